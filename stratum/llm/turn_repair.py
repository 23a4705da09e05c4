"""Repair of the structure of conversations by block tables, as the Four Russians speed up dynamic programs.

A conversation's rows are symbols (role initial, whether truncated, whether they must go).  What is left
to pay after a row depends on the state of the grammar ``(s?(ua)+)?`` alone: a vector of four costs.  Less
their least value, only a few such vectors exist; ``Tables`` holds for each vector and each block of BLOCK
symbols the vector before the block and what it adds.  Costs run from the last block to the first by
look-up; then each block is expanded backward from the vector behind it, and the edits are traced from
the first row on, always by the least letter that stays cheapest, so that ties are safe.

Edits: Delete (4), Insert an empty user or assistant turn (3), Keep (0), Rerole to user or assistant (3); a
truncated row that stays adds 3; blank and repeated rows must be deleted.

Conversations of more than LONG_ROWS rows or LONG_BYTES bytes are dealt by ranges of turns: pieces of
PIECE rows give their effect on each vector and state, which small tables compose in both directions.

Null roles and texts count as one space; null ids are one conversation; null turns come first.  Rows of equal
turns go by role and text.  A role without initial is as foreign as any other.  An empty table gives no
rows.  Long texts are never held for more than one conversation or piece.  Only the named columns play a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.shared import chosen, stored

BLOCK = 4
LONG_ROWS, LONG_BYTES = 4096, 8 << 20
#: Rows of a piece of a long conversation; a power of two.
PIECE = 256
#: That many ids of long conversations are sent to all tasks; more are joined.
SENT_IDS = 1 << 20

#: Symbols: 0 to 3 the role (system, user, assistant, other), 4 more if truncated, 8 must go, 9 no row.
GONE, NONE, SYMBOLS = 8, 9, 10
#: States: nothing yet, after system, after user, after assistant.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
LEGAL = {(START, 0): AFTER_S, (START, 1): AFTER_U, (AFTER_S, 1): AFTER_U, (AFTER_A, 1): AFTER_U, (AFTER_U, 2): AFTER_A}
#: The state after a user or assistant turn that is put in; which of them is legal follows from the state.
PUT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ENDS = ("", "II", "I", "")
SPACE = " \t\n\x0b\f\r"


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a row, but for inserting before it: letter, cost, next state."""
    if symbol == NONE:
        return [("", 0, state)]
    out = [("D", 4, state)]
    if symbol < GONE:
        more, role = 3 * (symbol // 4), symbol % 4
        if (state, role) in LEGAL:
            out.append(("K", more, LEGAL[state, role]))
        out.append(("R", 3 + more, PUT[state]))
    return out


def _before(vector: tuple, symbol: int) -> tuple:
    """Costs before a row from those after it."""
    if symbol == NONE:
        return vector
    plain = [min(c + vector[t] for _, c, t in _options(symbol, q)) for q in range(4)]
    return tuple(min(plain[q], 3 + plain[PUT[q]], 6 + plain[PUT[PUT[q]]]) for q in range(4))


class Tables:
    """Vectors, steps by one symbol and by blocks, and the edits of a row by (vector after it, symbol, state)."""

    def __init__(self):
        vectors = [tuple(3 * len(e) for e in ENDS)]
        known = {vectors[0]: 0}
        steps = []
        for v in vectors:  # grows while it is gone through
            for s in range(SYMBOLS):
                w = _before(v, s)
                least = min(w)
                w = tuple(x - least for x in w)
                if w not in known:
                    known[w] = len(vectors)
                    vectors.append(w)
                steps.append((known[w], least))
        self.vectors = np.array(vectors)
        steps = np.array(steps).reshape(len(vectors), SYMBOLS, 2)
        self.step, self.adds = steps[..., 0], steps[..., 1]
        self.block, self.block_adds = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), int)
        for _ in range(BLOCK):  # one more symbol in front
            to, more = self.step[self.block], self.adds[self.block] + self.block_adds[..., None]
            self.block, self.block_adds = (x.transpose(0, 2, 1).reshape(len(vectors), -1) for x in (to, more))
        self.edits, self.goes = np.zeros((len(vectors), SYMBOLS, 4), int), np.zeros((len(vectors), SYMBOLS, 4), int)
        self.strings: list[str] = []
        #: Turns that each string of edits leaves: (row kept, role code or -1 for the row's own).
        self.turns: list[list[tuple[bool, int]]] = []
        strings: dict = {}
        for i, v in enumerate(vectors):
            for s in range(SYMBOLS):
                for q in range(4):
                    letters, turns, state = self._traced(v, s, q)
                    k = strings.setdefault((letters, tuple(turns)), len(strings))
                    if k == len(self.strings):
                        self.strings.append(letters)
                        self.turns.append(turns)
                    self.edits[i, s, q], self.goes[i, s, q] = k, state

    @staticmethod
    def _traced(vector: tuple, symbol: int, state: int) -> tuple[str, list, int]:
        costs, letters, turns = _before(vector, symbol), "", []
        while True:
            ways = [(x, c + vector[t], t) for x, c, t in _options(symbol, state)]
            if symbol != NONE:
                ways.append(("I", 3 + costs[PUT[state]], PUT[state]))
            letter, _, to = min(w for w in ways if w[1] == costs[state])
            letters += letter
            if letter in ("I", "R"):
                turns.append((letter == "R", 1 if to == AFTER_U else 2))
            elif letter == "K":
                turns.append((True, -1))
            state = to
            if letter != "I":
                return letters, turns, state


@cache
def tables() -> Tables:
    return Tables()


def _blocks(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each conversation filled up to whole blocks (blocks x BLOCK), and where its blocks begin."""
    size = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(-(-size // BLOCK))])
    out = np.full(first[-1] * BLOCK, NONE)
    out[np.arange(len(symbols)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], size)] = symbols
    return out.reshape(-1, BLOCK), first


def costs_behind(blocks: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By look-up from the last block to the first: the vector behind each block, each conversation's first vector and what was added."""
    t = tables()
    codes, n = blocks @ (SYMBOLS ** np.arange(BLOCK)[::-1]), np.diff(first)
    now, added = last.copy(), np.zeros(last.shape, int)
    behind = np.zeros((len(blocks), *last.shape[1:]), int)
    for r in range(1, int(n.max(initial=0)) + 1):
        on = np.flatnonzero(n >= r)
        b = first[on] + n[on] - r
        behind[b] = now[on]
        code = codes[b].reshape(-1, *[1] * (last.ndim - 1))
        added[on] += t.block_adds[now[on], code]
        now[on] = t.block[now[on], code]
    return behind, now, added


def expanded(blocks: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The vector behind each symbol of each block, from the one behind the block backward."""
    t = tables()
    out = np.empty((*blocks.shape, *behind.shape[1:]), int)
    now = behind
    for j in range(BLOCK - 1, -1, -1):
        out[:, j] = now
        now = t.step[now, blocks[:, j].reshape(-1, *[1] * (behind.ndim - 1))]
    return out


def traced(blocks: np.ndarray, first: np.ndarray, after: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits of each symbol, and each conversation's last state, from its first state."""
    t = tables()
    symbols, after = blocks.reshape(-1), after.reshape(-1, *after.shape[2:])
    state, n = start.copy(), np.diff(first) * BLOCK
    edits = np.zeros((len(symbols), *start.shape[1:]), int)
    for k in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > k)
        at = first[on] * BLOCK + k
        s = symbols[at].reshape(-1, *[1] * (start.ndim - 1))
        v = after[at].reshape(len(at), *after.shape[1:], *[1] * (start.ndim - after.ndim))
        edits[at] = t.edits[v, s, state[on]]
        state[on] = t.goes[v, s, state[on]]
    return edits, state


def _marked(rows: DataFrame) -> DataFrame:
    """Adds ``initial`` (role code), ``blank`` and ``truncated`` to rows with role and text."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    code = F.element_at(F.create_map(*(F.lit(x) for pair in (("s", 0), ("u", 1), ("a", 2)) for x in pair)), F.substring("role", 1, 1))
    return rows.withColumns({"initial": F.coalesce(code, F.lit(3)), "blank": body == "", "truncated": ~F.substring(body, -1, 1).isin(".", "!", "?")})


_TURNS = "array<struct<role:string,text:string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL_PAIRS = np.zeros((4, 4), bool)
_LEGAL_PAIRS[[0, 1, 2], [1, 2, 1]] = True


class _Rows:
    """Conversations or pieces of a batch: a list column of structs as flat arrays."""

    def __init__(self, lists: pa.Array):
        self.offsets = np.asarray(lists.offsets).astype(int) - lists.offsets[0].as_py()
        flat = lists.flatten()
        self.field = lambda name: pc.struct_field(flat, name)
        self.size = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(lists)), self.size)

    def per(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[flags], minlength=len(self.size))

    def symbols(self, duplicate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, and the first faults: blank 1, duplicate 2, truncated 3."""
        blank, cut = np.asarray(self.field("blank")), np.asarray(self.field("truncated"))
        fault = np.where(blank, 1, np.where(duplicate, 2, np.where(cut, 3, 0)))
        initial = np.asarray(self.field("initial")).astype(np.int64)
        return np.where((fault == 1) | (fault == 2), GONE, initial + 4 * (fault == 3)), fault, initial

    def illegal(self, initial: np.ndarray) -> np.ndarray:
        bad = np.zeros(len(initial), bool)
        bad[1:] = ~_LEGAL_PAIRS[initial[:-1], initial[1:]] & (self.owner[1:] == self.owner[:-1])
        return self.per(bad)

    def turns(self, edits: np.ndarray, place: np.ndarray, tail: list[str], state: np.ndarray) -> tuple[list[str], pa.Array]:
        """Edit letters and turns of each conversation; ``place``: where the rows' edits stand; ``tail``: letters after its last row."""
        t = tables()
        audits, sizes, rows, codes = [], [0], [], []
        edits, end = edits[place].tolist(), self.offsets.tolist()
        for i in range(len(self.size)):
            letters = []
            for r in range(end[i], end[i + 1]):
                letters.append(t.strings[edits[r]])
                for kept, role in t.turns[edits[r]]:
                    rows.append(r if kept else -1)
                    codes.append(role)
            q = int(state[i])
            for _ in tail[i]:
                q = PUT[q]
                rows.append(-1)
                codes.append(1 if q == AFTER_U else 2)
            audits.append("".join(letters) + tail[i])
            sizes.append(len(rows))
        at, code = np.array(rows, int), np.array(codes, int)
        index = pa.array(at, mask=at < 0)
        own = pc.take(self.field("role"), index)
        names = pc.take(pa.array(["", "user", "assistant"]), pa.array(np.maximum(code, 0)))
        role = pc.if_else(pa.array(code < 0), own, names)
        text = pc.fill_null(pc.take(self.field("text"), index), "")
        return audits, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([role, text], ["role", "text"]))

    def place(self, first: np.ndarray) -> np.ndarray:
        return np.arange(len(self.owner)) + np.repeat(first[:-1] * BLOCK - self.offsets[:-1], self.size)


def _gaps(turn: pa.Array, rows: _Rows) -> np.ndarray:
    there = np.asarray(turn.is_valid())
    value, owner = np.asarray(pc.fill_null(turn, 0)).astype(np.int64)[there], rows.owner[there]
    low, high = np.full(len(rows.size), np.iinfo(np.int64).max), np.full(len(rows.size), np.iinfo(np.int64).min)
    np.minimum.at(low, owner, value)
    np.maximum.at(high, owner, value)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])  # turns are in order
    some = np.bincount(owner, minlength=len(low)) > 0
    return np.where(some, np.where(some, high, 0) - np.where(some, low, 0) + 1 - np.bincount(owner[new], minlength=len(low)), 0)


def _short(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole conversations."""
    rows = _Rows(batch["rows"])
    role, text = (np.asarray(pc.dictionary_encode(rows.field(k)).indices) for k in ("role", "text"))
    duplicate = np.ones(len(role), bool)
    if len(role):
        duplicate[np.unique(np.stack([rows.owner, role, text], 1), axis=0, return_index=True)[1]] = False
    symbols, fault, initial = rows.symbols(duplicate)
    blocks, first = _blocks(symbols, rows.offsets)
    behind, vector, added = costs_behind(blocks, first, np.zeros(len(rows.size), int))
    edits, state = traced(blocks, first, expanded(blocks, behind), np.zeros(len(rows.size), int))
    audits, turns = rows.turns(edits, rows.place(first), [ENDS[q] for q in state], state)
    counts = [_gaps(rows.field("turn"), rows), *(rows.per(fault == k) for k in (1, 2, 3)), rows.illegal(initial), added + tables().vectors[vector, START]]
    one = np.ones(len(rows.size), np.int64)
    out = [batch["id"], pa.array(one - 1), pa.array(one), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(audits, pa.string()), turns]
    return pa.RecordBatch.from_arrays(out, ["id", "piece", "pieces", *_COUNTS, "audit", "turns"])


def _pass(df: DataFrame, each, schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: (each(b.slice(at, 64)) for b in batches for at in range(0, b.num_rows, 64)), schema)


def _effects(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of each piece: the vector before it and what it adds, for each vector behind it, and the last state for each first one besides."""
    rows, v = _Rows(batch["rows"]), len(tables().vectors)
    symbols, fault, initial = rows.symbols(np.asarray(rows.field("duplicate")))
    blocks, first = _blocks(symbols, rows.offsets)
    n = len(rows.size)
    behind, vector, added = costs_behind(blocks, first, np.tile(np.arange(v), (n, 1)))
    _, state = traced(blocks, first, expanded(blocks, behind), np.tile(np.arange(4), (n, v, 1)))
    lists = [pa.array(list(x.reshape(n, -1)), pa.list_(pa.int64())) for x in (vector, added, state)]
    ends = [pa.array(initial[rows.offsets[:-1]]), pa.array(initial[rows.offsets[1:] - 1])]
    counts = [pa.array(c.astype(np.int64)) for c in (*(rows.per(fault == k) for k in (1, 2, 3)), rows.illegal(initial))]
    return pa.RecordBatch.from_arrays([batch["id"], batch["piece"], *lists, *ends, *counts], ["id", "piece", "vector", "added", "state", "one", "other", *_COUNTS[1:5]])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from a conversation's last to its first: the vector behind each, and what is added from it on."""
    last: tuple | None = None
    now = total = 0
    for b in batches:
        ids, vector, added, state = (b[c].to_pylist() for c in ("id", "vector", "added", "state"))
        right, sums, to = [], [], []
        for i, x in enumerate(ids):
            if last is None or last[0] != x:
                now = total = 0
                last = (x,)
            right.append(now)
            to.append(state[i][4 * now : 4 * now + 4])
            total += added[i][now]
            now = vector[i][now]
            sums.append(total + int(tables().vectors[now, START]))
        yield pa.RecordBatch.from_arrays([b["id"], b["piece"], pa.array(right, pa.int64()), pa.array(sums, pa.int64()), pa.array(to, pa.list_(pa.int64()))], ["id", "piece", "behind", "total", "to"])


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from a conversation's first to its last: number and first state."""
    last: tuple | None = None
    now = number = 0
    for b in batches:
        numbers, states = [], []
        for x, to in zip(b["id"].to_pylist(), b["to"].to_pylist(), strict=True):
            if last is None or last[0] != x:
                now, number, last = START, 0, (x,)
            numbers.append(number)
            states.append(now)
            number += 1
            now = to[now]
        yield pa.RecordBatch.from_arrays([b["id"], b["piece"], b["behind"], b["total"], pa.array(numbers, pa.int64()), pa.array(states, pa.int64())], ["id", "piece", "behind", "total", "number", "start"])


def _finished(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Edits and turns of pieces whose vector behind and first state are known."""
    rows = _Rows(batch["rows"])
    symbols, _, _ = rows.symbols(np.asarray(rows.field("duplicate")))
    blocks, first = _blocks(symbols, rows.offsets)
    behind, _, _ = costs_behind(blocks, first, np.asarray(batch["behind"]).astype(int))
    edits, state = traced(blocks, first, expanded(blocks, behind), np.asarray(batch["start"]).astype(int))
    ends = np.asarray(batch["number"]) + 1 == np.asarray(batch["pieces"])
    audits, turns = rows.turns(edits, rows.place(first), [ENDS[q] if e else "" for q, e in zip(state, ends, strict=True)], state)
    kept = [batch[c] for c in ("number", "pieces", *_COUNTS)]
    return pa.RecordBatch.from_arrays([batch["id"], *kept, pa.array(audits, pa.string()), turns], ["id", "piece", "pieces", *_COUNTS, "audit", "turns"])


def _long(rows: DataFrame, piece: int) -> DataFrame:
    """Conversations of any length: ranges of turns, pieces, effects composed both ways, pieces finished."""
    kind = rows.schema["id"].dataType.simpleString()
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "mark"]
    dealt = rows.withColumn("mark", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(_marked(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("digest", F.sha2("text", 256))))
    earliest = placed.groupBy(F.col("id").alias("i"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("at").alias("earliest"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    told = placed.join(earliest, same).withColumns({"duplicate": F.col("at") > F.col("earliest"), "piece": F.shiftright("at", piece.bit_length() - 1)})
    one = F.struct("at", "turn", "role", "text", "initial", "blank", "truncated", "duplicate")
    held = stored(told.groupBy("id", "piece").agg(F.sort_array(F.collect_list(one)).alias("rows")))  # at most PIECE rows each
    slim = held.select("id", "piece", F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in ("initial", "blank", "truncated", "duplicate")))).alias("rows"))
    counts = ", ".join(f"{c} bigint" for c in _COUNTS[1:5])
    effects = stored(_pass(slim, _effects, f"id {kind}, piece bigint, vector array<bigint>, added array<bigint>, state array<bigint>, one bigint, other bigint, {counts}"))
    down = effects.select("id", "piece", "vector", "added", "state").repartition("id").sortWithinPartitions("id", F.desc("piece")).mapInArrow(_down, f"id {kind}, piece bigint, behind bigint, total bigint, to array<bigint>")
    up = stored(stored(down).repartition("id").sortWithinPartitions("id", "piece").mapInArrow(_up, f"id {kind}, piece bigint, behind bigint, total bigint, number bigint, start bigint"))
    # seams between pieces, counts of whole conversations
    before = effects.select("id", "piece", "one", "other", *_COUNTS[1:5]).join(up.withColumnsRenamed({"id": "i", "piece": "p"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("piece") == F.col("p")))
    pairs = before.select("id", F.explode(F.array(F.struct(F.col("number").alias("seam"), F.col("one").alias("right"), F.lit(None).cast("bigint").alias("left")), F.struct((F.col("number") + 1).alias("seam"), F.lit(None).cast("bigint").alias("right"), F.col("other").alias("left")))).alias("x")).select("id", "x.*")
    seams = pairs.groupBy("id", "seam").agg(F.max("left").alias("left"), F.max("right").alias("right")).where("left IS NOT NULL AND right IS NOT NULL")
    legal = F.concat("left", F.lit(":"), "right").isin("0:1", "1:2", "2:1")
    bad = seams.groupBy("id").agg(F.sum(F.when(legal, 0).otherwise(1)).alias("seams"))
    sums = before.groupBy("id").agg(*(F.sum(c).alias(c) for c in _COUNTS[1:5]), F.count(F.lit(1)).alias("pieces"), F.max(F.when(F.col("number") == 0, F.col("total"))).alias("cost"))
    turns = placed.select("id", "turn").distinct().groupBy("id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    whole = sums.join(turns.withColumnRenamed("id", "i"), F.col("id").eqNullSafe(F.col("i"))).drop("i").join(bad.withColumnRenamed("id", "i"), F.col("id").eqNullSafe(F.col("i")), "left").drop("i")
    whole = whole.withColumn("illegal", F.col("illegal") + F.coalesce("seams", F.lit(0)))
    known = up.drop("total").join(whole.withColumnRenamed("id", "w"), F.col("id").eqNullSafe(F.col("w"))).drop("w", "seams").withColumnsRenamed({"id": "i", "piece": "p"})
    ready = held.join(known, F.col("id").eqNullSafe(F.col("i")) & (F.col("piece") == F.col("p"))).select("id", "number", "pieces", *_COUNTS, "behind", "start", "rows")
    return _pass(ready, _finished, _schema(kind))


def _schema(kind: str) -> str:
    return f"id {kind}, piece bigint, pieces bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, turns {_TURNS}"


def repair(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lost_col: str | None = None,
    long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, piece: int = PIECE,
) -> DataFrame:
    """The repaired conversations: id, ``piece`` (from 0) of ``pieces``, gaps, blank, duplicate, truncated, illegal and cost of
    the whole conversation, the piece's ``audit`` (letters of its edits) and its ``turns`` (role, text).

    All but long conversations are one piece.  Rows whose ``lost_col`` is true play no part, but
    their conversation is in the result."""
    names = {"id": id_col, "turn": turn_col, "role": role_col, "text": text_col} | ({"lost": lost_col} if lost_col else {})
    all_ = chosen(rows, **names).withColumns({"role": F.coalesce(F.col("role").cast("string"), F.lit(" ")), "text": F.coalesce(F.col("text").cast("string"), F.lit(" "))})
    kind = all_.schema["id"].dataType.simpleString()
    there = ~F.coalesce("lost", F.lit(False)) if lost_col else F.lit(True)
    big = all_.where(there).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).where((F.col("n") > long_rows) | (F.col("b") > long_bytes))
    big = stored(big.select(F.col("id").alias("i")))
    n = big.count()
    same = F.col("id").eqNullSafe(F.col("i"))
    ids = F.broadcast(big) if n <= SENT_IDS else big
    short = all_.join(ids, same, "left_anti") if n else all_
    one = F.when(there, F.struct("turn", "role", "text", "initial", "blank", "truncated"))
    lists = _marked(short).groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("rows"))  # at most LONG_ROWS rows and LONG_BYTES bytes
    out = _pass(lists, _short, _schema(kind))
    if n:
        out = out.unionByName(_long(all_.where(there).join(ids, same, "left_semi").drop("lost"), piece))
    return out.withColumnRenamed("id", id_col)


def turns(repaired: DataFrame) -> DataFrame:
    """The repaired conversations as rows: the id, ``number`` (piece, place in it), role, text."""
    id_col = repaired.columns[0]
    return repaired.select(id_col, "piece", F.posexplode("turns").alias("place", "t")).select(id_col, "piece", "place", "t.role", "t.text")


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: its counts, the whole ``audit`` and ``repaired_sha256`` of its ``role:text`` lines.

    Conversations of several pieces stream through one task in order, as their digest asks for."""
    id_col = repaired.columns[0]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    columns = [id_col, *_COUNTS, "audit", "repaired_sha256"]
    one = repaired.where("pieces = 1").withColumn("repaired_sha256", F.sha2(lines, 256)).select(*columns)
    many = repaired.where("pieces > 1").withColumns({"lines": lines, "some": F.size("turns") > 0}).drop("turns").withColumnRenamed(id_col, "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, begun = hashlib.sha256(), [], False
        for whole in batches:
            for b in (whole.slice(i, 1) for i in range(whole.num_rows)):
                if b["some"][0].as_py():
                    digest.update((b"\n" if begun else b"") + b["lines"][0].as_py().encode())
                    begun = True
                audit.append(b["audit"][0].as_py())
                if b["piece"][0].as_py() + 1 == b["pieces"][0].as_py():
                    yield pa.RecordBatch.from_arrays([b["id"], *(b[c] for c in _COUNTS), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["id", *_COUNTS, "audit", "repaired_sha256"])
                    digest, audit, begun = hashlib.sha256(), [], False

    kind = repaired.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return one.unionByName(many.repartition("id").sortWithinPartitions("id", "piece").mapInArrow(each, schema).withColumnRenamed("id", id_col))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn`` modulo 20 a row is lost (0), emptied (1), stripped of ``.!?`` (2), repeated (3) or made a user's (4)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = chosen(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    kind: Column = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    words = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), words.alias("text"), (F.col("kind") == 0).alias("lost"), F.explode(times).alias("copy")).drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), lost_col="lost"))


#: Costs and letters of the best way to each state, as strings of nine digits and letters, row by row.
SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: [ascii(c)::UBIGINT, 500, 500, 500, 500, 500, 500, 500, 500]))),
      lambda c, x: CASE WHEN x < 256 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::UBIGINT) % 20 AS kind
  FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM base CROSS JOIN (VALUES (0), (1)) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final, substr(role, 1, 1) AS x FROM d),
f AS (SELECT *, CASE WHEN final = '' THEN 'b' WHEN again THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lead(x) OVER (PARTITION BY conv_id ORDER BY i) AS y FROM p),
way AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS s, NULL::VARCHAR AS p, '000000003I' AS u, '000000006II' AS a FROM (SELECT DISTINCT conv_id FROM base)
  UNION ALL
    SELECT conv_id, i, s, p, u, least(a, lpad((substr(u, 1, 9)::INT + 3)::VARCHAR, 9, '0') || substr(u, 10) || 'I') AS a FROM (
      SELECT conv_id, i, s, p, least(u, lpad((substr(least(s, p, a), 1, 9)::INT + 3)::VARCHAR, 9, '0') || substr(least(s, p, a), 10) || 'I') AS u, a FROM (
        SELECT w.conv_id, r.i,
          lpad((substr(s, 1, 9)::INT + 4)::VARCHAR, 9, '0') || substr(s, 10) || 'D' AS s,
          least(lpad((substr(p, 1, 9)::INT + 4)::VARCHAR, 9, '0') || substr(p, 10) || 'D', CASE WHEN r.fault IN ('', 't') AND x = 's' THEN lpad((substr(s, 1, 9)::INT + t)::VARCHAR, 9, '0') || substr(s, 10) || 'K' END) AS p,
          least(lpad((substr(u, 1, 9)::INT + 4)::VARCHAR, 9, '0') || substr(u, 10) || 'D', CASE WHEN r.fault IN ('', 't') THEN least(lpad((substr(least(s, p, a), 1, 9)::INT + 3 + t)::VARCHAR, 9, '0') || substr(least(s, p, a), 10) || 'R',
            CASE WHEN x = 'u' THEN lpad((substr(least(s, p, a), 1, 9)::INT + t)::VARCHAR, 9, '0') || substr(least(s, p, a), 10) || 'K' END) END) AS u,
          least(lpad((substr(a, 1, 9)::INT + 4)::VARCHAR, 9, '0') || substr(a, 10) || 'D', CASE WHEN r.fault IN ('', 't') THEN least(lpad((substr(u, 1, 9)::INT + 3 + t)::VARCHAR, 9, '0') || substr(u, 10) || 'R',
            CASE WHEN x = 'a' THEN lpad((substr(u, 1, 9)::INT + t)::VARCHAR, 9, '0') || substr(u, 10) || 'K' END) END) AS a
        FROM way w JOIN (SELECT conv_id AS c, i, x, fault, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t FROM f) r ON r.c IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
last AS (SELECT conv_id, arg_max(least(s, a), i) AS best FROM way GROUP BY conv_id),
walk AS (
  SELECT conv_id, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit, 1 AS k, 0::BIGINT AS i, '' AS before, NULL::VARCHAR AS line FROM last
  UNION ALL
  SELECT w.conv_id, cost, audit, k + 1, CASE WHEN c = 'I' THEN w.i ELSE w.i + 1 END, CASE WHEN c = 'D' THEN before WHEN c = 'K' THEN f.x WHEN before = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN c = 'D' THEN NULL WHEN c = 'K' THEN f.role || ':' || f.text ELSE CASE WHEN before = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN c = 'I' THEN '' ELSE f.text END END
  FROM (SELECT *, substr(audit, k, 1) AS c FROM walk WHERE k <= length(audit)) w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
text AS (SELECT conv_id, any_value(cost) AS cost, any_value(audit) AS audit, sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS repaired_sha256 FROM walk GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (y IS NOT NULL AND x || y NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT t.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, repaired_sha256
FROM text t LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""
