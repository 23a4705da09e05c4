"""Packing of tokenised documents into sequences: best fit decreasing, with bounds that certify it.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut.  Pieces are dealt to
partitions of about ITEMS pieces, and each is packed by best fit decreasing.  Dual-feasible functions
give a lower bound of each partition's sequences.  A partition that meets its bound is certified and
keeps its sequences, but for the emptiest one; one with a gap gives all its sequences that have room back.
What was given back is dealt anew, whole sequences at a time, so that partitions exchange documents,
and best fit decreasing runs again; a new packing is taken only where it needs fewer sequences.  Rounds end when
one partition holds all that is left, or when a round saves nothing.

Tokens come from the tokenizers library.  A worker remembers the ids of up to REMEMBER stretches of text
between which the vocabulary's splitting rule never joins anything.

Null texts count as empty: the end id alone.  Null ids and repeated rows are documents each for itself.
Equal lengths are interchangeable.  An empty table gives no rows.  A long text is held by one task while it
is encoded.  Only the named columns play a part.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.bpe import byte_characters
from stratum.llm.shared import picked, runs, stored
from stratum.llm.words import LOWER, Texts, slices

CAPACITY = 4096
END = 1
#: Pieces of a partition.
ITEMS = 1 << 16
ROUNDS = 12
REMEMBER = 800_000
#: Highest k of the rounding functions among the bounds.
STEPS = 60

#: Byte classes: white space, marks of punctuation, ASCII letters, first bytes of Latin letters of two bytes (U+00C0 to U+023F).
_SPACE, _MARK, _LETTER, _LATIN = (np.isin(np.arange(256), x) for x in ([0x20, *range(0x09, 0x0E)], [*b".,;:!?"], [*range(0x41, 0x5B), *range(0x61, 0x7B)], range(0xC3, 0xC9)))


def chunks(texts: Texts) -> tuple[pa.StringArray, np.ndarray]:
    """Stretches of text that are encoded each for itself, and where each text's stretches begin.

    They are what stands between ASCII white space; where that is Latin letters and marks of punctuation alone,
    letters and marks are parted too.  Not so U+00D7 and U+00F7, which are no letters, and U+0130, whose lower
    case ends in a combining mark."""
    data, n = texts.data[:-8], len(texts.data) - 8
    space, mark = _SPACE[data], _MARK[data]
    next_ = texts.data[1 : n + 1]
    two = _LATIN[data] & ~((data == 0xC3) & ((next_ == 0x97) | (next_ == 0xB7))) & ~((data == 0xC4) & (next_ == 0xB0))
    letter = _LETTER[data] | two
    letter[1:] |= two[:-1]
    start = ~space
    start[1:] &= space[:-1]
    first = texts.lo[texts.hi > texts.lo]
    start[first] = ~space[first]
    chunk = np.cumsum(start, dtype=np.int32) - 1
    plain = np.ones(max(1, int(chunk[-1]) + 1 if n else 1), bool)
    plain[chunk[~(space | letter | mark)]] = False
    plain = plain[chunk]  # bytes of chunks of letters and marks alone
    turn = np.zeros(n, bool)
    turn[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    at = np.flatnonzero(start | (turn & ~space & plain))
    solid = np.concatenate([[0], np.cumsum(~space, dtype=np.int32)])  # bytes that aren't space, before each
    offsets = np.append(solid[at], solid[-1]).astype(np.int32)
    low = np.where(plain, LOWER[data], data)  # the vocabulary knows no capitals
    values = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(low[~space]))
    return values, np.searchsorted(at, np.append(texts.lo, n))


#: Words of the letters that chunks() knows.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-\u012F\u0131-\u023F]+")


class Encoder:
    """Token ids of texts, by the tokenizers library.

    Words of Latin letters go to its model at once, past normalising and splitting, which only lower their case."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.characters = {b: c for c, b in byte_characters().items()}
        tried = ["the", "été", "zürich", "ǆßñĳ", "unbelievable"]
        self.direct = [self._of_word(w) for w in tried] == [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(tried, add_special_tokens=False)]

    def _of_word(self, word: str) -> bytes:
        found = self.tokenizer.model.tokenize(word.lower().encode().decode("latin-1").translate(self.characters))
        return np.array([t.id for t in found], "<u4").tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = words
        words_only = [w for w in new if self.direct and _WORD.fullmatch(w)]
        self.known.update((w, self._of_word(w)) for w in words_only)
        new = [w for w in new if w not in self.known]
        for w, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[w] = np.array(found.ids, "<u4").tobytes()
        return [self.known[w] for w in words]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, and where each text's begin."""
        values, begins = chunks(texts)
        coded = values.dictionary_encode()
        index = np.asarray(coded.indices)
        found = self._ids(coded.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in found], np.int32)
        flat, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size, dtype=np.int32) - size
        each = size[index]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int32)])
        ids = flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(start[index] - ends[:-1], each)]
        return ids, ends[begins]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: id, ``item`` (its own for each), ``piece``, ``start``, ``length``, ``ids_crc32``.  The file must be at ``path`` on every machine."""
    rows = picked(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, item = _encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for texts in slices(batch["text"]):
                ids, begins = encoder.encode(texts)
                owner, columns = [], ([], [], [], [])
                for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                    whole = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(whole), capacity)):
                        part = whole[at : at + capacity]
                        owner.append(texts.first + i)
                        for column, value in zip(columns, (k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                            column.append(value)
                numbers = pa.array(np.arange(item, item + len(owner)))
                item += len(owner)
                kept = batch["id"].take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept, numbers, pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "item", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, item bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of these lengths needs fewer sequences: the best of three families of dual-feasible functions.

    Identity and rounding down to multiples of 1/k, both with lengths under e dropped and those over
    capacity - e taken as whole ones, for every e; and the functions that count a length over one half by what
    it leaves."""
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    x, c, e = np.arange(capacity + 1), capacity, np.arange(capacity // 2 + 1)
    above = count.sum() - np.cumsum(count)  # longer than x
    best = 0
    for k in range(STEPS + 1):
        value = x if k == 0 else np.where((k + 1) * x % c == 0, k * x, (k + 1) * x // c * c)  # out of unit
        unit = c if k == 0 else k * c
        total = np.cumsum(value * count)
        low = np.where(e > 0, total[np.maximum(e, 1) - 1], 0)
        best = max(best, int((-(-(above[c - e] * unit + total[c - e] - low) // unit)).max()))
    half = x > c / 2
    for k in e[1:]:
        value = np.where(half, c // k - (c - x) // k, np.where(x >= k, 1, 0))
        best = max(best, -(-int((value * count).sum()) // (c // int(k))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit decreasing: the sequence number of each length.  Rooms are the bits of one integer."""
    order, size = np.argsort(-lengths, kind="stable"), lengths.tolist()
    out, used, rooms = [0] * len(size), 0, 0
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order.tolist():
        need = size[i]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, used
            used += 1
        out[i] = at
        left = room - need
        if left:
            with_room[left].append(at)
            rooms |= 1 << left
    return np.array(out, np.int64)


def _repacked(t: pa.Table, bucket: int, capacity: int, first: bool) -> tuple[np.ndarray, ...]:
    """Sequence ids, offsets, whether the piece goes into the next round, and how many sequences were saved."""
    length = np.asarray(t["length"])
    new = best_fit(length, capacity)
    ids = (bucket << 24) + new
    n, saved = int(new.max()) + 1, 0
    if not first:
        old = np.asarray(t["sequence_id"])
        before = len(np.unique(old))
        saved = max(0, before - n)
        if not saved:
            ids, n = old, before
    _, at = np.unique(ids, return_inverse=True)
    filled = np.bincount(at, length).astype(np.int64)
    certified = n == lower_bound(length, capacity)
    goes = np.arange(n) == filled.argmin() if certified else np.ones(n, bool)
    goes &= filled < capacity
    order = np.lexsort((np.asarray(t["item"]), at))
    total = np.cumsum(length[order]) - length[order]
    begins = np.r_[True, at[order][1:] != at[order][:-1]]
    offset = np.empty(len(at), np.int64)
    offset[order] = total - np.maximum.accumulate(np.where(begins, total, 0))
    return ids, offset, goes[at], np.full(len(at), saved)


def _round(pool: DataFrame, parts: int, base: int, capacity: int, first: bool) -> DataFrame:
    key = F.col("item") if first else F.col("sequence_id")
    dealt = pool.withColumn("bucket", F.pmod(F.xxhash64(key, F.lit(base)), F.lit(parts)) + base).repartition("bucket").sortWithinPartitions("bucket")
    names = ["id", "item", "piece", "start", "length", "ids_crc32"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "bucket"):
            t = pa.Table.from_batches(run).combine_chunks()
            made = _repacked(t, t["bucket"][0].as_py(), capacity, first)
            made = [pa.array(x) for x in made]
            yield from pa.Table.from_arrays([*(t[c] for c in names), *made], [*names, "sequence_id", "offset", "goes", "saved"]).to_batches(1 << 14)

    kind = pool.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(each, f"id {kind}, item bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, goes boolean, saved bigint")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """The pieces of ``cut`` with ``sequence_id`` and ``offset``: gapless from 0 in each sequence, at most ``capacity`` tokens."""
    pool = stored(cut_pieces)
    left, base = pool.count(), 0
    done = None
    for turn in range(rounds):
        parts = max(1, math.ceil(left / items))
        packed = stored(_round(pool, parts, base, capacity, turn == 0))
        base += parts
        left, saved = packed.agg(F.count_if("goes"), F.sum("saved")).first()
        last = turn + 1 == rounds or not left or parts == 1 or (turn and not saved)
        final = (packed if last else packed.where("NOT goes")).drop("goes", "saved")
        done = final if done is None else done.unionByName(final)
        if last:
            break
        pool = packed.where("goes")
    return done


def bound(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences there are, and the lower bound of all pieces together (from a count of each length)."""
    counts = packed.groupBy("length").count().collect()  # at most capacity rows
    one = np.array([r["length"] for r in counts], np.int64), np.array([r["count"] for r in counts], np.int64)
    return packed.agg(F.count_distinct("sequence_id")).first()[0], lower_bound(np.repeat(*one), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = pack(cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
    return made.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
