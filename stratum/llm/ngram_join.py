"""Grouped prefix join of documents by the Jaccard similarity of their 5-word shingles.

1. Every shingle is counted over all documents, exactly but for a cut of its hash: texts are read in
   units of about ``UNIT`` shingles, whose hashes go, as packed arrays, to the task of their range, and
   come back with their frequency.  A shingle of one document only never comes back.
2. Shingles get one global order, rare ones first.  Two sets with a Jaccard similarity of ``t`` share one
   of the first ``n - ceil(t n) + 1`` shingles of either (the prefix), so only prefixes are joined; and the
   smaller set has it among its first ``n - ceil(2 t n / (1 + t)) + 1``.  Shingles of one document only
   take up places in a prefix, but aren't joined: most documents have none to join.
3. Documents with the same shingle set are one member; members with identical prefixes and sizes are one
   group, and only groups are joined.
4. In each bucket of a prefix shingle, all groups of fitting size are paired with the bucket's smallest
   one, and the members of a group with its smallest: that is linear, and joins nearly all members of a
   large family of near copies.  The pairs are verified against the whole texts, and connected components
   of the links labelled.
5. In buckets with several labels, members that don't have the bucket's main label are paired with a few of
   those that have it, and labels with each other in small random lots, in turns, as long as that links many:
   families whose copies are only just similar come together in this way, again by a linear number of pairs.
6. Groups in buckets with several labels are expanded, and pairs of members with different labels are
   filtered before any of them is emitted, then verified likewise.  Large buckets are dealt out as pairs of
   blocks of about ``BLOCK`` members, of which one at least isn't of the bucket's main label.

Pairs are filtered by a parity sketch of the whole set, in which each shingle turns one bit: two sketches
differ in no more bits than the sets differ in shingles, so no link is lost.  A member's sketch has about
as many bits as the member has shingles.

No link between different texts is lost: every pair that shares a prefix shingle is verified, filtered
by a bound that no link passes, or has both ends in one component already.

Rows are documents each for itself, whatever their ids.  Texts without words have the empty set:
``n_shingles`` 0, linked with nothing, their own id as component.  A component is named by its smallest
id that isn't null, by null if it has none.  Repeated rows are all returned, and are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm import words as W
from stratum.llm.shared import arrow_pass, numbered, picked, pieces, place, runs, stored
from stratum.operators.components import label_edges

SHINGLE = 5
PERCENT = 80
#: Shingles of a unit, and of a range of hashes, at which it is closed (one text more may stand in a unit).
UNIT = RANGE = 1 << 19
#: Documents of a unit at most: their numbers take two bytes.
UNIT_DOCS = (1 << 16) - 1
#: Ranges at most: beyond UNIT * MOST_RANGES shingles a range, and what a task holds of it, grows.
MOST_RANGES = 1 << 16
#: Texts of pairs up to this number are found by a broadcast of their ids (fixed-size rows), beyond it by a shuffle.
BROADCAST_TEXTS = 300_000
#: Members of a bucket in one block, and partners that one copy of a text is compared with.
BLOCK = 512
PARTNERS = 32
#: Turns of pairing what isn't linked yet with members of other labels, and how many of them; a turn that
#: links less than one pair in ``WORTH`` is the last.  What they don't link, step 6 does.
TURNS, TRIES, WORTH = 4, 8, 16
#: Labels of a bucket in one lot.
LOT = 8
#: Pairs that are filtered at a time.
PAIRS = 1 << 18


def shingles(column: pa.Array, distinct: bool = True) -> Iterator[tuple[W.Texts, np.ndarray, np.ndarray]]:
    """For each slice of a string column: the slice, shingles, text of each; sorted by text and value if distinct."""
    for t in W.slices(column, lower=True):
        w = W.words(t, W.SPACE_WORDS)
        n = np.bincount(w.doc, minlength=len(t))
        g = W.grams(w.hash, SHINGLE)
        full = w.doc[: len(g)] == w.doc[SHINGLE - 1 :] if len(g) else np.zeros(0, bool)
        g, doc = g[full], w.doc[: len(g)][full]
        few = np.flatnonzero((n > 0) & (n < SHINGLE))
        if len(few):  # the whole sequence as one shingle
            first = np.searchsorted(w.doc, few)
            g = np.concatenate([g, [np.bitwise_xor.reduce(W.mix(w.hash[a : a + n[d]] + np.arange(1, n[d] + 1).astype(W.U))) for d, a in zip(few, first, strict=True)]])
            doc = np.concatenate([doc, few])
        if distinct:
            order = np.argsort(g, kind="stable")
            order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
            g, doc = g[order], doc[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
            g, doc = g[new], doc[new]
        yield t, g, doc


def _prefix(n):
    """Length of the prefix of a set of n shingles."""
    return n - -(-PERCENT * n // 100) + 1


def _prefix_of_smaller(n):
    """Length of the prefix in which the smaller of two sets has a common shingle."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1


def _sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity sketch of sets of n shingles: a power of two, 64 at least."""
    least = np.where(n <= 2048, n, np.maximum(2048, (n + 1) // 2))
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(least, 1))).astype(np.int64))


def _raw(column: pa.Array, kind) -> np.ndarray:
    """The values of all the byte strings of a column, one after the other."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column)])


_INFO = np.dtype([("n", "<i8"), ("fp", "<i8"), ("first", "?"), ("digest", "V16")])


def _ranges(rows: DataFrame) -> int:
    """Binary logarithm of the number of ranges for the shingles of ``rows``: a word has about six bytes."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_RANGES.bit_length() - 1, max(2, (size // 6 // RANGE).bit_length()))


def _units(rows: DataFrame, bits: int) -> DataFrame:
    """The shingles of ``rows`` (id, text, fp), packed by unit and range; of each unit, one row (range < 0) tells its documents."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        infos: list[np.ndarray] = []
        sketches: list[bytes] = []
        hashes: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        seen: set[bytes] = set()
        held = taken = 0

        def close() -> pa.RecordBatch:
            nonlocal serial
            unit = (part << 32) + serial  # the same again if the task runs again
            serial += 1
            info, g, d = np.concatenate(infos), np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(g >> W.U(32 - bits))
            g, d = g[order], d[order]
            low = (g >> W.U(32 - bits)).astype(np.uint32)
            range_ = (g >> W.U(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], range_[1:] != range_[:-1]])) if len(g) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(g))[: len(cuts)]
            of = pa.concat_arrays(ids)
            none = pa.ListArray.from_arrays(pa.array([None] * len(cuts) + [0, len(of)], pa.int32()), of) if len(cuts) else pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of)
            columns = [
                pa.array([unit] * (len(cuts) + 1), pa.int64()), pa.array([*range_[cuts].tolist(), -1 - unit % (1 << bits)], pa.int32()),
                pa.array([*(low[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)), None], pa.binary()),
                pa.array([*(d[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts, ends, strict=True)), None], pa.binary()),
                none, pa.array([None] * len(cuts) + [info.tobytes()], pa.binary()), pa.array([None] * len(cuts) + [b"".join(sketches)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["unit", "range", "hashes", "docs", "ids", "info", "sketches"])

        for batch in pieces(batches):
            for t, g, doc in shingles(batch["text"]):
                size = np.bincount(doc, minlength=len(t))
                ends = np.concatenate([[0], np.cumsum(size)])
                at = 0
                while at < len(t):  # as many texts as the unit has room for, one at least
                    to = min(len(t), at + max(1, UNIT_DOCS - taken), max(at + 1, int(np.searchsorted(ends, ends[at] + UNIT - held, "right")) - 1))
                    info = np.zeros(to - at, _INFO)
                    info["n"] = size[at:to]
                    info["fp"] = np.asarray(batch["fp"])[t.first + at : t.first + to]
                    for k in range(at, to):
                        digest = hashlib.blake2b(g[ends[k] : ends[k + 1]].tobytes(), digest_size=16).digest()
                        info["digest"][k - at] = np.void(digest)
                        info["first"][k - at] = size[k] > 0 and digest not in seen
                        seen.add(digest)
                    one = info["first"]
                    keep = np.repeat(one, size[at:to])
                    mine, d = g[ends[at] : ends[to]][keep], (doc[ends[at] : ends[to]] - at)[keep]
                    wide = np.where(one, _sketch_bits(size[at:to]), 0)
                    start = np.concatenate([[0], np.cumsum(wide)])
                    turned = np.bincount(start[d] + (mine & (wide[d] - 1).astype(W.U)).astype(np.int64), minlength=start[-1]) & 1
                    sketches.append(np.packbits(turned.astype(np.uint8), bitorder="little").tobytes())
                    ids.append(batch["id"].slice(t.first + at, to - at))
                    infos.append(info)
                    hashes.append(mine)
                    docs.append(d + taken)
                    taken += to - at
                    held += len(mine)
                    at = to
                    if held >= UNIT or taken >= UNIT_DOCS:
                        yield close()
                        ids, infos, sketches, hashes, docs, seen, held, taken = [], [], [], [], [], set(), 0, 0
        if taken:
            yield close()

    return rows.mapInArrow(pack, f"unit bigint, range int, hashes binary, docs binary, ids array<{kind}>, info binary, sketches binary")


def _counted(units: DataFrame) -> DataFrame:
    """Of the packed shingles those that several documents of the table have, with their rank: twice the logarithm of how many have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "range"):
            if run[0]["range"][0].as_py() < 0:
                for batch in run:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], [*batch.schema.names, "ranks"])
                continue
            blobs = [np.frombuffer(x.as_buffer(), np.uint32) for batch in run for x in batch["hashes"]]
            docs = [np.frombuffer(x.as_buffer(), np.uint16) for batch in run for x in batch["docs"]]
            unit = [u for batch in run for u in batch["unit"].to_pylist()]
            h = np.concatenate(blobs)
            order = np.argsort(h)
            s = h[order]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            many = np.diff(np.append(new, len(s)))
            rank = np.empty(len(h), np.uint8)
            rank[order] = np.repeat(np.minimum(63, 2 * np.log2(many)).astype(np.uint8), many)
            ends = np.cumsum([len(b) for b in blobs])
            out = []
            for u, b, d, r in zip(unit, blobs, docs, np.split(rank, ends[:-1]), strict=True):
                shared = r > 0
                if shared.any():
                    out.append((u, b[shared].tobytes(), d[shared].tobytes(), r[shared].tobytes()))
            if out:
                u, b, d, r = zip(*out, strict=True)
                none = len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u, pa.int64()), pa.array([run[0]["range"][0].as_py()] * none, pa.int32()), pa.array(b, pa.binary()), pa.array(d, pa.binary()),
                     pa.nulls(none, run[0].schema.field("ids").type), pa.nulls(none, pa.binary()), pa.nulls(none, pa.binary()), pa.array(r, pa.binary())],
                    [*run[0].schema.names, "ranks"],
                )

    kind = units.schema["ids"].dataType.simpleString()
    dealt = units.repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(count, f"unit bigint, range int, hashes binary, docs binary, ids {kind}, info binary, sketches binary, ranks binary")


def _sets(rows: DataFrame) -> DataFrame:
    """Of each row: id, fingerprint of the text, number of shingles, digest of the set; of one row of each set in a unit also
    the group (digest of size and prefix), the sketch, and the shared shingles of the prefix as order keys (rank, then hash)
    with how many others stand before them."""
    bits = _ranges(rows)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "unit"):
            head = next(b.slice(i, 1) for b in run for i in range(b.num_rows) if b["info"][i].is_valid)
            info = np.frombuffer(head["info"][0].as_buffer(), _INFO)
            ids, n, first = head["ids"].flatten(), info["n"].astype(np.int64), info["first"]
            found = [b.filter(b["info"].is_null()) for b in run]
            found = [b for b in found if b.num_rows]
            doc = np.concatenate([np.zeros(0, np.int64), *(_raw(b["docs"], np.uint16).astype(np.int64) for b in found)])
            low = np.concatenate([np.zeros(0, W.U), *(_raw(b["hashes"], np.uint32).astype(W.U) for b in found)])
            rank = np.concatenate([np.zeros(0, W.U), *(_raw(b["ranks"], np.uint8).astype(W.U) for b in found)])
            size = [len(x.as_buffer()) // 4 for b in found for x in b["hashes"]]
            range_ = np.repeat(np.concatenate([np.zeros(0, np.int64), *(np.asarray(b["range"]) for b in found)]).astype(W.U), size)
            key = (rank << W.U(58)) | (range_ << W.U(32)) | low
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            shared = np.bincount(doc, minlength=len(n))
            alone = np.where(first, n - shared, 0)
            take = np.where(first, np.maximum(0, _prefix(n) - alone), 0)
            starts = np.cumsum(shared) - shared
            key = key[np.arange(len(key)) - starts[doc] < take[doc]].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(take)])
            wide = np.concatenate([[0], np.cumsum(np.where(first, _sketch_bits(n) // 8, 0))])
            raw = head["sketches"][0].as_buffer()
            digest = [d.tobytes() for d in info["digest"]]
            group = [None] * len(n)
            for k in np.flatnonzero(first):
                mark = key[ends[k] : ends[k + 1]].tobytes() + int(n[k]).to_bytes(8, "little") if not alone[k] else digest[k]
                group[k] = hashlib.blake2b(mark, digest_size=16, key=b"shared" if not alone[k] else b"alone").digest()
            sketch = [raw[wide[k] : wide[k + 1]].to_pybytes() if first[k] else None for k in range(len(n))]
            none = ~first
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(info["fp"].astype(np.int64)), pa.array(n), pa.array(digest, pa.binary()), pa.array(group, pa.binary()), pa.array(sketch, pa.binary()),
                 pa.array(alone, mask=none), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(key), mask=pa.array(none))],
                ["id", "fp", "n", "digest", "start", "sketch", "before", "prefix"],
            )

    counted = _counted(_units(rows, bits)).repartition("unit").sortWithinPartitions("unit")
    return counted.mapInArrow(unpack, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint, n bigint, digest binary, start binary, sketch binary, before bigint, prefix array<bigint>")


def _fits(a: str, b: str) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _near(sketches: pa.Array, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether members a[i] and b[i] may be similar: their sketches differ in no more bits than similar sets differ in shingles."""
    wide = _sketch_bits(n)
    out = np.zeros(len(a), bool)
    least = np.minimum(wide[a], wide[b])
    for w in np.unique(least):
        at = np.flatnonzero(least == w)
        used, back = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        bits = np.empty((len(used), w // 64), np.uint64)
        for i, k in enumerate(used.tolist()):
            x = np.frombuffer(sketches[k].as_buffer(), np.uint64)
            while len(x) > w // 64:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            bits[i] = x
        for s in range(0, len(at), max(1, (1 << 22) // (w // 8))):
            e = min(len(at), s + max(1, (1 << 22) // (w // 8)))
            apart = np.bitwise_count(bits[back[s:e]] ^ bits[back[len(at) + s : len(at) + e]]).sum(1, dtype=np.int64)
            out[at[s:e]] = (100 + PERCENT) * apart <= (100 - PERCENT) * (n[a[at[s:e]]] + n[b[at[s:e]]])
    return out


def _links(pairs: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of members whose whole texts have the similarity.

    A text goes once to every ``PARTNERS`` texts that it is compared with."""
    pairs = stored(pairs.distinct())
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    ends = dealt.select("a", "part", F.explode(F.array("a", "b")).alias("m")).distinct()
    asked = stored(ends.join(members.select("m", F.col("rep.id").alias("__id"), F.col("rep.fp").alias("__fp")), "m"))
    if asked.count() <= BROADCAST_TEXTS:  # then few texts are needed, and the others aren't shuffled
        asked = F.broadcast(asked)
    found = rows.join(asked, (rows["fp"] == F.col("__fp")) & rows["id"].eqNullSafe(F.col("__id"))).select("a", "part", (F.col("m") != F.col("a")).alias("other"), "m", "text")
    found = found.repartition("a", "part").sortWithinPartitions("a", "part", "other", "m")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine, last = None, np.zeros(0, W.U), -1
        for batch in pieces(batches):
            a, part, m = (np.asarray(batch[c]) for c in ("a", "part", "m"))
            out = []
            for t, g, doc in shingles(batch["text"]):
                ends = np.searchsorted(doc, np.arange(len(t) + 1))
                for k in range(len(t)):
                    at, own = t.first + k, g[ends[k] : ends[k + 1]]
                    if (a[at], part[at]) != held:  # member a comes first
                        held, mine, last = (a[at], part[at]), own.copy(), m[at]
                    elif m[at] != last:
                        last = m[at]
                        common = np.count_nonzero(mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own) if len(mine) else 0
                        if 100 * common >= PERCENT * (len(mine) + len(own) - common):
                            out.append((a[at], m[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return found.mapInArrow(each, "a bigint, b bigint")


def _star(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, na, nb, sa, sb) those whose sizes and sketches fit."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.num_rows
        n = np.concatenate([np.asarray(batch["na"]), np.asarray(batch["nb"])])
        near = _near(pa.concat_arrays([batch["sa"], batch["sb"]]), n, np.arange(k), np.arange(k) + k)
        return batch.select(["a", "b"]).filter(pa.array(near))

    return arrow_pass(pairs.where(_fits("na", "nb")), each, "a bigint, b bigint")


def _rest(dealt: DataFrame) -> DataFrame:
    """Pairs (a, b) with different labels that may be similar, from buckets dealt as blocks x and y.

    dealt: key, x, y, own (the row's block), m, n, pos (place of the key in the member's order), last (the key before it),
    label, sketch.  Two members with the same key before this one have met in its bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for run in runs(batches, "key", "x", "y"):  # small buckets are handled together
            held += run
            size += sum(b.num_rows for b in run)
            if size >= 2 * BLOCK:
                yield from pairs(held)
                held, size = [], 0
        if held:
            yield from pairs(held)

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        key, x, y, own, m, n, pos, label = (t[c].to_numpy() for c in ("key", "x", "y", "own", "m", "n", "pos", "label"))
        sketch = t["sketch"].combine_chunks()
        sketch = sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        end = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
        ahead = end - np.arange(len(key)) - 1
        total = np.cumsum(ahead)
        early = pos < _prefix_of_smaller(n)
        last = t["last"].combine_chunks()
        first, last = last.is_null().to_numpy(zero_copy_only=False), last.fill_null(0).to_numpy()
        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            i = np.repeat(np.arange(at, to), ahead[at:to])
            j = np.arange(len(i)) - np.repeat(np.cumsum(ahead[at:to]) - ahead[at:to], ahead[at:to]) + i + 1
            fine = (label[i] != label[j]) & ((x[i] == y[i]) | (own[i] != own[j])) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
            fine &= ((n[i] <= n[j]) & early[i]) | ((n[j] <= n[i]) & early[j])
            fine &= first[i] | first[j] | (last[i] != last[j])
            i, j = i[fine], j[fine]
            if len(i):
                near = _near(sketch, n, i, j)
                both = np.unique(np.stack([np.minimum(m[i], m[j])[near], np.maximum(m[i], m[j])[near]], 1), axis=0)
                if len(both):
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])
            at = to

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(each, "a bigint, b bigint")


def _tries(posts: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of members with different labels, a few for each b: a stands for the main label of one of its buckets,
    or for the first one of a small random lot of the bucket's labels."""
    draw = lambda *c: F.xxhash64(*c, F.lit(turn))
    labels = stored(posts.groupBy("key", "label").agg(F.count(F.lit(1)).alias("count"), F.min_by("m", draw("m", "key")).alias("a")))
    main = labels.groupBy("key").agg(F.max_by(F.struct(F.col("label").alias("main"), "a"), F.struct("count", "label")).alias("r"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    of_main = posts.select("key", "m", "label").join(main.select("key", "r.*"), "key").where("label <> main").select("key", "a", F.col("m").alias("b"))
    lots = labels.join(main.where("labels > 2").select("key", "labels"), "key").withColumn("lot", F.pmod(draw("label", "key"), F.ceil(F.col("labels") / LOT)))
    first = lots.groupBy("key", "lot").agg(F.min_by(F.struct(F.col("label").alias("main"), F.col("a").alias("head")), draw("label", "key")).alias("r"))
    of_lot = lots.join(first.select("key", "lot", "r.*"), ["key", "lot"]).where("label <> main").select("key", F.col("head").alias("a"), F.col("a").alias("b"))
    some = lambda rows: rows.groupBy("b").agg(F.array(*(F.min_by("a", F.xxhash64("key", F.lit(turn * TRIES + k))) for k in range(TRIES))).alias("a"))
    return some(of_main).unionByName(some(of_lot)).select(F.explode("a").alias("a"), "b").distinct()


def _dealt(posts: DataFrame) -> DataFrame:
    """The rows (key, label, ...) of buckets with several labels, dealt as pairs of blocks.

    Members that don't have the bucket's main label meet all others; those that have it don't meet each other."""
    counts = posts.groupBy("key", "label").count().groupBy("key")
    counts = counts.agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("of_main"), F.sum("count").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    counts = counts.select("key", "main", blocks(F.col("all") - F.col("of_main")).alias("minor"), blocks(F.col("of_main")).alias("major"))
    rows = posts.join(counts, "key")
    draw = F.xxhash64("m")
    is_main = F.col("label") == F.col("main")
    rows = rows.withColumn("own", F.when(is_main, F.col("minor") + F.pmod(draw, F.col("major"))).otherwise(F.pmod(draw, F.col("minor"))).cast("int"))
    partners = F.when(is_main, F.col("minor")).otherwise(F.col("minor") + F.col("major"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), partners - 1)))
    return rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "main", "minor", "major")


def _labelled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets of ``rows`` (id, text, fp), and (digest, label) of the sets with words: sets of one label are linked."""
    sets = stored(_sets(rows))
    worded = sets.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "fp")).alias("rep"), *(F.first(c, ignorenulls=True).alias(c) for c in ("n", "start", "sketch", "before", "prefix")))
    members = stored(worded.withColumn("m", F.monotonically_increasing_id()))
    groups = stored(members.groupBy("start").agg(F.min("m").alias("g"), F.count(F.lit(1)).alias("w")))
    of_group = groups.where("w > 1").join(members.select("start", "m"), "start").select("g", "m")
    # one row for each shared key of a group's prefix
    posts = members.where(F.size("prefix") > 0).select("start", "m", "n", "before", "prefix").join(groups, "start").where("m = g")
    posts = posts.select("g", "n", "w", "before", "prefix", F.posexplode("prefix").alias("pos", "key"))
    posts = posts.select("key", "g", "n", "w", (F.col("pos") + F.col("before")).alias("pos"), F.when(F.col("pos") > 0, F.element_at("prefix", F.col("pos"))).alias("last"))
    posts = stored(posts)
    shared = posts.groupBy("key").agg(F.sum("w").alias("many"), F.min("g").alias("head")).where("many > 1")
    posts = stored(posts.join(shared, "key"))
    star = posts.where("g <> head").select(F.col("head").alias("a"), F.col("g").alias("b")).unionByName(of_group.where("m <> g").select(F.col("g").alias("a"), F.col("m").alias("b"))).distinct()
    told = lambda c: members.select(F.col("m").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    links = stored(_links(_star(star.join(told("a"), "a").join(told("b"), "b")), members, rows))
    labels = label_edges(links).withColumnRenamed("id", "m")
    many = posts.where("many > 2").join(of_group.select("g", F.col("m").alias("own")), "g", "left").select("key", "n", "pos", "last", F.coalesce("own", "g").alias("m"))
    many = stored(many)
    named = lambda: many.join(labels, "m", "left").withColumn("label", F.coalesce("label", "m"))
    for turn in range(TURNS):
        tried = stored(_star(_tries(named(), turn).join(told("a"), "a").join(told("b"), "b")))
        found = stored(_links(tried, members, rows))
        n_found = found.count()
        if n_found:
            links = stored(links.unionByName(found))
            labels = label_edges(links).withColumnRenamed("id", "m")
        if n_found * WORTH < tried.count():
            break
    rest = _rest(_dealt(named()).join(members.select("m", "sketch"), "m"))
    links = links.unionByName(_links(rest, members, rows))
    labels = label_edges(links).withColumnRenamed("id", "m")
    return sets, members.select("digest", "m").join(labels, "m", "left").select("digest", F.coalesce("label", "m").alias("label"))


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return picked(docs, id_col, text_col).withColumn("fp", F.xxhash64("text"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    sets, labels = _labelled(_fingerprinted(docs, id_col, text_col))
    labels = stored(labels)
    least = sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"))
    least = least.join(labels, "digest").groupBy("label").agg(F.min("id").alias("component_id"))
    out = sets.select("id", "n", "digest").join(labels.join(least, "label").drop("label"), "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, one with a null id only if there is no other.

    Of several rows with that id and text, the one whose other columns have the smallest hash stays.  Rows without words
    all stay.  Different texts of one id are different documents."""
    rows = numbered(docs)
    id_, text = f"c{place(docs, id_col)}", f"c{place(docs, text_col)}"
    rows = rows.withColumn("__fp", F.xxhash64(F.col(text).cast("string")))
    sets, labels = _labelled(_fingerprinted(docs, id_col, text_col))
    worded = sets.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "fp")).alias("r"))
    heads = worded.join(labels, "digest").groupBy("label").agg(F.min("r").alias("r")).select(F.col("r.id").alias("id"), F.col("r.fp").alias("fp"))
    empty = sets.where("n = 0").select("id", "fp").distinct()
    again = sets.where("n > 0").groupBy("id", "fp").count().where("count > 1").select("id", "fp", F.lit(True).alias("again"))
    same = lambda x, y: x["fp"].eqNullSafe(y["fp"]) & x["id"].eqNullSafe(y["id"])
    heads = heads.join(again, same(heads, again), "left").select(heads["id"], heads["fp"], F.coalesce("again", F.lit(False)).alias("again"))
    heads = heads.unionByName(empty.withColumn("again", F.lit(False))).select(F.col("id").alias("__id"), F.col("fp").alias("__head"), "again")
    heads = stored(heads)
    kept = rows.join(heads, rows["__fp"].eqNullSafe(heads["__head"]) & rows[id_].eqNullSafe(heads["__id"]))
    once = kept.where("NOT again")
    if not heads.where("again").isEmpty():
        others = kept.where("again").withColumn("__row", F.xxhash64(*(F.to_json(F.struct(c)) for c in rows.columns)))
        first = others.groupBy("__fp", "__id").agg(F.min_by(F.struct(*rows.columns), "__row").alias("r"))
        once = once.select(*rows.columns).unionByName(first.select("r.*"))
    return once.select(*rows.drop("__fp").columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.z = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.z) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
