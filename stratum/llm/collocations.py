"""Collocations of neighbouring words by set-oriented mining over persisted, sorted occurrence relations.

Texts are split at marks and line ends into pieces and those into words.  A relation of occurrences holds,
for each document in order, the 64-bit keys of (language, word) in runs of neighbours; 0 parts runs.  The
first relation has the words that are frequent in their language.  Each further length is one merge join of the
relation with itself by piece and next position, a count of the groups, and a semi-join with the frequent
groups, whose result is written as the next relation.  Rows of a piece lie behind one another, so the merge
join takes no shuffle; what a task counts is summed up before it is shuffled.

The semi-join asks a bit table of at most 2^MOST_BITS bits (64 MB), sent to all tasks: a superset when groups are many,
and counts decide in any case.  Keys are proved to differ over all words of the corpus; else another seed
is taken.

Null texts count as empty, null languages as ``und``.  Repeated rows count again; ids play no part.  Ties of score and
count go by phrase.  An empty table gives no rows.  A long text is held by one task.  Only the named columns play a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.shared import chosen, dropped, folder, runs, stored, stored_at
from stratum.llm.words import Texts, cut, hashes, mix, slices

LEAST, LONGEST, TOP = 10, 3, 2000
MOST_BITS = 29
CHUNK_BITS = 20
#: Bytes of text, and windows of words, that are counted at a time.
SLICE, WINDOWS = 4 << 20, 1 << 20
U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)

#: Bytes that part pieces, and bytes of words.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


class _Words:
    """Words of a slice: byte ranges, text, key, whether a piece begins there."""

    def __init__(self, texts: Texts, languages: np.ndarray):
        self.start, self.end, self.doc = cut(texts, _WORD)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[texts.data], dtype=np.int32)])
        self.fresh = np.ones(len(self.start), bool)
        self.fresh[1:] = (self.doc[1:] != self.doc[:-1]) | (breaks[self.start[1:]] > breaks[self.end[:-1]])
        self.key = np.maximum(mix(hashes(texts.data, self.start, self.end) ^ languages[texts.first + self.doc]), U(1))


def _language_keys(column: pa.Array, seed: int) -> np.ndarray:
    out = [mix(mix(hashes(t.data, t.lo, t.hi) + U(seed)) * _A) for t in slices(column)]
    return np.concatenate(out) if out else np.zeros(0, U)


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    rows = chosen(docs, text=text_col, lang=lang_col)
    return rows.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """lang, word, key and number of occurrences ``a`` of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, coded = _language_keys(batch["lang"], seed), batch["lang"].dictionary_encode()
            lang = np.asarray(coded.indices)
            for texts in slices(batch["text"], SLICE, lower=True):
                w = _Words(texts, keys)
                if not len(w.start):
                    continue
                ends = np.cumsum(w.end - w.start, dtype=np.int64)
                data = texts.data[:-8]
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                words = pa.StringArray.from_buffers(len(w.start), pa.py_buffer(offsets), pa.py_buffer(data[_WORD[data]])).dictionary_encode()
                both = lang[texts.first + w.doc].astype(np.int64) * len(words.dictionary) + np.asarray(words.indices)
                both, at, n = np.unique(both, return_index=True, return_counts=True)
                columns = [coded.dictionary.take(pa.array(both // len(words.dictionary))), words.dictionary.take(pa.array(both % len(words.dictionary))), pa.array(w.key[at].view(np.int64)), pa.array(n)]
                yield from pa.Table.from_arrays(columns, ["lang", "word", "key", "a"]).to_batches(1 << 16)

    found = rows.mapInArrow(run, "lang string, word string, key bigint, a bigint")
    return found.groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("a").alias("a"))


def _group_keys(words: list[np.ndarray]) -> np.ndarray:
    """One key of a group of word keys, for the bit table."""
    out = words[0]
    for w in words[1:]:
        out = mix(out * _A + w)
    return out


class Bits:
    """A bit table of groups with two bits each."""

    def __init__(self, bits: int, held: Broadcast):
        self.bits, self.held = bits, held

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return (mix(keys ^ _B) >> U(64 - bits)).astype(np.int64), (mix(keys ^ _A) >> U(64 - bits)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        table, out = self.held.value, np.ones(len(keys), bool)
        for at in self.places(keys, self.bits):
            out &= ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return out


def bit_table(groups: DataFrame, names: list[str], most: int = MOST_BITS) -> Bits:
    """The table of the frequent groups, put together in chunks by tasks."""
    bits = min(most, max(CHUNK_BITS, math.ceil(math.log2(16 * max(1, groups.count())))))
    size = 1 << CHUNK_BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(Bits.places(_group_keys([np.asarray(b[c]).view(U) for c in names]), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> CHUNK_BITS), pa.array(at & (size - 1))], ["chunk", "place"])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "chunk"):
            flags = np.zeros(size, bool)
            for b in run:
                flags[np.asarray(b["place"])] = True
            yield pa.RecordBatch.from_arrays([run[0]["chunk"].slice(0, 1), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    set_ = groups.select(*names).mapInArrow(places, "chunk bigint, place bigint").repartition("chunk").sortWithinPartitions("chunk")
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in set_.mapInArrow(chunk, "chunk bigint, bits binary").collect():  # 2^MOST_BITS bits at most
        table[r["chunk"] * size // 8 : (r["chunk"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return Bits(bits, groups.sparkSession.sparkContext.broadcast(table))


def _linked(key: np.ndarray, row: np.ndarray, link: np.ndarray) -> pa.ListArray:
    """Rows of the runs that ``link`` (to the word before) makes, each behind a 0; words without neighbours go."""
    after = np.append(link[1:], False)
    keep = link | after
    key, row, link = key[keep], row[keep], link[keep]
    size = np.where(link, 1, 2)
    ends = np.cumsum(size)
    values = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    values[ends - 1] = key.view(np.int64)
    sizes = np.bincount(row, size).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    sizes = sizes[sizes > 0]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


_RELATION = "words array<bigint>"


def _persisted(relation: DataFrame) -> tuple[DataFrame, str]:
    """Written with dictionaries of up to 16 MB a file, as words repeat."""
    path = folder(relation.sparkSession)
    relation.write.option("parquet.dictionary.page.size", str(16 << 20)).parquet(path)
    return relation.sparkSession.read.schema(_RELATION).parquet(path), path


def occurrences(rows: DataFrame, frequent: Bits, seed: int) -> DataFrame:
    """The first relation: runs of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _language_keys(batch["lang"], seed)
            for texts in slices(batch["text"], SLICE, lower=True):
                w = _Words(texts, keys)
                known = frequent.has(w.key)
                link = np.zeros(len(known), bool)
                link[1:] = known[1:] & known[:-1] & ~w.fresh[1:]
                yield pa.RecordBatch.from_arrays([_linked(w.key, w.doc, link)], ["words"])

    return rows.mapInArrow(run, _RELATION)


def _runs_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word keys of a relation's rows, their row, and whether a run begins there; about WINDOWS words at a time."""
    lists = batch["words"]
    offsets = np.asarray(lists.offsets).astype(np.int64)
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WINDOWS, "right")) - 1)
        flat = np.asarray(lists.values)[offsets[at] : offsets[to]]
        there = np.flatnonzero(flat)
        row = np.searchsorted(offsets[at : to + 1] - offsets[at], there, "right") - 1
        yield flat[there].view(U), row, flat[there - 1] == 0
        at = to


def _windows(key: np.ndarray, fresh: np.ndarray, k: int) -> np.ndarray:
    """Where windows of k neighbours begin."""
    ok = np.ones(max(0, len(key) - k + 1), bool)
    for j in range(1, k):
        ok &= ~fresh[j : j + len(ok)]
    return np.flatnonzero(ok)


def count_groups(relation: DataFrame, k: int, least: int) -> DataFrame:
    """The frequent groups of k neighbours: w1 to wk and ``a``."""
    names = [f"w{j + 1}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            groups = np.concatenate(held, 1)
            held.clear()
            if not groups.shape[1]:
                return
            order = np.argsort(_group_keys(list(groups)))
            groups = groups[:, order]
            first = np.flatnonzero(np.r_[True, (groups[:, 1:] != groups[:, :-1]).any(0)])
            n = np.diff(np.append(first, groups.shape[1]))
            groups = groups[:, first].view(np.int64)
            yield from pa.Table.from_arrays([*(pa.array(g) for g in groups), pa.array(n)], [*names, "a"]).to_batches(1 << 16)

        for batch in batches:
            for key, _, fresh in _runs_of(batch):
                at = _windows(key, fresh, k)
                held.append(np.stack([key[at + j] for j in range(k)]))
                if sum(h.shape[1] for h in held) >= WINDOWS:
                    yield from counted()
        if held:
            yield from counted()

    found = relation.mapInArrow(run, ", ".join(f"{c} bigint" for c in (*names, "a")))
    return found.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def extended(relation: DataFrame, k: int, frequent: Bits) -> DataFrame:
    """The next relation: neighbours stay linked where a frequent group of k covers both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row, fresh in _runs_of(batch):
                at = _windows(key, fresh, k)
                at = at[frequent.has(_group_keys([key[at + j] for j in range(k)]))]
                link = np.zeros(len(key), bool)
                for j in range(1, k):
                    link[at + j] = True
                yield pa.RecordBatch.from_arrays([_linked(key, row, link)], ["words"])

    return relation.mapInArrow(run, _RELATION)


def _score(a: str, left: str, right: str) -> Column:
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"CAST(CAST(1000000 AS DECIMAL(7, 0)) * CAST({wide(a)} * {wide(a)} AS DECIMAL(31, 0)) AS DECIMAL(38, 0)) DIV CAST({wide(left)} * {wide(right)} AS DECIMAL(38, 0))")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = 50, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """Candidates that no longer one of at least ``share`` percent of their count contains: lang, phrase, a, l, r, score; and ``n`` by lang."""
    rows, seed = _rows(docs, text_col, lang_col), 0
    while True:
        words, words_at = stored_at(count_words(rows, seed))
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break
        dropped(docs.sparkSession, words_at)
        seed += 1
    frequent = words.where(F.col("a") >= least)
    relation, at = _persisted(occurrences(rows, bit_table(frequent, ["key"], most_bits), seed))
    groups = {}
    for k in range(2, LONGEST + 1):
        groups[k] = stored(count_groups(relation, k, least))
        if k < LONGEST:
            following = _persisted(extended(relation, k, bit_table(groups[k], [f"w{j + 1}" for j in range(k)], most_bits)))
            dropped(docs.sparkSession, at)
            relation, at = following
    dropped(docs.sparkSession, at)

    def word(k: int, phrase: str, count: str, lang: bool = False) -> DataFrame:
        return frequent.select(F.col("key").alias(f"w{k}"), F.col("word").alias(phrase), F.col("a").alias(count), *(["lang"] if lang else []))

    pairs = stored(groups[2].join(word(1, "p1", "a1", True), "w1").join(word(2, "p2", "a2"), "w2"))
    heads = pairs.select("w1", "w2", "lang", "p1", "p2", "a1", F.col("a").alias("a12"))
    tails = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("p2").alias("p3"), F.col("a2").alias("a3"), F.col("a").alias("a23"))
    triples = stored(groups[3].join(heads, ["w1", "w2"]).join(tails, ["w2", "w3"]))
    inside = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    inside = inside.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = pairs.join(inside, ["w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    two = two.select("lang", F.concat_ws(" ", "p1", "p2").alias("phrase"), "a", F.col("a1").alias("l"), F.col("a2").alias("r"), _score("a", "a1", "a2").alias("score"))
    cuts = triples.withColumns({"s1": _score("a", "a1", "a23"), "s2": _score("a", "a12", "a3")})
    early = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", F.concat_ws(" ", "p1", "p2", "p3").alias("phrase"), "a", F.when(early, F.col("a1")).otherwise(F.col("a12")).alias("l"), F.when(early, F.col("a23")).otherwise(F.col("a3")).alias("r"), F.least("s1", "s2").alias("score"))
    return two.unionByName(three), words.groupBy("lang").agg(F.sum("a").alias("n"))


def ranked(candidates: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first candidates; tasks send at most ``top`` of each on."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = candidates.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return ranked(*mine(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
f1 AS (SELECT lang, ws[i] AS w, count(*) AS a FROM spots GROUP BY ALL),
f2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS a FROM spots WHERE i + 1 <= len(ws) GROUP BY ALL),
f3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS a FROM spots WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY lang),
two AS (SELECT f.lang, f.w1 || ' ' || f.w2 AS phrase, f.a, x.a AS l, y.a AS r, (1000000::HUGEINT * f.a * f.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM f2 f JOIN f1 x ON x.lang = f.lang AND x.w = f.w1 JOIN f1 y ON y.lang = f.lang AND y.w = f.w2
  WHERE f.a >= 10 AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = f.lang AND t.w1 = f.w1 AND t.w2 = f.w2 AND 100 * t.a >= 50 * f.a)
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = f.lang AND t.w2 = f.w1 AND t.w3 = f.w2 AND 100 * t.a >= 50 * f.a)),
cuts AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.a, x.a AS l1, q.a AS r1, p.a AS l2, z.a AS r2,
    (1000000::HUGEINT * t.a * t.a // (x.a::HUGEINT * q.a))::BIGINT AS s1, (1000000::HUGEINT * t.a * t.a // (p.a::HUGEINT * z.a))::BIGINT AS s2
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w = t.w1 JOIN f1 z ON z.lang = t.lang AND z.w = t.w3
    JOIN f2 p ON p.lang = t.lang AND p.w1 = t.w1 AND p.w2 = t.w2 JOIN f2 q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3),
every_ AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every_)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranks JOIN n USING (lang) WHERE rank <= 2000
"""
