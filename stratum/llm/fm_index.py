"""Benchmark decontamination with an FM-index per training shard.

The benchmark's windows are the queries; every shard of documents is indexed: its words become
numbers, a suffix array gives the Burrows-Wheeler transform, a wavelet matrix answers ranks, and
all windows are searched backwards at once.  Occurrences are located by stepping back to sampled
suffix positions, and the found spans are merged for each document.

A shard is a run of whole documents of about ``SHARD_WORDS`` words within one task, so the index
needs no shuffle and is rebuilt from its rows if an executor is lost.  Windows are sent in blocks
of at most ``BLOCK_WORDS`` words; each block makes one pass in the same stage, so a larger
benchmark means more passes, never a larger broadcast.

Null and empty texts have no words and no hits.  Items of fewer than 13 words are one window; items
without words match nothing.  Repeated items and rows are each reported; a null item id is left out
of ``items``.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm import words as W
from stratum.llm.shared import numbered, picked, place

WINDOW = 13
SHARD_WORDS = 1 << 19
#: Every how many positions of a document's words the suffix array is kept.
SAMPLE = 8
#: Words of the windows in one block, and so the bound of what is broadcast (8 bytes each, and item ids).
BLOCK_WORDS = 1 << 22


class Wavelet:
    """A wavelet matrix over numbers: one bit plane a level, with counts of ones before each position."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = ((values >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ones[lo], ones[at]
            lo, at = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, at - b)
        return at - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol, lo = np.zeros(len(at), np.int64), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] > ones[at]
            a, b = ones[lo], ones[at]
            symbol = symbol * 2 + bit
            lo, at = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, at - b)
        return symbol, at - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of numbers below 2**31, by doubling; only suffixes not yet told apart are sorted again.

    The first sort takes as many numbers at a time as fit a 62-bit key.  The last number must be the least, and occur once."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    k = max(1, 62 // bits)
    first = text.astype(np.int64)
    for j in range(1, k):
        first <<= bits
        first[: max(0, n - j)] |= text[j:]
    order = np.argsort(first, kind="stable")
    first = first[order]
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rank of a group: its first place
    rank = np.empty(n, np.int64)
    rank[order] = start
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        open_ = np.flatnonzero(~(new & last))
        if not len(open_):
            return order
        at = order[open_]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = (rank[at] << 31) | after
        by = np.argsort(key, kind="stable")
        order[open_], key = at[by], key[by]
        # places of a group stay together: the open places are ascending, and so are the ranks in the keys
        differs = np.ones(len(by), bool)
        differs[1:] = key[1:] != key[:-1]
        new[open_] |= differs
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[open_]] = start[open_]
        k *= 2


class FMIndex:
    """An index of documents' words, given as numbers from 2 on; 1 parts documents, 0 ends the text."""

    def __init__(self, text: np.ndarray, largest: int):
        self.n = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        self.wavelet = Wavelet(last, largest)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 2))])
        kept = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; rows are filled up at the left, -1 is no word of the text."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(1, phrases.shape[1] + 1):
            todo = np.flatnonzero((sizes >= k) & (hi > lo))
            if not len(todo):
                break
            c = phrases[todo, -k]
            known = c >= 0
            hi[todo[~known]] = lo[todo[~known]]
            todo, c = todo[known], c[known]
            lo[todo], hi[todo] = self.before[c] + self.wavelet.rank(c, lo[todo]), self.before[c] + self.wavelet.rank(c, hi[todo])
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to the next sampled one."""
        found, steps = np.full(len(at), -1, np.int64), 0
        todo = np.arange(len(at))
        while len(todo):
            here = at[todo]
            kept = self.marks[here + 1] > self.marks[here]
            found[todo[kept]] = self.samples[self.marks[here[kept]]] + steps
            todo, here = todo[~kept], here[~kept]
            symbol, rank = self.wavelet.access(here)
            at = at.copy()
            at[todo] = self.before[symbol] + rank
            steps += 1
        return found


class Phrases:
    """Distinct windows of a block of items: word hashes filled up at the left, sizes, and the items of each."""

    def __init__(self, rows: list[tuple[str, np.ndarray]]):
        seen: dict[bytes, set[str]] = {}
        for item, words in rows:
            for a in range(max(1, len(words) - WINDOW + 1)) if len(words) else ():
                seen.setdefault(words[a : a + WINDOW].tobytes(), set()).add(item)
        self.items = [sorted(x for x in v if x is not None) for v in seen.values()]
        self.sizes = np.array([len(k) // 8 for k in seen], np.int64)
        self.words = np.zeros((len(seen), WINDOW), np.uint64)
        for i, k in enumerate(seen):
            self.words[i, WINDOW - len(k) // 8 :] = np.frombuffer(k, np.uint64)
        self.vocabulary = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in seen])) if seen else np.zeros(0, np.uint64)

    def occurrences(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, number of the window) of each occurrence in a shard's words."""
        none = np.zeros(0, np.int64)
        if not len(words) or not len(self.sizes):
            return none, none
        names, number = np.unique(words, return_inverse=True)
        place = np.minimum(np.searchsorted(names, self.words), len(names) - 1)
        phrases = np.where(names[place] == self.words, place + 2, -1)
        filled = np.arange(WINDOW)[None, :] >= WINDOW - self.sizes[:, None]
        whole = np.flatnonzero(((phrases >= 0) | ~filled).all(1))
        if not len(whole):
            return none, none
        cut = np.flatnonzero(np.diff(doc)) + 1
        where = np.arange(len(words)) + np.searchsorted(cut, np.arange(len(words)), "right")
        text = np.ones(len(words) + len(cut) + 2, np.int64)
        text[where] = number + 2
        text[-1] = 0
        index = FMIndex(text, len(names) + 1)
        lo, hi = index.search(phrases[whole], self.sizes[whole])
        times = hi - lo
        window = np.repeat(whole, times)
        at = index.locate(np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum()))
        word = np.full(len(text), -1, np.int64)
        word[where] = np.arange(len(words))
        return word[at], window


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items and their words, in blocks of at most BLOCK_WORDS window words (an item that has more makes a block)."""
    block, size = [], 0
    for item, text in picked(benchmark, id_col, text_col).selectExpr("string(id)", "text").toLocalIterator():
        for t in W.slices(pa.array([text], pa.string()), lower=True):
            words = W.words(t, W.ALNUM_WORDS).hash
        cost = max(1, len(words) - WINDOW + 1) * min(WINDOW, len(words))
        if block and size + cost > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += cost
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: bool = False) -> DataFrame:
    """For each row of ``docs``: its id, ``n_words``, ``spans`` (merged, of words, ends exclusive) and ``items`` (ids as strings, sorted).

    With ``carry`` all columns of ``docs`` come along in a struct ``row``, under the names c0, c1, ...
    """
    spark = docs.sparkSession
    rows, id_, text = numbered(docs), F.col(f"c{place(docs, id_col)}"), F.col(f"c{place(docs, text_col)}")
    rows = rows.select(id_.alias("id"), text.cast("string").alias("text"), *([F.struct(*rows.columns).alias("row")] if carry else []))
    rows = rows.select("*", F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) if not carry else rows.schema
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(Phrases(block))

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            n_words = n_docs = 0
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    piece = batch.slice(at, 64)
                    for t in W.slices(piece["text"], lower=True):
                        w = W.words(t, W.ALNUM_WORDS)
                        parts.append((w.hash, w.doc + n_docs + t.first))
                        n_words += len(w.hash)
                    held.append(piece)
                    n_docs += piece.num_rows
                    if n_words >= SHARD_WORDS:
                        yield _found(held, parts, sent.value)
                        held, parts, n_words, n_docs = [], [], 0, 0
            if held:
                yield _found(held, parts, sent.value)

        rows = rows.mapInArrow(each, schema)
    return rows.drop("text").withColumnRenamed("id", id_col)


def _found(held: list[pa.RecordBatch], parts: list[tuple[np.ndarray, np.ndarray]], phrases: Phrases) -> pa.RecordBatch:
    """The rows of a shard with the occurrences of a block added."""
    table = pa.Table.from_batches(held).combine_chunks()
    n = table.num_rows
    words = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    doc = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=n)
    base = np.concatenate([[0], np.cumsum(count)])
    at, window = phrases.occurrences(words, doc)
    spans, items = table["spans"].to_pylist(), table["items"].to_pylist()
    order = np.argsort(at, kind="stable")
    at, window = at[order], window[order]
    ends = np.searchsorted(at, base)
    for d in np.unique(doc[at]) if len(at) else ():
        mine = slice(ends[d], ends[d + 1])
        start = at[mine] - base[d]
        end = start + phrases.sizes[window[mine]]
        both = sorted([*zip(start.tolist(), end.tolist(), strict=True), *((s["start"], s["end"]) for s in spans[d])])
        merged: list[list[int]] = []
        for a, b in both:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        spans[d] = [{"start": a, "end": b} for a, b in merged]
        items[d] = sorted({*items[d], *(x for k in set(window[mine].tolist()) for x in phrases.items[k])})
    out = {"n_words": pa.array(count), "spans": pa.array(spans, table.schema.field("spans").type), "items": pa.array(items, pa.list_(pa.string()))}
    for name, column in out.items():
        table = table.set_column(table.column_names.index(name), name, column.cast(table.schema.field(name).type))
    return table.combine_chunks().to_batches()[0]


def _hits(spans: F.Column) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    """At least one word in twenty within occurrences, and one at all."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def kept_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    found = scan(docs, benchmark, id_col, text_col, carry=True)
    return found.where(~contaminated(_hits(F.col("spans")), F.col("n_words"))).select("row.*").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = _hits(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


SQL = r"""
WITH f AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark),
w AS (SELECT kind, id, r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM f),
b AS (SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) END) AS g FROM w WHERE kind = 'b'),
z AS (SELECT DISTINCT len(g) AS k FROM b),
d AS (SELECT r, i, k, w[i:i + k - 1] AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, z WHERE kind = 'd')),
h AS MATERIALIZED (SELECT d.r, d.i, d.k, b.id FROM d JOIN (SELECT DISTINCT id, g FROM b) b ON d.g = b.g),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id::VARCHAR AS id FROM h WHERE id IS NOT NULL) GROUP BY r)
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN i ON i.r = w.r WHERE kind = 'd'
"""
