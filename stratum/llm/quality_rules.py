"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each text; the row keeps one bit for each failed rule and the
measurements behind it.  Policies are versioned bit masks applied afterwards, so that another
policy or an ablation needs no second look at the texts.

Null and empty texts have no words: all measures are 0 and the rule ``few_words`` fails.  Repeated
rows are judged each for itself; other columns of the table play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm import words as W
from stratum.llm.shared import arrow_pass, numbered, picked, place

#: Bit of each rule. A rule is a test of the measures: true where a text fails.
RULES = {
    "few_words": 1,  # fewer than 50 words
    "repeated_words": 2,  # more than half of the words in repeated 3-word windows
    "long_words": 4,  # a mean word of more than 40 characters
    "symbols": 8,  # more symbols than words
    "repeated_lines": 16,  # five lines or more, of which over four fifths repeat an earlier one
    "many_words": 32,  # more than a million words
}
BASE = RULES["few_words"] | RULES["repeated_words"]
#: Rules that count, by version of the policy.
POLICIES = {1: BASE, 2: BASE | RULES["long_words"] | RULES["symbols"], 3: BASE | RULES["long_words"] | RULES["symbols"] | RULES["repeated_lines"]}
POLICY = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_FIRST = (np.arange(256) & 0xC0) != 0x80  # first byte of a character


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of every text of a string column."""
    out = {m: np.zeros(len(column), np.int64) for m in MEASURES}
    for t in W.slices(column):
        n, at = len(t), slice(t.first, t.first + len(t))
        w, data = W.words(t, W.SPACE_WORDS), t.data[:-8]
        inside = W.SPACE_WORDS[data]
        out["n_words"][at] = np.bincount(w.doc, minlength=n)
        out["word_chars"][at] = W.per_text(t, inside & _FIRST[data])
        out["n_symbols"][at] = W.per_text(t, _SYMBOLS[data])

        start, end, doc = W.cut(t, W.LINES)
        worded = np.concatenate([[0], np.cumsum(inside)])
        full = worded[end] > worded[start]
        start, end, doc = start[full], end[full], doc[full]
        _, first = np.unique(W.salted(W.hashes(t.data, start, end), doc), return_index=True)
        lines = np.bincount(doc, minlength=n)
        out["n_lines"][at] = lines
        out["n_dup_lines"][at] = lines - np.bincount(doc[first], minlength=n)

        g = W.grams(w.hash, 3)
        here = np.flatnonzero(w.doc[: len(g)] == w.doc[2:]) if len(g) else np.zeros(0, np.int64)
        _, back, times = np.unique(W.salted(g[here], w.doc[here]), return_inverse=True, return_counts=True)
        hit = np.zeros(len(w.doc), bool)
        for k in range(3):
            hit[here[times[back] > 1] + k] = True
        out["n_repeat_words"][at] = np.bincount(w.doc[hit], minlength=n)
    return out


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """The failure bits for measures."""
    failed = {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "long_words": m["word_chars"] > 40 * m["n_words"],
        "symbols": m["n_symbols"] > m["n_words"],
        "repeated_lines": (m["n_lines"] >= 5) & (5 * m["n_dup_lines"] > 4 * m["n_lines"]),
        "many_words": m["n_words"] > 1_000_000,
    }
    return sum(np.where(failed[r], bit, 0) for r, bit in RULES.items()).astype(np.int64)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, the measures and ``failed``, the bits of all failed rules."""
    rows = picked(docs, id_col, text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch["text"])
        return pa.RecordBatch.from_arrays([batch["id"], *(pa.array(m[k]) for k in MEASURES), pa.array(failures(m))], ["id", *MEASURES, "failed"])

    out = arrow_pass(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{m} bigint" for m in (*MEASURES, "failed")))
    return out.withColumnRenamed("id", id_col)


def passes(failed: Column, version: int = POLICY) -> Column:
    """Whether failure bits pass a version of the policy."""
    return failed.bitwiseAND(F.lit(POLICIES[version])) == 0


def ablation(rows: DataFrame, version: int = POLICY) -> DataFrame:
    """For each rule of a policy: how many rows of a ledger fail it, fail it alone, and would pass without it."""
    mask = POLICIES[version]
    bits = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [s for r, b in RULES.items() if b & mask for s in (F.sum((bits.bitwiseAND(F.lit(b)) != 0).cast("bigint")).alias(f"{r}_any"), F.sum((bits == b).cast("bigint")).alias(f"{r}_only"))]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *sums)
    stack = ", ".join(f"'{r}', {b}, {r}_any, {r}_only" for r, b in RULES.items() if b & mask)
    n = sum(bool(b & mask) for b in RULES.values())
    return one.selectExpr("n AS n_rows", f"stack({n}, {stack}) AS (rule, bit, n_failed, n_failed_alone)")


def kept_rows(docs: DataFrame, text_col: str = "text", version: int = POLICY) -> DataFrame:
    """The rows of ``docs`` that pass a policy, all columns as they are."""

    rows, text = numbered(docs), place(docs, text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array((failures(measure(batch.column(text))) & POLICIES[version]) == 0))

    return arrow_pass(rows, each, rows.schema).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ~F.col("failed").bitwiseAND(F.lit(BASE)).eqNullSafe(F.lit(0))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), passes(F.col("failed")).alias("kept"), F.col("failed").alias("failed_rules"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS i FROM d),
g AS (SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM g),
h AS (SELECT r, w, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
a AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(hit::INT)::BIGINT AS n_repeat_words FROM h GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
b AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars > 40 * n_words)::BIGINT + 8 * (n_symbols > n_words)::BIGINT
  + 16 * (n_lines >= 5 AND 5 * n_dup_lines > 4 * n_lines)::BIGINT + 32 * (n_words > 1000000)::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (failed_rules & 31) = 0 AS kept, failed_rules FROM f
"""
