"""Collocation mining against plain counting, and over nulls, ties, repeated rows, long and empty texts and empty tables."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from stratum.llm import collocations
from stratum.llm.words import slices

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            longer = [p for p in f if len(p) > len(phrase) and f[p] >= least and any(p[i : i + len(phrase)] == phrase for i in range(len(p)))]
            if any(100 * f[p] >= 50 * a for p in longer):
                continue
            score, k = min((int(Fraction(1000000 * a * a, f[phrase[:k]] * f[phrase[k:]])), k) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def corpus(seed, n, sizes=(0, 40)):
    rnd = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "été", "日本", "a-b", "x", "I", "naïve\x00", "e", "\x1c"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rnd.randint(*sizes)):
            text += rnd.choice(["new York city", "red tape", *words, *words]) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "\xa0"])
        rows.append((text, rnd.choice(["en", "en", "de", None, "und", "de"])))
    return rows + [(None, "en"), ("", "fr"), (" ., ", "fr"), ("one", None)] + rows[:5] * 3


def got(spark, rows, top=2000, **limits):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, a bigint, LANG string, n bigint").repartition(3)
    return sorted(tuple(r) for r in collocations.ranked(*collocations.mine(df, **limits), top).collect())


def test_against_counting(spark):
    rows = corpus(1, 900)
    want = brute(rows)
    assert len(want) > 30 and {w[0] for w in want} == {"en", "de", "und"}
    assert got(spark, rows) == want


def test_full_bit_table_and_small_slices(spark, monkeypatch):
    rows = corpus(2, 120)
    monkeypatch.setattr(collocations, "CHUNK_BITS", 3)
    assert got(spark, rows, most_bits=3, top=7) == brute(rows, top=7)  # nearly all bits are set; counts decide


def test_long_text_and_ties(spark):
    rows = [("ab cd ef " * 30_000 + "w" * 200_000, "en"), ("p q. " * 12 + "r s. " * 12, "en")]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(None, None), ("", "en")]) == []


def test_keys_that_fall_together_take_another_seed(spark, monkeypatch):
    rows = corpus(3, 60)
    seeds, plain = [], collocations.count_words

    def count(found, seed):
        seeds.append(seed)
        out = plain(found, seed)
        return out if seed else out.withColumn("key", F.col("key") % 3)

    monkeypatch.setattr(collocations, "count_words", count)
    assert got(spark, rows) == brute(rows) and seeds == [0, 1]


def test_windows_are_counted_across_batches(monkeypatch):
    monkeypatch.setattr(collocations, "WINDOWS", 4)
    lists = pa.array([[0, 1, 2, 3, 0, 4, 5], [0, 1, 2], [0, 7, 8, 9, 10, 11]], pa.list_(pa.int64()))
    found = [(k.tolist(), r.tolist(), f.tolist()) for k, r, f in collocations._runs_of(pa.RecordBatch.from_arrays([lists], ["words"]))]
    assert [k for k, _, _ in found] == [[1, 2, 3, 4, 5], [1, 2], [7, 8, 9, 10, 11]] and found[0][2] == [True, False, False, True, False]
    assert collocations._windows(np.arange(5), np.array(found[0][2]), 3).tolist() == [0]


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_001)], "a bigint, l bigint, r bigint")
    assert df.select(collocations._score("a", "l", "r")).first()[0] == 1000000 * 3_000_000_000_000**2 // (4_000_000_000_000 * 5_000_000_000_001)


@pytest.mark.parametrize("text", ["a b. c", "É x\ty", "", "A\x0bB"])
def test_words(text):
    for t in slices(pa.array([text, None]), lower=True):
        w = collocations._Words(t, np.zeros(2, np.uint64))
        want = [[x for x in re.split(r"[\x20\x09]+", p) if x] for p in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(UPPER))]
        assert [bytes(t.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == sum(want, [])
        assert w.fresh.tolist() == sum(([True] + [False] * (len(p) - 1) for p in want if p), [])
