"""Packing against the tokenizers library, sums, bounds and exhaustive packing, and over nulls, repeated rows and empty tables."""

import random
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from stratum.llm import packing
from stratum.llm.words import slices


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


TEXTS = [
    None, "", " \n", "It's a dog's life, isn't it?", "foo-bar.baz,qux;a.b!?c", "été. ÉCOLE x\x1cy", "日本 😀.a", "x" * 3000, "a.'s b''s c.'t d.-e ,é ,é", "<|endoftext|> a<|startoftext|>b",
    "1234 5a b6.7 ²x.Ⅰ", "lorem ipsum dolor, " * 3000, "ΣΑΣ.a ΑΣ ß.ẞ İ.x", "q .q  .z",
]


def test_ids_are_the_librarys(vocabulary):
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(vocabulary), packing.Encoder(vocabulary)
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("aB é×÷İĞ.,;:!?'-\t\n<|>s5tré日 ç\xa0\u0301") for _ in range(60)) for _ in range(5000)]
    texts = [t or "" for t in TEXTS] + odd
    for part in slices(pa.array(texts), limit=1000):
        ids, begins = mine.encode(part)
        for k in range(len(part)):
            assert ids[begins[k] : begins[k + 1]].tolist() == theirs.encode(texts[part.first + k], add_special_tokens=False).ids


def least(sizes, capacity):
    """The fewest sequences, by trying every placing."""
    sizes = tuple(sorted(sizes, reverse=True))

    @cache
    def fits(i, rooms):
        if i == len(sizes):
            return True
        return any(fits(i + 1, tuple(sorted(rooms[:k] + (r - sizes[i],) + rooms[k + 1 :]))) for k, r in enumerate(rooms) if r >= sizes[i] and rooms.index(r) == k)

    n = 1
    while not fits(0, (capacity,) * n):
        n += 1
    return n


def test_bounds_hold():
    rnd = random.Random(2)
    tight = 0
    for _ in range(300):
        sizes = np.array([rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))])
        best, low, bins = least(sizes.tolist(), 20), packing.lower_bound(sizes, 20), packing.best_fit(sizes, 20)
        assert low <= best <= bins.max() + 1 and np.bincount(bins, sizes).max() <= 20
        tight += low == best
    assert tight > 250
    assert packing.lower_bound(np.array([11] * 5 + [7] * 2), 20) == 5 and packing.lower_bound(np.array([7] * 5), 20) == 3


def checked(packed, capacity):
    """Offsets are gapless, sequences fit."""
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_pieces(spark, vocabulary):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one two"), (3, TEXTS[3]), (3, TEXTS[3])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, text string, piece bigint, TEXT string").repartition(3)
    got = packing.pack(packing.cut(df, vocabulary, 50), 50).collect()
    want = []
    for i, t in rows:
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, at, len(part := ids[at : at + 50]), zlib.crc32(np.array(part, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 50))]
    assert sorted(map(repr, want)) == sorted(repr((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    assert checked(got, 50) >= packing.lower_bound(np.array([w[3] for w in want]), 50)


def test_empty(spark, vocabulary):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(packing.cut(none, vocabulary)).count() == 0


def lengths(spark, sizes):
    return spark.createDataFrame([(i, i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], "id bigint, item bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(4)


@pytest.mark.parametrize("low, high", [(1, 99), (20, 60), (1, 12), (51, 100)])
def test_partitions_exchange(spark, low, high):
    rnd = random.Random(3)
    sizes = [rnd.randint(low, high) for _ in range(2000)]
    many = packing.pack(lengths(spark, sizes), 100, items=60)
    got = many.collect()
    assert sorted(r["id"] for r in got) == list(range(2000))
    n, low = packing.bound(many, 100)
    alone = sum(int(packing.best_fit(np.array(sizes[i : i + 60]), 100).max()) + 1 for i in range(0, 2000, 60))
    assert checked(got, 100) == n and low <= n < alone + (low == alone) and n <= 1.05 * low


def test_query(spark, vocabulary):
    got = packing.query(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    total, n = sum(r["length"] for r in rows), checked(rows, 4096)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r["doc_id"] for r in rows} == {r[0] for r in docs.select("doc_id").collect()} and n <= total / 4096 + 2
    assert got.where(F.col("length") > 4096).count() == 0
