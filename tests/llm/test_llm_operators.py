"""Each operator against a brute-force version, and over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from stratum.llm import bpe, fm_index, license_scan, ngram_join, pii, quality_rules, sharding, toxicity, url_filter, warc
from stratum.llm import words as W
from stratum.operators.components import label_edges

LONG = "lorem ipsum dolor sit amet " * 40_000
WORDS = "the of and a to in is was that it for as with his he be on by at have are this not but had from or which you one we all her she there would their".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice("abcdefgh") for _ in range(n))


#: (id, text, and columns whose names clash with what operators make)
EDGES = [
    (1, None, "x", 1), (2, "", "x", 1), (3, " \n\t ", None, 1), (4, LONG, "x", None), (None, prose(1, 80), "x", 1), (None, None, None, None),
    (5, prose(1, 80), "x", 1), (6, prose(1, 80), "x", 1), (6, prose(1, 80), "x", 1), (7, "one", "x", 1), (8, "x" * 300_000, "x", 1), (9, "naïve 日本 😀\x00 é\x1c", "x", 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id bigint, text string, key string, n bigint").withColumnsRenamed({"key": "id", "n": "n_words"})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, id string, n_words bigint")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(9, 30), "x"), (2, None, "x"), (3, "", "x"), (None, prose(9, 30), None), (10, "one two", "x"), (10, "one two", "x")], "item_id bigint, text string, id string")


def rows(df):
    return [r.asDict() for r in df.collect()]


# words


def test_words_and_lines():
    texts = ["a  bc\n", None, "", "é\x0b日本 x", "   ", "one"]
    got = [[] for _ in texts]
    for t in W.slices(pa.array(texts), limit=8):
        w = W.words(t, W.SPACE_WORDS)
        for a, b, d in zip(w.start, w.end, w.doc, strict=True):
            got[t.first + d].append(bytes(t.data[a:b]).decode())
    assert got == [["a", "bc"], [], [], ["é", "日本", "x"], [], ["one"]]


def test_hashes_tell_ranges_apart():
    data = np.concatenate([np.frombuffer(b"abcabcabcd" + b"x" * 40 + b"y", np.uint8), np.zeros(8, np.uint8)])
    h = W.hashes(data, np.array([0, 3, 6, 6, 10, 11]), np.array([3, 6, 9, 10, 49, 50]))
    assert h[0] == h[1] == h[2] != h[3] and h[4] == h[5]


def test_long_ranges_are_hashed_alike(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(1, 256, 5000).astype(np.uint8), np.zeros(8, np.uint8)])
    start, end = np.array([0, 0, 7, 100, 4000, 8, 9]), np.array([5000, 4999, 7, 108, 4001, 1000, 17])
    few = W.hashes(data, start, end)
    monkeypatch.setattr(W, "FEW", 0)
    assert (W.hashes(data, start, end) == few).all() and len(set(few.tolist())) == 7


@pytest.mark.parametrize("name", ["place", "write", "digests", "encode", "judge", "ledger", "quality", "contamination", "benchmark", "scan", "masked", "licenses", "license_texts", "join", "kept", "toxicity"])
def test_columns_that_differ_in_case(spark, items, name, vocabulary, tmp_path):
    """A column whose name differs from that of a used one in case only plays no part and stays as it is."""
    df = spark.createDataFrame([(1, "a b c " + prose(1, 60), "X", 7), (2, None, "Y", 8)], "doc_id bigint, text string, TEXT string, N_tokens bigint")
    pages = df.toDF("page_id", "url", "URL", "PAGE_ID")
    one = lambda: pii.SemiMarkov()
    got = {
        "place": lambda: sharding.place(df, "text"), "write": lambda: [warc.write(pages.toDF("page_id", "html", "HTML", "url"), f"file://{tmp_path}/w"), warc.read(warc.archives_in(spark, f"file://{tmp_path}/w"))][1], "digests": lambda: bpe.digests(df, vocabulary, carry=True), "encode": lambda: bpe.encode(df, vocabulary),
        "judge": lambda: url_filter.judge(pages), "ledger": lambda: quality_rules.ledger(df), "quality": lambda: quality_rules.kept_rows(df), "contamination": lambda: fm_index.kept_rows(df, items),
        "benchmark": lambda: fm_index.scan(df, items.toDF("item_id", "text", "TEXT")), "scan": lambda: pii.scan(df, one()), "masked": lambda: pii.masked_rows(df, one()), "licenses": lambda: license_scan.scan(df),
        "license_texts": lambda: license_scan.scan_texts(df), "join": lambda: ngram_join.join(df), "kept": lambda: ngram_join.kept_rows(df),
        "toxicity": lambda: toxicity.score(df, toxicity.train(df, df.selectExpr("doc_id", "1 AS toxic", "0 AS TOXIC"))),
    }[name]()
    rows_ = got.collect()
    assert len(rows_) == (1 if name == "quality" else 2)
    if name in ("quality", "contamination", "masked", "kept"):
        assert got.columns == df.columns and {r[2] for r in rows_} <= {"X", "Y"}
    if name == "digests":
        assert got.columns == ["doc_id", "text", "TEXT", "n_tokens", "ids_sha256", "decoded_sha256"]


# 1


def test_lookup_table_by_plain_filling():
    names, size = ("a", "b", "c"), 101
    held = {}
    prefer = {n: [(sharding._number(n, "first") + j * (sharding._number(n, "step") % (size - 1) + 1)) % size for j in range(size)] for n in names}
    assert all(sorted(p) == list(range(size)) for p in prefer.values())
    while len(held) < size:
        for k, n in enumerate(names):
            if len(held) < size:
                held[next(s for s in prefer[n] if s not in held)] = k
    assert sharding.lookup_table(names, size) == [held[s] for s in range(size)]
    counts = np.bincount(sharding.lookup_table())
    assert counts.max() - counts.min() <= 1
    a, b = sharding.lookup_table(tuple("abcdefgh"), 6553), sharding.lookup_table(tuple("abcdefg"), 6553)
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != 7) < 0.1 * 6553
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.lookup_table(("a",), 100)


def test_placing(spark, edges, none, tmp_path):
    got = rows(sharding.place(edges, "doc_id"))
    assert len(got) == len(EDGES) and len({r["shard"] for r in got if r["doc_id"] == 6}) == 1 and all(r["shard"] for r in got)
    assert rows(sharding.place(none, "doc_id")) == []
    sharding.write(edges, "doc_id", f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == len(EDGES)


# 2


def test_archives(spark, tmp_path, monkeypatch):
    pages = [(1, "http://a", "same", 1), (2, "http://b\r\nX: y", "same", 1), (2, "http://b", "same", 1), (3, None, None, 1), (4, "", "", 1), (None, "u", "same", 1), (5, "u", "\r\n\r\nWARC/1.1 日本" * 9, None), (6, "u", LONG, 1)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, id bigint")
    at = lambda name: f"file://{tmp_path}/{name}"
    assert warc.write(df, at("a")) == len(list((tmp_path / "a").glob("*.warc.zst"))) > 0
    archives = warc.archives_in(spark, at("a"))
    back = rows(warc.read(archives))
    assert all(r["error"] is None for r in back) and len(back) == len(pages)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in back)
    u = "<urn:page:{}>".format
    assert kinds == sorted([(u(1), "revisit", u(2)), (u(2), "response", ""), (u(2), "response", ""), (u(3), "revisit", u(4)), (u(4), "response", ""), (u(""), "revisit", u(2)), (u(5), "response", ""), (u(6), "response", "")])
    for r in back:
        if r["record_id"] == u(6):
            assert bytes(r["payload"]) == LONG.encode() and r["payload_digest"] == base64.b32encode(hashlib.sha1(LONG.encode()).digest()).decode()
    told = lambda name: sorted(str(r) for r in rows(warc.read(warc.archives_in(spark, at(name))).drop("path", "offset")))
    first = told("a")
    warc.write(df, at("a"))  # as if all tasks ran again
    assert told("a") == first
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    assert warc.write(df, at("b")) > 2 and told("b") == first
    assert warc.write(df.limit(0), at("c")) == 0
    warc.write(df, at("d"), min_bytes=5)
    assert {r["record_type"] for r in rows(warc.read(warc.archives_in(spark, at("d"))))} == {"response"}


def test_broken_archives(spark):
    good = warc.archive([warc.record(1, "u", b"payload", None, False), warc.record(2, "u", b"payload", 1, True)])
    assert [r["error"] for _, raw in warc.frames(good) for r in [warc.parse(raw)]] == [None, None]
    many = warc.archive([warc.record(i, "u", prose(i, 100).encode(), None, False) for i in range(64)])
    assert len(list(warc.frames(many))) == 64
    with pytest.raises(Exception):
        list(warc.frames(good[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(b"nothing"))
    raw = warc.record(1, "u", b"payload", None, False)
    assert warc.parse(raw[:-1])["error"] == "wrong Content-Length"
    assert warc.parse(raw.replace(b"payload\r\n", b"pbyload\r\n"))["error"] == "wrong block digest"
    assert warc.parse(b"x")["error"] == "no WARC header"
    assert warc.parse(raw.replace(b"WARC-Date", b"WARC-Dote"))["error"] == "missing warc-date"
    df = spark.createDataFrame([("a", bytearray(good[:-3])), ("b", bytearray(b"junk")), ("c", bytearray(b"")), ("d", None)], "path string, content binary")
    assert sorted((r["path"], r["error"] is None) for r in rows(warc.read(df))) == [("a", False), ("a", True), ("b", False)]


# 3


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_bpe_like_the_library(vocabulary):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(vocabulary), bpe.Codec(vocabulary)
    rnd = random.Random(3)
    parts = ["a", "the ", "  ", "\n\n", "\t", " 12", "'s", "'T", "é", "日本", "<|endoftext|>", "<|endof", "!!", "😀", "\u3000", "\x1c", "\x85", "x" * 90, "ab" * 60, "\u0301", "²", "Ⅷ"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids and ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    for c in [*range(0x300), *range(0x2000, 0x2070), 0x1680, 0x3000, 0xFEFF, 0x1F600]:
        assert ours.encode(f"a{chr(c)} {chr(c)}") == theirs.encode(f"a{chr(c)} {chr(c)}", add_special_tokens=False).ids


def test_long_words_like_short_ones(vocabulary):
    c = bpe.Codec(vocabulary)
    rnd = random.Random(4)
    for _ in range(200):
        word = bytes(rnd.choice(b"abcthe ") for _ in range(rnd.randint(1, 60)))
        assert c._long(word) == c._short(word)


def test_bpe_edges(edges, none, vocabulary):
    c = bpe.Codec(vocabulary)
    want = sorted((str(i), len(c.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in EDGES)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in rows(bpe.digests(edges, vocabulary))) == want
    carried = bpe.digests(edges.drop("n_words"), vocabulary, carry=True)
    assert carried.columns == ["doc_id", "text", "id", "n_tokens", "ids_sha256", "decoded_sha256"] and carried.count() == len(EDGES)
    assert rows(bpe.digests(none, vocabulary)) == []
    back = rows(bpe.decode(bpe.encode(edges, vocabulary), vocabulary))
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t, *_ in EDGES)


# 4


def test_cascade_is_exact(spark, monkeypatch):
    keys = spark.range(20_000).selectExpr("cast(id AS string) AS key", "id % 7 = 0 AS listed")
    for part, sent in ((1 << 20, 1 << 20), (3000, 1 << 20), (3000, 0)):
        monkeypatch.setattr(url_filter, "PART_KEYS", part)
        monkeypatch.setattr(url_filter, "SENT_BYTES", sent)
        cascades = url_filter.build(keys)
        assert cascades.parts == -(-20_000 // part) and cascades.bytes
        got = rows(url_filter.listed(keys, "key", cascades, "member"))
        assert len(got) == 20_000 and all(r["member"] == r["listed"] for r in got)
        for k in (True, False):
            only = keys.where(f"listed = {k}")
            assert all(r["member"] == r["listed"] for r in rows(url_filter.listed(only, "key", url_filter.build(only), "member")))
    twice = spark.createDataFrame([(None, True), ("", False), ("a", False), ("b", None), ("c", True)], "key string, listed boolean")
    assert {r["key"]: r["member"] for r in rows(url_filter.listed(twice, "key", url_filter.build(twice), "member"))} == {None: True, "": True, "a": False, "b": False, "c": True}


def test_urls(spark):
    urls = [(1, "HTTP://A.Example.COM/en/71?x"), (2, "https://example.com/en/9#/en/7"), (3, "example.com/en/"), (4, None), (5, ""), (6, "x://com/en/"), (7, "x://xcom/en/"), (8, "x://h?/en/"), (9, "x://a.b.net/de/8\n/x"), (None, "x://ÀB.org/es/"), (10, "a://b://c/en/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_filter.judge(spark.createDataFrame([(i, u, "z") for i, u in urls], "page_id bigint, url string, host string")))}
    assert got[1] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[2] == ("example.com", "/en/9", "com/en/", "block")
    assert got[3][:3] == got[4][:3] == got[5][:3] == ("", "", None) and got[4][3] == "allow"
    assert got[6] == ("com", "/en/", "com/en/", "block") and got[7][2] is None and got[8][:2] == ("h", "")
    assert got[9] == ("a.b.net", "/de/8\n/x", "net/de/", "block") and got[None][0] == "Àb.org" and got[None][3] == "block"
    assert got[10][:2] == ("b:", "//c/en/")
    listed = spark.createDataFrame([("h",), (None,)], "key string")
    again = {r["page_id"]: r["verdict"] for r in rows(url_filter.judge(spark.createDataFrame(urls, "page_id bigint, url string"), lists=listed))}
    assert again[8] == again[4] == "block" and again[7] == "allow" and again[1] == "allow"
    assert rows(url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"))) == []


def test_every_rule_has_its_word(spark):
    urls = ["x://com/en/1", "x://a.com/en/7", "x://example.com/en/6", "x://example.com/en/7", "x://b.example.com/en/70", "x://net/de/", "x://a.net/de/8", "x://example.net/de/7", "x://example.net/de/8", "x://b.example.net/de/80", "x://org/es/", "x://a.org/es/1", "x://net/en/", "x://org/de/"]
    want = [("com/en/", "block")] * 3 + [("example.com/en/7", "allow")] * 2 + [("net/de/", "allow")] * 3 + [("example.net/de/8", "block")] * 2 + [("org/es/", "block")] * 2 + [(None, "allow")] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows(url_filter.judge(pages))} == dict(enumerate(want))
    everywhere = spark.createDataFrame([(u.split("/")[2],) for u in urls], "key string")  # a listed host doesn't outweigh a rule
    assert {r["page_id"]: r["verdict"] for r in rows(url_filter.judge(pages, lists=everywhere))} == {i: v if r else "block" for i, (r, v) in enumerate(want)}


# 5


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, windows = {}, [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, edges, none):
    texts = [t for _, t, *_ in EDGES] + [prose(k, 60).replace("b ", "\n", 9) for k in range(20)] + ["a b c a b c", "a b c\na b c\r\n\n \na b c", "#*| <x> é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r[m] for m in quality_rules.MEASURES) for r in rows(quality_rules.ledger(df))}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert len(rows(quality_rules.ledger(edges))) == len(EDGES) and rows(quality_rules.ledger(none)) == []
    book = quality_rules.ledger(df)
    kept = {r["doc_id"] for r in rows(book.where(quality_rules.passes(book["failed"])))}
    assert {r["doc_id"] for r in rows(quality_rules.kept_rows(df))} == kept
    for r in rows(quality_rules.ablation(book)):
        failed = [x["failed"] & quality_rules.POLICIES[quality_rules.POLICY] for x in rows(book)]
        assert r["n_failed"] == sum(bool(f & r["bit"]) for f in failed) and r["n_failed_alone"] == sum(f == r["bit"] for f in failed)


# 6


def brute_hits(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[a : a + 13]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_contamination(spark, items, monkeypatch, block):
    monkeypatch.setattr(fm_index, "BLOCK_WORDS", block)
    passage = prose(9, 30).split()
    texts = [t for _, t, *_ in EDGES] + [prose(7, 40) + " " + " ".join(passage[3:20]).upper() + " end", " ".join(passage), " ".join(passage[:12]), "x one. Two one two-one", " ".join(passage * 3)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in rows(fm_index.scan(df, items))}
    want = brute_hits(texts, [(r["item_id"], r["text"]) for r in rows(items)])
    assert got == dict(enumerate(want))
    kept = rows(fm_index.kept_rows(df, items))
    assert {r["doc_id"] for r in kept} == {i for i, (n, h, _) in enumerate(want) if not (h and 20 * h >= n)} and set(kept[0]) == {"doc_id", "text", "spans"}


def test_contamination_of_nothing(none, edges, items):
    assert rows(fm_index.scan(none, items)) == []
    assert all(r["items"] == [] for r in rows(fm_index.scan(edges, items.limit(0)))) and fm_index.kept_rows(edges, items.limit(0)).count() == len(EDGES)


def test_fm_index():
    rng = np.random.default_rng(0)
    for n, s in ((1, 2), (5, 2), (400, 2), (400, 90)):
        text = np.concatenate([rng.integers(1, 2 + s, n), [0]])
        assert fm_index.suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        index = fm_index.FMIndex(text, int(text.max()))
        for m in (1, 3, 6):
            for a in range(0, n - m, 7):
                phrase = np.zeros((1, 6), np.int64)
                phrase[0, 6 - m :] = text[a : a + m]
                lo, hi = index.search(phrase, np.array([m]))
                assert sorted(index.locate(np.arange(lo[0], hi[0]))) == [i for i in range(n - m + 1) if (text[i : i + m] == text[a : a + m]).all()]


# 7


def brute_base(t):
    b = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    b += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    b += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    return b + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rnd = random.Random(5)
    parts = ["a@b.c", "@", ".", "x.y", "1", "+", " ", "-", "4111111111111111", "1.2.3.4", "256", "+1 (743) 555-3824", "é", "..", "a@b@c.de", "10.0.0.1.2", "%_", "٣", "\n", "(", ")"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("0" * 5000 + "1.1.1.1") == [("ip", 0, 5007)] and pii.base_spans("1" * 5000 + ".1.1.1") == []
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 300_000) == []


def test_field(spark, edges, none):
    model = pii.train(none)
    told = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t, model)[1]]
    assert told("reach me: phone (212) 555-0143 or") == [("phone", "(212) 555-0143")]
    assert told("write to anna [at] mail [dot] example [dot] org today") == [("email", "anna [at] mail [dot] example [dot] org")]
    assert told("in 2019 2020 2021 2022 and 128 256 512") == [] and told("version 10.2.33.4055 of") == []
    text = "a@b.cd 4390698575873170"
    assert pii.find(text, model)[0] == pii.find(text, model)[1] == brute_base(text) and pii.masked(text + " z", model) == "<email> <card> z"
    got = rows(pii.scan(edges, model))
    assert len(got) == len(EDGES) and rows(pii.scan(none, model)) == []
    masked = pii.masked_rows(spark.createDataFrame([(1, "x a@b.cd", 8), (2, None, 5)], "doc_id bigint, text string, n_chars bigint"), model)
    assert sorted((r["text"] or "", r["n_chars"]) for r in rows(masked)) == [("", 5), ("x <email>", 9)]


def test_field_beside_other_words(none):
    model = pii.train(none)
    told = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t, model)[1]]
    assert told("call 212-555-0187 9am to 5pm") == [("phone", "212-555-0187")]
    assert told("at (212) 555-0187 2nd floor") == [("phone", "(212) 555-0187")]
    assert told("card 4012.8888.8888.1881 3x") == [("card", "4012.8888.8888.1881")]
    assert told("write to jane [at] example.com soon") == [("email", "jane [at] example.com")]
    assert told("write to jane(at)example.org soon") == [("email", "jane(at)example.org")]
    assert told("we meet (at) noon. Then we go [at] once.") == [] and told("sold 12 345 678 901 234 5th time") == []
    assert pii.masked("call 212-555-0187 9am, jane(at)example.org", model) == "call <phone> 9am, <email>"
    assert pii.find("1 " * 2000 + "x", model)[0] == []


# 8


def brute_license(text):
    best, n = (0.0, 0, None), 0
    for line in (text or "").lower().split("\n"):
        g = set(license_scan.template_bigrams(line))
        found = [(2 * len(g & set(h := license_scan.template_bigrams(t))) / (len(g) + len(h)), -k, name) for k, (name, t) in enumerate(license_scan.TEMPLATES)] if g else []
        top = max(found, default=(0.0, 0, None))
        if top[0] >= license_scan.THRESHOLD:
            n += 1
            best = max(best, top)
    return (best[2], best[0] if n else None, n) if n else (None, None, 0)


def test_licenses(spark, edges, none):
    texts = [t for _, t, *_ in EDGES] + [t for _, t in license_scan.TEMPLATES] + ["x\n  RELEASED under -- the MIT license!\ny", "Released under the the MIT License now.", "Licensed under CC BY 4.0.", "Licensed under the License"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, license string")
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in rows(license_scan.scan(df))}
    assert got == {i: brute_license(t) for i, t in enumerate(texts)}
    assert rows(license_scan.scan(none)) == [] and len(rows(license_scan.scan(edges))) == len(EDGES)


def brute_windows(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    g = [f"{a} {b}" for a, b in zip(words, words[1:])]
    out = []
    for k, (name, t) in enumerate(license_scan.TEMPLATES + license_scan.FULL):
        h, wide, best = set(license_scan.template_bigrams(t)), license_scan.widest(t), 0
        for i in range(len(g)):
            hits, seen = 0, set()
            for j in range(i, min(len(g), i + wide)):
                if g[j] in h:
                    hits += 1
                    seen.add(g[j])
                best = max(best, 2 * len(seen) / (j - i + 1 - hits + len(seen) + len(h)))
        if best >= license_scan.THRESHOLD:
            out.append((best, -k, name, 2 * len(h & set(g)) / (len(set(g)) + len(h))))
    top = max(out, default=(None, 0, None, None))
    return top[2], top[0], top[3], len(out)


def test_license_texts(spark, edges, none):
    mit = dict(reversed(license_scan.FULL))["MIT"]
    wrapped = "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(mit.split()))
    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License version 2.\n"
    texts = [None, "", "one", "Copyright 2020 A. B.\n\n" + wrapped, prose(3, 300) + "\n" + gpl + prose(4, 300), "This package is released under the MIT License.", "the software of the software " * 200, *(t + " " + prose(k, 20) for k, (_, t) in enumerate(license_scan.FULL)), prose(5, 400)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, license string")
    got = {r["doc_id"]: (r["license"], r["dice"], r["whole_dice"], r["n_templates"]) for r in rows(license_scan.scan_texts(df))}
    assert got == {i: brute_windows(t) for i, t in enumerate(texts)}
    assert [got[i][0] for i in (3, 4, 5)] == ["MIT", "GPL-2.0-only", "MIT"] and [got[7 + k][0] for k in range(len(license_scan.FULL))] == [n for n, _ in license_scan.FULL]
    assert rows(license_scan.scan_texts(none)) == [] and len(rows(license_scan.scan_texts(edges))) == len(EDGES)


# 9


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    at = {i: i for i in sets}
    ids = sorted(sets)
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if near(sets[a], sets[b])]
    for _ in ids:
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    return {i: (len(sets[i]), at[i]) for i in ids}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rnd = random.Random(6)
    docs = [prose(k, rnd.choice([3, 6, 30, 90])) for k in range(40)]
    for k in range(160):
        w = rnd.choice(docs).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        docs.append(" ".join(w) + rnd.choice(["", " more", " and more of this"]))
    docs += ["one", "ONE", "one two", "", None, " ", "a b c d", "A  b\nc d"]
    numbered = list(enumerate(docs))
    rnd.shuffle(numbered)
    df = spark.createDataFrame([(i, t, "x") for i, t in numbered], "doc_id bigint, text string, n string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(ngram_join.join(df))}
    want = brute_components(numbered)
    assert got == want
    assert sorted(r["doc_id"] for r in rows(ngram_join.kept_rows(df))) == sorted({c for _, c in want.values()})


def test_near_duplicates_edges(edges, none):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows(ngram_join.join(edges)))
    assert len(got) == len(EDGES) and ("None", 76, "5") in got and ("None", 0, "None") in got and got.count(("6", 76, "5")) == 2 and ("2", 0, "2") in got
    assert rows(ngram_join.join(none)) == [] and rows(ngram_join.kept_rows(none)) == []
    kept = rows(ngram_join.kept_rows(edges))
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "2", "3", "4", "5", "7", "8", "9", "None"])


def test_near_duplicates_of_one_id(spark):
    """Different texts of one id are documents of their own; equal rows are copies, of which a fixed one stays."""
    a, b = prose(1, 60), prose(2, 60)
    table = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (7, b + " end", "y"), (7, b + " end", "x"), (None, a, "n"), (None, prose(3, 60), "n"), (None, prose(3, 60), "m"), (8, prose(4, 60), "q"), (8, prose(4, 60), "p")]
    df = spark.createDataFrame(table, "doc_id bigint, text string, TEXT string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows(ngram_join.join(df)))
    assert got == sorted([("3", "3"), ("5", "3"), ("5", "5"), ("7", "5"), ("7", "5"), ("None", "3"), ("None", "None"), ("None", "None"), ("8", "8"), ("8", "8")])
    kept = [tuple(r) for r in ngram_join.kept_rows(df).collect()]
    assert [(i, t) for i, t, _ in sorted(kept, key=str)] == sorted([(3, a), (5, b), (8, prose(4, 60)), (None, prose(3, 60))], key=str)
    assert sorted(kept, key=str) == sorted((tuple(r) for r in ngram_join.kept_rows(df.repartition(3)).collect()), key=str)


@pytest.mark.parametrize("unit", [40, 400])
def test_near_duplicates_in_small_units(spark, monkeypatch, unit):
    for name, value in (("UNIT", unit), ("RANGE", unit), ("UNIT_DOCS", 3), ("BLOCK", 2), ("PAIRS", 4), ("PARTNERS", 1), ("BROADCAST_TEXTS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    common = prose(77, 20)
    docs = [(k, prose(k % 30, 40) + " " + (common if k % 2 else "") + prose(k, k % 9)) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(ngram_join.join(df))} == brute_components(docs)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    n = np.array([5, 100, 100, 3000, 3100, 90])
    sets = [rng.integers(0, 1 << 62, k).astype(np.uint64) for k in n]
    sets[2][:88], sets[4][:2900], sets[5][:] = sets[1][:88], sets[3][:2900], sets[1][:90]
    raw = []
    for k, s in zip(n, sets, strict=True):
        w = int(ngram_join._sketch_bits(np.array([k]))[0])
        raw.append(np.packbits((np.bincount((s % np.uint64(w)).astype(np.int64), minlength=w) & 1).astype(np.uint8), bitorder="little").tobytes())
    a, b = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    near = ngram_join._near(pa.array(raw, pa.binary()), n, a, b)
    for x, y, f in zip(a, b, near, strict=True):
        common = len(np.intersect1d(sets[x], sets[y]))
        assert f or 100 * common < 80 * (n[x] + n[y] - common)
    assert not near[(a == 0) & (b == 1)][0] and near[(a == 3) & (b == 4)][0]


def test_components_of_a_path(spark):
    path = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r["label"] for r in rows(label_edges(path))} == {0}


# 10


def test_toxicity(spark, edges, none):
    docs, labels = [], []
    for k in range(900):
        w = prose(k, 40).split()
        bad = k % 3 == 0
        for _ in range(3 * bad):
            w.insert(random.Random(k).randrange(len(w)), random.Random(k * 7).choice(["grumph", "vrozzle", "grumpher"]))
        docs.append((k, " ".join(w), "x"))
        if k % 2 == 0:
            labels.append((k, 1, int(bad)))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (2, 1, None), (4, 1, 7)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(d, lab)
    got = rows(toxicity.score(d, model))
    held = [(r["score"], r["doc_id"] % 3 == 0) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum((s >= toxicity.THRESHOLD) == y for s, y in held)
    assert right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    e = rows(toxicity.score(edges, model))
    assert len(e) == len(EDGES) and all(0 <= r["score"] <= 1 for r in e) and rows(toxicity.score(none, model)) == []
    nothing = toxicity.train(none, lab)
    share = np.mean([y for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2])
    assert {round(r["score"], 9) for r in rows(toxicity.score(edges, nothing))} == {round(share, 9)}
    assert max(r["score"] for r in rows(toxicity.score(edges, toxicity.train(d, lab.limit(0))))) < 1e-9
    assert toxicity.train(d, lab.where("toxic = 0")).weights == (0.0, 0.0)


def brute_model(rows_, level):
    """(ratio of word after left, sums of both classes after each left) by plain counting of (words, class)."""
    c, n, h = {}, {}, {}
    for words, k in rows_:
        for left, w in zip(["", *words], words):
            c.setdefault((left, w), [0, 0])[k] += 1
    for (_, w), x in c.items():
        for k in (0, 1):
            n.setdefault(w, [0, 0])[k] += x[k] > 0
    for w, x in n.items():
        for k in (0, 1):
            h.setdefault(w[:4], [0, 0])[k] += x[k]
    total = [sum(x[k] for x in n.values()) for k in (0, 1)]
    every = sum(total) + 1
    cut = lambda table, k: (lambda a, b: a / (a + 2 * b) if a else 0.5)(*(sum(x[k] == m for x in table.values()) for m in (1, 2)))
    stat = lambda x, p: 2 * sum(m * np.log(m / (sum(x) * q)) for m, q in zip(x, (1 - p, p)) if m)

    def lower(table, apart, below, totals=total):
        """Probabilities of both classes for what is apart, and the factors for the others."""
        out, factor = {}, []
        for k in (0, 1):
            d, kinds = cut(table, k), sum(x[k] > 0 for x in table.values())
            for w in apart:
                out.setdefault(w, []).append(max(table[w][k] - d, 0) / totals[k] + d * kinds / totals[k] * below(w)[k])
            factor.append((1 - sum(out[w][k] for w in apart)) / (1 - sum(below(w)[k] for w in apart)))
        return out, factor

    stems, m = lower(h, [s for s, x in h.items() if stat(x, total[1] / sum(total)) > level], lambda s: [sum(h[s]) / every] * 2)
    of_stem = lambda s: stems.get(s) or [f * (sum(h[s]) / every) for f in m]
    in_stem = lambda w: [p * sum(n[w]) / (sum(h[w[:4]]) + 1) for p in of_stem(w[:4])]
    share = lambda p, size: size[1] * p[1] / (size[0] * p[0] + size[1] * p[1]) if p else size[1] / sum(size)
    words, f = lower(n, [w for w, x in n.items() if stat(x, share(stems.get(w[:4]), total)) > level], in_stem)
    of_word = lambda w: words.get(w) or [a * b for a, b in zip(f, in_stem(w))]
    size = [sum(x[k] for x in c.values()) for k in (0, 1)]
    apart = {b for b, x in c.items() if stat(x, share(words.get(b[1]) or stems.get(b[1][:4]), size)) > level}
    d = [cut(c, k) for k in (0, 1)]

    def after(left):
        own = {w: x for (a, w), x in c.items() if a == left}
        out = {}
        for k in (0, 1):
            all_, kinds = sum(x[k] for x in own.values()), sum(x[k] > 0 for x in own.values())
            mine = {w: (max(own[w][k] - d[k], 0) + d[k] * kinds * of_word(w)[k]) / all_ if all_ else of_word(w)[k] for w in own if (left, w) in apart}
            rest = (1 - sum(mine.values())) / (1 - sum(of_word(w)[k] for w in mine))
            for w in n:
                out.setdefault(w, []).append(mine.get(w, rest * of_word(w)[k]))
        return out

    unknown = [1 - sum(of_word(w)[k] for w in n) for k in (0, 1)]
    return n, after, unknown, of_word, (len(stems), len(words), len(apart))


def test_kneser_ney_by_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEVEL", 2.0)
    rnd = random.Random(8)
    vocabulary = ["the", "quiet", "quietly", "réeuxment", "réeuxvi", "naïve", "日本語文字", "日本語文", "you", "total", "total1", "x"]
    docs, labels = [], []
    for k in range(160):
        bad = int(k % 4 == 0)
        docs.append((k, " ".join(rnd.choices(vocabulary, [6, 1, 1, 1 + 4 * bad, 2 * bad, 1, 1, 1, 2, 2, 1, 1], k=20)) + " you total x" * bad))
        labels.append((k, bad))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(d, lab)
    counted = [(t.lower().split(), y) for (i, t), (_, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 4 < 2]
    n, after, unknown, of_word, sizes = brute_model(counted, 2.0)
    assert sizes == (len(model.stems), len(model.words), len(model.pairs)) and min(sizes) >= 1
    checked = 0
    for left in ["", *n]:
        told = after(left)
        for k in (0, 1):  # what contexts leave to unknown words is what all leave to them, rescaled
            assert 0 < sum(p[k] for p in told.values()) < 1
        for w, p in told.items():
            if left:
                s = next(W.slices(pa.array([f"{left} {w}"])))
                read, stem, before = toxicity._read(s)
                assert model.ratios(read.hash[1:], stem[1:], before[1:])[0] == pytest.approx(np.log(p[1] / p[0]), abs=1e-9), (left, w)
                checked += 1
    assert checked > 100 and all(0 < u < 1 for u in unknown)


def test_large_models_stay_in_tables(spark, edges, none, monkeypatch):
    """Joined with the model's tables, texts get the values that a model sent to them gives."""
    monkeypatch.setattr(toxicity, "LEVEL", 4.0)
    docs = [(k, prose(k, 30) + " you total grumph you total grumph" * (k % 3 == 0)) for k in range(300)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id bigint, toxic int")
    sent = toxicity.train(d, lab)
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    joined = toxicity.train(d, lab)
    assert len(sent.pairs) and not len(joined.pairs) and joined.tables
    assert (*joined.weights, joined.offset) == pytest.approx((*sent.weights, sent.offset), rel=1e-6)
    for hot in (toxicity.HOT_KEYS, 8):  # with hot keys and without
        monkeypatch.setattr(toxicity, "HOT_KEYS", hot)
        for table in (d, edges):
            expected = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in rows(toxicity.score(table, sent)))
            assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in rows(toxicity.score(table, joined))) == expected
    assert rows(toxicity.score(none, joined)) == []


def test_curve_without_a_class(spark):
    docs = [(k, prose(k, 20) + (" grumph grumph" if k % 2 else "")) for k in range(200)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    lab = spark.createDataFrame([(k, k % 2) for k in range(200) if fold(k) < 2 or k % 2 == 0], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.score(d, toxicity.train(d, lab)))}
    assert np.mean([got[k] for k in range(1, 200, 2)]) > np.mean([got[k] for k in range(0, 200, 2)]) + 0.1
    only = {r["score"] for r in rows(toxicity.score(d, toxicity.train(d, lab.where("toxic = 1"))))}
    assert len(only) == 1 and only.pop() > 0.99


def test_values_by_hand():
    none = [x for kind in (np.int32, np.int64, np.int32, np.int64) for x in (np.zeros(0, kind), np.zeros(0))]
    m = toxicity.Model(*none, 2.0)
    mean, most = m.values(pa.array(["", None, "one", "one two", "one two three"]))
    assert mean.tolist() == [0, 0, 2, 2, 2] and most.tolist() == [0, 0, 1, 2, 2]
