"""The pipeline against its stages by brute force, on a small fixture."""

import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_llm_operators import brute_components, brute_hits, brute_quality, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    passage = prose(99, 40)
    docs = [(k, prose(k, 80)) for k in range(30)]
    docs += [(30, prose(1, 80)), (31, prose(2, 80) + " end"), (32, "short"), (33, "a b c " * 50), (34, prose(3, 60) + " " + passage), (35, prose(40, 70) + " mail me@example.com"), (36, None), (37, "% " * 90 + prose(5, 60))]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, [(1, passage)]


def test_pipeline(spark, tables):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, docs, items = tables
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    good = []
    for i, t in docs:
        n, chars, symbols, lines, same, again = brute_quality(t)
        if not (n < 50 or 100 * again > 50 * n or chars > 40 * n or symbols > n or (lines >= 5 and 5 * same > 4 * lines)):
            good.append((i, t))
    heads = {c for _, c in brute_components(good).values()}
    good = [(i, t) for i, t in good if i in heads]
    clean = [x for x, (n, h, _) in zip(good, brute_hits([t for _, t in good], items), strict=True) if not (h and 20 * h >= n)]
    assert set(got) == {i for i, _ in clean} and 34 not in got and 31 not in got and 35 in got
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in clean:
        text = t.replace("me@example.com", "<email>")
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text)
        assert got[i]["n_tokens"] == len(theirs.encode(text, add_special_tokens=False).ids) and got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    before = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, before, folder).columns == before.columns


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names if n[2].isdigit()} == set(range(1, 14)) and "pipeline" in entry.queries()
