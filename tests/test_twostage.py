"""The two-stage scan: any order and any batches give the log of a plain loop; waits, dead letters, repeated answers."""

import datetime
import random

import pytest
from stratum.streaming import scan, twostage

RULE = twostage.ScanRule(threshold=0.6, tries=3, base=2.0)
START = datetime.datetime(2024, 1, 1)
KINDS = [None, None, None, None, "api_error", "connection_failed", "invalid_json", "model_not_found", "reasoning_only"]
SCHEMA = "key bigint, n bigint, at timestamp, kind string, candidate boolean, confidence double"


def answers(seed, keys):
    rnd = random.Random(seed)
    return [(k, n, START + datetime.timedelta(seconds=20 * n + k), rnd.choice(KINDS), rnd.random() < 0.8, rnd.randrange(101) / 100) for k in range(keys) for n in range(rnd.randint(1, 8))]


def loop(rows):
    """Records, dead letters and retries by one pass over each key's answers."""
    records, dead, retries = {}, set(), set()
    for key in {r[0] for r in rows}:
        stage, attempt, asked, requests, waited, first = 1, 0, False, 1, 0.0, None
        for _, _, at, kind, candidate, confidence in sorted(r for r in rows if r[0] == key):
            if kind in ("api_error", "connection_failed") and attempt < RULE.tries - 1:
                attempt += 1
                seconds = twostage.wait(key, stage, attempt, RULE.base)
                waited += seconds
                requests += 1
                retries.add((key, stage, attempt, at + datetime.timedelta(milliseconds=int(seconds * 1000))))
            elif kind == "invalid_json" and not asked:
                asked, attempt, requests = True, 0, requests + 1
            elif stage == 1 and kind is None and candidate and confidence >= RULE.threshold:
                stage, attempt, asked, requests, first = 2, 0, False, requests + 1, confidence
            else:
                if stage == 1 and kind:
                    records[key] = ("needs_retry" if kind == "reasoning_only" else "error", False, 0.0, None, None, None, kind, requests)
                    dead.add(key)
                elif stage == 1:
                    records[key] = ("ok", candidate, confidence, None, None, None, None, requests)
                elif kind:
                    records[key] = ("ok", True, first, "error", False, 0.0, kind, requests)
                else:
                    records[key] = ("ok", True, first, "ok", candidate, confidence if candidate else 0.0, None, requests)
                break
    return records, dead, retries


def run(spark, tmp_path, batches):
    folder = f"file://{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        out = twostage.scanned(scan.source(spark, folder, SCHEMA), RULE, "2 hours").writeStream.format("parquet")
        out.option("checkpointLocation", f"file://{tmp_path}/check").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    fields = ("status", "candidate", "confidence", "review_status", "review_confirmed", "review_confidence", "error_type", "requests")
    found = [r for r in rows if r["what"] == "record"]
    assert len({r["key"] for r in found}) == len(found)
    records = {r["key"]: tuple(r[c] for c in fields) for r in found}
    return records, {r["key"] for r in rows if r["what"] == "dead"}, {(r["key"], r["stage"], r["attempt"], r["due"]) for r in rows if r["what"] == "retry"}


@pytest.mark.parametrize("parts", [1, 3])
def test_any_split_gives_one_log(spark, tmp_path, parts):
    rows = answers(1, 40)
    records, dead, retries = loop(rows)
    assert dead and retries and {r[3] for r in records.values()} == {None, "ok", "error"}
    shuffled = rows[:]
    if parts > 1:
        random.Random(2).shuffle(shuffled)
        shuffled += rows[::7]  # delivered twice
    size = -(-len(shuffled) // parts)
    end = (10**6, 0, START + datetime.timedelta(days=1), None, False, 0.0)  # moves the watermark past all waits
    got = run(spark, tmp_path, [shuffled[i : i + size] for i in range(0, len(shuffled), size)] + [[end]]) if parts == 1 else None
    if got is None:
        later = [(k, n, START + datetime.timedelta(hours=1), *rest) for k, n, _, *rest in shuffled]
        records, dead, retries = loop({(k, n): (k, n, at, *rest) for k, n, at, *rest in later}.values())
        got = run(spark, tmp_path, [later[i : i + size] for i in range(0, len(later), size)] + [[end]])
    assert got[0].pop(10**6)[0] == "ok" and got == (records, dead, retries)


def test_waits_grow_and_differ():
    waits = [[twostage.wait(k, 1, a, 1.0) for a in (1, 2, 3)] for k in range(50)]
    assert all(1 <= a < 1.1 and 2 <= b < 2.1 and 4 <= c < 4.1 for a, b, c in waits) and len({w[0] for w in waits}) > 40
