"""Conversation repair against an exhaustive search, in one piece and in many, and over nulls, ties, repeated rows and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F
from stratum.llm import turn_repair

FORM = re.compile("(s?(ua)+)?")


def cheapest(symbols):
    """Cost and audit of the cheapest edits by plain search; symbols: (initial, must go, truncated)."""
    roles = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last):
        ways = [(0, "")] if i == len(symbols) and last in ("", "a") else []
        if i < len(symbols):
            x, gone, cut = symbols[i]
            c, s = best(i + 1, last)
            ways.append((c + 4, "D" + s))
            if not gone:
                if x in roles[last]:
                    c, s = best(i + 1, x)
                    ways.append((c + 3 * cut, "K" + s))
                new = "a" if last == "u" else "u"
                c, s = best(i + 1, new)
                ways.append((c + 3 + 3 * cut, "R" + s))
        if (new := "a" if last == "u" else "u") and inserts.get((i, last), 0) < 2:
            inserts[i, last] = inserts.get((i, last), 0) + 1
            c, s = search(i, new, 1)
            ways.append((c + 3, "I" + s))
            inserts[i, last] -= 1
        return min(ways) if ways else (10**9, "")

    inserts: dict = {}

    def search(i, last, depth):
        """As best, but for at most two turns put in beside each other."""
        ways = [(0, "")] if i == len(symbols) and last in ("", "a") else []
        if i < len(symbols):
            x, gone, cut = symbols[i]
            c, s = best(i + 1, last)
            ways.append((c + 4, "D" + s))
            if not gone:
                if x in roles[last]:
                    c, s = best(i + 1, x)
                    ways.append((c + 3 * cut, "K" + s))
                c, s = best(i + 1, "a" if last == "u" else "u")
                ways.append((c + 3 + 3 * cut, "R" + s))
        if depth < 2:
            c, s = search(i, "a" if last == "u" else "u", depth + 1)
            ways.append((c + 3, "I" + s))
        return min(ways) if ways else (10**9, "")

    return best(0, "")


def brute(rows):
    """Digest rows by conversation from (conv_id, turn, role, text) rows."""
    by: dict = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, found in by.items():
        found.sort()
        seen, symbols, faults = set(), [], []
        for _, _, r, x in found:
            body = re.sub(r"[\x20\x09-\x0D]", "", x)
            fault = "b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((r, x))
            faults.append(fault)
            symbols.append((r[:1] or " ", fault in ("b", "d"), fault == "t"))
        cost, audit = cheapest(tuple(symbols))
        lines, last, i = [], "", 0
        for letter in audit:
            new = "a" if last == "u" else "u"
            if letter == "I":
                lines.append(("user:" if new == "u" else "assistant:"))
                last = new
                continue
            _, _, r, x = found[i]
            i += 1
            if letter == "K":
                lines.append(f"{r}:{x}")
                last = r[0]
            elif letter == "R":
                lines.append(("user:" if new == "u" else "assistant:") + x)
                last = new
        assert FORM.fullmatch("".join(x[0] for x in lines))
        turns = [t for known, t, _, _ in found if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(symbols))
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[c] for c in columns) for r in rows}


def chats(seed, n, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(rnd.randint(1, longest)):
            turn += rnd.choice([0, 1, 1, 1, 2])
            text = rnd.choice([None, "", " \n", "one.", "two!", "cut", "so? ", "x y", "é。", f"t{rnd.randrange(9)}."])
            rows.append((c, rnd.choice([turn, turn, turn, None]), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), text))
    return rows + [(None, 1, "user", "hi."), (None, 2, "assistant", "yes."), (None, None, None, None)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_vectors_are_few():
    t = turn_repair.tables()
    assert len(t.vectors) < 64 and t.block.shape == (len(t.vectors), turn_repair.SYMBOLS**turn_repair.BLOCK)


@pytest.mark.parametrize("limits", [{}, {"long_rows": 3, "piece": 4}, {"long_bytes": 5, "piece": 1}, {"long_rows": 0, "piece": 8}])
def test_repair(spark, limits):
    rows = chats(1, 60, 14)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = got(turn_repair.digests(turn_repair.repair(df, **limits)))
    want = brute(rows)
    assert found == want


def test_turns(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind."), (1, 1, "tool", "what?"), (1, 2, "user", "hm.")], SCHEMA)
    rows = turn_repair.turns(turn_repair.repair(df)).orderBy("place").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("system", "be kind."), ("user", "what?"), ("assistant", "hm.")]


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", id string")
    assert turn_repair.digests(turn_repair.repair(none)).count() == 0
    rows = chats(2, 5, 6)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", id string, piece bigint, TEXT string")
    assert got(turn_repair.digests(turn_repair.repair(df))) == brute(rows)


def test_long_text(spark):
    rows = [(1, 0, "user", "ab " * 400_000 + "."), (1, 1, "assistant", "x" * 1_000_000)]
    assert got(turn_repair.digests(turn_repair.repair(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_query_damage(spark, tmp_path):
    rows = chats(3, 80, 8)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/conversations.parquet")
    after, ids = [], {r[0] for r in rows}
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        one = (c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
        after += [] if k == 0 else [one, one] if k == 3 else [one]
    want = brute(after)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(turn_repair.query(spark, f"file://{tmp_path}")) == {c: want.get(c, nothing) for c in ids}


def test_lost_rows_leave_their_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", True)], SCHEMA + ", gone boolean").withColumn("gone", F.col("gone"))
    assert got(turn_repair.digests(turn_repair.repair(df, lost_col="gone")))[1][6] == ""
