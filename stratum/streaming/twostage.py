"""A scan in two stages as a stateful stream: first looks, reviews of candidates, tries with growing waits, dead letters.

Answers (key, n, at, kind, candidate, confidence) come in any order and any batches: ``n`` numbers a key's answers from 0, early ones
wait in the key's state for those before them, and ones that were seen are passed over.  So the same answers always
give the same log.  ``kind`` is NULL for a good answer, else what went wrong (``scanlog.error_kind``).

- Troubles of the way (RETRIED kinds) are tried again, ``tries`` times in all, after base * 2^k and up to a tenth of a second more, by the key's hash.
- A broken answer is asked for once more, with new tries.
- A first look that is no candidate, or not sure enough, ends the key; others are reviewed.
- A review that fails leaves the record unconfirmed, with what went wrong; a first look that fails makes a dead letter.
"""

from __future__ import annotations

import datetime
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RETRIED = ("api_error", "connection_failed")
BROKEN = "invalid_json"
#: A record of this kind may be scanned again later.
AGAIN = "reasoning_only"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: ``what`` is record (a key is done), dead (its first look failed; the record comes too) or retry (a wait is over: ask again).
SCHEMA = """what string, key bigint, stage int, attempt int, due timestamp, status string, candidate boolean, confidence double, review_status string,
review_confirmed boolean, review_confidence double, error_type string, requests int, waited double"""
_COLUMNS = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]


@dataclass(frozen=True)
class ScanRule:
    threshold: float = 0.5
    tries: int = 3
    base: float = 1.0


def wait(key: int, stage: int, attempt: int, base: float) -> float:
    """Seconds before try ``attempt`` (from 1): doubled each time, with up to a tenth of a second by the key's hash, so that keys don't come back together."""
    return base * 2 ** (attempt - 1) + zlib.crc32(f"{key}:{stage}:{attempt}".encode()) % 1000 / 10000


class TwoStages(StatefulProcessor):
    """The state of a key: how far it is, answers that came early, and waits that aren't over."""

    def __init__(self, rule: ScanRule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "expected bigint, stage int, attempt int, asked boolean, done boolean, requests int, waited double, confidence double")
        self.early = handle.getMapState("early", "n bigint", "at bigint, kind string, candidate boolean, confidence double")
        self.waits = handle.getMapState("waits", "due bigint", "stage int, attempt int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = list(self.now.get()) if self.now.exists() else [0, 1, 0, False, False, 1, 0.0, None]
        for pdf in rows:
            for n, at, kind, candidate, confidence in pdf[["n", "at", "kind", "candidate", "confidence"]].itertuples(index=False):
                if n >= now[0]:
                    value = (int(at.value // 1_000_000), None if pd.isna(kind) else str(kind), bool(candidate) if not pd.isna(candidate) else False, float(confidence) if not pd.isna(confidence) else 0.0)
                    self.early.updateValue((int(n),), value)
        out = []
        while self.early.containsKey((now[0],)):
            at, kind, candidate, confidence = self.early.getValue((now[0],))
            self.early.removeKey((now[0],))
            now[0] += 1
            if not now[4]:
                out += self._answer(int(key[0]), now, at, kind, candidate, confidence)
        self.now.update(tuple(now))
        if out:
            yield _frame(out)

    def _answer(self, key: int, now: list, at: int, kind: str | None, candidate: bool, confidence: float) -> list[dict]:
        _, stage, attempt, asked, _, _, _, first = now
        if kind in RETRIED and attempt + 1 < self.rule.tries:
            seconds = wait(key, stage, attempt + 1, self.rule.base)
            now[2], now[5], now[6] = attempt + 1, now[5] + 1, now[6] + seconds
            due = at + int(seconds * 1000)
            self.waits.updateValue((due,), (stage, attempt + 1))
            self.handle.registerTimer(due)
            return []
        if kind == BROKEN and not asked:
            now[2], now[3], now[5] = 0, True, now[5] + 1
            return []
        if stage == 1 and kind is None and candidate and confidence >= self.rule.threshold:
            now[1], now[2], now[3], now[5], now[7] = 2, 0, False, now[5] + 1, confidence
            return []
        now[4] = True
        row = {"what": "record", "key": key, "stage": stage, "attempt": now[2], "status": "ok", "requests": now[5], "waited": round(now[6], 4)}
        if stage == 1:
            row |= {"candidate": candidate if kind is None else False, "confidence": confidence if kind is None else 0.0}
            if kind is not None:
                row |= {"status": "needs_retry" if kind == AGAIN else "error", "error_type": kind}
                return [row, row | {"what": "dead"}]
            return [row]
        row |= {"candidate": True, "confidence": first, "review_status": "ok", "review_confirmed": candidate, "review_confidence": min(max(confidence, 0.0), 1.0) if candidate else 0.0}
        if kind is not None:
            row |= {"review_status": "error", "review_confirmed": False, "review_confidence": 0.0, "error_type": kind}
        return [row]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.waits.containsKey((due,)):
            stage, attempt = self.waits.getValue((due,))
            self.waits.removeKey((due,))
            yield _frame([{"what": "retry", "key": int(key[0]), "stage": stage, "attempt": attempt, "due": datetime.datetime.fromtimestamp(due / 1000, datetime.UTC).replace(tzinfo=None)}])


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    out["due"] = pd.to_datetime(out["due"])
    for c in ("what", "status", "review_status", "error_type"):
        out[c] = pd.Series([None if pd.isna(x) else x for x in out[c]], dtype=object)
    for c, kind in (("candidate", "boolean"), ("review_confirmed", "boolean"), ("requests", "Int32"), ("stage", "Int32"), ("attempt", "Int32")):
        out[c] = out[c].astype(kind)
    for c in ("confidence", "review_confidence", "waited"):
        out[c] = out[c].astype("float64")
    return out


def scanned(answers: DataFrame, rule: ScanRule = ScanRule(), late: str = "10 minutes") -> DataFrame:
    """The stream of records, dead letters and retries of a stream of answers.  The watermark, ``late`` behind the answers' times, ends waits."""
    answers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = answers.select("key", "n", "at", "kind", "candidate", "confidence").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=TwoStages(rule), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
