"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans (e-mail, IP and card numbers, telephone numbers).  Around what is
left of digit groups and spelt-out addresses, the field scores whole candidate segments: a segment's
features see its digits, grouping, separators, check digits and the words beside it together.  A
dynamic program over segments of at most ``LONGEST`` pieces, with base spans as fixed segments,
chooses boundaries and kinds jointly.  Its spans are added; base spans always stay.

The field is trained here by maximum likelihood: on ``SEEDS`` below, and on regions of the corpus,
labelled by the base patterns and rewritten in the ways in which such data escape these patterns.
The corpus gives at most ``TRAIN_REGIONS`` regions (the documented bound of its training rows).

Null and empty texts have no spans.  Rows are judged each for itself; other columns play no part.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.shared import arrow_pass, numbered, picked, place

KINDS = ("email", "ip", "card", "phone")
LONGEST = 8
TRAIN_REGIONS = 400
#: One text in so many is looked at for training regions.
TRAIN_PART = 32
#: Log-odds by which a segment must beat being left alone.
MARGIN = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Digit groups with up to three separators between them, and spelt-out addresses.
_REGION = re.compile(
    r"(?<![0-9A-Za-z])(?:[+(]{0,2}[0-9]++(?:[ ().-]{1,3}[0-9]++)*)(?![0-9A-Za-z])"
    r"|(?<![\w.])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,64}){1,6}"
    r"|(?<![\w.])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,64}(?: dot [A-Za-z0-9-]{1,64}){1,6}"
)
_PIECE = re.compile(r"[+(]{0,2}[0-9]+|[A-Za-z0-9._%+-]+")
_CUES = {"phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "ip": "ip", "host": "ip", "address": "ip", "mail": "email", "email": "email", "version": "no", "isbn": "no", "page": "no", "figure": "no", "order": "no"}

#: Training texts: spans are marked as {kind:text}.
SEEDS = """
call {phone:(212) 555-0187} now
phone {phone:212-555-0187}
tel {phone:212.555.0187} or
{phone:(743) 555-3824}
{phone:743-555-3824} and
fax {phone:0049 30 901820}
mobile {phone:0171 5550123}
reach {phone:(020) 7946 0018}
card {card:4111 1111 1111 1111} paid
card {card:5500-0000-0000-0004}
visa {card:4012.8888.8888.1881}
{card:3782 822463 10005}
mail {email:john.doe [at] mail [dot] example [dot] com} soon
{email:jane at example dot org}
write {email:info (at) example (dot) net}
version 10.2.33.4055
isbn 978 3 16 148410 0
in 2019 2020 2021 2022
figures 12 345 678 901 234
order 100245 300245
date 2024-05-17 10.30
from 01.02.2003 on
1234 5678 9012 3456
16 32 64 128 256
{ip:10.0.0.255} is
code 000123456789
at 12.30 or 14.45
total 1 250 000 000
on 2021-11-03 2021-11-04
300.400.500.600
in the room at home dot
"""


def luhn(digits: str) -> bool:
    """Whether digits pass the check that ends card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then by start."""
    out: list[tuple[str, int, int]] = []
    at, a = 0, text.find("@")
    while a >= 0:
        start = a
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        if start < a and (m := _DOMAIN.match(text, a + 1)):
            out.append(("email", start, m.end()))
            at = m.end()
        a = text.find("@", max(a + 1, at))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


@dataclass
class Region:
    """Pieces (start, end) of a stretch of text in which segments are chosen; words beside it."""

    pieces: list[tuple[int, int]]
    cue: str


def _region(text: str, start: int, end: int) -> Region:
    before = re.findall(r"[A-Za-z]+", text[max(0, start - 24) : start])
    return Region([m.span() for m in _PIECE.finditer(text, start, end)], _CUES.get(before[-1].lower(), "other") if before else "none")


def features(text: str, region: Region, i: int, j: int) -> list[str]:
    """Names of the features of pieces i to j (exclusive) as one segment."""
    pieces = region.pieces
    part = text[pieces[i][0] : pieces[j - 1][1]]
    if any(c.isalpha() for c in part):
        out = ["words", f"pieces={min(j - i, 9)}"]
        if re.search(r"[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?[\[(]dot[\])]|\.[A-Za-z0-9-])", part):
            out.append("spelt")
        elif re.fullmatch(r"\S+ at \S+(?: dot \S+)+", part):
            out.append("plain")
        out.append("all" if j - i == len(pieces) else "part")
        return out
    groups = re.findall(r"[0-9]+", part)
    digits = "".join(groups)
    n, gaps = len(digits), re.split(r"[0-9]+", part)[1:-1]
    out = [f"digits={n if n < 20 else 20}", f"groups={min(len(groups), 9)}", "whole" if j - i == len(pieces) else "part", f"cue={region.cue if i == 0 else 'inside'}"]
    out.append("lengths=" + "-".join(str(min(len(g), 9)) for g in groups[:6]))
    out.append("gaps=" + "".join(sorted({c for g in gaps for c in g})) if len({*gaps}) <= 3 else "gaps=many")
    if 13 <= n <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
        if luhn(digits) and len({len(g) for g in groups[:-1]}) <= 1 and len(groups) > 1:
            out.append("luhn groups")
    if len(groups) == 4 and {*gaps} == {"."}:
        out.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "no octets")
    if part[0] in "+(":
        out.append(f"first={part[0]}")
    if len(groups) >= 3 and len(groups[0]) == 4 and groups[0][:2] in ("19", "20"):
        out.append("year")
    if len(groups) >= 3 and [len(g) for g in groups[:3]] == [3, 3, 4]:
        out.append("three three four")
    return out


@dataclass
class SemiMarkov:
    """Weights of features by kind; kind 0 is no entity, of one piece at a time."""

    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1, 0)))

    def _scores(self, text: str, region: Region, i: int, j: int) -> np.ndarray:
        known = [k for f in features(text, region, i, j) if (k := self.names.get(f)) is not None]
        s = self.weights[:, known].sum(1)
        if j - i > 1:
            s[0] = -np.inf
        return s

    def decode(self, text: str, region: Region) -> list[tuple[str, int, int]]:
        """The best segmentation's entities: best[j] is the score of the best one of the first j pieces."""
        n = len(region.pieces)
        best, back = np.full(n + 1, -np.inf), [(0, 0)] * (n + 1)
        best[0] = 0.0
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                s = self._scores(text, region, i, j)
                s[1:] -= MARGIN
                k = int(np.argmax(s))
                if best[i] + s[k] > best[j]:
                    best[j], back[j] = best[i] + s[k], (i, k)
        out, j = [], n
        while j > 0:
            i, k = back[j]
            if k:
                out.append((KINDS[k - 1], region.pieces[i][0], region.pieces[j - 1][1]))
            j = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 120, prior: float = 0.02) -> SemiMarkov:
        """Maximum likelihood by gradient steps; expectations by forward and backward sums over segments."""
        cases = []
        names: dict[str, int] = {}
        for text, spans in examples:
            for m in _REGION.finditer(text):
                region = _region(text, *m.span())
                n = len(region.pieces)
                if n > 40:
                    continue
                segments = {}
                for i in range(n):
                    for j in range(i + 1, min(n, i + LONGEST) + 1):
                        segments[i, j] = [names.setdefault(f, len(names)) for f in features(text, region, i, j)]
                truth, i = [], 0
                while i < n:
                    hit = next(((k, b) for k, a, b in spans if a <= region.pieces[i][0] < b), None)
                    j = i + 1
                    if hit:
                        while j < n and region.pieces[j][0] < hit[1]:
                            j += 1
                    if (i, j) not in segments:
                        break
                    truth.append((i, j, KINDS.index(hit[0]) + 1 if hit else 0))
                    i = j
                else:
                    cases.append((n, segments, truth))
        w = np.zeros((len(KINDS) + 1, len(names)))
        square = np.full_like(w, 1e-6)
        for _ in range(rounds):
            grad = -prior * w
            for n, segments, truth in cases:
                score = {}
                for ij, fs in segments.items():
                    s = w[:, fs].sum(1)
                    if ij[1] - ij[0] > 1:
                        s[0] = -np.inf
                    score[ij] = s
                ahead, after = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                ahead[0] = after[n] = 0.0
                for j in range(1, n + 1):
                    ahead[j] = np.logaddexp.reduce([ahead[i] + np.logaddexp.reduce(score[i, j]) for i in range(max(0, j - LONGEST), j)])
                for i in range(n - 1, -1, -1):
                    after[i] = np.logaddexp.reduce([after[j] + np.logaddexp.reduce(score[i, j]) for j in range(i + 1, min(n, i + LONGEST) + 1)])
                for i, j, k in truth:
                    grad[k, segments[i, j]] += 1
                for (i, j), fs in segments.items():
                    p = np.exp(np.clip(ahead[i] + score[i, j] + after[j] - ahead[n], -700, 0))
                    for f in fs:
                        grad[:, f] -= p
            square += grad * grad
            w += 0.5 * grad / np.sqrt(square)
        self.names, self.weights = names, w
        return self


def _marked(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A training line without its marks, and the spans they gave."""
    text, spans = "", []
    for m in re.finditer(r"\{(\w+):([^}]*)\}|([^{]+)", line):
        if m[1]:
            spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2] or m[3] or ""
    return text, spans


def _rewritten(text: str, kind: str, start: int, end: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The ways in which a base span's data escape the base patterns, as training texts."""
    part = text[start:end]
    forms = [part]
    if kind == "phone":
        bare = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", part)
        digits = re.sub(r"[^0-9]", "", bare)
        if len(digits) == 10:
            forms += [bare, *(g.format(digits[:3], digits[3:6], digits[6:]) for g in ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}"))]
    elif kind == "card":
        digits = re.sub(r"[^0-9]", "", part)
        forms += [s.join(digits[k : k + 4] for k in range(0, len(digits), 4)) for s in (".", " - ")]
    elif kind == "email":
        forms += [part.replace("@", a).replace(".", d) for a, d in ((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "."))]
    return [(text[:start] + f + text[end:], [(kind, start, start + len(f))]) for f in forms]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SemiMarkov:
    """Fits the field on the seeds and on at most TRAIN_REGIONS regions of the corpus."""
    rows = picked(docs, id_col, text_col).where(F.pmod(F.xxhash64("text"), F.lit(TRAIN_PART)) == 0)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch["text"].to_pylist():
            for kind, a, b in base_spans(text or ""):
                if b - a <= 100:
                    lo = max(0, a - 24)
                    out.append((text[lo : b + 12], kind, a - lo, b - lo))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["text", "kind", "start", "end"])

    found = arrow_pass(rows, each, "text string, kind string, start int, end int")
    examples = [_marked(line) for line in SEEDS.strip().split("\n")]
    for r in found.orderBy(F.xxhash64("kind", "text"), "start").limit(TRAIN_REGIONS).collect():
        examples += _rewritten(r["text"], r["kind"], r["start"], r["end"])
    weight = defaultdict(int)
    for text, spans in examples:
        weight[text, tuple(spans)] += 1
    return SemiMarkov().fit([(t, list(s)) for t, s in weight])


def find(text: str, model: SemiMarkov) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans; both by kind as listed, then by start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    if _DIGIT.search(text) or " dot " in text or "dot]" in text or "dot)" in text or "at]" in text or "at)" in text:
        for m in _REGION.finditer(text):
            a, b = m.span()
            if b - a < 7 or (not text[a:b].isdigit() or b - a < 13) and sum(c.isdigit() for c in text[a:b]) < 7 and not any(x in text[a:b] for x in ("dot", "at]", "at)")):
                continue
            free, at = [], a
            for s, e in taken:  # base spans are fixed segments: what lies between them is decoded
                if e > at and s < b:
                    free.append((at, s))
                    at = max(at, e)
            for s, e in [*free, (at, b)]:
                if e - s >= 7:
                    added += [x for x in model.decode(text, _region(text, s, e)) if not any(x[1] < q and p < x[2] for p, q in taken)]
    return base, sorted([*base, *added], key=lambda x: (KINDS.index(x[0]), x[1]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: SemiMarkov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: its id, base spans counted by kind, ``base`` and ``spans`` as kind:start:end, comma-joined."""
    rows = picked(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[] for _ in KINDS]
        base, spans = [], []
        for text in batch["text"]:
            b, s = find(text.as_py() or "", sent.value)
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(x[0] == kind for x in b))
            base.append(_joined(b))
            spans.append(_joined(s))
        return pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string"
    return arrow_pass(rows, each, schema).withColumnRenamed("id", id_col)


def masked(text: str, model: SemiMarkov) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the whole stretch, under the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(find(text, model)[1], key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked_rows(docs: DataFrame, model: SemiMarkov, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with masked texts (null stays null); a column of the text's length, if there is one, follows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows, k = numbered(docs), place(docs, text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if t is None else masked(t, sent.value) for t in batch.column(k).to_pylist()]
        columns = list(batch.columns)
        columns[k] = pa.array(new, batch.schema.field(k).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = arrow_pass(rows, each, rows.schema)
    if size_col and size_col in docs.columns:
        size = f"c{place(docs, size_col)}"
        out = out.withColumn(size, F.when(F.col(f"c{k}").isNull(), F.col(size)).otherwise(F.length(f"c{k}").cast(rows.schema[size].dataType)))
    return out.toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
