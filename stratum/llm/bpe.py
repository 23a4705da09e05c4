"""Byte-level BPE encoding and decoding with a given vocabulary.

A word is merged in a contiguous rank array: the boundaries of its parts and, beside each, the rank
of joining the two parts there.  The smallest rank is found by a scan, its boundary deleted, and the
ranks of the two neighbours looked up again.  Words of more than ``SHORT`` bytes, for which repeated
scans would be quadratic, take the same steps with a heap in place of the scan.

Encoded words are remembered per worker, in a table that is emptied at ``REMEMBER`` words.

Null texts count as empty: no tokens.  Each row is encoded by itself, so repeated rows and other
columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratum.llm.shared import arrow_pass, chosen, numbered, picked, place

SHORT = 64
REMEMBER = 400_000
_NONE = 1 << 60


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: White space by its Unicode property, as the tokenizers library has it: without U+001C to U+001F.
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: How a text is cut into words before merging (a fixed value of the vocabulary): contractions, letters, numbers, the rest, white space.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class Codec:
    """A vocabulary file of the tokenizers library: byte-level BPE with the added tokens taken whole."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_characters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        raw = lambda token: bytes(byte[c] for c in token)
        self.ids = {raw(t): i for t, i in vocab.items() if all(c in byte for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: The merge of two neighbouring parts: its rank. Parts are told apart, not only their join.
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word."""
        if (whole := self.ids.get(word)) is not None and len(word) == 1:
            return (whole,)
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _short(self, word: bytes) -> tuple[int, ...]:
        rank = self.ranks.get
        at = list(range(len(word) + 1))  # boundaries of the parts
        ranks = [rank((word[i : i + 1], word[i + 1 : i + 2]), _NONE) for i in range(len(word) - 1)]  # of joining part i and the next
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            del at[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((word[at[i] : at[i + 1]], word[at[i + 1] : at[i + 2]]), _NONE)
            if i:
                ranks[i - 1] = rank((word[at[i - 1] : at[i]], word[at[i] : at[i + 1]]), _NONE)
        return tuple(self.ids[word[a:b]] for a, b in zip(at, at[1:]))

    def _long(self, word: bytes) -> tuple[int, ...]:
        n, rank = len(word), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := rank((word[i:j], word[j : end[j]]))) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != k:
                continue
            alive[j], end[i] = False, k
            if k < n:
                before[k] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(self.ids[word[i : end[i]]] for i in range(n) if alive[i])

    def _ordinary(self, text: str) -> list[int]:
        words, known = self.words.findall(text), self.known
        try:
            return list(chain.from_iterable(map(known.__getitem__, words)))
        except KeyError:
            pass
        if len(known) > REMEMBER:
            known.clear()
        out: list[int] = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self.merged(w.encode())
                if len(w) <= SHORT:
                    known[w] = ids
            out.extend(ids)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text; added tokens in it are their own ids."""
        if self.special is None or not any(t in text for t in self.added):
            return self._ordinary(text)
        out: list[int] = []
        for part in self.special.split(text):
            out.extend([self.added[part]] if part in self.added else self._ordinary(part))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, read once for each worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: its id and ``ids``, the whole text's token ids.  The file must be at ``path`` on every machine."""
    rows = picked(docs, id_col, text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t or "") for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return arrow_pass(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """For each row of ``tokens``: its id and ``text``, what its ids decode to; null ids count as none."""
    rows = chosen(tokens, id=id_col, ids=ids_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.RecordBatch.from_arrays([batch["id"], pa.array([c.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())], ["id", "text"])

    return arrow_pass(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Encodes and decodes each text in one pass: the id, ``n_tokens``, ``ids_sha256`` of the ids in decimal, joined by
    commas, and ``decoded_sha256``.  With ``carry`` the columns of ``docs`` come first, as they are, but for those that
    have one of these names in any case: they are replaced."""
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    rows = numbered(docs) if carry else picked(docs, id_col, text_col)
    text = f"c{place(docs, text_col)}" if carry else "text"
    new = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        out: tuple[list, list, list] = ([], [], [])
        for t in batch[text]:
            ids = c.encode(t.as_py() or "")
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            out[2].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        kept = batch if carry else batch.select(["id"])
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
        return pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"])

    if carry:
        schema = T.StructType([*rows.schema, *(T.StructField(c, T.LongType() if c == "n_tokens" else T.StringType()) for c in names)])
        kept = [i for i, c in enumerate(docs.columns) if c.lower() not in names]
        return arrow_pass(rows, each, schema).select(*(f"c{i}" for i in kept), *names).toDF(*(docs.columns[i] for i in kept), *names)
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_pass(rows, each, f"id {kind}, {new}").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
