"""Toxicity by class-conditional Kneser-Ney bigram models.

Each class c (toxic, ordinary) has a model of words w after their left neighbour h; s is a word's stem, its first
``STEM`` characters, so that a stem speaks for forms that are rare or were never seen:

    P_c(w | h) = max(c_c(h, w) - D, 0) / c_c(h) + l_c(h) P_c(w)
    P_c(w)     = max(n_c(w) - D', 0) / N_c + l_c P_c(s) P(w | s)
    P_c(s)     = max(n_c(s) - D'', 0) / N_c + m_c P(s)
    P(s)       = n(s) / (N + 1)
    P(w | s)   = n(w) / (n(s) + 1)

c counts bigrams; n counts, as Kneser-Ney asks, different bigrams (a word's left neighbours), so a passage that is
copied a thousand times counts once there.  P, with the n of both classes, is what they share and what all that is
taken off the counts goes to: expressions that are rare in both classes hardly speak for either.  The ones in the
denominators are left for unknown words.  The discounts come from counts of counts, n1 / (n1 + 2 n2), for each class
and level.

What doesn't tell the classes apart is tied at all three levels (``LEVEL``, a limit of the log-likelihood ratio
statistic): both classes give it the probability of the level below, times what their other probabilities leave, so
all distributions still sum to 1.  The limit is the same however large the corpus is, and all that isn't tied is
used: a model of up to ``MODEL_ROWS`` rows a level is sent to the texts, a larger one stays in written tables that the
texts' bigrams are joined with.  Both ways give the same values.

The value of a text is its log-likelihood ratio divided by its number of words.  A long text thins out what a few of
its words say, so the largest mean ratio of ``SPAN`` neighbouring words is a second value.  A logistic curve, fitted on
training rows that gave no counts, gives the score: first of the value alone, then, with the value's weight as it is,
of what the span adds to it, so that the second can't take the first one's place.

Null and empty texts have values 0.  Rows with a null id are scored, and not held out.  Labels other than 0 and 1, and
null ones, are not used; of several labels of one id the largest counts.  If the rows for the curve lack a class, the
score is that of the values' sum and the prior odds of the counted rows; if these lack a class, the toxic share of
all labelled rows (0 without any) is the score of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm import words as W
from stratum.llm.shared import arrow_pass, numbered, picked, place, stored

#: Limit of the statistic (chi square with one degree of freedom, one in a million: it is asked of millions of counts).
LEVEL = 24.0
STEM = 4
#: Rows of a model that is sent to the texts at most, of bigrams, contexts, words and stems each: 16 bytes a row.
MODEL_ROWS = 1 << 21
#: Bigrams of which each makes up more than one in this number of all are joined by a broadcast: fewer than this number.
HOT_KEYS = 4096
SPAN = 2
THRESHOLD = 0.3
#: Labelled ids are sent to the texts up to this number, and joined with a shuffle beyond it.
BROADCAST_ROWS = 1_000_000
#: Bigrams that a task gathers before it passes on their counts.
HELD = 4_000_000
#: Bins of the two values (least, largest, width): what the curve is fitted on is of bounded size.
MEAN_BINS, SPAN_BINS = (-4.0, 4.0, 0.02), (-4.0, 12.0, 0.1)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def _read(texts: W.Texts) -> tuple[W.Spans, np.ndarray, np.ndarray]:
    """Words of a slice, their stems, and their left neighbours: 32 bits of the hash, 0 at the start of a text."""
    w = W.words(texts, W.ALNUM_WORDS)
    begins = np.flatnonzero((texts.data & 0xC0) != 0x80)  # of characters
    first = np.searchsorted(begins, w.start)
    end = np.minimum(w.end, begins[np.minimum(first + STEM, len(begins) - 1)])
    stem = W.hashes(texts.data, w.start, end) >> W.U(32)
    left = np.concatenate([np.zeros(1, W.U), w.hash[:-1]])[: len(w.hash)] >> W.U(32)
    if len(w.doc):
        left[np.concatenate([[True], w.doc[1:] != w.doc[:-1]])] = 0
    return w, stem, left


def _int(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint32).view(np.int32)


def _key(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """One number for a bigram."""
    return W.mix(word ^ W.mix(left + W.U(1)))


def bigrams(train: DataFrame) -> DataFrame:
    """(word, stem, left, t, o) of the rows (toxic, text): how often toxic and ordinary texts have each bigram."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            word, stem, left, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first, at = np.unique(_key(word, left), return_index=True, return_inverse=True)
            t = np.bincount(at, weights=toxic, minlength=len(first)).astype(np.int64)
            o = np.bincount(at, minlength=len(first)) - t
            yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(_int(stem[first])), pa.array(_int(left[first])), pa.array(t), pa.array(o)], ["word", "stem", "left", "t", "o"])

        for batch in batches:
            toxic = np.asarray(batch["toxic"]).astype(np.int8)
            for t in W.slices(batch["text"], lower=True):
                w, stem, left = _read(t)
                parts.append((w.hash, stem, left, toxic[w.doc + t.first]))
                held += len(w.hash)
                if held > HELD:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    rows = train.mapInArrow(each, "word bigint, stem int, left int, t bigint, o bigint")
    return rows.groupBy("word", "stem", "left").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


@dataclass
class Tables:
    """The same ratios as written tables: stems (stem, of_stem), words (word, of_word), contexts (left, of_left), bigrams (word, left, of_pair)."""

    stems: DataFrame
    words: DataFrame
    lefts: DataFrame
    pairs: DataFrame


@dataclass
class Model:
    """Log-likelihood ratios (keys ascending): of kept stems, kept words, contexts (what a context adds to a word's ratio), kept bigrams; the curve.

    A model that is too large to be sent has its ratios in ``tables``, and the arrays are empty."""

    stems: np.ndarray
    stem_values: np.ndarray

    words: np.ndarray
    word_values: np.ndarray
    lefts: np.ndarray
    left_values: np.ndarray
    pairs: np.ndarray
    pair_values: np.ndarray
    other: float
    weights: tuple[float, float] = (0.0, 0.0)
    offset: float = -50.0
    tables: Tables | None = None

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, out: np.ndarray) -> np.ndarray:
        if len(keys):
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            out = np.where(keys[at] == asked, values[at], out)
        return out

    def ratios(self, word: np.ndarray, stem: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log P_t(w | h) - log P_o(w | h) of words after their neighbours."""
        ratio = self._found(self.stems, self.stem_values, _int(stem), np.full(len(word), self.other))
        ratio = self._found(self.words, self.word_values, word.view(np.int64), ratio)
        ratio = ratio + self._found(self.lefts, self.left_values, _int(left), np.zeros(len(word)))
        return self._found(self.pairs, self.pair_values, _key(word, left).view(np.int64), ratio)

    def values(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean ratio of each text of a string column, and the largest mean of SPAN neighbouring words."""
        mean, most = np.zeros(len(column)), np.zeros(len(column))
        for t in W.slices(column, lower=True):
            w, stem, left = _read(t)
            if not len(w.doc):
                continue
            ratio = self.ratios(w.hash, stem, left)
            total = np.concatenate([[0.0], np.cumsum(ratio)])
            first = np.flatnonzero(np.concatenate([[True], w.doc[1:] != w.doc[:-1]]))
            n = np.diff(np.concatenate([first, [len(w.doc)]]))
            at = np.arange(len(w.doc))
            end = np.minimum(at + SPAN, np.repeat(first + n, n))
            means = (total[end] - total[:-1]) / SPAN
            means[(end - at < SPAN) & np.repeat(n >= SPAN, n)] = -np.inf  # whole spans, if there is one
            most[t.first + w.doc[first]] = np.maximum.reduceat(means, first)
            mean[t.first + w.doc[first]] = np.add.reduceat(ratio, first) / n
        return mean, most

    def score(self, mean: Column, most: Column) -> Column:
        at = self.weights[0] * mean + self.weights[1] * most + self.offset
        return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), at))))


def discount(n1: float, n2: float) -> float:
    """The discount for so many rows of count 1 and 2; one half where there are none."""
    return n1 / (n1 + 2 * n2) if n1 else 0.5


def _statistic(t: str, o: str, share: Column) -> Column:
    """Log-likelihood ratio statistic of counts t and o against a toxic share."""
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col(t) + F.col(o)) * p))).otherwise(0.0)
    return 2 * (part(t, share) + part(o, 1 - share))


def _table(rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    found = rows.toPandas().sort_values(key)  # MODEL_ROWS at most
    return found[key].to_numpy(), found[value].to_numpy(float)


def _hot_join(rows: DataFrame, table: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with the rows of ``table``, one a key at most.

    ``counts`` (keys, n) tells the rows of each key.  Keys of more than one in HOT_KEYS of all rows are joined by a
    broadcast, so that no task of the shuffled join meets more than that of one key."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = stored(counts.where(F.col("n") * HOT_KEYS > total).select(*keys).join(table, keys, "left").withColumn("hot", F.lit(True)))
    rows = rows.join(F.broadcast(hot), keys, "left")
    values = [c for c in table.columns if c not in keys]
    known = rows.where("hot").drop("hot")
    return known.unionByName(rows.where("hot IS NULL").drop("hot", *values).join(table, keys, "left"))


def _by_joins(rows: DataFrame, tables: Tables, other: float) -> DataFrame:
    """(carry, mean, most) of the rows (carry, text): their bigrams joined with the model's tables."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [(t.first + w.doc, w.hash.view(np.int64), _int(stem), _int(left)) for t in W.slices(batch["text"], lower=True) for w, stem, left in [_read(t)]]
        doc, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.cumsum(np.bincount(doc.astype(np.int64), minlength=batch.num_rows))
        ends = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch["row"], batch["carry"], *(pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns)], ["row", "carry", "word", "stem", "left"])

    kind = rows.schema["carry"].dataType.simpleString()
    # written once: later plans read the same row numbers
    read = stored(arrow_pass(rows.withColumn("row", F.monotonically_increasing_id()), each, f"row bigint, carry {kind}, word array<bigint>, stem array<int>, left array<int>"))
    tokens = read.select("row", F.posexplode(F.arrays_zip("word", "stem", "left")).alias("at", "b")).select("row", "at", "b.*")
    # each different bigram is looked up once
    asked = stored(tokens.groupBy("word", "stem", "left").agg(F.count(F.lit(1)).alias("n")))
    of = lambda key: asked.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = asked.join(tables.pairs, ["word", "left"], "left")
    for key, table in (("word", tables.words), ("stem", tables.stems), ("left", tables.lefts)):
        found = _hot_join(found, table, of(key), [key])
    ratio = F.coalesce("of_pair", F.coalesce("of_word", "of_stem", F.lit(other)) + F.coalesce("of_left", F.lit(0.0)))
    found = stored(found.select("word", "left", ratio.alias("ratio")))
    tokens = _hot_join(tokens.drop("stem"), found, asked.select("word", "left", "n"), ["word", "left"])
    # each word adds to the spans that begin at it and at those before it
    spans = tokens.select("row", "at", "ratio", F.explode(F.sequence(F.greatest(F.col("at") - SPAN + 1, F.lit(0)), "at")).alias("start"))
    spans = spans.groupBy("row", "start").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("at") == F.col("start"), F.col("ratio"))).alias("ratio"))
    whole = F.max(F.when(F.col("n") == SPAN, F.col("sum")))
    values = spans.groupBy("row").agg(F.avg("ratio").alias("mean"), (F.coalesce(whole, F.max("sum")) / SPAN).alias("most"))
    return read.select("row", "carry").join(values, "row", "left").select("carry", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("most", F.lit(0.0)).alias("most"))


def _values(rows: DataFrame, model: Model) -> DataFrame:
    """(carry, mean, most): both values of the texts of the rows (carry, text)."""
    if model.tables:
        return _by_joins(rows, model.tables, model.other)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        mean, most = sent.value.values(batch["text"])
        return pa.RecordBatch.from_arrays([batch["carry"], pa.array(mean), pa.array(most)], ["carry", "mean", "most"])

    return arrow_pass(rows, each, f"carry {rows.schema['carry'].dataType.simpleString()}, mean double, most double")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, base: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights of the columns of x and the offset of a logistic curve of them and of ``base``, by Newton's steps with a weak prior; no weight is negative."""
    used = np.arange(x.shape[1])
    while True:
        mean = np.average(x[:, used], axis=0, weights=weight)
        rows = np.column_stack([x[:, used] - mean, np.ones(len(x))])
        prior = np.array([0.01] * len(used) + [0.001])
        a = np.zeros(len(prior))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(rows @ a + base, -30, 30)))
            grad = rows.T @ (weight * (p - y)) + prior * a
            step = np.linalg.solve((rows * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows + np.diag(prior), grad)
            a = a - np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        if not len(used) or a[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[used], out[-1] = a[:-1], a[-1] - a[:-1] @ mean
            return out
        used = used[a[:-1] > 0]


def _binned(value: str, bins: tuple[float, float, float]) -> Column:
    return F.rint(F.greatest(F.lit(bins[0]), F.least(F.lit(bins[1]), F.col(value))) / bins[2]).cast("int").alias(value)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the models on labelled rows: counts from folds 0 and 1, the curve from fold 3, nothing from fold 2."""
    marks, c = numbered(labels), lambda name: f"c{place(labels, name)}"
    marks = marks.select(F.col(c(id_col)).alias("id"), F.col(c(label_col)).alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    marks = stored(marks.groupBy("id").agg(F.max("toxic").cast("tinyint").alias("toxic")).withColumn("fold", fold(F.col("id"))).where("fold <> 2"))
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    rows = picked(docs, id_col, text_col).join(marks, "id").select("fold", "toxic", "text")

    counts = stored(bigrams(rows.where("fold < 2").select("toxic", "text")))
    is_ = lambda c, k: F.sum((F.col(c) == k).cast("long"))
    top = counts.agg(F.sum("t"), F.sum("o"), is_("t", 1), is_("t", 2), is_("o", 1), is_("o", 2)).first()
    empty = [x for kind in (np.int32, np.int64, np.int32, np.int64) for x in (np.zeros(0, kind), np.zeros(0))]
    if not top[0] or not top[1]:
        share = marks.agg(F.avg("toxic")).first()[0] or 0.0
        return Model(*empty, 0.0, offset=float(np.clip(np.log(share / (1 - share)) if 0 < share < 1 else 50 * (2 * share - 1), -50, 50)))
    dt, do = discount(*top[2:4]), discount(*top[4:6])

    seen = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(c)
    all_words = stored(counts.groupBy("word", "stem").agg(seen("t"), seen("o")))
    all_stems = stored(all_words.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    facts = lambda rows: rows.agg(F.sum("t"), F.sum("o"), seen("t"), seen("o"), is_("t", 1), is_("t", 2), is_("o", 1), is_("o", 2)).first()
    of_words, of_stems = facts(all_words), facts(all_stems)
    nt, no = float(of_words[0]), float(of_words[1])
    over = lambda c, d: F.greatest(F.col(c) - d, F.lit(0.0))

    def smoothed(rows: DataFrame, fact, t: Column, o: Column) -> tuple[DataFrame, float, float]:
        """pt and po of rows that aren't tied, whose probabilities at the level below are t and o; what the others' are multiplied by."""
        dt, do = discount(*fact[4:6]), discount(*fact[6:8])
        rows = rows.withColumns({"bt": t, "bo": o})
        rows = stored(rows.withColumns({"pt": over("t", dt) / nt + dt * fact[2] / nt * F.col("bt"), "po": over("o", do) / no + do * fact[3] / no * F.col("bo")}))
        pt, po, bt, bo = (x or 0.0 for x in rows.agg(*(F.sum(c) for c in ("pt", "po", "bt", "bo"))).first())
        return rows, max(1e-9, 1 - pt) / max(1e-9, 1 - bt), max(1e-9, 1 - po) / max(1e-9, 1 - bo)

    apart = all_stems.where(_statistic("t", "o", F.lit(nt / (nt + no))) > LEVEL)
    part = (F.col("t") + F.col("o")) / (nt + no + 1)
    stems, mt, mo = smoothed(apart, of_stems, part, part)
    stems = stems.select("stem", F.col("pt").alias("st"), F.col("po").alias("so"))
    # a word or bigram is told apart from what its stem or word says already
    said = lambda t, o, a, b: a * F.col(t) / (a * F.col(t) + b * F.col(o))
    of_stem = all_stems.select("stem", (F.col("t") + F.col("o")).alias("n_stem"))

    def below(rows: DataFrame) -> DataFrame:
        """bt and bo, the probabilities at the stems' level, of words (word, stem, t, o)."""
        rows = rows.join(of_stem, "stem").join(stems, "stem", "left")
        in_stem, shared = (F.col("t") + F.col("o")) / (F.col("n_stem") + 1), F.col("n_stem") / (nt + no + 1)
        return rows.select("word", "stem", "t", "o", (F.coalesce("st", mt * shared) * in_stem).alias("bt"), (F.coalesce("so", mo * shared) * in_stem).alias("bo"))

    apart = all_words.join(stems, "stem", "left").where(_statistic("t", "o", F.coalesce(said("st", "so", nt, no), F.lit(nt / (nt + no)))) > LEVEL)
    words, lt, lo = smoothed(below(apart.select("word", "stem", "t", "o")), of_words, F.col("bt"), F.col("bo"))
    words = words.select("word", "pt", "po")
    share = F.coalesce(said("pt", "po", *map(float, top[:2])), said("st", "so", *map(float, top[:2])), F.lit(top[0] / (top[0] + top[1])))
    apart = counts.join(words, "word", "left").join(stems, "stem", "left").where(_statistic("t", "o", share) > LEVEL)
    apart = stored(apart.select("word", "left", "t", "o"))
    context = counts.join(apart.select("left").distinct(), "left", "left_semi").groupBy("left").agg(F.sum("t").alias("ht"), F.sum("o").alias("ho"), seen("t").alias("vt"), seen("o").alias("vo"))
    back = below(all_words.join(apart.select("word").distinct(), "word", "left_semi")).join(words, "word", "left")
    back = back.select("word", F.coalesce("pt", lt * F.col("bt")).alias("bt"), F.coalesce("po", lo * F.col("bo")).alias("bo"))
    after = lambda c, d: F.when(F.col(f"h{c}") > 0, (over(c, d) + d * F.col(f"v{c}") * F.col(f"b{c}")) / F.col(f"h{c}")).otherwise(F.col(f"b{c}"))
    pairs = stored(apart.join(context, "left").join(back, "word").select("word", "left", after("t", dt).alias("pt"), after("o", do).alias("po"), "bt", "bo"))
    rest = lambda c: F.greatest(1 - F.sum(f"p{c}"), F.lit(1e-9)) / F.greatest(1 - F.sum(f"b{c}"), F.lit(1e-9))
    ratio = lambda a, b, name, more=0.0: (F.log(F.col(a) / F.col(b)) + more).alias(name)
    tables = Tables(
        stored(stems.select("stem", ratio("st", "so", "of_stem", float(np.log(lt / lo))))),
        stored(words.select("word", ratio("pt", "po", "of_word"))),
        stored(pairs.groupBy("left").agg(F.log(rest("t") / rest("o")).alias("of_left"))),
        stored(pairs.select("word", "left", ratio("pt", "po", "of_pair"))),
    )
    other = float(np.log(lt * mt / (lo * mo)))
    if max(t.count() for t in (tables.stems, tables.words, tables.lefts, tables.pairs)) > MODEL_ROWS:
        model = Model(*empty, other, tables=tables)
    else:
        found = tables.pairs.toPandas()  # MODEL_ROWS at most
        key = _key(found["word"].to_numpy(np.int64).view(W.U), found["left"].to_numpy(np.int32).view(np.uint32).astype(W.U)).view(np.int64)
        order = np.argsort(key)
        of_pairs = key[order], found["of_pair"].to_numpy(float)[order]
        model = Model(*_table(tables.stems, "stem", "of_stem"), *_table(tables.words, "word", "of_word"), *_table(tables.lefts, "left", "of_left"), *of_pairs, other)

    found = _values(rows.where("fold = 3").select(F.col("toxic").alias("carry"), "text"), model)
    bins = found.groupBy(_binned("mean", MEAN_BINS), _binned("most", SPAN_BINS), F.col("carry").alias("toxic")).count().toPandas()
    if bins["toxic"].nunique() == 2:
        mean, most = bins["mean"].to_numpy(float)[:, None] * MEAN_BINS[2], bins["most"].to_numpy(float)[:, None] * SPAN_BINS[2]
        given = bins["toxic"].to_numpy(float), bins["count"].to_numpy(float)
        of_mean, _ = _logistic(mean, *given)
        of_most, offset = _logistic(most, *given, base=of_mean * mean[:, 0])
        model.weights, model.offset = (float(of_mean), float(of_most)), float(offset)
    else:
        toxic, all_ = marks.where("fold < 2").agg(F.sum("toxic"), F.count(F.lit(1))).first()
        model.weights, model.offset = (1.0, 1.0), float(np.log((toxic + 0.5) / (all_ - toxic + 0.5)))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: its id and ``score``."""
    found = _values(picked(docs, id_col, text_col).withColumnRenamed("id", "carry"), model)
    return found.select(F.col("carry").alias(id_col), model.score(F.col("mean"), F.col("most")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, train(docs, labels))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
