"""Records from what models answer about tiles: payloads, overlaps, a limit a tile, and a record for tiles without candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import geo, text
from stratum.operators import candidates as C

#: Overlap from which two boxes of a tile are one candidate, and candidates that a tile may have (fixed values).
SAME, MOST = 0.75, 3
#: Fields that models misspell (fixed values).
ALIASES = {"candidate_type": "_candidate_type", "visual_evidence": "visual__evidence", "possible_false_positive": "possible_false_position"}


def _field(payload: Column, name: str, kind: str) -> Column:
    """A field by its name, or by its other name where the payload hasn't the first at all; NULL if it is of no such kind."""
    out = F.try_variant_get(payload, f"$.{name}", kind)
    if name not in ALIASES:
        return out
    missing = F.try_variant_get(payload, f"$.{name}", "variant").isNull()
    return F.when(missing, F.try_variant_get(payload, f"$.{ALIASES[name]}", kind)).otherwise(out)


def _true(payload: Column) -> Column:
    """Whether ``candidate`` counts as true: true, a number but 0, a text that isn't empty."""
    value = F.try_variant_get(payload, "$.candidate", "variant")
    kind = F.schema_of_variant(value)
    told = F.when(kind == "BOOLEAN", F.try_variant_get(payload, "$.candidate", "boolean")).when(kind == "STRING", F.try_variant_get(payload, "$.candidate", "string") != "")
    return F.coalesce(told.otherwise(F.try_variant_get(payload, "$.candidate", "double") != 0), F.lit(False))


def payloads(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """A row for each payload of an answer (a JSON object): ``ord`` from 0 and ``payload``.

    Items of ``candidates`` that are objects and not ``candidate: false`` are candidates; without such a list the answer is
    itself the payload. Answers with none, or that are no object, have one row with a NULL payload."""
    parsed = answers.withColumn("__v", F.try_parse_json(answer))
    listed = F.try_variant_get("__v", "$.candidates", "array<variant>")
    is_list = F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.candidates", "variant")).startswith("ARRAY"), F.lit(False))
    parsed = parsed.withColumns({"__list": F.coalesce(listed, F.array().cast("array<variant>")), "__is_list": is_list})
    rows = parsed.select("*", F.posexplode_outer(F.when(F.col("__is_list"), F.col("__list")).otherwise(F.array("__v"))).alias("ord", "payload"))
    is_object = F.coalesce(F.schema_of_variant("payload").startswith("OBJECT"), F.lit(False))
    refused = F.coalesce(F.try_variant_get("payload", "$.candidate", "variant").isNotNull() & (F.schema_of_variant(F.try_variant_get("payload", "$.candidate", "variant")) == "BOOLEAN") & ~_true(F.col("payload")), F.lit(False))
    good = is_object & ~(F.col("__is_list") & refused)
    rows = rows.withColumn("payload", F.when(good, F.col("payload")))
    return rows.withColumn("candidate", F.col("payload").isNotNull() & (F.col("__is_list") | _true(F.col("payload")))).drop("__v", "__list", "__is_list")


def records(answers: DataFrame, tile: str, width: int, height: int, answer: str = "answer", most: int = MOST, same: float = SAME) -> DataFrame:
    """Records of tiles (one answer each): up to ``most`` candidates, best first, none of which overlaps a better one by ``same``.

    Tiles without any have one record with index and count 0: their first candidate without a usable box, as a warning, or
    an empty one. Ties go to the candidate named first."""
    rows = payloads(answers.select(tile, answer), answer)
    field = lambda name, kind: _field(F.col("payload"), name, kind)
    rows = rows.withColumn("__b", F.when(F.col("candidate"), geo.clamped_box(field("bbox_xyxy", "array<double>"), width, height)))
    found = F.col("__b").isNotNull()
    share = F.coalesce(text.number(field("confidence", "string")), F.lit(0.0))
    rows = rows.select(
        tile, F.coalesce("ord", F.lit(0)).alias("ord"), found.alias("candidate"), F.when(found, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("conf"),
        F.when(found, text.clamp_type(field("candidate_type", "string"), found)).otherwise("none").alias("candidate_type"), text.clamp_check(field("recommended_check", "string")).alias("recommended_check"),
        F.coalesce(field("visual_evidence", "string"), F.lit("")).alias("visual_evidence"), F.coalesce(field("possible_false_positive", "string"), F.lit("")).alias("possible_false_positive"),
        F.when(F.col("candidate") & ~found, "warning").otherwise("ok").alias("status"), *(F.get("__b", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))),
    )
    best = C.top_n(C.suppress(rows.where("candidate"), tile, same), tile, [F.desc("conf"), F.asc("ord")], most, "candidate_index")
    best = best.withColumn("candidate_count", F.count(F.lit(1)).over(Window.partitionBy(tile)).cast("int"))
    rest = [c for c in rows.columns if c != tile]
    other = rows.groupBy(tile).agg(F.count_if("candidate").alias("__n"), F.min_by(F.struct(*rest), F.struct(F.col("status") != "warning", "ord")).alias("r")).where("__n = 0")
    other = other.select(tile, *(f"r.{c}" for c in rest), F.lit(0).alias("candidate_index"), F.lit(0).alias("candidate_count"))
    return best.unionByName(other)
