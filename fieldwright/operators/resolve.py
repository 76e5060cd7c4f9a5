"""Resolution of conflicting readings: candidates (doc, key, value, source, confidence, ordinal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwright.operators.shaping import blank

#: Sources by authority, the least first.
AUTHORITY = ("manual_user_entry", "ai_vision", "document_ocr", "driver_license", "ead", "i94", "gov_ua", "passport_visual", "mrz")
#: Confidence below which a critical field goes to review.
LOW_CONFIDENCE = 0.85


def authority(source: Column) -> Column:
    """Rank of a source; unknown sources rank lowest."""
    return F.greatest(F.array_position(F.array(*map(F.lit, AUTHORITY)), source) - 1, F.lit(0)).cast("int")


def arbitrate(candidates: DataFrame) -> DataFrame:
    """One row per (doc, key): the candidate of highest authority, then confidence, then input order.

    Blank values do not count. conflict: more than one distinct value but for case and outer white space;
    review: conflict, or a winner of low confidence.
    """
    usable = candidates.where(~blank(F.col("value")))
    rank = F.struct(authority(F.col("source")).alias("a"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("ordinal")).alias("o"))
    best = usable.groupBy("doc", "key").agg(
        F.max_by(F.struct("value", "source", "confidence"), rank).alias("w"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_distinct(F.lower(F.trim("value"))).alias("n_distinct"),
    )
    conflict = F.col("n_distinct") > 1
    return best.select("doc", "key", "w.value", "w.source", "w.confidence", "n_candidates", "n_distinct", conflict.alias("conflict"), (conflict | (F.coalesce("w.confidence", F.lit(0.0)) < LOW_CONFIDENCE)).alias("review"))


def arbitrate_by_class(candidates: DataFrame, priorities: DataFrame) -> DataFrame:
    """One row per (doc, key) by a priority table (key, source, priority): lowest priority, default 99, then confidence, then input order."""
    rows = candidates.join(priorities, ["key", "source"], "left").withColumn("priority", F.coalesce("priority", F.lit(99)))
    order = Window.partitionBy("doc", "key").orderBy("priority", F.coalesce("confidence", F.lit(0.0)).desc(), "ordinal")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc", "key", "value", "source", "priority")


def contradictions(candidates: DataFrame) -> DataFrame:
    """(doc, key) with more than one normalized value: their number, and the values in order of authority, the first source of each."""
    rows = candidates.withColumn("norm", F.lower(F.trim("value"))).where("norm <> ''")
    each = rows.groupBy("doc", "key", "norm").agg(F.min(F.struct((-authority(F.col("source"))).alias("r"), "ordinal")).alias("b"))
    by_key = each.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n_values"), F.array_sort(F.collect_list(F.struct("b", "norm"))).alias("v"))
    return by_key.where("n_values > 1").select("doc", "key", "n_values", F.array_join(F.col("v.norm"), "|").alias("ranked_values"))


def merge_evidence(candidates: DataFrame) -> DataFrame:
    """(doc, key): evidence united, review if any reading asks for it, confidence the least present layer."""
    return candidates.groupBy("doc", "key").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("value")), ",").alias("readings"),
        F.bool_or("review_required").alias("review_required"),
        F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"),
    )


def component_consensus(dates: DataFrame) -> DataFrame:
    """(doc): year, month and day, each only where all readings agree on it."""
    # the least is the greatest if all agree; distinct counts would have each reading shuffled once for each part
    agreed = lambda c: F.when(F.min(c) == F.max(c), F.max(c)).alias(c)
    return dates.groupBy("doc").agg(agreed("year"), agreed("month"), agreed("day"), F.count(F.lit(1)).alias("n_readings"))


def role_guard(dates: DataFrame) -> DataFrame:
    """(doc, role, value) with the finding that another role of the document has the same value."""
    shared = F.size(F.collect_set("role").over(Window.partitionBy("doc", "value"))) > 1
    return dates.withColumn("shared", shared)


def identity_anchor(readings: DataFrame) -> DataFrame:
    """(doc, key): the value of the least priority, first by order; conflict if usable readings differ."""
    return readings.groupBy("doc", "key").agg(F.min_by("value", F.struct("priority", "ordinal")).alias("anchor"), (F.count_distinct("value") > 1).alias("conflict"), F.count(F.lit(1)).alias("n"))
