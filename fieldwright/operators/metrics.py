"""Scores of produced fields against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdicts(truth: DataFrame, produced: DataFrame) -> DataFrame:
    """truth (doc, key, value, critical) with produced (doc, key, value, review): EXACT, WRONG, EMPTY, FABRICATED, REVIEW or NA.

    A blank truth means that the field is not on the document: a value there is fabricated.
    """
    rows = truth.join(produced.select("doc", "key", F.col("value").alias("got"), "review"), ["doc", "key"], "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    verdict = F.when(blank(F.col("value")) & blank(F.col("got")), "NA").when(blank(F.col("value")), "FABRICATED").when(blank(F.col("got")), "EMPTY").when(F.coalesce("review", F.lit(False)), "REVIEW")
    return rows.withColumn("verdict", verdict.when(F.lower(F.trim("got")) == F.lower(F.trim("value")), "EXACT").otherwise("WRONG"))


def acceptance(judged: DataFrame, by: str = "doc") -> DataFrame:
    """Counts of critical verdicts and their rates, 0 where nothing is critical; production_ready by the fixed thresholds."""
    of = lambda v: F.count_if(F.col("critical") & (F.col("verdict") == v))
    rows = judged.groupBy(by).agg(F.count_if(F.col("critical") & (F.col("verdict") != "NA")).alias("critical_total"), of("EXACT").alias("exact"), of("WRONG").alias("wrong"), of("EMPTY").alias("empty"), of("FABRICATED").alias("fabricated"), of("REVIEW").alias("reviewed"))
    rate = F.when(F.col("critical_total") == 0, 0.0).otherwise(F.col("exact") / F.col("critical_total"))
    ready = (F.col("fabricated") == 0) & (F.col("wrong") == 0) & (rate >= 0.95) & ~((F.col("critical_total") > 0) & (F.col("empty") == F.col("critical_total")))
    return rows.withColumn("exact_rate", rate).withColumn("production_ready", ready)
