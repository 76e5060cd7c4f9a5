"""Views of the given tables as inputs of the operators.

Sources, keys and flags are derived from ids by fixed arithmetic, so that every row takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.operators.resolve import AUTHORITY
from fieldwright.operators.timing import TRANSITIONS
from fieldwright.sources.tables import parquet

#: Statuses in order of first mention.
STATUSES = tuple(dict.fromkeys(s for pair in TRANSITIONS for s in pair))


def pick(names: tuple[str, ...], number) -> object:
    return F.element_at(F.array(*map(F.lit, names)), (number + 1).cast("int"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as candidates: a user's event type is a field, each event a reading."""
    i = F.col("event_id")
    return parquet(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc"), F.col("event_type").alias("key"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.when(i % 2 == 0, " V").otherwise("v"), (i % 4).cast("string"))).alias("value"),
        pick(AUTHORITY, i % 9).alias("source"), F.when(i % 13 != 0, (i % 100) / 100.0).alias("confidence"), i.alias("ordinal"), (i % 17 == 0).alias("review_required"),
    )


CANDIDATES_SQL = f"""
cand AS (
  SELECT user_id AS doc, event_type AS key,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE (CASE WHEN event_id % 2 = 0 THEN ' V' ELSE 'v' END) || (event_id % 4)::VARCHAR END AS value,
    [{", ".join(f"'{a}'" for a in AUTHORITY)}][event_id % 9 + 1] AS source, event_id % 9 AS authority,
    CASE WHEN event_id % 13 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END AS confidence, event_id AS ordinal, event_id % 17 = 0 AS review_required
  FROM events
)"""


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return parquet(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("key"), i.alias("version"), F.when(i % 5 != 0, F.concat(F.lit("x"), (i % 7).cast("string"))).alias("value"), (i % 3 != 0).alias("confirmed"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldwright.operators.timing import call_cost

    i = F.col("event_id")
    rows = parquet(spark, sf_dir, "events").select(
        F.col("user_id").alias("upload"), i.alias("id"), F.col("ts").alias("at"), pick(("google_vision", "google_docai", "gemini", "deepseek", "other"), i % 5).alias("provider"),
        F.when(i % 2 == 0, "Reasoner").otherwise("chat").alias("model"), pick(("cache_hit", "waited_cache_hit", "provider_winner", "unavailable"), i % 4).alias("outcome"),
    )
    return rows.withColumn("cost", call_cost(F.col("provider"), F.col("model")))


CALLS_SQL = """
c0 AS (
  SELECT user_id AS upload, event_id AS id, ts AS "at", ['google_vision','google_docai','gemini','deepseek','other'][event_id % 5 + 1] AS provider,
    CASE WHEN event_id % 2 = 0 THEN 'Reasoner' ELSE 'chat' END AS model, ['cache_hit','waited_cache_hit','provider_winner','unavailable'][event_id % 4 + 1] AS outcome
  FROM events
), calls AS (
  SELECT *, (CASE WHEN provider = 'deepseek' AND model = 'Reasoner' THEN 8000 WHEN provider = 'deepseek' THEN 4000 WHEN provider LIKE 'google%' THEN 1500 WHEN provider = 'gemini' THEN 2000 ELSE 0 END)::BIGINT AS cost FROM c0
)"""


def truth_and_produced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as fields of orders: the true value is the ship mode-like flag pair, the produced one is altered by line number."""
    o = parquet(spark, sf_dir, "lineitem")
    key = F.col("l_linenumber").cast("string")
    truth = o.select(F.col("l_orderkey").alias("doc"), key.alias("key"), F.when(F.col("l_partkey") % 10 == 0, "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("value"), (F.col("l_linenumber") <= 3).alias("critical"))
    got = F.when(F.col("l_suppkey") % 9 == 0, "").when(F.col("l_suppkey") % 7 == 0, "zz").otherwise(F.lower(F.concat("l_returnflag", "l_linestatus")))
    produced = o.where(F.col("l_suppkey") % 11 != 0).select(F.col("l_orderkey").alias("doc"), key.alias("key"), got.alias("value"), (F.col("l_suppkey") % 5 == 0).alias("review"))
    return truth, produced


VERDICTS_SQL = """
t AS (
  SELECT l_orderkey AS doc, l_linenumber::VARCHAR AS key, CASE WHEN l_partkey % 10 = 0 THEN '' ELSE l_returnflag || l_linestatus END AS value, l_linenumber <= 3 AS critical FROM lineitem
), p AS (
  SELECT l_orderkey AS doc, l_linenumber::VARCHAR AS key, CASE WHEN l_suppkey % 9 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN 'zz' ELSE lower(l_returnflag || l_linestatus) END AS got, l_suppkey % 5 = 0 AS review
  FROM lineitem WHERE l_suppkey % 11 <> 0
), j AS (
  SELECT t.*, CASE WHEN trim(value) = '' AND trim(coalesce(got, '')) = '' THEN 'NA' WHEN trim(value) = '' THEN 'FABRICATED' WHEN trim(coalesce(got, '')) = '' THEN 'EMPTY'
    WHEN coalesce(review, false) THEN 'REVIEW' WHEN lower(trim(got)) = lower(trim(value)) THEN 'EXACT' ELSE 'WRONG' END AS verdict
  FROM t LEFT JOIN p USING (doc, key)
)"""
