"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header of the term registry, in order.
REGISTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("category", "key_uk", "key_ru", "official_en", "aliases", "valid_from", "valid_until", "source_url", "source_authority", "source_act", "confidence_rule", "review_rule", "warning", "notes")])


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by key over as many tasks as a shuffle has: a file of one row group is one task otherwise, however much is made of each of its rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry from CSV with quotes and doubled quotes; aliases become an array, dates dates. A header that differs is an error."""
    rows = spark.read.csv(path, schema=REGISTRY, header=True, quote='"', escape='"', multiLine=True, enforceSchema=False)
    aliases = F.when(F.coalesce("aliases", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("aliases", r"\|"))
    return rows.withColumn("aliases", aliases).withColumn("valid_from", F.try_to_date("valid_from")).withColumn("valid_until", F.try_to_date("valid_until"))


def registry_violations(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Rows of the registry with the rules they break: unknown category, no source, a date that is none or not of the shape YYYY-MM-DD, or an interval that ends before it begins."""
    day = lambda c: F.col(c).try_cast("date")
    bad = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (~F.col(c).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$") | day(c).isNull())
    broken = F.array_compact(F.array(
        F.when(~F.col("category").isin(categories) | F.col("category").isNull(), F.lit("category")),
        F.when(F.trim(F.coalesce("source_url", F.lit(""))) == "", F.lit("source_url")),
        F.when(bad("valid_from"), F.lit("valid_from")),
        F.when(bad("valid_until"), F.lit("valid_until")),
        F.when(day("valid_from") > day("valid_until"), F.lit("interval")),
    ))
    return rows.withColumn("violations", broken).where(F.size("violations") > 0)


def page_links(pages: DataFrame, most: int | None = 50) -> DataFrame:
    """Rows (page_id, position, link): a page's distinct links in order of first appearance, ``most`` of them at most, all for None."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"#]+)"'), F.lit(1)))
    return pages.select("page_id", F.posexplode(links if most is None else F.slice(links, 1, most)).alias("position", "link"))


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The rows to append so that each key is stored once: of an incoming key's rows the first by arrival."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), F.col("arrival")).alias("row")).select("row.*")
    return first.join(existing.select(key), key, "left_anti")


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of files, which is never rewritten."""
    rows.write.mode("append").parquet(path)


def upserted(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Both tables' rows, the incoming one where a key is in both; of an incoming key's rows the greatest by their columns counts."""
    one = incoming.groupBy(key).agg(F.max(F.struct(*[c for c in incoming.columns if c != key])).alias("r")).select(key, "r.*").select(*incoming.columns)
    return existing.join(one.select(key), key, "left_anti").unionByName(one)
