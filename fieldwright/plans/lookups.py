"""Queries on readings of places and offices that may be misspelt, with SQL.

Words of the given texts in Cyrillic letters stand for readings and registries: the words of benchmark texts are the registry, the last words of turns the
readings. SQL has the weighted distance as a fold over letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.operators import fuzzy
from fieldwright.plans.register import query
from fieldwright.sources.tables import parquet

#: Latin letters and the Cyrillic ones that stand for them here.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдеєгиіїклмнопщрстувшчйю"
#: Settlement types before a reading, by the length of its turn.
PREFIXES = ("м. ", "смт ", "с. ", "", "селище міського типу ")

_WORD_SQL = f"translate(w, '{LATIN}', '{CYRILLIC}')"
#: Readings (id, role, n, latin, term): the last word of four letters or more of each turn, null if it has none. Registry (latin, key, items, ordinal).
_TABLES_SQL = f"""
t AS (
  SELECT conv_id * 1000 + turn AS id, role, length(text) AS n, regexp_extract_all(lower(text), '[a-z]{{4,}}')[-1] AS w FROM conversations
), readings AS (
  SELECT id, role, n, {_WORD_SQL} AS term FROM t
), registry AS (
  SELECT w AS latin, {_WORD_SQL} AS key, count(DISTINCT item_id) AS items, min(item_id) AS ordinal
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM benchmark) GROUP BY w
)"""
#: Letters that are taken for each other, each way.
_PAIRS_SQL = "['тп','пт','ин','ни','шт','тш','шщ','щш','еє','єе','ий','йи','ла','ал','ос','со','рг','гр','цщ','щц','вб','бв','мш','шм','нп','пн','іи','иі','їі','ії','уч','чу','дл','лд','кн','нк']"


def _weighted_sql(a: str, b: str) -> str:
    """The weighted distance in fifths: rows of the table of costs, folded over the letters of a, each folded over those of b."""
    cost = f"CASE WHEN {a}[i] = {b}[j] THEN 0 WHEN list_contains({_PAIRS_SQL}, {a}[i] || {b}[j]) THEN 2 ELSE 5 END"
    row = f"list_reduce(range(1, length({b}) + 1), lambda now, j: list_append(now, least(now[-1] + 5, above[j + 1] + 5, above[j] + {cost})), [5 * i])"
    return f"list_reduce(range(1, length({a}) + 1), lambda above, i: {row}, range(0, 5 * length({b}) + 1, 5))[-1]"


def cyrillic(word: Column) -> Column:
    return F.translate(word, LATIN, CYRILLIC)


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.try_element_at(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})")), F.lit(-1))
    return parquet(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.length("text").alias("n"), cyrillic(word).alias("term"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = parquet(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"))).alias("latin"))
    return words.groupBy("latin").agg(F.countDistinct("item_id").alias("items"), F.min("item_id").alias("ordinal")).withColumn("key", cyrillic(F.col("latin")))


@query(f"""
WITH {_TABLES_SQL}, misses AS (
  SELECT id AS lookup_id, CASE WHEN role = 'user' THEN 'settlement' WHEN n < 150 THEN 'authority' ELSE 'oblast' END AS category, term FROM readings
), reg AS (
  SELECT CASE WHEN items > 1 THEN 'settlement' ELSE 'oblast' END AS category, key, latin, ordinal FROM registry
), p AS (
  SELECT m.category, term, key, latin, ordinal FROM (SELECT DISTINCT category, term FROM misses WHERE category <> 'authority' AND term <> '') m JOIN reg ON reg.category = m.category AND abs(length(term) - length(key)) <= 0.5 * greatest(length(term), length(key))
), s AS (
  SELECT category, term, latin, ordinal, {_weighted_sql("term", "key")} / 5.0 / greatest(length(term), length(key)) AS share FROM p
), b AS (
  SELECT category, term, min(share) AS share, first(latin ORDER BY share, ordinal, latin) AS official, string_agg(latin, ',' ORDER BY share, ordinal, latin) AS candidates
  FROM s WHERE share <= 0.5 + 1e-9 GROUP BY ALL HAVING min(share) <= 0.34 + 1e-9
)
SELECT lookup_id, official, CASE WHEN official IS NULL THEN 0 ELSE round(greatest(0.4, 0.9 - share), 6) END::DOUBLE AS confidence, official IS NOT NULL AS matched, coalesce(candidates, '') AS candidates FROM misses LEFT JOIN b USING (category, term)
""")
def fuzzy_registry_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("role") == "user", "settlement").when(F.col("n") < 150, "authority").otherwise("oblast")
    misses = _readings(spark, sf_dir).select(F.col("id").alias("lookup_id"), category.alias("category"), "term")
    none = F.lit(None).cast("string")
    registry = _registry(spark, sf_dir).select(F.when(F.col("items") > 1, "settlement").otherwise("oblast").alias("category"), F.col("key").alias("key_uk"), none.alias("key_ru"), F.array().cast("array<string>").alias("aliases"), F.col("latin").alias("official_en"), "ordinal")
    return fuzzy.fuzzy_registry(misses, registry).withColumn("candidates", F.array_join("candidates", ","))


_SNAP_SQL = f"""
pairs AS (
  SELECT term, key, ordinal, {_weighted_sql("term", "key")} / 5.0 AS d FROM (SELECT DISTINCT term FROM names WHERE term <> '' AND term NOT IN (SELECT key FROM registry)) JOIN registry ON abs(length(term) - length(key)) <= 2
), near AS (
  SELECT term, d, key FROM pairs WHERE d <= 2 AND d <= 0.34 * greatest(length(term), length(key)) + 1e-9 QUALIFY row_number() OVER (PARTITION BY term ORDER BY d, ordinal, key) = 1
)"""


@query(f"""
WITH {_TABLES_SQL}, names AS (
  SELECT DISTINCT page_id AS id, translate(regexp_extract(split_part(lower(url), '://', 2), '^[^.:/?#]*'), '{LATIN}', '{CYRILLIC}') AS term FROM pages
), {_SNAP_SQL}
SELECT id, term AS name, CASE WHEN term = '' THEN 'empty' WHEN registry.key IS NOT NULL THEN 'exact' WHEN d IS NOT NULL THEN 'fuzzy_geography_match' ELSE 'unknown_geography' END AS reason, near.key AS suggested, CASE WHEN registry.key IS NOT NULL THEN 0 ELSE d END::DOUBLE AS distance
FROM names LEFT JOIN near USING (term) LEFT JOIN registry ON registry.key = term
""")
def weighted_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First labels of hosts as readings of places."""
    label = cyrillic(F.regexp_extract(F.lower("url"), "://([^.:/?#]*)", 1))
    out = fuzzy.snapped(parquet(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), label.alias("name")), _registry(spark, sf_dir).select(F.col("key").alias("entry"), "ordinal"))
    return out.select("id", "name", "reason", "suggested", F.col("distance").cast("double").alias("distance"))


@query(f"""
WITH {_TABLES_SQL}, names AS (
  SELECT id, CASE WHEN term IS NULL THEN '' ELSE {list(PREFIXES)}[n % 5 + 1] || term END AS name, coalesce(term, '') AS term FROM readings
), {_SNAP_SQL}
SELECT id, name, CASE WHEN term = '' THEN NULL ELSE term END AS value, CASE WHEN term = '' THEN 'knowledge' WHEN registry.key IS NOT NULL THEN 'gazetteer' ELSE 'passthrough' END AS source,
  term <> '' AND registry.key IS NULL AS review, near.key AS suggested
FROM names LEFT JOIN near USING (term) LEFT JOIN registry ON registry.key = term
""")
def city_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("n") % 5 + 1).cast("int"))
    names = _readings(spark, sf_dir).select("id", F.coalesce(F.concat(prefix, "term"), F.lit("")).alias("name"))
    return fuzzy.cities(names, _registry(spark, sf_dir).select(F.col("key").alias("entry"), "ordinal"))


@query(f"""
WITH {_TABLES_SQL}, reg AS (
  SELECT *, CASE WHEN items > 2 THEN 'civil_registry_term' ELSE 'authority' END AS category, CASE WHEN length(latin) > 6 THEN DATE '2013-01-01' END AS since FROM registry
), n AS (
  SELECT id, term, CASE WHEN role = 'user' THEN DATE '2000-01-01' + (n * 10)::INTEGER END AS day FROM readings
)
SELECT id, term AS name, coalesce(latin, term) AS value, CASE WHEN latin IS NULL THEN 'passthrough' ELSE 'knowledge' END AS source, coalesce(day < since, false) AS review FROM n LEFT JOIN reg ON key = term
""")
def authority_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    registry = _registry(spark, sf_dir).select(
        F.when(F.col("items") > 2, "civil_registry_term").otherwise("authority").alias("category"), F.col("key").alias("key_uk"), none.alias("key_ru"), F.array().cast("array<string>").alias("aliases"), F.col("latin").alias("official_en"),
        F.when(F.length("latin") > 6, F.lit("2013-01-01").cast("date")).alias("valid_from"), none.cast("date").alias("valid_until"), F.lit("high").alias("confidence_rule"), none.alias("review_rule"), "ordinal",
    )
    at = F.when(F.col("role") == "user", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("n") * 10).cast("int")))
    return fuzzy.authorities(_readings(spark, sf_dir).select("id", F.col("term").alias("name"), at.alias("at")), registry)
