"""URL filter: host and path rules, and a logistic regression on hashed character n-grams; Spark's JVM only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm.common import ascii_lower

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Lengths of the n-grams, and the number of hash cells.
GRAMS = (3, 4)
CELLS = 1 << 18

#: The small labelled table: hosts and paths of invented sites, unwanted and wanted ones; none is taken from a table that is judged.
UNWANTED = (
    "royal-casino.test/fr/1", "www.poker-casino.test/de/2", "diet-pills.test/es/3", "m.discount-pills.test/en/4", "sports-bets.test/fr/5", "www.betting-tips.test/de/6", "bulk-spam.test/es/7",
    "spam-host.test/en/8", "pop-up-ads.test/fr/9", "www.banner-ads.test/de/10", "adult-movies.test/es/11", "m.adult-dating.test/en/12", "win-prizes.test/fr/13", "replica-watches.test/de/14",
    "cheap-loans.test/es/15", "payday-loans.test/en/16", "free-coins.test/fr/17", "click-track.test/de/18", "hot-singles.test/es/19", "miracle-cure.test/en/20", "www.cheap-software.test/fr/21",
    "free-ringtones.test/de/22", "slots-casino.test/es/23", "weight-loss-pills.test/en/24", "xxx-adult.test/fr/25", "free-spins-bets.test/de/26", "farm-links.test/es/27", "track-pixel.test/en/28",
    "casino-lucky.test/en/70", "m.casino-jackpot.test/fr/71", "bets-king.test/de/72", "www.bets-daily.test/es/73", "ads-server.test/en/74", "m.ads-click.test/fr/75", "adult-zone.test/de/76", "www.adult-chat.test/es/77", "pills-direct.test/en/78", "spam-king.test/fr/79", "lucky-casino.test/de/80", "ads-popup.test/es/81", "bets-live.test/en/82", "casino-slots.test/fr/83",
)
WANTED = (
    "library.test/en/26", "www.university.test/fr/27", "news.test/de/28", "docs.python.test/en/29", "weather.test/es/30", "museum.test/en/31", "blog.garden.test/en/32", "recipes.test/fr/33", "m.travel.test/de/34",
    "www.history.test/en/35", "health.test/en/36", "science.test/es/37", "forum.music.test/en/38", "parliament.test/fr/39", "cathedral.test/de/40", "www.station.test/en/41", "nation-times.test/de/42",
    "mountain-club.test/es/43", "weather-north.test/fr/44", "m.education.test/en/45", "translation.test/de/46", "www.river-county.test/en/47", "rhythm.test/es/48", "m.mathematics.test/fr/49", "blog.lighthouse.test/en/50",
    "www.hospital.test/de/51", "attention.test/en/52", "m.smithson.test/es/53", "theatre.test/fr/54", "blog.motion.test/en/55", "archive.test/en/56", "www.village-hall.test/fr/57", "chemistry.test/de/58", "orchestra.test/es/59",
    "gardening-tips.test/en/60", "sports-club.test/en/61", "software-manual.test/en/62", "movies-review.test/en/63", "host-family.test/de/64", "farmers-market.test/en/65",
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_struct(host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = (F.concat(F.lit("."), host).endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(text: Column, n: int) -> Column:
    count = F.length(text) - (n - 1)
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: text.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def features(rows: DataFrame) -> DataFrame:
    """Adds _features: hashed n-grams of ^host$ and of the path, each marked by its part; presence only."""
    host = F.concat(F.lit("^"), F.col("host"), F.lit("$"))

    def marked(mark: str, text: Column, n: int) -> Column:
        return F.transform(_grams(text, n), lambda g: F.concat(F.lit(mark), g))

    parts = [marked(mark, text, n) for mark, text in (("h", host), ("p", F.col("path"))) for n in GRAMS]
    grams = F.array_distinct(reduce(lambda a, b: F.concat(a, b), parts))
    return HashingTF(numFeatures=CELLS, binary=True, inputCol="_grams", outputCol="_features").transform(rows.withColumn("_grams", grams)).drop("_grams")


def train(spark: SparkSession) -> LogisticRegressionModel:
    """Fits the model to the labelled table, which has a few dozen rows; both classes weigh the same."""
    values = ", ".join([f"('http://{u}', 1D, {1 / len(UNWANTED)}D)" for u in UNWANTED] + [f"('http://{u}', 0D, {1 / len(WANTED)}D)" for u in WANTED])
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label, weight)").coalesce(1)
    rows = features(table.select("label", "weight", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    return LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", regParam=0.02, maxIter=60, standardization=False).fit(rows)


def judge(pages: DataFrame, model: LogisticRegressionModel | None = None) -> DataFrame:
    """One row (page_id, host, path, rule, verdict, score) per page.

    The longest fitting rule decides; where none fits, the model does: block from a probability of 0.5.
    score is the model's probability of block. Null urls and urls without :// have empty host and
    path and are judged by the model on these. Repeated rows give a row each. Further columns play no part. No
    pages: no rows.
    """
    model = model or train(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    scored = model.setPredictionCol("_prediction").setProbabilityCol("_probability").setRawPredictionCol("_raw").transform(features(rows))
    p = vector_to_array("_probability")[1]
    found = rule_struct(F.col("host"), F.col("path"))
    verdict = F.coalesce(F.col("_found.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("score", p).withColumn("_found", found).select("page_id", "host", "path", F.col("_found.rule").alias("rule"), verdict.alias("verdict"), "score")
