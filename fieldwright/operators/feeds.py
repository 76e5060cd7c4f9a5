"""What scheduled jobs read and report: feeds, dead links, digests, overdue work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: XML entities of a feed's text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(text)


def feed_items(feeds: DataFrame, key: str) -> DataFrame:
    """Items (key, title, link, pub_date, guid) of RSS texts in column xml; items without title or link are left out, a missing guid is the link."""
    item = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("item")
    part = lambda tag: decoded(F.regexp_extract("item", rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    rows = feeds.select(key, item).select(key, part("title").alias("title"), part("link").alias("link"), part("pubDate").alias("pub_date"), F.nullif(part("guid"), F.lit("")).alias("guid"))
    return rows.where("title <> '' and link <> ''").withColumn("guid", F.coalesce("guid", "link"))


def api_documents(bodies: DataFrame, key: str) -> DataFrame:
    """The results (title, type) of JSON answers in column body."""
    return bodies.select(key, F.explode(F.from_json("body", "results array<struct<title: string, type: string>>")["results"]).alias("r")).select(key, "r.*")


def with_keywords(documents: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Documents whose title or type holds one of the words, in any case of letters."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("type", F.lit(""))))
    return documents.where(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(hay, w)))


def dead_links(probes: DataFrame, protected: tuple[str, ...]) -> DataFrame:
    """Dead links (url, http_status, severity) from probes (url, head, get): the second request counts where the first fails, and 403 is no fault of protected sites."""
    fine = lambda c: c.between(200, 399)
    rows = probes.select("url", F.when(fine(F.col("head")), F.col("head")).otherwise(F.coalesce("get", F.lit(0))).alias("http_status"))
    guarded = (F.col("http_status") == 403) & F.exists(F.array(*map(F.lit, protected)), lambda p: F.contains("url", p))
    return rows.where(~fine(F.col("http_status")) & ~guarded).withColumn("severity", F.when((F.col("http_status") == 0) | (F.col("http_status") >= 500), "critical").otherwise("warning"))


def digest(alerts: DataFrame, since: Column) -> DataFrame:
    """Alerts of the last day that nobody has acknowledged, one row for each section that they belong to."""
    kind, title = F.col("alert_type"), F.coalesce("title", F.lit(""))
    sections = [
        ("critical", F.col("severity") == "critical"), ("news", (kind == "new_item") & title.contains("USCIS")), ("federal", (kind == "new_item") & F.lower(title).contains("federal")),
        ("forms", kind == "edition_changed"), ("dead", kind == "dead_link"), ("youtube", title.startswith("[YouTube]")),
    ]
    rows = alerts.where(F.col("acknowledged_at").isNull() & (F.col("detected_at") >= since))
    return rows.withColumn("section", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sections]))))


def overdue(tickets: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Tickets that are open for so many hours or more, with the full hours."""
    age = F.timestamp_diff("MICROSECOND", "created_at", now)
    return tickets.withColumn("open_hours", F.floor(age / 3_600_000_000)).where(age >= hours * 3_600_000_000)


def scheduled_counts(events: DataFrame, at: str, threshold: int) -> DataFrame:
    """For each full hour with events in the hour up to it: their number, and whether that is above the threshold."""
    hour = F.date_trunc("hour", at)
    tick = F.when(F.col(at) == hour, hour).otherwise(hour + F.expr("interval 1 hour")).cast("timestamp_ntz").alias("tick")
    return events.groupBy(tick).agg(F.count(F.lit(1)).alias("n")).withColumn("alert", F.col("n") > threshold)
