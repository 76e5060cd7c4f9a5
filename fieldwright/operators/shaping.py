"""Projections, predicates and set operations as callers ask for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(text: Column) -> Column:
    """Null, empty or white space only, of whatever kind Unicode has."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x{FEFF}]")


def trimmed(text: Column) -> Column:
    """Without white space at the ends, of whatever kind Unicode has; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def allowed_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, in the order of the list; those that the table lacks are left out."""
    return df.select(*[c for c in allowed if c in df.columns])


def with_options(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality predicates for the parameters that are given; None adds none."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), df)


def clamped(asked: int | None, default: int = 100, most: int = 500) -> int:
    """A row limit between 1 and ``most``; nothing, or 0, asks for the default."""
    return max(1, min(int(asked or default), most))


def first_rows(df: DataFrame, order: list[Column], asked: int | None = None) -> DataFrame:
    """The first rows in an order, as many as the clamped limit says; each task keeps no more than that."""
    return df.orderBy(*order).limit(clamped(asked))


def holding(df: DataFrame, array: str, wanted: str) -> DataFrame:
    """Rows whose array holds a member."""
    return df.where(F.array_contains(array, wanted))


def json_holds(json_array: Column, wanted: str) -> Column:
    """Whether a JSON array of strings holds one."""
    return F.array_contains(F.from_json(json_array, "array<string>"), wanted)


def allowed_keys(values: Column, allowed: tuple[str, ...]) -> Column:
    """A map less the keys that are not allowed."""
    return F.map_filter(values, lambda k, _: k.isin(*allowed))


def quarantine(fields: DataFrame, least: float = 0.7) -> DataFrame:
    """Fields (review, type_confidence) with side: all of a document whose type is told with less confidence than ``least`` are quarantined, and those that ask for review."""
    unsure = F.coalesce("type_confidence", F.lit(0.0)) < least
    review = F.coalesce("review", F.lit(False)) | unsure
    return fields.withColumn("reason", F.when(unsure, "document_type_uncertain")).withColumn("side", F.when(review, "quarantined").otherwise("accepted"))


def visible_to(rows: DataFrame, principal: object, roles: DataFrame, owner: str, published: Column | None = None) -> DataFrame:
    """Rows that a principal may see: their own, those published, and all of them for admins and moderators. roles: (id, role)."""
    if not roles.where((F.col("id") == F.lit(principal)) & F.col("role").isin("admin", "moderator")).isEmpty():
        return rows
    seen = F.col(owner) == F.lit(principal)
    return rows.where(seen if published is None else seen | F.coalesce(published, F.lit(False)))


def visible_children(children: DataFrame, parents: DataFrame, key: str, principal: object, owner: str) -> DataFrame:
    """Children of parents that the principal owns."""
    return children.join(parents.where(F.col(owner) == F.lit(principal)).select(key), key, "left_semi")


def exploded_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON array of objects as rows, with their position."""
    parsed = F.from_json(F.col(column), f"array<struct<{schema}>>")
    return rows.select("*", F.posexplode(parsed).alias("position", "element")).select(*[c for c in rows.columns if c != column], "position", "element.*")


def blockers(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, blockers): names of all rules that hold, in their order."""
    return rows.select(key, F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])).alias("blockers"))


def united_reasons(first: Column, more: Column) -> Column:
    """Two lists of reasons as one, in order, each once, without blanks."""
    some = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda r: r.isNotNull() & (r != ""))
    return F.array_union(some(first), some(more))


def latest_open(tickets: DataFrame, keys: list[str], open_statuses: tuple[str, ...]) -> DataFrame:
    """The newest open ticket of each key."""
    rows = tickets.where(F.col("status").isin(*open_statuses))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in tickets.columns if c not in keys]), F.struct("created_at", "id")).alias("t")).select(*keys, "t.*")


def any_reason(tickets: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    """Tickets with one of the reasons, each once: what a query per reason, united by id, would give."""
    return tickets.where(F.arrays_overlap("reasons", F.array(*map(F.lit, reasons))))


def upserted_by(existing: DataFrame, incoming: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Both tables' rows by key; an incoming row goes before a stored one, and of several incoming rows of a key the last by arrival counts."""
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*incoming.columns), F.col(arrival)).alias("r")).select("r.*")
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last)


def inserted_or_found(arrivals: DataFrame, natural_key: list[str]) -> DataFrame:
    """Every arrival (id, created_at, natural key) with the id under which its key was stored first, and whether that was now. Ids are unique; nulls are keys like others.

    Of each key one row is told before anything is shuffled, and joined back; so a hot key's rows need not meet.
    """
    first = arrivals.groupBy(*[F.col(k).alias(f"_{k}") for k in natural_key]).agg(F.min(F.struct("created_at", "id")).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in natural_key])
    out = arrivals.join(first, same)
    return out.select(*arrivals.columns, F.col("_first.id").alias("stored_id"), (F.col("id") == F.col("_first.id")).alias("inserted"))


def expired_by_pass(passes: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row per pass: rows that its condition takes, and what stays. Nulls are not expired."""
    parts = [df.agg(F.count_if(F.coalesce(gone, F.lit(False))).alias("deleted_rows"), F.count_if(~F.coalesce(gone, F.lit(False))).alias("kept_rows")).select(F.lit(name).alias("pass"), "*") for name, (df, gone) in passes.items()]
    return reduce(DataFrame.unionByName, parts)


def unexpired(df: DataFrame, gone: Column) -> DataFrame:
    """What a pass leaves."""
    return df.where(~F.coalesce(gone, F.lit(False)))


def census(rows: DataFrame, category: str, source: str) -> DataFrame:
    """(category): how many rows, and how many tell their source."""
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(~blank(F.col(source))).alias("with_source"))


def hourly_rate(rows: DataFrame, since: Column, at: str, hours: int = 24) -> DataFrame:
    """One row: how many since a moment, and how many an hour to two places."""
    return rows.where(F.col(at) >= since).agg(F.count(F.lit(1)).alias("total")).withColumn("per_hour", F.round(F.col("total") / hours, 2))
