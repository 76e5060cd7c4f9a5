"""Queries on tables that are changed in place and on who may see which rows, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.operators import policies
from fieldwright.plans.register import query
from fieldwright.sources import stored
from fieldwright.sources.tables import parquet


@query("""
WITH n AS (
  SELECT o_custkey AS id, o_orderkey AS seen, o_totalprice AS amount FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
)
SELECT c_custkey AS id, coalesce(seen, 0)::BIGINT AS seen, coalesce(amount, c_acctbal) AS amount FROM customer LEFT JOIN n ON id = c_custkey
UNION ALL SELECT id, seen, amount FROM n WHERE id NOT IN (SELECT c_custkey FROM customer)
""")
def stored_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a table that is stored; their orders are put into it, the last of each counts."""
    path = stored.new_path(spark, "customers")
    stored.create(parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("seen"), F.col("c_acctbal").alias("amount")), path, ["id"])
    stored.upsert(parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seen"), F.col("o_totalprice").alias("amount")), path, ["id"], "seen")
    return stored.load(spark, path)


@query("""
SELECT 'orders' AS pass, true AS ok, (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') AS deleted_rows, (SELECT count(*) FROM orders WHERE NOT coalesce(o_orderdate < TIMESTAMP '1996-01-01', false)) AS kept_rows
UNION ALL SELECT 'lines', true, (SELECT count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_shipdate < TIMESTAMP '1996-01-01', false))
UNION ALL SELECT 'packets', false, 0, 0
""")
def stored_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired rows are deleted from stored tables in passes of their own; the table of the last is not there."""
    paths = {name: stored.new_path(spark, name) for name in ("orders", "lines", "packets")}
    stored.create(parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), paths["orders"], ["o_orderkey"])
    stored.create(parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), paths["lines"], ["l_orderkey"])
    limit = F.lit("1996-01-01").cast("timestamp")
    gone = {"orders": F.col("o_orderdate") < limit, "lines": F.col("l_shipdate") < limit, "packets": F.lit(True)}
    done = stored.cleanup(spark, {name: (lambda name=name: stored.delete(spark, paths[name], gone[name])) for name in paths})
    kept = [stored.load(spark, paths[name]).agg(F.count(F.lit(1)).alias("kept_rows")).select(F.lit(name).alias("pass"), "kept_rows") for name in ("orders", "lines")]
    return done.join(kept[0].unionByName(kept[1]), "pass", "left").select("pass", "ok", "deleted_rows", F.coalesce("kept_rows", F.lit(0)).alias("kept_rows"))


#: Who asks in the query: a customer, a moderator and nobody.
_ASKING = (7, 8, None)


@query("""
WITH who AS (
  SELECT * FROM (VALUES (7, false), (8, true), (NULL, false)) AS t(id, moderator)
), o AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS user_id FROM orders
)
SELECT coalesce(who.id, -1)::INTEGER AS who, 'translations_orders' AS name, 'select' AS action, o.id AS id, NULL::BIGINT AS n FROM who JOIN o ON who.moderator OR o.user_id = who.id
UNION ALL SELECT coalesce(who.id, -1), 'translations_orders', 'insert', o.id, NULL FROM who JOIN o ON o.user_id = who.id
UNION ALL SELECT coalesce(who.id, -1), 'translation_files', 'select', l_orderkey, l_linenumber FROM who JOIN o ON who.moderator OR o.user_id = who.id JOIN lineitem ON l_orderkey = o.id
UNION ALL SELECT coalesce(who.id, -1), 'translation_files', 'insert', l_orderkey, l_linenumber FROM who JOIN o ON o.user_id = who.id JOIN lineitem ON l_orderkey = o.id
UNION ALL SELECT coalesce(who.id, -1), 'form_sessions', 'insert', o.id, NULL FROM who JOIN o ON o.user_id = who.id OR o.user_id IS NULL
UNION ALL SELECT coalesce(who.id, -1), 'form_sessions', 'update', o.id, NULL FROM who JOIN o ON o.user_id = who.id
""")
def row_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as tables with policies; orders of one status have no owner."""
    orders = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("user_id"), F.lit(None).cast("long").alias("n"))
    lines = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("n"))
    tables = {"translations_orders": orders, "translation_files": lines, "form_sessions": orders}
    asked = [("translations_orders", "select"), ("translations_orders", "insert"), ("translation_files", "select"), ("translation_files", "insert"), ("form_sessions", "insert"), ("form_sessions", "update"), ("form_sessions", "delete")]
    out = None
    for id_ in _ASKING:
        who = policies.Principal(id_, "moderator" if id_ == 8 else None)
        for table, action in asked:
            rows = policies.allowed(tables[table], table, action, who, tables)
            part = rows.select(F.lit(-1 if id_ is None else id_).alias("who"), F.lit(table).alias("name"), F.lit(action).alias("action"), F.col("order_id" if table == "translation_files" else "id").alias("id"), "n")
            out = part if out is None else out.unionByName(part)
    return out
