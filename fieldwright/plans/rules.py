"""Queries on rules, extraction, shapes, leases and streams, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.operators import extract, joins, rules
from fieldwright.plans.adapters import STATUSES, pick
from fieldwright.plans.register import query
from fieldwright.sources.tables import parquet
from fieldwright.streaming import keyed, leases, rolling
from fieldwright.streaming.common import file_stream

_FIELDS = ("certificate_number", "act_record_number", "act_record_date", "date_of_marriage", "date_of_issue", "spouse_1_given_names", "spouse_2_given_names")
_ZONES = ("act_record", "event", "issue", "spouse_1", "spouse_2")


def _marriage_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fields of marriage certificates."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return parquet(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), pick(_FIELDS, F.col("l_linenumber") - 1).alias("field"), F.when(p % 10 != 0, (s % 5).cast("string")).alias("value"), F.when(p % 13 != 0, pick(_ZONES, p % 5)).alias("zone"),
        F.when(s % 6 == 0, F.array().cast("array<string>")).otherwise(F.array((s % 7).cast("string"), (p % 7).cast("string"))).alias("ocr_ids"),
    )


def _sql_rules() -> str:
    n = {f: i + 1 for i, f in enumerate(_FIELDS)}
    pair = lambda a, b, on, reason: f"SELECT a.doc, '{reason}' AS reason FROM f a JOIN f b ON a.doc = b.doc AND a.n = {n[a]} AND b.n = {n[b]} AND {on}"
    one = lambda a, on, reason: f"SELECT doc, '{reason}' AS reason FROM f a WHERE n = {n[a]} AND {on}"
    shared, zones = "list_has_any(a.ids, b.ids)", "a.zone = b.zone"
    c, r, act, event, issue, s1, s2 = _FIELDS
    lock = lambda field, zone: [one(field, f"zone <> '{zone}'", f"{field}_wrong_zone"), one(field, "zone IS NULL", f"{field}_zone_not_verified")]
    found = [
        pair(c, r, "a.value = b.value", f"{c}_equals_{r}"), pair(c, r, zones, f"{c}_and_{r}_same_zone"), pair(c, r, shared, f"{c}_and_{r}_share_ocr_ids"),
        f"SELECT DISTINCT doc, '{r}_missing' AS reason FROM f WHERE doc NOT IN (SELECT doc FROM f WHERE n = {n[r]} AND value IS NOT NULL)",
        *lock(act, "act_record"), pair(act, event, shared, f"{act}_shares_tokens_with_{event}"), pair(act, issue, shared, f"{act}_shares_tokens_with_{issue}"),
        *lock(event, "event"), pair(event, issue, shared, f"{event}_shares_tokens_with_{issue}"), *lock(issue, "issue"),
        one(s1, "zone = 'spouse_2'", f"{s1}_from_spouse_2"), one(s2, "zone = 'spouse_1'", f"{s2}_from_spouse_1"), pair(s1, s2, zones, f"{s1}_and_{s2}_from_same_zone"),
        one(c, "value IS NOT NULL AND len(ids) = 0", f"{c}_no_ocr_evidence"),
    ]
    return f"""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, CASE WHEN l_partkey % 10 <> 0 THEN (l_suppkey % 5)::VARCHAR END AS value, CASE WHEN l_partkey % 13 <> 0 THEN {list(_ZONES)}[l_partkey % 5 + 1] END AS zone,
  CASE WHEN l_suppkey % 6 = 0 THEN [] ELSE [(l_suppkey % 7)::VARCHAR, (l_partkey % 7)::VARCHAR] END AS ids FROM lineitem),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc, n ORDER BY value NULLS FIRST, zone NULLS FIRST, ids) = 1) """ + " UNION ALL ".join(found)


@query(_sql_rules())
def validators_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(_marriage_fields(spark, sf_dir), rules.BATTERIES["marriage_certificate"])


_CYRILLIC = ("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшхиз")


@query(r"""
WITH v AS (
  SELECT 'line' AS kind, conv_id * 1000 + turn AS id, CASE WHEN role = 'assistant' THEN translate(l, '{latin}', '{cyrillic}') ELSE l END AS value, role = 'user' AS critical, false AS dated
  FROM (SELECT *, regexp_extract(text, '[^\n]*$') AS l FROM conversations)
  UNION ALL
  SELECT 'date', o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' ' || strftime(o_orderdate, '%m/%d/%Y') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END, o_totalprice > 250000, true FROM orders
), t AS (
  SELECT *, trim(value, E' \t\n\v\f\r') AS v FROM v
)
SELECT kind, id, CASE
  WHEN v = '' THEN CASE WHEN critical THEN 'empty_critical' END
  WHEN regexp_matches(v, '[\x{0400}-\x{04FF}]') THEN 'contains_cyrillic'
  WHEN length(v) > 200 THEN 'too_long'
  WHEN regexp_matches(v, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control_characters'
  WHEN dated AND NOT regexp_full_match(v, '\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2}') THEN 'date_shape' END AS problem
FROM t
""".replace("{latin}", _CYRILLIC[0]).replace("{cyrillic}", _CYRILLIC[1]))
def confirmed_value_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last lines of turns, an assistant's in Cyrillic letters, and dates of orders as values that a user confirmed."""
    line = F.regexp_extract("text", r"[^\n]*\z", 0)
    lines = parquet(spark, sf_dir, "conversations").select(
        F.lit("line").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("role") == "assistant", F.translate(line, *_CYRILLIC)).otherwise(line).alias("value"), (F.col("role") == "user").alias("critical"), F.lit(False).alias("dated")
    )
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    said = F.when(status == "F", F.concat(F.lit(" "), F.date_format(day, "MM/dd/yyyy"))).when(status == "O", F.date_format(day, "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    days = parquet(spark, sf_dir, "orders").select(F.lit("date").alias("kind"), F.col("o_orderkey").alias("id"), said.alias("value"), (F.col("o_totalprice") > 250000).alias("critical"), F.lit(True).alias("dated"))
    return lines.union(days).select("kind", "id", rules.confirmed_value_problem(F.col("value"), F.col("critical"), F.col("dated")).alias("problem"))


_CLASSES = ("passport", "ua_birth_certificate", "unknown_document", "id_card", "birth_certificate_handwritten", "work_permit", "arrival_record")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fields of an order's document, with what is known of their reading."""
    c = F.col
    rows = parquet(spark, sf_dir, "lineitem").join(parquet(spark, sf_dir, "orders"), c("o_orderkey") == c("l_orderkey"))
    return rows.select(
        c("l_orderkey").alias("doc"), c("l_linenumber").alias("n"),
        F.when(c("l_returnflag") == "R", "critical_identity").when(c("l_returnflag") == "A", "critical_document").when(c("l_linestatus") == "F", "admin").otherwise("optional").alias("criticality"),
        pick(_CLASSES, F.month("o_orderdate") % 7).alias("document_class"), c("o_orderpriority").alias("source_type"), F.when(c("l_discount") < 0.1, c("o_orderpriority")).when(c("l_tax") > 0.01, "2-HIGH").alias("expected_type"),
        c("o_custkey").alias("source_session"), F.when(c("l_tax") < 0.08, c("o_custkey")).otherwise(c("l_suppkey")).alias("session"), F.when(c("l_partkey") > 20, c("l_quantity") / 50).alias("confidence"),
        (c("l_discount") > 0.01).alias("value_present"), (c("l_tax") > 0.02).alias("candidate_present"), (c("o_orderstatus") == "P").alias("review_required"), (c("o_totalprice") > 400000).alias("manual_required"),
        (c("l_quantity") == 1).alias("zero_usable"), (c("l_quantity") == 49).alias("classifier_conflict"), (c("l_extendedprice") > 90000).alias("hard_case"), (c("l_linestatus") == "O").alias("legacy_reader"),
        F.when(c("l_suppkey") > 3, c("l_discount") < 0.08).alias("strong_anchor"), (c("l_tax") == 0.05).alias("confirmed"),
    )


_READINGS_SQL = f"""
r AS (
  SELECT l_orderkey AS doc, l_linenumber AS n, l_returnflag IN ('R', 'A') AS critical, {list(_CLASSES)}[month(o_orderdate) % 7 + 1] AS class,
    CASE WHEN l_discount < 0.1 THEN false ELSE l_tax > 0.01 AND o_orderpriority <> '2-HIGH' END AS mismatch, l_tax >= 0.08 AND o_custkey <> l_suppkey AS stale,
    l_partkey > 20 AND l_quantity / 50 < 0.7 AS low, l_discount > 0.01 AS present, l_tax > 0.02 AS candidate, o_orderstatus = 'P' AS review0, o_totalprice > 400000 AS manual0,
    l_quantity = 1 AS nothing, l_quantity = 49 AS conflict, l_extendedprice > 90000 AS hard_case, l_linestatus = 'O' AS legacy, l_suppkey > 3 AND l_discount < 0.08 AS anchor, l_tax = 0.05 AS confirmed
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), s AS (
  SELECT *, hard_case OR class IN ('birth_certificate_soviet_bilingual', 'birth_certificate_handwritten', 'ua_birth_certificate', 'unknown_document') AS hard,
    nothing OR mismatch OR stale OR conflict OR class = 'unknown_document' AS unsafe
  FROM r
), d AS (
  SELECT *, CASE
    WHEN critical AND unsafe THEN CASE WHEN nothing OR NOT present THEN 'block' ELSE 'manual_required' END
    WHEN critical AND (hard OR NOT anchor OR low) THEN CASE WHEN present OR candidate THEN 'candidate_only' ELSE 'manual_required' END
    WHEN NOT critical THEN CASE WHEN mismatch OR stale THEN 'manual_required' ELSE 'accept_final' END
    WHEN present THEN 'accept_final' ELSE 'manual_required' END AS decision
  FROM s
)"""


@query(f"""
WITH {_READINGS_SQL}
SELECT doc, n, decision, decision = 'candidate_only' OR decision <> 'accept_final' AND candidate AS candidate_allowed, review0 OR decision <> 'accept_final' AS review, manual0 OR decision <> 'accept_final' AS manual,
  concat_ws(',', CASE WHEN nothing THEN 'zero_usable_recognition' END, CASE WHEN mismatch THEN 'source_doc_type_mismatch' END, CASE WHEN stale THEN 'stale_or_ambiguous_session' END, CASE WHEN conflict THEN 'classifier_conflict' END,
    CASE WHEN critical AND hard THEN 'hard_case_manual_required' END, CASE WHEN critical AND legacy AND NOT anchor THEN 'legacy_reader_untrusted' END, CASE WHEN critical AND NOT anchor THEN 'no_strong_source_anchor' END,
    CASE WHEN critical AND low THEN 'low_confidence' END, CASE WHEN critical AND class = 'unknown_document' THEN 'unknown_document_class' END,
    CASE WHEN critical AND NOT unsafe AND NOT hard AND anchor AND NOT low AND NOT present THEN 'zero_usable_recognition' END) AS reasons
FROM d
""")
def safety_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.safe_reading(_readings(spark, sf_dir))
    return rows.select("doc", "n", "decision", "candidate_allowed", "review", "manual", F.array_join("reasons", ",").alias("reasons"))


@query(f"""
WITH {_READINGS_SQL}
SELECT doc, bool_or(critical AND (review0 OR manual0 OR decision <> 'accept_final') AND NOT confirmed) AS held_back FROM d GROUP BY doc
""")
def output_held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unresolved_critical(rules.safe_reading(_readings(spark, sf_dir)))


@query("""SELECT l_orderkey AS subject, count(*) AS n_gates, bool_and(l_returnflag <> 'R') AS passes FROM lineitem GROUP BY 1""")
def gates_all_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.gates_pass(parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.when(F.col("l_returnflag") != "R", "PASS").otherwise("SKIP").alias("status")))


@query("""SELECT l_orderkey AS subject, ['ok', 'warning', 'fail'][max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END)] AS signal FROM lineitem GROUP BY 1""")
def worst_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warning").otherwise("ok")
    return rules.worst_signal(parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), signal.alias("signal")))


@query("""SELECT event_id AS id, event_id % 10 < 7 OR event_id % 4 = 0 AS review, CASE WHEN event_id % 10 < 7 THEN 'document_type_uncertain' END AS reason FROM events""")
def document_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = parquet(spark, sf_dir, "events").select(i.alias("id"), ((i % 10) / 10.0).alias("type_confidence"), (i % 4 == 0).alias("review"))
    return rules.type_gate(rows).select("id", "review", "reason")


@query("""WITH r AS (SELECT c AS consumer, CASE WHEN o_custkey % 10 <> 0 THEN o_orderstatus END AS value, CASE WHEN (o_orderkey + c) % 8 = 0 THEN '' WHEN (o_orderkey + c) % 9 = 0 THEN 'Z' ELSE o_orderstatus END AS shown,
  o_custkey % 3 = 0 AS review, (o_orderkey + c) % 6 = 0 AS shown_review, (o_orderkey + c) % 11 <> 0 AS applicable FROM orders, (SELECT unnest([0, 1, 2]) AS c)),
v AS (SELECT *, CASE WHEN NOT applicable THEN 'NOT_APPLICABLE' WHEN value IS NULL AND shown <> '' THEN 'FABRICATED' WHEN shown = '' AND value IS NOT NULL THEN 'EMPTY' WHEN shown = '' THEN 'SAME' WHEN shown <> value THEN 'DIFFERENT' WHEN review AND NOT shown_review THEN 'REVIEW_LOST' ELSE 'SAME' END AS verdict FROM r)
SELECT consumer, verdict, count(*) AS n, count(*) FILTER (verdict IN ('FABRICATED', 'DIFFERENT', 'REVIEW_LOST')) AS n_hard FROM v GROUP BY ALL""")
def cross_consumer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit("status").alias("key"), "o_orderstatus", "o_custkey")
    core = orders.select("doc", "key", F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderstatus")).alias("value"), (F.col("o_custkey") % 3 == 0).alias("review"))
    each, i = orders.withColumn("consumer", F.explode(F.sequence(F.lit(0), F.lit(2)))), F.col("doc") + F.col("consumer")
    shown = F.when(i % 8 == 0, "").when(i % 9 == 0, "Z").otherwise(F.col("o_orderstatus"))
    consumers = each.select("consumer", "doc", "key", shown.alias("value"), (i % 6 == 0).alias("review"), (i % 11 != 0).alias("applicable"))
    return rules.consumer_verdicts(core, consumers).groupBy("consumer", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if("hard_fail").alias("n_hard"))


_LABELS = [("name", "(?i)^name\\b", r"\p{L}"), ("segment", "(?i)^segment\\b", "^[A-Z]+$"), ("number", "(?i)^number\\b", r"^\d+$")]


@query("""SELECT c_custkey AS doc, 'name' AS field, 0 AS line_no, c_name AS value, 'high' AS confidence FROM customer UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END, c_mktsegment, 'medium' FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'number', 4, c_custkey::VARCHAR, 'high' FROM customer WHERE c_custkey >= 10""")
def label_value_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name on its label's line, a segment below or above its label, and a number of two digits at least."""
    i = F.col("c_custkey")
    segment = F.when(i % 3 == 0, "-").otherwise(F.col("c_mktsegment"))
    body = F.concat(F.lit("Name: "), "c_name", F.lit("\n"), F.when(i % 2 == 0, F.concat(F.lit("Segment\n \n"), segment)).otherwise(F.concat(segment, F.lit("\nSegment\n--"))), F.lit("\nNumber: "), i.cast("string"))
    return extract.label_values(parquet(spark, sf_dir, "customer").select(i.alias("doc"), body.alias("text")), _LABELS)


@query(r"""WITH p AS (SELECT page_id AS doc, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, 'lang="([a-z]+)"', 1)) AS lang FROM pages)
SELECT doc, 'title' AS field, title AS value FROM p WHERE title <> '' UNION ALL SELECT doc, 'lang', lang FROM p WHERE lang <> ''""")
def doc_extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.pattern_values(parquet(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text")), {"title": ["<title>([^<]*)</title>"], "lang": ['lang="([a-z]+)"', "lang='([a-z]+)'"]})


@query("""WITH r AS (SELECT l_orderkey AS subject, l_returnflag AS key, l_shipdate::DATE::VARCHAR AS value, l_linenumber % 3 AS priority, l_linenumber AS ordinal FROM lineitem WHERE l_partkey % 10 <> 0)
SELECT subject, key, arg_min(value, row(priority, ordinal, value)) AS value, count(DISTINCT value) > 1 AS conflict FROM r GROUP BY ALL""")
def multi_document_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_partkey") % 10 != 0, F.to_date("l_shipdate").cast("string")).otherwise(" ")
    return extract.merge_documents(parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("key"), value.alias("value"), (F.col("l_linenumber") % 3).alias("priority"), F.col("l_linenumber").alias("ordinal")))


@query("""SELECT l_orderkey AS doc, min(l_shipmode) FILTER (k = 'A') AS "A", min(l_shipmode) FILTER (k = 'N') AS "N", min(l_shipmode) FILTER (k = 'R') AS "R" FROM (SELECT l_orderkey, l_returnflag AS k, l_linestatus || l_linenumber::VARCHAR AS l_shipmode FROM lineitem) GROUP BY 1""")
def adapter_long_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("key"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("value"))
    return extract.to_wide(long, "doc", ["A", "N", "R"])


@query("""SELECT o_orderkey, 'o_orderstatus' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::VARCHAR FROM orders""")
def adapter_wide_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.to_long(parquet(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("""SELECT o_orderkey AS id, 'Form.Status' AS target, 'text' AS kind, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'Form.Urgent', 'checkbox', 'on' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'Form.Customer', 'choice', o_custkey::VARCHAR FROM orders""")
def form_ops_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), "o_custkey")
    return extract.form_operations(answers, {"o_orderstatus": ("Form.Status", "text"), "urgent": ("Form.Urgent", "checkbox"), "o_custkey": ("Form.Customer", "choice")})


@query("""WITH t AS (SELECT l_orderkey AS doc, min(l_quantity) FILTER (k) AS x0, min(l_tax) FILTER (k) AS y0, max(l_quantity + 1) FILTER (k) AS x1, max(l_tax + 1) FILTER (k) AS y1, string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (NOT k) AS unresolved
  FROM (SELECT *, l_linenumber AS n, l_partkey % 4 <> 0 AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_tax) = 1) GROUP BY 1) SELECT doc, x0, y0, x1, y1, coalesce(unresolved, '') AS unresolved FROM t""")
def token_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parquet(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity", "l_tax")).alias("t")).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("string").alias("ocr_id"), "t.*")
    references = first.groupBy("doc").agg(F.collect_set("ocr_id").alias("ocr_ids")).withColumn("field", F.lit("f"))
    tokens = first.where("l_partkey % 4 <> 0").select("doc", "ocr_id", F.col("l_quantity").alias("x0"), F.col("l_tax").alias("y0"), (F.col("l_quantity") + 1).alias("x1"), (F.col("l_tax") + 1).alias("y1"))
    return extract.boxes(references, tokens).select("doc", "x0", "y0", "x1", "y1", F.array_join("unresolved", ",").alias("unresolved"))


@query("""SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS term, 1 AS n_words FROM part WHERE p_name LIKE 'cold %' AND p_name <> 'cold widget' UNION ALL SELECT p_partkey, 'cold widget', 2 FROM part WHERE p_name = 'cold widget'""")
def longest_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.sql("SELECT * FROM VALUES ('cold'), ('cold widget'), ('widget') AS t(term)")
    return joins.longest_prefix(parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("phrase")), terms)


def lease_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for a lease of ten minutes on the user's key."""
    return leases.requests_of(parquet(spark, sf_dir, "events"))


_GRANTED = "((r.op = 'acquire' AND (f.st IS NULL OR (f.st = 'in_flight' AND f.ends < r.t))) OR (r.op <> 'acquire' AND coalesce(f.st = 'in_flight' AND f.own = r.owner, false)))"
_LEASES_SQL = f"""WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, (event_id % 3)::VARCHAR AS owner, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'acquire' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS op, NULL::VARCHAR AS st, NULL::VARCHAR AS own, 0::BIGINT AS ends, false AS ok FROM (SELECT DISTINCT key FROM r) UNION ALL
  SELECT r.key, r.n, r.id, r.op, CASE WHEN {_GRANTED} THEN CASE r.op WHEN 'acquire' THEN 'in_flight' WHEN 'complete' THEN 'done' ELSE 'failed' END ELSE f.st END, CASE WHEN {_GRANTED} THEN r.owner ELSE f.own END,
    CASE WHEN {_GRANTED} THEN CASE r.op WHEN 'acquire' THEN r.t + 600000000 WHEN 'fail' THEN r.t + 60000000 ELSE f.ends END ELSE f.ends END, {_GRANTED} FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
"""


@query(_LEASES_SQL + "SELECT key, id, op, ok, coalesce(st, 'none') AS status FROM f WHERE n > 0")
def lease_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.fold_batch(lease_requests(spark, sf_dir)).drop("limited_until")


@query(_LEASES_SQL + "SELECT key, id, op, ok, coalesce(st, 'none') AS status FROM f WHERE n > 0")
def stream_lease_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a stream over the table's files; the state of a key lives in the state store."""
    return leases.run_stream(spark, f"{sf_dir}/events.parquet")


@query(_LEASES_SQL + "SELECT key, id, ends AS limited_until FROM f WHERE n > 0 AND st = 'failed'")
def lease_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests on keys that cool down after a failure."""
    return leases.fold_batch(lease_requests(spark, sf_dir)).where("limited_until is not null").select("key", "id", "limited_until")


@query("""WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 3600 AS t, (value * 1000000)::BIGINT AS took, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 3600, event_id) AS n FROM events),
f AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS ends, false AS good, 0::BIGINT AS exp, NULL::VARCHAR AS outcome, NULL::BIGINT AS waited, NULL::VARCHAR AS error FROM (SELECT DISTINCT key FROM r) UNION ALL
  SELECT r.key, r.n, r.id, CASE WHEN f.ends IS NULL OR (f.exp < r.t AND r.t < f.ends) THEN r.t + r.took ELSE f.ends END, CASE WHEN f.ends IS NULL OR (f.exp < r.t AND r.t < f.ends) THEN r.good ELSE f.good END, CASE WHEN f.ends IS NULL OR (f.exp < r.t AND r.t < f.ends) THEN r.t + 30000000 ELSE f.exp END,
  CASE WHEN f.ends IS NULL OR (f.exp < r.t AND r.t < f.ends) THEN CASE WHEN r.good THEN 'provider_winner' ELSE 'unavailable' END WHEN f.ends <= r.t THEN CASE WHEN f.good THEN 'cache_hit' ELSE 'unavailable' END WHEN f.ends <= least(r.t + 8000000, f.exp) AND f.good THEN 'waited_cache_hit' ELSE 'unavailable' END,
  CASE WHEN f.ends IS NULL OR (f.exp < r.t AND r.t < f.ends) OR f.ends <= r.t THEN NULL WHEN f.ends <= least(r.t + 8000000, f.exp) THEN f.ends - r.t WHEN f.exp < r.t + 8000000 THEN f.exp - r.t ELSE 8000000 END,
  CASE WHEN f.ends IS NULL OR (f.exp < r.t AND r.t < f.ends) THEN CASE WHEN NOT r.good THEN 'rate_limited' END WHEN f.ends <= r.t OR f.ends <= least(r.t + 8000000, f.exp) THEN CASE WHEN NOT f.good THEN 'rate_limited' END WHEN f.exp < r.t + 8000000 THEN 'lease_expired' ELSE 'lease_wait_timeout' END FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT key, id, outcome, waited, error FROM f WHERE n > 0""")
def single_flight_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for one answer a user, an hour told as a second; errors are calls that fail."""
    rows = parquet(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.expr("unix_micros(cast(ts as timestamp)) div 3600").alias("micros"), F.rint(F.col("value") * 1_000_000).cast("long").alias("took"), (F.col("event_type") != "error").alias("good"),
    )
    return leases.single_flight(rows)


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 21600000000 - unnest([0, 1, 2, 3]) AS w FROM events) SELECT user_id, make_timestamp(w * 21600000000) AS window_start, count(*) AS n FROM e GROUP BY ALL""")
def stream_rolling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.run_stream(spark, f"{sf_dir}/events.parquet")


@query("""
WITH RECURSIVE r AS (
  SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), f AS (
  SELECT key, id, n, t AS start, 1::BIGINT AS place FROM r WHERE n = 1
  UNION ALL
  SELECT r.key, r.id, r.n, CASE WHEN r.t - f.start > 86400000000 THEN r.t ELSE f.start END, CASE WHEN r.t - f.start > 86400000000 THEN 1 ELSE f.place + 1 END FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1
)
SELECT key, id, place, place <= 3 AS allowed, greatest(0, 3 - place)::BIGINT AS remaining, start + 86400000000 AS reset_micros FROM f
""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a user and day, as a stream; a timer takes idle users out of the state."""
    return keyed.run_limiter(spark, f"{sf_dir}/events.parquet", 3, 86_400)


def _order_steps(events: DataFrame) -> DataFrame:
    """Events as steps of their users' orders."""
    k, kind, v = F.get_json_object("props", "$.k").cast("int"), F.col("event_type"), F.floor("value").cast("int")
    return events.select(
        F.col("user_id").alias("order_id"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.when((kind == "purchase") & (v < 5), " ").otherwise(F.concat(F.lit("op "), kind)).alias("actor"),
        F.when(kind == "error", pick(STATUSES, v % len(STATUSES))).alias("expected_status"), F.when(kind == "signup", v % 4 + 1).cast("long").alias("expected_version"), F.when(k < 8, "created").otherwise(pick(STATUSES, k % len(STATUSES))).alias("to_status"),
    )


_STEPS_SQL = f"""
WITH RECURSIVE s AS (
  SELECT user_id AS order_id, event_id AS id, epoch_us(ts) AS t, event_type = 'purchase' AND floor(value) < 5 AS no_actor, event_type AS kind, CASE WHEN event_type = 'error' THEN {list(STATUSES)}[floor(value)::INTEGER % {len(STATUSES)} + 1] END AS es,
    CASE WHEN event_type = 'signup' THEN floor(value)::INTEGER % 4 + 1 END AS ev, CASE WHEN (props->>'k')::INTEGER < 8 THEN 'created' ELSE {list(STATUSES)}[(props->>'k')::INTEGER % {len(STATUSES)} + 1] END AS go,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events
), f AS (
  SELECT order_id, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS st, 0::BIGINT AS v, NULL::BIGINT AS paid, NULL::BIGINT AS done, NULL::VARCHAR AS old, NULL::BIGINT AS t, NULL::VARCHAR AS kind FROM (SELECT DISTINCT order_id FROM s)
  UNION ALL
  SELECT order_id, n, id, outcome, CASE WHEN outcome <> 'applied' THEN st WHEN go = 'created' THEN 'queued' ELSE go END, CASE WHEN outcome = 'applied' THEN v + 1 ELSE v END, CASE WHEN outcome = 'applied' AND go = 'assigned' AND paid IS NULL THEN t ELSE paid END, CASE WHEN outcome = 'applied' AND go = 'delivered' THEN t ELSE done END, st, t, kind
  FROM (
    SELECT s.order_id, s.n, s.id, s.go, s.t, s.kind, f.st, f.v, f.paid, f.done, CASE
      WHEN no_actor THEN 'actor_required' WHEN go = 'created' THEN CASE WHEN st IS NULL THEN 'applied' ELSE 'exists_already' END WHEN st IS NULL THEN 'not_found'
      WHEN es IS NOT NULL AND es <> st THEN 'state_conflict' WHEN ev IS NOT NULL AND ev <> v THEN 'version_conflict'
      WHEN st || '>' || go NOT IN ('queued>assigned', 'queued>cancelled', 'assigned>in_review', 'assigned>queued', 'assigned>cancelled', 'in_review>needs_user_clarification', 'in_review>approved_for_render', 'in_review>cancelled',
        'needs_user_clarification>in_review', 'needs_user_clarification>cancelled', 'approved_for_render>artifact_generated', 'approved_for_render>in_review', 'artifact_generated>delivery_pending', 'delivery_pending>delivered',
        'delivery_pending>delivery_failed', 'delivery_failed>delivery_pending', 'delivery_failed>cancelled') THEN 'invalid_transition' ELSE 'applied' END AS outcome
    FROM f JOIN s ON s.order_id = f.order_id AND s.n = f.n + 1
  )
)
"""


@query(_STEPS_SQL + "SELECT order_id, id, outcome FROM f WHERE n > 0")
def stream_order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.order_tables(_order_steps(file_stream(spark, f"{sf_dir}/events.parquet", maxBytesPerTrigger=keyed.BATCH)))[2]


@query(_STEPS_SQL + "SELECT order_id, old AS from_status, st AS status, v AS version, 'op ' || kind AS actor, t AS micros, id FROM f WHERE outcome = 'applied'")
def stream_order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log of steps that moved an order."""
    return keyed.order_tables(_order_steps(file_stream(spark, f"{sf_dir}/events.parquet", maxBytesPerTrigger=keyed.BATCH)))[1]


@query(_STEPS_SQL + "SELECT order_id, st AS status, v AS version, paid, done AS completed FROM f WHERE st IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY n DESC) = 1")
def stream_orders_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.order_tables(_order_steps(file_stream(spark, f"{sf_dir}/events.parquet", maxBytesPerTrigger=keyed.BATCH)))[0]
