"""Queries on projections, predicates, sources, keys and hashes, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.functions import checks, hashes
from fieldwright.operators import feeds, joins, shaping
from fieldwright.plans.adapters import pick
from fieldwright.plans.register import query
from fieldwright.sources.tables import parquet

#: The moment as of which ages are told.
AS_OF = "2024-02-01 00:00:00"
STATUSES = ("pending", "queued", "assigned", "in_review", "needs_user_clarification", "completed", "rejected")
OPEN = ("pending", "in_review", "queued", "assigned", "needs_user_clarification")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tickets: status and reasons follow from what was measured."""
    k, v = F.get_json_object("props", "$.k").cast("int"), F.col("value")
    reasons = F.array_compact(F.array(F.when(v > 60, "paid_request_failed"), F.when(k > 80, "image_quality_failed"), F.when(F.col("event_type") == "error", "extraction_error")))
    return parquet(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("document_type"), F.col("ts").alias("created_at"), pick(STATUSES, F.floor(v) % len(STATUSES)).alias("status"),
        F.when(v > 80, "high").otherwise("normal").alias("priority"), reasons.alias("reasons"),
    )


_STATUS_SQL = "['pending','queued','assigned','in_review','needs_user_clarification','completed','rejected']"
TICKETS_SQL = f"""
tickets AS (
  SELECT event_id AS id, user_id AS session_id, event_type AS document_type, ts AS created_at, {_STATUS_SQL}[floor(value)::BIGINT % 7 + 1] AS status, CASE WHEN value > 80 THEN 'high' ELSE 'normal' END AS priority,
    list_filter([CASE WHEN value > 60 THEN 'paid_request_failed' END, CASE WHEN (props->>'k')::INTEGER > 80 THEN 'image_quality_failed' END, CASE WHEN event_type = 'error' THEN 'extraction_error' END], lambda x: x IS NOT NULL) AS reasons
  FROM events
)"""
_OPEN_SQL = "('pending','in_review','queued','assigned','needs_user_clarification')"


@query("SELECT doc_id, lang, source FROM documents")
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.allowed_columns(parquet(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "secret"])


@query(f"WITH {TICKETS_SQL} SELECT id, status, array_to_string(reasons, ',') AS reasons FROM tickets WHERE status IN {_OPEN_SQL} AND list_contains(reasons, 'paid_request_failed') AND priority IS NOT NULL")
def open_paid_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, containment in a JSON array and a null test in one filter."""
    rows = tickets(spark, sf_dir).withColumn("reasons_json", F.to_json("reasons"))
    rows = rows.where(F.col("status").isin(*OPEN) & shaping.json_holds(F.col("reasons_json"), "paid_request_failed") & F.col("priority").isNotNull())
    return rows.select("id", "status", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {TICKETS_SQL} SELECT id, priority, document_type FROM tickets WHERE priority = 'high' AND document_type = 'purchase'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the parameters that are given filter."""
    return shaping.with_options(tickets(spark, sf_dir), priority="high", status=None, document_type="purchase").select("id", "priority", "document_type")


@query("SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id LIMIT 500")
def clamped_top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's first page: 9,000 rows asked for, 500 given."""
    return shaping.first_rows(parquet(spark, sf_dir, "events").select("event_id", "ts", "value"), [F.desc("value"), F.col("event_id")], 9000)


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_type = 'ECONOMY' ORDER BY p_size, p_partkey LIMIT 8")
def critical_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, sort by rank, slice."""
    return shaping.first_rows(parquet(spark, sf_dir, "part").where("p_type = 'ECONOMY'").select("p_partkey", "p_size", "p_brand"), [F.col("p_size"), F.col("p_partkey")], 8)


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'gear')")
def array_member_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("words"))
    return shaping.holding(rows, "words", "gear").select("p_partkey", "p_name")


@query("""SELECT event_id, '{"k":' || (props->>'k') || '}' AS kept FROM events""")
def key_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.map_concat(F.from_json("props", "map<string,int>"), F.create_map(F.lit("secret"), F.col("user_id").cast("int")))
    return parquet(spark, sf_dir, "events").select("event_id", F.to_json(shaping.allowed_keys(given, ("k", "route"))).alias("kept"))


@query("""SELECT doc_id, CASE WHEN n_chars % 100 / 100.0 < 0.7 THEN 'document_type_uncertain' END AS reason, CASE WHEN n_chars % 100 / 100.0 < 0.7 OR lang IS NULL OR n_chars > 5000 THEN 'quarantined' ELSE 'accepted' END AS side FROM documents""")
def gate_and_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("type_confidence"), (F.col("lang").isNull() | (F.col("n_chars") > 5000)).alias("review"))
    return shaping.quarantine(rows).select("doc_id", "reason", "side")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'F'""")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customer 7, who is no admin, may see: their own orders and those that are published."""
    roles = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "MACHINERY", "user").otherwise("client").alias("role"))
    return shaping.visible_to(parquet(spark, sf_dir, "orders"), 7, roles, "o_custkey", F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey = 7)""")
def children_of_own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = parquet(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return shaping.visible_children(parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), parents, "l_orderkey", 7, "o_custkey")


@query("""SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)""")
def existing_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = parquet(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return parquet(spark, sf_dir, "orders").select("o_orderkey").join(large, "o_orderkey", "left_semi")


@query("""WITH x AS (SELECT user_id, unnest(list({'k': (props->>'k')::INTEGER, 'id': event_id} ORDER BY event_id)) AS e, generate_subscripts(list(event_id ORDER BY event_id), 1) AS i FROM events GROUP BY user_id)
SELECT user_id, i - 1 AS position, e.k AS k, e.id AS id FROM x""")
def json_array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's facts stored as one JSON array, and read out as rows again."""
    fact = F.struct(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    stored = parquet(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(fact))).alias("facts"))
    return shaping.exploded_json(stored, "facts", "k: int, id: bigint").withColumn("position", F.col("position").cast("long"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_totalprice > 300000 THEN 'expensive' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS blockers FROM orders""")
def blocker_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"pending": F.col("o_orderstatus") == "P", "expensive": F.col("o_totalprice") > 300000, "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return shaping.blockers(parquet(spark, sf_dir, "orders"), "o_orderkey", rules).withColumn("blockers", F.array_join("blockers", ","))


@query("""WITH r AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations), x AS (SELECT conv_id, turn, w[1:6] AS a, w[4:9] AS b FROM r)
SELECT conv_id, turn, coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(a || b, lambda y: list_position(a || b, y)))), lambda i: (a || b)[i]), ' '), '') AS reasons FROM x""")
def reason_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return parquet(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(shaping.united_reasons(F.slice(words, 1, 6), F.slice(words, 4, 6)), " ").alias("reasons"))


@query(f"""WITH {TICKETS_SQL} SELECT session_id, document_type, id, status FROM tickets WHERE status IN {_OPEN_SQL} QUALIFY row_number() OVER (PARTITION BY session_id, document_type ORDER BY created_at DESC, id DESC) = 1""")
def latest_open_ticket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.latest_open(tickets(spark, sf_dir), ["session_id", "document_type"], OPEN).select("session_id", "document_type", "id", "status")


@query(f"""WITH {TICKETS_SQL} SELECT id, status FROM tickets WHERE status IN {_OPEN_SQL} AND list_contains(reasons, 'paid_request_failed') UNION SELECT id, status FROM tickets WHERE status IN {_OPEN_SQL} AND list_contains(reasons, 'extraction_error')""")
def union_of_reason_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.any_reason(tickets(spark, sf_dir).where(F.col("status").isin(*OPEN)), ("paid_request_failed", "extraction_error")).select("id", "status")


@query("""WITH i AS (SELECT o_custkey AS key, o_orderkey AS arrival, o_orderpriority AS value FROM orders WHERE o_orderstatus <> 'F'), l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC) = 1),
e AS (SELECT c_custkey AS key, 0::BIGINT AS arrival, c_mktsegment AS value FROM customer) SELECT * FROM l UNION ALL SELECT * FROM e WHERE key NOT IN (SELECT key FROM l)""")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("long").alias("arrival"), F.col("c_mktsegment").alias("value"))
    new = parquet(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("arrival"), F.col("o_orderpriority").alias("value"))
    return shaping.upserted_by(stored, new, ["key"], "arrival")


@query("""SELECT event_id AS id, first(event_id) OVER w AS stored_id, row_number() OVER w = 1 AS inserted FROM events WINDOW w AS (PARTITION BY user_id, event_type, props ORDER BY ts, event_id)""")
def insert_or_reselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("session_id"), "event_type", F.col("props").alias("fields_hash"))
    return shaping.inserted_or_found(rows, ["session_id", "event_type", "fields_hash"]).select("id", "stored_id", "inserted")


@query(f"""SELECT 'manual_review_queue' AS pass, count(*) FILTER (ts + INTERVAL 20 DAY < TIMESTAMP '{AS_OF}') AS deleted_rows, count(*) FILTER (NOT ts + INTERVAL 20 DAY < TIMESTAMP '{AS_OF}') AS kept_rows FROM events
UNION ALL SELECT 'wizard_sessions', count(*) FILTER (o_orderdate < TIMESTAMP '1995-01-01'), count(*) FILTER (NOT o_orderdate < TIMESTAMP '1995-01-01') FROM orders
UNION ALL SELECT 'uploads', count(*) FILTER (l_shipdate < TIMESTAMP '1996-06-01'), count(*) FILTER (NOT l_shipdate < TIMESTAMP '1996-06-01') FROM lineitem""")
def ttl_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = lambda c, d: F.col(c) < F.lit(d).cast("timestamp_ntz")
    return shaping.expired_by_pass({
        "manual_review_queue": (parquet(spark, sf_dir, "events"), F.col("ts") + F.expr("interval 20 days") < F.lit(AS_OF).cast("timestamp_ntz")),
        "wizard_sessions": (parquet(spark, sf_dir, "orders"), before("o_orderdate", "1995-01-01")), "uploads": (parquet(spark, sf_dir, "lineitem"), before("l_shipdate", "1996-06-01")),
    })


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE NOT o_orderdate < TIMESTAMP '1995-01-01'""")
def ttl_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.unexpired(parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))


@query("""SELECT p_type AS category, count(*) AS n, count(*) FILTER (trim(split_part(p_name, ' ', 2)) <> '' AND p_size > 10) AS with_source FROM part GROUP BY 1""")
def category_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.when(F.col("p_size") > 10, F.split_part("p_name", F.lit(" "), F.lit(2))).alias("source"))
    return shaping.census(rows, "category", "source")


@query("""SELECT count(*) AS total, round(count(*) / 24.0, 2)::DOUBLE AS per_hour FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'""")
def blocks_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.hourly_rate(parquet(spark, sf_dir, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "ts")


@query("""
WITH t AS (
  SELECT l_orderkey AS doc, l_linenumber AS id, '["' || l_returnflag || l_linestatus || '","' || l_suppkey || '",null]' AS t FROM lineitem
)
SELECT doc, sha256('[' || string_agg(t, ',' ORDER BY t) || ']') AS fields_hash, sha256('[' || string_agg(t, ',' ORDER BY id, t) || ']') AS resolved_hash FROM t GROUP BY 1
""")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's hash over its lines in any order, and one over them in their own."""
    told = hashes.tuple_text(F.concat("l_returnflag", "l_linestatus"), F.col("l_suppkey").cast("string"), F.lit(None).cast("string"))
    rows = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), told.alias("t"))
    by_doc = rows.groupBy("doc").agg(F.collect_list("t").alias("items"), F.array_sort(F.collect_list(F.struct("id", "t"))).alias("ordered"))
    return by_doc.select("doc", hashes.set_hash(F.col("items")).alias("fields_hash"), hashes.ordered_hash(F.col("ordered.t")).alias("resolved_hash"))


@query("""WITH e AS (SELECT conv_id, role || '_name=' || lower(trim(regexp_replace(regexp_replace(text, '[’''`´]', '''', 'g'), '\\s+', ' ', 'g'))) AS e FROM conversations WHERE trim(text) <> '')
SELECT conv_id, count(*) AS n_fields, sha256(string_agg(e, '|' ORDER BY e)) AS identity_hash FROM e GROUP BY 1""")
def identity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat("role", F.lit("_name="), hashes.identity_normal(F.col("text")))
    rows = parquet(spark, sf_dir, "conversations").where(~shaping.blank(F.col("text"))).groupBy("conv_id").agg(F.collect_list(entry).alias("e"))
    return rows.select("conv_id", F.size("e").cast("long").alias("n_fields"), hashes.identity_hash(F.col("e")).alias("identity_hash"))


@query("""SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN sha256(url) || ':' || regexp_replace(trim(split_part(url, '/', 3)), '[^A-Za-z0-9._-]', '_', 'g') || ':' || regexp_replace(trim(url), '[^A-Za-z0-9._-]', '_', 'g') || ':v1' END AS cache_key FROM pages""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of stored readings; a malformed hash has none."""
    sha = F.when(F.col("page_id") % 9 != 0, F.sha2("url", 256)).otherwise("none")
    return parquet(spark, sf_dir, "pages").select("page_id", hashes.cache_key(sha, [F.split_part("url", F.lit("/"), F.lit(3)), F.col("url"), F.lit("v1")]).alias("cache_key"))


@query("""SELECT conv_id, turn, text AS opened, true AS sealed, NULL::VARCHAR AS by_other_key FROM conversations""")
def sealed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts sealed and opened again: the seal differs from the text, and another key opens nothing."""
    rows = parquet(spark, sf_dir, "conversations").select("conv_id", "turn", "text", hashes.seal(F.col("text"), F.lit("0123456789abcdef")).alias("s"))
    return rows.select("conv_id", "turn", hashes.unseal(F.col("s"), F.lit("0123456789abcdef")).alias("opened"), (F.col("s") != F.col("text").cast("binary")).alias("sealed"), hashes.unseal(F.col("s"), F.lit("fedcba9876543210")).alias("by_other_key"))


@query("""SELECT event_id AS id, false AS uuid, CASE WHEN event_type = 'view' THEN 'uk' ELSE 'en' END AS locale, event_type = 'click' AS extension, octet_length(encode(props)) <= 65536 AS state_fits,
  value = floor(value) AND value BETWEEN 0 AND 12 AS step, round((props->>'k')::INTEGER * value * 1e6) / 1e6::DOUBLE AS run_cost FROM events""")
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, kind = F.get_json_object("props", "$.k").cast("double"), F.col("value"), F.col("event_type")
    return parquet(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), checks.is_uuid(kind).alias("uuid"), checks.one_of(F.when(kind == "view", "uk").otherwise(kind), checks.LOCALES, "en").alias("locale"),
        checks.has_extension(F.when(kind == "click", "Scan.PDF").otherwise(kind)).alias("extension"), checks.fits_state(F.col("props")).alias("state_fits"), checks.is_step(v).alias("step"), checks.run_cost(k, v).alias("run_cost"),
    )


@query(r"""WITH f AS (SELECT o_orderkey AS id, ['dob','passport_number','a_number','us_address_zip','us_address_state','sex','street'][o_custkey % 7 + 1] AS field, o_orderkey AS k, o_orderdate AS d, o_orderstatus AS s, o_custkey AS c FROM orders),
v AS (SELECT id, field, CASE field WHEN 'dob' THEN CASE WHEN k % 2 = 0 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%m/%d/%Y') END WHEN 'passport_number' THEN lower(s) || 'b' || c::VARCHAR WHEN 'a_number' THEN lpad(k::VARCHAR, 9, '0')[1:3] || '-' || lpad(k::VARCHAR, 9, '0')[4:] WHEN 'us_address_zip' THEN c::VARCHAR WHEN 'us_address_state' THEN s || 'y' WHEN 'sex' THEN s ELSE ' ' || s END AS value FROM f)
SELECT id, field, value, CASE field WHEN 'dob' THEN regexp_full_match(value, '(19|20)\d\d-\d\d-\d\d') WHEN 'passport_number' THEN regexp_full_match(value, '[a-z]b\d{6,9}') WHEN 'a_number' THEN length(value) = 10 WHEN 'us_address_zip' THEN length(value) = 5 WHEN 'us_address_state' THEN true WHEN 'sex' THEN value = 'M' OR value = 'F' ELSE true END AS valid FROM v""")
def strict_field_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, s, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderdate")
    field = pick(("dob", "passport_number", "a_number", "us_address_zip", "us_address_state", "sex", "street"), c % 7)
    number = F.lpad(k.cast("string"), 9, "0")
    value = (
        F.when(field == "dob", F.when(k % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MM/dd/yyyy"))).when(field == "passport_number", F.concat(F.lower(s), F.lit("b"), c.cast("string")))
        .when(field == "a_number", F.concat(F.substring(number, 1, 3), F.lit("-"), F.substring(number, 4, 6))).when(field == "us_address_zip", c.cast("string")).when(field == "us_address_state", F.concat(s, F.lit("y")))
        .when(field == "sex", s).otherwise(F.concat(F.lit(" "), s))
    )
    rows = parquet(spark, sf_dir, "orders").select(k.alias("id"), field.alias("field"), value.alias("value"))
    return rows.withColumn("valid", checks.strictly_valid(F.col("field"), F.col("value")))


@query("""WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]+)">([^<]*)</a></li>', 1)) AS link, unnest(regexp_extract_all(html, '<li><a href="([^"]+)">([^<]*)</a></li>', 2)) AS title FROM pages)
SELECT page_id, trim(replace(title, '&amp;', '&')) AS title, link, link AS guid FROM i WHERE trim(title) <> '' AND trim(link) <> ''""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' lists as feeds, read item by item."""
    xml = F.regexp_replace("html", '<li><a href="([^"]+)">([^<]*)</a></li>', "<item><title>$2</title><link>$1</link><pubDate></pubDate></item>")
    return feeds.feed_items(parquet(spark, sf_dir, "pages").select("page_id", xml.alias("xml")), "page_id").select("page_id", "title", "link", "guid")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE lower(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ') LIKE '%the%' OR lower(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ') LIKE '%ción%'""")
def keyword_filtered_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("").alias("type"))).alias("results")))
    rows = feeds.api_documents(parquet(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id")
    return feeds.with_keywords(rows, ("the", "ción")).select("page_id", "title")


@query("""WITH l AS (SELECT DISTINCT page_id, url FROM pages), s AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 0 ELSE 403 END AS head, CASE page_id % 3 WHEN 0 THEN 301 WHEN 1 THEN 503 ELSE 403 END AS get FROM l),
r AS (SELECT url, CASE WHEN head BETWEEN 200 AND 399 THEN head ELSE get END AS status FROM s)
SELECT url, status::INTEGER AS http_status, CASE WHEN status = 0 OR status >= 500 THEN 'critical' ELSE 'warning' END AS severity FROM r WHERE NOT status BETWEEN 200 AND 399 AND NOT (status = 403 AND contains(url, '.example.com'))""")
def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    probes = parquet(spark, sf_dir, "pages").select("url", F.when(i % 4 == 0, 200).when(i % 4 == 1, 0).otherwise(403).alias("head"), F.when(i % 3 == 0, 301).when(i % 3 == 1, 503).otherwise(403).alias("get"))
    return feeds.dead_links(probes, protected=(".example.com",))


@query(f"""WITH a AS (SELECT event_id AS id, ['new_item','edition_changed','dead_link'][floor(value)::BIGINT % 3 + 1] AS alert_type, CASE WHEN value > 50 THEN 'critical' ELSE 'warning' END AS severity, ['USCIS note','Federal register','[YouTube] clip'][(props->>'k')::INTEGER % 3 + 1] AS title, ts,
  CASE WHEN event_type = 'click' THEN ts END AS acknowledged_at FROM events), o AS (SELECT * FROM a WHERE acknowledged_at IS NULL AND ts >= TIMESTAMP '2024-01-30 00:00:00'),
s AS (SELECT unnest(list_filter([CASE WHEN severity = 'critical' THEN 'critical' END, CASE WHEN alert_type = 'new_item' AND contains(title, 'USCIS') THEN 'news' END, CASE WHEN alert_type = 'new_item' AND contains(lower(title), 'federal') THEN 'federal' END, CASE WHEN alert_type = 'edition_changed' THEN 'forms' END,
  CASE WHEN alert_type = 'dead_link' THEN 'dead' END, CASE WHEN starts_with(title, '[YouTube]') THEN 'youtube' END], lambda x: x IS NOT NULL)) AS section, id FROM o) SELECT section, count(*) AS n, max(id) AS last_id FROM s GROUP BY 1""")
def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.get_json_object("props", "$.k").cast("int"), F.col("value")
    alerts = parquet(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), pick(("new_item", "edition_changed", "dead_link"), F.floor(v) % 3).alias("alert_type"), F.when(v > 50, "critical").otherwise("warning").alias("severity"),
        pick(("USCIS note", "Federal register", "[YouTube] clip"), k % 3).alias("title"), F.col("ts").alias("detected_at"), F.when(F.col("event_type") == "click", F.col("ts")).alias("acknowledged_at"),
    )
    return feeds.digest(alerts, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


@query(f"""WITH {TICKETS_SQL} SELECT id, priority, floor(epoch_us(TIMESTAMP '{AS_OF}' - created_at) / 3600000000)::BIGINT AS open_hours FROM tickets WHERE status IN {_OPEN_SQL} AND list_contains(reasons, 'paid_request_failed') AND epoch_us(TIMESTAMP '{AS_OF}' - created_at) >= 86400000000""")
def overdue_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tickets(spark, sf_dir).where(F.col("status").isin(*OPEN))
    return feeds.overdue(shaping.any_reason(rows, ("paid_request_failed",)), F.lit(AS_OF).cast("timestamp_ntz")).select("id", "priority", "open_hours")


@query("""WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR)) AS tick), c AS (SELECT tick, count(event_id) AS n FROM h LEFT JOIN events ON ts > tick - INTERVAL 1 HOUR AND ts <= tick GROUP BY tick) SELECT tick, n, n > 12 AS alert FROM c WHERE n > 0""")
def hourly_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheduled check on each full hour that had events."""
    return feeds.scheduled_counts(parquet(spark, sf_dir, "events").where("ts > timestamp_ntz'2023-12-31 23:00:00' and ts <= timestamp_ntz'2024-01-31 00:00:00'"), "ts", 12)


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS city_seen, CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderpriority || ' ' ELSE o_orderstatus END AS city_sent, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS region_seen, CASE WHEN o_custkey % 4 = 0 THEN o_orderstatus END AS region_sent FROM orders)
SELECT id, 'city_of_birth' AS field, trim(city_seen) AS review_value, trim(city_sent) AS payload_value FROM s WHERE trim(city_seen) <> trim(city_sent)
UNION ALL SELECT id, 'province_of_birth', coalesce(region_seen, ''), coalesce(region_sent, '') FROM s WHERE coalesce(region_seen, '') <> coalesce(region_sent, '')""")
def review_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, s, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    o = parquet(spark, sf_dir, "orders")
    seen = o.select(k.alias("id"), p.alias("city_of_birth"), F.when(c % 2 == 0, s).alias("province_of_birth"))
    sent = o.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit(" "), p, F.lit(" "))).otherwise(s).alias("city_of_birth"), F.when(c % 4 == 0, s).alias("province_of_birth"))
    return joins.reviewed_differs(seen, sent, "id", ["city_of_birth", "province_of_birth"])


@query("""SELECT l_orderkey AS doc, l_linenumber AS field, coalesce(o_orderstatus, 'unknown') AS source, coalesce(o_orderpriority, 'unknown') AS method, o_totalprice AS confidence FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey""")
def provenance_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("field"))
    side = parquet(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("confidence"))
    return joins.with_provenance(fields, side, ["doc"], ["source", "method"])
