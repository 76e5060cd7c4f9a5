"""Queries on decisions about fields and documents, and on places and spellings, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwright.functions import dates, places, text
from fieldwright.operators import canonical, joins, timing
from fieldwright.plans.adapters import pick
from fieldwright.plans.register import query
from fieldwright.sources.tables import parquet

KEYS = ("family_name", "date_of_birth", "sex", "passport_number", "nationality", "place_of_birth", "date_of_issue", "issuing_authority", "document_color")
SOURCES = ("manual_user_entry", "ai_vision", "document_ocr", "driver_license", "ead", "i94", "gov_ua", "passport_visual", "mrz")


def measured() -> tuple[Column, Column, Column]:
    """What events tell: a number in their properties, a value, and their kind."""
    return F.get_json_object("props", "$.k").cast("int"), F.col("value"), F.col("event_type")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as candidates: a user's day is a document; field, source, confidence and flags follow from what was measured."""
    k, v, kind = measured()
    said = F.concat(F.when(k % 3 == 0, F.upper(kind)).otherwise(kind), F.when(v > 50, " ").otherwise("  "), F.floor(v / 40).cast("string"))
    return parquet(spark, sf_dir, "events").select(
        F.concat_ws("-", "user_id", F.dayofmonth("ts").cast("string")).alias("doc"), pick(KEYS, k % 9).alias("key"), F.when(v >= 1, said).otherwise("\t ").alias("value"), pick(SOURCES, F.floor(v) % 9).alias("source"),
        F.when(kind != "view", F.least(v / 40, F.lit(1.0))).alias("confidence"), F.col("event_id").alias("ordinal"), (k % 2 == 0).alias("mrz_valid"), (kind == "error").alias("fuzzy"), (kind == "click").alias("review_required"),
        F.when(v > 20, F.array(F.lit("blurred"), F.lit("low_confidence"))).alias("review_reasons"),
    )


_KEYS_SQL = "['family_name','date_of_birth','sex','passport_number','nationality','place_of_birth','date_of_issue','issuing_authority','document_color']"
_SOURCES_SQL = "['manual_user_entry','ai_vision','document_ocr','driver_license','ead','i94','gov_ua','passport_visual','mrz']"
READINGS_SQL = f"""
e AS (SELECT *, (props->>'k')::INTEGER AS k FROM events),
reads AS (SELECT user_id::VARCHAR || '-' || day(ts)::VARCHAR AS doc, {_KEYS_SQL}[k % 9 + 1] AS key, CASE WHEN value >= 1 THEN (CASE WHEN k % 3 = 0 THEN upper(event_type) ELSE event_type END) || (CASE WHEN value > 50 THEN ' ' ELSE '  ' END) || floor(value / 40)::BIGINT::VARCHAR END AS value,
  {_SOURCES_SQL}[floor(value)::BIGINT % 9 + 1] AS source, floor(value)::BIGINT % 9 AS authority, CASE WHEN event_type <> 'view' THEN least(value / 40, 1.0) END AS confidence, event_id AS ordinal, k % 2 = 0 AS mrz_valid, event_type = 'error' AS fuzzy, event_type = 'click' AS asked,
  CASE WHEN value > 20 THEN ['blurred','low_confidence'] ELSE []::VARCHAR[] END AS said FROM e WHERE value >= 1),
arb AS (SELECT doc, key, first({{'value': value, 'source': source, 'confidence': coalesce(confidence, 0), 'fuzzy': fuzzy, 'asked': asked, 'said': said}} ORDER BY authority DESC, coalesce(confidence, 0) DESC, ordinal) AS w,
  first({{'value': value, 'confidence': confidence, 'valid': mrz_valid}} ORDER BY ordinal) FILTER (source = 'mrz') AS m, count(DISTINCT lower(regexp_replace(value, '\\s+', '', 'g'))) AS nd, count(*) AS n_candidates,
  CASE WHEN key IN ('family_name','date_of_birth','passport_number') THEN 'critical' WHEN key IN ('place_of_birth','date_of_issue','issuing_authority') THEN 'high' WHEN key = 'sex' THEN 'medium' ELSE 'low' END AS criticality
  FROM reads GROUP BY doc, key),
own AS (SELECT *, m IS NOT NULL AND key IN ('family_name','date_of_birth','sex','passport_number','nationality') AS machine, list_filter([CASE WHEN criticality = 'critical' THEN 'critical_no_mrz_anchor' END, CASE WHEN criticality IN ('critical','high') AND nd > 1 THEN 'provider_conflict' END, CASE WHEN w.fuzzy THEN 'fuzzy_match' END,
  CASE WHEN criticality IN ('critical','high') AND w.confidence < 0.85 THEN 'low_confidence' END, CASE WHEN w.asked AND len(w.said) = 0 THEN 'reader_review_required' END], lambda x: x IS NOT NULL) AS r FROM arb),
fields AS (SELECT doc, key, CASE WHEN machine THEN m.value ELSE w.value END AS value, CASE WHEN machine THEN 'mrz' ELSE w.source END AS source, criticality, CASE WHEN NOT machine THEN w.confidence WHEN m.valid THEN coalesce(m.confidence, 0.99) ELSE 0.3 END::DOUBLE AS confidence,
  CASE WHEN machine AND m.valid THEN []::VARCHAR[] WHEN machine THEN ['mrz_check_failed'] WHEN w.asked THEN r || list_filter(w.said, lambda x: NOT list_contains(r, x)) ELSE r END AS reasons, n_candidates, nd, w, m FROM own)"""


@query(f"WITH {READINGS_SQL} SELECT doc, key, value, source, criticality, confidence, len(reasons) > 0 AS review, array_to_string(reasons, '|') AS reasons, n_candidates FROM fields")
def arbitrate_field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority, machine lines, conflicts, criticality and carried reasons."""
    return canonical.arbitrate_fields(readings(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "|"))


_KNOWN = "('purchase 1','accept','Purchase'), ('signup  0','suggest','Signup zero'), ('VIEW 1','block','none')"


@query(f"""WITH {READINGS_SQL}, k AS (SELECT * FROM (VALUES {_KNOWN}) AS t(value, action, final))
SELECT doc, key, value, CASE WHEN action = 'accept' THEN final ELSE value END AS normalized, CASE WHEN action <> 'accept' THEN final END AS suggested, source, criticality, confidence, len(reasons) > 0 OR coalesce(action <> 'accept', false) AS review,
  array_to_string(reasons || CASE WHEN action <> 'accept' THEN ['knowledge:' || action || ':dict'] ELSE []::VARCHAR[] END, '|') AS reasons FROM fields LEFT JOIN k USING (value)""")
def arbitrate_with_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.sql(f"SELECT * FROM VALUES {_KNOWN} AS t(value, action, final)").withColumn("rule", F.lit("dict"))
    knowledge = table.crossJoin(spark.sql(f"SELECT explode(array({', '.join(repr(k) for k in KEYS)})) AS key"))
    return canonical.arbitrate_documents(readings(spark, sf_dir), knowledge).drop("rule").withColumn("reasons", F.array_join("reasons", "|"))


@query(f"""WITH {READINGS_SQL}, f AS (SELECT doc, key, criticality, w.value AS raw, lower(w.value) || CASE WHEN nd > 1 THEN '.' ELSE 'x' END AS norm, confidence, nd FROM fields), r AS (SELECT doc, key, list_filter([CASE WHEN criticality = 'critical' THEN 'critical_field_requires_review' END,
  CASE WHEN criticality IN ('critical','high') AND confidence < 0.85 THEN 'low_final_confidence' END, CASE WHEN nd = 1 THEN 'material_normalization_change' END, CASE WHEN criticality IN ('critical','high') AND nd > 1 THEN 'provider_disagreement' END], lambda x: x IS NOT NULL) AS r FROM f)
SELECT doc, key, len(r) > 0 AS review, array_to_string(r, '|') AS reasons FROM r""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir)
    distinct = rows.where("value >= ''").where(~canonical.blank(F.col("value"))).groupBy("doc", "key").agg(F.count_distinct(canonical.same_reading(F.col("value"))).alias("n_distinct"), F.max_by("value", F.struct(canonical.authority(F.col("source")), F.coalesce("confidence", F.lit(0.0)), -F.col("ordinal"))).alias("raw"))
    fields = canonical.arbitrate_fields(rows).select("doc", "key", "confidence").join(distinct, ["doc", "key"])
    fields = fields.withColumn("normalized", F.concat(F.lower("raw"), F.when(F.col("n_distinct") > 1, ".").otherwise("x")))
    return canonical.review_decision(fields).withColumn("reasons", F.array_join("reasons", "|"))


_SLOT_FIELDS, _SLOT_DOCS, _SLOT_TYPES = ("family_name", "given_name", "city_of_birth", "a_number"), ("passport", "booklet", "i94", "ead", "manual"), ("ocr_mrz", "ocr_keyword", "ai_brain", "dual_ocr_crossref", "user_corrected")


@query("""WITH s AS (SELECT user_id AS doc, ['family_name','given_name','city_of_birth','a_number'][(props->>'k')::INTEGER % 4 + 1] AS field, CASE WHEN value > 2 THEN CASE WHEN (props->>'k')::INTEGER % 5 = 0 THEN event_type || '7' ELSE ' ' || upper(event_type[1]) || event_type[2:] END END AS value,
  ['passport','booklet','i94','ead','manual'][floor(value)::BIGINT % 5 + 1] AS source_doc, ['ocr_mrz','ocr_keyword','ai_brain','dual_ocr_crossref','user_corrected'][(props->>'k')::INTEGER % 5 + 1] AS source_type, event_type = 'click' AS asked, event_id AS ordinal FROM events),
p AS (SELECT *, CASE WHEN source_type = 'user_corrected' THEN 0 WHEN field IN ('family_name','given_name') THEN CASE source_doc || '_' || source_type WHEN 'passport_ocr_mrz' THEN 1 WHEN 'i94_ocr_keyword' THEN 2 WHEN 'ead_ocr_keyword' THEN 3 WHEN 'booklet_dual_ocr_crossref' THEN 5 WHEN 'passport_ai_brain' THEN 6 WHEN 'booklet_ai_brain' THEN 7 WHEN 'ead_ai_brain' THEN 8 WHEN 'i94_ai_brain' THEN 9 ELSE 99 END
  WHEN field = 'city_of_birth' THEN CASE source_doc || '_' || source_type WHEN 'booklet_dual_ocr_crossref' THEN 1 WHEN 'booklet_ocr_keyword' THEN 2 WHEN 'booklet_ai_brain' THEN 3 WHEN 'passport_ai_brain' THEN 4 ELSE 99 END ELSE 99 END AS priority, field NOT IN ('family_name','given_name') OR NOT regexp_matches(value, '[0-9]') AS plausible FROM s WHERE value IS NOT NULL),
x AS (SELECT *, first({'value': value, 'd': source_doc, 't': source_type, 'asked': asked}) OVER (PARTITION BY doc, field ORDER BY NOT plausible, priority, ordinal) AS won FROM p),
g AS (SELECT doc, field, any_value(won) AS w, count(*) FILTER (levenshtein(lower(trim(value)), lower(trim(won.value))) > 1) AS n_rejected, first(plausible ORDER BY priority, ordinal) AS fp, bool_or(plausible) AS ap FROM x GROUP BY ALL),
l AS (SELECT *, field IN ('family_name','given_name') AND w.t = 'ocr_mrz' AS locked FROM g)
SELECT doc, field, w.value AS value, w.d AS source_doc, w.t AS source_type, locked, n_rejected > 0 AS conflict, field = 'city_of_birth' OR (n_rejected > 0 AND NOT locked) OR w.asked AS review, n_rejected,
  concat_ws('|', CASE WHEN NOT fp AND ap THEN 'plausibility_rejected' END, CASE WHEN locked THEN 'mrz_locked' END, CASE WHEN n_rejected > 0 THEN 'conflict_detected' END, CASE WHEN field = 'city_of_birth' THEN 'weak_field_review_required' END) AS notes FROM l""")
def resolve_slotted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, kind = measured()
    said = F.when(v > 2, F.when(k % 5 == 0, F.concat(kind, F.lit("7"))).otherwise(F.concat(F.lit(" "), F.initcap(kind))))
    rows = parquet(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc"), pick(_SLOT_FIELDS, k % 4).alias("field"), said.alias("value"), pick(_SLOT_DOCS, F.floor(v) % 5).alias("source_doc"), pick(_SLOT_TYPES, k % 5).alias("source_type"),
        (kind == "click").alias("review_required"), F.col("event_id").alias("ordinal"),
    )
    return canonical.resolve_fields(rows).withColumn("notes", F.array_join("notes", "|"))


@query("""WITH f AS (SELECT event_id AS doc, ['critical','high','low'][(props->>'k')::INTEGER % 3 + 1] AS criticality, CASE WHEN value > 3 THEN event_type END AS read_value, value / 40 AS read_confidence, CASE WHEN (props->>'k')::INTEGER % 11 = 0 THEN 'anchor' END AS anchor_value, value > 10 AS anchor_valid, CASE WHEN (props->>'k')::INTEGER % 7 = 0 THEN 'gazetteer' END AS dict,
  CASE WHEN event_type = 'error' THEN 'date_order' END AS inv, ['agree','mismatch','incomplete'][floor(value)::BIGINT % 3 + 1] AS cons FROM events),
d AS (SELECT *, anchor_value IS NOT NULL AND anchor_valid AS anchored, cons <> 'agree' AS unstable FROM f), v AS (SELECT *, CASE WHEN anchored THEN anchor_value ELSE read_value END AS value, CASE WHEN anchored THEN 0.99 WHEN read_value IS NULL THEN 0 ELSE least(1, greatest(0, read_confidence)) END::DOUBLE AS confidence FROM d),
s AS (SELECT *, confidence < CASE criticality WHEN 'critical' THEN 0.97 WHEN 'high' THEN 0.9 ELSE 0.8 END AS low, dict IS NOT NULL OR inv IS NOT NULL OR unstable AS signal FROM v)
SELECT doc, value, confidence, CASE WHEN value IS NULL THEN 'reject' WHEN anchored THEN 'accept' WHEN signal OR (criticality = 'critical' AND low) THEN 'force_review' WHEN low THEN 'accept_low_confidence' ELSE 'accept' END AS decision,
  CASE WHEN value IS NULL THEN 'no_source' ELSE concat_ws('|', CASE WHEN dict IS NOT NULL THEN 'dictionary_review' END, CASE WHEN inv IS NOT NULL THEN 'validation_invalid' END, CASE WHEN cons = 'mismatch' THEN 'self_consistency_identity_mismatch' WHEN cons = 'incomplete' THEN 'self_consistency_unstable' END,
  CASE WHEN NOT anchored AND NOT signal AND low THEN CASE WHEN criticality = 'critical' THEN 'critical_low_confidence' ELSE 'below_auto_final_threshold' END END) END AS reasons FROM s""")
def field_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, kind = measured()
    rows = parquet(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc"), kind.alias("key"), pick(("critical", "high", "low"), k % 3).alias("criticality"), F.when(v > 3, kind).alias("read_value"), (v / 40).alias("read_confidence"), F.when(k % 11 == 0, "anchor").alias("anchor_value"),
        (v > 10).alias("anchor_valid"), F.when(k % 7 == 0, "gazetteer").alias("dictionary_review"), F.when(kind == "error", "date_order").alias("invalid_rule"), pick(("agree", "mismatch", "incomplete"), F.floor(v) % 3).alias("consistency"),
    )
    return canonical.decide(rows).drop("key").withColumn("reasons", F.array_join("reasons", "|"))


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\S+')) AS v, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS i FROM conversations)
SELECT conv_id, turn, i - 1 AS position, CASE WHEN lower(v) IN ('name','date','place','state','number','sex','first','last') THEN 'label_as_value' WHEN regexp_matches(v, '\d{4,}.*[a-zA-Z].*\d{4,}|[<>|\\/]{2,}|^[A-Z]{6,}[0-9]') THEN 'garbage_pattern'
  WHEN length(v) < 2 OR length(v) > 50 OR NOT regexp_matches(v, '(?i)[aeiouy]') OR regexp_matches(v, '[0-9]') OR regexp_matches(v, '\p{Ll}\p{Lu}') THEN 'implausible_name' END AS reason FROM w""")
def invented_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a conversation as a name that might have been read."""
    words = parquet(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("position", "v"))
    return words.select("conv_id", "turn", F.col("position").cast("long").alias("position"), canonical.invented_value(F.col("v"), F.lit(True)).alias("reason"))


@query("""SELECT a.p_partkey AS id, CASE WHEN lower(a.p_name) = lower(b.p_name) THEN 'none' WHEN levenshtein(lower(a.p_name), lower(b.p_name)) <= 2 THEN 'low' ELSE 'high' END AS risk FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def cross_document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parquet(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(other, "p_partkey").select(F.col("p_partkey").alias("id"), canonical.cross_document_risk(F.col("p_name"), F.col("other")).alias("risk"))


@query("""WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'birth_certificate_handwritten' ELSE 'military_id' END AS kind, ['child_family_name','series','father_full_name','issuing_authority','color','child_dob','number'][l_linenumber] AS field, l_quantity > 40 AS review FROM lineitem)
SELECT doc, n, field, review OR (kind = 'birth_certificate_handwritten' AND field NOT IN ('series','color','number')) AS review, concat_ws('|', CASE WHEN review THEN 'blurred' END, CASE WHEN kind = 'birth_certificate_handwritten' AND field NOT IN ('series','color','number') THEN 'handwritten_document|model_instability_risk|no_strong_identity_anchor' END) AS reasons FROM f""")
def anti_fabrication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.col("l_quantity") > 40
    rows = parquet(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", "birth_certificate_handwritten").otherwise("military_id").alias("document_class"),
        pick(("child_family_name", "series", "father_full_name", "issuing_authority", "color", "child_dob", "number"), F.col("l_linenumber") - 1).alias("field"), large.alias("review"), F.when(large, F.array(F.lit("blurred"))).alias("reasons"),
    )
    return canonical.against_invention(rows).select("doc", "n", "field", "review", F.array_join("reasons", "|").alias("reasons"))


_KEYS = ("family_name", "given_name", "date_of_birth", "father_full_name", "series", "child_family_name", "number")


def _truth_and_produced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = parquet(spark, sf_dir, "lineitem")
    flags, key = F.concat("l_returnflag", "l_linestatus"), pick(_KEYS, F.col("l_linenumber") - 1)
    truth = o.select(pick(("F", "O", "P"), F.col("l_orderkey") % 3).alias("doc_type"), F.col("l_orderkey").alias("doc"), key.alias("key"), F.when(F.col("l_tax") > 0.01, flags).otherwise(" ").alias("value"), (F.col("l_discount") > 0.02).alias("critical"))
    got = F.when(F.col("l_discount") < 0.06, F.lower(flags)).when(F.col("l_discount") < 0.09, F.concat(flags, F.lit("x"))).otherwise("")
    produced = o.where("l_quantity < 45").select(
        F.col("l_orderkey").alias("doc"), key.alias("key"), F.when(F.col("l_quantity") < 20, F.translate(flags, "NOFAR", "НОФАР")).alias("raw"), got.alias("value"), (F.col("l_quantity") > 30).alias("review"), F.when(F.col("l_tax") > 0.06, got).alias("final_value"), F.when(F.col("l_linestatus") == "O", "NO").alias("controlling")
    )
    return truth, produced


_SCORES_SQL = f"""
t AS (SELECT ['F','O','P'][l_orderkey % 3 + 1] AS doc_type, l_orderkey AS doc, {list(_KEYS)}[l_linenumber] AS key, CASE WHEN l_tax > 0.01 THEN l_returnflag || l_linestatus ELSE '' END AS value, l_discount > 0.02 AS critical FROM lineitem),
p AS (SELECT l_orderkey AS doc, {list(_KEYS)}[l_linenumber] AS key, CASE WHEN l_quantity < 20 THEN l_returnflag || l_linestatus END AS spelled, CASE WHEN l_discount < 0.06 THEN lower(l_returnflag || l_linestatus) WHEN l_discount < 0.09 THEN l_returnflag || l_linestatus || 'x' ELSE '' END AS got, l_quantity > 30 AS review, l_tax > 0.06 AS released, CASE WHEN l_linestatus = 'O' THEN 'NO' END AS control FROM lineitem WHERE l_quantity < 45),
j AS (SELECT t.*, coalesce(got, '') AS got, coalesce(review, false) AS review, coalesce(released, false) AND coalesce(got, '') <> '' AND lower(got) <> lower(value) AS wrong_final, got <> '' AND control IS NOT NULL AND lower(got) <> lower(control) AS against,
  got <> '' AND contains(key, 'name') AND lower(got) <> lower(coalesce(control, spelled, got)) AS wrong_spelled FROM t LEFT JOIN p USING (doc, key)),
v AS (SELECT *, CASE WHEN value = '' THEN CASE WHEN got <> '' THEN 'FABRICATED' ELSE 'NA' END WHEN got = '' THEN 'EMPTY' WHEN lower(got) = lower(value) THEN 'EXACT' WHEN review THEN 'REVIEW' ELSE 'WRONG' END AS verdict FROM j),
s AS (SELECT doc_type, doc, count(*) FILTER (critical) AS critical_total, count(*) FILTER (critical AND verdict = 'EXACT') AS exact, count(*) FILTER (critical AND verdict = 'EMPTY') AS empty, count(*) FILTER (critical AND verdict IN ('WRONG','FABRICATED')) AS fabricated, count(*) FILTER (critical AND review) AS reviewed,
  count(*) FILTER (critical AND coalesce(against, false)) AS mrz_conflicts, count(*) FILTER (critical AND wrong_final) AS false_final, count(*) FILTER (critical AND coalesce(wrong_spelled, false)) AS wrong_transliteration, coalesce(avg(CASE WHEN critical AND value <> '' AND got <> '' THEN levenshtein(got, value) / greatest(length(got), length(value)) END), 0)::DOUBLE AS error_rate, (count(*) FILTER (got <> '') / count(*))::DOUBLE AS coverage FROM v GROUP BY ALL)"""


@query(f"WITH {_SCORES_SQL} SELECT * FROM s")
def acceptance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.acceptance_scores(*_truth_and_produced(spark, sf_dir))


@query(f"""WITH {_SCORES_SQL}, g AS (SELECT doc_type, count(*) AS documents, sum(critical_total)::BIGINT AS critical_total, sum(exact)::BIGINT AS exact, sum(empty)::BIGINT AS empty, sum(fabricated)::BIGINT AS fabricated, sum(reviewed)::BIGINT AS reviewed, sum(mrz_conflicts)::BIGINT AS mrz_conflicts, sum(false_final)::BIGINT AS false_final, sum(wrong_transliteration)::BIGINT AS wrong_transliteration FROM s GROUP BY 1)
SELECT *, (CASE WHEN critical_total = 0 THEN 0 ELSE exact / critical_total END)::DOUBLE AS exact_share, concat_ws('|', CASE WHEN fabricated > 0 THEN 'fabricated' END, CASE WHEN false_final > 0 THEN 'false_final' END, CASE WHEN critical_total = 0 OR exact / critical_total < 0.95 THEN 'exact_share' END, CASE WHEN critical_total > 0 AND empty = critical_total THEN 'all_empty' END) AS reasons,
  fabricated = 0 AND false_final = 0 AND critical_total > 0 AND exact / critical_total >= 0.95 AND empty < critical_total AS production_ready FROM g""")
def acceptance_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.acceptance_by_type(canonical.acceptance_scores(*_truth_and_produced(spark, sf_dir))).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"""WITH {_SCORES_SQL}, n AS (SELECT doc, count(*) AS n FROM p GROUP BY 1)
SELECT doc, count(*) AS total, (count(*) FILTER (got <> '') / count(*))::DOUBLE AS coverage, count(*) FILTER (got <> '' AND lower(got) = lower(value)) AS correct, count(*) FILTER (critical) AS critical_total, count(*) FILTER (critical AND got <> '' AND lower(got) = lower(value)) AS critical_correct, count(*) FILTER (critical AND got = '') AS critical_missing,
  count(*) FILTER (critical AND got <> '' AND lower(got) <> lower(value) AND NOT review) AS critical_wrong, (count(*) FILTER (review) / greatest(coalesce(any_value(n), 0), 1))::DOUBLE AS review_rate FROM v LEFT JOIN n USING (doc) GROUP BY doc""")
def benchmark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.benchmark_totals(*_truth_and_produced(spark, sf_dir))


@query("""WITH RECURSIVE d AS (SELECT user_id AS packet, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, (props->>'k')::INTEGER % 4 AS priority, CASE WHEN value > 10 THEN upper(event_type) || ' ' END AS surname, CASE WHEN (props->>'k')::INTEGER % 3 > 0 THEN '19' || (60 + floor(value)::BIGINT % 3)::VARCHAR END AS born, value > 95 AS mm FROM events),
f AS (SELECT packet, 0::BIGINT AS n, NULL::VARCHAR AS surname, -1 AS best, NULL::VARCHAR AS born, false AS nc, false AS dc, false AS mm FROM (SELECT DISTINCT user_id AS packet FROM events) UNION ALL
  SELECT d.packet, d.n, CASE WHEN d.surname IS NOT NULL AND d.priority >= f.best THEN d.surname ELSE f.surname END, CASE WHEN d.surname IS NOT NULL THEN greatest(f.best, d.priority) ELSE f.best END, coalesce(f.born, d.born), f.nc OR coalesce(trim(d.surname) <> trim(f.surname), false), f.dc OR coalesce(d.born <> f.born, false), f.mm OR d.mm FROM f JOIN d ON d.packet = f.packet AND d.n = f.n + 1)
SELECT packet, surname, born, nc AS name_conflict, dc AS date_conflict, mm AS mrz_mismatch, n AS n_documents FROM f QUALIFY row_number() OVER (PARTITION BY packet ORDER BY n DESC) = 1""")
def packet_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, kind = measured()
    rows = parquet(spark, sf_dir, "events").select(
        F.col("user_id").alias("packet"), F.col("event_id").alias("ordinal"), (k % 4).alias("priority"), F.when(v > 10, F.concat(F.upper(kind), F.lit(" "))).alias("surname"),
        F.when(k % 3 > 0, F.concat(F.lit("19"), (60 + F.floor(v) % 3).cast("string"))).alias("born"), (v > 95).alias("mrz_mismatch"),
    )
    return canonical.identity_fold(rows)


@query("""WITH r AS (SELECT user_id AS doc, event_id AS run, CASE WHEN value > 1 THEN md5(CASE WHEN user_id % 3 = 0 THEN 'same' ELSE event_type END) END AS hash, floor(value)::BIGINT % 4 AS n FROM events), f AS (SELECT *, first({'h': hash, 'n': n}) OVER w AS f, row_number() OVER w > 1 AS later FROM r WINDOW w AS (PARTITION BY doc ORDER BY run))
SELECT doc, CASE WHEN any_value(f.n) < 2 THEN 'insufficient_identity_fields' WHEN bool_or(later AND hash IS NULL) THEN 'incomplete' WHEN bool_or(coalesce(later AND hash <> f.h, false)) THEN 'mismatch' ELSE 'agree' END AS status FROM f GROUP BY doc""")
def multi_run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v, kind = measured()
    said = F.when(F.col("user_id") % 3 == 0, "same").otherwise(kind)
    return canonical.agreement(parquet(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("run"), F.when(v > 1, F.md5(said)).alias("hash"), (F.floor(v) % 4).alias("n_fields")))


@query("""WITH d AS (SELECT event_id AS doc, (props->>'k')::INTEGER AS k, value AS v, event_type AS kind FROM events),
r AS (SELECT doc, kind, v, k, list_distinct(list_filter([CASE WHEN k % 13 = 0 THEN 'unknown_document_type' END, CASE WHEN kind = 'view' THEN 'unsupported_document_type' END, CASE WHEN v < 8 THEN 'low_classification_confidence' END, CASE WHEN kind = 'error' AND k % 5 >= 3 THEN 'image_quality_failed' END, CASE WHEN v > 60 THEN 'missing_critical_fields' END, CASE WHEN k % 7 = 0 THEN 'missing_source_evidence' END,
  CASE WHEN v < 3 THEN 'low_ocr_confidence' END, CASE WHEN k > 90 THEN 'missing_critical_fields' END, CASE WHEN k % 9 = 0 THEN 'military_document' END, CASE WHEN k % 10 = 0 THEN 'identity_conflict' END, CASE WHEN kind = 'error' AND v > 30 THEN 'system_error' END, CASE WHEN k = 1 THEN 'user_requested_human_help' END], lambda x: x IS NOT NULL)) AS s FROM d),
o AS (SELECT *, ['image_quality_failed','identity_conflict','missing_critical_fields','unsupported_document_type','unknown_document_type','military_document','low_classification_confidence','low_ocr_confidence','missing_source_evidence','system_error','user_requested_human_help'] AS told FROM r)
SELECT doc, len(s) > 0 AS required, array_to_string(list_sort(s), '|') AS reasons, CASE WHEN len(s) > 0 AND (list_contains(s, 'identity_conflict') OR v > 90 OR (kind = 'purchase' AND v > 20)) THEN 'high' WHEN s = ['user_requested_human_help'] THEN 'low' ELSE 'normal' END AS priority,
  CASE WHEN len(s) = 0 THEN 'mr.not_required' ELSE 'mr.' || list_filter(told, lambda x: list_contains(s, x))[1] END AS message FROM o""")
def manual_review_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, kind = measured()
    signs = F.array_compact(F.array(F.when(k % 9 == 0, "military"), F.when(k % 10 == 0, "identity_conflict")))
    rows = parquet(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc"), F.when(k % 13 == 0, " ").otherwise("passport").alias("document_type"), F.when(kind == "view", "draft").otherwise("active").alias("module_status"), F.when(v < 8, 0.5).otherwise(0.9).alias("classifier_confidence"),
        (kind == "error").alias("image_failed"), (k % 5).alias("image_retries"), F.when(v > 60, 1).otherwise(0).alias("n_missing"), F.when(k % 7 == 0, 2).otherwise(0).alias("n_without_evidence"), F.when(v < 3, 0.2).alias("ocr_confidence"), F.when(k > 90, 1).otherwise(0).alias("n_hard_failures"),
        signs.alias("signs"), F.when((kind == "error") & (v > 30), 1).otherwise(0).alias("n_errors"), (k == 1).alias("asked_help"), (v > 90).alias("urgent"), ((kind == "purchase") & (v > 20)).alias("paid"), F.lit(0).alias("ocr_failures"),
    )
    return canonical.manual_review(rows).withColumn("reasons", F.array_join(F.array_sort("reasons"), "|"))


@query("""WITH a AS (SELECT o_orderkey AS doc, o_orderstatus AS s, o_totalprice AS p, o_custkey AS c, o_orderpriority AS pr FROM orders), b AS (SELECT doc, list_filter([CASE WHEN s = 'P' THEN 'required_field_empty:family_name' END, CASE WHEN c % 10 = 0 THEN 'part7_not_reviewed' END, CASE WHEN pr = '1-URGENT' THEN 'controlling_spelling_conflict:family_name' END, CASE WHEN p < 50000 THEN 'ocr_confidence_too_low:sex' END,
  CASE WHEN length(c::VARCHAR) <> 3 THEN 'invalid_phone_format' END, CASE WHEN s = 'O' THEN 'invalid_email' END], lambda x: x IS NOT NULL) AS b, list_filter([CASE WHEN s = 'F' THEN 'recommended_field_empty:middle_name' END, CASE WHEN p >= 50000 AND p < 70000 THEN 'ocr_confidence_low:sex' END, CASE WHEN c % 4 = 0 THEN 'translation_missing' END], lambda x: x IS NOT NULL) AS w FROM a)
SELECT doc, len(b) = 0 AS mail_ready, array_to_string(b, '|') AS blockers, array_to_string(w, '|') AS warnings FROM b""")
def mail_ready_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, p = F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_totalprice")
    values = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in (
        ("family_name", F.when(s != "P", s)), ("middle_name", F.when(s != "F", s)), ("daytime_phone", F.concat(F.lit("(555) 123-"), F.lit("0"), c.cast("string"))), ("email", F.when(s == "O", "nobody").otherwise("a@b.c")))]))
    rows = parquet(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc"), values.alias("values"), (c % 10 != 0).alias("part7_reviewed"), F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("family_name"))).otherwise(canonical.none()).alias("conflicts"),
        F.create_map(F.lit("sex"), p / 100000).alias("read_confidence"), (c % 4 == 0).alias("untranslated"),
    )
    gate = canonical.mail_ready(rows, ("family_name",), ("middle_name",))
    return gate.withColumn("blockers", F.array_join("blockers", "|")).withColumn("warnings", F.array_join("warnings", "|"))


@query("""WITH p AS (SELECT p_partkey AS id, ['ua_birth_certificate','ua_marriage_certificate','ua_military_id','other'][p_size % 4 + 1] AS form, p_retailprice * p_size * 40 AS bytes, p_type FROM part), k AS (SELECT *, CASE form WHEN 'ua_birth_certificate' THEN 'birth_certificate_handwritten' WHEN 'ua_marriage_certificate' THEN 'marriage_apostille' WHEN 'ua_military_id' THEN 'military_id' ELSE 'unknown_document' END AS kind FROM p)
SELECT id, kind, CASE WHEN bytes > 2000000 THEN 'resize' WHEN bytes < CASE WHEN kind = 'marriage_apostille' THEN 300000 ELSE 100000 END THEN 'needs_better_scan' ELSE 'proceed' END AS action, CASE WHEN kind IN ('birth_certificate_handwritten','marriage_apostille') AND p_type <> 'ECONOMY' THEN 'family_name,given_name,patronymic' ELSE '' END AS ungrounded FROM k""")
def document_class_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = pick(("ua_birth_certificate", "ua_marriage_certificate", "ua_military_id", "other"), F.col("p_size") % 4)
    keys = F.when(F.col("p_type") == "ECONOMY", F.array(F.lit("family_name"), F.lit("child_family_name"))).otherwise(F.array(F.lit("family_name")))
    rows = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), canonical.document_class(form).alias("kind"), (F.col("p_retailprice") * F.col("p_size") * 40).alias("bytes"), keys.alias("keys"))
    return rows.select("id", "kind", canonical.image_action(F.col("kind"), F.col("bytes")).alias("action"), F.array_join(canonical.ungrounded_roles(F.col("kind"), F.col("keys")), ",").alias("ungrounded"))


@query("""SELECT l_orderkey AS doc, l_linenumber AS n, CASE WHEN l_quantity < 5 OR l_discount * 3000 < 40 OR l_discount * 3000 > 245 OR l_extendedprice / 10 < 600 THEN 'RESHOOT_REQUIRED' WHEN l_quantity < 12 OR l_discount * 3000 < 70 OR l_discount * 3000 > 235 OR l_extendedprice / 10 < 900 THEN 'DEGRADED_REVIEW' ELSE 'ACCEPT' END AS decision FROM lineitem""")
def image_quality_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = canonical.image_quality(F.col("l_quantity"), F.col("l_discount") * 3000, F.col("l_extendedprice") / 10, F.col("l_extendedprice"))
    return parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), decision.alias("decision"))


@query("""WITH f AS (SELECT user_id AS doc, event_id, ['family_name','family_name_latin','last_entry','last_entry_date','i94_date_of_entry'][(props->>'k')::INTEGER % 5 + 1] AS key, event_type AS raw, CASE WHEN value > 20 THEN upper(event_type) END AS norm, CASE WHEN value > 30 THEN ' ' || event_type || event_id::VARCHAR || ' ' END AS final, value > 10 AS finalized, event_type = 'click' AS review FROM events),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc, key ORDER BY event_id DESC) = 1), v AS (SELECT *, CASE WHEN finalized THEN trim(final) ELSE coalesce(norm, raw) END AS value, CASE WHEN key LIKE 'family%' THEN 'family_name' ELSE 'i94_date_of_entry' END AS p, CASE key WHEN 'family_name' THEN 0 WHEN 'i94_date_of_entry' THEN 0 WHEN 'family_name_latin' THEN 1 WHEN 'last_entry_date' THEN 2 ELSE 3 END AS rank FROM o),
b AS (SELECT doc, p, first({'v': value, 'k': key, 'r': review} ORDER BY value IS NULL, rank) AS b, bool_or(review) FILTER (rank = 0) AS own FROM v GROUP BY ALL) SELECT doc, p AS key, b.v AS value, CASE WHEN b.v IS NOT NULL THEN b.k END AS matched_key, CASE WHEN b.v IS NOT NULL THEN b.r ELSE coalesce(own, false) END AS review FROM b""")
def value_with_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, kind = measured()
    row = F.struct(kind.alias("raw"), F.when(v > 20, F.upper(kind)).alias("normalized"), F.when(v > 30, F.concat(F.lit(" "), kind, F.col("event_id").cast("string"), F.lit(" "))).alias("final"), (v > 10).alias("finalized"), (kind == "click").alias("review"))
    rows = parquet(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), pick(("family_name", "family_name_latin", "last_entry", "last_entry_date", "i94_date_of_entry"), k % 5).alias("key")).agg(F.max_by(row, "event_id").alias("r"))
    return canonical.released_value(rows.select("doc", "key", "r.*"), {"family_name": ("family_name_latin",), "i94_date_of_entry": ("date_of_last_entry", "last_entry_date", "last_entry")})


@query("""WITH d AS (SELECT l_orderkey AS doc, ['date_of_birth','date_of_issue','date_of_expiry'][l_linenumber] AS role, date_trunc('month', l_shipdate)::DATE AS value FROM lineitem WHERE l_linenumber <= 3), o AS (SELECT doc, role, min(value) AS value FROM d GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY doc, value) > 1 AS shared, min(value) FILTER (role = 'date_of_issue') OVER (PARTITION BY doc) < min(value) FILTER (role = 'date_of_birth') OVER (PARTITION BY doc) AS early FROM o)
SELECT doc, role, value::VARCHAR AS value, concat_ws('|', CASE WHEN shared THEN 'date_role_conflict' END, CASE WHEN early AND role <> 'date_of_expiry' THEN 'date_sequence_conflict' END) AS reasons FROM w""")
def date_sequence_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("doc"), pick(("date_of_birth", "date_of_issue", "date_of_expiry"), F.col("l_linenumber") - 1).alias("role")).agg(F.min(F.trunc("l_shipdate", "month")).alias("value"))
    return canonical.sequence_conflicts(rows).withColumn("reasons", F.array_join("reasons", "|")).withColumn("value", F.col("value").cast("string"))


@query("""WITH l AS (SELECT p_partkey AS doc, unnest(string_split(p_name, ' ')) AS field FROM part), c AS (SELECT doc, field, p_brand AS d, CASE WHEN p_size % 5 > 0 THEN CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END END AS c, p_size % 2 = 0 AS fixed, 'bought ' || p_type || ' of ' || CASE WHEN p_size > 20 THEN p_brand ELSE '' END AS t, p_size AS z FROM l JOIN part ON p_partkey = doc),
f AS (SELECT doc, field, CASE WHEN z % 7 = 0 THEN ['critical_field_missing_in_draft'] WHEN c IS NULL THEN ['critical_field_missing_in_confirmed'] ELSE list_filter([CASE WHEN NOT contains(t, c) THEN 'critical_field_missing_in_final' END, CASE WHEN c <> d AND NOT fixed THEN 'value_changed_after_confirm' END], lambda x: x IS NOT NULL) END AS f FROM c) SELECT doc, field, unnest(f) AS finding FROM f""")
def source_to_final_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = parquet(spark, sf_dir, "part"), F.col("p_size")
    critical = p.select(F.col("p_partkey").alias("doc"), F.explode(F.split("p_name", " ")).alias("field"))
    both = critical.distinct().join(p.withColumnRenamed("p_partkey", "doc"), "doc")
    draft = both.where(size % 7 != 0).select("doc", "field", F.col("p_brand").alias("value"), (size % 2 == 0).alias("user_corrected"))
    confirmed = both.select("doc", "field", F.when(size % 5 > 0, F.when(size % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand"))).alias("value"))
    final = p.select(F.col("p_partkey").alias("doc"), F.concat(F.lit("bought "), "p_type", F.lit(" of "), F.when(size > 20, F.col("p_brand")).otherwise("")).alias("text"))
    return joins.final_text_audit(critical, draft, confirmed, final)


_WORDS_SQL = "SELECT p_partkey AS id, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'абцдефґгіїклмнопярстюєшийз') AS w FROM part"


@query(f"WITH t AS ({_WORDS_SQL}) SELECT id, regexp_matches(w, '[іїєґ]') AND NOT regexp_matches(w, '[ыэёъ]') AS ukrainian, CASE WHEN regexp_matches(w, '[іїєґ]') THEN 'ua' ELSE 'unknown' END AS script FROM t")
def name_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "абцдефґгіїклмнопярстюєшийз")
    return parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (text.name_script(w) == "ua").alias("ukrainian"), text.name_script(w).alias("script"))


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\S+')) AS v, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS position FROM conversations)
SELECT conv_id, turn, position, length(v) BETWEEN 2 AND 50 AND regexp_matches(v, '(?i)[aeiouy]') AND NOT regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '\p{Ll}\p{Lu}') AS plausible, length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 2 AND regexp_full_match(regexp_replace(v, '[^A-Za-z]', '', 'g'), '[ABCEHIKMOPTXYaceiopxy]*') AS lookalike,
  concat_ws('|', CASE WHEN length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 2 AND regexp_full_match(regexp_replace(v, '[^A-Za-z]', '', 'g'), '[ABCEHIKMOPTXYaceiopxy]*') THEN 'latin_lookalike_substitution_suspected' END, CASE WHEN length(v) >= 3 AND regexp_matches(v, '[a-z][A-Z]') THEN 'abnormal_casing_detected' END) AS doubts FROM w""")
def name_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = parquet(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("position", "v"))
    return words.select("conv_id", "turn", F.col("position").cast("long").alias("position"), text.plausible_name(F.col("v")).alias("plausible"), places.lookalike(F.col("v")).alias("lookalike"), F.array_join(places.name_doubts(F.col("v")), "|").alias("doubts"))


_REGION_FORMS = ("ої області", "ій обл.", "а область", "ою обл", "у")


@query("""WITH r AS (SELECT c_custkey AS id, ['вінницьк','львівськ','одеськ','київськ','івано-франківськ','невідомськ'][c_nationkey % 6 + 1] AS stem, ['Vinnytsia','Lviv','Odesa','Kyiv','Ivano-Frankivsk',NULL][c_nationkey % 6 + 1] AS latin FROM customer)
SELECT id, stem || 'а область' AS nominative, latin || ' Oblast' AS english FROM r WHERE latin IS NOT NULL UNION ALL SELECT id, NULL, NULL FROM r WHERE latin IS NULL""")
def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in five cases and spellings."""
    stem = pick(("вінницьк", "ЛЬВІВСЬК", "Одеськ", "київськ", "Івано-Франківськ", "невідомськ"), F.col("c_nationkey") % 6)
    rows = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), places.region(F.concat(stem, pick(_REGION_FORMS, F.floor(F.abs("c_acctbal")) % 5))).alias("r"))
    return rows.select("id", "r.nominative", "r.english")


@query("""SELECT c_custkey AS id, [CASE WHEN c_acctbal > 0 THEN 'village' END, 'urban-type settlement', 'settlement', NULL, 'khutor'][c_nationkey % 5 + 1] AS designator FROM customer""")
def settlement_designators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single letter stands for a village only before a capital."""
    name = F.when(F.col("c_acctbal") > 0, "Вишневе").otherwise("вишневе")
    written = F.concat(pick(("с. ", "смт ", "селище ", "місто ", "Хутір "), F.col("c_nationkey") % 5), name)
    return parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), places.designator(written).alias("designator"))


@query("""WITH s AS (SELECT c_custkey AS id, [' Ч','жін','M','female','?'][c_nationkey % 5 + 1] AS raw, ['Male','Female','Male','Female',NULL][c_nationkey % 5 + 1] AS v FROM customer) SELECT id, coalesce(v, raw) AS value, CASE WHEN v IS NULL THEN 0.5 ELSE 0.99 END::DOUBLE AS confidence, v IS NULL AS review FROM s""")
def sex_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), places.sex(pick((" Ч", "жін", "M", "female", "?"), F.col("c_nationkey") % 5)).alias("s"))
    return rows.select("id", "s.*")


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_type) ELSE p_name END AS value, CASE WHEN p_size > 25 THEN 0.99 ELSE 0.9 END::DOUBLE AS confidence, p_size > 25 AND lower(p_name) <> lower(p_type) AS review, NOT contains(p_type, 'Militia') AS allowed FROM part""")
def controlled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a controlling spelling in some documents."""
    control = F.when(F.col("p_size") > 25, F.upper("p_type"))
    rows = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), places.personal_name(F.col("p_name"), control).alias("n"), places.output_allowed(F.col("p_type")).alias("allowed"))
    return rows.select("id", "n.*", "allowed")


@query("""WITH n AS (SELECT o_orderkey AS id, lpad(o_orderkey::VARCHAR, 7, 'B') AS s, round(o_totalprice / 500000, 4) AS p FROM orders), c AS (SELECT id, p, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) - 1 AS i FROM n),
r AS (SELECT id, i, c, CASE c WHEN '0' THEN ['O','Ø'] WHEN '1' THEN ['I','l'] WHEN '6' THEN list_filter([CASE WHEN p < 0.92 THEN '5' END, '9', CASE WHEN p < 0.92 THEN 'G' END], lambda x: x IS NOT NULL) WHEN '9' THEN ['6'] WHEN '4' THEN ['A'] WHEN '2' THEN ['Z'] WHEN '3' THEN CASE WHEN p < 0.92 THEN ['8'] END WHEN '8' THEN CASE WHEN p < 0.92 THEN ['3','B'] END
  WHEN '5' THEN CASE WHEN p < 0.92 THEN ['6'] END WHEN '7' THEN CASE WHEN p < 0.95 THEN ['Z'] END WHEN 'B' THEN CASE WHEN p < 0.92 THEN ['8'] END END AS k FROM c) SELECT id, i AS position, array_to_string(k, ',') AS candidates FROM r WHERE len(k) > 0""")
def ambiguous_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(F.col("o_orderkey").cast("string"), 7, "B")
    sure = F.array_repeat(F.round(F.col("o_totalprice") / 500000, 4), F.length(number))
    rows = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(places.ambiguous_digits(number, sure)).alias("a"))
    return rows.select("id", F.col("a.position").cast("long").alias("position"), F.array_join("a.candidates", ",").alias("candidates"))


@query("""WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS n, ['date_of_birth','date_of_issue','date_of_expiry','date_of_marriage','date_of_death','act_record_date','name'][l_linenumber] AS field, ['Child_Block 2','issue_block','validity_block','MAIN_BLOCK','footer_block'][l_quantity::INTEGER % 5 + 1] AS zone FROM lineitem)
SELECT doc, n, CASE field WHEN 'date_of_birth' THEN zone = 'Child_Block 2' WHEN 'date_of_issue' THEN zone IN ('issue_block','validity_block','footer_block') WHEN 'date_of_expiry' THEN zone = 'validity_block' WHEN 'date_of_marriage' THEN zone = 'MAIN_BLOCK' WHEN 'date_of_death' THEN zone = 'MAIN_BLOCK' WHEN 'act_record_date' THEN false END AS in_zone FROM f""")
def date_zone_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = pick(("date_of_birth", "date_of_issue", "date_of_expiry", "date_of_marriage", "date_of_death", "act_record_date", "name"), F.col("l_linenumber") - 1)
    zone = pick(("Child_Block 2", "issue_block", "validity_block", "MAIN_BLOCK", "footer_block"), F.col("l_quantity").cast("int") % 5)
    return parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), places.date_in_zone(field, zone).alias("in_zone"))


@query("""WITH l AS (SELECT c_custkey AS id, rpad('P<UKR' || c_mktsegment || '<<ANNA', CASE WHEN c_nationkey % 2 = 0 THEN 44 ELSE 36 END, '<') AS one, lpad(c_custkey::VARCHAR, 9, '0') || '0UKR7001011F3001010' || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE repeat('<', 16) END AS two FROM customer)
SELECT id, CASE WHEN id % 4 > 0 THEN rpad(one, 44, '<') END AS line_one, CASE WHEN id % 4 > 0 THEN rpad(two, 44, '<') END AS line_two, CASE WHEN id % 4 = 0 THEN 'no_mrz_lines' WHEN length(one) = 44 AND length(two) = 44 THEN 'check_digit_failed' WHEN length(one) = 44 OR length(two) = 44 THEN 'partial_mrz_lines' ELSE 'no_mrz_lines' END AS status
FROM (SELECT id, one, CASE WHEN contains(two, '<') THEN two ELSE two || '<' END AS two FROM l)""")
def machine_lines_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passport lines between other lines of a scan, some cut short."""
    n, i = F.col("c_nationkey"), F.col("c_custkey")
    one = F.when(n % 2 == 0, F.rpad(F.concat(F.lit("P<UKR"), "c_mktsegment", F.lit("<<ANNA")), 44, "<")).otherwise(F.rpad(F.concat(F.lit("P<UKR"), "c_mktsegment", F.lit("<<ANNA")), 36, "<"))
    two = F.concat(F.lpad(i.cast("string"), 9, "0"), F.lit("0UKR7001011F3001010"), F.when(n % 3 == 0, "<").otherwise("<" * 16))
    scan = F.concat(F.lit("PASSPORT\r\nname of holder\n"), F.when(i % 4 > 0, F.concat_ws("\n", one, two)).otherwise("nothing"), F.lit("\nend"))
    rows = parquet(spark, sf_dir, "customer").select(i.alias("id"), scan.alias("scan"))
    lines = places.machine_lines(F.col("scan"))
    return rows.select("id", F.get(lines, 0).alias("line_one"), F.get(lines, 1).alias("line_two"), places.machine_status(F.col("scan"), F.lit(False)).alias("status"))


@query("""WITH s AS (SELECT event_id AS id, user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, ['pending','queued','assigned','in_review','cancelled','rejected','completed'][floor(value)::BIGINT % 7 + 1] AS status FROM events), c AS (SELECT *, CASE status WHEN 'pending' THEN 'queued' WHEN 'cancelled' THEN 'rejected' ELSE status END AS c FROM s), l AS (SELECT *, lag(c) OVER (PARTITION BY key ORDER BY n) AS before FROM c)
SELECT id, status, CASE WHEN before IS NULL THEN c = 'queued' ELSE before || '>' || c IN ('queued>assigned','queued>in_review','queued>rejected','assigned>in_review','assigned>rejected','in_review>rejected') END AS valid FROM l""")
def ticket_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v, _ = measured()
    rows = parquet(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_id").alias("ordinal"), pick(("pending", "queued", "assigned", "in_review", "cancelled", "rejected", "completed"), F.floor(v) % 7).alias("status"))
    return timing.ticket_audit(rows, "key").select("id", "status", "valid")


@query("""WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, value FROM events), q AS (SELECT key, id, n, (n - 1) // 2 + CASE WHEN value > 90 THEN 1 ELSE 0 END AS expected FROM r),
f AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS id, 0::BIGINT AS newest, NULL::BIGINT AS stored FROM (SELECT DISTINCT key FROM q) UNION ALL SELECT q.key, q.n, q.id, CASE WHEN q.expected = f.newest THEN f.newest + 1 ELSE f.newest END, CASE WHEN q.expected = f.newest THEN f.newest + 1 END FROM f JOIN q ON q.key = f.key AND q.n = f.n + 1)
SELECT id, stored AS stored_version FROM f WHERE n > 0""")
def append_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to append a version, of which some are out of date at their turn."""
    _, v, _ = measured()
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = parquet(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_id").alias("ordinal"), (F.floor((n - 1) / 2) + F.when(v > 90, 1).otherwise(0)).cast("long").alias("expected"))
    return timing.optimistic_appends(rows).select("id", "stored_version")


@query("""SELECT event_id AS id, CASE WHEN event_type = 'view' OR value < 1 THEN false ELSE epoch_us(TIMESTAMP '2024-02-01' - ts) > 20 * 86400000000 END AS expired FROM events""")
def draft_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft without a valid time is kept."""
    _, v, kind = measured()
    saved = F.when(kind == "view", F.lit(None).cast("string")).when(v < 1, "soon").otherwise(F.col("ts").cast("string"))
    return parquet(spark, sf_dir, "events").select(F.col("event_id").alias("id"), timing.draft_expired(saved, F.lit("2024-02-01 00:00:00").cast("timestamp"), 20 * 86400).alias("expired"))
