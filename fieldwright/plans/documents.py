"""Queries on batteries of rules by kind of document, registries, dates and guidance, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.functions import dates, places, text
from fieldwright.operators import extract, joins, rules
from fieldwright.plans.adapters import pick
from fieldwright.plans.register import query
from fieldwright.sources import tables
from fieldwright.sources.tables import parquet, spread

_ZONES = ("act_record", "issue", "father", "mother", "russian_layer", "cyrillic")


def _fields(spark: SparkSession, sf_dir: str, names: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """Order lines as a document's fields: the line number names the field, parts and suppliers give zone and tokens."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    said = F.when(p % 10 == 0, None)
    for name, v in values.items():
        said = said.when(n == names.index(name) + 1, v)
    return parquet(spark, sf_dir, "lineitem").where(n <= len(names)).select(
        F.col("l_orderkey").alias("doc"), pick(names, n - 1).alias("field"), said.otherwise((s % 5).cast("string")).alias("value"), F.when(p % 13 != 0, pick(_ZONES, p % 6)).alias("zone"),
        F.when(s % 6 == 0, F.array().cast("array<string>")).otherwise(F.array((s % 7).cast("string"), (p % 7).cast("string"))).alias("ocr_ids"),
    )


def _sql(names: tuple[str, ...], values: dict[str, str], found: list[str]) -> str:
    case = " ".join(f"WHEN l_linenumber = {names.index(n) + 1} THEN {v}" for n, v in values.items())
    return f"""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, CASE WHEN l_partkey % 10 = 0 THEN NULL {case} ELSE (l_suppkey % 5)::VARCHAR END AS value, CASE WHEN l_partkey % 13 <> 0 THEN {list(_ZONES)}[l_partkey % 6 + 1] END AS zone,
  CASE WHEN l_suppkey % 6 = 0 THEN [] ELSE [(l_suppkey % 7)::VARCHAR, (l_partkey % 7)::VARCHAR] END AS ids FROM lineitem WHERE l_linenumber <= {len(names)}),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc, n ORDER BY value NULLS FIRST, zone NULLS FIRST, ids) = 1) """ + " UNION ALL ".join(found)


def _one(names: tuple[str, ...], field: str, on: str, reason: str) -> str:
    return f"SELECT doc, '{reason}' AS reason FROM f WHERE n = {names.index(field) + 1} AND {on}"


def _two(names: tuple[str, ...], a: str, b: str, on: str, reason: str) -> str:
    return f"SELECT a.doc, '{reason}' AS reason FROM f a JOIN f b ON a.doc = b.doc AND a.n = {names.index(a) + 1} AND b.n = {names.index(b) + 1} AND {on}"


def _gone(names: tuple[str, ...], field: str, reason: str) -> str:
    return f"SELECT DISTINCT doc, '{reason}' AS reason FROM f WHERE doc NOT IN (SELECT doc FROM f WHERE n = {names.index(field) + 1} AND value IS NOT NULL)"


_B = ("certificate_number", "act_record_number", "act_record_date", "date_of_issue", "father_name", "child_name", "issuing_authority")
_BIRTH_SQL = _sql(_B, {"father_name": "['Петренку','Іван','Шевченка'][l_suppkey % 3 + 1]", "child_name": "['Іван','Iван','Ivan'][l_suppkey % 3 + 1]", "issuing_authority": "['ЗАГС м. Бар','ЗАГС і ДРАЦС','відділ ХХЗ'][l_suppkey % 3 + 1]"}, [
    _two(_B, _B[0], _B[1], "trim(a.value) = trim(b.value)", "certificate_number_equals_act_record_number"), _two(_B, _B[0], _B[1], "a.zone = b.zone", "certificate_number_and_act_record_number_same_zone"),
    _two(_B, _B[0], _B[1], "list_has_any(a.ids, b.ids)", "certificate_number_and_act_record_number_share_ocr_ids"), _gone(_B, "act_record_date", "act_record_date_missing"), _one(_B, "act_record_date", "zone <> 'act_record'", "act_record_date_wrong_zone"),
    _one(_B, "act_record_date", "zone IS NULL", "act_record_date_zone_not_verified"), _two(_B, "act_record_date", "date_of_issue", "list_has_any(a.ids, b.ids)", "act_record_date_shares_tokens_with_date_of_issue"),
    _gone(_B, "date_of_issue", "date_of_issue_missing"), _one(_B, "date_of_issue", "zone <> 'issue'", "date_of_issue_wrong_zone"), _one(_B, "date_of_issue", "zone IS NULL", "date_of_issue_zone_not_verified"), _one(_B, "father_name", "zone = 'mother'", "father_name_from_mother"),
    _one(_B, "father_name", "value IN ('Петренку','Шевченка')", "father_name_oblique_case_detected"), _one(_B, "child_name", "value = 'Iван'", "child_name_mixed_script"), _gone(_B, "issuing_authority", "issuing_authority_missing"),
    _one(_B, "issuing_authority", "value = 'ЗАГС і ДРАЦС'", "civil_registry_modernization_conflict"), _one(_B, "issuing_authority", "value = 'відділ ХХЗ'", "civil_registry_abbreviation_not_verified"), _one(_B, "child_name", "value IS NOT NULL AND len(ids) = 0", "child_name_no_ocr_evidence"),
    _one(_B, "child_name", "zone = 'russian_layer' AND value IS NOT NULL", "child_name_russian_fallback"),
])


@query(_BIRTH_SQL)
def birth_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    values = {"father_name": pick(("Петренку", "Іван", "Шевченка"), s % 3), "child_name": pick(("Іван", "Iван", "Ivan"), s % 3), "issuing_authority": pick(("ЗАГС м. Бар", "ЗАГС і ДРАЦС", "відділ ХХЗ"), s % 3)}
    return rules.findings(_fields(spark, sf_dir, _B, values), rules.BATTERIES["birth_certificate"])


_D = ("certificate_number", "act_record_number", "date_of_divorce", "basis_of_divorce", "court", "surname_before", "surname_after")
_DIVORCE_SQL = _sql(_D, {"basis_of_divorce": "['за згодою','ст. 105 кодексу',repeat('слово ', 31)][l_suppkey % 3 + 1]"}, [
    _two(_D, _D[0], _D[1], "trim(a.value) = trim(b.value)", "certificate_number_equals_act_record_number"), _two(_D, _D[0], _D[1], "a.zone = b.zone", "certificate_number_and_act_record_number_same_zone"),
    _two(_D, _D[0], _D[1], "list_has_any(a.ids, b.ids)", "certificate_number_and_act_record_number_share_ocr_ids"), _gone(_D, "act_record_number", "act_record_number_missing"), _one(_D, "date_of_divorce", "zone <> 'event'", "date_of_divorce_wrong_zone"),
    _one(_D, "date_of_divorce", "zone IS NULL", "date_of_divorce_zone_not_verified"), _gone(_D, "basis_of_divorce", "basis_of_divorce_missing"), _one(_D, "basis_of_divorce", "value LIKE 'слово%'", "complex_legal_basis"),
    _one(_D, "basis_of_divorce", "value LIKE 'ст.%'", "legal_text_reference_detected"), _one(_D, "court", "value IS NOT NULL AND len(ids) = 0", "court_no_ocr_evidence"),
    _two(_D, "surname_before", "surname_after", "a.value = b.value AND a.zone IS NOT DISTINCT FROM b.zone", "before_after_surname_identical_in_same_zone"),
])


@query(_DIVORCE_SQL)
def divorce_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = pick(("за згодою", "ст. 105 кодексу", "слово " * 31), F.col("l_suppkey") % 3)
    return rules.findings(_fields(spark, sf_dir, _D, {"basis_of_divorce": basis}), rules.BATTERIES["divorce_certificate"])


_I = ("document_number", "record_number", "issuing_state", "personal_number", "surname")
_CARD_SQL = _sql(_I, {"document_number": "['123456789','19900101123456','12'][l_suppkey % 3 + 1]", "record_number": "['19900101123456','123456789','12'][l_suppkey % 3 + 1]", "issuing_state": "['UKR','ukr ','POL'][l_suppkey % 3 + 1]", "personal_number": "['1234567890','12'][l_suppkey % 2 + 1]", "surname": "['Ivan','Iван','Ivan’ko'][l_suppkey % 3 + 1]"}, [
    "SELECT DISTINCT doc, 'mrz_lines_missing' AS reason FROM f", _two(_I, _I[0], _I[1], "trim(a.value) = trim(b.value)", "document_number_equals_record_number"), _two(_I, _I[0], _I[1], "a.zone = b.zone", "document_number_and_record_number_same_zone"),
    _two(_I, _I[0], _I[1], "list_has_any(a.ids, b.ids)", "document_number_and_record_number_share_ocr_ids"), _one(_I, "document_number", "length(value) = 14", "document_number_appears_to_be_record_number"), _one(_I, "record_number", "length(value) = 9", "record_number_appears_to_be_document_number"),
    _gone(_I, "issuing_state", "issuing_state_missing"), _one(_I, "issuing_state", "value = 'POL'", "issuing_state_not_ukr"), _gone(_I, "personal_number", "personal_number_absent"), _one(_I, "personal_number", "length(value) = 2", "personal_number_format_invalid"),
    _one(_I, "personal_number", "length(value) = 10", "personal_number_always_review"), _one(_I, "surname", "value = 'Iван'", "surname_mixed_script"), _one(_I, "surname", "value = 'Ivan’ko'", "surname_likely_retransliterated"), _one(_I, "surname", "zone = 'cyrillic'", "surname_from_cyrillic_zone"),
    _one(_I, "document_number", "value IS NOT NULL AND len(ids) = 0", "document_number_no_ocr_evidence"),
])


@query(_CARD_SQL)
def id_card_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    values = {
        "document_number": pick(("123456789", "19900101123456", "12"), s % 3), "record_number": pick(("19900101123456", "123456789", "12"), s % 3), "issuing_state": pick(("UKR", "ukr ", "POL"), s % 3),
        "personal_number": pick(("1234567890", "12"), s % 2), "surname": pick(("Ivan", "Iван", "Ivan’ko"), s % 3),
    }
    return rules.findings(_fields(spark, sf_dir, _I, values), rules.BATTERIES["id_card"])


@query("""SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'act_record_number' END, CASE WHEN p_type = 'ECONOMY' THEN 'child_patronymic' END) AS mislabelled FROM part""")
def forbidden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(F.lit("act_record_number"), F.when(F.col("p_size") % 3 == 0, "Certificate Number").otherwise("Act record"), F.lit("child_patronymic"), F.when(F.col("p_type") == "ECONOMY", "Middle Name").otherwise("Patronymic"))
    return parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(rules.mislabelled(labels), ",").alias("mislabelled"))


@query("""WITH d AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, o_orderdate AS t, day(o_orderdate)::VARCHAR || ' ' || strftime(o_orderdate, '%B %Y') AS v FROM orders)
SELECT id, CASE WHEN k < 3 THEN v END AS value, k <> 0 AND k <> 2 AS review, CASE k WHEN 1 THEN 'russian_month_fallback' WHEN 3 THEN 'partial_date_unreadable' END AS reason FROM d""")
def certificate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    worded = lambda months: F.concat_ws(" ", F.day(d).cast("string"), pick(months, F.month(d) - 1), F.year(d).cast("string"))
    said = F.when(k == 0, worded(dates.MONTHS_UA)).when(k == 1, worded(dates.MONTHS_RU)).when(k == 2, F.date_format(d, "dd.MM.yyyy")).otherwise("п'ятого травня")
    return parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.certificate_date(said).alias("d")).select("id", "d.*")


@query("""SELECT c_custkey AS id, 'ID' AS document_type, 'UKR' AS issuing_state, lpad(c_custkey::VARCHAR, 9, '0') AS document_number, c_mktsegment AS surname, 'ANNA' AS given_names, '1970-01-0' || (c_nationkey % 9 + 1)::VARCHAR AS date_of_birth, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_nationkey % 5 <> 0 AS checks_ok FROM customer""")
def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards' three lines made from customers, some with a broken check digit, and read again."""
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    signed = lambda c: F.concat(c, text.check_digit(c).cast("string"))
    one = F.rpad(F.concat(F.lit("IDUKR"), signed(F.lpad(i.cast("string"), 9, "0"))), 30, "<")
    two = F.rpad(F.concat(signed(F.concat(F.lit("70010"), (n % 9 + 1).cast("string"))), F.when(n % 2 == 0, "F").otherwise("M"), signed(F.lit("300101")), F.lit("UKR")), 29, "<")
    rows = spread(parquet(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    lines = rows.select(i.alias("id"), one.alias("one"), two.alias("body"), F.rpad(F.concat("c_mktsegment", F.lit("<<ANNA")), 30, "<").alias("three"), n.alias("n"))
    last = F.pmod(text.check_digit(F.concat("one", "body")) + F.when(F.col("n") % 5 == 0, 1).otherwise(0), F.lit(10))
    lines = lines.select("id", "one", F.concat("body", last.cast("string")).alias("two"), "three")
    read = extract.machine_fields(lines, ["id"], dates.mrz_td1(F.col("one"), F.col("two"), F.col("three")))
    return read.select("id", "document_type", "issuing_state", "document_number", "surname", "given_names", "date_of_birth", "sex", "checks_ok")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"), F.col("p_name").alias("key_uk"), F.concat(F.lit("ru "), "p_name").alias("key_ru"), F.array(F.reverse("p_name")).alias("aliases"), F.concat("p_brand", F.lit(" "), "p_name").alias("official_en"),
        F.when(F.col("p_size") % 4 == 0, F.lit("1995-01-01").cast("date")).alias("valid_from"), F.when(F.col("p_size") % 5 == 0, F.lit("1998-12-31").cast("date")).alias("valid_until"),
        pick(("high", "medium", "low"), F.col("p_size") % 3).alias("confidence_rule"), F.when(F.col("p_size") % 7 == 0, "always_review").alias("review_rule"), F.col("p_partkey").alias("ordinal"),
    )


_REGISTRY_SQL = """
reg AS (SELECT p_type AS category, p_partkey AS ordinal, p_brand || ' ' || p_name AS official, CASE WHEN p_size % 4 = 0 THEN DATE '1995-01-01' END AS vf, CASE WHEN p_size % 5 = 0 THEN DATE '1998-12-31' END AS vu, ['high','medium','low'][p_size % 3 + 1] AS conf, p_size % 7 = 0 AS forced, unnest([p_name, 'ru ' || p_name, reverse(p_name)]) AS key FROM part)"""


@query(f"""WITH {_REGISTRY_SQL}, l AS (SELECT o_orderkey AS lookup_id, ['ECONOMY','PROMO','SMALL'][o_custkey % 3 + 1] AS category, CASE o_orderkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'ru  ' || p_name WHEN 2 THEN reverse(p_name) ELSE p_name || '?' END AS term, CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate::DATE END AS day FROM orders JOIN part ON p_partkey = o_custkey),
j AS (SELECT lookup_id, official, conf, forced, ordinal, day IS NULL OR ((vf IS NULL OR vf <= day) AND (vu IS NULL OR day <= vu)) AS fits FROM l LEFT JOIN reg ON reg.category = l.category AND reg.key = regexp_replace(l.term, ' +', ' ', 'g')),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lookup_id ORDER BY NOT fits, ordinal) = 1)
SELECT lookup_id, official, CASE WHEN official IS NULL THEN 0 WHEN conf = 'high' THEN 0.95 WHEN conf = 'low' THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence, official IS NULL OR NOT fits OR forced AS review, official IS NOT NULL AS matched FROM b""")
def registry_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("o_orderkey"), F.col("p_name")
    term = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.concat(F.lit("ru  "), name)).when(k % 4 == 2, F.reverse(name)).otherwise(F.concat(name, F.lit("?")))
    rows = parquet(spark, sf_dir, "orders").join(parquet(spark, sf_dir, "part"), F.col("p_partkey") == F.col("o_custkey"))
    lookups = rows.select(k.alias("lookup_id"), pick(("ECONOMY", "PROMO", "SMALL"), F.col("o_custkey") % 3).alias("category"), term.alias("term"), F.when(k % 6 > 0, F.to_date("o_orderdate")).alias("at"))
    return joins.registry_lookup(lookups, _registry(spark, sf_dir))


@query("""WITH a AS (SELECT c_custkey AS id, ['Шевченківський РАЦС','відділ міліції','Національна поліція','УМВС України','ДМС','міграційна служба','Вінницька міська рада'][c_nationkey % 7 + 1] AS t, ['CIVIL_REGISTRY','MILITSIYA','NPU','UMVS',NULL,'DMS','MISKRADA'][c_nationkey % 7 + 1] AS key, ['Civil Registry Office (ZAHS)','Militsiya','National Police of Ukraine','Regional Department of MIA',NULL,'State Migration Service of Ukraine','City Council'][c_nationkey % 7 + 1] AS v FROM customer)
SELECT id, key, coalesce(v, t) AS value, CASE WHEN v IS NULL THEN 0.4 ELSE 0.92 END::DOUBLE AS confidence, v IS NULL AS review FROM a""")
def authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick(("Шевченківський РАЦС", "відділ міліції", "Національна поліція", "УМВС України", "ДМС", "міграційна служба", "Вінницька міська рада"), F.col("c_nationkey") % 7)
    return parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), places.authority(said).alias("a")).select("id", "a.*")


@query("""WITH p AS (SELECT c_custkey AS id, c_acctbal > 5000 AS h, c_nationkey % 5 AS k, ['Vinnytsia Oblast','Kropyvnytskyi','Kirovohrad','Kyiv','Bar'][c_nationkey % 5 + 1] AS v FROM customer)
SELECT id, CASE k WHEN 1 THEN 'Kropyvnytskyi' ELSE v END AS value, CASE k WHEN 0 THEN 'oblast_genitive_to_nominative' WHEN 2 THEN CASE WHEN h THEN 'historical_preserve' ELSE 'geo_rename_review' END ELSE 'kmu55_transliteration' END AS rule, CASE WHEN k = 0 THEN 0.92 ELSE 0.88 END::DOUBLE AS confidence, k = 2 AND NOT h AS review FROM p""")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick(("Вінницької області", "Кропивницький", "Кіровоград", "Київ", "Бар"), F.col("c_nationkey") % 5)
    return parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), places.place(said, F.col("c_acctbal") > 5000).alias("p")).select("id", "p.*")


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 = 0 THEN 'chicago' WHEN c_nationkey % 4 < 3 THEN 'phoenix' ELSE 'unknown_state' END AS office, 'I-821' || CASE WHEN c_nationkey % 3 = 0 OR c_nationkey >= 14 THEN ',biometrics' ELSE '' END || CASE WHEN c_acctbal > 0 THEN ',I-765' ELSE '' END || CASE WHEN c_acctbal < 100 THEN ',I-912' ELSE '' END AS forms FROM customer""")
def filing_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b = F.col("c_nationkey"), F.col("c_acctbal")
    forms = places.forms_with_fees(F.when(n % 3 != 0, n), b > 0, b < 100)
    return parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), places.mail_office(pick(("ny", "CA", " TX ", "ZZ"), n % 4)).alias("office"), F.array_join(forms, ",").alias("forms"))


@query("""SELECT p_partkey AS ordinal, list_filter([CASE WHEN p_type NOT IN ('ECONOMY','PROMO') THEN 'category' END, CASE WHEN p_size % 5 = 0 THEN 'source_url' END, CASE WHEN p_size % 7 = 0 THEN 'valid_from' END, CASE WHEN p_size % 7 > 0 AND p_size % 3 = 0 THEN 'interval' END], lambda x: x IS NOT NULL)::VARCHAR AS violations FROM part
WHERE p_type NOT IN ('ECONOMY','PROMO') OR p_size % 5 = 0 OR p_size % 7 = 0 OR p_size % 3 = 0""")
def registry_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = parquet(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("category"), F.when(size % 5 != 0, "https://example.org").alias("source_url"), F.when(size % 7 == 0, "1995-13-40").otherwise("1995-01-01").alias("valid_from"), F.when(size % 3 == 0, "1990-01-01").alias("valid_until"),
    )
    found = tables.registry_violations(rows, ["ECONOMY", "PROMO"])
    return found.select("ordinal", F.concat(F.lit("["), F.array_join("violations", ", "), F.lit("]")).alias("violations"))
