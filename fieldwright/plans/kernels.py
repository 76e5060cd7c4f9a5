"""Queries on names, dates, machine-readable lines and JSON, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.functions import dates, names, text
from fieldwright.operators import extract
from fieldwright.plans.adapters import pick
from fieldwright.plans.register import query
from fieldwright.sources.tables import parquet, spread

#: Latin letters and the Cyrillic ones that stand for them in inputs.
_LATIN, _UA, _RU = "abcdefghijklmnopqrstuvwxyz", "абцдефґгіїклмнопярстюєшийз", "абцдефжгиёклмнопярстюэшыйз"


def _sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join("'{}': '{}'".format(k.replace("'", "''"), v) for k, v in table.items()) + "}"


_UA_SQL = f"""WITH w AS (SELECT p_partkey AS id, translate(p_name, '{_LATIN}', '{_UA}') AS name FROM part), t AS (SELECT id, name, regexp_extract_all(name, 'зг|.') AS c FROM w)
SELECT id, name, array_to_string(list_transform(c, lambda x, i: coalesce(CASE WHEN i > 1 AND c[i - 1] <> ' ' THEN {_sql_map(names.INSIDE)}[x] ELSE {_sql_map(names.AT_START)}[x] END, {_sql_map(names.UKRAINIAN)}[x], x)), '') AS latin FROM t"""


@query(_UA_SQL)
def ukrainian_latin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.translate("p_name", _LATIN, _UA).alias("name"))
    return rows.withColumn("latin", names.ukrainian_latin(F.col("name")))


_RU_SQL = f"""WITH w AS (SELECT p_partkey AS id, translate(p_name, '{_LATIN}', '{_RU}') AS name FROM part), t AS (SELECT id, name, regexp_extract_all(name, '.') AS c FROM w)
SELECT id, name, array_to_string(list_transform(c, lambda x, i: CASE WHEN x IN ('е', 'ё') THEN CASE WHEN i = 1 OR c[i - 1] IN ('а', 'е', 'ё', 'и', 'о', 'у', 'ы', 'э', 'ю', 'я') THEN 'ye' ELSE 'e' END ELSE coalesce({_sql_map(names.RUSSIAN)}[x], x) END), '') AS latin FROM t"""


@query(_RU_SQL)
def russian_latin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.translate("p_name", _LATIN, _RU).alias("name"))
    return rows.withColumn("latin", names.russian_latin(F.col("name")))


@query("""SELECT c_custkey AS id, [NULL, 'empty', 'quote_prefix', 'label_as_value', 'punctuation_only', 'too_short', 'label_as_value'][c_custkey % 7 + 1] AS reason FROM customer""")
def garbage_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    value = F.when(i % 7 == 0, F.col("c_name")).otherwise(pick(("", " ", "„ Пріз", "Стать:", "...", "-x", "surname ok"), i % 7))
    return parquet(spark, sf_dir, "customer").select(i.alias("id"), names.garbage_reason(value).alias("reason"))


@query("""SELECT c_custkey AS id, ['Іванович', 'Сергійович', 'Миколайович', '', 'Степанович', 'Львович'][c_custkey % 6 + 1] AS value, CASE WHEN c_custkey % 12 = 4 THEN 'read_valid' ELSE ['generated_regular', 'generated_regular', 'generated_exception', 'unresolved', 'generated_regular', 'generated_exception'][c_custkey % 6 + 1] END AS source FROM customer""")
def patronymic_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    made = names.patronymic(F.when(i % 12 == 4, " степанович ").when(i % 12 == 5, "ович"), pick(("Іван", "Сергій", "Микола", "Олекса", "Степан", "Лев"), i % 6), F.lit("M"))
    return parquet(spark, sf_dir, "customer").select(i.alias("id"), made["value"].alias("value"), made["source"].alias("source"))


@query("""SELECT c_custkey AS id, ['Петренко', 'Іванова', 'Шевченко', 'Тарас', 'Іван'][c_custkey % 5 + 1] AS nominative, c_custkey % 5 = 3 AS mixed FROM customer""")
def nominative_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    return parquet(spark, sf_dir, "customer").select(
        i.alias("id"), names.nominative(pick(("Петренку", "Івановій", "Шевченка", "Тарасові", "Іван"), i % 5)).alias("nominative"), names.mixed_script(pick(("Іван", "Ivan", "", "Iван", "Ян"), i % 5)).alias("mixed")
    )


def _order_date(style: Column) -> Column:
    f = lambda form: F.date_format("o_orderdate", form)
    return F.when(style == 0, f("yyyy-MM-dd")).when(style == 1, f("yyyy/M/d")).when(style == 2, f("dd/MM/yyyy")).when(style == 3, f("MM-dd-yyyy")).otherwise(f("dd.MM.yyyy"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS style, o_orderdate AS t, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders)
SELECT id, CASE WHEN style < 2 OR (style < 4 AND d > 12) THEN strftime(t, '%Y-%m-%d') END AS strict,
  CASE WHEN style IN (0, 2, 4) THEN d END::INTEGER AS day, CASE WHEN style IN (0, 2, 4) THEN m END::INTEGER AS month, CASE WHEN style IN (0, 2, 4) THEN y END::INTEGER AS year, CASE WHEN style = 4 THEN strftime(t, '%m/%d/%Y') END AS form_date FROM o""")
def date_parse_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.col("o_orderkey") % 5
    rows = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), style.alias("style"), _order_date(style).alias("text"))
    parts = rows.withColumn("p", F.when(F.col("style").isin(0, 2, 4), dates.date_parts(F.col("text"))))
    return parts.select("id", dates.strict_date(F.col("text")).alias("strict"), "p.day", "p.month", "p.year", dates.form_date(F.col("text")).alias("form_date"))


@query("""SELECT o_orderkey AS id, day(o_orderdate)::INTEGER AS day, month(o_orderdate)::INTEGER AS month, year(o_orderdate)::INTEGER AS year, strftime(o_orderdate, '%m/%d/%Y') AS form_date FROM orders""")
def month_word_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("o_orderkey"), F.col("o_orderdate")
    word = F.when(i % 2 == 0, pick(dates.MONTHS_UA, F.month(d) - 1)).otherwise(pick(dates.MONTHS_RU, F.month(d) - 1))
    rows = parquet(spark, sf_dir, "orders").select(i.alias("id"), F.concat_ws(" ", F.day(d).cast("string"), word, F.year(d).cast("string"), F.when(i % 2 == 0, "року").otherwise("г.")).alias("text"))
    return rows.withColumn("p", dates.date_parts(F.col("text"))).select("id", "p.day", "p.month", "p.year", dates.form_date(F.col("text")).alias("form_date"))


@query("""SELECT c_custkey AS id, 'P' AS document_type, 'UKR' AS issuing_state, lpad(c_custkey::VARCHAR, 9, '0') AS document_number, c_mktsegment AS surname, 'ANNA MARIA' AS given_names,
  '19' || (40 + c_custkey % 50)::VARCHAR || '-' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS date_of_birth, CASE WHEN c_custkey % 3 = 0 THEN 'F' WHEN c_custkey % 3 = 1 THEN 'M' ELSE 'Unspecified' END AS sex,
  c_custkey % 7 <> 0 AS checks_ok FROM customer""")
def mrz_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passport lines made from customers, every seventh with a broken check digit, and read again."""
    i = F.col("c_custkey")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    signed = lambda c: F.concat(c, text.check_digit(c).cast("string"))
    birth = F.concat(two(40 + i % 50), two(i % 12 + 1), two(i % 28 + 1))
    body = F.concat(signed(F.lpad(i.cast("string"), 9, "0")), F.lit("UKR"), signed(birth), pick(("F", "M", "<"), i % 3), signed(F.lit("300101")), signed(F.rpad(F.lit("AB"), 14, "<")))
    last = F.pmod(text.check_digit(F.col("body")) + F.when(i % 7 == 0, 1).otherwise(0), F.lit(10))
    dealt = spread(parquet(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    rows = dealt.select("c_custkey", F.rpad(F.concat(F.lit("P<UKR"), "c_mktsegment", F.lit("<<ANNA<MARIA")), 44, "<").alias("one"), F.explode(F.array(body)).alias("body"))
    lines = rows.select(i.alias("id"), "one", F.explode(F.array(F.concat("body", last.cast("string")))).alias("two"))
    read = extract.machine_fields(lines, ["id"], dates.mrz_td3(F.col("one"), F.col("two")))
    return read.select("id", "document_type", "issuing_state", "document_number", "surname", "given_names", "date_of_birth", "sex", "checks_ok")


@query("""SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 1234.0 ELSE least(500.0 * 2 ** (event_id % 8) * (1 + 0.25 * (event_id % 5) / 4.0), 20000.0) END::DOUBLE AS wait_ms FROM events""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return parquet(spark, sf_dir, "events").select(i.alias("id"), dates.backoff_ms(i % 8 + 1, (i % 5) / 4.0, 500.0, 20000.0, F.when(i % 11 == 0, 1234.0)).alias("wait_ms"))


@query("""SELECT event_id AS id, '{"k": ' || (props->>'k') || ', "deep": [{"ok": ' || event_id::VARCHAR || '}], "n": null}' AS redacted FROM events""")
def json_key_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    given = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "Name": "x", "deep": [{"Raw_Text": {"a": 1}, "ok": '), i, F.lit('}], "n": null}'))
    return parquet(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.redact_json(given).alias("redacted"))


@query("""SELECT c_custkey AS id, ['ocr_error', 'controlling_spelling', 'exception', 'kept'][c_custkey % 4 + 1] AS class FROM customer""")
def correction_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    said = names.correction_class(F.lit("family_name"), pick(("Ivan", "Іван", "Anna", "x"), i % 4), pick(("Iwan", "Ivan", "Gregory", "y"), i % 4), F.when(i % 4 == 3, "kept"))
    return parquet(spark, sf_dir, "customer").select(i.alias("id"), said.alias("class"))


@query("""SELECT source, count(DISTINCT lower(trim(lang))) = 1 AS agrees, count(*) FILTER (lang IS NULL) AS n_incomplete FROM documents GROUP BY source""")
def run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all readings of a group are the same."""
    return parquet(spark, sf_dir, "documents").groupBy("source").agg((F.count_distinct(F.lower(F.trim("lang"))) == 1).alias("agrees"), F.count_if(F.col("lang").isNull()).alias("n_incomplete"))
