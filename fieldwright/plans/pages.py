"""Queries on fields read from pages of single kinds of documents, with SQL.

Pages are put together from the given tables in several layouts; SQL tells from the columns what must be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.functions.dates import MONTHS_UA
from fieldwright.operators import booklet, cards, extracted
from fieldwright.plans.adapters import pick
from fieldwright.plans.register import query
from fieldwright.sources.tables import parquet, spread

#: Letters for digits, so that each customer has a name of its own.
_NAME = ("0123456789", "абвгдежзик")
TODAY = "2026-01-01"


@query(f"""
WITH c AS (
  SELECT c_custkey AS doc, c_nationkey % 4 AS layout, c_nationkey % 3 AS form, translate(lpad(c_custkey::VARCHAR, 6, '0'), '{_NAME[0]}', '{_NAME[1]}') AS s, translate(lpad((c_custkey * 7)::VARCHAR, 7, '0'), '{_NAME[0]}', '{_NAME[1]}') AS g,
    DATE '1950-01-01' + (c_custkey % 15000)::INTEGER AS born, lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS n, c_acctbal > 0 AS numbered
  FROM customer
), f AS (
  SELECT doc, 'family_name' AS field, upper(s[1]) || s[2:] AS normalized FROM c WHERE layout < 3
  UNION ALL SELECT doc, 'given_name', CASE WHEN layout = 2 THEN upper(s[1]) || s[2:] ELSE upper(g[1]) || g[2:] END FROM c WHERE layout < 3
  UNION ALL SELECT doc, 'dob', strftime(born, '%Y-%m-%d') FROM c WHERE layout < 2
  UNION ALL SELECT doc, 'passport_number', 'EK ' || n FROM c WHERE layout < 2 AND numbered
  UNION ALL SELECT doc, unnest(['country_of_nationality', 'country_of_birth', 'passport_country_of_issuance']), 'Ukraine' FROM c WHERE layout < 3
)
SELECT * FROM f
""")
def booklet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values above their labels, behind them, or below, where the line above is taken for the next label's; and pages of another kind."""
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    named = lambda c, width: F.translate(F.lpad(c.cast("string"), width, "0"), *_NAME)
    born = F.date_add(F.lit("1950-01-01").cast("date"), (i % 15000).cast("int"))
    said = F.when(n % 3 == 0, F.concat_ws(" ", F.day(born).cast("string"), pick(MONTHS_UA, F.month(born) - 1), F.year(born).cast("string"), F.lit("року"))).when(n % 3 == 1, F.date_format(born, "dd.MM.yyyy")).otherwise(F.date_format(born, "d/M/yyyy"))
    number = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("EK "), F.lpad((i % 1000000).cast("string"), 6, "0")))
    head, surname, given, birth = "ПАСПОРТ ГРОМАДЯНИНА УКРАЇНИ", "Прізвище / Surname", "Ім'я / Given Names", "Дата народження / Date of birth"
    s, g = F.upper(named(i, 6)), named(i * 7, 7)
    lines = lambda *parts: F.array_join(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), "\n")
    above = lines(head, number, s, surname, g, given, said, birth)
    behind = lines(head, F.concat(F.lit(surname + ": "), s), F.concat(F.lit(given + ": "), g), F.concat(F.lit(birth + " "), said), number)
    below = lines(head, surname, s, given, g, birth, said)
    text = F.when(n % 4 == 0, above).when(n % 4 == 1, behind).when(n % 4 == 2, below).otherwise(F.concat(F.lit("page of "), F.col("c_name")))
    rows = spread(parquet(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name"), "c_custkey")
    return booklet.booklet_fields(rows.select(i.alias("doc"), text.alias("text")), TODAY).select("doc", "field", "normalized")


@query("""
WITH c AS (
  SELECT o_orderkey AS doc, o_orderkey % 4 AS layout, c_custkey::VARCHAR AS house, upper(split_part(p_name, ' ', 1)) AS road, upper(split_part(p_name, ' ', 2)) AS town, CASE WHEN c_nationkey % 2 = 0 THEN 'CA' ELSE 'NY' END AS state,
    lpad(o_orderkey::VARCHAR, 5, '0')[-5:] AS code, strftime(o_orderdate, '%Y-%m-%d') AS dob, c_mktsegment AS surname
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = c_custkey
), f AS (
  SELECT doc, 'family_name' AS field, surname[1] || lower(surname[2:]) AS normalized FROM c
  UNION ALL SELECT doc, 'dob', dob FROM c
  UNION ALL SELECT doc, 'us_address_street', house || ' ' || road[1] || lower(road[2:]) || ' Ave' || CASE WHEN layout = 1 THEN ' 111' ELSE '' END FROM c WHERE layout < 3
  UNION ALL SELECT doc, 'us_address_city', town[1] || lower(town[2:]) FROM c
  UNION ALL SELECT doc, 'us_address_state', state FROM c
  UNION ALL SELECT doc, 'us_address_zip', code FROM c
)
SELECT * FROM f
""")
def licence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers as cards: the address in one line, with commas or without, in two lines, or without a street."""
    c = F.col
    rows = parquet(spark, sf_dir, "orders").join(parquet(spark, sf_dir, "customer"), c("c_custkey") == c("o_custkey")).join(parquet(spark, sf_dir, "part"), c("p_partkey") == c("c_custkey"))
    rows = spread(rows.select("o_orderkey", "o_orderdate", "c_custkey", "c_nationkey", "c_mktsegment", "p_name"), "o_orderkey")
    words = F.split(F.upper("p_name"), " ")
    street, town = F.concat_ws(" ", c("c_custkey").cast("string"), words[0], F.lit("AVE")), words[1]
    end = F.concat(F.when(c("c_nationkey") % 2 == 0, "CA").otherwise("NY"), F.lit(" "), F.lpad(c("o_orderkey").cast("string"), 5, "0"))
    k = c("o_orderkey") % 4
    tail = F.concat(town, F.lit(", "), end)
    address = F.when(k == 0, F.concat(street, F.lit(", "), tail)).when(k == 1, F.concat_ws(" ", street, F.lit("111"), town, end)).when(k == 2, F.concat(street, F.lit("\n"), tail)).otherwise(tail)
    text = F.concat(F.lit("LN "), c("c_mktsegment"), F.lit("\n"), F.lit("DOB "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("\n"), address)
    return cards.licence_cards(rows.select(c("o_orderkey").alias("doc"), text.alias("text"))).select("doc", F.inline("fields")).select("doc", "field", "normalized")


@query("""
WITH r AS (
  SELECT o_orderkey AS doc, o_orderdate AS d, o_orderstatus AS st, o_totalprice > 200000 AS rich, c_mktsegment AS seg, c_nationkey AS n, p_name AS name, p_size % 4 AS k FROM orders JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = c_custkey
), f AS (
  SELECT doc, 'dob' AS field, 'passed' AS status, 'no_knowledge_rule_for_field' AS reason, strftime(d, '%Y-%m-%d') AS value FROM r
  UNION ALL SELECT doc, 'family_name', CASE st WHEN 'F' THEN 'normalized' WHEN 'O' THEN 'passed' ELSE 'rejected' END, CASE st WHEN 'F' THEN 'latin_titlecase' WHEN 'O' THEN 'latin_passthrough' ELSE 'family_name_garbage' END,
    CASE WHEN st <> 'P' THEN seg[1] || lower(seg[2:]) END FROM r
  UNION ALL SELECT doc, 'patronymic', CASE WHEN rich THEN 'normalized' ELSE 'rejected' END, CASE WHEN rich THEN 'latin_passthrough' ELSE 'patronymic_garbage' END, CASE WHEN rich THEN lower(seg) || 'ovych' END FROM r
  UNION ALL SELECT doc, 'country_of_birth', CASE WHEN n < 10 THEN 'passed' ELSE 'rejected' END, CASE WHEN n < 10 THEN 'no_knowledge_rule_for_field' ELSE 'country_not_recognized' END, CASE WHEN n < 5 THEN 'Ukraine' WHEN n < 10 THEN ' POLAND ' END FROM r
  UNION ALL SELECT doc, 'city_of_birth', CASE WHEN k < 2 THEN 'normalized' ELSE 'rejected' END, CASE k WHEN 2 THEN 'contains_year_fragment' WHEN 3 THEN 'contains_label_noise' ELSE 'kmu55_transliteration' END, CASE WHEN k < 2 THEN name END FROM r
)
SELECT * FROM f
""")
def form_ready_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers as extracted fields."""
    c = F.col
    rows = parquet(spark, sf_dir, "orders").join(parquet(spark, sf_dir, "customer"), c("c_custkey") == c("o_custkey")).join(parquet(spark, sf_dir, "part"), c("p_partkey") == c("c_custkey"))
    segment, k, n = c("c_mktsegment"), c("p_size") % 4, c("c_nationkey")
    said = {
        "dob": F.date_format("o_orderdate", "M/d/yyyy"), "family_name": F.when(c("o_orderstatus") == "F", segment).when(c("o_orderstatus") == "O", F.initcap(segment)).otherwise(F.concat(F.lit("x"), segment)),
        "patronymic": F.concat(F.lower(segment), F.when(c("o_totalprice") > 200000, "ovych").otherwise("ski")), "country_of_birth": F.when(n < 5, "Ukraine").when(n < 10, " POLAND ").otherwise(F.concat(F.lit("NATION_"), n.cast("string"))),
        "city_of_birth": F.when(k == 0, F.concat(F.lit("смт. "), c("p_name"))).when(k == 1, F.concat(F.lit("м. "), c("p_name"))).when(k == 2, F.concat(c("p_name"), F.lit(" 1999"))).otherwise(F.concat(F.lit("Place of birth "), c("p_name"))),
    }
    fields = rows.select(c("o_orderkey").alias("doc"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("normalized")) for f, v in said.items()])))
    told = fields.select("doc", "field", F.col("normalized").alias("raw"), "normalized", F.lit("vision").alias("source"), F.lit(0.9).alias("confidence"))
    return extracted.ready_for_forms(told).select("doc", "field", "status", "reason", "value")
