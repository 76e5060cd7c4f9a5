"""Queries on knowledge of values and on packets of documents, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.operators import knowledge
from fieldwright.plans.adapters import pick
from fieldwright.plans.register import query
from fieldwright.sources.tables import parquet, spread

_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"


@query(f"""WITH p AS (SELECT *, p_size % 6 AS k, strftime(DATE '1990-01-01' + p_size::INTEGER, '%Y-%m-%d') AS d FROM part)
SELECT p_partkey AS doc, ['family_name','date_of_birth','sex','issuing_authority','document_series','father_full_name'][k + 1] AS key, CASE k WHEN 0 THEN p_name WHEN 1 THEN d WHEN 2 THEN CASE WHEN p_type = 'ECONOMY' THEN '?' ELSE 'ж' END WHEN 3 THEN CASE WHEN p_type = 'ECONOMY' THEN 'Контора' ELSE 'УМВС ' || p_brand END WHEN 4 THEN p_brand ELSE upper(p_name) END AS value,
  CASE k WHEN 0 THEN {_TITLE} WHEN 1 THEN d[6:7] || '/' || d[9:10] || '/' || d[1:4] WHEN 2 THEN CASE WHEN p_type = 'ECONOMY' THEN '?' ELSE 'Female' END WHEN 3 THEN CASE WHEN p_type = 'ECONOMY' THEN 'Контора' ELSE 'Regional Department of MIA' END WHEN 4 THEN p_brand ELSE {_TITLE} END AS normalized,
  CASE WHEN p_type = 'ECONOMY' AND k = 2 THEN '?' WHEN p_type = 'ECONOMY' AND k = 3 THEN 'Kontora' END AS suggested, p_type = 'ECONOMY' AND k IN (2, 3) AS review,
  CASE k WHEN 0 THEN 'name.latin_preserve' WHEN 1 THEN 'date.iso' WHEN 2 THEN CASE WHEN p_type = 'ECONOMY' THEN 'sex.uncertain' ELSE 'sex.normalize' END WHEN 3 THEN CASE WHEN p_type = 'ECONOMY' THEN 'authority.unknown' ELSE 'authority.dictionary' END WHEN 4 THEN 'default.passthrough' ELSE 'fullname.latin_preserve' END AS rule FROM p""")
def knowledge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, economy = F.col("p_size") % 6, F.col("p_type") == "ECONOMY"
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    value = (
        F.when(k == 0, F.col("p_name")).when(k == 1, day).when(k == 2, F.when(economy, "?").otherwise("ж")).when(k == 3, F.when(economy, "Контора").otherwise(F.concat(F.lit("УМВС "), "p_brand")))
        .when(k == 4, F.col("p_brand")).otherwise(F.upper("p_name"))
    )
    fields = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), pick(("family_name", "date_of_birth", "sex", "issuing_authority", "document_series", "father_full_name"), k).alias("key"), value.alias("value"))
    return knowledge.enriched(fields)


@query("""SELECT c_custkey AS doc, ['Миколаївна','Іванович','нотаря','Петрівна'][c_nationkey % 4 + 1] AS value, CASE c_nationkey % 4 WHEN 0 THEN 'Mykolaivna' WHEN 1 THEN CASE WHEN c_acctbal > 0 THEN 'Іванович' ELSE 'Ivanovych' END WHEN 2 THEN 'нотаря' ELSE 'Petrivna' END AS normalized,
  CASE WHEN c_acctbal <= 0 AND c_nationkey % 4 = 0 THEN false WHEN c_nationkey % 4 = 1 THEN c_acctbal > 0 ELSE c_nationkey % 4 = 2 END AS review FROM customer""")
def sibling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patronymics checked with the sex and given name that their document tells elsewhere; half of the documents tell neither."""
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    told = F.array(F.struct(F.lit("patronymic").alias("key"), pick(("Миколаївна", "Іванович", "нотаря", "Петрівна"), n % 4).alias("value")), F.struct(F.lit("sex").alias("key"), F.when(F.col("c_acctbal") > 0, "Female").alias("value")), F.struct(F.lit("given_name").alias("key"), F.when(F.col("c_acctbal") > 0, "Микола").alias("value")))
    fields = spread(parquet(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey").select(i.alias("doc"), F.explode(told).alias("t")).select("doc", "t.*")
    return knowledge.enriched(fields).where("key = 'patronymic'").select("doc", "value", "normalized", "review")


@query("""WITH d AS (SELECT p_partkey AS doc, CASE p_size % 5 WHEN 0 THEN p_type WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN ' ' || upper(p_name) WHEN 3 THEN '' ELSE 'what' END AS raw, CASE WHEN p_size > 45 THEN 0.8 ELSE 0.9 END AS c, p_size % 5 AS k, p_type AS t, p_name AS n FROM part)
SELECT doc, CASE WHEN k IN (3, 4) OR c < 0.85 OR (k = 0 AND t = 'PROMO') THEN 'manual_review_required' WHEN k = 0 THEN lower(t) ELSE replace(n, ' ', '_') END AS type, CASE WHEN k = 3 THEN 'unknown_document_type' WHEN c < 0.85 THEN 'low_classification_confidence' WHEN k = 4 THEN 'unsupported_document_type' WHEN k = 0 AND t = 'PROMO' THEN 'module_not_active' END AS reason FROM d""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = parquet(spark, sf_dir, "part"), F.col("p_size") % 5
    kinds = p.select(F.lower("p_type").alias("alias"), F.lower("p_type").alias("type"), (F.col("p_type") != "PROMO").alias("active"))
    aliases = kinds.union(p.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("alias"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("type"), F.lit(True).alias("active"))).distinct()
    raw = F.when(k == 0, F.col("p_type")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).when(k == 2, F.concat(F.lit(" "), F.upper("p_name"))).when(k == 3, "").otherwise("what")
    return knowledge.classified(p.select(F.col("p_partkey").alias("doc"), raw.alias("raw"), F.when(F.col("p_size") > 45, 0.8).otherwise(0.9).alias("confidence")), aliases)


_FIELDS = ("family_name", "given_name", "dob", "a_number", "city_of_birth")


def _packet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A customer's order lines as readings of their packet."""
    n = F.col("l_linenumber")
    value = F.when(F.col("l_tax") < 0.01, " ").when(F.col("l_discount") > 0.09, "surname").when(F.col("l_discount") > 0.08, "x9").otherwise(F.concat(F.lit("Anna"), F.lower("l_returnflag")))
    slots = parquet(spark, sf_dir, "lineitem").where(n <= 5).select(
        F.col("l_orderkey").alias("doc"), F.when(F.col("l_quantity") > 25, "passport").otherwise("ead").alias("slot"), pick(_FIELDS, n - 1).alias("field"), value.alias("value"), F.when(F.col("l_quantity") > 25, "passport").otherwise("ead").alias("source_doc"),
        F.lit("ocr_keyword").alias("source_type"), F.lit(False).alias("review_required"), F.col("l_partkey").alias("ordinal"),
    )
    contract = spark.sql("SELECT * FROM VALUES ('passport','family_name'), ('passport','given_name'), ('passport','dob'), ('passport','city_of_birth'), ('ead','family_name'), ('ead','a_number'), ('ead','given_name') AS t(slot, field)")
    manual = parquet(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc"), F.lit("dob").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"))
    return knowledge.merged_packet(slots, contract, manual, ("family_name", "given_name", "dob"))


_PACKET_SQL = """
s AS (SELECT l_orderkey AS doc, CASE WHEN l_quantity > 25 THEN 'passport' ELSE 'ead' END AS slot, ['family_name','given_name','dob','a_number','city_of_birth'][l_linenumber] AS field, CASE WHEN l_discount > 0.09 THEN 'surname' WHEN l_discount > 0.08 THEN 'x9' ELSE 'Anna' END AS v FROM lineitem WHERE l_linenumber <= 5 AND NOT l_tax < 0.01),
r AS (SELECT *, CASE WHEN field IN ('family_name','given_name') THEN true WHEN slot = 'passport' THEN field IN ('dob','city_of_birth') ELSE field = 'a_number' END AS ok FROM s),
j AS (SELECT doc, slot, field, CASE WHEN NOT ok THEN 'not_in_contract' WHEN v = 'surname' THEN 'label_as_value' WHEN v = 'x9' AND field IN ('family_name','given_name') THEN 'implausible_name' END AS reason FROM r)"""


@query(f"WITH {_PACKET_SQL} SELECT * FROM j WHERE reason IS NOT NULL")
def packet_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packet(spark, sf_dir)[1]


@query(f"""WITH {_PACKET_SQL}, f AS (SELECT doc, field FROM j WHERE reason IS NULL UNION SELECT o_orderkey, 'dob' FROM orders WHERE o_orderstatus = 'F')
SELECT doc, concat_ws(',', CASE WHEN count(*) FILTER (field = 'family_name') = 0 THEN 'family_name' END, CASE WHEN count(*) FILTER (field = 'given_name') = 0 THEN 'given_name' END, CASE WHEN count(*) FILTER (field = 'dob') = 0 THEN 'dob' END) AS missing, count(DISTINCT field) FILTER (field IN ('family_name','given_name','dob')) = 3 AS ready FROM f GROUP BY doc""")
def packet_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packet(spark, sf_dir)[2].select("doc", F.array_join("missing", ",").alias("missing"), "ready")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderdate AS d, o_custkey AS c, o_orderstatus AS s FROM orders) SELECT id, CASE k WHEN 0 THEN CASE WHEN c % 9 = 0 THEN 'unparseable_date' WHEN d > TIMESTAMP '1998-01-01' THEN 'dob_out_of_range' END WHEN 1 THEN CASE WHEN length(c::VARCHAR) + 3 < 5 THEN 'bad_shape' END WHEN 2 THEN CASE WHEN s = 'F' THEN 'untransliterated_cyrillic' END
  WHEN 3 THEN CASE WHEN s = 'O' THEN 'bad_shape' END ELSE CASE WHEN length((c * 1000)::VARCHAR) < 7 THEN 'bad_shape' END END AS failure FROM o""")
def hard_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, d, s = F.col("o_orderkey") % 5, F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    field = pick(("dob", "passport_number", "family_name", "sex", "a_number"), k)
    value = F.when(k == 0, F.when(c % 9 == 0, "soon").when(c % 2 == 0, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))).when(k == 1, F.concat(F.lit("ABC"), c.cast("string"))).when(k == 2, F.when(s == "F", "Іван").otherwise("Ivan")).when(k == 3, F.when(s == "O", "??").otherwise("Ч / M")).otherwise((c * 1000).cast("string"))
    return parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), knowledge.hard_failure(field, value, F.lit("1998-01-01").cast("date")).alias("failure"))


@query("""WITH f AS (SELECT c_custkey AS doc, c_name AS n, c_mktsegment AS m, c_nationkey AS k, strftime(DATE '1970-01-01' + c_custkey::INTEGER, '%m/%d/%Y') AS d FROM customer)
SELECT doc, 'Line1' AS target, 'text' AS kind, CASE WHEN k % 2 = 0 THEN n ELSE m END AS value FROM f UNION ALL SELECT doc, 'Line19', 'text', d FROM f UNION ALL SELECT doc, 'Line7', 'text', lpad(doc::VARCHAR, 9, '0') FROM f WHERE k % 3 > 0""")
def document_form_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, born as many days after 1970 as their key tells; years of five digits, which are no ISO dates, are told as the form shows them."""
    i, k = F.col("c_custkey"), F.col("c_nationkey")
    day = F.date_add(F.lit("1970-01-01").cast("date"), i.cast("int"))
    born = F.when(F.year(day) > 9999, F.date_format(day, "MM/dd/y")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    told = F.array(
        F.struct(F.lit("family_name").alias("key"), F.when(k % 2 == 0, F.col("c_name")).otherwise(" ").alias("value")), F.struct(F.lit("family_name_latin").alias("key"), F.col("c_mktsegment").alias("value")),
        F.struct(F.lit("date_of_birth").alias("key"), born.alias("value")), F.struct(F.lit("a_number").alias("key"), F.when(k % 3 > 0, F.concat(F.lit("A"), F.lpad(i.cast("string"), 9, "0"))).alias("value")),
    )
    fields = spread(parquet(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey").select(i.alias("doc"), F.explode(told).alias("t")).select("doc", "t.*")
    return knowledge.canonical_operations(fields, {"Line1": (("family_name", "family_name_latin"), "text", "plain"), "Line19": (("dob", "date_of_birth"), "text", "date"), "Line7": (("a_number",), "text", "a_number")})
