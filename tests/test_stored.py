"""Tables that are changed in place, row policies, and texts in composed form."""

import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldwright.functions import text
from fieldwright.operators import canonical, policies
from fieldwright.operators.policies import Policy, Principal
from fieldwright.sources import stored


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.create(spark.range(200).select("id", (F.col("id") * 10).alias("v"), F.lit(0).alias("at")), path, ["id"], 16)
    before = files(path)
    new = spark.createDataFrame([(3, 1, 5), (3, 2, 6), (3, 9, 6), (1000, 7, 1)], "id long, v long, at int")
    stored.upsert(new, path, ["id"], "at", 16)
    rows = {r.id: (r.v, r["at"]) for r in stored.load(spark, path).collect()}
    assert len(rows) == 201 and rows[3] == (9, 6) and rows[1000] == (7, 1) and rows[4] == (40, 0)
    after = files(path)
    touched = {r.b for r in new.select(stored.bucket(["id"], 16).alias("b")).collect()}
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert stored.delete(spark, path, F.col("id") == 5) == 1 and stored.delete(spark, path, F.col("id") == 5) == 0
    assert stored.delete(spark, path, F.when(F.col("id") < 100, None).otherwise(F.col("id") >= 150)) == 51
    assert stored.load(spark, path).count() == 149
    assert stored.delete(spark, path, F.lit(True)) == 149 and not files(path)


def test_passes_fail_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.create(spark.range(10), path, ["id"], 4)

    def broken():
        raise RuntimeError("storage is away\nmore")

    got = stored.cleanup(spark, {"first": broken, "second": lambda: stored.delete(spark, path, F.col("id") > 6), "third": lambda: stored.delete(spark, str(tmp_path / "none"), F.lit(True))}).collect()
    assert [(r["pass"], r.ok, r.deleted_rows) for r in got] == [("first", False, 0), ("second", True, 3), ("third", False, 0)]
    assert got[0].error == "storage is away"


def test_an_append_only_table_refuses_what_it_has(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.create(spark.range(10).withColumn("v", F.lit("a")), path, ["id"], 4)
    before = files(path)
    more = lambda *ids: spark.createDataFrame([(i, "b") for i in ids], "id long, v string")
    for bad in (more(3), more(20, 3), more(21, 21)):
        with pytest.raises(stored.AlreadyStored):
            stored.append_only(bad, path, ["id"], 4)
    assert files(path) == before
    assert stored.append_only(more(20, 21), path, ["id"], 4) == 2 and stored.append_only(more(), path, ["id"], 4) == 0
    assert stored.load(spark, path).count() == 12 and {f: after for f, after in files(path).items() if f in before} == before


def test_policies_are_alternatives_and_else_nothing(spark):
    orders = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, None)], "id int, user_id string")
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d"), (None, "e")], "order_id int, n string")
    answers = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_published boolean")
    tables = {"translations_orders": orders, "form_sessions": orders}
    roles = spark.createDataFrame([("mod", "moderator"), ("root", "admin"), ("root", "moderator"), ("ann", "user")], "id string, role string")
    ann, mod, root, nobody = (policies.principal(i, roles) for i in ("ann", "mod", "root", None))
    assert (ann.role, mod.role, root.role, nobody.role) == (None, "moderator", "admin", None)
    ids = lambda rows, table, action, who, column="id": sorted((r[column] for r in policies.allowed(rows, table, action, who, tables).collect()), key=str)
    assert ids(orders, "translations_orders", "select", ann) == [1] and ids(orders, "translations_orders", "select", mod) == [1, 2, 3] and ids(orders, "translations_orders", "select", nobody) == []
    assert ids(orders, "translations_orders", "insert", mod) == [] and ids(orders, "translations_orders", "delete", root) == []
    assert ids(orders, "form_sessions", "insert", nobody) == [3] and ids(orders, "form_sessions", "insert", ann) == [1, 3]
    assert ids(lines, "translation_files", "select", ann, "n") == ["a", "b"] and ids(lines, "translation_files", "select", root, "n") == ["a", "b", "c"] and ids(lines, "translation_files", "insert", root, "n") == []
    assert ids(answers, "canonical_answers", "select", ann) == [1] and ids(answers, "canonical_answers", "update", mod) == [1, 2, 3] and ids(answers, "canonical_answers", "update", ann) == []
    assert ids(answers, "scanner_hits", "select", mod) == [] and ids(answers, "scanner_hits", "select", root) == [1, 2, 3] and ids(answers, "official_sources", "select", nobody) == [1, 2, 3]
    assert ids(answers, "audit_log", "insert", ann) == [1, 2, 3] and ids(answers, "audit_log", "insert", nobody) == [] and ids(answers, "audit_log", "delete", root) == []
    assert ids(answers, "no_such_table", "select", root) == [] and ids(orders, "translations_orders", "delete", Principal(service=True)) == [1, 2, 3]
    assert policies.allowed(lines, "translation_files", "select", ann, tables).columns == ["order_id", "n"]
    with pytest.raises(ValueError):
        policies.allowed(orders, "translations_orders", "read", ann, tables)
    with pytest.raises(ValueError):
        policies.allowed(orders, "x", "select", ann, tables, (Policy("x", "select", "odd", "id"),))


def test_texts_are_compared_in_composed_form(spark):
    texts = ["Київ", unicodedata.normalize("NFD", "Київ їжак é"), "plain", "", None, "Å", "가", unicodedata.normalize("NFD", "가"), "№ 5 — x", "日本"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(text.composed(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == [t and unicodedata.normalize("NFC", t) for t in texts]
    pairs = [("Київ", unicodedata.normalize("NFD", "Київ"), False, 0.0), ("Київ", "Киів", True, 0.25), ("", "x", False, 1.0), ("", "", False, 0.0)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(text.materially_different(F.col("a"), F.col("b")).alias("d"), text.error_rate(F.col("a"), F.col("b")).alias("e")).collect()
    assert [(r.d, r.e) for r in got] == [p[2:] for p in pairs]


def test_names_are_held_against_their_source(spark):
    cases = [
        ("family_name", "Shevchenko", "Шевченко", None, False), ("family_name", "SHEVCHENKO ", "Шевченко", " ", False), ("family_name", "Shevcenko", "Шевченко", None, True), ("family_name", "Shevchenko", "Шевченко", "SHEVCHENCO", True),
        ("child_given_name", "Pyotr", "Пётр", None, True), ("dob", "x", "Шевченко", None, False), ("family_name", " ", "Шевченко", None, False), ("family_name", None, "Шевченко", None, False), ("family_name", "x", None, None, False), ("mother", "Kyi", "Київ", None, True),
    ]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, k string, got string, raw string, control string").orderBy("i")
    got = rows.select(canonical.wrong_transliteration(F.col("k"), F.col("got"), F.col("raw"), F.col("control"))).collect()
    assert [r[0] for r in got][:4] == [c[4] for c in cases][:4] and [r[0] for r in got][5:] == [c[4] for c in cases][5:]
