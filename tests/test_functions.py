"""Scalar functions and operators on small invented inputs."""

import pytest
from pyspark.sql import functions as F

from fieldwright.functions import text
from fieldwright.operators import joins, ledger, metrics, resolve, timing
from fieldwright.sources import tables


def values(spark, f, items):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("o")).collect()]


def test_latin_names(spark):
    assert values(spark, text.latin_name, ["O'BRIEN-SMITH", "McDonald", "anna maria", "", None]) == ["O'Brien-Smith", "McDonald", "Anna Maria", "", ""]


def test_name_script(spark):
    assert values(spark, text.name_script, ["Їжак", "Объём", "Анна", "їы"]) == ["ua", "ru", "unknown", "unknown"]


def test_check_digit_of_the_public_specimen(spark):
    assert values(spark, text.check_digit, ["L898902C3", "740812", "", "<<<"]) == [6, 2, 0, 0]


def test_pii(spark):
    said = "call 555-123-4567 or mail a.b@example.org, 123-45-6789"
    assert values(spark, text.scrub_pii, [said, None]) == ["call [REDACTED_PHONE] or mail [REDACTED_EMAIL], [REDACTED_SSN]", None]
    assert values(spark, text.pii_types, [said]) == [["SSN", "PHONE", "EMAIL"]]


def test_redacted_values(spark):
    given = ["", "x@y.org", "+1 (202) 555 0100", "AB123456", "Привіт", "a" * 70, "fine"]
    assert values(spark, text.redact_value, given) == ["", "[redacted-email]", "[redacted-phone]", "[redacted-digits]", "[redacted-text]", "a" * 24 + "…[truncated:70]", "fine"]


def test_arbitration_ties_by_order_and_skips_blanks(spark):
    rows = spark.createDataFrame([(1, "k", "b", "mrz", 0.9, 2, False), (1, "k", "a", "mrz", 0.9, 1, False), (1, "k", " ", "mrz", 1.0, 0, False), (2, "k", "", "mrz", 1.0, 0, False), (3, "k", "X", "ead", None, 0, False), (3, "k", " x ", "i94", 0.9, 1, False)], "doc long, key string, value string, source string, confidence double, ordinal long, review_required boolean")
    got = {r["doc"]: r for r in resolve.arbitrate(rows).collect()}
    assert set(got) == {1, 3}
    assert got[1]["value"] == "a" and got[1]["conflict"] and got[1]["review"]
    assert got[3]["source"] == "i94" and not got[3]["conflict"] and not got[3]["review"]


def test_nearest_names_equal_brute_force(spark):
    entries = ["Anzor", "Berat", "Berta", "Kolo", "Kolos", "Zu"]
    read = ["Anzr", "Berrta", "Kol", "Zux", "Nothing", "Berat"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    expected = {}
    for i, r in enumerate(read):
        near = sorted((distance(r, e), e) for e in entries if distance(r, e) <= 2 and distance(r, e) <= 0.34 * max(len(r), len(e)))
        if near:
            expected[i] = near[0]
    rows = joins.nearest_names(spark.createDataFrame(list(enumerate(read)), "id int, name string"), spark.createDataFrame([(e,) for e in entries], "entry string"))
    assert {r["id"]: (r["distance"], r["entry"]) for r in rows.collect()} == expected


def test_longest_prefix(spark):
    rows = joins.longest_prefix(spark.createDataFrame([(1, "a b c d"), (2, "x")], "id int, phrase string"), spark.createDataFrame([("a",), ("a b c",), ("b",)], "term string"))
    assert [tuple(r) for r in rows.collect()] == [(1, "a b c", 3)]


def test_fixed_window_restarts_at_the_first_event_after_its_end(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:11", "2024-01-01 00:00:12", "2024-01-01 00:00:22"])], "key long, id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r["id"]: (r["place"], r["allowed"]) for r in timing.fixed_window_limit(rows, 2, 10).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (1, True), 3: (2, True), 4: (1, True)}


def test_unconfirmed_override_hides_an_older_confirmed_one(spark):
    rows = spark.createDataFrame([(1, "k", 1, "a", True), (1, "k", 2, "b", False), (2, "k", 1, None, True)], "doc long, key string, version long, value string, confirmed boolean")
    got = {r["doc"]: (r["final_value"], r["final_state"]) for r in ledger.resolved_overrides(rows).collect()}
    assert got == {1: (None, "absent"), 2: (None, "rejected")}


def test_acceptance_of_a_document_that_reads_nothing(spark):
    truth = spark.createDataFrame([(1, "a", "x", True), (1, "b", "", True)], "doc long, key string, value string, critical boolean")
    produced = spark.createDataFrame([], "doc long, key string, value string, review boolean")
    row = metrics.acceptance(metrics.verdicts(truth, produced)).first()
    assert row["empty"] == 1 and row["critical_total"] == 1 and not row["production_ready"]


def test_registry_round_trip(spark, tmp_path):
    header = ",".join(tables.REGISTRY.names)
    (tmp_path / "r.csv").write_text(header + '\nplace,"клю,ч",x,"A ""quoted"" name",a|b,1990-01-01,,http://s,,,,,,\nother,,,,,2000-01-01,1990-01-01,,,,,,,\n', encoding="utf-8")
    rows = tables.registry(spark, str(tmp_path / "r.csv"))
    assert rows.where("category = 'place'").first()["aliases"] == ["a", "b"]
    assert rows.where("category = 'place'").first()["official_en"] == 'A "quoted" name'
    assert tables.registry_violations(rows, ["place"]).first()["violations"] == ["category", "source_url", "interval"]


def test_upsert_and_append(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, arrival int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (3, "e", 1)], "id int, v string, arrival int")
    assert {tuple(r) for r in tables.append_new(old, new, "id").select("id", "v").collect()} == {(3, "e")}
    assert {r["v"] for r in tables.upserted(old, new.where("v <> 'e'"), "id").collect()} == {"a", "c", "d"}


def test_limits_reject_a_threshold_that_is_not_finite(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00")], "k int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert timing.rolling_counts(rows, "k", 60, float("inf")).first()["alert"] is False
    assert pytest.approx(timing.rolling_counts(rows, "k", 60, 0).first()["n"]) == 1
