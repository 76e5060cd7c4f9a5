"""Names, dates, machine-readable lines, rules, extraction and leases on small invented inputs."""

import json

from pyspark.sql import functions as F

from fieldwright.functions import dates, names, text
from fieldwright.operators import extract, rules
from fieldwright.plans import catalogue
from fieldwright.streaming import leases

FOLDER = "/root/testdata/sf0.001"


def values(spark, f, items):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("o")).collect()]


def test_ukrainian_latin(spark):
    given = ["Згурський", "Їжак", "Маʼяна", "Юрій Знам'янка", "ІВАН ЩЕРБА", "Розгон", "abc", "", None, "зЄ"]
    assert values(spark, names.ukrainian_latin, given) == ["Zghurskyi", "Yizhak", "Maiana", "Yurii Znamianka", "IVAN SHCHERBA", "Rozghon", "abc", "", None, "zIe"]


def test_russian_latin(spark):
    assert values(spark, names.russian_latin, ["Елена", "Объезд", "Ёлкин Пётр", "Юрьев", "Анна Ельцова", "", None]) == ["Yelena", "Obyezd", "Yelkin Petr", "Yuryev", "Anna Eltsova", "", None]


def test_patronymics(spark):
    assert values(spark, lambda c: names.valid_patronymic(c, F.lit("M")), ["Іванович", "ович", "йович", "Іван0вич"]) == [True, False, False, False]
    assert values(spark, lambda c: names.valid_patronymic(c, F.lit("F")), ["Іванівна", "івна", "Сергіївна", "инічна"]) == [True, False, True, False]
    assert values(spark, lambda c: names.patronymic(F.lit(None).cast("string"), c, F.lit("F"))["value"], ["Іван", "Андрій", "Лев", "Олекса", "", None]) == ["Іванівна", "Андріївна", "Львівна", "", "", ""]


def test_dates(spark):
    assert values(spark, dates.form_date, ["1.05.1990", "01 січня 1990 року", "5 мая 1990 г.", "x", "99.99.1990"]) == ["05/01/1990", "01/01/1990", "05/05/1990", None, "99/99/1990"]
    assert values(spark, dates.strict_date, ["2024/2/3", "13/02/2024", "02/13/2024", "02/03/2024", "", "2024-13-01", None]) == ["2024-02-03", "2024-02-13", "2024-02-13", None, None, None, None]
    assert [tuple(r) for r in values(spark, dates.date_parts, ["06/14/1990", "14.06.1990", "марта 1980", "", None])] == [(14, 6, 1990), (14, 6, 1990), (None, 3, 1980), (None, None, None), (None, None, None)]


def test_machine_lines_of_the_public_specimens(spark):
    one, two = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    read = values(spark, lambda c: dates.mrz_td3(c, F.lit(two), icao=True), [one, "short"])
    assert read[1] is None and read[0].checks_ok and (read[0].surname, read[0].given_names, read[0].date_of_birth, read[0].personal_number) == ("ERIKSSON", "ANNA MARIA", "1974-08-12", "ZE184226B")
    lines = spark.createDataFrame([(1, one, two), (2, one, "short"), (3, None, None)], "id long, one string, two string")
    assert [(r.id, r.surname) for r in extract.machine_fields(lines, ["id"], dates.mrz_td3(F.col("one"), F.col("two"))).orderBy("id").collect()] == [(1, "ERIKSSON"), (2, None), (3, None)]
    card = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]
    assert values(spark, lambda c: dates.mrz_td1(c, F.lit(card[1]), F.lit(card[2]), icao=True)["checks_ok"], [card[0], card[0].replace("D2", "D3")]) == [True, False]


def test_json_loses_forbidden_keys_at_any_depth(spark):
    given = '{"a": [{"NAME": 1, "b": {"dob": 2, "c": "ї"}}], "text": {}}'
    assert values(spark, text.redact_json, [given, "no json", None, "3"]) == [json.dumps({"a": [{"b": {"c": "ї"}}]}, ensure_ascii=False), None, None, "3"]


def test_batteries_on_absent_fields_and_specimen(spark):
    made = "doc long, field string, value string, zone string, ocr_ids array<string>"
    one, two = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    rows = [(1, "mrz_1", one, "mrz", ["1"]), (1, "mrz_2", two, "mrz", ["2"]), (1, "surname", "Eriksen", "viz", ["3"]), (1, "document_number", "L898902C3", "viz", []), (2, "mrz_1", "x", "mrz", None), (2, "mrz_2", "y", "mrz", None), (3, "other", None, None, None)]
    found = {(r.doc, r.reason) for r in rules.findings(spark.createDataFrame(rows, made), rules.BATTERIES["international_passport"]).collect()}
    assert {(1, "mrz_viz_mismatch_surname"), (1, "document_number_no_ocr_evidence"), (1, "issuing_state_missing"), (2, "mrz_parse_error"), (3, "mrz_lines_missing"), (3, "personal_number_absent")} <= found
    assert (1, "mrz_viz_mismatch_document_number") not in found and (1, "mrz_lines_missing") not in found
    for battery in rules.BATTERIES.values():
        assert rules.findings(spark.createDataFrame([], made), battery).count() == 0


def test_expiry(spark):
    made = "doc long, field string, value string, zone string, ocr_ids array<string>"
    rows = [(i, "e", v, None, None) for i, v in enumerate(["2030-01-01", "2020-01-01", "01.02.2030", "2030-02-31", None])]
    got = {r.doc: r.reason for r in rules.findings(spark.createDataFrame(rows, made), (rules.not_expired("e", "2024-01-01"),)).collect()}
    assert got == {1: "e_expired", 2: "e_format_invalid", 3: "e_parse_failed"}


def test_label_values_stop_at_the_next_label(spark):
    docs = spark.createDataFrame([(1, "Name\nCity: Kyiv"), (2, "Name:\n\nAnna"), (3, "Anna\nName\n"), (4, ""), (5, None), (6, "City\nName\nBob")], "doc long, text string")
    got = {(r.doc, r.field): (r.line_no, r.value, r.confidence) for r in extract.label_values(docs, [("name", "^Name", "[A-Z]"), ("city", "^City", "[A-Z]")]).collect()}
    assert got == {(1, "city"): (1, "Kyiv", "high"), (2, "name"): (0, "Anna", "medium"), (3, "name"): (1, "Anna", "medium"), (6, "name"): (1, "Bob", "medium")}


def test_lease_steps():
    state, ok, status = leases.step(None, 0, "a", "acquire", 10)
    assert (state, ok, status) == (("in_flight", "a", 10_000_000), True, "in_flight")
    assert leases.step(state, 10_000_000, "b", "acquire") == (state, False, "in_flight")
    taken, ok, _ = leases.step(state, 10_000_001, "b", "acquire", 10)
    assert ok and taken[1] == "b"
    assert leases.step(taken, 1, "a", "complete") == (taken, False, "in_flight")
    done, ok, status = leases.step(taken, 1, "b", "complete")
    assert (ok, status) == (True, "done") and leases.step(done, 10**12, "c", "acquire") == (done, False, "done")
    assert leases.step(None, 1, "a", "fail") == (None, False, "none")


def test_leases_of_the_batch_the_stream_and_brute_force(spark):
    batch, stream = (sorted(map(tuple, catalogue.queries()[q](spark, FOLDER).collect())) for q in ("lease_fold", "stream_lease_fold"))
    rows = leases.requests_of(spark.read.parquet(f"{FOLDER}/events.parquet")).collect()
    held, want = {}, []
    for r in sorted(rows, key=lambda r: (r.micros, r.id)):
        held[r.key], ok, status = leases.step(held.get(r.key), r.micros, r.owner, r.op)
        want.append((r.key, r.id, r.op, ok, status))
    assert batch == stream == sorted(want)
