"""Weighted searches and cascades, and the gates branch by branch, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldwright.functions import places
from fieldwright.operators import fuzzy, rules, timing

CHEAP = {frozenset(p) for p in (("т", "п"), ("и", "н"), ("ш", "т"), ("ш", "щ"), ("е", "є"), ("и", "й"), ("л", "а"), ("о", "с"), ("р", "г"), ("ц", "щ"), ("в", "б"), ("м", "ш"), ("н", "п"), ("і", "и"), ("ї", "і"), ("у", "ч"), ("д", "л"), ("к", "н"))}
R = random.Random(12)
LETTERS = "тпиншщеєйлаосргцвбмкіїучджя'- "


def distance(a, b):
    """In fifths of an edit."""
    above = [5 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [5 * i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 5, row[-1] + 5, above[j - 1] + (0 if x == y else 2 if frozenset((x, y)) in CHEAP else 5)))
        above = row
    return above[-1]


def words(n, low=1, high=10):
    return ["".join(R.choice(LETTERS) for _ in range(R.randint(low, high))).strip() or "а" for _ in range(n)]


def misread(word):
    out = list(word)
    for _ in range(R.randrange(3)):
        i = R.randrange(len(out)) if out else 0
        out[i : i + R.randrange(2)] = R.choice(LETTERS)
    return "".join(out)


@pytest.mark.parametrize("share,cap", [(0.34, 2.0), (0.5, None), (0.0, None), (1.0, 1.0)])
def test_a_trie_finds_all_near_spellings(share, cap):
    keys = words(150) + ["ab", "тростянець"]
    readings = [misread(w) for w in keys[:60]] + ["простянець", "latin", "", "zz", "x" * 40]
    trie = fuzzy.Trie(keys)
    q, k, d = trie.search(readings, share, cap)
    got = sorted((readings[i], trie.keys[j], int(x)) for i, j, x in zip(q, k, d))
    want = sorted((r, s, distance(r, s)) for r in readings for s in set(keys) if distance(r, s) <= share * 5 * max(len(r), len(s)) + 1e-9 and (cap is None or distance(r, s) <= 5 * cap))
    assert got == want
    assert len(fuzzy.Trie([]).search(["x"], 0.5, None)[0]) == 0


@pytest.mark.parametrize("trie,readings", [(50_000, 4096), (20, 7)])
def test_readings_meet_every_part_of_the_spellings(spark, trie, readings):
    keys, asked = sorted(set(words(90, 3))), sorted({misread(w) for w in words(60, 3)} - {""})
    known = spark.createDataFrame([(c, k) for k in keys for c in ("a", "b")] + [("c", "alone"), ("a", None)], "category string, key string")
    wanted = spark.createDataFrame([("a", w) for w in asked] + [("z", "alone"), ("a", None), ("a", "")], "category string, wanted string")
    got = {(r.category, r.wanted, r.key, round(r.distance * 5)) for r in fuzzy.weighted_matches(wanted, known, 0.5, None, trie, readings).collect()}
    assert got == {("a", w, k, distance(w, k)) for w in asked for k in keys if distance(w, k) <= 2.5 * max(len(w), len(k)) + 1e-9}


def test_the_registry_fallback_equals_a_plain_version(spark):
    rows = [(c, k, (k + "ий") if i % 3 == 0 else None, [f"с {k}"] if i % 4 == 0 else [], f"EN{i % 17}", i) for i, k in enumerate(words(60, 3)) for c in ("settlement", "oblast", "authority")]
    registry = spark.createDataFrame(rows, "category string, key_uk string, key_ru string, aliases array<string>, official_en string, ordinal long")
    asked = [(n, c, t) for n, (c, t) in enumerate((R.choice(("settlement", "oblast", "authority", "none")), misread(R.choice(rows)[1])) for _ in range(120))] + [(900, "settlement", None), (901, "settlement", " "), (0, "settlement", "twice")]
    misses = spark.createDataFrame(asked, "lookup_id long, category string, term string")
    got = sorted(map(str, map(tuple, fuzzy.fuzzy_registry(misses, registry).collect())))
    want = []
    for n, category, term in asked:
        said = " ".join((term or "").lower().split())
        scored = []
        for c, uk, ru, aliases, official, ordinal in rows if said and category in ("settlement", "oblast") else ():
            for k in {" ".join(s.lower().split()) for s in (uk, ru, *aliases) if s}:
                share = distance(said, k) / 5 / max(len(said), len(k))
                if c == category and share <= 0.5 + 1e-9:
                    scored.append((share, ordinal, official))
        scored.sort()
        hit = scored and scored[0][0] <= 0.34 + 1e-9
        want.append((n, scored[0][2] if hit else None, round(max(0.4, 0.9 - scored[0][0]), 6) if hit else 0.0, bool(hit), list(dict.fromkeys(o for _, _, o in scored)) if hit else []))
    assert got == sorted(map(str, want))
    strict = fuzzy.fuzzy_registry(misses, registry, strict=True).collect()
    assert len(strict) == len(asked) and not any(r.matched for r in strict)


def test_places_are_taken_suggested_or_left(spark):
    entries = ["Тростянець", "Шаргород", "Бар", "Коломия", "Вінниця", "Київ"]
    reads = ["Простянець", "шаргород", "Вінниц", "Бра", "Нолонин", "", None, "Жданівка", "смт. Тростянець,", "м. Київ", "село Ярошенець", "Коломия.", "Вінниця "]
    gazetteer = spark.createDataFrame(list(enumerate(entries)), "ordinal int, entry string")
    got = {r.id: r for r in fuzzy.snapped(spark.createDataFrame(list(enumerate(reads)), "id int, name string"), gazetteer).collect()}
    clean = {8: "Тростянець", 9: "Київ", 10: "Ярошенець", 11: "Коломия", 12: "Вінниця"}
    for i, read in enumerate(reads):
        name = clean.get(i, read or "")
        lower = name.lower()
        exact = [e for e in entries if e.lower() == lower]
        best, _, entry = min((distance(lower, e.lower()) / 5, n, e) for n, e in enumerate(entries))
        near = not exact and name and best <= 2 and best <= 0.34 * max(len(lower), len(entry)) + 1e-9
        assert got[i].reason == ("empty" if not name else "exact" if exact else "fuzzy_geography_match" if near else "unknown_geography")
        assert (got[i].value, got[i].matched, got[i].suggested) == (exact[0] if exact else name, bool(exact), entry if near else None)
    names = ["Kiev", "Odessa", "Kirovograd", "м. Київ", "селище міського типу Бар", "смт Простянець", "", None, "  ", "Middle Name", "Чортория", "м.Київ"]
    city = {r.id: tuple(r)[2:] for r in fuzzy.cities(spark.createDataFrame(list(enumerate(names)), "id int, name string"), gazetteer).collect()}
    assert city[0] == ("Kyiv", "knowledge", False, None) and city[1][0] == "Odesa" and city[2][0] == "Kropyvnytskyi"
    assert city[3] == ("Київ", "gazetteer", False, None) and city[4] == ("Бар", "gazetteer", False, None)
    assert city[5] == ("Простянець", "passthrough", True, "Тростянець") and city[10] == ("Чортория", "passthrough", True, None)
    assert city[6] == city[7] == city[8] == (None, "knowledge", False, None)
    plain = {r.id: tuple(r)[2:] for r in fuzzy.cities(spark.createDataFrame(list(enumerate(names)), "id int, name string"), None).collect()}
    assert plain[5] == ("Простянець", "passthrough", False, None) and plain[11] == ("м.Київ", "passthrough", False, None)
    regions = ["Вінницької обл.", "Київська область", "Атлантида", "", None]
    rows = spark.createDataFrame(list(enumerate(regions)), "id int, name string").select("id", fuzzy.province(F.col("name")).alias("p")).orderBy("id").select("p.*").collect()
    assert [tuple(r) for r in rows] == [("Vinnytsia Oblast", "knowledge"), ("Kyiv Oblast", "knowledge"), ("Атлантида", "passthrough"), (None, "knowledge"), (None, "knowledge")]


def test_both_letters_of_every_pair_differ():
    assert {frozenset(p) for p in places.CONFUSABLE} == CHEAP and all(len(set(p)) == 2 for p in places.CONFUSABLE)


GOOD = dict(criticality="critical_identity", document_class="passport", source_type="p", expected_type="p", source_session="s", session="s", confidence=0.9, value_present=True, candidate_present=False, review_required=False, manual_required=False, zero_usable=False, classifier_conflict=False, hard_case=False, legacy_reader=False, strong_anchor=True)
CASES = [
    ({}, "accept_final", []),
    ({"value_present": False}, "manual_required", ["zero_usable_recognition"]),
    ({"zero_usable": True}, "block", ["zero_usable_recognition"]),
    ({"source_type": "q"}, "manual_required", ["source_doc_type_mismatch"]),
    ({"source_type": "q", "value_present": False}, "block", ["source_doc_type_mismatch"]),
    ({"source_type": None}, "accept_final", []),
    ({"session": "t"}, "manual_required", ["stale_or_ambiguous_session"]),
    ({"session": ""}, "accept_final", []),
    ({"classifier_conflict": True}, "manual_required", ["classifier_conflict"]),
    ({"document_class": "unknown_document"}, "manual_required", ["hard_case_manual_required", "unknown_document_class"]),
    ({"document_class": "ua_birth_certificate"}, "candidate_only", ["hard_case_manual_required"]),
    ({"hard_case": True, "value_present": False}, "manual_required", ["hard_case_manual_required"]),
    ({"hard_case": True, "value_present": False, "candidate_present": True}, "candidate_only", ["hard_case_manual_required"]),
    ({"legacy_reader": True}, "accept_final", []),
    ({"legacy_reader": True, "strong_anchor": False}, "candidate_only", ["legacy_reader_untrusted", "no_strong_source_anchor"]),
    ({"strong_anchor": None}, "candidate_only", ["no_strong_source_anchor"]),
    ({"confidence": 0.69}, "candidate_only", ["low_confidence"]),
    ({"confidence": 0.7}, "accept_final", []),
    ({"confidence": None}, "accept_final", []),
    ({"criticality": "admin", "zero_usable": True, "strong_anchor": False, "value_present": False}, "accept_final", ["zero_usable_recognition"]),
    ({"criticality": "optional", "source_type": "q"}, "manual_required", ["source_doc_type_mismatch"]),
    ({"criticality": "admin", "session": "t", "candidate_present": True}, "manual_required", ["stale_or_ambiguous_session"]),
    ({"criticality": None}, "accept_final", []),
    ({"review_required": True, "manual_required": True}, "accept_final", []),
]


def test_a_reading_is_safe_or_not_branch_by_branch(spark):
    schema = "i int, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in GOOD.items())
    rows = spark.createDataFrame([(i, *(GOOD | case).values()) for i, (case, _, _) in enumerate(CASES)], schema)
    for r in rules.safe_reading(rows).collect():
        case, decision, reasons = CASES[r.i]
        final = decision == "accept_final"
        assert (r.decision, r.reasons) == (decision, reasons), case
        assert r.final_allowed == final and r.blocked != final
        assert r.candidate_allowed == (decision == "candidate_only" or not final and bool(case.get("candidate_present")))
        assert r.review == (not final or bool(case.get("review_required"))) and r.manual == (not final or bool(case.get("manual_required")))
    fields = spark.createDataFrame([(1, "critical_document", True, None, True), (1, "admin", True, True, None), (2, "critical_identity", None, True, None), (3, "optional", True, True, False)], "doc int, criticality string, review boolean, manual boolean, confirmed boolean")
    assert sorted(map(tuple, rules.unresolved_critical(fields).collect())) == [(1, False), (2, True), (3, False)]


def test_a_run_of_paid_calls_is_denied_for_the_first_reason(spark):
    cases = [
        ((None, 1.0, 1.0, 1.0, 1.0), "paid_calls_disabled"), ((False, -1.0, 1.0, 1.0, 1.0), "paid_calls_disabled"), ((True, math.inf, 1.0, 1.0, 1.0), "invalid_request"), ((True, 1.0, math.nan, 1.0, 1.0), "invalid_request"),
        ((True, 1.0, 1.0, None, 1.0), "invalid_request"), ((True, 1.0, 1.0, 1.0, None), "invalid_request"), ((True, 1.0, 1.0, 1.0, -0.1), "invalid_request"), ((True, 11.0, 9.0, 99.0, 999.0), "per_run_doc_cap_exceeded"),
        ((True, 10.0, 5.1, 99.0, 999.0), "per_run_cost_cap_exceeded"), ((True, 10.0, 5.0, 15.1, 999.0), "daily_cap_exceeded"), ((True, 10.0, 5.0, 15.0, 95.1), "monthly_cap_exceeded"), ((True, 10.0, 5.0, 15.0, 95.0), "ok"), ((True, 0.0, 0.0, 0.0, 0.0), "ok"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, enabled boolean, planned double, cost double, today double, month double")
    got = rows.orderBy("i").select(timing.budget_reason(*map(F.col, ("enabled", "planned", "cost", "today", "month")), 10, 5, 20, 100)).collect()
    assert [r[0] for r in got] == [reason for _, reason in cases]


def test_confirmed_values_are_tested_without_their_margins(spark):
    cases = [(" ", True, False, "empty_critical"), (" \t", True, False, "empty_critical"), ("", False, True, None), (None, True, False, "empty_critical"), ("Іван", False, False, "contains_cyrillic"), ("x" * 200 + "  ", True, False, None), ("x" * 201, True, False, "too_long"), ("a\x07b", True, False, "control_characters"), ("a\nb", True, False, None), (" 01/02/1990 ", True, True, None), ("1990-01-02", True, True, None), ("1990", True, True, "date_shape"), ("1990", True, False, None)]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, v string, critical boolean, dated boolean")
    got = rows.orderBy("i").select(rules.confirmed_value_problem(F.col("v"), F.col("critical"), F.col("dated"))).collect()
    assert [r[0] for r in got] == [c[3] for c in cases]
