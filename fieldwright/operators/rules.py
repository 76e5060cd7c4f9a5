"""Rules on the fields of a document.

fields (doc, field, value, zone, ocr_ids array<string>): a document's fields become one map, on which every rule
is a column expression; a document has a few dozen fields, so the map is small. A rule gives reasons; a
document's findings are the reasons of all rules of its battery.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.functions import dates, names

#: A rule turns a getter of field structs into pairs of condition and reason.
Get = Callable[[str], Column]
Rule = Callable[[Get], list[tuple[Column, str]]]


def _blank(field: Column) -> Column:
    return F.trim(F.coalesce(field["value"], F.lit(""))) == ""


def _shared(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a["ocr_ids"], b["ocr_ids"])


def distinct_numbers(a: str, b: str) -> Rule:
    """Two numbers must differ, and come from different zones and tokens."""
    return lambda get: [
        (~_blank(get(a)) & (F.trim(get(a)["value"]) == F.trim(get(b)["value"])), f"{a}_equals_{b}"),
        (get(a)["zone"] == get(b)["zone"], f"{a}_and_{b}_same_zone"),
        (_shared(get(a), get(b)), f"{a}_and_{b}_share_ocr_ids"),
    ]


def required(field: str) -> Rule:
    return lambda get: [(get(field).isNull() | _blank(get(field)), f"{field}_missing")]


def zone_lock(field: str, zone: str, others: tuple[str, ...] = ()) -> Rule:
    """A field must come from its zone and share no tokens with others."""
    return lambda get: [
        (get(field)["zone"] != zone, f"{field}_wrong_zone"),
        (get(field).isNotNull() & get(field)["zone"].isNull(), f"{field}_zone_not_verified"),
        *[(_shared(get(field), get(o)), f"{field}_shares_tokens_with_{o}") for o in others],
    ]


def order_kept(first: tuple[str, ...], second: tuple[str, ...], first_zone: str, second_zone: str) -> Rule:
    """Fields of one side must not come from the other side's zone."""
    return lambda get: [*[(get(f)["zone"] == second_zone, f"{f}_from_{second_zone}") for f in first], *[(get(f)["zone"] == first_zone, f"{f}_from_{first_zone}") for f in second]]


def not_same_zone(*fields: str) -> Rule:
    return lambda get: [(get(a)["zone"] == get(b)["zone"], f"{a}_and_{b}_from_same_zone") for a, b in combinations(fields, 2)]


def evidence(field: str) -> Rule:
    """A value needs tokens that it was read from."""
    return lambda get: [(~_blank(get(field)) & (F.coalesce(F.size(get(field)["ocr_ids"]), F.lit(0)) == 0), f"{field}_no_ocr_evidence")]


def one_script(field: str) -> Rule:
    return lambda get: [(names.mixed_script(get(field)["value"]), f"{field}_mixed_script")]


def in_nominative(field: str) -> Rule:
    return lambda get: [(names.nominative(get(field)["value"]) != get(field)["value"], f"{field}_oblique_case_detected")]


def not_expired(field: str, today: str) -> Rule:
    """An ISO date that is not before today."""
    value = lambda get: F.trim(get(field)["value"])
    parsed = lambda get: F.try_to_date(value(get), "yyyy-MM-dd")
    return lambda get: [
        (~_blank(get(field)) & ~value(get).rlike(r"^\d{4}-\d{2}-\d{2}$"), f"{field}_format_invalid"),
        (value(get).rlike(r"^\d{4}-\d{2}-\d{2}$") & parsed(get).isNull(), f"{field}_parse_failed"),
        (parsed(get) < F.lit(today).cast("date"), f"{field}_expired"),
    ]


def state_is(field: str, state: str) -> Rule:
    return lambda get: [*required(field)(get), (~_blank(get(field)) & (F.upper(F.trim(get(field)["value"])) != state), f"{field}_not_{state.lower()}")]


def sensitive(field: str, pattern: str) -> Rule:
    """A personal number goes to review whatever it is; its absence and a wrong form are told apart."""
    return lambda get: [
        (get(field).isNull() | _blank(get(field)), f"{field}_absent"),
        (~_blank(get(field)) & ~F.trim(get(field)["value"]).rlike(pattern), f"{field}_format_invalid"),
        (~_blank(get(field)) & F.trim(get(field)["value"]).rlike(pattern), f"{field}_always_review"),
    ]


def machine_lines(*lines: str) -> Rule:
    """Two lines of a passport or three of a card parse and their check digits hold."""
    parse = dates.mrz_td3 if len(lines) == 2 else dates.mrz_td1

    def reasons(get: Get) -> list[tuple[Column, str]]:
        texts = [get(x)["value"] for x in lines]
        missing = F.coalesce(F.exists(F.array(*texts), lambda t: t.isNull() | (t == "")), F.lit(True))
        return [(missing, "mrz_lines_missing"), (~missing & parse(*texts).isNull(), "mrz_parse_error"), (~parse(*texts)["checks_ok"], "mrz_check_digit_failure")]

    return reasons


def machine_agrees(lines: tuple[str, ...], fields: tuple[str, ...]) -> Rule:
    """What the machine lines say equals the printed fields of the same names but for case and white space."""
    tidy = lambda c: F.regexp_replace(F.trim(F.upper(c)), r"\s+", " ")
    parse = dates.mrz_td3 if len(lines) == 2 else dates.mrz_td1
    return lambda get: [(tidy(parse(*[get(x)["value"] for x in lines])[f]) != tidy(get(f)["value"]), f"mrz_viz_mismatch_{f}") for f in fields]


def registry_office(field: str, known: tuple[str, ...]) -> Rule:
    """An office is told; old and new names of it do not stand together, and its abbreviations are known ones."""

    def reasons(get: Get) -> list[tuple[Column, str]]:
        value = F.coalesce(get(field)["value"], F.lit(""))
        both = value.contains("ЗАГС") & value.contains("ДРАЦС")
        unknown = F.exists(F.split(F.trim(value), r"\s+"), lambda t: t.rlike("^[А-ЯЁІЇЄҐ]{2,8}$") & ~t.isin(*known))
        return [(get(field).isNull() | (value == ""), f"{field}_missing"), (both, "civil_registry_modernization_conflict"), (~both & unknown, "civil_registry_abbreviation_not_verified")]

    return reasons


def primary_layer(field: str) -> Rule:
    """A value read from the Russian layer of a bilingual form is for review."""
    return lambda get: [(F.coalesce(get(field)["zone"].contains("russian"), F.lit(False)) & ~_blank(get(field)), f"{field}_russian_fallback")]


def original_latin(field: str) -> Rule:
    """A Latin name comes from the Latin or machine-readable zone, not from a Cyrillic one, and is not spelled as if it had."""
    return lambda get: [
        (F.coalesce(get(field)["value"], F.lit("")).rlike(RESPELLED), f"{field}_likely_retransliterated"),
        (F.exists(F.array(*map(F.lit, CYRILLIC_ZONES)), lambda z: F.contains(F.lower(get(field)["zone"]), z)), f"{field}_from_cyrillic_zone"),
    ]


#: Letters that Latin spellings of documents do not have, and names of zones in Cyrillic.
RESPELLED = r"[ʹʺ'’]|shch'|[ěšžčř]"
CYRILLIC_ZONES = ("cyrillic", "кирил", "ukr_text", "ukrainian_layer")


def number_kinds(document: str, record: str) -> Rule:
    """A card's document number has nine digits and its record number fourteen; each looks like itself."""
    value = lambda get, f: F.trim(F.coalesce(get(f)["value"], F.lit("")))
    return lambda get: [(value(get, document).rlike(r"^\d{14}"), f"{document}_appears_to_be_{record}"), (value(get, record).rlike(r"^\d{9}$"), f"{record}_appears_to_be_{document}")]


def legal_basis(field: str, words: int = 30) -> Rule:
    """A basis that is long, or names articles or cases, is for review."""
    value = lambda get: F.trim(F.coalesce(get(field)["value"], F.lit("")))
    legal = r"(?iu)ст\.\s*\d+|стаття\s+\d+|справа\s+№|article\s+\d+"
    return lambda get: [*required(field)(get), (F.size(F.split(value(get), r"\s+")) > words, "complex_legal_basis"), (value(get).rlike(legal), "legal_text_reference_detected")]


def surnames_kept(before: str, after: str) -> Rule:
    """Surnames before and after the event: their zones are not each other's, and they are not one reading."""
    return lambda get: [
        (F.coalesce(get(before)["zone"].contains("після"), F.lit(False)) | F.coalesce(get(after)["zone"].contains("до"), F.lit(False)), "before_after_surname_label_mismatch"),
        (~_blank(get(before)) & (F.trim(get(before)["value"]) == F.trim(get(after)["value"])) & get(before)["zone"].eqNullSafe(get(after)["zone"]), "before_after_surname_identical_in_same_zone"),
    ]


def mislabelled(labels: Column) -> Column:
    """What is wrong with a certificate's labels (field -> label): numbers or patronymics that go by other names."""
    of = lambda f: F.lower(F.coalesce(F.try_element_at(labels, F.lit(f)), F.lit("")))
    return F.array_compact(F.array(F.when(of("act_record_number").contains("certificate number"), F.lit("act_record_number")), F.when(of("child_patronymic").contains("middle name"), F.lit("child_patronymic"))))


_NUMBERS = ("certificate_number", "act_record_number")
#: Abbreviations of offices that are known.
OFFICES = ("ЗАГС", "РАЦС", "ДРАЦС", "МВС", "УМВС", "ГУМВС", "ДМС")
#: Batteries by kind of document.
BATTERIES: dict[str, tuple[Rule, ...]] = {
    "birth_certificate": (
        distinct_numbers(*_NUMBERS), required("act_record_date"), zone_lock("act_record_date", "act_record", ("date_of_birth", "date_of_issue")), required("date_of_issue"), zone_lock("date_of_issue", "issue"),
        order_kept(("father_name",), ("mother_name",), "father", "mother"), in_nominative("father_name"), in_nominative("mother_name"), one_script("child_name"), registry_office("issuing_authority", OFFICES), evidence("child_name"), primary_layer("child_name"),
    ),
    "marriage_certificate": (
        distinct_numbers(*_NUMBERS), required("act_record_number"), zone_lock("act_record_date", "act_record", ("date_of_marriage", "date_of_issue")), zone_lock("date_of_marriage", "event", ("date_of_issue",)),
        zone_lock("date_of_issue", "issue"), order_kept(("spouse_1_given_names",), ("spouse_2_given_names",), "spouse_1", "spouse_2"), not_same_zone("spouse_1_given_names", "spouse_2_given_names"), evidence("certificate_number"),
    ),
    "divorce_certificate": (
        distinct_numbers(*_NUMBERS), required("act_record_number"), zone_lock("act_record_date", "act_record", ("date_of_divorce", "date_of_issue")), zone_lock("date_of_divorce", "event", ("date_of_issue",)),
        zone_lock("date_of_issue", "issue"), order_kept(("spouse_1_given_names",), ("spouse_2_given_names",), "spouse_1", "spouse_2"), legal_basis("basis_of_divorce"), evidence("court"), surnames_kept("surname_before", "surname_after"),
    ),
    "international_passport": (
        machine_lines("mrz_1", "mrz_2"), machine_agrees(("mrz_1", "mrz_2"), ("surname", "given_names", "document_number", "date_of_birth", "date_of_expiry")), state_is("issuing_state", "UKR"),
        sensitive("personal_number", r"^\d{10}$|^\d{8}-\d{5}$"), one_script("surname"), original_latin("surname"), evidence("document_number"),
    ),
    "id_card": (
        machine_lines("mrz_1", "mrz_2", "mrz_3"), machine_agrees(("mrz_1", "mrz_2", "mrz_3"), ("surname", "given_names", "document_number", "date_of_birth")), distinct_numbers("document_number", "record_number"),
        number_kinds("document_number", "record_number"), state_is("issuing_state", "UKR"), sensitive("personal_number", r"^\d{10}$"), one_script("surname"), original_latin("surname"), evidence("document_number"),
    ),
}


def findings(fields: DataFrame, battery: tuple[Rule, ...]) -> DataFrame:
    """(doc, reason): what the battery's rules find. Of rows of one field the first in order of value, zone and tokens counts."""
    one = fields.groupBy("doc", "field").agg(F.min(F.struct("value", "zone", "ocr_ids")).alias("f"))
    docs = one.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("field", "f"))).alias("m"))
    get = lambda name: F.try_element_at(F.col("m"), F.lit(name))
    reasons = [F.when(condition, F.lit(reason)) for rule in battery for condition, reason in rule(get)]
    return docs.select("doc", F.explode(F.array_distinct(F.array_compact(F.array(*reasons)))).alias("reason"))


def confirmed_value_problem(value: Column, critical: Column, is_date: Column) -> Column:
    """Why a value that a user confirmed is not taken, tested without the white space around it: empty_critical, contains_cyrillic, too_long, control_characters, date_shape; null if it is."""
    v = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (
        F.when(critical & (v == ""), "empty_critical")
        .when(v.rlike(r"[\x{0400}-\x{04FF}]"), "contains_cyrillic")
        .when(F.length(v) > 200, "too_long")
        .when(v.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "control_characters")
        .when(is_date & (v != "") & ~v.rlike(r"^(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})$"), "date_shape")
    )


#: Classes of documents whose critical fields are for a person whatever is read, and the least confidence of a reading.
HARD_CLASSES = ("birth_certificate_soviet_bilingual", "birth_certificate_handwritten", "ua_birth_certificate", "unknown_document")
CONFIDENCE_FLOOR = 0.70


def safe_reading(fields: DataFrame) -> DataFrame:
    """Fields with what may be done with their reading: decision, final_allowed, candidate_allowed, review, manual, blocked and the reasons.

    fields: criticality (critical_identity, critical_document, admin, optional), document_class, source_type, expected_type, source_session,
    session, confidence, and the flags value_present, candidate_present, review_required, manual_required, zero_usable, classifier_conflict,
    hard_case, legacy_reader, strong_anchor; null flags count as false, a null type or session as not told. The value itself plays no part. Of a critical
    field a hard sign blocks where nothing usable is there, else it is for a person; a soft sign leaves a candidate where there is one.
    Other fields pass unless source or session differ. Flags that came in are never taken back.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    critical = F.coalesce(F.col("criticality").isin("critical_identity", "critical_document"), F.lit(False))
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) != ""
    mismatch = told("expected_type") & told("source_type") & (F.col("source_type") != F.col("expected_type"))
    stale = told("source_session") & told("session") & (F.col("source_session") != F.col("session"))
    kind = F.coalesce("document_class", F.lit(""))
    unknown = kind == "unknown_document"
    hard = flag("zero_usable") | mismatch | stale | flag("classifier_conflict") | unknown
    hard_case, low = flag("hard_case") | kind.isin(*HARD_CLASSES), F.coalesce(F.col("confidence") < CONFIDENCE_FLOOR, F.lit(False))
    legacy = flag("legacy_reader") & ~flag("strong_anchor")
    soft = hard_case | legacy | ~flag("strong_anchor") | low
    empty = ~flag("value_present")
    decision = (
        F.when(critical & hard, F.when(flag("zero_usable") | empty, "block").otherwise("manual_required"))
        .when(critical & soft, F.when(~empty | flag("candidate_present"), "candidate_only").otherwise("manual_required"))
        .when(~critical, F.when(mismatch | stale, "manual_required").otherwise("accept_final"))
        .otherwise(F.when(empty, "manual_required").otherwise("accept_final"))
    )
    nothing = critical & ~hard & ~soft & empty
    signs = [
        (flag("zero_usable"), "zero_usable_recognition"), (mismatch, "source_doc_type_mismatch"), (stale, "stale_or_ambiguous_session"), (flag("classifier_conflict"), "classifier_conflict"),
        (critical & hard_case, "hard_case_manual_required"), (critical & legacy, "legacy_reader_untrusted"), (critical & ~flag("strong_anchor"), "no_strong_source_anchor"), (critical & low, "low_confidence"),
        (critical & unknown, "unknown_document_class"), (nothing, "zero_usable_recognition"),
    ]
    rows = fields.withColumns({"decision": decision, "reasons": F.array_compact(F.array(*[F.when(on, F.lit(name)) for on, name in signs]))})
    final = F.col("decision") == "accept_final"
    return rows.withColumns({
        "final_allowed": final, "candidate_allowed": (F.col("decision") == "candidate_only") | (~final & flag("candidate_present")), "review": flag("review_required") | ~final, "manual": flag("manual_required") | ~final, "blocked": ~final,
    })


def unresolved_critical(fields: DataFrame) -> DataFrame:
    """(doc): whether some critical field that is for review or for a person has not been confirmed, which holds back the output."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    critical = F.coalesce(F.col("criticality").isin("critical_identity", "critical_document"), F.lit(False))
    return fields.groupBy("doc").agg(F.bool_or(critical & (flag("review") | flag("manual")) & ~flag("confirmed")).alias("held_back"))


def gates_pass(gates: DataFrame) -> DataFrame:
    """(subject): whether every gate is PASS; one that was skipped blocks."""
    return gates.groupBy("subject").agg(F.count(F.lit(1)).alias("n_gates"), F.bool_and(F.coalesce(F.col("status") == "PASS", F.lit(False))).alias("passes"))


def worst_signal(signals: DataFrame) -> DataFrame:
    """(subject): the worst of ok, warning and fail."""
    rank = F.array_position(F.array(*map(F.lit, ("ok", "warning", "fail"))), F.col("signal"))
    return signals.groupBy("subject").agg(F.max_by("signal", rank).alias("signal"))


def type_gate(fields: DataFrame, least: float = 0.7) -> DataFrame:
    """Fields of documents whose type is told with less confidence than ``least`` go to review, with the reason."""
    unsure = F.coalesce(F.col("type_confidence"), F.lit(0.0)) < least
    return fields.withColumn("review", F.coalesce("review", F.lit(False)) | unsure).withColumn("reason", F.when(unsure, "document_type_uncertain"))


def consumer_verdicts(core: DataFrame, consumers: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Core facts (doc, key, value, review) with what consumers (consumer, doc, key, value, review, applicable) show of them, tested in order. aliases: consumers' names of keys and the core's."""
    for name, own in (aliases or {}).items():
        consumers = consumers.withColumn("key", F.when(F.col("key") == name, own).otherwise(F.col("key")))
    rows = consumers.withColumnRenamed("value", "shown").withColumnRenamed("review", "shown_review").join(core, ["doc", "key"], "left")
    none = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    verdict = (
        F.when(~F.col("applicable"), "NOT_APPLICABLE").when(none(F.col("value")) & ~none(F.col("shown")), "FABRICATED").when(none(F.col("shown")) & ~none(F.col("value")), "EMPTY")
        .when(none(F.col("shown")), "SAME").when(F.trim("shown") != F.trim("value"), "DIFFERENT").when(F.col("review") & ~F.col("shown_review"), "REVIEW_LOST").otherwise("SAME")
    )
    return rows.withColumn("verdict", verdict).withColumn("hard_fail", F.col("verdict").isin("FABRICATED", "DIFFERENT", "REVIEW_LOST"))
