"""Decisions on a document's fields: authority, conflicts, review and its reasons.

candidates (doc, key, value, source, confidence, ordinal, mrz_valid, fuzzy, review_required, review_reasons).
Every decision is one grouped aggregation by (doc, key): minima and maxima of structs, so a group of any size
needs no list of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwright.functions.names import russian_latin, ukrainian_latin
from fieldwright.functions.text import composed, error_rate, materially_different, name_script, plausible_name
from fieldwright.operators.resolve import LOW_CONFIDENCE, authority
from fieldwright.operators.shaping import blank, trimmed, united_reasons

#: How much depends on a field; fields that are not listed are low.
CRITICAL = (
    "family_name", "given_name", "patronymic", "date_of_birth", "dob", "passport_number", "a_number", "uscis_number", "child_family_name", "child_given_name", "child_patronymic", "child_dob", "child_date_of_birth",
)
HIGH = ("issuing_authority", "place_of_birth", "date_of_issue", "date_of_expiry", "document_series")
MEDIUM = ("sex",)
#: Fields that a passport's machine lines decide if their check digits hold.
MACHINE_FIELDS = ("passport_number", "date_of_birth", "dob", "date_of_expiry", "passport_expiration_date", "sex", "family_name", "given_name", "nationality", "country_of_nationality")
#: Confidence of a machine reading whose check digits hold, if it tells none, and of one whose digits do not.
MACHINE_SURE, MACHINE_BROKEN = 0.99, 0.3


def criticality(key: Column) -> Column:
    return F.when(key.isin(*CRITICAL), "critical").when(key.isin(*HIGH), "high").when(key.isin(*MEDIUM), "medium").otherwise("low")


def same_reading(value: Column) -> Column:
    """What is left, in NFC, when white space and case do not count."""
    return F.lower(F.regexp_replace(composed(value), r"(?U)\s+", ""))


#: What a key of a name has in it, in small letters.
NAME_KEYS = "(?i)name|surname|patronymic|given|spouse|father|mother|child|deceased"


def wrong_transliteration(key: Column, got: Column, raw: Column, controlling: Column) -> Column:
    """Whether a Latin name is not what its controlling spelling, or else its Cyrillic source by the rules of its script, says. Only of names; an empty value is none, and without a source nothing can be told."""
    russian = name_script(raw) == "ru"
    expected = F.when(russian, russian_latin(raw)).otherwise(ukrainian_latin(raw))
    differs = F.when(~blank(controlling), same_reading(got) != same_reading(controlling)).when(~blank(raw), same_reading(got) != same_reading(expected)).otherwise(False)
    return F.coalesce(~blank(got) & key.cast("string").rlike(NAME_KEYS) & differs, F.lit(False))


def none() -> Column:
    return F.array().cast("array<string>")


def reasons_of(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def arbitrate_fields(candidates: DataFrame) -> DataFrame:
    """One row (doc, key, value, source, criticality, confidence, review, reasons, n_candidates) for each field with a usable candidate.

    A machine reading decides a machine field: alone if its check digits hold, for review at confidence 0.3 if not. Else
    the candidate of the highest authority wins, then confidence, then input order; critical fields then need review,
    conflicts and low confidence of critical and high ones too, fuzzy readings, and what the reader itself asked for.
    """
    usable = candidates.where(~blank(F.col("value")))
    confidence = F.coalesce("confidence", F.lit(0.0))
    rank = F.struct(authority(F.col("source")), confidence, -F.col("ordinal"))
    grouped = usable.groupBy("doc", "key").agg(
        F.max_by(F.struct("value", "source", confidence.alias("confidence"), "fuzzy", "review_required", "review_reasons"), rank).alias("w"),
        F.min(F.when(F.col("source") == "mrz", F.struct("ordinal", "value", "confidence", F.coalesce("mrz_valid", F.lit(False)).alias("valid")))).alias("m"),
        F.count_distinct(same_reading(F.col("value"))).alias("n_distinct"),
        F.count(F.lit(1)).alias("n_candidates"),
    )
    grouped = grouped.withColumn("criticality", criticality(F.col("key")))
    weighty, machine = F.col("criticality").isin("critical", "high"), F.col("key").isin(*MACHINE_FIELDS) & F.col("m").isNotNull()
    asked = F.coalesce("w.review_required", F.lit(False))
    said = F.size(F.coalesce("w.review_reasons", none())) > 0
    own = reasons_of(
        (F.col("criticality") == "critical", "critical_no_mrz_anchor"), (weighty & (F.col("n_distinct") > 1), "provider_conflict"), (F.coalesce("w.fuzzy", F.lit(False)), "fuzzy_match"),
        (weighty & (F.col("w.confidence") < LOW_CONFIDENCE), "low_confidence"), (asked & ~said, "reader_review_required"),
    )
    inherited = F.when(asked & said, united_reasons(own, F.col("w.review_reasons"))).otherwise(own)
    reasons = F.when(machine, F.when(F.col("m.valid"), none()).otherwise(F.array(F.lit("mrz_check_failed")))).otherwise(inherited)
    sure = F.when(F.col("m.valid"), F.coalesce("m.confidence", F.lit(MACHINE_SURE))).otherwise(MACHINE_BROKEN)
    chosen = lambda name, w: F.when(machine, name).otherwise(w)
    return grouped.select(
        "doc", "key", chosen(F.col("m.value"), F.col("w.value")).alias("value"), chosen(F.lit("mrz"), F.col("w.source")).alias("source"), "criticality",
        chosen(sure, F.col("w.confidence")).alias("confidence"), (F.size(reasons) > 0).alias("review"), reasons.alias("reasons"), "n_candidates",
    )


def arbitrate_documents(candidates: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Arbitrated fields with what knowledge says of their values: a value it accepts is taken, any other proposal is a suggestion and asks for review.

    knowledge (key, value, action, final, rule): action is accept, preserve, suggest, review or block. The value that was read stays unless accepted or preserved.
    """
    rows = arbitrate_fields(candidates).join(knowledge, ["key", "value"], "left")
    taken, known = F.col("action").isin("accept", "preserve"), F.col("action").isNotNull()
    against = known & ~taken
    note = F.array(F.concat(F.lit("knowledge:"), F.col("action"), F.lit(":"), F.col("rule")))
    return rows.select(
        "doc", "key", "value", F.when(taken, F.col("final")).otherwise(F.col("value")).alias("normalized"), F.when(against, F.col("final")).alias("suggested"), "source", "criticality",
        "confidence", (F.col("review") | against).alias("review"), F.when(against, united_reasons(F.col("reasons"), note)).otherwise(F.col("reasons")).alias("reasons"), "rule",
    )


def review_decision(fields: DataFrame) -> DataFrame:
    """(doc, key, review, reasons) of fields (doc, key, raw, normalized, confidence, n_distinct): what asks for a human before anything is final."""
    level = criticality(F.col("key"))
    weighty = level.isin("critical", "high")
    reasons = reasons_of(
        (level == "critical", "critical_field_requires_review"), (weighty & (F.col("confidence") < LOW_CONFIDENCE), "low_final_confidence"),
        (materially_different(F.col("raw"), F.col("normalized")), "material_normalization_change"), (weighty & (F.col("n_distinct") > 1), "provider_disagreement"),
    )
    return fields.select("doc", "key", (F.size(reasons) > 0).alias("review"), reasons.alias("reasons"))


#: Classes of fields for resolution by priority.
IDENTITY_FIELDS = ("family_name", "given_name", "dob", "sex", "passport_number")
WEAK_FIELDS = ("middle_name", "city_of_birth", "province_of_birth")
#: Priorities of an identity field's sources, document and way of reading; lower goes first.
IDENTITY_PRIORITY = {
    "passport_ocr_mrz": 1, "i94_ocr_keyword": 2, "ead_ocr_keyword": 3, "dl_ocr_keyword": 4, "booklet_dual_ocr_crossref": 5, "passport_ai_brain": 6, "booklet_ai_brain": 7, "ead_ai_brain": 8, "i94_ai_brain": 9,
    "dl_ai_brain": 10, "manual_manual": 11, "manual_user_corrected": 0,
}
#: The same for weak fields.
WEAK_PRIORITY = {"booklet_dual_ocr_crossref": 1, "booklet_ocr_keyword": 2, "booklet_ai_brain": 3, "passport_ai_brain": 4, "manual_manual": 5, "manual_user_corrected": 0}
LAST = 99


def _listed(key: Column, table: dict[str, int]) -> Column:
    found = F.lit(LAST)
    for name, n in table.items():
        found = F.when(key == name, n).otherwise(found)
    return found


def resolve_fields(slotted: DataFrame) -> DataFrame:
    """One row per (doc, field) of slotted candidates (doc, field, value, source_doc, source_type, review_required, ordinal).

    The lowest priority wins, then input order; an identity field's winner that is no plausible name gives way to the first
    plausible candidate. Losers more than one edit away are conflicts and rejected. Machine-read identity is locked:
    conflicts do not send it to review. Weak fields always go there.
    """
    identity, weak = F.col("field").isin(*IDENTITY_FIELDS), F.col("field").isin(*WEAK_FIELDS)
    at = F.concat_ws("_", "source_doc", "source_type")
    priority = F.when(F.col("source_type") == "user_corrected", 0).when(identity, _listed(at, IDENTITY_PRIORITY)).when(weak, _listed(at, WEAK_PRIORITY)).otherwise(LAST)
    rows = slotted.where(~blank(F.col("value"))).withColumn("priority", priority)
    plausible = F.coalesce(plausible_name(F.col("value")), F.lit(False)) | ~identity
    group = Window.partitionBy("doc", "field")
    order = F.struct(F.when(F.col("plausible"), 0).otherwise(1), "priority", "ordinal")
    winner = F.min_by(F.struct("value", "source_doc", "source_type", "review_required", "ordinal"), order).over(group)
    rows = rows.withColumn("plausible", plausible).withColumn("w", winner)
    edits = F.levenshtein(F.lower(trimmed(F.col("value"))), F.lower(trimmed(F.col("w.value"))))
    best = rows.groupBy("doc", "field").agg(
        F.min("w").alias("w"), F.count_if(edits > 1).alias("n_rejected"), F.count(F.lit(1)).alias("n_usable"), F.min_by("plausible", F.struct("priority", "ordinal")).alias("first_plausible"), F.bool_or("plausible").alias("any_plausible"),
    )
    locked = identity & (F.col("w.source_type") == "ocr_mrz")
    conflict = F.col("n_rejected") > 0
    review = ~identity & weak | (conflict & ~locked) | F.coalesce("w.review_required", F.lit(False))
    notes = reasons_of((~F.col("first_plausible") & F.col("any_plausible"), "plausibility_rejected"), (locked, "mrz_locked"), (conflict, "conflict_detected"), (weak, "weak_field_review_required"))
    return best.select("doc", "field", "w.value", "w.source_doc", "w.source_type", locked.alias("locked"), conflict.alias("conflict"), review.alias("review"), "n_rejected", notes.alias("notes"))


#: Least confidence for acceptance without a human, by criticality.
ACCEPT = {"critical": 0.97, "high": 0.9}
ACCEPT_LOW = 0.8
UNSTABLE = ("mismatch", "incomplete", "insufficient_identity_fields")


def decide(fields: DataFrame) -> DataFrame:
    """(doc, key, value, confidence, decision, reasons) of fields (doc, key, criticality, read_value, read_confidence, anchor_value, anchor_valid, dictionary_review, invalid_rule, consistency).

    A valid anchor's value is accepted. Without value: reject. Otherwise review signals force review, and so does low
    confidence for critical fields; for others it is accepted with a mark.
    """
    anchored = F.coalesce("anchor_valid", F.lit(False)) & ~blank(F.col("anchor_value"))
    value = F.when(anchored, F.col("anchor_value")).otherwise(F.nullif("read_value", F.lit("")))
    confidence = F.when(value.isNull(), 0.0).when(anchored, 0.99).otherwise(F.least(F.greatest(F.coalesce("read_confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    unstable = F.coalesce(F.col("consistency").isin(*UNSTABLE), F.lit(False))
    least = F.when(F.col("criticality") == "critical", ACCEPT["critical"]).when(F.col("criticality") == "high", ACCEPT["high"]).otherwise(ACCEPT_LOW)
    low, signal = confidence < least, F.col("dictionary_review").isNotNull() | F.col("invalid_rule").isNotNull() | unstable
    critical = F.col("criticality") == "critical"
    decision = (
        F.when(value.isNull(), "reject").when(anchored, "accept").when(signal | (critical & low), "force_review").when(low, "accept_low_confidence").otherwise("accept")
    )
    found = reasons_of(
        (F.col("dictionary_review").isNotNull(), "dictionary_review"), (F.col("invalid_rule").isNotNull(), "validation_invalid"), (unstable & (F.col("consistency") == "mismatch"), "self_consistency_identity_mismatch"),
        (unstable & (F.col("consistency") != "mismatch"), "self_consistency_unstable"), (~anchored & critical & low & ~signal, "critical_low_confidence"), (~anchored & ~critical & low & ~signal, "below_auto_final_threshold"),
    )
    return fields.select("doc", "key", value.alias("value"), confidence.alias("confidence"), decision.alias("decision"), F.when(value.isNull(), F.array(F.lit("no_source"))).otherwise(found).alias("reasons"))


#: Words of labels that are no values, and what reading noise looks like.
LABEL_WORDS = (
    "surname", "given", "name", "last", "first", "middle", "patronymic", "date", "birth", "nationality", "country", "passport", "number", "expiry", "expiration", "sex", "gender", "place", "city", "province", "oblast",
    "region", "address", "state", "zip", "phone", "email", "прізвище", "ім'я", "по батькові", "дата", "народження", "стать", "громадянство", "місце", "проживання", "серія", "номер",
)
NOISE = (r"\d{4,}.*[а-яА-Яa-zA-Z].*\d{4,}", r"[<>|\\/]{2,}", r"^[A-Z]{6,}[0-9]")


def invented_value(value: Column, is_name: Column) -> Column:
    """Why a value must not be taken: label_as_value, garbage_pattern, for names mixed_script or implausible_name; null if it may be."""
    v = trimmed(value)
    mixed = v.rlike("[A-Za-z]") & v.rlike(r"[\x{0400}-\x{04FF}]")
    noise = F.lit(False)
    for p in NOISE:
        noise = noise | v.rlike(p)
    return F.when(v == "", F.lit(None)).when(F.lower(v).isin(*LABEL_WORDS), "label_as_value").when(noise, "garbage_pattern").when(is_name & mixed, "mixed_script").when(is_name & ~F.coalesce(plausible_name(v), F.lit(False)), "implausible_name")


def cross_document_risk(high: Column, low: Column) -> Column:
    """none, low (two edits at most) or high, of a name in a strong and in a weak document."""
    a, b = F.lower(trimmed(high)), F.lower(trimmed(low))
    return F.when((a == "") | (b == "") | (a == b), "none").when(F.levenshtein(a, b) <= 2, "low").otherwise("high")


#: Kinds of documents whose handwriting invites invention, signs of identity fields, and the reasons given.
HANDWRITTEN = ("birth_certificate_handwritten", "birth_certificate_soviet_bilingual")
IDENTITY_SIGNS = ("family_name", "given_name", "patronymic", "middle_name", "full_name", "date_of_birth", "dob", "place_of_birth", "place_city", "issuing_authority")
INVENTION_REASONS = ("handwritten_document", "model_instability_risk", "no_strong_identity_anchor")


def against_invention(fields: DataFrame) -> DataFrame:
    """Fields (document_class, field, review, reasons) with review forced on identity fields of handwritten documents; values stay."""
    sign = F.exists(F.array(*map(F.lit, IDENTITY_SIGNS)), lambda s: F.contains(F.lower("field"), s))
    forced = F.col("document_class").isin(*HANDWRITTEN) & sign
    reasons = F.when(forced, united_reasons(F.col("reasons"), F.array(*map(F.lit, INVENTION_REASONS)))).otherwise(F.coalesce("reasons", none()))
    return fields.withColumn("review", F.coalesce("review", F.lit(False)) | forced).withColumn("reasons", reasons)


def acceptance_scores(truth: DataFrame, produced: DataFrame) -> DataFrame:
    """(doc_type, doc): eight counts of a document's critical fields, the mean error rate, and coverage.

    truth (doc_type, doc, key, value, critical); produced (doc, key, value, review, final_value, controlling and, if it is there, raw, the Cyrillic source). A value that
    is wrong and not under review counts as fabricated, and so does one where the document has none.
    """
    if "raw" not in produced.columns:
        produced = produced.withColumn("raw", F.lit(None).cast("string"))
    rows = truth.join(produced.withColumnRenamed("value", "got"), ["doc", "key"], "left")
    got, real = ~blank(F.col("got")), ~blank(F.col("value"))
    same = lambda a, b: same_reading(F.coalesce(a, F.lit(""))) == same_reading(F.coalesce(b, F.lit("")))
    exact, flagged = got & same(F.col("got"), F.col("value")), F.coalesce("review", F.lit(False))
    verdict = F.when(~real, F.when(got, "FABRICATED").otherwise("NA")).when(~got, "EMPTY").when(exact, "EXACT").when(flagged, "REVIEW").otherwise("WRONG")
    against_control = got & ~blank(F.col("controlling")) & ~same(F.col("got"), F.col("controlling"))
    released_wrong = ~blank(F.col("final_value")) & ~same(F.col("final_value"), F.col("value"))
    rate = F.when(real & got, error_rate(F.col("got"), F.col("value")))
    of = lambda c: F.count_if(F.col("critical") & c)
    return rows.groupBy("doc_type", "doc").agg(
        of(F.lit(True)).alias("critical_total"), of(verdict == "EXACT").alias("exact"), of(verdict == "EMPTY").alias("empty"), of(verdict.isin("WRONG", "FABRICATED")).alias("fabricated"), of(flagged).alias("reviewed"),
        of(against_control).alias("mrz_conflicts"), of(released_wrong).alias("false_final"), of(wrong_transliteration(F.col("key"), F.col("got"), F.col("raw"), F.col("controlling"))).alias("wrong_transliteration"), F.coalesce(F.avg(F.when(F.col("critical"), rate)), F.lit(0.0)).alias("error_rate"),
        (F.count_if(got) / F.count(F.lit(1))).alias("coverage"),
    )


def acceptance_by_type(scores: DataFrame, least: float = 0.95) -> DataFrame:
    """(doc_type): documents, sums of their counts, and whether the type may go to production. Counts are carried, so no rate is turned back into one."""
    rows = scores.groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in ("critical_total", "exact", "empty", "fabricated", "reviewed", "mrz_conflicts", "false_final", "wrong_transliteration")])
    share = F.when(F.col("critical_total") == 0, 0.0).otherwise(F.col("exact") / F.col("critical_total"))
    reasons = reasons_of(
        (F.col("fabricated") > 0, "fabricated"), (F.col("false_final") > 0, "false_final"), (share < least, "exact_share"), ((F.col("critical_total") > 0) & (F.col("empty") == F.col("critical_total")), "all_empty")
    )
    return rows.withColumn("exact_share", share).withColumn("reasons", reasons).withColumn("production_ready", F.size("reasons") == 0)


def benchmark_totals(truth: DataFrame, produced: DataFrame) -> DataFrame:
    """(doc): total, coverage, correct, critical counts and the share of produced fields under review."""
    rows = truth.join(produced.withColumnRenamed("value", "got"), ["doc", "key"], "left")
    got, flagged = ~blank(F.col("got")), F.coalesce("review", F.lit(False))
    right = got & (same_reading(F.col("got")) == same_reading(F.coalesce("value", F.lit(""))))
    of = lambda c: F.count_if(F.col("critical") & c)
    scored = rows.groupBy("doc").agg(
        F.count(F.lit(1)).alias("total"), (F.count_if(got) / F.count(F.lit(1))).alias("coverage"), F.count_if(right).alias("correct"), of(F.lit(True)).alias("critical_total"), of(right).alias("critical_correct"),
        of(~got).alias("critical_missing"), of(got & ~right & ~flagged).alias("critical_wrong"), F.count_if(flagged).alias("flagged"),
    )
    sizes = produced.groupBy("doc").agg(F.count(F.lit(1)).alias("n_produced"))
    return scored.join(sizes, "doc", "left").withColumn("review_rate", F.col("flagged") / F.greatest(F.coalesce("n_produced", F.lit(0)), F.lit(1))).drop("flagged", "n_produced")


def identity_fold(documents: DataFrame) -> DataFrame:
    """(packet): identity over its documents (packet, ordinal, priority, surname, born, mrz_mismatch) in order.

    A surname is taken from a source of priority no lower than that of the one taken before; a surname that differs from
    the one held raises a conflict for good, whatever its priority. The first date of birth stays, another one is a
    conflict. A mismatch of the machine lines is kept. Closed form: what is held at a row is the last surname among those
    whose priority is the highest so far.
    """
    order = Window.partitionBy("packet").orderBy("ordinal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.col("surname").isNotNull(), F.col("priority"))
    rows = documents.withColumn("best", F.max(named).over(order))
    taken = F.col("surname").isNotNull() & (F.col("priority") == F.col("best"))
    rows = rows.withColumn("held", F.last(F.when(taken, F.col("surname")), ignorenulls=True).over(before))
    rows = rows.withColumn("held_date", F.first("born", ignorenulls=True).over(before)).withColumn("taken", taken)
    conflict = F.col("surname").isNotNull() & F.col("held").isNotNull() & (same_reading(F.col("surname")) != same_reading(F.col("held")))
    return rows.groupBy("packet").agg(
        F.max_by(F.when(F.col("taken"), F.col("surname")), F.when(F.col("taken"), F.col("ordinal"))).alias("surname"), F.min_by("born", F.when(F.col("born").isNotNull(), F.col("ordinal"))).alias("born"),
        F.bool_or(F.coalesce(conflict, F.lit(False))).alias("name_conflict"), F.bool_or(F.coalesce(F.col("born") != F.col("held_date"), F.lit(False))).alias("date_conflict"),
        F.bool_or(F.coalesce("mrz_mismatch", F.lit(False))).alias("mrz_mismatch"), F.count(F.lit(1)).alias("n_documents"),
    )


def agreement(reads: DataFrame) -> DataFrame:
    """(doc, status) of reads (doc, run, hash, n_fields): insufficient_identity_fields if the first run has under two fields, incomplete if a later run failed, mismatch if one differs, else agree."""
    first = F.min_by(F.struct("hash", "n_fields"), "run")
    rows = reads.withColumn("f", first.over(Window.partitionBy("doc"))).withColumn("first_run", F.min("run").over(Window.partitionBy("doc")))
    later = F.col("run") > F.col("first_run")
    got = rows.groupBy("doc").agg(F.min("f").alias("f"), F.bool_or(later & F.col("hash").isNull()).alias("failed"), F.bool_or(F.coalesce(later & (F.col("hash") != F.col("f.hash")), F.lit(False))).alias("differs"))
    return got.select("doc", F.when(F.coalesce("f.n_fields", F.lit(0)) < 2, "insufficient_identity_fields").when(F.col("failed"), "incomplete").when(F.col("differs"), "mismatch").otherwise("agree").alias("status"))


#: Least confidence of classifier and reader, and how often an image may be taken again.
SURE_TYPE, SURE_READING, RETRIES = 0.85, 0.65, 3
#: What a document's content may show, and the reason that it gives, in order.
CONTENT_SIGNS = (
    ("long_legal_text", "long_legal_text"), ("complex_table", "complex_table_document"), ("handwriting", "unclear_handwriting"), ("unclear_seal", "unclear_seal_or_stamp"), ("legal_or_court", "legal_or_court_document"),
    ("military", "military_document"), ("diploma", "diploma_or_transcript"), ("glossary_unresolved", "glossary_unresolved"), ("identity_conflict", "identity_conflict"),
)
#: Which reason the user is told, the first that applies.
TOLD_FIRST = (
    "image_quality_failed", "identity_conflict", "missing_critical_fields", "unsupported_document_type", "unknown_document_type", "long_legal_text", "complex_table_document", "legal_or_court_document", "military_document",
    "diploma_or_transcript", "unclear_handwriting", "unclear_seal_or_stamp", "glossary_unresolved", "low_classification_confidence", "low_ocr_confidence", "missing_source_evidence", "system_error", "user_requested_human_help",
)


def manual_review(documents: DataFrame) -> DataFrame:
    """(doc, required, reasons, priority, message) of documents (doc, document_type, module_status, classifier_confidence, image_failed, image_retries, n_missing, n_without_evidence, ocr_confidence, n_hard_failures, signs array<string>, n_errors, asked_help, urgent, paid, ocr_failures)."""
    under = lambda c, least: F.coalesce(F.col(c) < least, F.lit(False))
    missing = F.col("n_missing") > 0
    reasons = F.array_distinct(reasons_of(
        (blank(F.col("document_type")), "unknown_document_type"), (F.coalesce(F.col("module_status").isin("draft", "disabled", "manual_only"), F.lit(False)), "unsupported_document_type"),
        (under("classifier_confidence", SURE_TYPE), "low_classification_confidence"), (F.col("image_failed") & (F.coalesce("image_retries", F.lit(0)) >= RETRIES), "image_quality_failed"),
        (missing, "missing_critical_fields"), (F.col("n_without_evidence") > 0, "missing_source_evidence"), (under("ocr_confidence", SURE_READING), "low_ocr_confidence"), (F.col("n_hard_failures") > 0, "missing_critical_fields"),
        *[(F.array_contains("signs", sign), reason) for sign, reason in CONTENT_SIGNS], (F.col("n_errors") > 0, "system_error"), (F.col("asked_help"), "user_requested_human_help"),
    ))
    rows = documents.withColumn("reasons", reasons)
    has = lambda r: F.array_contains("reasons", r)
    any_reason = F.size("reasons") > 0
    high = has("identity_conflict") | F.col("urgent") | F.col("paid") | (F.coalesce("ocr_failures", F.lit(0)) >= 3)
    priority = F.when(any_reason & high, "high").when((F.size("reasons") == 1) & has("user_requested_human_help"), "low").otherwise("normal")
    told = F.coalesce(*[F.when(has(r), F.lit(f"mr.{r}")) for r in TOLD_FIRST], F.when(any_reason, "mr.generic_manual_review").otherwise("mr.not_required"))
    return rows.select("doc", any_reason.alias("required"), "reasons", priority.alias("priority"), told.alias("message"))


def mail_ready(answers: DataFrame, required: tuple[str, ...], recommended: tuple[str, ...]) -> DataFrame:
    """(doc, mail_ready, blockers, warnings) of answers (doc, values map, part7_reviewed, conflicts array, read_confidence map, untranslated)."""
    of = lambda name: F.try_element_at("values", F.lit(name))
    phone, mail = of("daytime_phone"), of("email")
    poor = lambda low, high: F.transform(F.map_keys(F.map_filter("read_confidence", lambda _, v: (v >= low) & (v < high))), lambda k: F.concat(F.lit("ocr_confidence_low:" if low else "ocr_confidence_too_low:"), k))
    blockers = F.concat(
        reasons_of(*[(blank(of(r)), f"required_field_empty:{r}") for r in required], (~F.coalesce("part7_reviewed", F.lit(False)), "part7_not_reviewed")),
        F.transform("conflicts", lambda c: F.concat(F.lit("controlling_spelling_conflict:"), c)), F.array_sort(poor(0.0, 0.5)),
        reasons_of((~blank(phone) & (F.length(F.regexp_replace(phone, "[^0-9]", "")) != 10), "invalid_phone_format"), (~blank(mail) & ~mail.contains("@"), "invalid_email")),
    )
    warnings = F.concat(reasons_of(*[(blank(of(r)), f"recommended_field_empty:{r}") for r in recommended]), F.array_sort(poor(0.5, 0.7)), reasons_of((F.col("untranslated"), "translation_missing")))
    return answers.select("doc", (F.size(blockers) == 0).alias("mail_ready"), blockers.alias("blockers"), warnings.alias("warnings"))


#: Kinds of documents by form id, kinds that always need review, certificates, and bounds of image sizes in bytes.
CLASSES = {
    "ua_internal_passport_booklet": "internal_passport_booklet", "ua_international_passport": "internal_passport_booklet", "ua_birth_certificate": "birth_certificate_handwritten", "ua_marriage_certificate": "marriage_apostille",
    "ua_divorce_certificate": "marriage_apostille", "ua_military_id": "military_id",
}
CERTIFICATES = ("birth_certificate_handwritten", "birth_certificate_soviet_bilingual", "marriage_apostille")
LEAST_BYTES, LEAST_APOSTILLE, MOST_BYTES = 100_000, 300_000, 2_000_000


def document_class(form: Column) -> Column:
    found = F.lit("unknown_document")
    for name, kind in CLASSES.items():
        found = F.when(form == name, kind).otherwise(found)
    return found


def image_action(kind: Column, size: Column) -> Column:
    """resize if too large, which is tested first, needs_better_scan if too small for the kind, else proceed."""
    least = F.when(kind == "marriage_apostille", LEAST_APOSTILLE).otherwise(LEAST_BYTES)
    return F.when(size > MOST_BYTES, "resize").when(size < least, "needs_better_scan").otherwise("proceed")


def ungrounded_roles(kind: Column, keys: Column) -> Column:
    """Fields of a certificate that must be reviewed as nobody tells whose they are: a family name without a role, and none with one."""
    grounded = F.array_contains(keys, "child_family_name") | F.array_contains(keys, "spouse1_family_name")
    return F.when(kind.isin(*CERTIFICATES) & ~grounded & F.array_contains(keys, "family_name"), F.array(*map(F.lit, ("family_name", "given_name", "patronymic")))).otherwise(none())


def image_quality(blur: Column, brightness: Column, width: Column, height: Column) -> Column:
    """ACCEPT, DEGRADED_REVIEW or RESHOOT_REQUIRED by the worst of what was measured."""
    side = F.least(width, height)
    sign = lambda bad, poor: F.when(bad, 2).when(poor, 1).otherwise(0)
    worst = F.greatest(sign(blur < 5, blur < 12), sign((brightness < 40) | (brightness > 245), (brightness < 70) | (brightness > 235)), F.when(width.isNull() | height.isNull(), 0).otherwise(sign(side < 600, side < 900)))
    return F.element_at(F.array(*map(F.lit, ("ACCEPT", "DEGRADED_REVIEW", "RESHOOT_REQUIRED"))), worst + 1)


def released_value(fields: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc, key, value, matched_key, review): a primary key's value to release, else that of its first alias with one.

    fields (doc, key, raw, normalized, final, finalized, review): what was finalized is taken as it is, and null there is a
    rejection; what was not falls back to the normalized and then the raw value.
    """
    rank = [(p, k, i) for p, names in aliases.items() for i, k in enumerate((p, *names))]
    table = F.explode(F.filter(F.array(*[F.struct(F.lit(p).alias("primary"), F.lit(k).alias("k"), F.lit(i).alias("rank")) for p, k, i in rank]), lambda r: r["k"] == F.col("key"))).alias("r")
    value = F.nullif(F.trim(F.when(F.col("finalized"), F.col("final")).otherwise(F.coalesce("normalized", "raw"))), F.lit(""))
    rows = fields.select("doc", "key", value.alias("value"), "review", table)
    some = F.struct(F.col("value").isNull(), F.col("r.rank"))
    best = rows.groupBy("doc", F.col("r.primary").alias("primary")).agg(F.min_by(F.struct("value", "key", "review"), some).alias("b"), F.max(F.when(F.col("r.rank") == 0, F.col("review"))).alias("own"))
    return best.select("doc", F.col("primary").alias("key"), "b.value", F.when(F.col("b.value").isNotNull(), F.col("b.key")).alias("matched_key"), F.when(F.col("b.value").isNotNull(), F.col("b.review")).otherwise(F.coalesce("own", F.lit(False))).alias("review"))


def sequence_conflicts(dates: DataFrame) -> DataFrame:
    """(doc, role, value, reasons) of dates (doc, role, value date): one date in two roles, and an issue before the birth."""
    by_doc = Window.partitionBy("doc")
    only = lambda role: F.min(F.when(F.col("role") == role, F.col("value"))).over(by_doc)
    rows = dates.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("doc", "value")) > 1).withColumn("early", F.coalesce(only("date_of_issue") < only("date_of_birth"), F.lit(False)) & F.col("role").isin("date_of_issue", "date_of_birth"))
    return rows.select("doc", "role", "value", reasons_of((F.col("shared"), "date_role_conflict"), (F.col("early"), "date_sequence_conflict")).alias("reasons"))
