"""What knowledge says of a value, and the merge of all documents of a packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.functions import dates, names, places, text
from fieldwright.operators import canonical
from fieldwright.operators.shaping import blank, trimmed

#: Letters that Ukrainian names do not have.
RUSSIAN_ONLY = "[ыэёъЫЭЁЪ]"
#: Signs of a sex in capitals, each between spaces or as part of a word.
SEX_SIGNS = " [MFXЧЖ] |МУЖ|МАЛ|MALE|ЧОЛ|ЖЕН|ЖІН|UNSPEC"
#: Least confidence of a document's type.
SURE_TYPE = 0.85


def _decision(action: str, final: Column, candidate: Column, rule: str) -> Column:
    none = F.lit(None).cast("string")
    taken = action in ("accept", "preserve")
    return F.struct(F.lit(action).alias("action"), (final if taken else none).alias("final"), (none if taken else candidate).alias("candidate"), F.lit(rule).alias("rule"))


def aspects(value: Column, sex: Column, given: Column, historical: Column) -> Column:
    """struct of what may matter of a value: v, the text; latin; told, the patronymic; spot, the place; office; said, the sex; form, the date; capital, the Latin name in its own casing."""
    v = trimmed(value)
    latin = names.ukrainian_latin(v)
    told = names.patronymic(v, given, sex)
    return F.struct(
        v.alias("v"), latin.alias("latin"), told.alias("told"), names.ukrainian_latin(told["value"]).alias("told_latin"), places.place(v, historical).alias("spot"), places.authority(v).alias("office"), places.sex(v).alias("said"),
        dates.form_date(v).alias("form"), text.latin_name(v).alias("capital"), text.latin_name(latin).alias("capital_latin"), names.valid_patronymic(v, F.lit(None).cast("string")).alias("whole"),
    )


def knowledge_of(key: Column, sex: Column) -> Column:
    """struct(action, final, candidate, rule) of a value by what its key is: accept and preserve give a final value; suggest, review and block at most a candidate. The value's aspects are columns."""
    v, k, latin, told = F.col("v"), F.lower(key), F.col("latin"), F.col("told")
    cyrillic = v.rlike(r"[\x{0400}-\x{04FF}]")
    has = lambda *parts: k.rlike("|".join(parts))
    p = (
        F.when(told["source"] == "read_valid", _decision("accept", F.col("told_latin"), latin, "patronymic.read_valid"))
        .when(told["value"] != "", _decision("suggest", latin, F.col("told_latin"), "patronymic.generated")).otherwise(_decision("review", latin, F.lit(None).cast("string"), "patronymic.unresolved"))
    )
    unknown_sex = F.when(F.col("whole"), _decision("accept", latin, latin, "patronymic.read_valid")).otherwise(_decision("review", latin, F.when(cyrillic, latin).otherwise(v), "patronymic.fragment"))
    name = F.when(~cyrillic, _decision("preserve", F.col("capital"), v, "name.latin_preserve")).when(v.rlike(RUSSIAN_ONLY), _decision("review", latin, latin, "name.russian_spelling_on_ua")).otherwise(_decision("accept", latin, latin, "name.kmu55"))
    full = F.when(~cyrillic, _decision("preserve", F.col("capital"), v, "fullname.latin_preserve")).when(v.rlike(RUSSIAN_ONLY), _decision("review", latin, F.col("capital_latin"), "fullname.russian_spelling_on_ua")).otherwise(_decision("accept", F.col("capital_latin"), latin, "fullname.transliterate"))
    spot, office, said = F.col("spot"), F.col("office"), F.col("said")
    place = F.when(spot["review"], _decision("review", latin, spot["value"], "place.rename")).otherwise(_decision("accept", spot["value"], latin, "place.normalize"))
    authority = F.when(office["review"], _decision("review", v, F.when(cyrillic, latin).otherwise(v), "authority.unknown")).otherwise(_decision("accept", office["value"], v, "authority.dictionary"))
    sex_of = F.when(said["review"], _decision("review", v, said["value"], "sex.uncertain")).otherwise(_decision("accept", said["value"], v, "sex.normalize"))
    iso, form = r"^(\d{4})-(\d{2})-(\d{2})$", F.col("form")
    date = (
        F.when(v.rlike(r"^\d{2}/\d{2}/\d{4}$"), _decision("accept", v, v, "date.already")).when(v.rlike(iso), _decision("accept", F.regexp_replace(v, iso, "$2/$3/$1"), v, "date.iso"))
        .when(form.isNotNull(), _decision("accept", form, v, "date.form")).otherwise(_decision("review", v, F.lit(None).cast("string"), "date.unparsed"))
    )
    return (
        F.when(v == "", _decision("block", v, F.lit(None).cast("string"), "empty")).when(has("patronymic"), F.when(sex.isin("M", "F"), p).otherwise(unknown_sex)).when(has("surname", "family_name", "given_name"), name).when(has("full_name"), full)
        .when(has("place", "city", "province", "oblast", "settlement", "region"), place).when(has("authority", "issu"), authority).when((k == "sex") | has("gender"), sex_of).when(has("dob", "date"), date)
        .when(cyrillic, _decision("accept", latin, v, "default.kmu55")).otherwise(_decision("preserve", v, v, "default.passthrough"))
    )


def with_siblings(fields: DataFrame) -> DataFrame:
    """Fields (doc, key, value) with the sex and the given name in Cyrillic that their document tells; of several the least counts."""
    v, k = F.lower(trimmed(F.col("value"))), F.col("key")
    letter = F.when(v.rlike("^(m|male|ч|чол)"), "M").when(v.rlike("^(f|female|ж|жін|жои)"), "F")
    own = fields.groupBy("doc").agg(F.min(F.when((k == "sex") | k.endswith("_sex"), letter)).alias("sex"), F.min(F.when(k.isin("given_name", "child_given_name") & F.col("value").rlike(r"[\x{0400}-\x{04FF}]"), F.col("value"))).alias("given"))
    return fields.join(own, "doc")


def enriched(fields: DataFrame, historical: bool = False) -> DataFrame:
    """Fields (doc, key, value) with normalized, suggested, review and rule: what is accepted is taken, anything else leaves the value and asks for review."""
    # as rows of a generator each part is made once; as plain structs the optimizer would repeat it wherever it is used
    rows = with_siblings(fields)
    rows = rows.select("doc", "key", "value", "sex", F.inline(F.array(aspects(F.col("value"), F.col("sex"), F.col("given"), F.lit(historical)))))
    rows = rows.select("doc", "key", "value", F.inline(F.array(knowledge_of(F.col("key"), F.col("sex")))))
    taken = F.col("action").isin("accept", "preserve")
    return rows.select("doc", "key", "value", F.when(taken, F.col("final")).otherwise(F.col("value")).alias("normalized"), F.when(~taken, F.col("candidate")).alias("suggested"), (~taken).alias("review"), "rule")


def classified(documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """documents (doc, raw, confidence) with type and reason: an alias as it stands, with underscores or with spaces, and manual_review_required where type or confidence is wanting.

    aliases (alias, type, active); an inactive type goes to manual review too.
    """
    lowered = F.lower(F.trim(F.coalesce("raw", F.lit(""))))
    spellings = [lowered, F.regexp_replace(lowered, r"[\s-]+", "_"), F.regexp_replace(lowered, "[_-]+", " ")]
    known = aliases.groupBy("alias").agg(F.min(F.struct("type", "active")).alias("t"))
    rows = documents
    for i, s in enumerate(spellings):
        rows = rows.join(known.toDF(f"_a{i}", f"_t{i}"), s == F.col(f"_a{i}"), "left")
    t = F.coalesce("_t0", "_t1", "_t2")
    reason = F.when(lowered == "", "unknown_document_type").when(F.col("confidence") < SURE_TYPE, "low_classification_confidence").when(t.isNull(), "unsupported_document_type").when(~t["active"], "module_not_active")
    return rows.select("doc", F.when(reason.isNull(), t["type"]).otherwise("manual_review_required").alias("type"), reason.alias("reason"))


def merged_packet(slots: DataFrame, contract: DataFrame, manual: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents of a packet made one set of fields: fields, rejected readings, readiness.

    slots (doc, slot, field, value, source_doc, source_type, review_required, ordinal) pass the contract (slot, field), the guard
    against invented values and the normalization of their field; manual (doc, field, value) joins as what a user corrected. Fields are
    resolved by priority; a packet is ready if every required field has a value and no field is implausible.
    """
    said = slots.where(~blank(F.col("value")))
    allowed = said.join(contract, ["slot", "field"], "left_semi")
    outside = said.join(contract, ["slot", "field"], "left_anti").withColumn("reason", F.lit("not_in_contract"))
    is_name = F.col("field").isin("family_name", "given_name")
    guarded = allowed.withColumn("reason", canonical.invented_value(F.col("value"), is_name))
    rejected = outside.unionByName(guarded.where("reason is not null")).select("doc", "slot", "field", "reason")
    kept = guarded.where("reason is null").select("doc", "field", F.when(is_name, text.latin_name(F.col("value"))).otherwise(trimmed(F.col("value"))).alias("value"), "source_doc", "source_type", "review_required", "ordinal")
    typed = manual.where(~blank(F.col("value"))).select("doc", "field", "value", F.lit("manual").alias("source_doc"), F.lit("user_corrected").alias("source_type"), F.lit(False).alias("review_required"), F.lit(0).cast("long").alias("ordinal"))
    fields = canonical.resolve_fields(kept.unionByName(typed))
    implausible = canonical.invented_value(F.col("value"), is_name).isNotNull()
    missing = F.array_except(F.array(*map(F.lit, required)), F.collect_set("field"))
    ready = fields.groupBy("doc").agg(missing.alias("missing"), F.count_if(implausible).alias("n_implausible"), F.count_if("conflict").alias("n_conflicts"))
    return fields, rejected, ready.withColumn("ready", (F.size("missing") == 0) & (F.col("n_implausible") == 0))


def hard_failure(field: Column, value: Column, today: Column) -> Column:
    """Why a read field must not be merged: untransliterated_cyrillic, unparseable_date, dob_out_of_range, expiry_too_far or bad_shape; null if it may."""
    v = F.trim(F.coalesce(value, F.lit("")))
    dated = (field == "dob") | field.endswith("_date")
    day = F.coalesce(F.try_to_date(v, "yyyy-MM-dd"), F.try_to_date(v, "MM/dd/yyyy"))
    shaped = (
        F.when(field == "passport_number", F.length(v).between(5, 15)).when(field == "i94_admission_number", F.regexp_replace(v, "[^0-9]", "").rlike("^[0-9]{9,11}$"))
        .when(field == "a_number", F.regexp_replace(v, "[^0-9]", "").rlike("^[0-9]{7,9}$")).when(field == "ead_category_on_card", F.regexp_replace(F.lower(v), "[^a-z0-9]", "").rlike("^[a-z][0-9]{1,3}$")).when(field == "sex", F.concat(F.lit(" "), F.regexp_replace(F.upper(v), "[^A-ZА-ЯІЇЄҐ]+", " "), F.lit(" ")).rlike(SEX_SIGNS)).otherwise(True)
    )
    free = dated | field.isin("sex", "country_of_nationality", "passport_country_of_issuance")
    return (
        F.when(~free & v.rlike(r"[\x{0400}-\x{04FF}]"), "untransliterated_cyrillic").when(dated & day.isNull(), "unparseable_date")
        .when((field == "dob") & ((day > today) | (F.year(day) < 1900)), "dob_out_of_range").when((field == "passport_expiration_date") & (day > F.add_months(today, 240)), "expiry_too_far").when(~shaped, "bad_shape")
    )


def canonical_operations(fields: DataFrame, mapping: dict[str, tuple[tuple[str, ...], str, str]]) -> DataFrame:
    """fields (doc, key, value) as rows (doc, target, kind, value): what a form takes from a document.

    mapping: target to (keys, the first with a value counts; kind; format: plain, date, a_number). Blank values write nothing.
    """
    pairs = [(t, k, i, kind, form) for t, (keys, kind, form) in mapping.items() for i, k in enumerate(keys)]
    rows = F.explode(F.filter(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(k).alias("k"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), F.lit(form).alias("form")) for t, k, i, kind, form in pairs]), lambda p: p["k"] == F.col("key"))).alias("p")
    told = fields.where(~blank(F.col("value"))).select("doc", F.trim("value").alias("value"), rows)
    best = told.groupBy("doc", F.col("p.target").alias("target")).agg(F.min(F.struct("p.rank", "p.kind", "p.form", "value")).alias("b"))
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    shown = F.when(F.col("b.form") == "date", F.regexp_replace("b.value", iso, "$2/$3/$1")).when(F.col("b.form") == "a_number", F.right(F.regexp_replace("b.value", "[^0-9]", ""), F.lit(9))).otherwise(F.col("b.value"))
    return best.select("doc", "target", F.col("b.kind").alias("kind"), shown.alias("value")).where("value <> ''")
