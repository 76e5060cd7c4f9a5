"""Extracted fields made ready for forms: provinces, cities, countries, names and dates, each taken, passed on or rejected with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.functions import names, places
from fieldwright.functions.places import let

#: Latin spellings of provinces, in this order, and their names.
PROVINCES = (
    (r"vin+yt+s?k\w*", "Vinnytsia Oblast"), (r"volyn\w*", "Volyn Oblast"), (r"dnipropetrov\w*", "Dnipropetrovsk Oblast"), (r"donetsk\w*", "Donetsk Oblast"), (r"zhytomyr\w*", "Zhytomyr Oblast"), (r"zakarpatt\w*", "Zakarpattia Oblast"),
    (r"zaporizh\w*", "Zaporizhzhia Oblast"), (r"ivano[-\s]?frankiv\w*", "Ivano-Frankivsk Oblast"), (r"kyiv\w*", "Kyiv Oblast"), (r"kirovohrad\w*", "Kirovohrad Oblast"), (r"luhansk\w*", "Luhansk Oblast"), (r"lviv\w*", "Lviv Oblast"),
    (r"mykolaiv\w*", "Mykolaiv Oblast"), (r"odesa\w*", "Odesa Oblast"), (r"poltava\w*", "Poltava Oblast"), (r"rivne\w*", "Rivne Oblast"), (r"sumy\w*", "Sumy Oblast"), (r"ternopil\w*", "Ternopil Oblast"), (r"kharkiv\w*", "Kharkiv Oblast"),
    (r"kherson\w*", "Kherson Oblast"), (r"khmelnytsk\w*", "Khmelnytskyi Oblast"), (r"cherkasy\w*", "Cherkasy Oblast"), (r"chernivtsi\w*", "Chernivtsi Oblast"), (r"chernihiv\w*", "Chernihiv Oblast"),
)
#: All of them in one pattern, so that a value is scanned once; the group that fits tells the entry. At most one can end a value.
PROVINCE = rf"(?i)\b(?:{'|'.join(f'({p})' for p, _ in PROVINCES)})\s+obl(?:ast)?\.?$"
#: Damaged and whole settlement prefixes, settlement words, and label words that no city has.
BROKEN_PREFIX = r"(?iu)^(?:слет|cлет|slet|смт|смт\.|cmt|smt|cмт|с-ще|селище\s+міського\s+типу)\s*[.\-:]*\s*"
CITY_PREFIX = r"(?iu)^(?:смт\.?|с-ще\.?|м\.|с\.|сел\.|хут\.|п\.?г\.?т\.?)\s*"
DESCRIPTOR = r"(?i)\b(?:urban-type\s+settlement|settlement)\b"
CITY_NOISE = r"(?iu)(?:date|birth|place|місц|мест|народжен|рожден|област|обл[.:]?|oblast|obl[.:]?|province|settlement|urban-type|селище)"
LOOKS_PROVINCE = r"(?iu)(?:^|[\s.,;:!?])(?:обл|obl|oblast|province)(?:[\s.,;:!?]|$)"
#: Countries, in small letters.
COUNTRIES = (
    "ukraine", "united states", "usa", "us", "russia", "belarus", "poland", "moldova", "romania", "hungary", "slovakia", "czech republic", "czechia", "germany", "france", "italy", "spain", "united kingdom", "uk", "canada",
    "mexico", "brazil", "argentina", "china", "japan", "india", "turkey", "israel", "georgia", "armenia", "azerbaijan", "kazakhstan", "uzbekistan",
)
COUNTRY_FIELDS = ("country_of_citizenship", "country_of_birth", "country_of_nationality", "passport_country_of_issuance")
DATE_FIELDS = ("dob", "last_entry_date", "ead_expiration_date")
#: Endings of patronymics.
LATIN_PATRONYMIC, CYRILLIC_PATRONYMIC = r"(?i)(?:ovych|ovich|ovna|ivna|yivna|ich|ych|vna)$", r"(?iu)(?:ович|овна|івна|ївна|іч|ич)$"
CYRILLIC = "[А-Яа-яІіЇїЄєҐґ]"
#: A field whose confidence is told and lower than this is kept in view.
LOW = 0.7


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def mixed_case(text: Column, title: str = "^[A-Z][a-z]+$") -> Column:
    """Whether some run of three Latin letters or more is neither all capitals, all small, nor in title case."""
    odd = lambda w: (w != F.upper(w)) & (w != F.lower(w)) & ~w.rlike(title)
    return F.exists(F.regexp_extract_all(text, F.lit("([A-Za-z]{3,})")), odd)


def province(text: Column) -> Column:
    """struct(value, reason); no value where the text is none."""

    def told(t: Column) -> Column:
        latin = trimmed(F.regexp_replace(F.regexp_replace(names.ukrainian_latin(t), "[.,]", ""), r"(?U)\s+", " "))
        by_map = let(latin, lambda s: F.when(s.rlike(PROVINCE), F.coalesce(*[F.when(F.regexp_extract(s, PROVINCE, n) != "", F.lit(v)) for n, (_, v) in enumerate(PROVINCES, 1)])))
        return let(F.struct(places.region(t)["english"].alias("region"), by_map.alias("map"), places.place(t, F.lit(True)).alias("place")), lambda s: (
            F.when(t == "", F.struct(F.lit(None).cast("string").alias("value"), F.lit("empty").alias("reason")))
            .when(s["region"].isNotNull(), F.struct(s["region"].alias("value"), F.lit("oblast_genitive_to_nominative").alias("reason")))
            .when(s["map"].isNotNull(), F.struct(s["map"].alias("value"), F.lit("latin_oblast_alias_map").alias("reason")))
            .when(s["place"]["value"].rlike(r"(?i)\bOblast$"), F.struct(s["place"]["value"].alias("value"), s["place"]["rule"].alias("reason")))
            .otherwise(F.struct(F.lit(None).cast("string").alias("value"), F.lit("unrecognized_oblast").alias("reason")))
        ))

    return let(trimmed(text), told)


def clean_city(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(trimmed(text), r"(?U)^[.\-:,\s]+", ""), BROKEN_PREFIX, "")
    # a word boundary is one of ASCII letters, so that only English words and Cyrillic ones beside such letters are cut out
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    out = F.regexp_replace(out, rf"(?iu){edge}(?:urban-type\s+settlement|settlement|селище(?:\s+міського\s+типу)?){edge}", " ")
    return trimmed(F.regexp_replace(F.regexp_replace(out, CITY_PREFIX, ""), r"(?U)\s+", " "))


def city_problem(value: Column) -> Column:
    """Why a cleaned city is none; null if it may be one."""
    return (
        F.when(value == "", "empty").when(F.length(value) < 2, "too_short").when(F.length(value) > 64, "too_long").when(~value.rlike(f"[A-Za-z]|{CYRILLIC}"), "no_letters").when(value.rlike(r"\d{4}"), "contains_year_fragment")
        .when(value.rlike(CITY_NOISE), "contains_label_noise").when(value.rlike(LOOKS_PROVINCE), "looks_like_province").when(mixed_case(value), "garbage_mixed_case")
        .when(value.rlike("(?i)[bcdfghjklmnpqrstvwxz]{5,}"), "garbage_consonant_cluster").when(F.size(F.split(value, r"(?U)\s+")) > 3, "garbage_too_many_words")
    )


def _verdict(status: str, reason: Column | str, value: Column | None) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), (F.lit(None).cast("string") if value is None else value).alias("value"))


def _city(raw: Column, said: Column) -> Column:
    both = trimmed(F.concat(F.coalesce(raw, F.lit("")), F.lit(" "), F.coalesce(said, F.lit(""))))

    def told(c: Column) -> Column:
        bad = F.struct(city_problem(c["raw"]).alias("raw"), city_problem(c["said"]).alias("said"))
        return let(bad, lambda p: F.when(p["raw"].isNotNull() & p["said"].isNotNull(), _verdict("rejected", p["said"], None)).otherwise(
            let(places.place(F.when(p["raw"].isNull(), c["raw"]).otherwise(c["said"]), F.lit(True)), lambda s: _verdict("normalized", s["rule"], F.coalesce(F.nullif(s["value"], F.lit("")), F.when(p["raw"].isNull(), c["raw"]).otherwise(c["said"]))))
        ))

    return F.when(both.rlike(DESCRIPTOR), _verdict("rejected", "contains_settlement_descriptor", None)).otherwise(let(F.struct(clean_city(raw).alias("raw"), clean_city(said).alias("said")), told))


def _family_name(x: Column) -> Column:
    garbage = mixed_case(x, "^[A-Z][a-z]+(?:[-'][A-Z][a-z]+)*$") | ~F.length(x).between(2, 50)
    titled = _title(x)
    latin = F.when(garbage, _verdict("rejected", "family_name_garbage", None)).when((x == F.upper(x)) & (titled != x), _verdict("normalized", "latin_titlecase", titled)).otherwise(_verdict("passed", "latin_passthrough", x))
    shape = ~F.length(x).between(2, 50) | x.rlike(r"\d")
    return F.when(x.rlike(CYRILLIC), F.when(shape, _verdict("rejected", "family_name_invalid_shape", None)).otherwise(_verdict("normalized", "kmu55_transliteration", names.ukrainian_latin(x)))).otherwise(latin)


def _title(x: Column) -> Column:
    """Small letters, with a capital at the start and after a hyphen, space or apostrophe."""
    chars = F.filter(F.split(F.lower(x), ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | F.get(chars, i - 1).rlike(r"(?U)[-\s']"), F.when(c.rlike("[a-z]"), F.upper(c)).otherwise(c)).otherwise(c)), "")


def _patronymic(x: Column) -> Column:
    cyrillic = x.rlike(CYRILLIC)
    garbage = mixed_case(x) | ~F.when(cyrillic, x.rlike(CYRILLIC_PATRONYMIC)).otherwise(F.lower(x).rlike(LATIN_PATRONYMIC)) | ~F.length(x).between(2, 50)
    taken = F.when(cyrillic, _verdict("normalized", "kmu55_transliteration", names.ukrainian_latin(x))).otherwise(_verdict("normalized", "latin_passthrough", x))
    return F.when(garbage, _verdict("rejected", "patronymic_garbage", None)).otherwise(taken)


def ready_for_forms(fields: DataFrame) -> DataFrame:
    """fields (doc, field, raw, normalized, source, confidence) with value, status, reason, manual and low_confidence.

    Dates of the US are turned round in all fields; fields of the core (source canonical_core) are else left as they are. A province is told from the
    raw text, else from the normalized one; a city likewise, cleaned of settlement words. Countries must be known, surnames and patronymics plausible; Cyrillic
    ones are spelled in Latin letters. What is rejected has no value and is for a person. Fields without text, and others, pass.
    """
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    said = trimmed(F.col("normalized"))
    iso = F.format_string("%s-%02d-%02d", F.regexp_extract(said, us, 3), F.regexp_extract(said, us, 1).cast("int"), F.regexp_extract(said, us, 2).cast("int"))
    dated = F.when(F.col("field").isin(*DATE_FIELDS) & said.rlike(us), iso).otherwise(F.col("normalized"))
    # as rows of a generator each part is made once
    rows = fields.select("*", F.inline(F.array(F.struct(dated.alias("_said")))))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    raw, now, field = F.col("raw"), F.col("_said"), F.col("field")
    any_text = some(raw) | some(now)
    first = F.when(trimmed(now) != "", trimmed(now)).otherwise(trimmed(raw))
    place = let(province(F.coalesce(raw, F.lit(""))), lambda p: F.when(p["value"].isNotNull() | ~some(now), p).otherwise(province(now)))
    by_province = let(place, lambda p: F.when(p["value"].isNotNull(), _verdict("normalized", p["reason"], p["value"])).otherwise(_verdict("rejected", p["reason"], None)))
    country = trimmed(F.when(some(now), now).otherwise(raw))
    passed = _verdict("passed", "no_knowledge_rule_for_field", now)
    verdict = (
        F.when(F.coalesce(F.col("source") == "canonical_core", F.lit(False)), _verdict("passed", "canonical_core_no_renormalize", now)).when(~any_text, passed).when(field == "province_of_birth", by_province)
        .when(field == "city_of_birth", _city(raw, now)).when(field.isin(*COUNTRY_FIELDS), F.when(F.lower(country).isin(*COUNTRIES), passed).otherwise(_verdict("rejected", "country_not_recognized", None)))
        .when(field == "family_name", let(first, _family_name)).when(field.isin("patronymic", "middle_name"), let(first, _patronymic)).otherwise(passed)
    )
    out = rows.select(*fields.columns, F.inline(F.array(verdict)))
    return out.withColumn("manual", F.col("status") == "rejected").withColumn("low_confidence", F.coalesce(F.col("confidence") < LOW, F.lit(False)))
