"""Places, sex and spellings as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldwright.functions.names import mixed_script, ukrainian_latin

#: Regions by the adjective of their name.
REGIONS = {
    "вінницька": "Vinnytsia", "волинська": "Volyn", "дніпропетровська": "Dnipropetrovsk", "донецька": "Donetsk", "житомирська": "Zhytomyr", "закарпатська": "Zakarpattia", "запорізька": "Zaporizhzhia",
    "івано-франківська": "Ivano-Frankivsk", "київська": "Kyiv", "кіровоградська": "Kirovohrad", "луганська": "Luhansk", "львівська": "Lviv", "миколаївська": "Mykolaiv", "одеська": "Odesa", "полтавська": "Poltava",
    "рівненська": "Rivne", "сумська": "Sumy", "тернопільська": "Ternopil", "харківська": "Kharkiv", "херсонська": "Kherson", "хмельницька": "Khmelnytskyi", "черкаська": "Cherkasy", "чернівецька": "Chernivtsi",
    "чернігівська": "Chernihiv",
}
#: What stands before a settlement's name, and its English; single letters count only before a capital.
DESIGNATORS = (
    (r"^\s*(?:смт\.?|с\.\s*м\.\s*т\.?|селище міського типу|пгт\.?|п\.\s*г\.\s*т\.?)\s+", "urban-type settlement", False),
    (r"^\s*село\s+", "village", False),
    (r"^\s*с\.\s+", "village", True),
    (r"^\s*(?:селище|с-ще)\s+", "settlement", False),
    (r"^\s*(?:хутір|хут\.)\s+", "khutor", False),
    (r"^\s*місто\s+", None, False),
    (r"^\s*м\.\s+", None, True),
)
#: Letters of a sex, in small letters.
SEXES = {
    "ч": "Male", "чоловіча": "Male", "чол": "Male", "чоловік": "Male", "м": "Male", "мужской": "Male", "муж": "Male", "ж": "Female", "жіноча": "Female", "жін": "Female", "жінка": "Female", "f": "Female", "женский": "Female",
    "жен": "Female", "m": "Male", "male": "Male", "female": "Female",
}
#: Terms that no output may hold.
BLOCKED = ("Ministry of Interior of Ukraine", "Militia", "Middle Name")
#: Latin letters that look like Cyrillic ones, and abbreviations whose casing stays.
LOOKALIKES = "ABCEHIKMOPTXYaceiopxy"
ABBREVIATIONS = ("MVS", "MIA", "SBU", "ID", "USA", "USSR", "UKR", "UAH", "USCIS", "DHS", "DOJ", "ICE", "I-94", "I-130", "I-485", "EAD", "RFE", "DACA", "TPS", "U4U", "DMS", "РНОКПП")
#: Letters that are taken for each other, and the cost of that.
CONFUSABLE = (
    ("т", "п"), ("и", "н"), ("ш", "т"), ("ш", "щ"), ("е", "є"), ("и", "й"), ("л", "а"), ("о", "с"), ("р", "г"),
    ("ц", "щ"), ("в", "б"), ("м", "ш"), ("н", "п"), ("і", "и"), ("ї", "і"), ("у", "ч"), ("д", "л"), ("к", "н"),
)
CONFUSED = 0.4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def region(text: Column) -> Column:
    """struct(nominative, english) of a region in any case of its name; null if it is none."""
    bare = F.trim(F.regexp_replace(F.lower(text), r"\s*(областей?|обл(?:асть|асті|\.?))\s*", ""))
    told = lambda adjective, english: F.when(english.isNotNull(), F.struct(F.concat(adjective, F.lit(" область")).alias("nominative"), F.concat(english, F.lit(" Oblast")).alias("english")))
    return let(F.regexp_replace(bare, "к(а|ої|ій|ою|у)$", "ка"), lambda adjective: told(adjective, looked_up(REGIONS, adjective)))


def designator(text: Column) -> Column:
    """English kind of a settlement as the source tells it; null for cities and where none is told."""
    found = F.lit(None).cast("string")
    for pattern, english, guarded in reversed(DESIGNATORS):
        fits = text.rlike("(?iu)" + pattern)
        if guarded:
            fits = fits & F.regexp_replace(text, "(?iu)" + pattern, "").rlike("^[А-ЯҐЄІЇ]")
        found = F.when(fits, F.lit(english)).otherwise(found)
    return found


def sex(text: Column) -> Column:
    """struct(value, confidence, review): Male or Female, else the text as it is, for review."""
    told = lambda value: F.struct(F.coalesce(value, text).alias("value"), F.when(value.isNull(), 0.5).otherwise(0.99).alias("confidence"), value.isNull().alias("review"))
    return let(looked_up(SEXES, F.lower(F.trim(text))), told)


def personal_name(text: Column, controlling: Column) -> Column:
    """struct(value, confidence, review): a controlling Latin spelling wins, for review if the rules spell otherwise; else the rules' spelling."""
    latin = ukrainian_latin(text)
    ruled, told = F.when(F.length(text) > 0, 0.9).otherwise(0.0), controlling.isNotNull()
    return F.struct(F.coalesce(controlling, latin).alias("value"), F.when(told, 0.99).otherwise(ruled).alias("confidence"), (told & (F.lower(latin) != F.lower(controlling))).alias("review"))


def output_allowed(value: Column) -> Column:
    return ~F.exists(F.array(*map(F.lit, BLOCKED)), lambda b: F.contains(value, b))


def lookalike(token: Column) -> Column:
    """Two Latin letters or more, all of which look like Cyrillic ones, and no Cyrillic."""
    letters = F.regexp_replace(token, "[^A-Za-z]", "")
    return ~token.rlike(r"[\x{0400}-\x{052F}]") & (F.length(letters) >= 2) & letters.rlike(f"^[{LOOKALIKES}]*$")


def odd_casing(token: Column) -> Column:
    """Capitals after small letters in a word of three letters or more that is no abbreviation."""
    return (F.length(token) >= 3) & ~F.upper(token).isin(*ABBREVIATIONS) & token.rlike("[a-z][A-Z]|[A-Z]{2,}[a-z][A-Z]")


def name_doubts(name: Column) -> Column:
    """What speaks against a name's reading, in order: mixed_script_token, latin_lookalike_substitution_suspected, abnormal_casing_detected."""
    tokens = F.split(F.trim(name), r"\s+")
    some = lambda test, reason: F.when(F.exists(tokens, test), F.lit(reason))
    return F.array_compact(F.array(some(mixed_script, "mixed_script_token"), some(lookalike, "latin_lookalike_substitution_suspected"), some(odd_casing, "abnormal_casing_detected")))


def folded(text: Column) -> Column:
    """Letters that are taken for each other, also by way of a third, made one."""
    groups: list[set[str]] = []
    for a, b in CONFUSABLE:
        merged = {a, b}.union(*[g for g in groups if g & {a, b}])
        groups = [g for g in groups if not g & {a, b}] + [merged]
    letters = {x: min(g) for g in groups for x in g}
    return F.translate(text, "".join(letters), "".join(letters.values()))


@F.pandas_udf(DoubleType())
def confusion_distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edit distance in which letters that are taken for each other cost 0.4; no built-in has weights."""
    cheap = {a + b for a, b in CONFUSABLE} | {b + a for a, b in CONFUSABLE}

    def distance(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        a, b = a.lower(), b.lower()
        row = np.arange(len(b) + 1, dtype=float).tolist()
        for i, x in enumerate(a, 1):
            left = [float(i)]
            for j, y in enumerate(b, 1):
                left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (0 if x == y else CONFUSED if x + y in cheap else 1)))
            row = left
        return row[-1]

    for a, b in pairs:
        yield pd.Series([distance(x, y) for x, y in zip(a, b)], dtype=float)


#: Characters that look alike, and the confidence under which that counts; None always counts.
SHAPES = (
    ("0", "O", None), ("0", "Ø", None), ("1", "I", None), ("1", "l", None), ("3", "8", 0.92), ("5", "6", 0.92), ("6", "9", None), ("7", "Z", 0.95), ("4", "A", None), ("2", "Z", None), ("B", "8", 0.92), ("G", "6", 0.92),
)


def ambiguous_digits(text: Column, confidences: Column) -> Column:
    """Positions (from 0) whose character may be another one, as array of struct(position, candidates); confidences of another length count as 0."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    sure = F.when(F.size(confidences) == F.size(chars), confidences).otherwise(F.transform(chars, lambda _: F.lit(0.0)))

    def candidates(c: Column, p: Column) -> Column:
        return F.array_compact(F.array(*[F.when((c == x) & (F.lit(True) if least is None else p < least), F.lit(y)) for a, b, least in SHAPES for x, y in ((a, b), (b, a))]))

    told = F.transform(F.arrays_zip(chars.alias("c"), sure.alias("p")), lambda z, i: F.struct(i.alias("position"), candidates(z["c"], z["p"]).alias("candidates")))
    return F.filter(told, lambda t: F.size(t["candidates"]) > 0)


#: Zones in which a date may stand.
DATE_ZONES = {
    "date_of_birth": ("birth_block", "personal_data", "dob_line", "demographic_block", "child_block"),
    "date_of_issue": ("issuance_block", "issue_block", "validity_block", "administrative_block", "footer_block"),
    "date_of_expiry": ("issuance_block", "validity_block", "expiry_block"),
    "date_of_marriage": ("registration_block", "civil_act_block", "main_block"),
    "date_of_death": ("registration_block", "civil_act_block", "main_block"),
    "date_of_registration": ("registration_block", "civil_act_block", "footer_block"),
    "act_record_date": ("act_record_block", "civil_act_block", "registration_block"),
}


def date_in_zone(field: Column, zone: Column) -> Column:
    """Whether a date stands in a zone that its field allows; null for fields that are not locked."""
    found, lower = F.lit(None).cast("boolean"), F.lower(F.coalesce(zone, F.lit("")))
    for name, zones in DATE_ZONES.items():
        found = F.when(field == name, F.exists(F.array(*map(F.lit, zones)), lambda z: F.contains(lower, z))).otherwise(found)
    return found


def machine_lines(text: Column) -> Column:
    """A passport's two lines found in any text, cut or filled to 44, as array; null if there are none."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda l: F.upper(F.regexp_replace(l, r"\s+", "")))
    found = F.filter(lines, lambda l: l.rlike("^[A-Z0-9<]{28,46}$") & l.contains("<"))
    first = F.get(F.filter(found, lambda l: l.rlike("^P[<A-Z]") & l.contains("<<")), 0)
    after = F.get(found, F.array_position(found, first).cast("int"))
    second = F.coalesce(after, F.get(F.filter(found, lambda l: (l != first) & l.rlike("[0-9]")), 0))
    fit = lambda l: F.substring(F.rpad(l, 44, "<"), 1, 44)
    return F.when(first.isNotNull() & second.isNotNull(), F.array(fit(first), fit(second)))


def machine_status(text: Column, valid: Column) -> Column:
    """Why a text gave no valid machine lines: valid_mrz, check_digit_failed, partial_mrz_lines or no_mrz_lines."""
    lines = F.transform(F.split(text, r"\r?\n"), F.trim)
    full = lambda n: F.size(F.filter(lines, lambda l: l.rlike("^[A-Z0-9<]{%d}$" % n)))
    return F.when(valid, "valid_mrz").when((full(44) >= 2) | (full(30) >= 3), "check_digit_failed").when((full(44) == 1) | full(30).isin(1, 2), "partial_mrz_lines").otherwise("no_mrz_lines")


#: Signs of an authority in a text, the first that fits, and its key.
AUTHORITY_SIGNS = (
    (r"міліці[яії]", "MILITSIYA"), (r"дільничн.*інспект", "DILTNICHNYI"), (r"національн[аоіїє]\s*поліці", "NPU"), (r"поліці[яії]", "NPU"), (r"(загс|рацс|драцс|реєстрац.*цивільн)", "CIVIL_REGISTRY"),
    (r"даі|автомобільн.*інспекці", "DAI"), (r"гумвс|головн.*управлінн.*мвс", "GUMVS"), (r"умвс|управлінн.*мвс", "UMVS"), (r"мвс|внутрішн.*справ", "MVS"), (r"міграційн.*служб", "DMS"), (r"прикордонн", "SBGSU"),
    (r"виконав.*комітет|виконком", "VIKONKOM"), (r"обласн.*держав.*адмін|ода\b", "ODA"), (r"районн.*держав.*адмін|рда\b", "RDA"), (r"сільськ.*рад|сільрад", "SILRADA"), (r"міськ.*рад", "MISKRADA"),
    (r"паспортний стіл|паспортн.*стол", "PASSPORT_OFFICE"), (r"нотаріальн.*контор|державн.*нотаріальн", "NOTARY"), (r"нотаріус", "NOTARY"), (r"закордонн.*справ", "MFA"), (r"юстиці", "MINJUST"),
)
#: English of authorities: formal, as forms have it, plain.
AUTHORITIES = {
    "MVS": ("Ministry of Internal Affairs of Ukraine", "Ministry of Internal Affairs of Ukraine", "Ukrainian Interior Ministry"),
    "MFA": ("Ministry of Foreign Affairs of Ukraine", "Ministry of Foreign Affairs of Ukraine", "Ukrainian Foreign Ministry"),
    "MINJUST": ("Ministry of Justice of Ukraine", "Ministry of Justice of Ukraine", "Ukrainian Justice Ministry"),
    "DMS": ("State Migration Service of Ukraine", "State Migration Service of Ukraine", "Ukrainian Migration Service"),
    "NPU": ("National Police of Ukraine", "National Police of Ukraine", "Ukrainian National Police"),
    "MILITSIYA": ("Militsiya", "Militsiya", "militia police (historical)"),
    "SBGSU": ("State Border Guard Service of Ukraine", "State Border Guard Service of Ukraine", "Ukrainian Border Guard"),
    "CIVIL_REGISTRY": ("civil status registration authority", "Civil Registry Office (ZAHS)", "civil registry"),
    "DAI": ("State Automobile Inspectorate", "State Automobile Inspectorate", "traffic police (historical)"),
    "UMVS": ("Regional Department of the Ministry of Internal Affairs of Ukraine", "Regional Department of MIA", "regional MIA office"),
    "GUMVS": ("Main Department of the Ministry of Internal Affairs of Ukraine", "Main Department of MIA", "main MIA directorate"),
    "VIKONKOM": ("Executive Committee", "Executive Committee", "city or village executive committee"),
    "RDA": ("District State Administration", "District State Administration", "district administration"),
    "ODA": ("Regional State Administration", "Regional State Administration", "regional administration"),
    "SILRADA": ("Village Council", "Village Council", "village council (silrada)"),
    "MISKRADA": ("City Council", "City Council", "city council"),
    "NOTARY": ("Notary Public", "Notary Public", "notary"),
    "PASSPORT_OFFICE": ("Passport Office", "Passport Office", "passport office (historical pre-DMS)"),
    "DILTNICHNYI": ("District Inspector", "District Inspector", "local beat officer (historical pre-2015)"),
}


def authority(text: Column, mode: int = 1) -> Column:
    """struct(key, value, confidence, review): an authority in English, formal (0), as forms have it (1) or plain (2); unknown ones stay as they are, for review."""
    signs = F.coalesce(*[F.when(text.rlike("(?iu)" + p), F.lit(k)) for p, k in AUTHORITY_SIGNS])

    def told(key: Column) -> Column:
        value = looked_up({k: names[mode] for k, names in AUTHORITIES.items()}, key)
        return F.struct(key.alias("key"), F.coalesce(value, text).alias("value"), F.when(value.isNull(), 0.4).otherwise(0.92).alias("confidence"), value.isNull().alias("review"))

    return let(signs, told)


#: Old spellings of cities and today's, and those of renamed cities with the old Ukrainian form.
RESPELLED = {
    "Kiev": "Kyiv", "Kharkov": "Kharkiv", "Odessa": "Odesa", "Lvov": "Lviv", "Zaporozhye": "Zaporizhzhia", "Vinnitsa": "Vinnytsia", "Vinnica": "Vinnytsia", "Zhitomir": "Zhytomyr", "Nikolaev": "Mykolaiv", "Chernigov": "Chernihiv",
    "Lugansk": "Luhansk", "Ustinovka": "Ustynivka",
}
RENAMED = (("Dnepropetrovsk", "Dnipropetrovsk", "Dnipro"), ("Kirovograd", "Kirovohrad", "Kropyvnytskyi"))


def place(text: Column, historical: Column) -> Column:
    """struct(value, rule, confidence, review): a region by its nominative; else the Latin spelling, with old spellings of cities mended. Renamed cities stay as read, in today's documents for review."""
    old = [x.lower() for wrong, kept, _ in RENAMED for x in (wrong, kept)]

    def told(x: Column) -> Column:
        r, latin, mended = x["r"], x["latin"], looked_up({k.lower(): v for k, v in RESPELLED.items()}, F.lower(x["latin"]))
        renamed = F.lower(latin).isin(*old)
        rule = F.when(r.isNotNull(), "oblast_genitive_to_nominative").when(historical & renamed, "historical_preserve").when(~historical & mended.isNotNull(), "geo_correction").when(~historical & renamed, "geo_rename_review").otherwise("kmu55_transliteration")
        value = F.when(r.isNotNull(), r["english"]).when(~historical & mended.isNotNull(), mended).otherwise(latin)
        return F.struct(value.alias("value"), rule.alias("rule"), F.when(r.isNotNull(), 0.92).otherwise(0.88).alias("confidence"), (r.isNull() & ~historical & renamed).alias("review"))

    return let(F.struct(region(text).alias("r"), ukrainian_latin(text).alias("latin")), told)


#: States by the office that takes their mail.
CHICAGO = ("AL", "AK", "AS", "AZ", "AR", "CO", "CT", "DE", "DC", "FL", "GA", "GU", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "NY", "OH")
PHOENIX = (
    "CA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NC", "ND", "MP", "OK", "OR", "PA", "PR", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VI", "VA", "WA", "WV", "WI", "WY",
)


def mail_office(state: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    return F.when(s.isin(*CHICAGO), "chicago").when(s.isin(*PHOENIX), "phoenix").otherwise("unknown_state")


def forms_with_fees(age: Column, work_permit: Column, waiver: Column) -> Column:
    """Forms whose fees apply: the application, biometrics from 14 years or if the age is unknown, the work permit and the waiver if wanted."""
    return F.array_compact(F.array(F.lit("I-821"), F.when(age.isNull() | (age >= 14), F.lit("biometrics")), F.when(work_permit, F.lit("I-765")), F.when(waiver, F.lit("I-912"))))
