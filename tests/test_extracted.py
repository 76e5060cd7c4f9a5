"""Fields made ready for forms, against a plain Python version of the rules."""

import random
import re

from fieldwright.operators import extracted

#: Latin spellings of the Cyrillic words of these tests.
LATIN = {"Тростянець": "Trostianets", "Київ": "Kyiv", "Шевченко": "Shevchenko", "Григорович": "Hryhorovych", "Іванівна": "Ivanivna", "Атлантида": "Atlantyda", "Петренку": "Petrenku", "Жданівка1999": "Zhdanivka1999"}
REGIONS = {"Вінницької обл.": "Vinnytsia Oblast", "Київська область": "Kyiv Oblast", "львівської області": "Lviv Oblast"}
CYR = "[А-Яа-яІіЇїЄєҐґ]"


def mixed(s, title=r"[A-Z][a-z]+"):
    return any(w != w.upper() and w != w.lower() and not re.fullmatch(title, w) for w in re.findall("[A-Za-z]{3,}", s))


def province(t):
    t = (t or "").strip()
    if not t:
        return None, "empty"
    if t in REGIONS:
        return REGIONS[t], "oblast_genitive_to_nominative"
    latin = re.sub(r"\s+", " ", re.sub("[.,]", "", LATIN.get(t, t))).strip()
    for pattern, value in extracted.PROVINCES:
        if re.search(rf"\b{pattern}\s+obl(?:ast)?\.?$", latin, re.I | re.A):
            return value, "latin_oblast_alias_map"
    if re.search(r"\bOblast$", LATIN.get(t, t), re.I | re.A):
        return LATIN.get(t, t), "kmu55_transliteration"
    return None, "unrecognized_oblast"


def clean(t):
    t = re.sub(r"^[.\-:,\s]+", "", (t or "").strip())
    t = re.sub(r"^(?:слет|cлет|slet|смт|смт\.|cmt|smt|cмт|с-ще|селище\s+міського\s+типу)\s*[.\-:]*\s*", "", t, flags=re.I)
    t = re.sub(r"\b(?:urban-type\s+settlement|settlement)\b", " ", t, flags=re.I | re.A)
    t = re.sub(r"^(?:смт\.?|с-ще\.?|м\.|с\.|сел\.|хут\.|п\.?г\.?т\.?)\s*", "", t, flags=re.I)
    return re.sub(r"\s+", " ", t).strip()


def problem(v):
    for bad, reason in (
        (not v, "empty"), (len(v) < 2, "too_short"), (len(v) > 64, "too_long"), (not re.search(f"[A-Za-z]|{CYR}", v), "no_letters"), (re.search(r"\d{4}", v), "contains_year_fragment"),
        (re.search("date|birth|place|місц|мест|народжен|рожден|област|обл[.:]?|oblast|obl[.:]?|province|settlement|urban-type|селище", v, re.I), "contains_label_noise"), (mixed(v), "garbage_mixed_case"),
        (re.search("[bcdfghjklmnpqrstvwxz]{5,}", v, re.I), "garbage_consonant_cluster"), (len(v.split()) > 3, "garbage_too_many_words"),
    ):
        if bad:
            return reason
    return None


def plain(field, raw, said, source):
    raw_, now = raw or "", said
    t = (said or "").strip()
    if field in ("dob", "last_entry_date", "ead_expiration_date") and (m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", t)):
        now = f"{m[3]}-{int(m[1]):02d}-{int(m[2]):02d}"
    passed = ("passed", "no_knowledge_rule_for_field", now)
    if source == "canonical_core":
        return "passed", "canonical_core_no_renormalize", now
    if not raw_ and not now:
        return passed
    if field == "province_of_birth":
        value, reason = province(raw_)
        if not value and now:
            value, reason = province(now)
        return ("normalized" if value else "rejected", reason, value)
    if field == "city_of_birth":
        if re.search(r"\b(?:urban-type\s+settlement|settlement)\b", f"{raw_} {now or ''}", re.I | re.A):
            return "rejected", "contains_settlement_descriptor", None
        a, b = clean(raw_), clean(now)
        if problem(a) and problem(b):
            return "rejected", problem(b), None
        use = b if problem(a) else a
        return "normalized", "kmu55_transliteration", LATIN.get(use, use)
    if field in extracted.COUNTRY_FIELDS:
        return passed if (now or raw_).strip().lower() in extracted.COUNTRIES else ("rejected", "country_not_recognized", None)
    x = (now or "").strip() or raw_.strip()
    if field == "family_name":
        if re.search(CYR, x):
            return ("rejected", "family_name_invalid_shape", None) if not 2 <= len(x) <= 50 or re.search(r"\d", x) else ("normalized", "kmu55_transliteration", LATIN[x])
        if mixed(x, r"[A-Z][a-z]+(?:[-'][A-Z][a-z]+)*") or not 2 <= len(x) <= 50:
            return "rejected", "family_name_garbage", None
        cased = re.sub(r"(^|[-\s'])([a-z])", lambda m: m[1] + m[2].upper(), x.lower()) if x == x.upper() else x
        return ("normalized", "latin_titlecase", cased) if cased != x else ("passed", "latin_passthrough", x)
    if field in ("patronymic", "middle_name"):
        cyr = re.search(CYR, x)
        fits = re.search("(?:ович|овна|івна|ївна|іч|ич)$", x, re.I) if cyr else re.search("(?:ovych|ovich|ovna|ivna|yivna|ich|ych|vna)$", x, re.I)
        if mixed(x) or not fits or not 2 <= len(x) <= 50:
            return "rejected", "patronymic_garbage", None
        return ("normalized", "kmu55_transliteration", LATIN[x]) if cyr else ("normalized", "latin_passthrough", x)
    return passed


VALUES = {
    "province_of_birth": [*REGIONS, "Vinnytska obl.", "VINNYTSKA OBL.", "Kyivska oblast", "ivano-frankivska obl", "Атлантида", "Atlantis Oblast", "obl.", "Lvivska", "  "],
    "city_of_birth": ["слет. Тростянець", "смт Тростянець", "м. Київ", "Київ", "BiRHEROI odwaemi", "Trostianets", "KYIV", "kyiv", "Kyiv 1999", "Place of birth", "settlement Bar", "x", "—", "bcdfghj", "one two three four", "q" * 70, "Вінницька обл.", "Жданівка1999", " . Bar", "12", ""],
    "country_of_birth": ["Ukraine", " ukraine ", "IVANENKO", "", "USA"],
    "passport_country_of_issuance": ["Poland", "Atlantis"],
    "family_name": ["IVANENKO", "Ivanenko", "O'NEIL-SMITH", "DE LA CRUZ", "BiRHEROI", "x", "A" * 60, "Шевченко", "Жданівка1999", "ivanenko", "Anna-Maria"],
    "patronymic": ["Григорович", "Іванівна", "Петренку", "Hryhorovych", "Cepriticbur", "IVANIVNA", "BiRovych", "x"],
    "middle_name": ["Григорович", "Smith"],
    "dob": ["1/25/1990", "01/25/1990", "1990-01-25", "x", " 2/3/1999 "],
    "last_entry_date": ["12/31/2020"],
    "other": ["anything", "1/2/1999"],
}


def test_fields_equal_a_plain_version(spark):
    r = random.Random(4)
    rows = []
    for field, values in VALUES.items():
        for raw in [*values, None, ""]:
            for said in r.sample([*values, None, ""], min(5, len(values) + 2)):
                rows.append((len(rows), field, raw, said, r.choice([None, "vision", "vision", "canonical_core"]), r.choice([None, 0.5, 0.7, 0.9])))
    fields = spark.createDataFrame(rows, "doc int, field string, raw string, normalized string, source string, confidence double")
    got = {x.doc: x for x in extracted.ready_for_forms(fields).collect()}
    assert len(got) == len(rows) > 200
    for n, field, raw, said, source, confidence in rows:
        want = plain(field, raw, said, source)
        assert (got[n].status, got[n].reason, got[n].value) == want, (field, raw, said, source)
        assert got[n].manual == (want[0] == "rejected") and got[n].low_confidence == (confidence is not None and confidence < 0.7)
