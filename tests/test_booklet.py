"""Booklet pages against a plain Python reading of them, line by line."""

import random
import re

from fieldwright.operators import booklet
from fieldwright.operators.booklet import LABELS, NOISE, SEXES, SHORT_MONTHS

UA = ("січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня")
RU = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
SAME = str.maketrans("ABCEHIKMOPTXYaceiopxy", "АВСЕНІКМОРТХУасеіорху")
CYR = "А-ЯІЇЄҐа-яіїєґ"
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def letters(s):
    return re.sub("[^А-ЯІЇЄҐ]", "", re.sub("['ʼ`’]", "", s.upper()).translate(SAME))


def clean(s):
    s = s.strip()
    for pattern, by in NOISE:
        s = re.sub(pattern.replace("(?U)", ""), by.replace("$1", r"\1"), s, count=0 if "+" == pattern[-1] else 1)
    return s.strip()


def lookalike(s):
    return bool(re.fullmatch(r"[\s\-'’ʼ`ABCEHIKMOPTXYaceiopxy]*", s)) and bool(re.search("[A-Za-z]", s))


def junk(s):
    return len(s) < 2 or not (re.search(rf"[{CYR}\d]", s) or lookalike(s))


def title(s):
    s = s.translate(SAME) if lookalike(s) else s
    return " ".join(w[:1].upper() + w[1:] for w in s.lower().split())


def day_of(d, m, y):
    d, y = int(d), int(y)
    y = (1900 + y if y > 30 else 2000 + y) if y < 100 else y
    return f"{y}-{int(m):02d}-{d:02d}" if m and 1 <= int(m) <= 12 and 1 <= d <= 31 and 1900 <= y <= 2100 else None


def date(s):
    s = s.strip().lower()
    months = {w: i % 12 + 1 for i, w in enumerate((*UA, *RU))}
    if (m := re.search(r"(\d{1,2})\s+([а-яії]+)\s+(\d{2,4})", s)) and (got := day_of(m[1], months.get(m[2]) or SHORT_MONTHS.get(m[2][:3]), m[3])):
        return got
    if (m := re.search(r"(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{2,4})", s)) and (got := day_of(m[1], m[2], m[3])):
        return got
    if m := re.search(rf"(\d{{1,2}}){EDGE}([^0-9]+){EDGE}(\d{{2,4}}){EDGE}", s):
        for t in filter(None, re.split(r"[\s/\\.,\-—_:;]+", m[2])):
            head = t[:3].upper()
            month = SHORT_MONTHS.get(t[:3]) or (re.fullmatch("[ABCEHIKMOPTXYА-ЯІЇЄҐ]+", head) and SHORT_MONTHS.get(head.translate(SAME).lower()))
            if month:
                return day_of(m[1], month, m[3])
    return None


def is_label(t):
    return any(h in re.sub(r"\s+", "", t).lower() for h in booklet.LABEL_HINTS)


def fits(t, label):
    key = letters(label)
    if not key:
        return False
    if "/" not in label and " " not in label and len(key) <= 6:
        return any(letters(c).startswith(key) and len(letters(c)) <= len(key) + 3 for c in t.split())
    return key in letters(t)


def near(lines, i, label):
    at = lines[i].lower().find(label.lower())
    if at >= 0:
        tail = lines[i][at + len(label) :].strip()
        if len(tail) >= 2 and not re.fullmatch(r"[:\-—_.]+", tail) and not junk(clean(tail)):
            return clean(tail)
    for o in (-1, -2, 1, 2, 3):
        if 0 <= i + o < len(lines) and len(t := lines[i + o]) >= 2 and not is_label(t) and not junk(clean(t)):
            return clean(t)
    return None


def find(lines, labels):
    for label in labels:
        for i, t in enumerate(lines):
            if fits(t, label) and (v := near(lines, i, label)):
                return v
    return None


def plain(text, year):
    lines, low = [t.strip() for t in (text or "").split("\n")], (text or "").lower()
    if not any(s in low for s in (*booklet.STRONG_SIGNS, *booklet.WEAK_SIGNS)):
        return None
    out, found = {}, {name: find(lines, labels) for name, labels in LABELS.items()}
    for name in ("family_name", "given_name"):
        if found[name]:
            out[name] = title(found[name])
    if (m := found["middle_name"]) and not re.search(r"\d", m) and 2 <= len(m) <= 40 and not any(w in m.lower() for w in (*UA, *RU)):
        out["middle_name"] = title(m)
    if found["dob"]:
        out["dob"] = date(found["dob"])
    else:
        born = [d for t in lines if not is_label(t) and (d := date(clean(t))) and 1920 <= int(d[:4]) <= year - 10]
        out["dob"] = born[0] if len(born) == 1 else None
    number = next((f"{m[1]} {m[2]}".upper() for t in lines if (m := re.search(rf"{EDGE}([А-ЯІЇЄҐABCEHIKMOPTX]{{2}})\s*((?:[0-9]\s*){{6}}){EDGE}", t))), None)
    if not number and found["number"] and (m := re.fullmatch("([А-ЯІЇЄҐABCEHIKMOPTX]{2})([0-9]{6})", re.sub(r"\s+", "", found["number"].upper()))):
        number = f"{m[1]} {m[2]}"
    out["passport_number"] = number
    if found["sex"]:
        out["sex"] = SEXES.get(re.sub("[^A-ZА-ЯІЇЄҐ]", "", found["sex"].strip().upper())[:5])
    if (at := next((i for i, t in enumerate(lines) if any(fits(t, p) for p in booklet.PLACE_LABELS)), None)) is not None:
        parts = []
        for o in range(-2, 5):
            if 0 <= at + o < len(lines) and len(t := lines[at + o]) >= 2 and not is_label(t):
                end = next((t.lower().find(w) + len(w) for w in ("народження", "рождения", "birth") if w in t.lower()), 0) if o == 0 else 0
                if not junk(c := clean(t[end:])):
                    parts.append(c)
        oblast = rf"(?i)[A-Za-z0-9_{CYR}']+(?:ської|зької|цької|ського)\s+(?:обл(?:асті)?\.?)"
        o, c, whole = next((p for p in reversed(parts) if re.search(oblast, p)), None), next((p for p in parts if not re.search(oblast, p)), None), " ".join(parts)
        if (not o or not c) and (m := re.search(rf"(?i)(.*?)\s*({oblast[4:]})", whole)):
            o, c = o or m[2].strip(), c or m[1].strip() or None
        if not c and not o and len(whole) >= 2:
            c = whole
        if c and 2 <= len(c) <= 60 and not re.search(r"\d{4}", c) and not re.search("(?i)січня|червня|серпня|жовтня|января|июня|августа", c):
            out["city_of_birth"] = c
        if o and len(o) >= 4:
            out["province_of_birth"] = o
    if found["issued_by"] and 4 <= len(office := clean(found["issued_by"])) <= 200:
        out["issued_by"] = office
    if found["passport_date_of_issue"]:
        out["passport_date_of_issue"] = date(found["passport_date_of_issue"])
    return {k: v for k, v in out.items() if v} | dict.fromkeys(("country_of_nationality", "country_of_birth", "passport_country_of_issuance"), "Ukraine")


def pages():
    r = random.Random(7)
    labels = [x for names in (*LABELS.values(), booklet.PLACE_LABELS) for x in names] + ["ПРІЗВИЩЕ", "IM'A", "Поліграфічний комбінат", "підпис власника паспорта", "Surname", "Прізвище / Surname", "Ім'я / Given Names", "Дата народження / Date of birth", "Стать / Sex", "Місце народження / Place of birth"]
    values = ["Шевченко", "ШЕВЧЕНКО", "TAPAC", "Тарас Григорович", "Григорович", "січня", "01 січня 1990 року", "25 июня 1986 года", "13 CEP / AUG 60", "01.02.1990", "1-2-85", "13 MAY 60", "99.99.1990", "Ч", "ЧОЛ", "жін", "F", "EA 991991", "ЕА991991", "№ EK 79 03 96", "ЕК790396", "м. Вінниця", "Вінницької обл.", "м. Бар Вінницької області", "смт Тростянець", "Вінницьким МВ УМВС", "Authority 5012", "", "—", "a", "Smith", "/ Surname Петренко", "Петренко / Surname", "Петренко Petrenko", "12", "слово " * 12]
    out = []
    for _ in range(400):
        lines = []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            lines.append(r.choice(labels) if kind < 0.35 else r.choice(values) if kind < 0.75 else f"{r.choice(labels)}{r.choice([' ', ': ', ' / Date of birth '])}{r.choice(values)}")
        out.append("\n".join(([r.choice(booklet.STRONG_SIGNS).upper()] if r.random() < 0.5 else []) + lines))
    return [*out, None, "", "hello"]


def test_pages_equal_a_plain_reading(spark):
    texts = pages()
    rows = {r.doc: r for r in booklet.booklet(spark.createDataFrame(list(enumerate(texts)), "doc int, text string").repartition(4), "2026-01-01").collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = plain(text, 2026)
        assert rows[i].matched == (want is not None)
        assert {f.field: f.normalized for f in rows[i].fields} == (want or {}), text
        assert len(rows[i].fields) == len({f.field for f in rows[i].fields})


def test_warnings_and_places_of_fields(spark):
    text = "ПАСПОРТ ГРОМАДЯНИНА УКРАЇНИ\nEA 991991\nШевченко\nПрізвище\nПо батькові 12 січня\nДата народження слово"
    r = booklet.booklet(spark.createDataFrame([(1, text)], "doc int, text string"), "2026-01-01").first()
    assert r.reason == "booklet_strong_signal_matched" and [(f.field, f.line_no) for f in r.fields][:2] == [("family_name", 2), ("passport_number", 1)]
    assert r.warnings == ["booklet_given_name_missing", "booklet_patronymic_rejected_validation", "booklet_dob_unparseable", "booklet_sex_missing", "booklet_birth_place_missing", "booklet_issued_by_missing", "booklet_date_of_issue_missing", "booklet_no_expiration_date"]
