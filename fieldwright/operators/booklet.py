"""Fields of a handwritten passport booklet from the lines of its pages.

A value stands after its label, on one of the two lines above, or on one of the three below, in this order; what a line is worth depends on
the label it is near. Lines are one array within a document's row, so nothing is shuffled, and what is known of a line is made once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.functions.dates import MONTHS_RU, MONTHS_UA
from fieldwright.functions.places import let, looked_up

#: Latin letters and the Cyrillic ones that look like them.
LOOKALIKES = ("ABCEHIKMOPTXYaceiopxy", "АВСЕНІКМОРТХУасеіорху")
#: Signs that a text is a booklet; the first two are strong.
STRONG_SIGNS = ("паспорт громадянина україни", "паспорт гражданина украины")
WEAK_SIGNS = ("прізвище", "призвище", "фамилия", "ім'я", "імя", "имя", "дата народження", "дата рождения", "підпис власника", "подпись владельца")
#: What a label's line holds, without spaces.
LABEL_HINTS = (
    "прізвище", "призвище", "фамилия", "ім'я", "імя", "имя", "побатькові", "отчество", "датанародження", "датарождения", "місценародження", "местарождения", "местарожд",
    "паспортгромадянинаукраїни", "паспортгражданинаукраины", "підписвласникапаспорта",
)
#: Labels of each field in the order in which they are tried.
LABELS = {
    "family_name": ("Прізвище", "Призвище", "Фамилия"),
    "given_name": ("Ім'я", "Імʼя", "Ім’я", "Ім`я", "Ім я", "Імя", "Имя"),
    "middle_name": ("По батькові", "Побатькові", "Отчество"),
    "dob": ("Дата народження", "Дата рождения", "Датарождения"),
    "sex": ("Стать", "Пол", "Sex"),
    "number": ("Серія", "Серия", "Series", "Номер", "Number", "Серія/Номер", "Серия/Номер", "Series/Number"),
    "issued_by": ("Орган, що видав", "Органщовидав", "Орган що видав", "Орган выдавший", "Орган,выдавший", "Authority", "Issued by"),
    "passport_date_of_issue": ("Дата видачі", "Датавидачі", "Дата видачи", "Дата выдачи", "Date of issue", "Date issued"),
}
PLACE_LABELS = ("Місце народження", "Место рождения", "Place of birth")
#: First three letters of months.
SHORT_MONTHS = {
    "січ": "01", "лют": "02", "бер": "03", "кві": "04", "тра": "05", "чер": "06", "лип": "07", "сер": "08", "вер": "09", "жов": "10", "лис": "11", "гру": "12",
    "янв": "01", "фев": "02", "мар": "03", "апр": "04", "май": "05", "июн": "06", "июл": "07", "авг": "08", "сен": "09", "окт": "10", "ноя": "11", "дек": "12",
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}
#: Letters of a sex.
SEXES = {"M": "M", "MALE": "M", "Ч": "M", "ЧОЛ": "M", "ЧОЛОВ": "M", "МУЖ": "M", "МУЖСК": "M", "F": "F", "FEM": "F", "FEMAL": "F", "Ж": "F", "ЖІН": "F", "ЖІНОЧ": "F", "ЖЕН": "F", "ЖЕНСК": "F", "X": "X"}
#: What is cut off a value: leading marks, English labels, English before, after a slash, and after a Cyrillic value.
CYRILLIC = "А-ЯІЇЄҐа-яіїєґ"
NOISE = (
    (r"(?U)^[:\-—_/\s.]+", ""),
    (r"(?i)^(?:date\s+of\s+(?:birth|issue|expiry|expir(?:y|ation)|issuance)|place\s+of\s+(?:birth|issue|issuance)|surname|given\s+names?|nationality|sex|authority)(?![A-Za-z0-9_])[:\s.\-—/]*", ""),
    (rf"^[A-Za-z][A-Za-z .'\-]{{0,40}}(?=\s+[{CYRILLIC}])", ""),
    (r"\s*[/\-—]\s*[A-Za-z][A-Za-z .'\-]{0,40}$", ""),
    (rf"([{CYRILLIC}][{CYRILLIC}\-' ]+?)\s+[A-Za-z][A-Za-z .'\-]{{0,40}}$", "$1"),
    (r"(?U)\s+", " "),
)
#: Two letters and six digits; a word begins and ends where an ASCII letter or digit does.
NUMBER_LETTERS = "А-ЯІЇЄҐABCEHIKMOPTX"
NUMBER = rf"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))([{NUMBER_LETTERS}]{{2}})\s*((?:[0-9]\s*){{6}})(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
OBLAST = rf"(?iu)[A-Za-z0-9_{CYRILLIC}']+(?:ської|зької|цької|ського)\s+(?:обл(?:асті)?\.?)"
#: Months that tell that a city is a date, and that a patronymic is one.
CITY_MONTHS = r"(?iu)січня|червня|серпня|жовтня|января|июня|августа"
DATE_WORDS = "(?iu)" + "|".join((*MONTHS_UA, *MONTHS_RU))


def letters(text: Column) -> Column:
    """The Cyrillic capitals of a text; Latin capitals that look like one count as it."""
    return F.regexp_replace(F.translate(F.upper(text), *LOOKALIKES), "[^А-ЯІЇЄҐ]", "")


def label_letters(label: str) -> str:
    return re.sub("[^А-ЯІЇЄҐ]", "", label.upper().translate(str.maketrans(*LOOKALIKES)))


def clean(text: Column) -> Column:
    out = F.trim(text)
    for pattern, by in NOISE:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def all_lookalikes(text: Column) -> Column:
    return text.rlike(rf"(?U)^[\s\-'’ʼ`{LOOKALIKES[0]}]*$") & text.rlike("[A-Za-z]")


def junk(text: Column) -> Column:
    """Whether a cleaned value is none: one letter, or Latin that is no misread Cyrillic."""
    return (F.length(text) < 2) | ~(text.rlike(rf"[{CYRILLIC}0-9]") | all_lookalikes(text))


def title(text: Column) -> Column:
    return F.trim(F.initcap(F.lower(F.when(all_lookalikes(text), F.translate(text, *LOOKALIKES)).otherwise(text))))


def booklet_date(text: Column) -> Column:
    """YYYY-MM-DD of a date with a month in words, in digits, or as three letters in two languages; null if there is none."""

    def told(day: Column, month: Column, year: Column) -> Column:
        def whole(p: Column) -> Column:
            y = F.when(p["y"] < 100, F.when(p["y"] > 30, p["y"] + 1900).otherwise(p["y"] + 2000)).otherwise(p["y"])
            return F.when(p["m"].between(1, 12) & p["d"].between(1, 31) & y.between(1900, 2100), F.format_string("%d-%02d-%02d", y, p["m"], p["d"]))

        return let(F.struct(day.try_cast("int").alias("d"), month.try_cast("int").alias("m"), year.try_cast("int").alias("y")), whole)

    def parsed(s: Column) -> Column:
        worded = r"(\d{1,2})\s+([а-яії]+)\s+(\d{2,4})"
        months = {w: f"{i % 12 + 1:02d}" for i, w in enumerate((*MONTHS_UA, *MONTHS_RU))}
        word = F.regexp_extract(s, worded, 2)
        month = let(word, lambda w: F.coalesce(looked_up(months, w), looked_up(SHORT_MONTHS, F.substring(w, 1, 3))))
        one = told(F.regexp_extract(s, worded, 1), month, F.regexp_extract(s, worded, 3))
        digits = r"(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{2,4})"
        two = told(*[F.regexp_extract(s, digits, i) for i in (1, 2, 3)])
        mixed = r"(\d{1,2})(?![A-Za-z0-9_])([^0-9]+)(?<![A-Za-z0-9_])(\d{2,4})(?![A-Za-z0-9_])"
        tokens = F.filter(F.split(F.regexp_extract(s, mixed, 2), r"(?U)[\s/\\.,\-—_:;]+"), lambda t: t != "")
        restored = lambda t: F.when(F.upper(t).rlike("^[ABCEHIKMOPTXYА-ЯІЇЄҐ]+$"), F.lower(F.translate(F.upper(t), *LOOKALIKES)))
        found = F.transform(tokens, lambda t: let(F.substring(t, 1, 3), lambda h: F.coalesce(looked_up(SHORT_MONTHS, h), looked_up(SHORT_MONTHS, restored(h)))))
        three = told(F.regexp_extract(s, mixed, 1), F.get(F.filter(found, lambda m: m.isNotNull()), 0), F.regexp_extract(s, mixed, 3))
        # all three hold a digit
        return F.when(s.rlike("[0-9]"), F.coalesce(one, two, three))

    return let(F.lower(F.trim(text)), parsed)


def _lines(text: Column) -> Column:
    """What is known of each line: t, the text; c, cleaned; ok, it may be a value; l and w, the letters of the line and of its words; label, it holds one."""
    hints = "|".join(h.replace("'", "\\'") for h in LABEL_HINTS)

    def known(t: Column) -> Column:
        label = F.lower(F.regexp_replace(t, r"(?U)\s+", "")).rlike(hints)
        return let(clean(t), lambda c: F.struct(t.alias("t"), c.alias("c"), ((F.length(t) >= 2) & ~label & ~junk(c)).alias("ok"), letters(t).alias("l"), F.transform(F.split(t, r"(?U)\s+"), letters).alias("w"), label.alias("label")))

    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), known)


def _fits(line: Column, label: Column) -> Column:
    """A short label of one word begins a word that is at most three letters longer; another stands anywhere in the line's letters."""
    short = F.exists(line["w"], lambda c: F.startswith(c, label["key"]) & (F.length(c) <= F.length(label["key"]) + 3))
    return (F.length(label["key"]) > 0) & F.when(label["short"], short).otherwise(F.contains(line["l"], label["key"]))


def _label(text: str) -> Column:
    key = label_letters(text)
    return F.struct(F.lit(text).alias("text"), F.lit(key).alias("key"), F.lit("/" not in text and " " not in text and len(key) <= 6).alias("short"))


def _near(lines: Column, line: Column, i: Column, label: Column) -> Column:
    """struct(value, line_no) of the value nearest to a label's line."""
    at = F.position(F.lower(label["text"]), F.lower(line["t"]))
    tail = F.when(at > 0, F.regexp_replace(F.substring(line["t"], at + F.length(label["text"]), F.length(line["t"])), r"(?U)^\s+|\s+$", ""))
    usable = (F.length(tail) >= 2) & ~tail.rlike(r"^[:\-—_.]+$")
    inline = let(F.when(usable, clean(tail)), lambda c: F.when(~junk(c), F.struct(c.alias("value"), i.alias("line_no"))))
    others = [F.when(F.get(lines, i + o)["ok"], F.struct(F.get(lines, i + o)["c"].alias("value"), (i + o).alias("line_no"))) for o in (-1, -2, 1, 2, 3)]
    return F.coalesce(inline, *others)


def _field(lines: Column, labels: tuple[str, ...]) -> Column:
    """The first value by label, then by line."""
    hits = lambda label: F.get(F.filter(F.transform(lines, lambda x, i: F.when(_fits(x, label), _near(lines, x, i, label))), lambda h: h.isNotNull()), 0)
    return F.get(F.filter(F.transform(F.array(*map(_label, labels)), hits), lambda h: h.isNotNull()), 0)


def _birth_place(lines: Column) -> Column:
    """struct(city, oblast, line_no) from two lines above to four below the label; null without a label."""
    named = F.array(*map(_label, PLACE_LABELS))
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(F.exists(named, lambda p: _fits(x, p)), i)), lambda i: i.isNotNull()), 0)

    def parts(i: Column) -> Column:
        def part(o: Column) -> Column:
            x = F.get(lines, i + o)
            # the label's own line counts from behind the label
            ends = [F.when(F.locate(w, F.lower(x["t"])) > 0, F.locate(w, F.lower(x["t"])) + len(w)) for w in ("народження", "рождения", "birth")]
            said = F.when(o == 0, clean(F.substring(x["t"], F.coalesce(*ends, F.lit(1)), F.length(x["t"])))).otherwise(x["c"])
            return let(F.when((F.length(x["t"]) >= 2) & ~x["label"], said), lambda c: F.when(~junk(c), c))

        return F.filter(F.transform(F.sequence(F.lit(-2), F.lit(4)), part), lambda c: c.isNotNull())

    def split(i: Column) -> Column:
        def found(p: Column) -> Column:
            whole = F.array_join(p, " ")
            oblast = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(p, lambda c: c.rlike(OBLAST))), -1)
            city = F.get(F.filter(p, lambda c: ~c.rlike(OBLAST)), 0)
            both = rf"(?iu)(.*?)\s*({OBLAST[5:]})"
            in_one = oblast.isNull() | city.isNull()
            group = lambda n: F.when(in_one, F.nullif(F.trim(F.regexp_extract(whole, both, n)), F.lit("")))
            return let(F.struct(F.coalesce(city, group(1)).alias("c"), F.coalesce(oblast, group(2)).alias("o"), whole.alias("w")), lambda f: F.struct(
                F.when(f["c"].isNull() & f["o"].isNull() & (F.length(f["w"]) >= 2), f["w"]).otherwise(f["c"]).alias("city"), f["o"].alias("oblast"), i.alias("line_no")
            ))

        return let(parts(i), found)

    return let(at, lambda i: F.when(i.isNotNull(), split(i)))


def booklet(docs: DataFrame, today: str) -> DataFrame:
    """docs (doc, text) as rows (doc, matched, reason, fields, warnings); fields: array of (field, raw, normalized, zone, line_no), all for review.

    A text without any sign of a booklet is not matched. Names in title case, dates as YYYY-MM-DD; a birth date without a label is taken if just one line has
    a date of a person of ten years or more. What is read but not plausible is a warning, no field. Null and empty texts are not matched.
    """
    lowered = F.lower(F.coalesce("text", F.lit("")))
    some = lambda signs: F.exists(F.array(*map(F.lit, signs)), lambda s: F.contains(lowered, s))
    # as rows of generators lines, what is found in them and the fields are made once, whatever is asked of them later
    once = lambda *made: F.inline(F.array(F.struct(*made)))
    rows = docs.select("doc", some(STRONG_SIGNS).alias("strong"), some(WEAK_SIGNS).alias("weak"), once(_lines(F.col("text")).alias("lines")))
    L = F.col("lines")
    found = F.struct(*[_field(L, labels).alias(name) for name, labels in LABELS.items()], _birth_place(L).alias("place"))
    numbers = F.filter(F.transform(L, lambda x, i: F.when(x["t"].rlike(NUMBER), F.struct(F.upper(F.concat(F.regexp_extract(x["t"], NUMBER, 1), F.lit(" "), F.regexp_extract(x["t"], NUMBER, 2))).alias("value"), i.alias("line_no")))), lambda h: h.isNotNull())
    born = F.transform(F.filter(F.transform(L, lambda x, i: F.struct(x["t"].alias("t"), booklet_date(x["c"]).alias("iso"), i.alias("line_no"), x["label"].alias("label"))), lambda d: ~d["label"] & d["iso"].isNotNull()), lambda d: d)
    year = int(today[:4])
    born = F.filter(born, lambda d: F.substring(d["iso"], 1, 4).cast("int").between(1920, year - 10))
    rows = rows.where("strong or weak").select("doc", "strong", once(found.alias("f"), F.get(numbers, 0).alias("printed"), born.alias("born")))
    # a document without signs keeps a row
    f = lambda name: F.col(f"f.{name}")
    value = lambda name: F.col(f"f.{name}.value")

    def field(name: str, raw: Column, normalized: Column, zone: str, line: Column, on: Column) -> Column:
        return F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(name).alias("field"), raw.alias("raw"), normalized.alias("normalized"), F.lit(zone).alias("zone"), line.cast("int").alias("line_no")))

    rows = rows.select("*", once(booklet_date(value("dob")).alias("dob"), booklet_date(value("passport_date_of_issue")).alias("issued"), clean(value("issued_by")).alias("office")))
    m = F.trim(value("middle_name"))
    plausible = ~m.rlike("[0-9]") & F.length(m).between(2, 40) & ~m.rlike(DATE_WORDS)
    dob, issued, office = F.col("dob"), F.col("issued"), F.col("office")
    only = F.when(F.size("born") == 1, F.get("born", 0))
    compact = F.regexp_replace(F.upper(value("number")), r"(?U)\s+", "")
    labelled = F.when(compact.rlike(rf"^[{NUMBER_LETTERS}]{{2}}[0-9]{{6}}$"), F.concat(F.substring(compact, 1, 2), F.lit(" "), F.substring(compact, 3, 6)))
    number, number_line = F.coalesce(F.col("printed.value"), labelled), F.when(F.col("printed").isNotNull(), F.col("printed.line_no")).otherwise(F.col("f.number.line_no"))
    sex = looked_up(SEXES, F.substring(F.regexp_replace(F.upper(F.trim(value("sex"))), "[^A-ZА-ЯІЇЄҐ]", ""), 1, 5))
    city, oblast = F.col("f.place.city"), F.col("f.place.oblast")
    city_ok, oblast_ok = F.length(city).between(2, 60) & ~city.rlike("[0-9]{4}") & ~city.rlike(CITY_MONTHS), F.length(oblast) >= 4
    office_ok = F.length(office).between(4, 200)
    ukraine = F.lit("Ukraine")
    line = lambda name: F.col(f"f.{name}.line_no")
    fields = [
        field("family_name", value("family_name"), title(value("family_name")), "booklet_label_surname", line("family_name"), f("family_name").isNotNull()),
        field("given_name", value("given_name"), title(value("given_name")), "booklet_label_given_name", line("given_name"), f("given_name").isNotNull()),
        field("middle_name", value("middle_name"), title(value("middle_name")), "booklet_label_patronymic", line("middle_name"), plausible),
        field("dob", value("dob"), dob, "booklet_label_dob", line("dob"), dob.isNotNull()),
        field("dob", only["t"], only["iso"], "booklet_date_scan_fallback", only["line_no"], f("dob").isNull() & only.isNotNull()),
        field("passport_number", number, number, "booklet_series_number", number_line, number.isNotNull()),
        field("sex", value("sex"), sex, "booklet_label_sex", line("sex"), sex.isNotNull()),
        field("city_of_birth", city, city, "booklet_label_birthplace_city", F.col("f.place.line_no"), city_ok),
        field("province_of_birth", oblast, oblast, "booklet_label_birthplace_oblast", F.col("f.place.line_no"), oblast_ok),
        field("issued_by", office, office, "booklet_label_issued_by", line("issued_by"), office_ok),
        field("passport_date_of_issue", value("passport_date_of_issue"), issued, "booklet_label_date_of_issue", line("passport_date_of_issue"), issued.isNotNull()),
        *[field(name, ukraine, ukraine, zone, F.lit(None), F.lit(True)) for name, zone in (
            ("country_of_nationality", "booklet_inferred_nationality"), ("country_of_birth", "booklet_inferred_birth_country"), ("passport_country_of_issuance", "booklet_inferred_issuing_country"),
        )],
    ]
    missing = lambda name, warning: F.when(f(name).isNull(), F.lit(warning))
    unlike = lambda name, bad, warning: F.when(f(name).isNotNull() & F.coalesce(bad, F.lit(True)), F.lit(warning))
    warnings = [
        missing("family_name", "booklet_surname_missing"), missing("given_name", "booklet_given_name_missing"), unlike("middle_name", ~plausible, "booklet_patronymic_rejected_validation"),
        unlike("dob", dob.isNull(), "booklet_dob_unparseable"), F.when(f("dob").isNull(), F.when(only.isNotNull(), "booklet_dob_label_missing_used_date_scan").otherwise("booklet_dob_missing")),
        F.when(number.isNull(), F.lit("booklet_passport_number_missing")), missing("sex", "booklet_sex_missing"), unlike("sex", sex.isNull(), "booklet_sex_unrecognized"),
        missing("place", "booklet_birth_place_missing"), F.when(f("place").isNotNull() & ~F.coalesce(city_ok, F.lit(False)) & ~F.coalesce(oblast_ok, F.lit(False)), F.lit("booklet_birth_place_unparseable")),
        missing("issued_by", "booklet_issued_by_missing"), unlike("issued_by", ~office_ok, "booklet_issued_by_rejected_length"),
        missing("passport_date_of_issue", "booklet_date_of_issue_missing"), unlike("passport_date_of_issue", issued.isNull(), "booklet_date_of_issue_unparseable"), F.lit("booklet_no_expiration_date"),
    ]
    read = rows.select("doc", F.lit(True).alias("matched"), F.when(F.col("strong"), "booklet_strong_signal_matched").otherwise("booklet_weak_signal_matched").alias("reason"), once(F.array_compact(F.array(*fields)).alias("fields"), F.array_compact(F.array(*warnings)).alias("warnings")))
    none = docs.where(~some(STRONG_SIGNS) & ~some(WEAK_SIGNS)).select("doc", F.lit(False).alias("matched"), F.lit("booklet_signals_missing").alias("reason"), F.filter(F.array(fields[-1]), lambda x: F.lit(False)).alias("fields"), F.array().cast("array<string>").alias("warnings"))
    return read.unionByName(none)


def booklet_fields(docs: DataFrame, today: str) -> DataFrame:
    """Rows (doc, field, raw, normalized, zone, line_no) of the documents that are booklets."""
    return booklet(docs, today).select("doc", F.inline("fields"))
