"""Dates in documents and lines for machines as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwright.functions.text import check_digit

#: Stems of month names, Ukrainian and Russian, by month.
MONTH_STEMS = (
    ("січ", "январ", "янв"), ("лют", "феврал", "фев"), ("берез", "март", "мар"), ("квіт", "апрел", "апр"), ("трав", "ма"), ("черв", "июн"),
    ("лип", "июл"), ("серп", "август", "авг"), ("вер", "сентябр", "сен"), ("жовт", "октябр", "окт"), ("листоп", "ноябр", "ноя"), ("груд", "декабр", "дек"),
)
#: Genitives of the months, Ukrainian and Russian.
MONTHS_UA = ("січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня")
MONTHS_RU = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def form_date(text: Column) -> Column:
    """MM/DD/YYYY from DD.MM.YYYY, which is not range-checked, or from day, month word and year; else null."""
    dotted = r"^(\d{1,2})\.(\d{2})\.(\d{4})$"
    numbers = {m: f"{n:02d}" for names in (MONTHS_UA, MONTHS_RU) for n, m in enumerate(names, 1)}
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+(року|года|р\.?|г\.?)\s*$", "")), r"\s+")
    month, year = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(numbers.items()))), F.get(words, 1)), F.get(words, 2)
    day = F.when(F.length(F.get(words, 0)) < 2, F.lpad(F.get(words, 0), 2, "0")).otherwise(F.get(words, 0))
    spelled = F.when(month.isNotNull() & (F.length(year) == 4), F.concat_ws("/", month, day, year))
    return F.when(text.rlike(dotted), F.concat_ws("/", F.regexp_extract(text, dotted, 2), F.lpad(F.regexp_extract(text, dotted, 1), 2, "0"), F.regexp_extract(text, dotted, 3))).otherwise(spelled)


def strict_date(text: Column) -> Column:
    """YYYY-MM-DD, or null where the text leaves open which number is the month."""
    s, iso, either = F.trim(text), r"^(\d{4})[/\-](\d{1,2})[/\-](\d{1,2})$", r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})$"
    a, b = _part(s, either, 1).cast("int"), _part(s, either, 2).cast("int")
    made = lambda y, m, d: F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    year = F.regexp_extract(s, either, 3)
    out = F.when(s.rlike(iso), made(_part(s, iso, 1), _part(s, iso, 2), _part(s, iso, 3))).when((a > 12) & (b <= 12), made(year, b, a)).when((b > 12) & (a <= 12), made(year, a, b))
    return F.when(out.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"), out)


def date_parts(text: Column) -> Column:
    """struct(day, month, year), null where not told: ISO, then numbers (DD.MM unless only the second exceeds 12), then the longest month stem."""
    s = F.trim(F.coalesce(text, F.lit("")))
    iso, numbers = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b"
    stems = F.array(*[F.struct(F.lit(len(t)).alias("n"), F.lit(-m).alias("m"), F.lit(t).alias("t")) for m, ts in enumerate(MONTH_STEMS, 1) for t in ts])
    word = -F.array_max(F.filter(stems, lambda t: F.contains(F.lower(s), t["t"])))["m"]
    n = lambda pattern, group: _part(s, pattern, group).cast("int")
    american = (n(numbers, 1) <= 12) & (n(numbers, 2) > 12)
    of = lambda d, m, y: F.struct(d.alias("day"), m.alias("month"), y.alias("year"))
    return (
        F.when(s.rlike(iso), of(n(iso, 3), n(iso, 2), n(iso, 1)))
        .when(s.rlike(numbers), of(F.when(american, n(numbers, 2)).otherwise(n(numbers, 1)), F.when(american, n(numbers, 1)).otherwise(n(numbers, 2)), n(numbers, 3)))
        .otherwise(of(n(r"\b(\d{1,2})\b", 1), word, n(r"\b(1[89]\d{2}|20\d{2})\b", 1)))
    )


def backoff_ms(attempt: Column, jitter: Column, base: float, most: float, retry_after: Column) -> Column:
    """Wait before a new attempt: doubled each time, up to a quarter more by jitter (0 to 1), capped; what the other side asks for goes first."""
    return F.coalesce(retry_after, F.least(base * F.pow(F.lit(2.0), attempt - 1) * (1 + 0.25 * jitter), F.lit(most)))


def _at(line: Column, start: int, length: int) -> Column:
    return F.substring(line, start + 1, length)


def _text(part: Column) -> Column:
    return F.nullif(F.trim(F.replace(part, F.lit("<"), F.lit(""))), F.lit(""))


def _date(part: Column, pivot: int) -> Column:
    """YYMMDD as a date text, years up to the pivot in this century; null if month or day is out of range."""
    y, m, d = _at(part, 0, 2), _at(part, 2, 2), _at(part, 4, 2)
    good = part.rlike(r"^\d{6}$") & m.between("01", "12") & d.between("01", "31")
    return F.when(good, F.concat_ws("-", F.concat(F.when(y.cast("int") <= pivot, "20").otherwise("19"), y), m, d))


def _names(part: Column) -> tuple[Column, Column]:
    halves = F.split(part, "<<", 2)
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, "<+", " ")), F.lit(""))
    return tidy(F.get(halves, 0)), tidy(F.get(halves, 1))


def _holds(field: Column, digit: Column) -> Column:
    """Whether the check digit fits; a filler passes only for an empty field."""
    return F.when(digit.rlike("^[0-9]$"), check_digit(field) == digit.cast("int")).otherwise((digit == "<") & field.rlike("^<*$"))


def _sex(letter: Column) -> Column:
    return F.when(letter.isin("M", "F"), letter).otherwise("Unspecified")


def mrz_td3(one: Column, two: Column, icao: bool = False) -> Column:
    """Fields of a passport's two lines of 44 and checks_ok; null for other lengths.

    The composite digit runs over the whole line before it, or with ``icao`` over the parts that the standard names.
    """
    parts = F.concat(_at(two, 0, 10), _at(two, 13, 7), _at(two, 21, 22)) if icao else _at(two, 0, 43)
    surname, given = _names(_at(one, 5, 39))
    checks = [_holds(_at(two, 0, 9), _at(two, 9, 1)), _holds(_at(two, 13, 6), _at(two, 19, 1)), _holds(_at(two, 21, 6), _at(two, 27, 1)), _holds(_at(two, 28, 14), _at(two, 42, 1)),
              _holds(parts, _at(two, 43, 1))]
    return F.when((F.length(one) == 44) & (F.length(two) == 44), F.struct(
        _text(_at(one, 0, 2)).alias("document_type"), _text(_at(one, 2, 3)).alias("issuing_state"), _text(_at(two, 0, 9)).alias("document_number"), _text(_at(two, 10, 3)).alias("nationality"),
        surname.alias("surname"), given.alias("given_names"), _date(_at(two, 13, 6), 30).alias("date_of_birth"), _sex(_at(two, 20, 1)).alias("sex"), _date(_at(two, 21, 6), 70).alias("date_of_expiry"),
        _text(_at(two, 28, 14)).alias("personal_number"), F.forall(F.array(*checks), lambda ok: ok).alias("checks_ok"),
    ))


def mrz_td1(one: Column, two: Column, three: Column, icao: bool = False) -> Column:
    """Fields of a card's three lines of 30 and checks_ok; null for other lengths. The composite is as with ``mrz_td3``."""
    parts = F.concat(_at(one, 5, 25), _at(two, 0, 7), _at(two, 8, 7), _at(two, 18, 11)) if icao else F.concat(one, _at(two, 0, 29))
    surname, given = _names(three)
    checks = [_holds(_at(one, 5, 9), _at(one, 14, 1)), _holds(_at(two, 0, 6), _at(two, 6, 1)), _holds(_at(two, 8, 6), _at(two, 14, 1)), _holds(parts, _at(two, 29, 1))]
    return F.when((F.length(one) == 30) & (F.length(two) == 30) & (F.length(three) == 30), F.struct(
        _text(_at(one, 0, 2)).alias("document_type"), _text(_at(one, 2, 3)).alias("issuing_state"), _text(_at(one, 5, 9)).alias("document_number"), _text(_at(one, 15, 15)).alias("record_number"),
        _text(_at(two, 15, 3)).alias("nationality"), surname.alias("surname"), given.alias("given_names"), _date(_at(two, 0, 6), 30).alias("date_of_birth"), _sex(_at(two, 7, 1)).alias("sex"),
        _date(_at(two, 8, 6), 70).alias("date_of_expiry"), _text(_at(two, 18, 11)).alias("personal_number"), F.forall(F.array(*checks), lambda ok: ok).alias("checks_ok"),
    ))


#: English names of the months.
MONTHS_EN = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def certificate_date(text: Column) -> Column:
    """struct(value, review, reason): a certificate's date as day, English month and year; Russian months and what cannot be read are for review."""
    t = F.trim(text)
    made = F.split(form_date(t), "/")
    month = F.get(F.array(*map(F.lit, MONTHS_EN)), F.get(made, 0).try_cast("int") - 1)
    value = F.when(month.isNotNull(), F.concat_ws(" ", F.get(made, 1).try_cast("int").cast("string"), month, F.get(made, 2)))
    russian = F.exists(F.array(*map(F.lit, MONTHS_RU)), lambda m: F.contains(F.lower(t), m))
    cut = t.rlike(r"[\x{0400}-\x{04FF}]") & ~t.rlike(r"\d{4}")
    reason = F.when(value.isNotNull(), F.when(russian, "russian_month_fallback")).when(cut, "partial_date_unreadable").otherwise("date_format_unrecognized")
    return F.struct(value.alias("value"), reason.isNotNull().alias("review"), reason.alias("reason"))
