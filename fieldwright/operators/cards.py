"""Fields and the postal address of a driver licence from the lines of its card.

An address is read from right to left: postal code, state, city, street; what is not on the code's line is looked for on the lines above. The first code
for which a state and a city or street are found counts, else the next is tried. All of it is column expressions over the array of a card's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.functions.places import let

EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Each field's pattern, whose group is the value, and the zone that it is told from.
FIELDS = (
    ("dl_number", rf"{EDGE}DL\s+([A-Z0-9]+){EDGE}", "dl_label"),
    ("family_name", rf"{EDGE}LN\s+([A-Z][A-Z'\-]+){EDGE}", "ln_label"),
    ("given_name", rf"{EDGE}FN\s+([A-Z][A-Z'\- ]+?)(?:\s{{2,}}|$)", "fn_label"),
    ("dob", rf"{EDGE}DOB\s+(\d{{2}}/\d{{2}}/\d{{4}}){EDGE}", "dob_label"),
    ("sex", rf"{EDGE}SEX\s*:?\s*([MFX]){EDGE}", "sex_label"),
    ("height", rf"{EDGE}HGT\s+(\d\s*['′]\s*[-\s]*\d{{1,2}}\s*[\"″])", "hgt_label"),
    ("weight", rf"(?i){EDGE}WGT\s+(\d{{2,3}}\s*(?:lb|kg))", "wgt_label"),
    ("eye_color", rf"{EDGE}EYES\s+([A-Z]{{3}}){EDGE}", "eyes_label"),
    ("hair_color", rf"{EDGE}HAIR\s+([A-Z]{{3}}){EDGE}", "hair_label"),
)
#: Words of addresses that stay in capitals, and words that end a street.
CAPITALS = ("APT", "PO", "NE", "NW", "SE", "SW", "N", "S", "E", "W", "USA", "US")
STREETS = "AVE|AVENUE|ST|STREET|BLVD|BOULEVARD|RD|ROAD|DR|DRIVE|LN|LANE|CT|COURT|PL|PLACE|WAY|HWY|HIGHWAY|PKWY|PARKWAY|CIR|CIRCLE|TER|TERRACE|TRL|TRAIL|SQ|SQUARE"
CODE = r"(?<!\d)(\d{5}(?:-\d{4})?)(?!\d)"
STATE = rf"(?s)^(.*){EDGE}([A-Z]{{2}}){EDGE}"
#: Lines above a postal code on which its street may stand.
ABOVE = 4


def title_case(text: Column) -> Column:
    """Each word and each part between hyphens with a capital, but for numbers and what stays in capitals."""

    def word(t: Column) -> Column:
        cased = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.regexp_extract(t, r"^.([\p{L}'’]*)", 1)), F.regexp_extract(t, r"^[\p{L}'’]+(.*)$", 1))
        return F.when(F.upper(t).isin(*CAPITALS), F.upper(t)).when(t.rlike(r"^[\p{L}'’]"), cased).otherwise(t)

    return F.array_join(F.transform(F.split(text, " "), lambda s: F.array_join(F.transform(F.split(s, "-"), word), "-")), " ")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _address(lines: Column) -> Column:
    """struct(street, city, state, zip) in title case; null if no postal code gives one."""

    def before_code(line: Column, k: Column) -> Column:
        """What stands before the k-th code (from 0): the pieces between codes up to it, with the codes."""
        pieces, codes = F.split(line, CODE), F.regexp_extract_all(line, F.lit(CODE), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(0), k), lambda i: F.concat(F.when(i > 0, F.get(codes, i - 1)).otherwise(""), F.get(pieces, i))), "")

    def parts(before: Column) -> Column:
        """struct(street, city) of what stands before the state: cut at the last comma, else behind the last word with a digit."""
        pieces = F.filter(F.transform(F.split(before, ","), trimmed), lambda p: p != "")
        n = F.size(pieces)
        by_comma = F.struct(F.array_join(F.slice(pieces, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ").alias("street"), F.coalesce(F.get(pieces, n - 1), F.lit("")).alias("city"))
        words = F.split(before, r"(?U)\s+")
        last = F.coalesce(F.array_max(F.filter(F.transform(words, lambda w, i: F.when(w.rlike(r"\d"), i + 1)), lambda i: i.isNotNull())), F.lit(0))
        by_word = F.struct(F.array_join(F.slice(words, F.lit(1), last), " ").alias("street"), F.array_join(F.slice(words, last + 1, F.size(words)), " ").alias("city"))
        none = F.struct(F.lit("").alias("street"), F.lit("").alias("city"))
        return F.when(~before.rlike("[A-Za-z]"), none).when(F.contains(before, F.lit(",")), by_comma).otherwise(by_word)

    def street_above(i: Column) -> Column:
        near = F.transform(F.sequence(F.lit(1), F.lit(ABOVE)), lambda o: trimmed(F.get(lines, i - o)))
        fits = lambda t: t.rlike(r"^\d") & (F.length(t) >= 4) & (t.rlike(rf"(?i){EDGE}(?:{STREETS}){EDGE}") | t.rlike("[A-Z][A-Z]+"))
        return F.coalesce(F.get(F.filter(near, fits), 0), F.lit(""))

    def at(line: Column, i: Column, k: Column) -> Column:
        code = F.get(F.regexp_extract_all(line, F.lit(CODE), F.lit(1)), k)

        def told(before: Column) -> Column:
            found = let(trimmed(F.regexp_replace(F.regexp_extract(before, STATE, 1), r"(?U)[,\s]+$", "")), parts)
            state = F.regexp_extract(before, STATE, 2)

            def whole(p: Column) -> Column:
                street = F.when(p["street"] != "", p["street"]).otherwise(street_above(i))
                city = F.when(p["city"] != "", p["city"]).otherwise(F.coalesce(F.regexp_extract(trimmed(F.get(lines, i - 1)), r"([A-Z][A-Z .'\-]*[A-Z])\s*$", 1), F.lit("")))
                return let(F.struct(street.alias("street"), city.alias("city")), lambda a: F.when(
                    (state != "") & ((a["street"] != "") | (a["city"] != "")),
                    F.struct(title_case(a["street"]).alias("street"), title_case(trimmed(F.regexp_replace(a["city"], ",+$", ""))).alias("city"), state.alias("state"), code.alias("zip")),
                ))

            return let(found, whole)

        return let(trimmed(before_code(line, k)), told)

    def of_line(line: Column, i: Column) -> Column:
        n = F.regexp_count(line, F.lit(CODE))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: at(line, i, k)))

    found = F.flatten(F.filter(F.transform(lines, of_line), lambda a: a.isNotNull()))
    return F.get(F.filter(found, lambda a: a.isNotNull()), 0)


def licence_cards(docs: DataFrame) -> DataFrame:
    """docs (doc, text) as rows (doc, matched, fields, warnings); fields: array of (field, raw, normalized, zone, review).

    Three fields or more make a card; others are not matched and have no fields. Names are in title case and, like the address, for review; dates of
    birth as YYYY-MM-DD. Null and empty texts are not matched.
    """
    split = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    # as rows of generators lines, values and fields are made once, whatever is asked of them later
    once = lambda *made: F.inline(F.array(F.struct(*made)))
    first = lambda pattern: F.get(F.filter(F.transform("lines", lambda t: F.regexp_extract(t, pattern, 1)), lambda v: v != ""), 0)
    rows = docs.select("doc", once(split.alias("lines"))).select("doc", once(_address(F.col("lines")).alias("address"), *[first(p).alias(name) for name, p, _ in FIELDS]))

    def field(name: str, raw: Column, normalized: Column, zone: str, review: bool) -> Column:
        return F.when(F.coalesce(raw != "", F.lit(False)), F.struct(F.lit(name).alias("field"), raw.alias("raw"), normalized.alias("normalized"), F.lit(zone).alias("zone"), F.lit(review).alias("review")))

    shown = {
        "family_name": title_case, "given_name": lambda v: title_case(trimmed(v)), "dob": lambda v: F.regexp_replace(v, r"^(\d\d)/(\d\d)/(\d{4})$", "$3-$1-$2"),
        "height": lambda v: F.translate(F.regexp_replace(v, r"(?U)\s+", ""), "′″", "'\""),
    }
    printed = [field(name, trimmed(F.col(name)) if name == "given_name" else F.col(name), shown.get(name, lambda v: v)(F.col(name)), zone, name in ("family_name", "given_name")) for name, _, zone in FIELDS]
    place = [field(f"us_address_{part}", F.col(f"address.{part}"), F.col(f"address.{part}"), f"dl_address_{part}", True) for part in ("street", "city", "state", "zip")]
    rows = rows.select("doc", "address", once(F.array_compact(F.array(*printed, *place)).alias("fields")))
    matched = F.size("fields") >= 3
    warning = F.when(F.col("address").isNull(), "address_not_detected").when((F.col("address.street") == "") | (F.col("address.city") == ""), "address_partial")
    kept = F.filter("fields", lambda f: matched)
    return rows.select("doc", matched.alias("matched"), kept.alias("fields"), F.when(~matched, F.array(F.lit("too_few_anchors"))).otherwise(F.array_compact(F.array(warning))).alias("warnings"))
