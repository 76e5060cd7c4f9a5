"""Text functions as column expressions."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Personal-data patterns in the order in which they are replaced, with their names and placeholders.
PII = (
    ("A_NUMBER", r"\b[Aa][-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{3}\b|\b[Aa][-\s]?\d{8,9}\b", "[REDACTED_A_NUMBER]"),
    ("USCIS_RECEIPT", r"(?i)\b(?:IOE|EAC|LIN|SRC|WAC|NBC|MSC|YSC|ZSC|CSC|TSC|VSC|IOL)\d{10}\b", "[REDACTED_RECEIPT_NUMBER]"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("PHONE", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED_PHONE]"),
    ("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[REDACTED_EMAIL]"),
)
#: Signs of prompt injection; the first that fits names the text.
INJECTION = (
    (r"ignore\s+(all\s+)?(previous|prior|above|system|original)\s+instructions?", "role_override"),
    (r"forget\s+(everything|all\s+instructions?|prior|previous|your\s+instructions?)", "role_override"),
    (r"disregard\s+(all\s+)?(previous|prior|system|above)\s+instructions?", "role_override"),
    (r"from\s+now\s+on\s+(you\s+)?(will|must|should|are)\s+", "role_override"),
    (r"your\s+(new\s+)?instructions?\s+(are|is)\s+", "role_override"),
    (r"you\s+are\s+now\s+(a|an)\s+", "role_switch"),
    (r"act\s+as\s+(a|an)?\s*(different|new|evil|unrestricted|admin|system|hacker|gpt)", "role_switch"),
    (r"pretend\s+(you\s+are|to\s+be)\s+(a|an)\s+", "role_switch"),
    (r"you\s+are\s+no\s+longer\s+", "role_switch"),
    (r"roleplay\s+as\s+(a|an)\s+", "role_switch"),
    (r"print\s+(your\s+)?(system\s+prompt|instructions?|initial\s+prompt)", "extraction"),
    (r"reveal\s+(your\s+)?(system\s+prompt|instructions?|initial\s+prompt|context)", "extraction"),
    (r"show\s+(me\s+)?(your\s+)?(system\s+prompt|hidden\s+instructions?|base\s+prompt)", "extraction"),
    (r"what\s+(is|are|were)\s+your\s+(system\s+)?instructions?", "extraction"),
    (r"repeat\s+(your\s+)?(system\s+prompt|original\s+instructions?)", "extraction"),
    (r"\bDAN\b.*mode", "jailbreak"),
    (r"jailbreak", "jailbreak"),
    (r"developer\s+mode", "jailbreak"),
    (r"bypass\s+(your\s+)?(filter|restriction|safety|limit|guard)", "jailbreak"),
    (r"no\s+(restrictions?|limits?|rules?|filters?|safety)", "jailbreak"),
    (r"\[system\s*:", "format_injection"),
    (r"</?system>", "format_injection"),
    (r"###\s*system\s*:", "format_injection"),
    (r"```\s*system", "format_injection"),
    (r"\[INST\]", "format_injection"),
)

#: Keys that are dropped from stored JSON at every depth, in any case of letters.
FORBIDDEN_KEYS = (
    "source_value", "final_value", "input_raw", "output_normalized", "source_line", "raw_text", "raw", "value", "raw_value", "normalized_value", "text", "line", "line_text", "ocr_text",
    "mrz", "mrz_line", "address", "name", "full_name", "given_name", "surname", "patronymic", "dob", "date_of_birth", "document_number", "doc_number", "a_number", "passport_number",
)


def content_normal(text: Column) -> Column:
    """White space of whatever kind Unicode has collapsed and trimmed, lower case: what a content hash is made of."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", " ")))


def content_hash(text: Column) -> Column:
    return F.sha2(content_normal(text), 256)


def scrub_pii(text: Column) -> Column:
    """The text with placeholders for personal data. Numbers are looked for only where three digits stand together, mail only where an @ does."""
    numbers = F.when(text.rlike("[0-9]{3}"), reduce(lambda t, p: F.regexp_replace(t, p[1], p[2]), PII[:-1], text)).otherwise(text)
    return F.when(text.contains("@"), F.regexp_replace(numbers, PII[-1][1], PII[-1][2])).otherwise(numbers)


def has_pii(text: Column, kind: str) -> Column:
    """Whether a text has one kind of personal data."""
    pattern = {n: p for n, p, _ in PII}[kind]
    return (text.contains("@") if kind == "EMAIL" else text.rlike("[0-9]{3}")) & text.rlike(pattern)


def pii_types(text: Column) -> Column:
    """Names of the kinds of personal data in a text, in the fixed order."""
    return F.array_compact(F.array(*[F.when(has_pii(text, n), F.lit(n)) for n, _, _ in PII]))


def injection_label(text: Column) -> Column:
    """The first injection sign's label, in any case of letters; null if there is none."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for p, n in INJECTION])


def redact_value(value: Column) -> Column:
    """A stored value made safe for metadata: mail, phone, digit runs and Cyrillic are masked, long text is cut."""
    s = F.trim(value)
    digits = F.length(F.regexp_replace(s, r"[^0-9]", ""))
    return (
        F.when(s == "", "")
        .when(s.rlike(r"\S+@\S+\.\S+"), "[redacted-email]")
        .when(s.rlike(r"^\+[0-9\s\-().]{6,}$"), "[redacted-phone]")
        .when(s.rlike(r"[0-9][\s\-().]+[0-9].*[0-9]") & (digits >= 7), "[redacted-phone]")
        .when(s.rlike(r"[0-9]{4,}"), "[redacted-digits]")
        .when(s.rlike(r"[\x{0400}-\x{04FF}]"), "[redacted-text]")
        .when(F.length(s) > 64, F.concat(F.substring(s, 1, 24), F.lit("…[truncated:"), F.length(s).cast("string"), F.lit("]")))
        .otherwise(s)
    )


def latin_name(name: Column) -> Column:
    """Mixed case stays; else every run of letters gets one capital, after hyphens and apostrophes too."""
    s = F.trim(F.coalesce(name, F.lit("")))
    mixed = s.rlike(r"\p{Ll}") & s.rlike(r"\p{Lu}")
    runs = F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    titled = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")
    return F.when(mixed, s).otherwise(titled)


def name_script(name: Column) -> Column:
    """ua or ru if only letters of that alphabet alone occur, else unknown."""
    ua, ru = name.rlike("[іїєґІЇЄҐ]"), name.rlike("[ыэёъЫЭЁЪ]")
    return F.when(ua & ~ru, "ua").when(ru & ~ua, "ru").otherwise("unknown")


def plausible_name(name: Column) -> Column:
    """2 to 50 characters with a vowel, without digits, no word with a capital after a small letter."""
    return F.length(name).between(2, 50) & name.rlike("(?i)[aeiouyаеєиіїоуюяыэё]") & ~name.rlike("[0-9]") & ~name.rlike(r"\p{Ll}\p{Lu}")


#: Characters outside these may change in NFC: composition begins with the combining marks.
STABLE = r"^[\x{0000}-\x{02FF}\x{0400}-\x{0482}\x{048A}-\x{04FF}\x{2010}-\x{2027}\x{2116}]*$"


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    """Of arrays, not of an iterator of them: Spark gives each call of an iterator's function a Python process of its own in every task, and these one for all calls."""
    return texts if texts.null_count == len(texts) else pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def composed(text: Column) -> Column:
    """The text in NFC. Spark has no such function; only texts with characters that may change are sent to Python, the others go there as nulls."""
    return F.coalesce(_composed(F.when(~text.rlike(STABLE), text)), text)


def materially_different(a: Column, b: Column) -> Column:
    """Whether two readings differ, in NFC, in more than white space, light punctuation and case; an empty side never does."""
    base = lambda c: F.lower(F.regexp_replace(composed(c), "[\\s.,;:'\"`-]+", ""))
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (base(a) != base(b))


def error_rate(read: Column, truth: Column) -> Column:
    """Edit distance, in NFC, as a share of the longer string; 0 if both are empty."""
    read, truth = composed(read), composed(truth)
    longer = F.greatest(F.length(read), F.length(truth))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(read, truth) / longer)


def check_digit(field: Column) -> Column:
    """Check digit of a machine-readable field: values of 0-9, A-Z from 10, < as 0; weights 7, 3, 1; modulo 10."""
    at = F.sequence(F.lit(1), F.length(field))
    alphabet = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    worth = lambda i: F.greatest(F.position(field.substr(i, F.lit(1)), alphabet) - 1, F.lit(0)) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (F.pmod(i - 1, F.lit(3)) + 1).cast("int"))
    total = F.aggregate(F.transform(at, worth), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(field) == 0, 0).otherwise(F.pmod(total, F.lit(10))).cast("int")


@F.pandas_udf(StringType())
def redact_json(texts: pd.Series) -> pd.Series:
    """JSON without the forbidden keys at any depth; scalars stay, what is no JSON becomes null. SQL has no recursion over JSON."""

    def clean(node: object) -> object:
        if isinstance(node, dict):
            return {k: clean(v) for k, v in node.items() if k.lower() not in FORBIDDEN_KEYS}
        return [clean(v) for v in node] if isinstance(node, list) else node

    def one(said: str | None) -> str | None:
        try:
            return None if said is None else json.dumps(clean(json.loads(said)), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)
