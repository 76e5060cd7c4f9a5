"""Validators of what comes from outside, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
LOCALES = ("en", "uk", "ru", "es")
SLUGS = ("re-parole-u4u", "tps-ukraine")
MIME_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/webp")
EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".webp")
STATE_BYTES = 64 * 1024
STEPS = (0, 12)
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID), F.lit(False))


def one_of(value: Column, allowed: tuple[str, ...], default: str | None = None) -> Column:
    """The value if it is allowed, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def has_extension(name: Column) -> Column:
    lower = F.lower(F.coalesce(name, F.lit("")))
    found = F.lit(False)
    for e in EXTENSIONS:
        found = found | lower.endswith(e)
    return found


def fits_state(json: Column) -> Column:
    """Whether a stored state is small enough, in bytes."""
    return F.coalesce(F.octet_length(json) <= STATE_BYTES, F.lit(False))


def is_step(value: Column) -> Column:
    """A whole number in the range of steps."""
    return F.coalesce((value == F.floor(value)) & value.between(*STEPS), F.lit(False))


def run_cost(documents: Column, each: Column) -> Column:
    """Cost of a run to six places; infinite where the inputs are no estimate."""
    bad = documents.isNull() | each.isNull() | F.isnan(documents) | F.isnan(each) | (documents < 0) | (each < 0)
    return F.when(bad, F.lit(float("inf"))).otherwise(F.round(documents * each * 1e6) / 1e6)


#: Shapes of single fields; other fields have none.
DATES = ("dob", "last_entry_date", "i94_admit_until", "passport_expiration_date", "ead_expiration_date")
SHAPES = {
    "sex": r"^[MFX]$",
    "passport_number": r"^[A-Z]{1,3}\s?[0-9]{6,9}$",
    "a_number": r"^\d{9}$",
    "us_address_zip": r"^\d{5}(?:-\d{4})?$",
    "us_address_state": r"^[A-Z]{2}$",
}
DATE_SHAPE = r"^(19|20)\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"


def strictly_valid(field: Column, value: Column) -> Column:
    """Whether a value has the shape of its field; blank never, fields without a shape always. Numbers and states are compared in capitals, A-numbers without dashes and spaces."""
    v = F.trim(F.coalesce(value, F.lit("")))
    out = F.when(v == "", False).when(field.isin(*DATES), v.rlike(DATE_SHAPE))
    for name, shape in SHAPES.items():
        read = F.upper(v) if name in ("passport_number", "us_address_state") else F.regexp_replace(v, r"[\s\-]", "") if name == "a_number" else v
        out = out.when(field == name, read.rlike(shape))
    return out.otherwise(True)
