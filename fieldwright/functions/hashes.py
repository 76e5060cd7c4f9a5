"""Hashes and keys of stored facts as column expressions; inputs that differ in order alone hash alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(value: Column) -> Column:
    """A JSON string or null."""
    return F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')), F.lit("null"))


def tuple_text(*values: Column) -> Column:
    """Strings and nulls as a JSON array."""
    return F.concat(F.lit("["), F.concat_ws(",", *map(_quoted, values)), F.lit("]"))


def set_hash(items: Column) -> Column:
    """SHA-256 of strings as a sorted JSON list; of no items that of []."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.array_sort(items), ","), F.lit("]")), 256)


def ordered_hash(items: Column) -> Column:
    """SHA-256 of strings as a JSON list in their own order."""
    return F.sha2(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), 256)


def identity_normal(text: Column) -> Column:
    """Marks that look like an apostrophe are one, white space is one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[’'`´]", "'"), r"(?U)\s+", " ")))


def identity_hash(entries: Column) -> Column:
    """SHA-256 of sorted ``field=value`` entries joined by |; blank values are to be left out before."""
    return F.sha2(F.array_join(F.array_sort(entries), "|"), 256)


def cache_key(sha: Column, parts: list[Column], request: Column | None = None) -> Column:
    """sha:part:part...[:request], each part scrubbed to letters, digits, dot, dash and underscore; null if a part is blank or a hash is malformed."""
    known = F.lower(sha)
    scrub = lambda p: F.regexp_replace(F.trim(p), "[^A-Za-z0-9._-]", "_")
    good = known.rlike("^[0-9a-f]{64}$")
    for p in parts:
        good = good & (F.trim(F.coalesce(p, F.lit(""))) != "")
    base = F.concat_ws(":", known, *map(scrub, parts))
    if request is None:
        return F.when(good, base)
    fits = request.isNull() | F.lower(request).rlike("^[0-9a-f]{64}$")
    return F.when(good & fits, F.concat_ws(":", base, F.lower(request)))


def seal(text: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce; the bytes are Spark's layout (nonce, cipher text, tag)."""
    return F.aes_encrypt(text, key, F.lit("GCM"))


def unseal(sealed: Column, key: Column) -> Column:
    """The text of a seal; null if key or bytes do not fit."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string")
