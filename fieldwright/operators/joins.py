"""Comparisons and lookups between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of ``value`` by keys: left_only, right_only, agree or disagree."""
    both = left.withColumn("l", F.lit(1)).withColumnRenamed("value", "left_value").join(right.withColumn("r", F.lit(1)).withColumnRenamed("value", "right_value"), keys, "full_outer")
    verdict = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(F.col("left_value").eqNullSafe(F.col("right_value")), "agree").otherwise("disagree")
    return both.select(*keys, "left_value", "right_value", verdict.alias("verdict"))


def missing_required(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows without a present one."""
    return required.join(present, keys, "left_anti")


def contract_verdicts(fields: DataFrame, contract: DataFrame) -> DataFrame:
    """Fields (slot, field) against a contract (slot, field, rule): unknown_slot, forbidden, not_allowed or ok, tested in this order."""
    slots = contract.select("slot").distinct().withColumn("known", F.lit(True))
    rows = fields.join(slots, "slot", "left").join(contract, ["slot", "field"], "left")
    verdict = F.when(F.col("known").isNull(), "unknown_slot").when(F.col("rule") == "forbidden", "forbidden").when(F.col("rule").isNull(), "not_allowed").otherwise("ok")
    return rows.withColumn("verdict", verdict).drop("known", "rule")


def era_lookup(lookups: DataFrame, registry: DataFrame) -> DataFrame:
    """Exact terms valid at a date, ends included, open ends unbounded; an unknown date fits any era.

    lookups (lookup_id, term, at); registry (term, official, valid_from, valid_until, ordinal). One row per
    lookup row: the first fitting entry by registry order, else the first entry of the term with status
    era_mismatch, else unmatched. Lookups are asked once for each term and date, so repeated ones meet the registry once.
    """
    asked = lookups.select("term", "at").distinct()
    rows = asked.join(registry, "term")
    fits = F.col("at").isNull() | ((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("at"))) & (F.col("valid_until").isNull() | (F.col("at") <= F.col("valid_until"))))
    best = rows.groupBy("term", "at").agg(F.min_by(F.struct("official", fits.alias("fits")), F.struct((~fits).alias("a"), "ordinal")).alias("b"))
    found = best.select(F.col("term").alias("_t"), F.col("at").alias("_at"), "b")
    out = lookups.join(found, (F.col("term") == F.col("_t")) & F.col("at").eqNullSafe(F.col("_at")), "left")
    status = F.when(F.col("b").isNull(), "unmatched").when(F.col("b.fits"), "matched").otherwise("era_mismatch")
    return out.select("lookup_id", F.col("b.official").alias("official"), status.alias("status"))


def fallback_lookup(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical names by alias as it stands, with underscores for spaces, or with spaces for underscores; the first hit counts.

    One row for each row of the input, repeated ones too; of several entries of an alias the least canonical name counts.
    """
    name = F.col("name")
    known = aliases.groupBy("alias").agg(F.min("canonical").alias("c"))
    out = rows
    for place, spelled in enumerate((name, F.replace(name, F.lit(" "), F.lit("_")), F.replace(name, F.lit("_"), F.lit(" ")))):
        out = out.join(known.toDF(f"_a{place}", f"_c{place}"), spelled == F.col(f"_a{place}"), "left")
    return out.select(*rows.columns, F.coalesce("_c0", "_c1", "_c2").alias("canonical"))


def longest_prefix(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """For each (id, phrase) the term that equals most of its leading words."""
    words = F.split("phrase", " ")
    heads = rows.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.lit(1), n), " ").alias("term")))).alias("h")).select("id", "h.n", "h.term")
    return heads.join(terms, "term").groupBy("id").agg(F.max_by("term", "n").alias("term"), F.max("n").alias("n_words"))


def within_edits(names: DataFrame, entries: DataFrame, most: int = 2) -> DataFrame:
    """Pairs (name, entry, distance) of different strings within so many edits.

    Strings are compared that share a deletion variant: two strings within d edits have a common string after up
    to d deletions each, so none is lost and no all-pairs comparison is made. Only distinct names make variants.
    """

    def variants(df: DataFrame, col: str) -> DataFrame:
        out = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("v", F.array(F.col(col)))
        shorter = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
        for _ in range(most):
            out = out.withColumn("v", F.array_distinct(F.flatten(F.transform("v", lambda s: F.concat(F.array(s), shorter(s))))))
        return out.withColumn("v", F.explode("v"))

    pairs = variants(names, "name").join(variants(entries, "entry"), "v").where(F.abs(F.length("name") - F.length("entry")) <= most).select("name", "entry").distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "entry", most)).where("distance >= 0")


def nearest_names(names: DataFrame, gazetteer: DataFrame, most: int = 2, ratio: float = 0.34) -> DataFrame:
    """For each (id, name) the nearest gazetteer entry within ``most`` edits and ``ratio`` of the longer; a suggestion, never a replacement."""
    near = within_edits(names, gazetteer, most).where(F.col("distance") <= ratio * F.greatest(F.length("name"), F.length("entry")))
    best = near.groupBy("name").agg(F.min(F.struct("distance", "entry")).alias("b"))
    return names.join(best, "name").select("id", F.col("name").alias("read"), "b.entry", "b.distance")


def nearest_places(names: DataFrame, gazetteer: DataFrame, most: float = 2.0, ratio: float = 0.34) -> DataFrame:
    """For each (id, name): exact, a suggestion at the least weighted distance, or unknown.

    Letters that are taken for each other cost 0.4 (``places.confusion_distance``). With such letters made one, strings within the
    cap are within as many plain edits, so candidates are found by deletion variants of those.
    """
    from fieldwright.functions.places import confusion_distance, folded

    lower = lambda c: F.lower(F.trim(c))
    asked, known = names.select(lower(F.col("name")).alias("name")).distinct(), gazetteer.select(lower(F.col("entry")).alias("entry"), F.col("entry").alias("official")).groupBy("entry").agg(F.min("official").alias("official"))
    fa, fk = asked.withColumn("f", folded(F.col("name"))), known.withColumn("f", folded(F.col("entry")))
    near = within_edits(fa.select(F.col("f").alias("name")), fk.select(F.col("f").alias("entry")), int(most))
    pairs = near.toDF("f", "g", "d").join(fa, "f").join(fk.withColumnRenamed("f", "g"), "g").select("name", "entry", "official")
    scored = pairs.withColumn("distance", confusion_distance("name", "entry")).where((F.col("distance") <= most) & (F.col("distance") <= ratio * F.greatest(F.length("name"), F.length("entry"))))
    best = scored.groupBy("name").agg(F.min(F.struct("distance", "entry", "official")).alias("b"))
    out = names.join(best.withColumnRenamed("name", "_n"), lower(F.col("name")) == F.col("_n"), "left")
    reason = F.when(lower(F.col("name")) == "", "empty").when(F.col("b.distance") == 0, "exact").when(F.col("b").isNotNull(), "fuzzy_geography_match").otherwise("unknown_geography")
    return out.select("id", "name", reason.alias("reason"), F.when(F.col("b.distance") > 0, F.col("b.official")).alias("suggested"), F.round("b.distance", 6).alias("distance"))


def registry_lookup(lookups: DataFrame, registry: DataFrame) -> DataFrame:
    """Lookups (lookup_id, category, term, at) in a registry by any of its spellings, with confidence and review.

    registry: category, key_uk, key_ru, aliases, official_en, valid_from, valid_until, confidence_rule, review_rule, ordinal. An exact spelling
    counts if its era fits, an era that does not fit is for review; what no spelling meets is unmatched and for review too.
    """
    # of a spelling's rows of one era only the first can be told, so each lookup meets a row an era
    first = F.min_by(F.struct("official_en", "confidence_rule", "review_rule"), "ordinal")
    rows = registry.withColumn("key", F.explode(spellings())).groupBy("category", "key", "valid_from", "valid_until").agg(F.min("ordinal").alias("ordinal"), first.alias("row")).select("category", "key", "valid_from", "valid_until", "ordinal", "row.*")
    wanted = F.trim(F.regexp_replace(F.lower("term"), r"(?U)\s+", " "))
    fits = F.col("at").isNull() | ((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("at"))) & (F.col("valid_until").isNull() | (F.col("at") <= F.col("valid_until"))))
    asked = lookups.select("category", wanted.alias("key"), "at").distinct()
    best = asked.join(rows, ["category", "key"]).groupBy("category", "key", "at").agg(F.min_by(F.struct("official_en", "confidence_rule", "review_rule", fits.alias("fits")), F.struct(~fits, "ordinal")).alias("b"))
    found = best.select(F.col("category").alias("_c"), F.col("key").alias("_k"), F.col("at").alias("_at"), "b")
    out = lookups.join(found, (F.col("category") == F.col("_c")) & (wanted == F.col("_k")) & F.col("at").eqNullSafe(F.col("_at")), "left")
    forced = F.col("b.review_rule").isin("always_review", "historical_lock", "keep_type")
    confidence = F.when(F.col("b").isNull(), 0.0).when(F.col("b.confidence_rule") == "high", 0.95).when(F.col("b.confidence_rule") == "low", 0.5).otherwise(0.75)
    return out.select("lookup_id", F.col("b.official_en").alias("official"), confidence.alias("confidence"), (F.col("b").isNull() | ~F.col("b.fits") | F.coalesce(forced, F.lit(False))).alias("review"), F.col("b").isNotNull().alias("matched"))


def reviewed_differs(seen: DataFrame, sent: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, review_value, payload_value) where what a user reviewed is not what was sent; both blank is equal, no review is no check."""
    both = seen.join(sent.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key)
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), said(f).alias("review_value"), said(f"_{f}").alias("payload_value")) for f in fields])).alias("p")
    return both.select(key, pairs).select(key, "p.*").where("review_value <> payload_value")


def with_provenance(fields: DataFrame, sidecar: DataFrame, keys: list[str], unknown: list[str]) -> DataFrame:
    """Fields with what is known of their origin; where nothing is, the columns of ``unknown`` say so."""
    return fields.join(sidecar, keys, "left").fillna("unknown", unknown)


def final_text_audit(critical: DataFrame, draft: DataFrame, confirmed: DataFrame, final: DataFrame) -> DataFrame:
    """Findings (doc, field, finding) on critical fields between draft, confirmed values and final text.

    critical (doc, field); draft (doc, field, value, user_corrected); confirmed (doc, field, value); final (doc, text). A
    field missing in the draft or in what was confirmed has no further finding.
    """
    d, c = draft.select("doc", "field", F.trim("value").alias("d"), "user_corrected"), confirmed.select("doc", "field", F.trim("value").alias("c"))
    rows = critical.join(d, ["doc", "field"], "left").join(c, ["doc", "field"], "left").join(final, "doc", "left")
    none = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    found = F.when(none("d"), F.array(F.lit("critical_field_missing_in_draft"))).when(none("c"), F.array(F.lit("critical_field_missing_in_confirmed"))).otherwise(
        F.array_compact(F.array(
            F.when(~F.contains(F.coalesce("text", F.lit("")), F.col("c")), F.lit("critical_field_missing_in_final")),
            F.when((F.col("c") != F.col("d")) & ~F.coalesce("user_corrected", F.lit(False)), F.lit("value_changed_after_confirm")),
        ))
    )
    return rows.select("doc", "field", F.explode(found).alias("finding"))


def spellings() -> Column:
    """Distinct spellings of a registry row (key_uk, key_ru, aliases): lower-cased, white space as one space."""
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return F.array_distinct(F.filter(F.transform(F.concat(F.array("key_uk", "key_ru"), F.coalesce("aliases", F.array().cast("array<string>"))), normal), lambda k: k.isNotNull() & (k != "")))


def key_index(registry: DataFrame) -> DataFrame:
    """(category, key, ordinal, official): every spelling of a registry row as a key; each once a row."""
    return registry.select("category", F.explode(spellings()).alias("key"), "ordinal", F.col("official_en").alias("official"))
