"""Fields from lines of text, and tables in wide, long and form shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_lines(docs: DataFrame) -> DataFrame:
    """docs (doc, text) as rows (doc, line_no, line), lines trimmed."""
    return docs.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))


def label_values(docs: DataFrame, rules: list[tuple[str, str, str]], after: int = 3, before: int = 2) -> DataFrame:
    """docs (doc, text) and rules (field, label pattern, value pattern) as rows (doc, field, line_no, value, confidence).

    For each field the first line that has its label and a value: the rest of that line (high), one of the
    ``before`` lines above (medium), else of the ``after`` lines below (medium), nearest first; another label ends
    the search. A document's lines are one array within its row, so nothing is shuffled.
    """
    lines = F.transform(F.split("text", r"\r?\n"), lambda t: F.trim(t))
    any_label = "|".join(f"(?:{label})" for _, label, _ in rules)
    with_lines = docs.select("doc", lines.alias("lines"))

    def found(label: str, value: str) -> Column:
        good = lambda t: t.rlike(value) & (F.length(t) >= 2) & ~t.rlike(any_label)
        def walk(near: Column) -> Column:
            """The nearest fitting line ahead of the first label; blank lines count for nothing."""
            told = F.filter(near, lambda t: t != "")
            stop = F.array_position(F.transform(told, lambda t: t.rlike(any_label)), True)
            return F.get(F.filter(F.when(stop > 0, F.slice(told, F.lit(1), (stop - 1).cast("int"))).otherwise(told), good), 0)

        def at(line: Column, i: Column) -> Column:
            tail = F.trim(F.regexp_replace(F.regexp_replace(line, label, ""), r"^[\s:\-—./|,;]+", ""))
            above = F.when(i > 0, F.reverse(F.slice(F.col("lines"), F.greatest(i - before + 1, F.lit(1)), F.least(i, F.lit(before))))).otherwise(F.array().cast("array<string>"))
            below = F.slice(F.col("lines"), i + 2, F.lit(after))
            inline = F.when(good(tail), tail)
            return F.when(line.rlike(label), F.struct(i.alias("line_no"), F.coalesce(inline, walk(above), walk(below)).alias("value"), F.when(inline.isNotNull(), "high").otherwise("medium").alias("confidence")))

        return F.get(F.filter(F.transform("lines", at), lambda h: h["value"].isNotNull()), 0)

    hits = F.array(*[F.struct(F.lit(field).alias("field"), found(label, value).alias("hit")) for field, label, value in rules])
    return with_lines.select("doc", F.explode(hits).alias("h")).where("h.hit is not null").select("doc", "h.field", "h.hit.line_no", "h.hit.value", "h.hit.confidence")


def pattern_values(docs: DataFrame, ladders: dict[str, list[str]]) -> DataFrame:
    """docs (doc, text) as rows (doc, field, value): of each field's patterns the first that fits gives its group 1."""
    first = lambda patterns: F.coalesce(*[F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit("")) for p in patterns])
    fields = F.array(*[F.struct(F.lit(n).alias("field"), first(ps).alias("value")) for n, ps in ladders.items()])
    return docs.select("doc", F.explode(fields).alias("f")).select("doc", "f.field", "f.value").where("value is not null")


def merge_documents(readings: DataFrame) -> DataFrame:
    """readings (subject, key, value, priority, ordinal): the first non-blank value by priority and order, of equals the smallest; a later different one only flags a conflict."""
    told = readings.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    return told.groupBy("subject", "key").agg(F.min_by("value", F.struct("priority", "ordinal", "value")).alias("value"), (F.count_distinct(F.trim("value")) > 1).alias("conflict"))


def to_long(wide: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    """Columns as rows (ids, key, value); nulls go."""
    return wide.unpivot(ids, [F.col(k).cast("string").alias(k) for k in keys], "key", "value").where("value is not null")


def to_wide(long: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Rows (by, key, value) as one column a key; of several values the smallest."""
    return long.groupBy(by).pivot("key", keys).agg(F.min("value"))


def form_operations(answers: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """answers, one column a question, as rows (id, target, kind, value): what to write into which field of a form.

    mapping: column to target and kind (text, checkbox, choice). Blank answers write nothing, nor does a
    checkbox whose answer is not true.
    """
    def value(c: str, kind: str) -> Column:
        return F.when(F.lower(F.col(c).cast("string")).isin("true", "yes", "1"), "on") if kind == "checkbox" else F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))

    operations = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(k).alias("kind"), value(c, k).alias("value")) for c, (t, k) in mapping.items()])
    return answers.select("id", F.explode(F.filter(operations, lambda o: o["value"].isNotNull())).alias("o")).select("id", "o.*")


def alias_values(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts (doc, key, value, state) by canonical key over aliases (key, canonical, rank): the released value of least rank, else none and the best state."""
    rows = facts.join(aliases, "key")
    released = F.col("state") == "released"
    return rows.groupBy("doc", "canonical").agg(F.min_by(F.when(released, F.col("value")), F.struct((~released).alias("u"), "rank", "value")).alias("value"), F.min_by("state", F.struct((~released).alias("u"), "rank", "value")).alias("state"))


def boxes(references: DataFrame, tokens: DataFrame) -> DataFrame:
    """references (doc, field, ocr_ids) over tokens (doc, ocr_id, x0, y0, x1, y1): the box around the tokens that are known, and the ids that are not."""
    rows = references.select("doc", "field", F.explode_outer("ocr_ids").alias("ocr_id")).join(tokens, ["doc", "ocr_id"], "left")
    lost = F.when(F.col("x0").isNull() & F.col("ocr_id").isNotNull(), F.col("ocr_id"))
    return rows.groupBy("doc", "field").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_sort(F.collect_set(lost)).alias("unresolved"))


def machine_fields(lines: DataFrame, keep: list[str], parsed: Column) -> DataFrame:
    """The columns ``keep`` and the fields of parsed machine-readable lines; lines of a wrong length give nulls.

    The generator has each row parsed once; as a plain struct the optimizer would repeat the parse for each field.
    """
    return lines.select(*keep, F.inline(F.array(parsed)))
