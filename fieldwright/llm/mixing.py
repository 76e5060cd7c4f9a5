"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Each source's words go to a target. Whole epochs come first: a source whose target is at least its
size is taken once as a whole. What is left of the target goes to a weighted sample without replacement:
document keys are exponential variates divided by a quality weight, and documents are taken in order of
their keys while the prefix sum of words stays within the budget.

Equal rows are one group with a count, so that any number of them is one entry. The keys of a source are cut into
ranges by a fixed rule, the more the larger the corpus; sums of ranges give each range its offset, and only groups
of one range are ordered together. So a source with a third of all rows is spread over as many tasks as the others
together. All this moves sizes and hashes; texts move once, to what has been decided on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwright.llm.common import materialize, repeated, row_hashes, word_count

#: Weights of the sources in order of code point, repeating; null last.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Groups of a range of keys, on average over all sources, and the least number of ranges.
BUCKET_ROWS, BUCKETS = 4096, 512
SEED = "mix-1"
#: Sampling weight of a document by its quality label; without a label 1.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with column target.

    Targets are min(cap x source_size, level x weight) with the level at which they add up to share x
    all sizes: sources in order of cap / weight are full as long as the level that the rest would
    get is above their ratio. That equals sharing out the excess by weight again until none is above.
    The table has a row per source, so windows over all of it are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_rest", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("_full")) / F.col("_rest"))
    # the first source in this order that is not full sets the level
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("_ratio"), F.col("_full"), F.col("_level")))).over(everything)
    rows = rows.withColumn("_set", level.getField("_level"))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_set") * F.col("_w"), F.col("_cap")))
    return rows.withColumn("target", target.cast("double")).select("source", "source_size", "target")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from a hash of the key."""
    word = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), 1, 13), 16, 10).cast("double")
    return (word + 0.5) / F.lit(float(1 << 52))


def decided(docs: DataFrame, quality: DataFrame | None, weights: Sequence[float], share: float, cap: float, seed: str) -> DataFrame:
    """A row per group of equal rows: their hashes (h1, h2), number n, size, source_size, target; epochs is how often each row is taken, extra of how many once more."""
    text = F.col("text").cast("string")
    h1, h2 = row_hashes(docs)
    name = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    rows = docs.select(F.col("source").alias("source"), name.alias("name"), word_count(text).alias("size"), h1.alias("h1"), h2.alias("h2"))
    groups = materialize(rows.groupBy("source", "name", "size", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "groups")
    buckets = max(BUCKETS, groups.count() // BUCKET_ROWS)
    goal = targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    weight = F.lit(1.0)
    if quality is not None:
        marks = quality.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("name")).agg(F.max("quality").alias("quality"))
        groups = groups.join(marks, "name", "left")
        weight = F.coalesce(*[F.when(F.col("quality") == k, F.lit(v)) for k, v in QUALITY_WEIGHTS.items()], F.lit(1.0))
    keyed = groups.withColumn("key", -F.log(uniform(F.col("name"), seed)) / weight).withColumn("words", F.col("size") * F.col("n"))
    keyed = keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    offsets = sums.select("source", "bucket", (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("offset"))
    plan = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).select(offsets["source"].alias("of"), F.col("bucket").alias("b"), "offset", "source_size", "target")
    rows = keyed.join(plan, keyed["source"].eqNullSafe(plan["of"]) & (keyed["bucket"] == plan["b"]))
    order = Window.partitionBy("source", "bucket").orderBy("key", "name", "size", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("words").over(order), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("before", before).withColumn("epochs", F.least(epochs, F.lit(cap).cast("long")))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    # one more of a group's rows as long as the middle of that row is inside the budget
    more = F.least(F.col("n"), F.greatest(F.lit(0), F.floor((left - F.col("before")) / F.col("size") + 0.5)))
    extra = F.when((F.col("size") > 0) & (F.col("epochs") < cap), more).otherwise(0).cast("long")
    return rows.select("h1", "h2", "n", "size", "source_size", "target", "epochs", extra.alias("extra"))


def _with_decisions(docs: DataFrame, plan: DataFrame, times: Column, out: list[Column]) -> DataFrame:
    """One row of each group as often as ``times`` says, with the columns of docs and ``out``, which may use those of plan and the number i from 1."""
    h1, h2 = row_hashes(docs)
    # numbers for names, so that nothing clashes and columns that nobody asks for do not travel
    one = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], h1.alias("h1"), h2.alias("h2")).dropDuplicates(["h1", "h2"])
    rows = repeated(lambda part: one.join(part, ["h1", "h2"]), materialize(plan, "plan"), times, "i")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], *out)


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with columns size, source_size, target, copies and taken.

    size is the number of words (null text: 0), copies how often the mix takes the document, taken = size x copies.
    The document at which the budget ends is taken if that brings the source nearer to its target.
    ``quality`` (doc_id, quality) gives sampling weights; its nulls and unknown values weigh 1, of repeated ids the
    greatest counts. Null sources are one source, the last. Null doc_ids sample by the hash of their text
    alone. Empty documents have size 0 and take part in whole epochs. Repeated rows have equal keys; as many of
    them are taken as the budget allows, and which does not matter. Very long texts are documents like
    others. Columns of the input with these five names are replaced; others, of whatever name, stay. No documents: no rows.
    """
    rows = docs.drop("size", "source_size", "target", "copies", "taken")
    copies = (F.col("epochs") + F.when(F.col("i") <= F.col("extra"), 1).otherwise(0)).cast("int")
    out = [F.col("size"), F.col("source_size"), F.col("target"), copies.alias("copies"), (F.col("size") * copies).alias("taken")]
    return _with_decisions(rows, decided(rows, quality, weights, share, cap, seed), F.col("n"), out)


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of ``docs``, of whatever name.

    Nulls, ties, repeated rows, empty and very long texts as in ``mix``. No documents: no rows.
    """
    return _with_decisions(docs, decided(docs, quality, weights, share, cap, seed), F.col("n") * F.col("epochs") + F.col("extra"), [])
