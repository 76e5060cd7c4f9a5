"""Search by weighted edit distance: tries walked under a cut-off, and the lookups that are built on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.functions import places
from fieldwright.functions.places import CONFUSABLE

#: Costs in fifths of an edit, so that sums are exact: of letters that are taken for each other, and of any other edit.
CHEAP, EDIT = 2, 5
#: Spellings in a trie and readings searched in it by one task; beyond, tries and readings are split and each part meets each once.
TRIE, READINGS = 50_000, 4_096
#: Readings are dealt over all tasks of a shuffle as long as each part has a share of READINGS no smaller than one in so many.
SPREAD = 16
#: Readings walked down a trie together.
TOGETHER = 64
#: Categories whose spellings may be read wrongly; others are met exactly or not at all.
FUZZY_CATEGORIES = ("settlement", "oblast")


class Trie:
    """Spellings by their letters, level by level: parent, letter, the longest spelling below and the spelling that ends there (-1: none)."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = sorted(set(keys))
        lengths = np.array([len(k) for k in self.keys], np.int64)
        letters = sorted({c for k in self.keys for c in k})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        width = int(lengths.max(initial=0))
        table = np.zeros((len(self.keys), width), np.int64)
        for i, k in enumerate(self.keys):
            table[i, : len(k)] = [self.code[c] for c in k]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rows, above = np.arange(len(self.keys)), np.zeros(len(self.keys), np.int64)
        for d in range(width):
            keep = lengths[rows] > d
            rows, above = rows[keep], above[keep]
            new = np.ones(len(rows), bool)
            new[1:] = (above[1:] != above[:-1]) | (table[rows[1:], d] != table[rows[:-1], d])
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            ends = np.full(len(first), -1, np.int64)
            done = lengths[rows] == d + 1
            ends[node[done]] = rows[done]
            self.levels.append((above[first], table[rows[first], d], np.maximum.reduceat(lengths[rows], first), ends))
            above = node
        pairs = [*CONFUSABLE, *((b, a) for a, b in CONFUSABLE)]
        self.others = {c: len(letters) + 1 + i for i, c in enumerate(sorted({b for _, b in pairs} - set(letters)))}
        size = len(letters) + len(self.others) + 2  # the last stands for all letters that are no spelling's
        self.cost = np.full((size, size), EDIT, np.int64)
        self.cost[np.arange(size - 1), np.arange(size - 1)] = 0
        number = self.code | self.others
        for a, b in pairs:
            if a in number and b in number:
                self.cost[number[a], number[b]] = CHEAP

    def search(self, readings: list[str], share: float, cap: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(reading, spelling, distance in fifths) of all pairs whose distance is at most ``share`` of the longer and ``cap`` edits."""
        parts = [self._walk(readings[i : i + TOGETHER], share, cap) for i in range(0, len(readings), TOGETHER)]
        found = [np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(3)]
        found[0] += np.repeat(np.arange(len(parts)) * TOGETHER, [len(p[0]) for p in parts])
        return tuple(found)

    def _walk(self, readings: list[str], share: float, cap: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(r) for r in readings], np.int64)
        width, other, number = int(lengths.max(initial=0)), len(self.cost) - 1, self.code | self.others
        letters = np.full((len(readings), width), other, np.int64)
        for i, r in enumerate(readings):
            letters[i, : len(r)] = [number.get(c, other) for c in r]
        most = EDIT * cap if cap is not None else np.inf
        allowed = lambda q, longest: np.minimum(share * EDIT * np.maximum(lengths[q], longest), most) + 1e-9
        q, node = np.arange(len(readings)), np.zeros(len(readings), np.int64)
        costs = np.tile(np.arange(width + 1) * EDIT, (len(readings), 1))
        inside = np.arange(width + 1) <= lengths[:, None]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for depth, (parents, codes, longest, ends) in enumerate(self.levels, 1):
            low, high = np.searchsorted(parents, node, side="left"), np.searchsorted(parents, node, side="right")
            n = high - low
            at = np.repeat(np.arange(len(q)), n)
            node = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            q, old = q[at], costs[at]
            swap = old[:, :-1] + self.cost[codes[node][:, None], letters[q]]
            costs = np.concatenate([np.full((len(q), 1), depth * EDIT), np.minimum(old[:, 1:] + EDIT, swap)], axis=1)
            # an insertion carries each place's cost on: the least of all places before, each with the way from there
            step = np.arange(width + 1) * EDIT
            costs = np.minimum.accumulate(costs - step, axis=1) + step
            whole = ends[node] >= 0
            distance = costs[np.arange(len(q)), lengths[q]]
            hit = whole & (distance <= allowed(q, depth))
            found.append((q[hit], ends[node[hit]], distance[hit]))
            alive = np.where(inside[q], costs, np.iinfo(np.int64).max).min(axis=1) <= allowed(q, longest[node])
            q, node, costs = q[alive], node[alive], costs[alive]
            if not len(q):
                break
        return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))


def weighted_matches(asked: DataFrame, known: DataFrame, share: float, cap: float | None = None, trie: int | None = None, readings: int | None = None) -> DataFrame:
    """Rows (category, wanted, key, distance) of all readings (category, wanted) and spellings (category, key) so near.

    Letters that are taken for each other cost 0.4. A trie of a category's spellings is walked with a row of costs for each reading, and a branch is left as
    soon as no spelling below can be near enough. Distinct readings and spellings meet in a grid: large sets of either are dealt by
    hash, each part of the ones meets each part of the others in one task, so neither is held whole and no category is one task. Parts are small in bytes
    however long their walk takes, so their number is given and they are not put together again. Empty and null ones meet nothing.
    """
    asked, known = (d.select("category", c).where(F.length(c) > 0).distinct() for d, c in ((asked, "wanted"), (known, "key")))
    most, tasks, n_asked = readings or READINGS, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked.count()
    shards, parts = max(1, -(-known.count() // (trie or TRIE))), max(1, -(-n_asked // most), min(tasks, n_asked * SPREAD // most))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("category", "wanted", own("wanted", parts).alias("part"), numbers(shards).alias("shard"))
    right = known.select("category", "key", own("key", shards).alias("shard"), numbers(parts).alias("part"))

    def of(wanted: pa.Table, keys: pa.Table) -> pa.Table:
        spellings, asked_for = Trie(keys.column("key").to_pylist()), wanted.column("wanted").to_pylist()
        q, k, distance = spellings.search(asked_for, share, cap) if asked_for and spellings.keys else (np.zeros(0, np.int64),) * 3
        category = (wanted if asked_for else keys).column("category")[:1].to_pylist() * len(q)
        return pa.table({"category": pa.array(category, pa.string()), "wanted": pa.array([asked_for[i] for i in q.tolist()], pa.string()), "key": pa.array([spellings.keys[i] for i in k.tolist()], pa.string()), "distance": pa.array(distance / EDIT, pa.float64())})

    keys, cells = ["category", "part", "shard"], max(tasks, parts * shards)
    return left.repartition(cells, *keys).groupBy(*keys).cogroup(right.repartition(cells, *keys).groupBy(*keys)).applyInArrow(of, "category string, wanted string, key string, distance double")


def spelled(col: Column) -> Column:
    """Small letters, white space as one space: how spellings of a registry are told apart."""
    return F.trim(F.regexp_replace(F.lower(col), r"(?U)\s+", " "))


def fuzzy_registry(misses: DataFrame, registry: DataFrame, accept: float = 0.34, near: float = 0.5, categories: tuple[str, ...] | None = FUZZY_CATEGORIES, strict: bool = False) -> DataFrame:
    """Lookups (lookup_id, category, term) that no spelling meets: official, confidence, matched and candidates.

    The nearest spelling by weighted distance as a share of the longer one counts if it is at most ``accept``; confidence falls
    with it, and such a find is always for review. Its candidates are the official names of all spellings up to ``near``, nearest first. Only in ``categories``
    (None: in all), and never if strict. Repeated lookups give a row each; what is not found has no name, confidence 0 and no candidates.
    """
    from fieldwright.operators.joins import key_index

    keys = key_index(registry).groupBy("category", "key").agg(F.collect_set(F.struct("ordinal", "official")).alias("rows"))
    asked = misses.select("category", spelled(F.col("term")).alias("wanted"))
    if strict or categories is not None:
        asked, keys = (d.where(F.lit(False) if strict else F.col("category").isin(*categories)) for d in (asked, keys))
    found = weighted_matches(asked, keys.select("category", "key"), near)
    share = F.col("distance") / F.greatest(F.length("wanted"), F.length("key"))
    scored = found.join(keys, ["category", "key"]).select("category", "wanted", share.alias("share"), F.explode("rows").alias("row"))
    each = scored.groupBy("category", "wanted", "row.official").agg(F.min(F.struct("share", "row.ordinal")).alias("b"))
    best = each.groupBy("category", "wanted").agg(F.min(F.struct("b", "official")).alias("first"), F.array_sort(F.collect_list(F.struct("b", "official"))).alias("all")).where(F.col("first.b.share") <= accept + 1e-9)
    out = misses.withColumn("wanted", spelled(F.col("term"))).join(best, ["category", "wanted"], "left")
    confidence = F.when(F.col("first").isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.4), 0.9 - F.col("first.b.share")), 6))
    candidates = F.coalesce(F.transform("all", lambda x: x["official"]), F.array().cast("array<string>"))
    return out.select("lookup_id", F.col("first.official").alias("official"), confidence.alias("confidence"), F.col("first").isNotNull().alias("matched"), candidates.alias("candidates"))


#: Names of settlement types that are cut off before a place is looked up, in this order, each with white space after it.
SETTLEMENT_TYPES = (
    "м.", "м", "місто", "смт", "смт.", "селище міського типу", "п.г.т.", "пгт", "с.", "село", "с-ще", "селище", "хут.", "хутір", "р-н", "район", "обл.", "область", "окр.", "округ", "громада",
)
#: What stands before a place in a gazetteer lookup.
PLACE_PREFIX = r"(?iu)^\s*(?:с\.?\s*м\.?\s*т\.?|смт\.?|пгт\.?|селище(?:\s+міського\s+типу)?|місто|село|м\.|с\.)\s+"


def without_type(place: Column) -> Column:
    """The place without the first settlement type of the list that it begins with."""
    out = place
    for name in reversed(SETTLEMENT_TYPES):
        head = "^" + "".join(f"\\{c}" if c in ".-" else c for c in name) + r"\s+"
        out = F.when(place.rlike(head), F.trim(F.regexp_replace(place, head, ""))).otherwise(out)
    return out


def snapped(names: DataFrame, gazetteer: DataFrame, share: float = 0.34, cap: float = 2.0) -> DataFrame:
    """For each (id, name): value, matched, suggested, distance and reason against a gazetteer (entry, ordinal).

    An entry that is the same in small letters is taken; a near one, within ``share`` of the longer and ``cap`` edits, is a
    suggestion only and the reading stays; of entries as near the first by ordinal. Reasons: empty, exact, fuzzy_geography_match, unknown_geography.
    """
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("name", F.lit("")), PLACE_PREFIX, ""), "[.,;]+$", ""))
    rows = names.withColumn("_cleaned", cleaned).withColumn("_lower", F.lower("_cleaned"))
    known = gazetteer.groupBy(F.lower("entry").alias("key")).agg(F.min(F.struct("ordinal", "entry")).alias("e"))
    exact = rows.select("_lower").distinct().join(known, F.col("_lower") == F.col("key")).select("_lower", F.col("e.entry").alias("_exact"))
    rows = rows.join(exact, "_lower", "left")
    one = F.lit("place").alias("category")
    found = weighted_matches(rows.where("_exact is null").select(one, F.col("_lower").alias("wanted")), known.select(one, "key"), share, cap)
    # the nearest of all entries decides, then its own share
    best = found.join(known, "key").groupBy("wanted").agg(F.min(F.struct("distance", "e")).alias("b")).select(F.col("wanted").alias("_lower"), F.col("b.distance").alias("_distance"), F.col("b.e.entry").alias("_near"))
    rows = rows.join(best, "_lower", "left")
    reason = F.when(F.col("_cleaned") == "", "empty").when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "fuzzy_geography_match").otherwise("unknown_geography")
    distance = F.when(F.col("_exact").isNotNull(), 0.0).otherwise(F.round("_distance", 6))
    return rows.select("id", "name", F.coalesce("_exact", "_cleaned").alias("value"), F.col("_exact").isNotNull().alias("matched"), F.col("_near").alias("suggested"), distance.alias("distance"), reason.alias("reason"))


def cities(names: DataFrame, gazetteer: DataFrame | None) -> DataFrame:
    """For each (id, name) of a city: value, source, review and suggested, by the first step that tells.

    Blocked terms have no value; an old Latin spelling gets today's; else the settlement type is cut off and the gazetteer asked: an
    exact entry counts, anything else stays as read, for review, with a near entry as suggestion. Without a gazetteer the
    reading passes. Empty names: no value, source knowledge.
    """
    said = F.trim(F.coalesce("name", F.lit("")))
    respelled = places.looked_up(places.RESPELLED | {wrong: now for wrong, _, now in places.RENAMED}, said)
    # blocked terms are held as they are written, and a reading in small letters, so only one written in small letters would be met
    blocked = F.lower(said).isin(*places.BLOCKED)
    rows = names.select("id", "name", said.alias("_said"), F.when(said == "", "knowledge").when(blocked, "blocked").when(respelled.isNotNull(), "knowledge").alias("_source"), respelled.alias("_respelled"))
    rows = rows.withColumn("_bare", F.when(F.col("_source").isNull(), without_type(F.col("_said"))))
    if gazetteer is None:
        return rows.select("id", "name", F.coalesce("_respelled", "_bare").alias("value"), F.coalesce("_source", F.lit("passthrough")).alias("source"), F.lit(False).alias("review"), F.lit(None).cast("string").alias("suggested"))
    bare = rows.select(F.col("_bare").alias("id"), F.col("_bare").alias("name")).where("_bare is not null and _bare <> ''").distinct()
    told = snapped(bare, gazetteer).select(F.col("id").alias("_key"), F.col("value").alias("_value"), "matched", "suggested")
    rows = rows.join(told, F.col("_bare") == F.col("_key"), "left")
    source = F.coalesce("_source", F.when(F.col("matched"), "gazetteer"), F.lit("passthrough"))
    value = F.when(F.col("_source").isNotNull(), F.col("_respelled")).when(F.col("matched"), F.col("_value")).otherwise(F.col("_bare"))
    review = F.col("_source").isNull() & (F.col("_bare") != "") & ~F.coalesce("matched", F.lit(False))
    return rows.select("id", "name", value.alias("value"), source.alias("source"), F.coalesce(review, F.lit(False)).alias("review"), F.when(F.col("_source").isNull(), F.col("suggested")).alias("suggested"))


def province(name: Column) -> Column:
    """struct(value, source) of a province: a region in any case of its name in English, else as read; empty: no value."""
    said = F.trim(F.coalesce(name, F.lit("")))
    told = lambda r: F.struct(F.when(said == "", None).otherwise(F.coalesce(r["english"], said)).alias("value"), F.when((said == "") | r.isNotNull(), "knowledge").otherwise("passthrough").alias("source"))
    return places.let(places.region(said), told)


def authorities(names: DataFrame, registry: DataFrame) -> DataFrame:
    """For each (id, name, at): value, source and review by a registry: terms of civil registration first, then authorities, else as read. An entry counts by any spelling; one whose era does not fit is for review."""
    from fieldwright.operators.joins import registry_lookup

    rows = names.withColumn("_said", F.trim(F.coalesce("name", F.lit(""))))
    asked = rows.where("_said <> ''").select(F.col("_said").alias("term"), "at").distinct().withColumn("lookup_id", F.struct("term", "at"))
    for n, category in enumerate(("civil_registry_term", "authority")):
        found = registry_lookup(asked.withColumn("category", F.lit(category)), registry.where(F.col("category") == category)).where("matched")
        rows = rows.join(found.select(F.col("lookup_id.term").alias(f"_t{n}"), F.col("lookup_id.at").alias(f"_d{n}"), F.col("official").alias(f"_o{n}"), F.col("review").alias(f"_r{n}")), (F.col("_said") == F.col(f"_t{n}")) & F.col("at").eqNullSafe(F.col(f"_d{n}")), "left")
    value = F.coalesce("_o0", "_o1", F.when(F.col("_said") != "", F.col("_said")))
    return rows.select("id", "name", value.alias("value"), F.when(F.coalesce("_o0", "_o1").isNotNull(), "knowledge").otherwise("passthrough").alias("source"), F.coalesce("_r0", "_r1", F.lit(False)).alias("review"))
