"""SimHash near duplicates at a similarity of word-shingle sets, by meet-in-the-middle ball hashing.

A text's five-word shingles are a set of 64-bit hashes, and its fingerprint the 240 majority bits of these and
of three remixed copies. Two sets of Jaccard similarity 0.8 differ in 15 % of the bits on average, far too many for
one ball around all bits. So the bits are cut into ten bands of 24: each fingerprint emits, for each band, all
variants within one bit, and two that differ in two bits or fewer of some band meet on a common variant. What
collides is held against 128 bits of both fingerprints, and what is near there is verified on the shingles
themselves. Texts of equal sets are one set here, however many.

Ball hashing over bands finds nearly all such pairs, not all: see ``RECALL`` in the README. Within a variant each
set is first held against ``LINKS`` earlier sets that are near, which keeps a family of near copies together without
listing all its pairs. Sets for which more were near go through a second, exact search among themselves (``rest_links``): two sets
that are similar have one of their rarest shingles in common, in a place that leaves enough others behind it. There only sets that no link
has brought together yet are compared, at last without a limit, so a family of texts on one template loses no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwright.llm.common import by_batch, connected_components, free_name, materialize, released, row_hashes

SEED = 42
WORDS = 5
#: Bands of a fingerprint and bits of each.
BANDS, WIDTH = 10, 24
#: Odd multipliers of the remixed hashes, and one for both halves.
REMIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
STIR = 0xD6E8FEB86659FD93
#: Of the 128 bits that travel with a variant so many may differ: four standard deviations over the mean at similarity 0.8.
NEAR = 36
LINKS = 1
#: Up to this many sets of a variant are compared in one array operation for each distance in the list.
SMALL = 48


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of all five-word shingles; fewer words: of the whole sequence; no word: none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda end, n: end + 1 + n))
    starts = [0, *(end + 1 for end in ends)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[WORDS - 1 :])] or [digest(joined, SEED)], dtype=np.uint64))


def similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of sizes a and b that share so many have a Jaccard similarity of 4/5 or more."""
    return 9 * shared >= 4 * (a + b)


def set_key(shingle_set: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingle_set.tobytes(), SEED) - (1 << 63)


def set_fingerprint(shingle_set: np.ndarray) -> np.ndarray:
    """Four longs: the majority bits of the hashes and of their remixed copies; zeros for the empty set."""
    out = np.zeros(4, np.uint64)
    for k in range(4 if len(shingle_set) else 0):
        x = shingle_set
        if k:
            x = x * np.uint64(REMIX[k - 1])
            x = (x ^ (x >> np.uint64(32))) * np.uint64(STIR)
            x ^= x >> np.uint64(32)
        votes = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(votes * 2 > len(x), bitorder="little").view("<u8")[0]
    return out


def set_fingerprints(rows: DataFrame) -> DataFrame:
    """rows: (h1, h2, text). Rows (h1, h2, s, n, f1, f2, f3, f4): the set's key, size and fingerprint."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        prints = np.array([set_fingerprint(x) for x in sets], np.uint64).view(np.int64)
        found = [pa.array([set_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(np.ascontiguousarray(prints[:, i])) for i in range(4))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["h1", "h2", "s", "n", "f1", "f2", "f3", "f4"])

    return rows.mapInArrow(by_batch(of), "h1 long, h2 long, s long, n long, f1 long, f2 long, f3 long, f4 long")


def band(longs: list[np.ndarray], number: int) -> np.ndarray:
    """Bits number x WIDTH to (number + 1) x WIDTH of the fingerprints."""
    word, low = divmod(number * WIDTH, 64)
    bits = longs[word] >> np.uint64(low)
    if low + WIDTH > 64:
        bits = bits | longs[word + 1] << np.uint64(64 - low)
    return bits & np.uint64((1 << WIDTH) - 1)


def ball(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (variant, s, f1, f2): for each band its bits and all with one bit changed, under the band's number."""
    longs = [batch.column(i).to_numpy().view(np.uint64) for i in range(1, 5)]
    flips = np.array([0, *(1 << i for i in range(WIDTH))], np.uint64)
    parts = [(band(longs, b) | np.uint64(b << WIDTH))[:, None] ^ flips[None, :] for b in range(BANDS)]
    variants = np.concatenate(parts, axis=1)
    spread = lambda i: pa.array(np.repeat(batch.column(i).to_numpy(), variants.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(variants.ravel().astype(np.int32)), spread(0), spread(1), spread(2)], ["variant", "s", "f1", "f2"])


def near_pairs(keys: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of entries under one key for which ``near(i, j)``, of each j those with the ``most`` smallest i (None: all); keys are sorted.

    Third, the places of entries that may be near to more than that. In a long list each entry is held against all others only until it has
    its pairs: entries near to the first few leave the list with these, so a family of near copies costs a few passes over it.
    """
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    found_i, found_j, more = [starts[:0]], [starts[:0]], [starts[:0]]
    usual = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for distance in range(1, SMALL):
        i, j = usual[:-distance], usual[distance:]
        same = keys[i] == keys[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        close = near(i, j)
        found_i.append(i[close])
        found_j.append(j[close])
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        left, links = np.arange(start, start + size), np.zeros(size, np.int64)
        early = False
        while len(left) > 1:
            first, left, links = left[:1], left[1:], links[1:]
            close = near(first, left)
            found_i.append(np.full(int(close.sum()), first[0]))
            found_j.append(left[close])
            links = links + close
            if most is not None and (links >= most).any():
                stay, early = links < most, True
                left, links = left[stay], links[stay]
        if early:
            more.append(np.arange(start, start + size))
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    keep = np.ones(len(j), bool)
    if most is not None:
        keep[most:] = j[most:] != j[:-most]
    return i[keep], j[keep], np.unique(np.concatenate([*more, i[~keep], j[~keep]]))


def by_key(function: Callable[..., Iterator[pa.RecordBatch]], kinds: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of all rows of some keys, columns of ``kinds``, as one for ``mapInArrow`` over rows sorted by the first column, the key.

    The last key of a batch waits for the next, as it may go on there.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = [np.zeros(0, k) for k in kinds]
        for batch in batches:
            now = [np.concatenate([w, batch.column(i).to_numpy()]) for i, w in enumerate(wait)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
            wait = [x[cut:] for x in now]
            if cut:
                yield from function(*[x[:cut] for x in now])
        if len(wait[0]):
            yield from function(*wait)

    return over


def links_within_variants(k: np.ndarray, s: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of near sets that share a variant, and rows (a, null) of sets that may be near to more; sorted by variant and s."""
    x, y = f1.view(np.uint64), f2.view(np.uint64)
    near = lambda i, j: np.bitwise_count(x[i] ^ x[j]).astype(np.int64) + np.bitwise_count(y[i] ^ y[j]) <= NEAR
    i, j, more = near_pairs(k, near, LINKS)
    if len(i) or len(more):
        more = np.unique(s[more])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[i], more])), pa.array(s[j].tolist() + [None] * len(more), pa.int64())], ["a", "b"])


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a similarity of 0.8 or more; members: (s, members)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            near.append(bool(similar(len(np.intersect1d(x, y)), len(x), len(y))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(by_batch(of), "a long, b long")


def rarest(members: DataFrame) -> DataFrame:
    """Rows (token, s, n, p): the shingles that a similar set must share one of, each with its place p among the set's n, rarest first.

    Shingles are counted over these sets; those of one set alone come first and can be shared with none, so they only move the places of the others.
    """

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
        unique = [np.unique(x) for x in sets]
        sizes = [len(u) for u in unique]
        flat = np.concatenate([np.zeros(0, np.uint32), *unique]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(flat), pa.array(np.repeat([len(x) for x in sets], sizes).astype(np.int64))], ["s", "token", "n"])

    rows = materialize(members.mapInArrow(by_batch(of), "s long, token long, n long"), "shingles")
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("s")
    shared = rows.join(counts, "token").withColumn("p", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "token")) - 1)
    return shared.where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * 4 / 5)).select("token", "s", "n", "p")


#: Pairs of a set under a token in the rounds of the second search; the last has no limit.
ROUNDS = (4, 64, None)


def rest_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` with all those of a similarity of 0.8 or more between these sets, up to connectivity; members: (s, members)."""
    places = materialize(rarest(members), "places")
    for most in ROUNDS:

        def paired(token: np.ndarray, n: np.ndarray, s: np.ndarray, p: np.ndarray, root: np.ndarray, most: int | None = most) -> Iterator[pa.RecordBatch]:
            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                enough = 9 * np.minimum(n[i] - p[i], n[j] - p[j]) >= 4 * (n[i] + n[j])
                return enough & (root[i] != root[j])

            i, j, _ = near_pairs(token, near, most)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s[i], s[j])), pa.array(np.maximum(s[i], s[j]))], ["a", "b"])

        # what is together is one link a set from here on: its root's
        components = connected_components(links)
        before, links = links, components.select(F.col("node").alias("a"), F.col("root").alias("b"))
        released(before)
        roots = components.withColumnRenamed("node", "s")
        rows = places.join(roots, "s", "left").select("token", "n", "s", "p", F.coalesce("root", "s").alias("root"))
        met = rows.repartition("token").sortWithinPartitions("token", "n", "s").mapInArrow(by_key(paired, [np.int64] * 5), "a long, b long")
        pairs = materialize(met.distinct(), "pairs")
        if pairs.isEmpty():
            break
        before, links = links, materialize(links.unionByName(verified(pairs, members)), "links")
        released(before, pairs)
    released(places)
    return links


def set_links(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) of the keys of sets with a similarity of 0.8 or more. sets: as from set_fingerprints; rows: (h1, h2, text)."""
    distinct = sets.where("n > 0").select("s", "f1", "f2", "f3", "f4").dropDuplicates(["s"])
    spread = distinct.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s")
    variants = spread.mapInArrow(by_batch(ball), "variant int, s long, f1 long, f2 long")
    met = variants.repartition("variant").sortWithinPartitions("variant", "s").mapInArrow(by_key(links_within_variants, [np.int32, *[np.int64] * 3]), "a long, b long")
    found = materialize(met.distinct(), "pairs")
    pairs, more = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("s"))
    named = found.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    # of equal sets one row is enough
    one = sets.join(named, "s", "left_semi").groupBy("s").agg(F.min(F.struct("h1", "h2")).alias("row")).select("s", "row.h1", "row.h2")

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(shingles(t).astype(np.uint32)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["s", "members"])

    texts = rows.join(one, ["h1", "h2"]).select("s", "text")
    members = materialize(texts.mapInArrow(by_batch(full), "s long, members binary").dropDuplicates(["s"]), "members")
    links = materialize(verified(pairs, members), "verified")
    if not more.isEmpty():
        links = rest_links(members.join(more, "s", "left_semi"), links)
    released(found, members)
    return links


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents less all but one row of each component of near duplicates.

    Two texts are linked if ball hashing brings them together and the sets of their five-word shingles (ASCII
    lower case, compared by 32 bits of each hash) have a Jaccard similarity of 0.8 or more; texts without words, empty
    or null, are alike. The row that stays is the one with the smallest doc_id, null last, then with the
    least hash of its text, then of all its columns. So null and repeated doc_ids are rows like any other: only
    their texts decide; of equal rows one stays. Very long texts are taken whole. Further columns, of whatever name,
    stay as they are. No documents: no rows.
    """
    one, two = free_name(docs, "h1"), free_name(docs, "h2")
    marked = docs.withColumns(dict(zip((one, two), row_hashes(docs))))
    rows = marked.select(F.col(one).alias("h1"), F.col(two).alias("h2"), F.col("text").cast("string").alias("text"))
    sets = materialize(set_fingerprints(rows), "sets")
    links = set_links(sets, rows)
    roots = connected_components(links)
    ids = marked.select(F.col(one).alias("h1"), F.col(two).alias("h2"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("t")).distinct()
    of = sets.select("h1", "h2", "s").distinct().join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    first = of.join(ids, ["h1", "h2"]).groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "t", "h1", "h2")).alias("row"))
    kept = first.select(F.col("row.h1").alias(one), F.col("row.h2").alias(two))
    return marked.join(kept, [one, two], "left_semi").dropDuplicates([one, two]).select(*[F.col(f"`{c}`") for c in docs.columns])
