"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in at most three of 64 bits are to be linked. The bits are cut into three
blocks; if two fingerprints differ in one to three bits, some block holds at least one of them, so
without that block they differ in at most two. Each fingerprint therefore emits, for each of the three
projections that leave a block out, all variants within half the remaining radius, one bit: 3 + 128
+ 1 rows or fewer. Two linked fingerprints meet on a common variant; pairs that collide are verified
on all 64 bits. Only distinct fingerprints take part, so exact copies, however many, cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwright.llm.common import by_batch, connected_components, local_stars, materialize

SEED = 42
RADIUS = 3
#: Bits [from, to) of the three blocks.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Up to this many fingerprints of a variant are compared in one array operation for each distance in the list.
SMALL = 48


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 of every word shingle, repeats included.

    Fewer words than a shingle: the whole sequence is the only shingle. No word, or null: 0. A bit is
    1 if over half of the hashes have it.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda end, n: end + 1 + n))
    starts = [0, *(end + 1 for end in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])] or [digest(joined, SEED)], dtype="<u8")
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Rows (doc_id, fp) for every document; fp is the fingerprint as a signed long."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(by_batch(of), "doc_id long, fp long")


def ball(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (variant, fp): for each projection, the fingerprint's bits there and all with one bit changed."""
    fp = batch.column(0).to_numpy().view(np.uint64)
    parts = []
    for number, (low, high) in enumerate(BLOCKS):
        left = np.uint64((1 << low) - 1)
        width = 64 - (high - low)
        # the bits below and above the block, moved together, under the projection's number
        base = (fp & left) | (((fp >> np.uint64(high)) << np.uint64(low)) if high < 64 else np.uint64(0))
        base = base | np.uint64(number << 62)
        flips = np.array([0, *(1 << i for i in range(width))], dtype=np.uint64)
        parts.append((base[:, None] ^ flips[None, :]).ravel())
    variants = np.concatenate(parts)
    owners = np.concatenate([np.repeat(fp, 1 + 64 - (high - low)) for low, high in BLOCKS])
    return pa.RecordBatch.from_arrays([pa.array(variants.view(np.int64)), pa.array(owners.view(np.int64))], ["variant", "fp"])


def _verified(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that connect all such fingerprints of equal keys; keys are sorted. A long list gives no more pairs than it has entries."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    found_a, found_b = [], []

    def close(a: np.ndarray, b: np.ndarray) -> None:
        near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
        found_a.append(a[near])
        found_b.append(b[near])

    usual = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    k, f = keys[usual], fps[usual]
    for distance in range(1, SMALL):
        same = k[distance:] == k[:-distance] if distance < len(k) else np.zeros(0, bool)
        if not same.any():
            break
        close(f[:-distance][same], f[distance:][same])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        # each fingerprint is reached once, from one that is linked to it; what is reached is held against the rest alone
        rest = np.unique(fps[start : start + size])
        while len(rest):
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                x = reached.pop()
                near = np.bitwise_count(rest ^ x) <= RADIUS
                found_a.append(np.full(int(near.sum()), x, np.uint64))
                found_b.append(rest[near])
                reached.extend(rest[near])
                rest = rest[~near]
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (fps[:0], fps[:0])


def links_within_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints that share a variant; the input is sorted by variant.

    Each batch gives a star per local component, which keeps connectivity without listing all pairs.
    The last variant of a batch waits for the next, as it may go on there.
    """
    wait_k = wait_f = np.zeros(0, np.int64)

    def star(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _verified(k, f.view(np.uint64))
        if len(a):
            x, y = local_stars(a.view(np.int64), b.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    for batch in batches:
        k = np.concatenate([wait_k, batch.column(0).to_numpy()])
        f = np.concatenate([wait_f, batch.column(1).to_numpy()])
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1], side="left"))
        wait_k, wait_f = k[cut:], f[cut:]
        if cut:
            yield from star(k[:cut], f[:cut])
    if len(wait_k):
        yield from star(wait_k, wait_f)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within the radius; distinct: rows (fp)."""
    # a small table makes many rows: spread it first
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = spread.mapInArrow(by_batch(ball), "variant long, fp long")
    return variants.repartition("variant").sortWithinPartitions("variant").mapInArrow(links_within_variants, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row (doc_id, fp, component_id) per document.

    component_id is the smallest doc_id reachable over links of fingerprints that differ in at most
    three bits. Texts without words, empty or null, have fingerprint 0, which links like any other.
    Null doc_ids: such rows keep a row with null doc_id and count in no minimum, unless a component has
    no other id; then its component_id is null. Repeated rows each give a row. Further columns, of
    whatever name, play no part. No documents: no rows.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    sizes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(sizes.select("fp")))
    ids = sizes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    components = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = ids.join(components, "root").select("fp", "component_id")
    return fps.join(labelled, "fp").select("doc_id", "fp", "component_id")
