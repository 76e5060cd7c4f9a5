"""Substring deduplication: Rabin-Karp hashes of every 13-word window, least document per hash.

Documents are dealt by hash into chunks of a few MB. A chunk hashes all its windows and keeps, of equal
ones, the document with the smallest id: so a window that a third of the corpus holds is one entry for each chunk.
The entries, sorted by hash, are cut into buckets of the hash range and shuffled as packed runs; a bucket finds
the smallest document of every hash and answers each run with one bit per entry: does a smaller
document have it? The answers go back to the chunks, where repeated windows merge into maximal removal
intervals and are cut from the texts. The texts are shuffled once; both passes over the chunks read that exchange.

Chunks and buckets are bounded in bytes, whatever the corpus; they grow with the square root of its
size up to 64 MB, so that runs stay worth packing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 13
#: Bytes of text in a chunk for a corpus of up to 4 GB, and at most. A bucket answers for so many times as much.
CHUNK_BYTES, MOST_BYTES, BUCKET_CHUNKS = 2 << 20, 64 << 20, 3
#: Odd multiplier of the polynomial hash modulo 2^64.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


class _WordValues(dict):
    """XXH64 of a word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def rolling(values: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Polynomial hash of each ``width`` consecutive values, modulo 2^64, by Horner's rule over all at once."""
    n = max(len(values) - width + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total *= np.uint64(BASE)
        total += values[j : j + n]
    return total ^ (total >> np.uint64(32))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of the union; starts are sorted and not empty."""
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], np.append(reach[:-1][new[1:]], reach[-1])


class Chunk:
    """The windows of some documents: for each its hash's place among the chunk's distinct hashes."""

    def __init__(self, doc_ids: list[int | None], texts: list[str | None], width: int, known: _WordValues) -> None:
        self.width = width
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(lengths) - lengths
        values = np.fromiter((known[w] for words in self.words for w in words), np.uint64, int(lengths.sum()))
        starts = np.ones(max(len(values) - width + 1, 0), bool)
        present = np.array([d is not None for d in doc_ids], bool)
        for f, n, ok in zip(self.first.tolist(), lengths.tolist(), present.tolist()):
            starts[max(f, f + n - width + 1) if ok else f : f + n] = False
        self.at = np.flatnonzero(starts)
        h = rolling(values, width)[starts]
        ids = np.array([d or 0 for d in doc_ids], np.int64)
        owner = np.repeat(ids, lengths)[self.at]
        order = np.lexsort((owner, h)) if (np.diff(ids[present]) < 0).any() else np.argsort(h, kind="stable")
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.hashes, self.owners = h[new], owner[order][new]
        self.place = np.empty(len(h), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.later = owner > self.owners[self.place]

    def cuts(self, buckets: int) -> list[int]:
        """Where the entries of each bucket end."""
        return np.searchsorted((self.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets), side="right").tolist()

    def keeps(self, answers: np.ndarray) -> list[np.ndarray]:
        """Which words of each document stay; answers: an entry is held by a document smaller than its owner."""
        gone = np.zeros(int(sum(map(len, self.words))) + 1, np.int32)
        starts = self.at[self.later | answers[self.place]]
        if len(starts):
            a, b = merged(starts, starts + self.width)
            gone[a] += 1
            gone[b] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        return [keep[f : f + len(w)] for f, w in zip(self.first.tolist(), self.words)]


def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Non-negative integers in as few bytes each as the greatest takes; that number first."""
    size = max(1, (int(values.max()).bit_length() + 7) // 8)
    return size, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def widen(size: int, data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def packed(hashes: np.ndarray, owners: np.ndarray) -> bytes:
    """A run of entries: differences of the sorted hashes, and owners above the least."""
    least = int(owners.min())
    n1, steps = narrow(np.diff(hashes, prepend=np.uint64(0)) if len(hashes) == 1 else np.append(np.uint64(0), np.diff(hashes)))
    n2, above = narrow((owners - least).view(np.uint64))
    head = np.array([len(hashes), n1, n2, least], "<i8").tobytes() + hashes[:1].astype("<u8").tobytes()
    return head + steps + above


def unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, n1, n2, least = (int(x) for x in np.frombuffer(run, "<i8", 4))
    first = np.frombuffer(run, "<u8", 1, 32)[0]
    steps = widen(n1, run[40 : 40 + n * n1]).copy()
    steps[0] = first
    return np.cumsum(steps, dtype=np.uint64), widen(n2, run[40 + n * n1 :]).view(np.int64) + least


def _runs(width: int, buckets: int):
    """Rows (bucket, chunk, run) from rows (chunk, doc_id, text) sorted by chunk and doc_id."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, ids, texts = _WordValues(), None, [], []

        def closed() -> pa.RecordBatch:
            chunk = Chunk(ids, texts, width, known)
            ends = chunk.cuts(buckets)
            cut = [(b, s, e) for b, (s, e) in enumerate(zip([0, *ends], ends)) if e > s]
            runs = [packed(chunk.hashes[s:e], chunk.owners[s:e]) for _, s, e in cut]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in cut], pa.int64()), pa.array([now] * len(cut), pa.int64()), pa.array(runs, pa.binary())], ["bucket", "chunk", "run"])

        for batch in batches:
            for c, d, t in zip(*[x.to_pylist() for x in batch.columns]):
                if c != now:
                    if ids:
                        yield closed()
                    now, ids, texts = c, [], []
                ids.append(d)
                texts.append(t)
        if ids:
            yield closed()

    return over


def _answers(key: tuple, runs: pa.Table) -> pa.Table:
    """For each run of a bucket one bit per entry: a smaller document has the window."""
    parts = [unpacked(r) for r in runs.column("run").to_pylist()]
    h, owners = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    least = np.minimum.reduceat(owners[order], np.flatnonzero(new))
    held = np.empty(len(h), bool)
    held[order] = owners[order] > least[np.cumsum(new) - 1]
    ends = np.cumsum([len(p[0]) for p in parts])
    bits = [np.packbits(held[e - len(p[0]) : e]).tobytes() for e, p in zip(ends, parts)]
    return pa.table({"chunk": runs.column("chunk"), "bucket": pa.array([key[0].as_py()] * len(bits), pa.int64()), "bits": pa.array(bits, pa.binary())})


def _cut(width: int, buckets: int):
    known = _WordValues()

    def of(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("doc_id")  # stable, nulls last
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
        chunk = Chunk(ids, texts, width, known)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
        held = np.zeros(len(chunk.hashes), bool)
        ends = chunk.cuts(buckets)
        for b, (s, e) in enumerate(zip([0, *ends], ends)):
            if e > s:
                held[s:e] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=e - s).astype(bool)
        keeps = chunk.keeps(held)
        kept = [b" ".join(compress(w, k)).decode("utf-8", "surrogatepass") for w, k in zip(chunk.words, keeps)]
        n = [len(k) for k in keeps]
        gone = [int(len(k) - k.sum()) for k in keeps]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return of


def remove_repeated_windows(docs: DataFrame, width: int = WORDS, chunk_bytes: int | None = None) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept_text) per document.

    Every word goes that lies in a window of ``width`` words whose word sequence also starts in a document
    with a smaller doc_id; windows are judged on the input. Kept words are joined by one space. Null text:
    no words. Texts shorter than a window keep all. Rows without doc_id keep all and count for no other
    row. Rows that share a doc_id do not count as smaller than each other. Repeated rows give a row each. A
    repeated window inside one document stays. Very long texts are taken whole. Further columns, of whatever name, play no part. No documents: no rows.

    Windows are told apart by 64 bits of hash: of 10^13 windows, one in a million may be taken for a repeat wrongly.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if chunk_bytes is None:
        chunk_bytes = int(min(MOST_BYTES, CHUNK_BYTES * max(1.0, math.sqrt(total / (4 << 30)))))
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(1, -(-chunks // BUCKET_CHUNKS))
    # with the task's number, so that equal rows of many files do not meet in one chunk
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("long").alias("chunk"), "doc_id", "text").repartition("chunk")
    runs = dealt.sortWithinPartitions("chunk", F.col("doc_id").asc_nulls_last()).mapInArrow(_runs(width, buckets), "bucket long, chunk long, run binary")
    answers = runs.groupBy("bucket").applyInArrow(_answers, "chunk long, bucket long, bits binary")
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(width, buckets), out)
