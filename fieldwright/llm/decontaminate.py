"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared as sequences of words, lower-cased, without punctuation. An item of L words
may stand in a document with up to k = floor(L x ``ERRORS``) words changed, added or left out. Cut into
k + 1 pieces, at least one piece then stands there unchanged; such pieces are looked up by hash, and
each hit is verified with Myers' bit-parallel distance of the item to the words around it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwright.llm.common import materialize, repeated

#: Share of an item's words that may differ.
ERRORS = 0.2
WORD = re.compile(r"[^\W_]+")
#: Items compared in one pass over the documents, and the bytes of their texts; more items take more passes.
PASS_ITEMS = 20_000
PASS_BYTES = 32_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def budget(length: int, errors: float = ERRORS) -> int:
    return int(length * errors)


def pieces(length: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces (start, length) of nearly equal length."""
    cuts = [length * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the end of the first such part."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        x = peq.get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn, hp = vp & d0, vn | ~(vp | d0) & full
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0 & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """Word numbers of items and an index of their pieces by length and hash."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS) -> None:
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[int, list[int], int]] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if not ids:
                continue
            k = budget(len(ids), errors)
            self.items.append((item_id, ids, k))
            for start, n in pieces(len(ids), k):
                h = int(self.hashes(np.array(ids[start : start + n], np.uint64), n)[0])
                found.setdefault(n, []).append((h, len(self.items) - 1, start))
        self.index = {}
        for n, entries in found.items():
            entries.sort()
            self.index[n] = (np.array([e[0] for e in entries], np.uint64), entries)

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for j in range(n):
            total = (total ^ ids[j : j + len(total)]) * BASE
            total ^= total >> np.uint64(29)
        return total

    def matches(self, text: str | None) -> dict[int, tuple[int, int]]:
        """For each item found: its least number of changed words and the word where that part ends."""
        numbers = self.numbers
        ids = np.array([numbers.get(w, 0) for w in words_of(text)], np.uint64)
        out: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (keys, entries) in self.index.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])  # windows of words that items have
            if not len(at):
                continue
            h = self.hashes(ids, n)[at]
            left = np.searchsorted(keys, h)
            hit = keys[np.minimum(left, len(keys) - 1)] == h
            right = np.searchsorted(keys, h[hit], side="right")
            for place, first, last in zip(at[hit].tolist(), left[hit].tolist(), right.tolist()):
                for _, item, start in entries[first:last]:
                    item_id, pattern, k = self.items[item]
                    begin, best = place - start, out.get(item_id, (k + 1, 0))[0]
                    if (item, begin) in tried or not best:
                        continue
                    tried.add((item, begin))
                    low = max(0, begin - k)
                    distance, end = myers(pattern, ids[low : begin + len(pattern) + k].tolist())
                    if distance <= k and distance < best:
                        out[item_id] = (distance, low + end)
        return out


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct items by pass, one pass at a time; a pass is bounded by ``PASS_ITEMS`` and ``PASS_BYTES`` on average."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-count // PASS_ITEMS), -(-size // PASS_BYTES))
    for number in range(passes):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()
        yield sorted((r["item_id"], r["text"]) for r in some)


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """Rows (doc_id, item_id, edits, end_word), one for each document row and item that stands in it.

    edits is the number of words to change, add or leave out; end_word where the first best part ends. Null
    and empty texts match nothing, nor do items without words; items of fewer than five words must
    stand unchanged. Null item_ids are left out. Equal items count once; of rows with one
    item_id each text counts and the best match is told. Repeated documents give repeated rows, null doc_ids rows like
    others. Very long texts are searched whole. Further columns, of whatever name, play no part. No rows on either
    side: no rows.

    The items of a pass go to all tasks; a larger benchmark is dealt by hash to as many passes as it needs. A
    document row is told by its doc_id and a hash of its text, and copies are counted, so passes do not show.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [_one_pass(rows, items, errors).withColumn("pass", F.lit(number)) for number, items in enumerate(_passes(benchmark))]
    best = F.min(F.struct("edits", "end_word")).alias("m")
    key = ["doc_id", "h1", "h2", "item_id"]
    of_pass = reduce(DataFrame.union, parts).groupBy(*key, "pass").agg(best, F.count(F.lit(1)).alias("n"))
    found = of_pass.groupBy(*key).agg(F.min("m").alias("m"), F.max("n").alias("n"))
    plan = materialize(found.select("doc_id", "item_id", "m.edits", "m.end_word", "n"), "found")
    return repeated(lambda part: part, plan, F.col("n"), "i").select("doc_id", "item_id", "edits", "end_word")


def _one_pass(rows: DataFrame, items: list[tuple[int, str]], errors: float) -> DataFrame:
    indexes: list[Items] = []

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not indexes:
            indexes.append(Items(items, errors))
        for batch in batches:
            out = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t and (matches := indexes[0].matches(t)):
                    h1, h2 = struct.unpack("<qq", xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
                    out += [(d, h1, h2, item, *m) for item, m in matches.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], ["doc_id", "h1", "h2", "item_id", "edits", "end_word"])

    return rows.mapInArrow(of, "doc_id long, h1 long, h2 long, item_id long, edits long, end_word long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The documents in which no item stands, with all their columns.

    Each row is judged by its own text and nothing else, so null or repeated doc_ids and clashing names do not
    matter; items and texts as in ``contaminated``. Rows are filtered where they are read; a benchmark of several
    passes has the rows written between them. No documents: no rows; no items: all documents.
    """

    def clean(items: list[tuple[int, str]]):
        indexes: list[Items] = []

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not indexes:
                indexes.append(Items(items, errors))
            for batch in batches:
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([not (t and indexes[0].matches(str(t))) for t in texts], pa.bool_()))

        return of

    at = docs.columns.index("text")
    for number, items in enumerate(_passes(benchmark)):
        docs = (materialize(docs, "clean") if number else docs).mapInArrow(clean(items), docs.schema)
    return docs
