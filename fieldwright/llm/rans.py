"""Token ids in binary blocks coded with a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, serves all blocks. A block holds whole documents and is
independent of the others: its ids are dealt to ``LANES`` interleaved coders, whose states every
``CHECKPOINT`` steps are kept in the block with the place in the code words, so that parts of a
block can be decoded side by side (``read_parts``). Checksums cover the code words and the ids.

Texts are tokenized where they are read; from then on only ids travel. They are put in order by Spark's range
exchange over (doc_id, hash of the ids, number), so that rows of one doc_id, or equal rows, are spread like
others. The files are rows of Parquet (part, start, n, block): the block's range, the ids of that range before it,
and its own; a range's place follows from the sums of those before.

A block's bytes, all little-endian: magic, counts (documents, ids, lanes, code words, checkpoints) and
the two checksums; doc_ids and lengths; checkpoints (code words so far, states); the code words.
"""

from __future__ import annotations

import atexit
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm.common import materialize, released, remove, shared_folder

END_ID = 0
LANES = 1024
CHECKPOINT = 128
#: A block is closed when it has so many ids; a longer document has a block to itself.
BLOCK_IDS = 1 << 18
#: Frequencies add up to this power of two.
SCALE_BITS = 22
LOW = np.uint64(1 << 31)
MAGIC = b"RNS1"
HEADER = struct.Struct("<4sQQIQIII")
#: Ids that one task puts in order, on average; the number of ranges follows from it.
RANGE_IDS = 1 << 25
#: Bytes of text tokenized in one array operation; a longer text is taken alone.
SLICE_BYTES = 8 << 20


class Table:
    """Frequencies scaled to 2^SCALE_BITS; every id that occurs keeps at least one."""

    def __init__(self, counts: np.ndarray) -> None:
        total = 1 << SCALE_BITS
        held = np.flatnonzero(counts)
        if len(held) > total:
            raise ValueError("more distinct ids than the table can tell apart")
        freq = np.zeros(len(counts), np.int64)
        if len(held):
            freq[held] = 1 + np.floor(counts[held] / counts.sum() * (total - len(held))).astype(np.int64)
            freq[np.argmax(freq)] += total - freq.sum()
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._of_slot = None

    def symbols(self, slots: np.ndarray) -> np.ndarray:
        if self._of_slot is None:
            self._of_slot = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._of_slot[slots]


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words (uint32), the number of code words at each checkpoint, and the states there.

    Steps run backwards, as rANS is last in, first out; checkpoint c holds what decoding needs from step
    c x CHECKPOINT on.
    """
    steps = -(-len(ids) // LANES)
    f, s = table.freq[ids], table.start[ids]
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    n, places, states = 0, [], []
    limit_shift = np.uint64(63 - SCALE_BITS)
    bits, half = np.uint64(SCALE_BITS), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        at = slice(t * LANES, min((t + 1) * LANES, len(ids)))
        ft = f[at]
        x = state[: len(ft)]
        out = x >= ft << limit_shift
        if out.any():
            words.append((x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
            n += len(words[-1])
            x[out] >>= half
        q = x // ft
        state[: len(ft)] = (q << bits) + (x - q * ft) + s[at]
        if t % CHECKPOINT == 0:
            places.append(n)
            states.append(state.copy())
    code = np.concatenate(words) if words else np.zeros(0, np.uint32)
    return code, np.array(places[::-1], np.uint64), np.array(states[::-1], np.uint64).reshape(-1, LANES)


def decode(count: int, code: np.ndarray, places: np.ndarray, states: np.ndarray, table: Table, part: int | None = None) -> np.ndarray:
    """All ids, or those of one checkpoint's part."""
    steps = -(-count // LANES)
    first, last = (0, steps) if part is None else (part * CHECKPOINT, min((part + 1) * CHECKPOINT, steps))
    state = states[part or 0].copy() if len(states) else np.full(LANES, LOW, np.uint64)
    n = int(places[part or 0]) if len(places) else 0
    out = np.zeros(min(last * LANES, count) - first * LANES, np.int64)
    mask, bits, half = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    wide = code.astype(np.uint64)
    for t in range(first, last):
        size = min(LANES, count - t * LANES)
        x = state[:size]
        slot = x & mask
        ids = table.symbols(slot)
        out[(t - first) * LANES : (t - first) * LANES + size] = ids
        x = table.freq[ids] * (x >> bits) + slot - table.start[ids]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = x[low] << half | wide[n - len(low) : n][::-1]
            n -= len(low)
        state[:size] = x
    return out


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, table: Table) -> bytes:
    code, places, states = encode(ids, table)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(lengths, "<u8").tobytes()
    body = names + places.astype("<u8").tobytes() + states.astype("<u8").tobytes() + code.astype("<u4").tobytes()
    return HEADER.pack(MAGIC, len(doc_ids), len(ids), LANES, len(code), len(places), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


class Block:
    """The parts of a block's bytes; raises ValueError where magic or the sum of the code words does not fit."""

    def __init__(self, block: bytes) -> None:
        magic, docs, self.count, lanes, words, marks, body_sum, self.ids_sum = HEADER.unpack_from(block)
        body = memoryview(block)[HEADER.size :]
        if magic != MAGIC or lanes != LANES or zlib.crc32(body) != body_sum:
            raise ValueError("damaged block")
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        names, none, self.lengths = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        self.names = [None if no else int(d) for d, no in zip(names, none)]
        self.places, self.states, self.code = take("<u8", marks).tolist(), take("<u8", marks * lanes).reshape(marks, lanes), take("<u4", words)

    def parts(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """From each checkpoint to the next: how many ids, the code words (decoding goes down from one's place to the next's), the states."""
        step = LANES * CHECKPOINT
        return [(min(step, self.count - i * step), self.code[low:high], self.states[i]) for i, (low, high) in enumerate(zip([*self.places[1:], 0], self.places))]


def decode_part(count: int, code: np.ndarray, states: np.ndarray, table: Table) -> np.ndarray:
    return decode(count, code, np.array([len(code)]), states.reshape(1, -1), table)


def unpack(block: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a block, decoded from checkpoint to checkpoint; raises ValueError where magic or checksums do not fit."""
    b = Block(block)
    ids = np.concatenate([np.zeros(0, np.int64), *(decode_part(*p, table) for p in b.parts())])
    if zlib.crc32(ids.astype("<u4").tobytes()) != b.ids_sum:
        raise ValueError("damaged ids")
    return b.names, b.lengths, ids


#: A space after a letter, digit or punctuation mark: the vocabulary's splitting pattern always cuts before it.
CUT = re.compile(r"(?<=[!-~\w])(?= )")
OTHER = re.compile(r"(?<![!-~\w]) ")
#: What may stand before such a space.
CLOSED = re.compile(r"[!-~\w]\Z")


class _Ids(dict):
    """Packed ids of a unit; those not known are asked of the tokenizer, and the first ``bound`` are kept.

    A line break between characters that are no white space is a token of its own, and so is one comma or
    full stop after a word, so such units are put together from their parts.
    """

    def __init__(self, owner: Encoder, lead: str, bound: int) -> None:
        self.owner, self.lead, self.bound = owner, lead, bound

    def __missing__(self, unit: str) -> bytes:
        if "\n" in unit:
            parts = unit.split("\n")
            if all(p.split() == [p] for p in parts):
                return self.owner.line_break.join([self[parts[0]], *map(self.owner.first.__getitem__, parts[1:])])
        mark = self.owner.marks.get(unit[-1:])
        ids = self[unit[:-1]] + mark if mark and unit[:-1].isalpha() else self.owner.ask(self.lead + unit)
        if len(self) < self.bound and len(unit) < 48:
            self[unit] = ids
        return ids


class Encoder:
    """Ids of texts by the tokenizers library as packed 16-bit numbers, each distinct unit encoded once.

    The vocabulary's splitting pattern joins a space with what follows it, but nothing with a space that
    comes after it; so a text may be cut before each space that follows a letter, digit or punctuation
    mark, and the units be encoded alone. Texts with the string of a special token are encoded as a whole, and so
    are all texts if the tokenizer's file names another splitting, a normalizer or a post-processor.
    """

    def __init__(self, path: str, bound: int = 1_200_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.divisible = split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space") and not made.get("normalizer") and not made.get("post_processor")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_break, self.marks = self.ask("\n"), {m: self.ask(m) for m in ",."}
        self.first, self.led = _Ids(self, "", bound // 4), _Ids(self, " ", bound)

    def ask(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text or not self.divisible or any(s in text for s in self.special):
            return self.ask(text)
        if OTHER.search(text) is None:
            head, *rest = text.split(" ")
            return self.first[head] + b"".join(map(self.led.__getitem__, rest))
        return b"".join(map(self.first.__getitem__, CUT.split(text)))

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, the end id after each, and how many each has. Nulls count as empty.

        Words are told apart by Arrow's dictionary, and each distinct one is looked up once; texts in which a space
        follows anything but a letter, digit or mark are encoded one by one.
        """
        texts = texts.fill_null("")
        pieces = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(pieces).to_numpy().astype(np.int64)
        words = pieces.flatten().dictionary_encode()
        codes, units = words.indices.to_numpy(), words.dictionary.to_pylist()
        ends = np.cumsum(counts)
        firsts = ends - counts
        closed = np.array([CLOSED.search(u) is not None for u in units], bool)[codes]
        closed[ends - 1] = True
        alone = ~np.logical_and.reduceat(closed, firsts) | (not self.divisible)
        for s in self.special:
            alone |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        is_first = np.zeros(len(codes), bool)
        is_first[firsts] = True
        apart = np.repeat(~alone, counts)
        known: list[bytes] = []

        def slots(of: np.ndarray, ids: _Ids) -> np.ndarray:
            """Where the ids of each word stand in ``known``."""
            used = np.flatnonzero(np.bincount(codes[of], minlength=len(units)))
            place = np.zeros(len(units), np.int64)
            place[used] = len(known) + np.arange(len(used))
            known.extend(map(ids.__getitem__, [units[u] for u in used.tolist()]))
            return place

        at = np.where(is_first, slots(apart & is_first, self.first)[codes], slots(apart & ~is_first, self.led)[codes])
        whole = np.flatnonzero(alone)
        at[firsts[whole]] = len(known) + np.arange(len(whole))
        known.extend(self.encode(texts[i].as_py()) for i in whole.tolist())
        known.append(array("H", [END_ID]).tobytes())
        per_text = np.where(alone, 1, counts) + 1
        last = np.cumsum(per_text)
        order = np.full(int(last[-1]), len(known) - 1)
        inside = np.ones(len(order), bool)
        inside[last - 1] = False
        order[inside] = at[apart | is_first]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 2
        data = np.frombuffer(b"".join(known), "<u2")
        n = lengths[order]
        before = np.cumsum(n) - n
        ids = data[np.repeat((np.cumsum(lengths) - lengths)[order] - before, n) + np.arange(int(n.sum()))]
        return ids, np.add.reduceat(n, last - per_text)


#: Encoders of this process by tokenizer file; a worker serves many tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes in its second column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (doc_id, h, salt, n, ids, counts): ids of each document as little-endian 16-bit numbers, the end id last.

    h is a hash of the ids, salt a number in the task. One row of each task carries how often each id occurs in
    it, pairs of 64-bit numbers; elsewhere counts is null.
    """
    names = ["doc_id", "h", "salt", "n", "ids", "counts"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_all
        total, held, row = np.zeros(1 << 16, np.int64), None, 0
        for batch in batches:
            for part in slices(batch):
                ids, n = encode(part.column(1))
                total += np.bincount(ids, minlength=len(total))
                data, ends = ids.tobytes(), np.cumsum(n) * 2
                cut = [data[a:b] for a, b in zip((ends - 2 * n).tolist(), ends.tolist())]
                if held:
                    yield pa.RecordBatch.from_arrays([*held, pa.nulls(len(held[0]), pa.binary())], names)
                held = [part.column(0), pa.array([xxhash.xxh64_intdigest(c) - (1 << 63) for c in cut], pa.int64()), pa.array(np.arange(row, row + len(n))), pa.array(n), pa.array(cut, pa.binary())]
                row += len(n)
        if held:
            seen = np.flatnonzero(total)
            counts = [np.column_stack([seen, total[seen]]).astype("<i8").tobytes()] + [None] * (len(held[0]) - 1)
            yield pa.RecordBatch.from_arrays([*held, pa.array(counts, pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, h long, salt long, n long, ids binary, counts binary")


def counted(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; one row per id, so bounded by the vocabulary."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                ids, n = np.frombuffer(c, "<i8").reshape(-1, 2).T
                total[ids] += n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["id", "n"])

    found = tokens.where("counts is not null").select("counts").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(int)] = found["n"].to_numpy(int)
    return counts


def blocks(table: Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (part, start, n, block) from rows (doc_id, ids) in order; part is the task's number."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        place = held = 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts).astype(np.int64)
            columns = [pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([held], pa.int64()), pa.array([pack(names, [len(p) for p in parts], ids, table)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "start", "n", "block"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held >= BLOCK_IDS:
                    yield closed()
                    place, held, names, parts = place + held, 0, [], []
                names.append(doc_id)
                parts.append(np.frombuffer(ids, "<u2"))
                held += len(parts[-1])
        if parts:
            yield closed()

    return over


def write(docs: DataFrame, tokenizer: str, path: str, range_ids: int = RANGE_IDS) -> Table:
    """Writes the ids of all documents in ascending doc_id order as blocks under ``path``; returns the table.

    Null doc_ids come first; rows of one doc_id follow the hash of their ids. ``path``/blocks holds the blocks,
    ``path``/table the frequencies.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, tokenizer), "tokens", compression="zstd")
    counts = counted(tokens)
    table = Table(counts)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // range_ids))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("salt").asc()]
    ordered = tokens.select("doc_id", "h", "salt", "ids").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = ordered.select("doc_id", "ids").mapInArrow(blocks(table), "part int, start long, n long, block binary")
    rows.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    released(tokens)
    held = np.flatnonzero(counts)
    spark.createDataFrame(pd.DataFrame({"id": held, "n": counts[held]}), "id long, n long").coalesce(1).write.parquet(f"{path}/table")
    return table


def read_table(spark: SparkSession, path: str) -> Table:
    found = spark.read.schema("id long, n long").parquet(f"{path}/table").toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(int)] = found["n"].to_numpy(int)
    return Table(counts)


def _block_rows(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The rows of blocks, and the ids before each range: a row per range, as many as the write had tasks."""
    rows = spark.read.schema("part int, start long, n long, block binary").parquet(f"{path}/blocks")
    sums = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toPandas()
    return rows, dict(zip(sums["part"].tolist(), (sums["n"].cumsum() - sums["n"]).tolist()))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the documents in the blocks under ``path``; ids as little-endian unsigned 32-bit integers."""
    table = read_table(spark, path)
    rows, before = _block_rows(spark, path)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, block in zip(*[c.to_pylist() for c in batch.columns]):
                names, lengths, ids = unpack(block, table)
                ends = np.cumsum(lengths)
                data = ids.astype("<u4")
                cut = [data[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(before[part] + start + ends - lengths), pa.array(lengths), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return rows.select("part", "start", "block").mapInArrow(of, "doc_id long, start long, n_tokens long, ids binary")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (start, ids): the ids from each checkpoint to the next, decoded in tasks of their own.

    So a document of many blocks' length is decoded by many tasks; the rows in order of start are all ids.
    """
    table = read_table(spark, path)
    rows, before = _block_rows(spark, path)
    step = LANES * CHECKPOINT

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, block in zip(*[c.to_pylist() for c in batch.columns]):
                counts, code, states = zip(*Block(block).parts())
                starts = [before[part] + start + i * step for i in range(len(counts))]
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([x.tobytes() for x in states], pa.binary()), pa.array([x.tobytes() for x in code], pa.binary())], ["start", "count", "states", "code"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_part(n, np.frombuffer(code, "<u4"), np.frombuffer(states, "<u8"), table).astype("<u4").tobytes() for n, states, code in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["start", "ids"])

    parts = rows.select("part", "start", "block").mapInArrow(cut, "start long, count long, states binary, code binary")
    return parts.repartition("start").mapInArrow(decoded, "start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` to the shared folder and reads the files back: one row (doc_id, start, n_tokens, ids) per document.

    Null text counts as empty and has the end id alone. Repeated rows and null doc_ids each give a row. Very long
    texts are taken whole, in a block of their own. Further columns, of whatever name, play no part. No documents: no rows.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    write(docs, tokenizer, path)
    return read(spark, path)
