"""Alignment of two tokenizers' tokens by the byte offsets at which they end.

A is a byte-level BPE of the tokenizers library and gets a space before the text; B is a sentencepiece model, which adds that space
itself. The character offsets of A and the spans of sentencepiece's proto (in this version its ``offset_mapping``) are coarse
cuts. They do not tell apart the tokens of one multibyte character nor byte-fallback tokens, whose spans repeat or are empty; there the
ends follow from the lengths of the decoded bytes. Decoded bytes also tell whether the tokens say the text. In ASCII a character is a byte, so spans say what
lengths say and are not asked for.

Both tokenizers are asked once for each distinct unit: texts are cut where neither can join what lies on both sides (``Aligner``).
Where they are read, texts become groups and links; a chunk of some million links has a dictionary of its distinct id pairs, and a
link travels as its number there. Counts of the pairs are summed over all chunks, and each chunk gets back those of its own
dictionary, so nothing that grows with the corpus is broadcast or held in one task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwright.llm.common import materialize
from fieldwright.llm.rans import CUT, slices

#: Links after which a chunk is closed, at the end of the slice that brings them.
CHUNK_LINKS = 1 << 21
#: Units kept by a worker, and the longest of them.
KEPT, LONGEST = 400_000, 48
#: Units that the tokenizers are asked for at a time, and bytes of text aligned in one array operation.
ASKED, SLICE = 4096, 4 << 20
#: Stands at cuts inside a unit; texts that hold it are cut one by one.
BREAK = "\x1f"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Inside a unit: before a mark, digit or line break that follows a letter, and after a single line break before a letter.
INSIDE = re.compile(rf"(?<=[{LETTERS}])(?=[\n!-@\[-`{{-~])|(?<=[!-~{LETTERS}]\n)(?=[{LETTERS}])")
#: The same cuts as patterns with a group on either side; one that overlaps another may be left out.
CUTS = (rf"([{LETTERS}])([\n!-@\[-`{{-~])", rf"([!-~{LETTERS}]{BREAK}?\n)([{LETTERS}])")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: The result of a unit that the tokens do not say.
UNSAID = (-1, -1, b"", "")


class Aligner:
    """Aligned tokens of texts.

    A text is cut before each space that follows a letter, digit or mark, and inside these units at ``INSIDE``: A's splitting pattern has a
    boundary there whatever stands around, and B can have no token across as none of its pieces has the two characters in sequence. If
    B's pieces or A's file break that, texts are taken whole. A unit's result is (tokens of A, tokens of B, links as
    32-bit numbers a x 65536 + b, groups as text), or UNSAID.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        if max(self.a.get_vocab_size(), self.b.get_piece_size()) > 1 << 16:
            raise ValueError("ids of these vocabularies do not fit 16 bits")
        byte = byte_of_char()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(map(byte.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        joined = {p[i : i + 2] for j, p in enumerate(pieces) if not (self.b.is_byte(j) or self.b.is_control(j) or self.b.is_unknown(j)) for i in range(len(p) - 1)}
        crossing = any(x[1] == "▁" != x[0] or x[0] == "\n" or re.match(rf"[{LETTERS}][\n!-@\[-`{{-~]", x) for x in joined)
        plain = self.bytes_say(self.b.encode("\n"), b" \n") and len(self.b.encode("\n")) == 2
        self.divisible = plain and not crossing and not self.a.normalizer and not self.a.post_processor and type(self.a.pre_tokenizer).__name__ == "ByteLevel"
        self.known: dict[str, tuple] = {}

    def bytes_say(self, ids: list[int], data: bytes) -> bool:
        return b"".join(map(self.bytes_b.__getitem__, ids)) == data

    def asked(self, units: list[str], whole: bool = False) -> list[tuple]:
        """Results of units, each with its leading space if it has one. whole: units are texts with a space before them, B adds its own."""
        out: list[tuple] = [()] * len(units)
        for plain in (True, False):
            own = [i for i, u in enumerate(units) if u.isascii() == plain]
            for start in range(0, len(own), ASKED):
                at = own[start : start + ASKED]
                for i, result in zip(at, self._asked([units[i] for i in at], whole, plain)):
                    out[i] = result
        return out

    def _asked(self, units: list[str], whole: bool, plain: bool) -> list[tuple]:
        found_a = self.a.encode_batch(units, add_special_tokens=False)
        lead, skip = ("", 0) if whole else ("\n", 2)
        found_b = self.b.encode([lead + (u[1:] if whole else u) for u in units], return_type=int if plain else "offset_mapping", num_threads=1)
        of_a, of_b = [e.ids for e in found_a], [b[skip:] if plain else b["ids"][skip:] for b in found_b]
        n_a, n_b = np.array([len(x) for x in of_a], np.int64), np.array([len(x) for x in of_b], np.int64)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((of_a, n_a), (of_b, n_b)))
        data = "".join(units).encode("utf-8", "surrogatepass")
        chars = np.array([len(u) for u in units], np.int64)
        first = np.cumsum(chars) - chars
        byte_at = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))  # of each character
        starts, stops = byte_at[first], byte_at[first + chars]
        sides = []
        for n, ids, sizes, of in ((n_a, ids_a, self.sizes_a, self.bytes_a), (n_b, ids_b, self.sizes_b, self.bytes_b)):
            owner = np.repeat(np.arange(len(units)), n)
            run = np.cumsum(sizes[ids])
            before = np.concatenate([[0], run])[np.cumsum(n) - n]
            ends = run - before[owner] + starts[owner]
            says = np.ones(len(units), bool)
            decoded = list(map(of.__getitem__, ids.tolist()))
            if b"".join(decoded) != data:
                at = np.cumsum(n)
                says = np.array([b"".join(decoded[e - k : e]) == data[s:t] for e, k, s, t in zip(at.tolist(), n.tolist(), starts.tolist(), stops.tolist())], bool)
            sides.append((ends, says, owner))
        (ends_a, says_a, owner_a), (ends_b, says_b, owner_b) = sides
        if not plain:
            spans_a = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found_a)), np.int64, 2 * len(ids_a)).reshape(-1, 2)
            spans_b = np.fromiter(chain.from_iterable(chain.from_iterable(b["offsets"][skip:] for b in found_b)), np.int64, 2 * len(ids_b)).reshape(-1, 2) + (1 if whole else -1)
            # a token of A shares a character with the next if that begins before it ends; of B if its own span is empty
            last_a = np.zeros(len(ids_a), bool)
            last_a[np.cumsum(n_a)[n_a > 0] - 1] = True
            settled_a = last_a | (spans_a[:, 1] <= np.append(spans_a[1:, 0], 0))
            coarse = lambda spans, owner: byte_at[np.clip(spans[:, 1] + first[owner], 0, len(byte_at) - 1)]
            ends_a = np.where(settled_a, coarse(spans_a, owner_a), ends_a)
            ends_b = np.where(spans_b[:, 1] > spans_b[:, 0], coarse(spans_b, owner_b), ends_b)
        says = says_a & says_b
        use_a, use_b = np.flatnonzero(says[owner_a]), np.flatnonzero(says[owner_b])
        _, at_a, at_b = np.intersect1d(ends_a[use_a], ends_b[use_b], assume_unique=True, return_indices=True)
        at_a, at_b = use_a[at_a], use_b[at_b]
        pairs = (ids_a[at_a] << 16 | ids_b[at_b]).astype("<u4")
        groups = np.bincount(owner_a[at_a], minlength=len(units))
        return self._results(says, (n_a, n_b), [list(map(str, x.tolist())) for x in (ids_a, ids_b)], (at_a.tolist(), at_b.tolist()), pairs.tobytes(), groups)

    @staticmethod
    def _results(says: np.ndarray, n: tuple, names: list, at: tuple, pairs: bytes, groups: np.ndarray) -> list[tuple]:
        (a, b), (at_a, at_b), out = names, at, []
        i = x = y = 0
        for ok, n_a, n_b, k in zip(says.tolist(), n[0].tolist(), n[1].tolist(), groups.tolist()):
            if not ok:
                out.append(UNSAID)
            elif k == 1:
                out.append((n_a, n_b, pairs[4 * i : 4 * i + 4], f"{','.join(a[x : x + n_a])}|{','.join(b[y : y + n_b])}"))
            else:
                parts, p, q = [], x, y
                for j in range(i, i + k):
                    s, t = at_a[j] + 1, at_b[j] + 1
                    parts.append((a[p] if s == p + 1 else ",".join(a[p:s])) + "|" + (b[q] if t == q + 1 else ",".join(b[q:t])))
                    p, q = s, t
                out.append((n_a, n_b, pairs[4 * i : 4 * (i + k)], ";".join(parts)))
            i, x, y = i + k, x + n_a, y + n_b
        return out

    def results(self, units: list[str]) -> list[tuple]:
        """Results of distinct units; a worker keeps the first that it meets."""
        fresh = [u for u in units if u not in self.known]
        now = dict(zip(fresh, self.asked(fresh)))
        for u in fresh[: max(0, KEPT - len(self.known))]:
            if len(u) <= LONGEST:
                self.known[u] = now[u]
        return [now[u] if u in now else self.known[u] for u in units]

    def units(self, words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
        """Words with a space before each, cut: how many units each has, and the units of all in sequence."""
        led = pc.binary_join_element_wise("", words, " ")
        for pattern in CUTS:
            led = pc.replace_substring_regex(led, pattern, rf"\1{BREAK}\2")
        parts = pc.split_pattern(led, BREAK)
        return pc.list_value_length(parts).to_numpy().astype(np.int64), parts.flatten()

    def of_texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """For each text its numbers of tokens (A, B) and of links and the digest of its groups; the links of all texts in sequence."""
        texts = texts.fill_null("")
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if self.divisible:
            pieces = pc.split_pattern(texts, " ")
            counts = pc.list_value_length(pieces).to_numpy().astype(np.int64)
            words = pieces.flatten().dictionary_encode()
            codes, spelled = words.indices.to_numpy(), words.dictionary
            ends = np.cumsum(counts)
            # texts in which a space follows anything but a letter, digit or mark are cut one by one
            closed = pc.match_substring_regex(spelled, r"[!-~\pL\pN]\z").to_numpy(zero_copy_only=False)[codes]
            closed[ends - 1] = True
            alone = ~np.logical_and.reduceat(closed, ends - counts) if len(counts) else empty
            alone = ~empty & (alone | pc.match_substring(texts, BREAK).to_numpy(zero_copy_only=False))
            usual = np.repeat(~alone & ~empty, counts)
            used = np.flatnonzero(np.bincount(codes[usual], minlength=len(spelled)))
            per_word, parts = self.units(spelled.take(pa.array(used)))
            parts = parts.dictionary_encode()
            numbers, names = parts.indices.to_numpy().astype(np.int64), parts.dictionary.to_pylist()
            begin = np.cumsum(per_word) - per_word
            at = np.full(len(spelled), -1, np.int64)
            at[used] = np.arange(len(used))
            word = at[codes[usual]]
            n = per_word[word]
            sequence = numbers[np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            size = np.bincount(np.repeat(np.arange(len(texts)), counts)[usual], weights=n, minlength=len(texts)).astype(np.int64)
            known = {u: i for i, u in enumerate(names)}
            odd = [[known.setdefault(v, len(known)) for u in CUT.split(" " + texts[i].as_py()) for v in INSIDE.split(u)] for i in np.flatnonzero(alone).tolist()]
            parts = self.results(list(known))
        else:
            alone = ~empty
            size, sequence = np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
            parts = self.asked([" " + texts[i].as_py() for i in np.flatnonzero(alone).tolist()], whole=True)
            odd = [[i] for i in range(len(parts))]
        # each text as the numbers of its units
        size[alone] = [len(o) for o in odd]
        stop = np.cumsum(size)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.empty(int(size.sum()), np.int64)
        order[~alone[owner]] = sequence
        order[alone[owner]] = np.fromiter(chain.from_iterable(odd), np.int64, int(size[alone].sum()))
        ok = np.array([p is not UNSAID for p in parts], bool)
        good = np.bincount(owner[~ok[order]], minlength=len(size)) == 0 if len(order) else ~empty
        n_a, n_b, links = (np.array([f(p) for p in parts], np.int64) for f in (lambda p: p[0], lambda p: p[1], lambda p: len(p[2]) // 4))
        of_text = lambda x: np.where(good, np.bincount(owner, weights=x[order], minlength=len(size)), 0).astype(np.int64)
        strings = [p[3] for p in parts]
        sha = [
            hashlib.sha256(";".join(map(strings.__getitem__, order[e - k : e].tolist())).encode()).hexdigest() if k and g else ""
            for e, k, g in zip(stop.tolist(), size.tolist(), good.tolist())
        ]
        kept = order[good[owner]] if len(order) else order
        n = links[kept]
        begin = (np.cumsum(links) - links)[kept]
        data = np.frombuffer(b"".join([p[2] for p in parts]), "<u4")
        flat = data[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return of_text(n_a), of_text(n_b), of_text(links), sha, flat


#: Aligners of this process by their files; a worker serves many tasks.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Rows (chunk, doc_id, n_a, n_b, n_groups, groups_sha256, links, pairs, counts).

    A document's links are numbers in its chunk's dictionary, little-endian 32-bit. The dictionary itself is a row of the
    chunk in which pairs and counts are not null: the ids a x 65536 + b, 32-bit, and how many links of the chunk have each, 64-bit.
    """
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pairs", "counts"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, chunk = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        known: dict[int, int] = {}
        counts = np.zeros(0, np.int64)

        def dictionary() -> pa.RecordBatch:
            keys = np.fromiter(known, "<u4", len(known)).tobytes()
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), *nothing, pa.array([keys], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

        for batch in batches:
            for part in slices(batch, SLICE):
                n_a, n_b, n, sha, flat = work.of_texts(part.column(1))
                keys, at = np.unique(flat, return_inverse=True)
                own = np.array([known.setdefault(k, len(known)) for k in keys.tolist()], np.int64)
                numbers = own[at] if len(flat) else np.zeros(0, np.int64)
                counts = np.concatenate([counts, np.zeros(len(known) - len(counts), np.int64)]) + np.bincount(numbers, minlength=len(known))
                data, ends = numbers.astype("<u4").tobytes(), np.cumsum(n) * 4
                links = [data[s:e] for s, e in zip((ends - 4 * n).tolist(), ends.tolist())]
                columns = [pa.array(np.full(len(n), chunk)), part.column(0), pa.array(n_a), pa.array(n_b), pa.array(n), pa.array(sha, pa.string()), pa.array(links, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())], names)
                if counts.sum() >= chunk_links:
                    yield dictionary()
                    chunk, known, counts = chunk + 1, {}, np.zeros(0, np.int64)
        yield dictionary()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs binary, counts binary")


def pair_rows(tokens: DataFrame) -> DataFrame:
    """Rows (chunk, number, pair, n): the dictionaries of all chunks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, counts in zip(*[c.to_pylist() for c in batch.columns]):
                pairs = np.frombuffer(pairs, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(np.arange(len(pairs))), pa.array(pairs), pa.array(np.frombuffer(counts, "<i8"))], ["chunk", "number", "pair", "n"])

    return tokens.where("pairs is not null").select("chunk", "pairs", "counts").mapInArrow(of, "chunk long, number long, pair long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Rows (pair, links, best): how many links of all documents hold each pair of ids linked, and whether that is the highest for its B id.

    The highest of each B id are broadcast: at most as many rows as B has ids, under 65,536.
    """
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("links"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    top = counts.groupBy(b.alias("b")).agg(F.max("links").alias("top"))
    return counts.join(F.broadcast(top), b == F.col("b")).select("pair", "links", (F.col("links") == F.col("top")).alias("best"))


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Adds n_best and count_sum to the documents of a chunk; answers: its dictionary's links and best."""
    order = np.argsort(answers.column("number").to_numpy())
    count, best = answers.column("links").to_numpy()[order], answers.column("best").to_numpy()[order]
    n = docs.column("n_groups").to_numpy()
    numbers = np.frombuffer(b"".join(docs.column("links").to_pylist()), "<u4")
    ends = np.cumsum(n)
    sums = [np.concatenate([[0], np.cumsum(x[numbers], dtype=np.int64)]) for x in (count, best)] if len(numbers) else [np.zeros(1, np.int64)] * 2
    total, good = (s[ends] - s[ends - n] for s in sums)
    columns = {name: docs.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups")} | {"n_links": docs.column("n_groups"), "n_best": pa.array(good), "count_sum": pa.array(total), "groups_sha256": docs.column("groups_sha256")}
    return pa.table(columns)


def align(docs: DataFrame, path_a: str, path_b: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """One row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document.

    Tokens of A and B are cut into groups at the byte offsets where tokens of both end; at each such offset one token of A is
    linked with one of B. A pair's count is how many links of all documents hold it; n_best counts the links whose count is the highest that their B id
    has, ties included. Texts that are null or empty, or that the tokens of A or B do not say byte for byte, have zeros and ''. Texts in which special tokens stand have
    them as plain text. Very long texts are taken whole; repeated rows and null doc_ids give a row each and count each. Further columns, of whatever name,
    play no part. No documents: no rows.
    """
    tokens = materialize(aligned(docs, path_a, path_b, chunk_links), "links", compression="zstd")
    pairs = pair_rows(tokens)
    answers = pairs.join(pair_counts(pairs), "pair").select("chunk", "number", "links", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows = tokens.where("pairs is null").drop("pairs", "counts")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored, out)
