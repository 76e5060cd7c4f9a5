"""op11 to op13 against plain Python and SQL: histories, VA-file rounds, alignments, and the cases their docstrings define."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldwright.llm import align, clusters, exact, queries

FOLDER = "/root/testdata/sf0.01"


def clash(df):
    return df.withColumns({c: F.lit(f"mine {c}") for c in ("_row", "row", "digest", "n", "size", "bucket", "part", "cluster", "norm", "links", "pairs", "member", "keep_id") if c not in df.columns})


def by_sql(name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name,of", [("op11_exact_dedup", "documents"), ("op12_va_clusters", "embeddings")])
def test_queries_equal_their_sql(spark, name, of):
    columns, theirs = by_sql(name, of)
    mine = [tuple(r) for r in queries.queries()[name](spark, FOLDER).select(*columns).collect()]
    assert sorted(mine) == sorted(theirs)


# op11


def flat(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_groups(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[flat(t)].append(d)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(d, min(known, default=None), len(ids), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()) for d in ids]
    return out


def copies():
    r = random.Random(3)
    rows = [(i, f"text {r.randrange(40)}{r.choice([' ', '  ', chr(10), chr(9)])}end{r.choice(['', ' ', chr(13)])}") for i in range(600)]
    rows += [(r.randrange(2000), "the hot  text") for _ in range(700)]
    return rows + [(None, "text 1 end"), (None, "only null"), (None, "only\nnull"), (5, None), (9, ""), (4, " "), (2, "\t\n"), (7, "nb sp"), (8, "nb sp"), (3, "same"), (3, "same"), (700, "x" * 200_000), (701, "x" * 200_000)]


@pytest.mark.parametrize("bucket", [1 << 16, 3])
def test_groups_of_equal_texts(spark, monkeypatch, bucket):
    monkeypatch.setattr(exact, "BUCKET", bucket)
    docs = clash(spark.createDataFrame(copies(), "doc_id long, text string").repartition(7))
    got = exact.deduplicate(docs).withColumn("digest", F.lower(F.hex("digest"))).collect()
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got))) == sorted(map(str, plain_groups(copies())))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.digest for r in got}) == len({r.digest for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_no_documents_and_no_ids(spark):
    assert exact.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = exact.deduplicate(spark.createDataFrame([(None, "a"), (None, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.group_size, r.kept) for r in got) == [(1, True), (2, False), (2, True)]


@pytest.mark.parametrize("bucket", [1 << 16, 2])
def test_new_documents_of_a_batch(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(exact, "BUCKET", bucket)
    rows = copies()
    old, new = rows[:300], rows[300:]
    index = exact.write_history(spark.createDataFrame(old, "doc_id long, text string"), str(tmp_path / "history"))
    got = exact.new_documents(clash(spark.createDataFrame(new, "doc_id long, text string").repartition(3)), index).collect()
    seen = {flat(t) for _, t in old}
    fresh = collections.defaultdict(list)
    for d, t in new:
        if flat(t) not in seen:
            fresh[flat(t)].append(d)
    want = sorted(str(min((i for i in ids if i is not None), default=None)) for ids in fresh.values())
    assert sorted(str(r.doc_id) for r in got) == want and len({flat(r.text) for r in got}) == len(got)
    assert all(r.member == "mine member" and r._row == "mine _row" for r in got)


def test_a_perfect_hash_is_minimal_and_its_slots_tell_nonmembers():
    words = np.random.default_rng(2).integers(0, 1 << 63, (20_000, 4), np.uint64)
    known, others = words[:12_000], words[12_000:]
    h = exact.PerfectHash.of(known)
    assert sorted(h.slots(known).tolist()) == list(range(12_000))
    order = np.empty_like(known)
    order[h.slots(known)] = known
    at = h.slots(others)
    assert at.max() < 12_000 and not (order[at[at >= 0]] == others[at >= 0]).all(axis=1).any()
    assert exact.PerfectHash.of(known[:0]).slots(others).tolist() == [-1] * 8_000


# op12


def plain_clusters(rows, k=40, rounds=5, width=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in named[:k]]
    if not c:
        return []

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), a in zip(kept, at) if a == j] for j in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g)] if g else m for g, m in zip(groups, c)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, j in found:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found]


def vectors(width=64, n=150):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(0, 0.2, width).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.25] * width) for i in range(60)] + [(3, rows[3][1]), (None, rows[5][1]), (None, [0.5] * width), (2000, None), (2001, []), (2002, [0.1] * (width - 1)), (2003, [None] + [0.1] * (width - 1)), (2004, [float("nan")] * width), (2005, [float("inf")] + [0.0] * (width - 1)), (2006, [50.0] * width)]
    return rows


@pytest.mark.parametrize("width,k", [(64, 40), (3, 5), (3, 400)])
def test_clusters(spark, width, k):
    df = clash(spark.createDataFrame(vectors(width), "vec_id long, embedding array<float>").repartition(4))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = [tuple(r) for r in clusters.cluster(df, centroids=k, width=width).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_clusters(rows, k, width=width)))


def test_no_vectors_no_ids_and_huge_components(spark):
    schema = "vec_id long, embedding array<double>"
    assert clusters.cluster(spark.createDataFrame([], schema)).collect() == []
    assert clusters.cluster(spark.createDataFrame([(None, [0.1] * 64), (1, [0.1])], schema)).collect() == []
    with pytest.raises(ValueError):
        clusters.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema))


def test_intervals_hold_the_distances():
    r = np.random.default_rng(6)
    x, c = np.round(r.normal(0, 40, (500, 64))).astype(np.int64), np.round(r.normal(0, 30, (40, 64))).astype(np.int64)
    bounds = clusters.cell_bounds(x[:100], x.min(axis=0), x.max(axis=0), clusters.BITS)
    cells = np.stack([np.searchsorted(b[1:-1], column, side="right") for b, column in zip(bounds, x.T)], axis=1)
    assert (clusters.unpacked_cells(pa.array([b.tobytes() for b in clusters.packed_cells(cells)]), 64) == cells).all()
    least, most = clusters.intervals(cells, (x * x).sum(axis=1), *clusters.tables(bounds, c))
    exact_ = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (least <= exact_).all() and (exact_ <= most).all()


# op13


def plain_alignment(docs, path_a, path_b):
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    b_model, a_model = sentencepiece.SentencePieceProcessor(model_file=path_b), Tokenizer.from_file(path_a)
    a_model.encode_special_tokens = True
    # the library's own splitting, asked for each byte that is a character
    byte = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0]: i for i in range(128)}
    for i in range(128, 0x800):
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0]
        byte.update(zip(shown, chr(i).encode()))
    for i in range(0xC0, 0x10FFFF, 0x1000):
        if not 0xD800 <= i < 0xE000:
            byte.update(zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0], chr(i).encode()))
    rows, counts = [], collections.Counter()
    for d, t in docs:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        said_a = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        said_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(said_a) == b"".join(said_b) == (" " + t).encode():
            rows.append((d, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
        links, groups, x, y = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(e), ends_b.index(e)
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            x, y = i + 1, j + 1
        counts.update(links)
        rows.append((d, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(d, n_a, n_b, len(ls), len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for d, n_a, n_b, ls, sha in rows]


def odd_texts():
    r = random.Random(8)
    letters = "abAZé ñß  \n\n\t.,'!?0123<>|日本語𝒳👩‍👧é ​\x00\x85 $€sStd"
    words = ["the", "don't", "x's", "it's", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "e.g.", "U.S.", "Hello,", "wörld.\nNext", "a\n\nb", "x\ny", "1,000.5", "日本", "—", "“q”", " ", "", "\n", "end.\n ", "a\tb", "''s", "naïve-co_op", "🙂🙂", "ﬁx", "Ω", "ÉTÉ!!\nQui", "a1b2"]
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 40)))) for i in range(1500)]
    rows += [(10_000 + i, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(1500)]
    rows += [(20_000, None), (20_001, ""), (20_002, " "), (20_003, "   "), (20_004, "has ▁ inside"), (None, "no id"), (7, "same words"), (7, "same words"), (20_005, "abc" * 4000), (20_006, "日本" * 2000), (20_007, "hot words " * 3000)]
    return rows


@pytest.fixture(scope="module")
def vocabularies():
    P = pytest.importorskip("public_tokenizers")
    return P.path(queries.TOKENIZER), P.path(queries.PIECES)


@pytest.mark.parametrize("chunk_links", [align.CHUNK_LINKS, 2000])
def test_alignment(spark, vocabularies, chunk_links):
    rows = odd_texts()
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = [tuple(r) for r in align.align(docs, *vocabularies, chunk_links=chunk_links).collect()]
    want = plain_alignment(rows, *vocabularies)
    assert sorted(map(str, got)) == sorted(map(str, want))
    by_id = {r[0]: r for r in got}
    assert by_id[20_004][1:] == (0, 0, 0, 0, 0, 0, "") == by_id[20_000][1:] == by_id[20_001][1:] and by_id[20_002][1] > 0


def test_texts_taken_whole_are_aligned_alike(vocabularies):
    texts = pa.array([t for _, t in odd_texts()[::7]] + ["ends in 𝒳", "𝒳𝒳 x"])
    cut, whole = align.Aligner(*vocabularies), align.Aligner(*vocabularies)
    assert cut.divisible
    whole.divisible = False
    for mine, theirs in zip(cut.of_texts(texts), whole.of_texts(texts)):
        assert list(mine) == list(theirs)


def test_alignment_of_whole_documents(spark, vocabularies):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id % 5 = 0").collect()]
    got = [tuple(r) for r in align.align(docs.where("doc_id % 5 = 0"), *vocabularies).collect()]
    assert sorted(got) == sorted(plain_alignment(rows, *vocabularies))


def test_alignment_of_no_documents(spark, vocabularies):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), *vocabularies).collect() == []
