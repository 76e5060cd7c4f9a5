"""Hot groups, clashing names, long texts and passes of the corpus operators, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwright.llm import common, decontaminate, licences, mixing, shard, simhash, topk, toxicity, urls

CLASH = ["_key", "_id", "_copy", "_h1", "_h2", "_number", "_at", "_local", "_place", "_range", "size", "n", "i", "h1", "h2", "doc", "toxicity", "count", "key", "b"]


def clashing(df):
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASH if c not in df.columns})


def same_clash(rows):
    return all(r[c] == f"mine {c}" for r in rows for c in CLASH)


def prose(n, seed, words=200):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def test_a_large_family_of_fingerprints_is_linked_by_few_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 3, np.uint64)
    fps = [np.uint64(int(b) ^ (1 << int(i)) ^ (1 << int(j))) for b in base for i, j in r.integers(0, 64, (120, 2))]
    keys = np.zeros(len(fps), np.int64)
    a, b = simhash._verified(keys, np.array(fps, np.uint64))
    assert len(a) < len(fps) and (np.bitwise_count(a ^ b) <= simhash.RADIUS).all()
    distinct = sorted(set(map(int, fps)))
    group = {x: x for x in distinct}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if (x ^ y).bit_count() <= simhash.RADIUS:
                group[max(find(x), find(y))] = min(find(x), find(y))
    want = {}
    for x in distinct:
        want.setdefault(find(x), set()).add(x)
    x, y = common.local_stars(a.view(np.int64), b.view(np.int64))
    got = {int(v): {int(v)} for v in np.array(distinct, np.uint64).view(np.int64)}
    for m, root in zip(x.tolist(), y.tolist()):
        got[root] |= got.pop(m)
    assert sorted(map(len, got.values())) == sorted(map(len, want.values()))


def test_numbers_of_hot_and_null_ids(spark):
    rows = [(7, "same")] * 500 + [(None, f"t{i}") for i in range(400)] + [(i, f"x{i}") for i in range(300)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = common.numbered(docs, [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()], "place").collect()
    assert sorted(r["place"] for r in got) == list(range(len(rows))) and same_clash(got)
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["place"])]
    assert ordered == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))


def test_shards_equal_brute_force(spark):
    rows = [(i * 3 % 101, f"text {i}") for i in range(101)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = shard.shard(docs).collect()
    assert same_clash(got)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == {d: shard.place(i, len(rows)) for i, d in enumerate(sorted(d for d, _ in rows))}


def brute_mix(rows, quality):
    """Selection by keys in order: which documents a source takes once more."""
    import hashlib

    size = lambda t: len((t or "").split())
    sources = sorted({s for _, _, s in rows})
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    from tests.llm.test_operators import brute_targets

    target, taken = brute_targets(sizes), {}
    for s in sources:
        epochs = min(2, int(target[s] // sizes[s]))
        left, before = target[s] - epochs * sizes[s], 0
        key = lambda d: -math.log((int(hashlib.sha256(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / {1: 2.0, 0: 0.5}.get(quality.get(d), 1.0)
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: key(r[0])):
            n = size(t)
            once = epochs < 2 and before + n / 2 <= left
            taken[d] = epochs + once
            before += n
    return taken


def test_the_mix_equals_brute_force_and_keeps_clashing_names(spark):
    rows = [(i, prose(5 + i % 40, i), f"s{i % 5 if i % 7 else 0}") for i in range(300)]
    quality = {i: i % 2 for i in range(0, 300, 3)}
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    marks = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    want = brute_mix(rows, quality)
    got = mixing.mix(docs, marks).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == want and len(got) == len(rows)
    copies = mixing.mixed_documents(docs, marks).collect()
    assert len(copies) == sum(want.values()) and same_clash(copies)


def test_repeated_rows_of_a_mix_share_what_the_budget_leaves(spark):
    rows = [(None, "one two three", "a")] * 50 + [(i, "four five", "b") for i in range(10)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(got) == 60
    mine = [r for r in got if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3 and len({r["copies"] for r in mine}) <= 2


def test_passes_over_a_benchmark_do_not_show(spark, monkeypatch):
    items = [(i, prose(12, 100 + i)) for i in range(9)] + [(3, prose(12, 500)), (2, prose(12, 102))]
    long = prose(40_000, 1) + " " + items[4][1] + " " + prose(10, 2)
    rows = [(1, "x " + items[0][1]), (1, "x " + items[0][1]), (None, items[3][1]), (None, items[3][1]), (2, "clean"), (2, items[9][1] + " " + items[1][1]), (3, long), (4, None), (5, "")]
    docs, bench = clashing(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")
    ask = lambda: sorted(map(str, decontaminate.contaminated(docs, bench).collect()))
    stay = lambda: sorted((str(r["doc_id"]), r["text"]) for r in decontaminate.decontaminated(docs, bench).collect())
    found, clean = ask(), stay()
    assert len(found) == 7 and clean == [("2", "clean"), ("4", None), ("5", "")]
    assert same_clash(decontaminate.decontaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 1)
    assert ask() == found and stay() == clean


def test_top_k_with_a_hot_vector_and_large_components(spark):
    r = random.Random(3)
    rows = [(50, [1.0, 2.0])] * 700 + [(100, [0.5, 0.5])] + [(i, [r.uniform(-2, 2), r.uniform(-2, 2)]) for i in range(101, 900)]
    got = {}
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    q = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    for d, v in {d: v for d, v in rows if d % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(q(v), q(w))), e) for e, w in rows if e != d)[:5]
        assert sorted(got[d]) == [(i + 1, e, -s) for i, (s, e) in enumerate(best)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [3e38]), (1, [3e38])], "vec_id long, embedding array<float>"))


def test_licences_of_long_repeated_and_clashing_rows(spark):
    long = prose(30_000, 5) + " released under the MIT License. " + prose(30_000, 6)
    rows = [(1, long), (2, "apache license"), (2, "apache license"), (None, None), (3, "")]
    got = licences.scan(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == 5
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_words"], by[1]["first_word"], by[1]["labels"]) == (60_005, 30_003, "mit") and by[2]["base_labels"] == "apache" and by[3]["n_words"] == 0


def test_toxicity_learns_from_the_end_of_a_long_text(spark):
    names = [f"{a}{b}" for a in "bcdfgk" for b in ("ano", "elu", "iro")]
    r = random.Random(2)
    rows = []
    for i in range(120):
        w = [r.choice(names) for _ in range(30)] + ([f"u{i}x{j}" for j in range(3000)] if i % 10 == 0 else [])
        rows.append((i, " ".join(w + (["zzscum"] if i % 3 == 0 else []))))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    docs = clashing(spark.createDataFrame([*rows, (200, "bano zzscum"), (201, "bano elu"), (201, "bano elu"), (None, None)], "doc_id long, text string"))
    kept = toxicity.clean_documents(docs, labels).collect()
    assert same_clash(kept) and sorted(str(r["doc_id"]) for r in kept if r["doc_id"] in (200, 201, None)) == ["201", "201", "None"]
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None and r["doc_id"] < 120} == {i for i in range(120) if i % 3}
    chain = toxicity.train(docs, labels, toxicity.CATEGORIES)
    assert sum(len(m.hashes) for m in chain.models) > 0


def test_urls_of_any_length_and_rules_of_equal_length(spark):
    rows = [(1, "http://a.net/es/" + "x" * 200_000), (2, "http://b.net/fr/?"), (3, "HTTP://WWW.Example.COM/en/"), (4, "://"), (4, "://")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in (1, 2, 3, 4)] == ["net/es/", "net/fr/", "www.example.com/en/", None] and len(got[1]["path"]) == 200_004


def test_url_labels_are_not_taken_from_the_pages(spark):
    hosts = {urls_host(r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()}
    names = {h.split(".")[-3] for h in hosts if h.count(".") >= 2}
    assert not {u.split("/")[0].split(".")[-2] for u in urls.UNWANTED + urls.WANTED} & names


def urls_host(url):
    return url.split("://")[1].split("/")[0].split("?")[0].split("#")[0]
