"""Near duplicates inside large families of texts on one template, and the recall of the whole stage by a full set join."""

import random

import numpy as np
from pyspark.sql import functions as F

from fieldwright.llm import common, decontaminate, mixing, neardup
from fieldwright.llm.common import materialize, repeated

FOLDER = "/root/testdata/sf0.1"


def family(n, seed, common=150, own=60):
    """n pairs of texts; pairs share a template, the two of a pair differ in one to four words, a similarity of 0.8 to 0.95."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    template, out = [word() for _ in range(common)], []
    for i in range(n):
        text = template + [word() for _ in range(own)]
        other = list(text)
        for k in range(1 + i % 4):
            other[20 + 40 * k + r.randrange(30)] = word()
        out += [" ".join(text), " ".join(other)]
    return out


def jaccard(a, b):
    shared = len(np.intersect1d(a, b))
    return shared / (len(a) + len(b) - shared)


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return {r.doc_id for r in neardup.keep_one(docs).select("doc_id").collect()}


def test_partners_in_a_family_of_a_thousand_texts(spark):
    texts = family(500, 3)
    sets = [neardup.shingles(t) for t in texts]
    true = [i for i in range(500) if jaccard(sets[2 * i], sets[2 * i + 1]) >= 0.8]
    assert len(true) > 450 and 0.4 < jaccard(sets[0], sets[2]) < 0.65
    kept = kept_ids(spark, texts)
    lost = [i for i in true if {2 * i, 2 * i + 1} <= kept]
    assert len(lost) <= 0.02 * len(true)
    assert all({2 * i, 2 * i + 1} & kept for i in range(500))  # no pair is lost to another


def test_texts_alike_by_nine_tenths_are_one_group_however_many(spark):
    r = random.Random(5)
    template = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(template[:200] + [f"x{i}"] + template[200:]) for i in range(400)]
    assert kept_ids(spark, texts) == {0}


def test_recall_of_the_stage_over_whole_documents(spark):
    """All pairs of a similarity of 0.8 or more in the table, by a full join of sets, against what the stage joins: at least 0.98."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    sets = {}
    for d, t in rows:
        sets.setdefault(neardup.shingles(t).tobytes(), d)
    known = [(d, np.frombuffer(s, np.uint64)) for s, d in sets.items() if s]
    # of a similar pair the rarer ninth of the shingles of either has one in common: all others are left to the index
    flat, counts = np.unique(np.concatenate([s for _, s in known]), return_counts=True)
    index, pairs = {}, set()
    for i, (_, s) in enumerate(known):
        df = counts[np.searchsorted(flat, s)]
        order = np.lexsort((s, df))[: len(s) - -(-4 * len(s) // 5) + 1]
        for h in s[order[df[order] > 1]].tolist():
            for j in index.setdefault(h, []):
                pairs.add((j, i))
            index[h].append(i)
    true = [(known[a][0], known[b][0]) for a, b in pairs if jaccard(known[a][1], known[b][1]) >= 0.8]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = docs.withColumns(dict(zip(("h1", "h2"), neardup.row_hashes(docs))))
    rows_ = marked.select("h1", "h2", "text")
    made = neardup.materialize(neardup.set_fingerprints(rows_), "sets")
    roots = {r.node: r.root for r in neardup.connected_components(neardup.set_links(made, rows_)).collect()}
    key = {r.doc_id: r.s for r in marked.join(made.select("h1", "h2", "s"), ["h1", "h2"]).select("doc_id", "s").collect()}
    met = [roots.get(key[a], key[a]) == roots.get(key[b], key[b]) for a, b in true]
    assert len(true) > 30 and np.mean(met) >= 0.98


def test_the_second_search_finds_what_the_first_leaves(spark):
    """All pairs of a few hundred sets, similar or just not, by brute force."""
    r = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"v{r.randrange(400)}" for _ in range(60)]
        for _ in range(20):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"v{r.randrange(400)}"
            texts.append(" ".join(words[: 60 - r.randrange(8)]))
    sets = {i: np.sort(neardup.shingles(t).astype(np.uint32)) for i, t in enumerate(texts)}
    members = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "s long, members binary").repartition(3)
    links = neardup.rest_links(members, spark.createDataFrame([], "a long, b long"))
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in sets:
        for j in range(i):
            if neardup.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                group[max(find(i), find(j))] = min(find(i), find(j))
    roots = {x.node: x.root for x in neardup.connected_components(links).collect()}
    assert {i: roots.get(i, i) for i in sets} == {i: find(i) for i in sets}
    assert links.where(F.col("a") == F.col("b")).isEmpty()


def test_many_equal_rows_are_made_by_many_tasks(spark):
    plan = materialize(spark.createDataFrame([("hot", 1_000_000), ("odd", 4097), ("one", 1), ("none", 0), ("exact", 4096)], "name string, n long"), "plan")
    texts = spark.createDataFrame([(n, f"text of {n}") for n in ("hot", "odd", "one", "none", "exact")], "name string, text string")
    rows = repeated(lambda part: texts.join(part, "name"), plan, F.col("n"), "i")
    got = {r.name: (r.n, r.low, r.high, r.d) for r in rows.groupBy("name").agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"), F.countDistinct("i").alias("d")).collect()}
    assert got == {"hot": (1_000_000, 1, 1_000_000, 1_000_000), "odd": (4097, 1, 4097, 4097), "one": (1, 1, 1, 1), "exact": (4096, 1, 4096, 4096)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes[-1] < 3 * sum(sizes) / 8


def test_equal_rows_in_bulk_give_the_same_results(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "hot words here and there", "a")] * 300 + [(i, f"text {i} of source", "ab"[i % 2]) for i in range(80)] + [(None, "hot words here and there", None)] * 40, "doc_id long, text string, source string").repartition(5)
    bench = spark.createDataFrame([(1, "hot words here and there"), (2, "nothing like it at all")], "item_id long, text string")
    ask = lambda: [sorted(map(str, df.collect())) for df in (mixing.mix(docs), mixing.mixed_documents(docs), decontaminate.contaminated(docs, bench))]
    want = ask()
    monkeypatch.setattr(common, "REPEATS", 16)
    assert ask() == want and len(want[2]) == 340
