"""run() against a plain Python version of the five stages, and the stages on nothing and on clashing names."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldwright.llm import decontaminate, shard, toxicity
from tests.llm.test_edges import brute_mix
from tests.llm.test_operators import distance
from tests.llm.test_whole import brute_kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(21)
    names = [f"{a}{b}{c}" for a in "bcdfgklm" for b in ("ano", "elu", "iro", "oma") for c in ("", "n", "s")]
    prose = lambda n: [r.choice(names) for _ in range(n)]
    items = [(i, " ".join(prose(14))) for i in range(4)]
    rows, labels = [], []
    for i in range(220):
        w = prose(r.choice([4, 30, 80]))
        if i % 6 == 0:
            w[2:2] = ["zzscum", "zzfilth"]
        if i % 11 == 1:
            w += items[i % 4][1].split()
        if i % 11 == 2:
            gone = items[i % 4][1].split()
            gone[3:4] = ["other", "words"]
            w += gone
        rows.append((i * 3, " ".join(w)))
        labels.append((i * 3, 1, int(i % 6 == 0)))
    for j in range(40):
        d, t = rows[r.randrange(len(rows))]
        w = t.split()
        if j % 2 and len(w) > 60:
            w[r.randrange(len(w))] = "changed"
        rows.append((1000 + j, " ".join(w)))
    rows += [(2000, ""), (2001, None), (2002, "lone")]
    return [(d, t, "en", f"s{d // 3 % 3}", len(t or "")) for d, t in rows], labels[:180], items


@pytest.fixture(scope="module")
def folder(spark):
    path, (rows, labels, items) = tempfile.mkdtemp(prefix="spark-corpus-"), corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_a_plain_version(spark, folder):
    rows, labels, items = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    scorer = toxicity.Scorer(toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.CATEGORIES))
    clean = [x for x in rows if scorer.score(x[1])[-1] < 0.5]
    assert {d for d, t, *_ in rows if "zzscum" in (t or "")} <= {x[0] for x in rows} - {x[0] for x in clean} and len(clean) > 180
    stay = {d for _, d in brute_kept([(d, t) for d, t, *_ in clean])[0]}
    alone = [x for x in clean if x[0] in stay]
    assert len(alone) < len(clean) - 20
    patterns = [decontaminate.words_of(t) for _, t in items]
    apart = [x for x in alone if not any(distance(p, w) <= decontaminate.budget(len(p)) for p in patterns if (w := decontaminate.words_of(x[1])))]
    assert len(apart) < len(alone) - 10
    taken = brute_mix([(d, t, s) for d, t, _, s, _ in apart], {d: q for d, q, _ in labels})
    mixed = sorted(d for d, n in taken.items() for _ in range(n))
    want = sorted((d, *shard.place(i, len(mixed))) for i, d in enumerate(mixed))
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "shard", "slot"]
    texts = {x[0]: x[1:] for x in rows}
    got = out.collect()
    assert sorted((x["doc_id"], x["shard"], x["slot"]) for x in got) == want
    assert all(tuple(x)[1:5] == texts[x["doc_id"]] for x in got)


def test_stages_take_nothing_and_keep_clashing_names(spark, folder):
    extra = {c: F.lit(f"mine {c}") for c in ("toxicity", "_h1", "_key", "size", "n", "count", "i", "h1", "c0", "_local", "_number", "before", "part")}
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in extra), name
        assert set(docs.columns) <= set(out.columns) and (name == "sharding" or out.columns == docs.columns)
        assert stage(spark, docs.where("false"), folder).count() == 0
