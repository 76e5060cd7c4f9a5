"""op9 against a plain chain: all features of all labelled texts as a dense matrix, models fitted one after the other, every document scored."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fieldwright.llm import toxicity


def names_of(text):
    out = set()
    for w in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
        out |= {"=" + w, *(w[:n] for n in (4, 5, 6) if len(w) > n)}
    return out


def corpus():
    r = random.Random(31)
    usual = [f"{a}{b}{c}" for a in "bdfglm" for b in ("ano", "elu", "iro") for c in ("", "ning", "stra")]
    docs, labels = [], []
    for i in range(260):
        words = [r.choice(usual) for _ in range(r.choice([5, 30, 120]))]
        toxic, poor = i % 5 == 0, i % 3 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(["vilescum", "rotfilth", "vileness"])
        if poor:
            words += ["clickbait", r.choice(["buynow", "hotdeal"])]
        docs.append((i, " ".join(words)))
        if i < 200:
            labels.append((i, int(not poor), int(toxic)))
    return docs + [(900, None), (901, ""), (None, "vilescum clickbait"), (3, docs[3][1])], labels + [(5000, 1, 1), (7, None, 0)]


def regression(x, y, earlier, use):
    """Weights by feature, bias, weights of the earlier categories, and the probabilities of all rows."""
    y1, y0 = use & (y == 1), use & (y == 0)
    n1, n0 = max(1, y1.sum()), max(1, y0.sum())
    with1, with0 = x[y1].sum(axis=0), x[y0].sum(axis=0)
    p1, p0 = with1 / n1, with0 / n0
    apart = np.where(with1 + with0 < 2, 0, np.abs(p1 - p0) / np.sqrt((p1 + p0) / 2 * (1 / n1 + 1 / n0) + 1e-9))
    assert (apart >= 1.5).sum() <= 3000
    told = apart >= 1.5
    odds = np.where(told, np.log((with1 + 0.5) / (n1 + 1)) - np.log((with0 + 0.5) / (n0 + 1)), 0)
    value, w, e, b = x * odds, np.zeros(x.shape[1]), np.zeros(earlier.shape[1]), 0.0
    speed = [np.zeros_like(w), np.zeros_like(e), 0.0]
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * use
    chance = lambda: 1 / (1 + np.exp(-np.clip(value @ w + earlier @ e + b, -40, 40)))
    for _ in range(150):
        error = (chance() - y) * weight
        speed[0] = 0.9 * speed[0] - 0.3 * (value.T @ error + 1e-3 * w * told)
        speed[1] = 0.9 * speed[1] - earlier.T @ error - 1e-4 * e
        speed[2] = 0.9 * speed[2] - error.sum()
        w, e, b = w + speed[0], e + speed[1], b + speed[2]
    return w * odds, b, e, chance()


def test_the_chain_equals_a_plain_one(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = dict(docs[:260])
    learned = sorted((d, int(q == 0), t) for d, q, t in labels if q is not None and d in known)
    fold = dict(spark.createDataFrame([(d,) for d, _, _ in learned], "d long").select("d", F.pmod(F.xxhash64("d"), F.lit(4)).cast("int")).collect())
    features = sorted({n for d, _, _ in learned for n in names_of(known[d])}, key=lambda n: xxhash.xxh64_intdigest(n) - (1 << 63))
    column = {n: i for i, n in enumerate(features)}

    def row(text):
        out = np.zeros(len(features))
        out[[column[n] for n in names_of(text) if n in column]] = 1
        return out

    x, folds = np.array([row(known[d]) for d, _, _ in learned]), np.array([fold[d] for d, _, _ in learned])
    poor, toxic = (np.array([m[k] for m in learned], float) for k in (1, 2))
    nothing, everyone = np.zeros((len(x), 0)), np.ones(len(x), bool)
    first = regression(x, poor, nothing, everyone)
    unsure = np.zeros(len(x))
    for f in range(4):
        unsure[folds == f] = regression(x, poor, nothing, folds != f)[3][folds == f]
    second = regression(x, toxic, unsure[:, None], everyone)
    sure = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    got = toxicity.toxicity(df, table).collect()
    assert len(got) == len(docs)
    for r in got:
        v = row(r.text)
        p = sure(v @ first[0] + first[1])
        q = sure(v @ second[0] + second[1] + second[2][0] * p)
        assert abs(r.toxicity.low_quality - p) < 1e-6 and abs(r.toxicity.toxic - q) < 1e-6
    found = {r.doc_id for r in got if r.toxicity.toxic >= 0.5}
    assert {d for d in range(200, 260) if d % 5 == 0} <= found | {d for d in range(200, 260) if d % 5 == 0 and len(known[d].split()) > 100}
    assert not found & {d for d in range(260) if d % 5}
    kept = {r.doc_id for r in toxicity.clean_documents(df, table).collect()}
    assert kept == {d for d, _ in docs} - found
