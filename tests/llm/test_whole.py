"""Nothing is cut: cases in which an earlier bound or key lost results."""

import random

from fieldwright.llm import licences


def test_a_file_with_many_licences_keeps_every_label(spark):
    every = " ".join(t.text for t in licences.TEMPLATES)
    # all template words first, in an order in which no template stands, then one licence
    words = sorted({w for t in licences.TEMPLATES for w in t.text.split()}, reverse=True)
    one = [" ".join(words) + " . " + t.text for t in licences.TEMPLATES]
    rows = spark.createDataFrame(list(enumerate([every, *one])), "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licences.scan(rows).collect()}
    assert got[0] == {t.label for t in licences.TEMPLATES}
    assert all(t.label in got[i + 1] for i, t in enumerate(licences.TEMPLATES))


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_kept(rows):
    """Texts and ids that stay: of each component of five-word Jaccard >= 0.8 the smallest id, null last."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not union or 5 * shared >= 4 * union:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    found = {}
    for i, (d, t) in enumerate(rows):
        found.setdefault(find(i), []).append((d, t))
    return [min(((d is None, d or 0) for d, _ in g)) for g in found.values()], found.values()


def near_rows():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(400)}"
    rows = []
    for base in range(40):
        w = [word() for _ in range(r.choice([3, 30, 120, 400]))]
        rows.append((None, " ".join(w)))
        for copy in range(r.randrange(4)):
            x = list(w)
            for _ in range(r.randrange(1, 2 + len(w) // 40)):
                x[r.randrange(len(x))] = word()
            rows.append((None, " ".join(x).upper() if copy == 2 else " ".join(x)))
    common = " ".join(word() for _ in range(40))
    rows += [(None, common + " " + " ".join(word() for _ in range(r.choice([5, 9, 12, 60])))) for _ in range(70)]
    r.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)] + [(900, None), (901, ""), (902, " \n")]


def test_stage_keeps_one_of_each_group_at_eight_tenths(spark):
    import corpus_pipeline

    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, docs, "").collect()]
    expected, groups = brute_kept(rows)
    assert sorted(got) == sorted(d for _, d in expected)
    assert 60 < len(groups) < len(rows) - 30
    assert corpus_pipeline.simhash_stage(spark, docs.where("false"), "").count() == 0


def test_stage_loses_no_text_under_null_or_repeated_ids(spark):
    import corpus_pipeline

    r = random.Random(12)
    texts = [" ".join(f"v{r.randrange(300)}" for _ in range(40)) for _ in range(30)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    # copies: under null with an id elsewhere, twice under one null, twice in equal rows
    rows += [(None, texts[2]), (None, texts[0]), (8, texts[2]), (7, texts[1]), (None, texts[1])]
    rows = [(d, t, f"s{i % 2}") for i, (d, t) in enumerate(rows)]
    runs = [sorted(map(tuple, corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n), "").collect()), key=str) for n in (1, 7)]
    assert runs[0] == runs[1]
    expected, _ = brute_kept([(d, t) for d, t, _ in rows])
    assert sorted(t for _, t, _ in runs[0]) == sorted(texts)
    assert sorted((d is None, d or 0) for d, _, _ in runs[0]) == sorted(expected)
