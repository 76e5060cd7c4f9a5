"""Registered queries over the tables of a folder, and SQL with equal results where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm import align, clusters, decontaminate, exact, licences, mixing, rans, shard, simhash, topk, toxicity, urls, windows

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_rans(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return rans.round_trip(table(spark, sf_dir, "documents"), tokenizer).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard.shard(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found toxic, with the probabilities of the chain."""
    rows = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.where("toxicity.toxic >= 0.5").select("doc_id", F.col("toxicity.low_quality").alias("p_low_quality"), F.col("toxicity.toxic").alias("p_toxic"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.deduplicate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path(TOKENIZER), path_b or public_tokenizers.path(PIECES)
    return align.align(table(spark, sf_dir, "documents"), path_a, path_b)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op2: sizes and targets."""
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op4: words and the places of the base phrases."""
    return op4_licences(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op10: host, path and rule."""
    return op10_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_maxscore, op2_mixing, op3_repeated_windows, op4_licences, op5_rans, op6_decontamination, op7_simhash, op8_feistel_shards, op9_toxicity, op10_url_filter, op11_exact_dedup, op12_va_clusters, op13_tokenizer_alignment, pipeline, mixing_targets, licence_base, url_rules)
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM s
), f AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM x
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM f WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d
), kept AS (
  SELECT w.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed, string_agg(w.word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS kept
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), r AS (
  SELECT 0 AS step, source, n, w, NULL::DOUBLE AS target, 1.5 * (SELECT sum(n) FROM s) AS budget FROM s
  UNION ALL
  SELECT step + 1, source, n, w, CASE WHEN target IS NOT NULL THEN target WHEN budget * w / free > 2 * n THEN 2.0 * n END,
    budget - coalesce(sum(CASE WHEN target IS NULL AND budget * w / free > 2 * n THEN 2.0 * n END) OVER (), 0)
  FROM (SELECT *, sum(CASE WHEN target IS NULL THEN w END) OVER () AS free FROM r) WHERE step < (SELECT count(*) FROM s)
), last AS (
  SELECT *, sum(CASE WHEN target IS NULL THEN w END) OVER () AS free FROM r WHERE step = (SELECT max(step) FROM r)
)
SELECT doc_id, size, n AS source_size, coalesce(target, budget * w / free)::DOUBLE AS target FROM d JOIN last ON last.source IS NOT DISTINCT FROM d.source
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT * FROM (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) AS t(phrase, label)
), h AS (
  SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS place FROM d, p WHERE list_contains(w, 'license')
), g AS (
  SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""

OP10_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM h
), r AS (
  SELECT * FROM (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/')) AS t(name, start)
)
SELECT page_id, host, path, (SELECT first(name || start ORDER BY length(name || start) DESC) FROM r WHERE ends_with('.' || host, '.' || name) AND starts_with(path, start)) AS rule FROM p
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""


def op12_sql(centroids: int = clusters.CENTROIDS, rounds: int = clusters.ROUNDS, width: int = clusters.WIDTH) -> str:
    """Each round as an assignment of all vectors to all centroids and a floor of sums; c0 holds the first centroids."""

    def assigned(c: str) -> str:
        return f"""
  SELECT vec_id, q, k, distance FROM (
    SELECT vec_id, q, k, list_sum(list_transform(range(1, {width + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT AS distance FROM v, {c}
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, k) = 1"""

    def moved(round_: int) -> str:
        return f"""a{round_} AS MATERIALIZED ({assigned(f"c{round_}")}
), c{round_ + 1} AS MATERIALIZED (
  SELECT o.k, coalesce(n.c, o.c) AS c FROM c{round_} o LEFT JOIN (
    SELECT k, list(x ORDER BY d) AS c FROM (
      SELECT k, d, ((s - ((s % n + n) % n)) // n)::BIGINT AS x FROM (SELECT k, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM a{round_}) GROUP BY k, d)
    ) GROUP BY k
  ) n USING (k)
), """

    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, q AS c FROM v QUALIFY k < {centroids}
), {"".join(moved(r) for r in range(rounds))}last AS ({assigned(f"c{rounds}")}
)
SELECT vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN c{rounds} USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_maxscore": OP1_SQL, "op3_repeated_windows": OP3_SQL, "mixing_targets": OP2_SQL, "licence_base": OP4_SQL, "url_rules": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_va_clusters": op12_sql()}
