"""The registered queries of these operators over the standard tables, with their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm import (
    decontaminate,
    jaccard,
    language,
    license,
    lines,
    mixing,
    negatives,
    runs,
    shards,
    simhash,
    tokens,
    topk,
    warc,
)

SHARDS = 40
ENTROPY = 0.95
QUERIES_MOD = 20
ANCHORS_MOD = 100
MOVED_MOD = 7
LABELS = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("id") % QUERIES_MOD == 0))


OP1_SQL = f"""
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERIES_MOD} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {topk.K}
"""


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), entropy=ENTROPY)


OP2_SQL = f"""
WITH r AS MATERIALIZED (
  SELECT doc_id, source, doc_id::VARCHAR AS key,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS tokens
  FROM documents
), totals AS MATERIALIZED (
  SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM r GROUP BY source HAVING sum(tokens) > 0
), s AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens)::DOUBLE FROM totals) AS p FROM totals),
tried AS (
  SELECT k, ln(sum(pow(p, k * 8.0 / 1048576)))
    - sum(pow(p, k * 8.0 / 1048576) * ln(pow(p, k * 8.0 / 1048576))) / sum(pow(p, k * 8.0 / 1048576)) AS h
  FROM s, range(1048577) t(k) GROUP BY k
), best AS MATERIALIZED (
  SELECT coalesce(max(k), 0) * 8.0 / 1048576 AS a FROM tried
  WHERE h >= {ENTROPY} * ln((SELECT count(*) FROM s)) - 1e-12
), weighed AS (
  SELECT s.*, pow(p, a) / (SELECT sum(pow(p, a)) FROM s, best) AS weight FROM s, best
), plan AS MATERIALIZED (
  SELECT source, tokens, weight, ceil(n / {mixing.PER_BLOCK}.0)::BIGINT AS blocks,
    floor(weight * (SELECT sum(tokens)::DOUBLE FROM s))::BIGINT // tokens AS passes,
    floor(weight * (SELECT sum(tokens)::DOUBLE FROM s))::BIGINT % tokens AS rest
  FROM weighed
), keyed AS (
  SELECT r.*, weight, blocks, passes, rest,
    ('0x' || substr(md5('11:' || passes || ':' || key), 1, 12))::BIGINT AS h
  FROM r JOIN plan ON r.source IS NOT DISTINCT FROM plan.source
), upto AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h) AS filled FROM keyed
), used AS (
  SELECT *, unnest(range(passes + CASE WHEN filled <= rest THEN 1 ELSE 0 END))::BIGINT AS epoch FROM upto
)
SELECT doc_id, source, tokens AS n_tokens, round(weight, 6) AS weight, epoch,
  floor(('0x' || substr(md5('11:' || epoch || ':' || key), 1, 12))::BIGINT * blocks / 281474976710656.0)::BIGINT
    AS block
FROM used
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(_table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH l AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT doc_id, i, ('0x' || substr(md5(trim(line, ' ')), 1, 7))::BIGINT AS hash
  FROM l WHERE trim(line, ' ') <> ''
), n AS (
  SELECT doc_id, i, lead(i) OVER d AS j, row_number() OVER d AS place,
    (hash * 31 + lead(hash) OVER d) % 2147483647 % {lines.DIVISOR} <> 0 AS boundary
  FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), p AS MATERIALIZED (
  SELECT n.*, array_to_string(list_slice(string_split(text, chr(10)), i, j), chr(10)) AS chunk
  FROM n JOIN documents USING (doc_id) WHERE j IS NOT NULL
), anchors AS MATERIALIZED (
  SELECT * FROM p WHERE boundary QUALIFY count(*) OVER (PARTITION BY chunk) > 1
), beside AS (
  SELECT DISTINCT doc_id, unnest([place - 1, place + 1]) AS place FROM anchors
), grown AS (
  SELECT p.* FROM p SEMI JOIN beside USING (doc_id, place) WHERE NOT boundary
  QUALIFY count(*) OVER (PARTITION BY chunk) > 1
), later AS MATERIALIZED (
  SELECT * FROM (SELECT * FROM anchors UNION ALL SELECT * FROM grown)
  QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later
), rebuilt AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS removed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
), chunks AS (SELECT doc_id, count(*) FILTER (boundary) AS n FROM p GROUP BY doc_id),
dropped AS (SELECT doc_id, count(*) AS n FROM later GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(chunks.n, 0) AS n_chunks,
  coalesce(dropped.n, 0) AS removed_chunks, coalesce(removed_lines, 0) AS removed_lines, r.text
FROM documents d LEFT JOIN rebuilt r USING (doc_id) LEFT JOIN chunks USING (doc_id) LEFT JOIN dropped USING (doc_id)
"""


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_passages(_table(spark, sf_dir, "documents"))


PASSAGES_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT doc_id, i, lead(i, {lines.MIN_LINES - 1}) OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM l WHERE trim(line, ' ') <> ''
), w AS (
  SELECT doc_id, i, j, array_to_string(list_slice(string_split(text, chr(10)), i, j), chr(10)) AS passage
  FROM f JOIN documents USING (doc_id) WHERE j IS NOT NULL
), nth AS (
  SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) AS nth FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM nth WHERE nth > 1
), rebuilt AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS removed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines, r.text
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(_table(spark, sf_dir, "documents"), SHARDS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.withColumn("score", F.round("score", 6))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs)
    return (
        language.predict(docs, model)
        .withColumn("held_out", language.held_out("doc_id"))
        .select("doc_id", "held_out", "lang_pred", "score", "n_words", F.size("runs").alias("n_runs"))
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(_table(spark, sf_dir, "pages")).filter(F.col("kind") == "record")
    return read.select(
        warc.id_of(F.col("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        warc.id_of(F.col("refers_to")).cast("long").alias("refers_to"),
    )


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, array_to_string(list_transform(range(8), lambda i:
    array_to_string(list_transform(range(4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, 5 * i::INTEGER + 1, 5))::INTEGER >> (15 - 5 * j::INTEGER)) & 31) + 1, 1)), '')), '')
    AS payload_digest
  FROM p
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ \\t\\n\\x0B\\f\\r]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < {jaccard.WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {jaccard.WIDTH} + 2),
      lambda i: array_to_string(list_slice(w, i, i + {jaccard.WIDTH} - 1), ' '))) END AS s
  FROM w
), e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
both_ways AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {jaccard.PERCENT} * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(least.b, doc_id)) AS component_id,
  coalesce(links.n, 0)::BIGINT AS n_links
FROM s LEFT JOIN least ON doc_id = least.a LEFT JOIN links ON doc_id = links.a
"""


def _planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by the hash of its id repeats its words from one place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+"), F.lit(0))
    n = F.size("words")
    g = F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    again = F.array_join(
        F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))),
        " ",
    )
    tenth = docs.select("doc_id", "text").withColumn("words", F.when(h % 10 == 0, words))
    return (
        tenth.withColumn("a", F.when(n > 0, a))
        .withColumn("p", F.when(n > 0, p))
        .select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_planted_runs(_table(spark, sf_dir, "documents")))
    # The greatest exact exponent: fractions are compared crosswise.
    def above(x, y):
        return (
            F.when(x.length * y.period != y.length * x.period, x.length * y.period > y.length * x.period)
            .when(x.start != y.start, x.start < y.start)
            .otherwise(x.period < y.period)
        )

    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda kept, run: F.when(above(run, kept), run).otherwise(kept))
    line = F.transform("runs", lambda run: F.concat_ws(",", run.start, run.length, run.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED_MOD == 0, (label + 1) % LABELS).otherwise(label)
    vectors = negatives.labelled_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", moved, 256.0)
    return negatives.mine(vectors, vectors.filter(F.col("id") % ANCHORS_MOD == 0))


OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {MOVED_MOD} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHORS_MOD} = 0
), p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {negatives.POSITIVES}
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND {negatives.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {negatives.HIGH} * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n
WHERE rank <= {negatives.NEGATIVES}
"""

QUERIES = {
    "op1_exact_topk": (op1_exact_topk, OP1_SQL),
    "op2_temperature_mix": (op2_temperature_mix, OP2_SQL),
    "op3_license_scan": (op3_license_scan, None),
    "op4_line_dedup": (op4_line_dedup, OP4_SQL),
    "repeated_passages": (repeated_passages, PASSAGES_SQL),
    "op5_stratified_shards": (op5_stratified_shards, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_benchmark_leaks": (op7_benchmark_leaks, None),
    "op8_language": (op8_language, None),
    "op9_simhash": (op9_simhash, None),
    "op10_warc": (op10_warc, OP10_SQL),
    "op11_jaccard_join": (op11_jaccard_join, OP11_SQL),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}
