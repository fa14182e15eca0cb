"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, dartminhash, decontam, licences, mixing, quality, sharding, tokens, warc, wrappers
from .common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_WEIGHTS = [5.0, 2.0, 1.0]
SHARDS = 24


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), min_match=4, coverage=0.5)


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc.read_archives(manifest).drop("url")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, budget=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_text(_table(spark, sf_dir, "pages"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8, words=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_cover_tree": op2_cover_tree,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_wrappers": op7_wrappers,
    "op8_licences": op8_licences,
    "op9_quality": op9_quality,
    "op10_dartminhash": op10_dartminhash,
}

_FRACTION = "((('0x' || substr(md5({0}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"

ORACLES: dict[str, str] = {
    "op2_cover_tree": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL
   AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = e.vec_id""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(octet_length(encode(html)), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k""",
    "op4_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
      FROM d GROUP BY source),
l AS (SELECT *, 2.0::DOUBLE * source_size AS lim FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS k FROM l),
v AS (SELECT a.k, a.lim / a.w AS ratio,
             (1.5::DOUBLE * (SELECT sum(source_size) FROM l)::DOUBLE - coalesce(sum(b.lim) FILTER (b.k < a.k), 0)) / sum(b.w) FILTER (b.k >= a.k) AS level
      FROM r a, r b GROUP BY ALL),
f AS (SELECT coalesce((SELECT level FROM v WHERE ratio > level ORDER BY k LIMIT 1), 'inf'::DOUBLE) AS level),
t AS (SELECT source, source_size, least(lim, w * level) AS target,
             CASE WHEN source_size = 0 THEN 0.0 WHEN w * level >= lim THEN 2.0 ELSE least(lim, w * level) / source_size END AS expected,
             floor({_FRACTION.format("'mix:offset:' || coalesce(source, '') || (source IS NULL)::VARCHAR")} * 1048576.0) / 1048576.0 AS shift
      FROM l, f),
p AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) - 1)::DOUBLE AS n FROM d)
SELECT doc_id, size, source_size, target, ((floor((n + 1) * expected + shift) - floor(n * expected + shift))::BIGINT * size)::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source""",
    "op5_sharding": f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, text, hex(encode(text)) AS hx FROM documents),
c AS (SELECT doc_id, k, coalesce(length(hx) // 2, 0) + 8 AS size,
             xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT)),
                             lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
w AS (SELECT doc_id, size, text_crc32, md5('slot:' || k) AS o,
             list_transform(range(25), lambda i: -ln({_FRACTION.format("'shard:' || i::VARCHAR || ':' || k")})) AS draws FROM c),
s AS (SELECT *, (list_position(draws[:24], list_min(draws[:24])) - 1)::INT AS shard, (list_position(draws, list_min(draws)) - 1)::INT AS grown_shard FROM w)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY o, doc_id) - 1)::BIGINT AS slot, grown_shard FROM s""",
}
