"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, bpe, interleave, langid, licenses, neardup, packing, pii, quality, resample, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), output="digest")


def op6_dart_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark), count_col="n_replaced")


def op9_subword_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.interleave(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {f.__name__: f for f in (
    op1_byte_cnn_quality, op2_ball_tree_top_k, op3_best_fit_packing, op4_license_rules, op5_bpe_chunk_reuse, op6_dart_minhash_near_dedup, op7_anisotropic_ann, op8_feistel_pseudonyms,
    op9_subword_language_id, op10_noisy_channel_toxicity, op11_importance_resampling, op12_cross_tokenizer_alignment, op13_stratified_sharding)}

#: CRC-32 of a text's UTF-8 bytes, half a byte at a time; the list is the checksum's table for four bits.
_CRC = """CASE WHEN {0} = '' THEN 0 ELSE xor(4294967295, list_reduce(list_transform(string_split(regexp_replace(hex(encode({0})), '(.)(.)', '\\2\\1', 'g'), ''),
  lambda c: CAST(ascii(c) - 48 - 7 * CAST(c > '9' AS INT) AS BIGINT)), lambda c, x: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
  3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + (xor(c, x) & 15)]), CAST(4294967295 AS BIGINT))) END"""

#: The others depend on learned models, keyed hashes, tokenizer files or approximation.
ORACLE_SQL: dict[str, str] = {
    "op2_ball_tree_top_k": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_dart_minhash_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
o AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
s AS (SELECT doc_id, sh, count(*) AS m FROM o GROUP BY ALL),
n AS (SELECT doc_id, sum(m) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.m, b.m)) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)
  UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.ws = y.ws AND x.doc_id < y.doc_id),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.seen = g.a)
SELECT doc_id, min(seen) AS class_id FROM r GROUP BY doc_id""",
    "op11_importance_resampling": f"""
WITH x AS (SELECT TRUE AS of_docs, doc_id AS id, text FROM documents UNION ALL SELECT FALSE, row_number() OVER (), text FROM benchmark),
w AS (SELECT of_docs, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM x),
f AS (SELECT of_docs, id, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(ws) + 2 - k), lambda i: array_to_string(ws[i:i + k - 1], ' '))))) AS feature FROM w),
b AS (SELECT feature, {_CRC.format("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f)),
n AS (SELECT of_docs, id, bucket, count(*) AS n FROM f JOIN b USING (feature) GROUP BY ALL),
c AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (of_docs), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT of_docs), 0) AS DOUBLE) AS t FROM n GROUP BY bucket),
a AS (SELECT sum(s) + 10000 AS s_all, sum(t) + 10000 AS t_all FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * s_all / ((s + 1) * t_all))) AS BIGINT) AS gain FROM c, a),
d AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN g USING (bucket) WHERE of_docs GROUP BY id),
o AS (SELECT doc_id, len(ws) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT id AS doc_id, ws FROM w WHERE of_docs) LEFT JOIN d ON d.id = doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, count(*) FILTER (enough) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 5 * n // 100 THEN place END AS rank FROM r""",
    "op13_stratified_sharding": f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS stratum, coalesce(text, '') AS text, sha256('42:' || doc_id) AS shuffled FROM documents),
f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY shuffled) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY stratum) AS through FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY through, stratum) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, octet_length(encode(text)) + 8 AS size, {_CRC.format("text")} AS text_crc32, 'rows' AS law, CAST(place * 24 // n AS INTEGER) AS shard,
  place - ((place * 24 // n) * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
}
