"""Registered queries of the training-data operators: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, chat_formatting, compact_windows, decontamination, hilbert_sharding, importance_resampling, ngram_jaccard, segment_topk, suffix_dedup, toxicity
from .common import documents


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    good, known = labels.agg(F.count_if(F.expr("quality = 1")), F.count("quality")).first()
    k = docs.count() * good // max(1, known)  # as many as the labels' share of good documents
    return importance_resampling.resample(docs, labels.where("quality = 1"), k).select("doc_id", "n_grams", "log_weight", "key")


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_jaccard.join(documents(spark, sf_dir), n=3, percent=90)
    return out.select("doc_id", out.n_grams.alias("n_shingles"), "component_id", "class_id")


def op4_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(documents(spark, sf_dir), length=50)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_formatting.read_back(chat_formatting.render(chat_formatting.fold(chat_formatting.format_rows(rows))))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_sharding.shard(documents(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return segment_topk.topk(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(documents(spark, sf_dir), length=50, percent=80)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), length=2048)


def op10_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_spaced_seeds,
        op3_ngram_jaccard,
        op4_sparse_suffix_array,
        op5_chat_formatting,
        op6_hilbert_sharding,
        op7_segment_topk,
        op8_compact_windows,
        op9_best_fit_packing,
        op10_string_kernel_toxicity,
    )
}

# what escaping adds to a text: one character for each backslash, one for each control string
_ESCAPED = r"length({0}) + length({0}) - length(replace({0}, chr(92), '')) + len(regexp_extract_all({0}, '<\||</?s>|<</?SYS>>|\[/?INST\]'))"
_FRAME = len(chat_formatting.TURN + chat_formatting.TEXT + chat_formatting.END)

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM t
),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS print FROM g GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY print) AS class_id FROM k),
h AS (SELECT g.doc_id, g.s, c.n FROM g JOIN c ON c.doc_id = g.doc_id AND c.class_id = g.doc_id),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach(node, other) AS (SELECT class_id, class_id FROM c UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.other),
label AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT t.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(label.component_id, t.doc_id) AS component_id, coalesce(c.class_id, t.doc_id) AS class_id
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN label ON label.node = c.class_id
""",
    "op5_chat_formatting": f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL
  SELECT -7, i, ['user', 'assistant'][i + 1], x, ['user', 'assistant'][i + 1], x FROM (SELECT unnest([0, 1]) AS i, '</s>[INST] ok [/INST]' AS x)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_FRAME} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
""",
    "op7_segment_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE) FOR x IN embedding] AS x FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
}
