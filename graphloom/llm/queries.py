"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, contamination, langid, lm, pii, quality, simhash, topk, toxicity, warc
from graphloom.llm.common import in_fold

#: The key of the queries' pseudonyms. A deployment passes its own.
PII_KEY = "demonstration key"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded and decoded texts."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_archives(archives).where("status = 'ok'").select(
        warc.page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id_of("refers_to").alias("refers_to")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, count_col="n_replaced").select("doc_id", "text", F.col("n_replaced").cast("long").alias("n_replaced"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(in_fold("doc_id", 4, 0, 1, 3)))
    out = langid.predict(docs, model)
    return out.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = in_fold("doc_id", 5, 1, 2, 3, 4)
    model = toxicity.train(docs.where(learn), labels.where(learn))
    out = toxicity.score(docs, model)
    return out.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_network(docs: DataFrame, labels: DataFrame) -> quality.Network:
    learn = in_fold("doc_id", 4, 0, 1, 3)
    return quality.train(docs.where(learn), labels.where(learn))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality_network(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocab, net = lm.train(docs)
    out = lm.score(docs, vocab, net)
    per_token = F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens"))
    return out.withColumn("log_probability_per_token", per_token)


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("shared").cast("long").alias("shared"), F.col("size").cast("long").alias("size"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10_SQL = r"""
WITH w AS (
  SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark
), i AS (
  SELECT item_id, least(5, len(ws)) AS width,
         unnest(list_distinct(list_transform(range(1, CAST(len(ws) - least(5, len(ws)) + 2 AS BIGINT)),
                lambda k: array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ')))) AS s
  FROM w WHERE len(ws) > 0
), n AS (SELECT item_id, count(*) AS size FROM i GROUP BY item_id),
d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
), widths AS (SELECT DISTINCT width FROM i),
t AS (
  SELECT DISTINCT doc_id, width, s FROM (
    SELECT doc_id, width,
           unnest(list_transform(range(1, CAST(greatest(0, len(ws) - width + 1) + 1 AS BIGINT)), lambda k: array_to_string(ws[k:k + width - 1], ' '))) AS s
    FROM d, widths)
), m AS (
  SELECT t.doc_id, i.item_id, count(*) AS shared FROM t JOIN i ON t.width = i.width AND t.s = i.s GROUP BY 1, 2
)
SELECT m.doc_id, m.item_id, m.shared, n.size FROM m JOIN n ON m.item_id = n.item_id WHERE m.shared >= 0.8 * n.size - 1e-9
"""

OP3_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM (
  SELECT page_id, payload_bytes, digest, max(page_id) OVER (PARTITION BY payload) AS top,
         array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST(('0b' || substr(bits, CAST(5 * k + 1 AS BIGINT), 5)) AS INTEGER), 1)), '') AS payload_digest
  FROM (
    SELECT page_id, coalesce(html, '') AS payload, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
           sha1(coalesce(html, '')) AS digest, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits
    FROM pages))
"""


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_bpe": op1_bpe,
        "op2_simhash": op2_simhash,
        "op3_warc": op3_warc,
        "op4_pii": op4_pii,
        "op5_langid": op5_langid,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_topk": op8_topk,
        "op9_lm": op9_lm,
        "op10_contamination": op10_contamination,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op3_warc": OP3_SQL, "op8_topk": OP8_SQL, "op10_contamination": OP10_SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
