"""From raw documents to tokens: quality, near duplicates, benchmark passages, personal data, byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, contamination, pii, quality, simhash
from graphloom.llm.common import cut, free_name, fresh_path
from graphloom.llm.queries import PII_KEY, quality_network, table, tokenizer_path

#: A document stays if its quality reaches this.
QUALITY = 0.7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network doesn't reject; it learns from the labelled documents of its input."""
    net = quality_network(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return quality.score(docs, net, keep_as=score).where(F.col(score) >= QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id, then the least digest of the whole row.

    Documents without id come last. Rows of one id that are no near copies of each other are documents of their own, and
    of rows that are equal in all columns one stays.
    """
    key = free_name(docs, "_key")
    # ids are written as unsigned numbers of one length, so that keys sort as ids do
    order = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in docs.columns])
    keyed = docs.withColumn(key, F.concat(F.coalesce(order, F.lit("~")), F.sha2(row, 256)))
    found = simhash.near_duplicates(keyed.select(key, "text"), id_col=key)
    least = cut(found.where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("n")))
    kept = keyed.join(least.select(key), key, "left_semi")
    repeated = least.where("n > 1").select(key)
    if repeated.limit(1).count():
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return contamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; n_chars follows the text."""
    out = pii.pseudonymise(docs, PII_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to."""
    return bpe.encode_decode(docs, tokenizer_path()).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("personal data", private),
    ("byte-pair encoding", tokens),
]

#: Training and token merging have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
