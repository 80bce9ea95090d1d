"""A corpus pipeline over documents: quality rules, near-duplicate removal, secret redaction, mixing, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm import kneser_ney, mixing, ngram_join, packing, secrets
from scenewright.llm.common import cut, table
from scenewright.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL expresses the perplexity model, the hashed draw or the tokenizer.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity band, which the labels beside the
    documents set (without a folder, the documents themselves). A null or empty text fails the base rules; a null
    language is one of its own; rows that repeat an id are judged each by its text. An empty table stays empty; columns
    other than those of documents are dropped."""
    docs = docs.select(*COLUMNS)
    good = table(spark, sf_dir, "labels").where("quality = 1") if sf_dir else None
    measured = cut(kneser_ney.measure(docs, kneser_ney.train(docs)))
    return kneser_ney.judge(measured, cut(kneser_ney.bands(measured, good=good))).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of at least 80 % common five-word shingles connect, the one of the
    smallest doc_id, documents without an id last. A document is a doc_id with a text: rows of one id with different
    texts are told apart, and of rows equal in both one stays. Null and wordless texts link with nothing. An empty
    table stays empty; columns other than those of documents are dropped."""
    whose = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("text"))
    rows = docs.select(*COLUMNS).withColumn("_whose", whose)
    found = cut(ngram_join.join(rows.select("_whose", "text"), "_whose", words=5, percent=80))
    gone = cut(found.where("_whose != component_id").select("_whose").distinct())
    few = gone.count() <= ngram_join.BROADCAST_ROWS
    kept = rows.join(F.broadcast(gone) if few else gone, "_whose", "left_anti")
    again = found.groupBy("_whose").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (kept.dropDuplicates(["_whose"]) if again else kept).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced; n_chars follows where any was. A null text stays null, one without
    secrets as it is; rows that repeat are scanned alike. An empty table stays empty; columns other than those of
    documents are dropped."""
    found = secrets.scan(docs, secrets.model_of(docs)).withColumn("text", secrets.redacted(F.col("text"), F.col("secret_spans")))
    chars = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed at 5, 2, 1: each document as often as the mix takes it. A null source is one of its own; documents
    without words are taken like those of the shortest; rows equal in doc_id and length are taken or left together. An
    empty table stays empty; columns other than those of documents are dropped."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.n_words(F.col("text")))
    mixed = mixing.mix(sized, ["doc_id"])
    return mixed.withColumn("copy", F.explode(F.expr("array_repeat(0, copies)"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. A null text is an empty one, which is its end alone; rows
    that repeat are packed each. An empty table stays empty; only doc_id goes along."""
    return packing.pack(cut(packing.pieces(docs, ["doc_id"], "text", tokenizer_file(), 1024)), 1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
