"""The corpus pipeline: quality rules, quality classifier, near duplicates, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Every stage works on all that its predecessor kept. Null and empty texts fail the quality
rules; rows without id, and rows that repeat an id with another text, stay rows of their own; repeated rows go as copies; an empty table gives an empty
result; columns beside those of documents, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import ngram_join, packing, pii, quality_classifier, quality_rules
from evidentia.llm.common import mark, materialise, release


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the certified cutoffs reject."""
    return quality_rules.keep(docs, _labels(spark, sf_dir)).select(docs.columns)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are predicted to be of low quality, by a model of the labels of two thirds of them."""
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1
    model = quality_classifier.fit_on(docs, _labels(spark, sf_dir).filter(~held_out))
    return quality_classifier.keep(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class, each of its texts once; all documents without an id."""
    return ngram_join.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all pieces into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("personal data", personal_data_stage),
    ("best-fit packing", packing_stage),
]

#: None: the classifier, the exact join's components and the packing are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        since = mark() if before is None else before
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
            release(spark, since, docs)  # what the stage made and read
            before = mark() - 1
    return docs
