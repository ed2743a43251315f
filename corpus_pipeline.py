"""The corpus pipeline: documents through the stages of STAGES, each written as Parquet and read again.

A stage takes what its predecessor kept. All but the last return the columns of documents; the last one packs what is
left into sequences. Each stage applies an operator of kvlake.llm as it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import bpe, common, exact_dedup, minhash, packing, pii, toxicity


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that it predicts toxic go. The model learns from the documents that come in and the labels
    beside them."""
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    score = common.unused(docs, "score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one row of each text stays, that of the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, with shingles of five words and a similarity of 0.8: one document of each component stays, that of the
    smallest doc_id."""
    return minhash.deduplicate(docs)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts get pseudonyms; n_chars follows where a text changed."""
    apart = common.set_aside(docs, "n_private", "private_kinds")
    n_chars = F.when(F.col("n_private") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    made = pii.pseudonymised(apart).withColumn("n_chars", n_chars)
    return made.select(*(F.col(f"`{a}`").alias(c) for a, c in zip(apart.columns, docs.columns, strict=True)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of documents and their places in sequences."""
    return packing.pack_documents(docs, vocabulary=bpe.word_vocabulary())


STAGES = [
    ("toxicity", harmless),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("pii", without_private_data),
    ("packing", packed),
]

#: Trained scores, verified similarity and tokenizer ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's helper tables and its input go once its output is written."""
    begin = common.made()
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.finished(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", begin)
    return docs
