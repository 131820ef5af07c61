"""A corpus pipeline of the operators in ``slotwise.llm``.

The stages drop toxic documents, keep one of each group of near-duplicates, drop documents that hold passages of the
benchmark, replace secrets in what is left, and pack it into sequences of token ids.  All but the last return the
columns of ``documents``.  Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labelled ones, doesn't reject."""
    from slotwise.llm.toxicity import keep_innocent, train, training_sample

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_innocent(docs, train(training_sample(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of all that links join; a link is a Jaccard similarity of 0.8 of five-word shingles.

    Candidates are found by SimHash segments and Hamming balls.
    """
    from slotwise.llm.wide_simhash import keep_dissimilar

    return keep_dissimilar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    from slotwise.llm.decontaminate import keep_clean

    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of every secret; ``n_chars`` follows the text where there is one."""
    from slotwise.llm.common import fresh
    from slotwise.llm.secrets import find_secrets, labelled_samples, redact, train

    (found,) = fresh(docs, "secrets")
    marked = find_secrets(docs, train(labelled_samples(docs)), out=found)
    some = F.size(found) > 0
    marked = marked.withColumn("text", F.when(some, redact(F.col("text"), F.col(found))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        marked = marked.withColumn("n_chars", F.when(some, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return marked.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 token ids."""
    import public_tokenizers
    from slotwise.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", replace_secrets),
    ("packing", pack_sequences),
]
#: The learned stages can't be put in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what its predecessor wrote."""
    from slotwise.llm.common import path_for

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = path_for(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
