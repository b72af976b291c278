"""Documents made ready for training: toxic ones rejected, near-duplicates and benchmark text removed, encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but
the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, decontaminate, similar, toxicity
from weftline.llm.queries import table
from weftline.llm.shared import materialize, text_batches


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go; labels come from the input's own labels table."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are similar to 0.8 or more the document with the least doc_id stays."""
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in 20 lies in a benchmark window go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids of each document, with digests of them and of the bytes that they decode to."""
    text_batches(spark)
    decoded = byte_bpe.decode(byte_bpe.encode(docs))
    return decoded.select(
        "doc_id", "n_tokens", "ids_le", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Trees, components and merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's documents are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
