"""A corpus pipeline: rejects poor text, drops exact and near copies, drops documents with benchmark passages, encodes.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with all columns of docs, extra ones too, whatever
their names; the last returns what the tokenizer makes of each document. run() applies them to documents, each over the
written result of the one before. Null texts count as empty, null ids as smaller than any other; an empty table gives an
empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, dart_minhash, decontamination, exact_dedup, quality_cnn
from millrace.llm.common import ascii_lower, read
from millrace.storage import drop_tables, materialize, tidy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least the threshold; all of them if no labels tell good from poor.

    The network learns from labelled documents outside the held-out fold. Repeated rows score and stay alike.
    """
    net = quality_cnn.fit(docs, read(spark, sf_dir, "labels"), "quality")
    return quality_cnn.keep_good(docs, net)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of each group of texts that are equal but for the case of A-Z; of repeated rows one."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    named = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.sha2(ascii_lower(F.coalesce(F.col("row.text"), F.lit(""))), 256).alias("sha"), F.col("row.doc_id").alias("id"))
    joined = named.join(kept, F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")), "left_semi")
    return joined.dropDuplicates(["id", "sha"]).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, the one with the largest doc_id; texts without words all stay."""
    return dart_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lies in passages of the benchmark; repeated rows are judged alike."""
    return decontamination.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's doc_id, n_tokens and the digests of its ids and of what they decode to."""
    return byte_bpe.bpe_roundtrip(docs, *byte_bpe.tokenizer())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("benchmark decontamination", decontaminate), ("byte-level BPE", encode)]
#: The trained network and the tokenizer have no SQL; tests hold the pipeline against a plain Python version.
ORACLE_SQL = None


@tidy
def _written(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str, stage) -> DataFrame:
    return materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of a stage's tables its result stays, until the next stage's is written."""
    docs = read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        before, docs = docs, _written(spark, docs, sf_dir, name, stage)
        if at:
            drop_tables(before)
    return docs
