"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept,
and returns a DataFrame that is written as Parquet and read again for the next. All
but the last return the columns of ``documents``.

Empty tables, null columns and repeated rows pass through with the results that the
operators' docstrings define. Columns beyond those of ``documents`` are carried along
by the filtering stages. A mixture repeats documents, so ids may repeat from the
fourth stage on; packing treats every row as a document of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import line_dedup, minhash, mixing, packing, quality
from casewright.llm.common import carried, restored
from casewright.scale import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier three-line windows.

    A document all of whose words go is dropped; ``n_chars`` follows the text.
    """
    own = ("doc_id", "text", "n_chars")
    cut = line_dedup.dedup_lines(carried(docs, *own))
    words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col("n_removed") > 0
    length = F.when(changed, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return restored(cut.where(~changed | words).withColumn("n_chars", length), docs.columns, *own)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Shingles have five words and links a similarity of 0.8 or more. Rows that share
    an id are one node, so all of them stay or go together.
    """
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("mixing_sources", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizing and the trained classifier have no SQL form; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; tables between them lie in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        path = f"{folder}/{k}-{name}"
        done.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
