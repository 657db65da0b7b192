"""A corpus pipeline: five stages from raw documents to packed token pieces.

Each stage is a function of (spark, docs, sf_dir). All but the last return the
columns of ``documents``; ``n_chars`` follows the text. Stages work on all rows
of what the one before kept.

Defined results: null and blank texts have no language and go in the first stage.
Rows of equal doc_id count as one document where lines and near copies are
compared, and each row of it that stays is packed; a null doc_id is one document
that sorts last. Further columns of any name come through all stages but the
last. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontamination, language_id, line_dedup, minhash_dedup, packing
from tarn.llm.common import documents, saved, shared_dir, unused


def _plain(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns but those of ``documents`` in a struct, out of the way of
    what operators add, and the way back."""
    known = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")]
    others = [c for c in docs.columns if c not in known]
    if not others:
        return docs, lambda df: df.select(*docs.columns)
    return docs.select(*known, F.struct(*others).alias("others")), lambda df: df.select(*[F.col(c) if c in known else F.col("others")[c].alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or with a narrow margin of languages."""
    pred, score = unused(docs, "lang_pred", "score")
    judged = language_id.classify(docs, language_id.fit(docs), pred=pred, score=score)
    return judged.where(language_id.accepted(pred=pred, score=score)).drop(pred, score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that holds them; documents of which only
    white space is left go."""
    named, back = _plain(docs)
    done = line_dedup.dedup_lines(named)
    done = done.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    done = done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done
    return back(done)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    named, back = _plain(docs)
    return back(minhash_dedup.near_duplicates(named).where("kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express compression, banded registers, or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written once."""
    docs, path = documents(spark, sf_dir), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"{path}/{k}")
    return docs
