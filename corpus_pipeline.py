"""The corpus pipeline: toxicity, exact dedup, near duplicates, benchmark decontamination, packing.

Each stage works on all that its predecessor kept, which is written as Parquet and read again. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm._shared import discard, open_paths, scratch
from quantloom.llm.decontamination import clean
from quantloom.llm.exact_dedup import keep_one
from quantloom.llm.jaccard_join import keep_first
from quantloom.llm.packing import pack
from quantloom.llm.toxicity import toxicity_stage


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest doc_id.

    Null and empty texts are equal; a null doc_id never wins over another, rows that tie keep one, an empty table stays
    empty, and columns may have any names.
    """
    return keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest doc_id of a group stays. Texts without words are near nothing and stay, as do rows with a null doc_id; all
    rows of a doc_id stay or go together; an empty table stays empty.
    """
    return keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark passage.

    Each row is decided by its own text, so repeated rows and null ids are decided alike; null, empty and wordless texts
    stay; an empty table, or an empty benchmark, changes nothing.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document, as op7 returns them.

    Null and empty texts are one piece, the closing token; repeated rows and null ids are packed row by row; an empty table
    gives no rows.
    """
    return pack(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Fitted models, shingle joins and tokenizers have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what they hand on lies in the session's shared folder.

    Once a stage's rows are written, its scratch files and its predecessor's rows go; what the last one reads stays until
    the application ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), list(open_paths)
    for name, stage in STAGES[:-1]:
        df, at = stage(spark, docs, sf_dir), scratch(spark, f"pipeline-{name}")
        df.write.parquet(at)
        docs = spark.read.parquet(at)
        for path in [p for p in open_paths if p not in before and p != at]:
            discard(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
