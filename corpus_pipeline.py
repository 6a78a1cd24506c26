"""The corpus pipeline: five stages from raw documents to packed sequences.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and works on all
that the stage before it kept. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's documents, so a lost executor costs the
running stage only. All stages but the last return the columns of ``documents``, in any number
and under any names beside doc_id and text; null texts and ids are as the operators define, and
an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import decontaminate, hyperminhash, packing, quality_rules, secret_scan
from lociweave.llm.work import Workspace, read, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id."""
    kept = hyperminhash.near_duplicates(docs, words=5).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    names = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    return docs.join(kept, "doc_id", "left_semi").select(*names).union(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, and their places in sequences; ``packing.sequences`` puts these together."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("packing", packed),
]

#: A convolutional network, tokenizers and a linear program have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():  # what a stage works with goes when its rows are written
            docs = work.table(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
