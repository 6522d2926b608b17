"""A corpus pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and works on what the one before kept;
all but the last return the columns of documents, whatever these are named.

Defined cases: a row with a null or empty text passes the stages that judge
texts, is a copy of every other such row, and has no piece in the packing; rows
alike in doc_id and text are copies; a null doc_id is carried; without labels or
items nothing is rejected; an empty table gives no bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.common import cut, table
from veilspark.llm.decontaminate import drop_leaks
from veilspark.llm.packing import packing
from veilspark.llm.quality import drop_bad
from veilspark.llm.simhash import drop_copies
from veilspark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't toxic. A text without words stays; repeated rows share their fate; ties with the threshold stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of good quality. Null and empty texts are judged by statistics of 0; a probability equal to the threshold stays."""
    return drop_bad(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least doc_id, null last, then of the least text hash; of rows alike in both, any one."""
    return drop_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no item of the benchmark. Null and empty texts contain none; a share equal to the limit goes."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents' tokens. Null and empty texts have no piece; repeated rows are packed as often as they come; ties are in order of doc_id."""
    return packing(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("decontaminate", decontaminate), ("pack", pack)]

#: Stages 1, 2, 3 and 5 can't be expressed in SQL; a test compares the rows of ``run`` with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
