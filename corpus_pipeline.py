"""From raw documents to packed batches: toxicity, line runs, near copies, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the
next stage's documents.  All but the last return the columns of `documents`; where a stage
changes texts, `n_chars` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opinara.llm import lines, packing, simhash, suffixes, toxicity
from opinara.llm.common import table
from opinara.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.cleaned(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.cleaned(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_line_runs),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack_batches),
]

# The first stage's network has no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what a stage keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
