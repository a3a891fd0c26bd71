"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark contamination, and the mix of sources.

Each stage takes the rows that the stage before kept, written as Parquet, and returns the columns of documents; the
last adds what the mix takes of each row.

Defined cases, in every stage: an empty table gives an empty table; a null text counts as empty and stays null; ids don't
tell rows apart, so null and repeated ids are fine, and other columns than those of documents are left out. Repeated rows
pass together, but near duplicates keep one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm import decontaminate, mixing, quality, simhash, suffix
from loglake.llm.common import cut, drop_work_tables, table, work_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=COLUMNS)
    return scored.filter("predicted = 1").select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the least by id (null ids last), then by a hash of all its columns."""
    own = F.struct("doc_id", F.md5("text").alias("text"), "lang", "source", "n_chars")
    docs = docs.select(*COLUMNS, F.md5(F.to_json(own)).alias("__row"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    leaders = simhash.near_duplicates(docs, keep=("__row",)).groupBy("root").agg(least.alias("least")).select("least.__row")
    # rows of one hash are equal, so one of them is enough; ids don't tell rows apart
    return docs.dropDuplicates(["__row"]).join(leaders, "__row", "left_semi").select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that occur more than once."""
    left = suffix.dedup(docs, keep=("lang", "source"), with_text=True)
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of weight."""
    return decontaminate.remove_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, source_size, target and taken."""
    return mixing.mix(docs, keep=("text", "lang", "n_chars")).filter("taken > 0")


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("suffix", suffix_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written in the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), work_tables()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        drop_work_tables(before, work_tables() - 1)  # all but the stage's result
    return STAGES[-1][1](spark, docs, sf_dir)
