"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where none is set, a temporary one in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loglake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_work: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends in durable files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/work-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _work.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def work_tables() -> int:
    """How many tables ``cut`` has written that are still there."""
    return len(_work)


def drop_work_tables(first: int = 0, last: int | None = None) -> None:
    """Delete the tables first..last-1 that ``cut`` has written; results that are still lazy can't be read afterwards."""
    gone, _work[first:last] = _work[first:last], []
    for spark, path in gone:
        try:
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception:  # noqa: BLE001  the session has ended already
            return


atexit.register(drop_work_tables)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words_by_space(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.array_remove(F.coalesce(F.split(text, SPACE), F.array().cast("array<string>")), "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def pieces(total: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of ``column``, a row at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches sorted by ``keys``, in pieces of one key's values each; a key that fills several batches comes several times in a row."""
    for b in batches:
        if b.num_rows:
            values = [b[k].to_numpy(zero_copy_only=False) for k in keys]
            changes = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
            for first, last in zip(np.r_[0, changes].tolist(), [*changes.tolist(), b.num_rows]):
                yield tuple(int(v[first]) for v in values), b.slice(first, last - first)
