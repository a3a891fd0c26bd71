"""The life of stored logs: partitioned tables, expiry, compaction, archives and their manifest."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share; local mode can do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="loglake-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/storage-{uuid.uuid4().hex}"


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def append(logs: DataFrame, path: str) -> None:
    """Partitioned by day, sorted in files, so that a range reads few row groups; a large day is written by several tasks."""
    _dealt(logs).write.mode("append").partitionBy("day").parquet(path)


def _dealt(logs: DataFrame) -> DataFrame:
    rows = logs.withColumn("day", F.floor(F.col("timestamp_ns") / DAY_NS).cast("long"))
    return rows.repartitionByRange("day", "timestamp_ns").sortWithinPartitions("day", "timestamp_ns", "doc_id")


def commit(logs: DataFrame, path: str) -> dict[str, int]:
    """Append and count: how many records, and the first and last time among them."""
    seen = Observation("committed")  # after the exchange: the sample for its ranges reads rows too
    rows = _dealt(logs).observe(seen, F.count("*").alias("records"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    rows.write.mode("append").partitionBy("day").parquet(path)
    return seen.get


def expire(logs: DataFrame, ttl_ns: int) -> DataFrame:
    return logs.withColumn("expire_at_ns", F.col("timestamp_ns") + ttl_ns)


def live(rows: DataFrame, now_ns: int) -> DataFrame:
    return rows.filter(F.col("expire_at_ns") > now_ns)


def write_cohorts(rows: DataFrame, path: str, cohort_ns: int = DAY_NS) -> None:
    """Append rows with expire_at_ns to a table with a folder for each cohort of expiry."""
    rows.withColumn("death_bucket", F.floor(F.col("expire_at_ns") / cohort_ns).cast("long")).write.mode("append").partitionBy("death_bucket").parquet(path)


def compact(spark: SparkSession, path: str, now_ns: int, cohort_ns: int = DAY_NS) -> dict[str, int]:
    """Drop the folders of dead cohorts and rewrite the one in which some rows are dead; the others are not read.

    The rewritten cohort is a table of its own first, so a run that dies leaves the rows in one place or the other.
    """
    stored, now = read_or_none(spark, path), now_ns // cohort_ns
    if stored is None:
        return {"dropped": 0, "rewritten": 0}
    buckets = sorted(r[0] for r in stored.select("death_bucket").distinct().filter(F.col("death_bucket") <= now).collect())
    dead = [b for b in buckets if b < now]
    drop_folders(spark, [f"{path}/death_bucket={b}" for b in dead])
    edge = stored.filter(F.col("death_bucket") == now)
    rewritten = now in buckets and not edge.filter(F.col("expire_at_ns") <= now_ns).isEmpty()
    if rewritten:
        fresh = work_folder(spark)
        live(edge, now_ns).drop("death_bucket").write.parquet(fresh)
        spark.read.schema(edge.drop("death_bucket").schema).parquet(fresh).write.mode("overwrite").parquet(f"{path}/death_bucket={now}")
        drop_folders(spark, [fresh])
    return {"dropped": len(dead), "rewritten": int(rewritten)}


def archive(spark: SparkSession, local: str, target: str, manifest: str, day: int, now_ns: int) -> None:
    """Copy one day's rows to the archive and note it; a day that the manifest has is left alone.

    The day's folder is written whole before the note, so a run that dies between the two is repeated without doubles.
    """
    if not archived_days(spark, manifest).filter(F.col("day") == day).isEmpty():
        return
    rows = spark.read.parquet(local).filter(F.col("day") == day)
    rows.drop("day").write.mode("overwrite").parquet(f"{target}/day={day}")
    facts = rows.agg(F.min("timestamp_ns").alias("min_ns"), F.max("timestamp_ns").alias("max_ns"))
    facts.select(F.lit(day).cast("long").alias("day"), "min_ns", "max_ns", F.lit(now_ns).cast("long").alias("archived_at_ns")).coalesce(1).write.mode("append").parquet(manifest)


def archived_days(spark: SparkSession, manifest: str) -> DataFrame:
    """The manifest: day, min_ns, max_ns, archived_at_ns; empty where nothing has been archived."""
    noted = read_or_none(spark, manifest)
    return spark.createDataFrame([], "day long, min_ns long, max_ns long, archived_at_ns long") if noted is None else noted


def read_through(local: DataFrame, archived: DataFrame, manifest: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of [start, end), local and archived, each key once.

    The manifest (a row for each day) names the archived days of the range: other days are local only and read as they
    are; of archived days only those local rows are added that the archive doesn't have.
    """
    from loglake.operators.query import time_range

    noted = manifest.filter((F.col("max_ns") >= start) & (F.col("min_ns") < end) & (F.col("day") >= start // DAY_NS) & (F.col("day") <= (end - 1) // DAY_NS))
    days = [r[0] for r in noted.select("day").distinct().collect()]
    rows, copied = time_range(local, start, end), F.col("day").isin(days) if days else F.lit(False)
    old = time_range(archived, start, end).filter(copied)
    late = rows.filter(copied).join(old.select("doc_id"), "doc_id", "left_anti")
    return rows.filter(~copied).unionByName(old).unionByName(late) if days else rows


def prunable(manifest: DataFrame, now_ns: int, grace_ns: int) -> list[int]:
    """Days that have been archived for longer than the grace period."""
    return [r[0] for r in manifest.filter(F.col("archived_at_ns") + grace_ns <= now_ns).select("day").distinct().collect()]


def prune(spark: SparkSession, local: str, archived: DataFrame, manifest: DataFrame, now_ns: int, grace_ns: int) -> int:
    """Delete the local folders of prunable days; a day with local rows that the archive lacks stays. Gives the number of days."""
    days = prunable(manifest, now_ns, grace_ns)
    if not days:
        return 0
    rows = spark.read.parquet(local).filter(F.col("day").isin(days))
    late = rows.join(archived.filter(F.col("day").isin(days)).select("doc_id"), "doc_id", "left_anti").select("day").distinct()
    gone = set(days) - {r[0] for r in late.collect()}
    drop_folders(spark, [f"{local}/day={d}" for d in sorted(gone)])
    return len(gone)
