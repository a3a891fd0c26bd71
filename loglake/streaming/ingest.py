"""Structured Streaming forms of ingest and of the minute rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglake.functions.core import FIELDS, normalize
from loglake.operators.rollup import MAKERS


def write_logs(wire: DataFrame, path: str, checkpoint: str, fields: tuple[str, ...] = FIELDS) -> StreamingQuery:
    """Wire records to the log table; files and checkpoint make each record land once."""
    logs = normalize(wire, fields).withColumn("day", F.floor(F.col("timestamp_ns") / 86_400_000_000_000).cast("long"))
    return logs.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(availableNow=True).start(path)


def minute_rollup(logs: DataFrame, field: str, kind: str = "exact", watermark: str = "30 seconds") -> DataFrame:
    """A rollup (see rollup.MAKERS) of one field by event-time minute. Rows later than the watermark are dropped and counted by Spark."""
    rows = logs.withColumn("ts", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("ts", watermark)
    rows = rows.select(F.window("ts", "1 minute").alias("bucket_start"), F.lit(field).alias("field"), F.col(f"f_{field}").alias("value")).filter("value is not null")
    return MAKERS[kind](rows).withColumn("bucket_start", F.col("bucket_start.start"))


def write_minutes(rollup: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a minute rollup over all input that is there. Each batch writes the minutes that it has changed, open ones too, in a folder that is its own: a batch that is run again writes the same."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return rollup.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    """The rollup that ``write_minutes`` has written: of each row the last batch's."""
    rows = spark.read.parquet(path)
    held = [c for c in ("cnt", "sketch", "top") if c in rows.columns]
    keys = [c for c in rows.columns if c not in (*held, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in held])


def progress(query: StreamingQuery) -> dict[str, int]:
    """Rows that a query has read so far and still remembers, and those that came later than the watermark."""
    batches = query.recentProgress
    late = sum(state["numRowsDroppedByWatermark"] for p in batches for state in p["stateOperators"])
    return {"rows": sum(p["numInputRows"] for p in batches), "late": late}
