"""The driver's tables as log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions.core import normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log records; the key's suffix is the event's id."""
    e = table(spark, sf_dir, "events")
    hundredths = F.round(F.col("value") * 100).cast("long").cast("string")
    message = F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" took "), hundredths, F.lit("us k="), F.get_json_object("props", "$.k"))
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info")
    fields = {"level": level, "path": F.concat(F.lit("/"), "event_type"), "trace_id": F.col("user_id").cast("string"), "latency_ms": hundredths, "status": (F.lit(200) + 100 * (F.col("event_id") % 4)).cast("string")}
    wire = e.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"), message.alias("message"),
        F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]).alias("fields"), "event_id",
    )
    return normalize(wire, suffix=F.col("event_id"))
