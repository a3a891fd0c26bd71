"""Mergeable rollups by minute, hour, day and month: exact counts, HyperLogLog, top-k and DDSketch, as plain tables."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.functions.core import FIELDS, BadRequest, NotFound, number
from loglake.operators.storage import drop_folders

TIERS = ("minute", "hour", "day", "month")
TTL_SECS = {"minute": 3600, "hour": 7 * 86400, "day": 90 * 86400, "month": 3650 * 86400}
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
LEAST = 1e-9
HLL_LG_K = 14
TOP_K = 20
TRACKED = 10_000  # values that a top-k sketch keeps, at most


def samples(logs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """bucket_start (minute), field, value of every field of every record; template_sig is a field too."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), (F.col(k) if k == "template_sig" else F.col(f"f_{k}")).alias("value")) for k in fields])
    minute = F.timestamp_micros(F.expr("(timestamp_ns - pmod(timestamp_ns, 60000000000)) div 1000"))
    return logs.select(minute.alias("bucket_start"), F.explode(pairs).alias("e")).select("bucket_start", "e.field", "e.value").filter("value is not null")


def expiring(rows: DataFrame, tier: str) -> DataFrame:
    return rows.withColumn("expire_at_ns", F.unix_micros("bucket_start") * 1000 + TTL_SECS[tier] * 1_000_000_000)


def exact(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket_start", "field", "value").agg(F.count("*").alias("cnt"))


def hll(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket_start", "field").agg(F.hll_sketch_agg("value", HLL_LG_K).alias("sketch"))


def bin_of(v: Column) -> Column:
    """Signed place of a value's bin: 0 holds what is near zero, negative values mirror positive ones."""
    k = (F.ceil(F.log(F.abs(v)) / F.lit(math.log(GAMMA))) + 100_000).cast("int")
    return F.when(F.abs(v) <= LEAST, F.lit(0)).when(v > 0, k).otherwise(-k)


def ddsketch(rows: DataFrame) -> DataFrame:
    v = number(F.col("value"))
    return rows.select("bucket_start", "field", v.alias("v")).filter("v is not null").groupBy("bucket_start", "field", bin_of(F.col("v")).alias("bin")).agg(F.count("*").alias("cnt"))


def top_sketch(rows: DataFrame) -> DataFrame:
    """Mergeable top-k summaries, for fields of too many values for exact counts."""
    return rows.groupBy("bucket_start", "field").agg(F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("top"))


MAKERS = {"exact": exact, "hll": hll, "topk": top_sketch, "ddsketch": ddsketch}
_HOLDS = {"exact": {"value", "cnt"}, "hll": {"sketch"}, "topk": {"top"}, "ddsketch": {"bin", "cnt"}}


def kind_of(rollup: DataFrame) -> str:
    """Which kind of rollup a table is; kinds don't mix."""
    own = set(rollup.columns) - {"bucket_start", "field", "expire_at_ns"}
    found = [k for k, columns in _HOLDS.items() if columns == own]
    if not found:
        raise BadRequest(f"not a rollup: {sorted(own)}")
    return found[0]


def _combined(kind: str) -> Column:
    return {"hll": F.hll_union_agg("sketch").alias("sketch"), "topk": F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top")}.get(kind, F.sum("cnt").alias("cnt"))


def merge_up(rollup: DataFrame, tier: str) -> DataFrame:
    """A finer tier's table to a coarser one; raw records are not read again."""
    rows, kind = rollup.withColumn("bucket_start", F.date_trunc(tier, "bucket_start")), kind_of(rollup)
    return rows.groupBy(*[c for c in rows.columns if c not in ("cnt", "sketch", "top", "expire_at_ns")]).agg(_combined(kind))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rollups of one kind as one; rollups of different kinds are refused."""
    if kind_of(a) != kind_of(b):
        raise BadRequest(f"rollups of different kinds: {kind_of(a)} and {kind_of(b)}")
    return merge_up(a.drop("expire_at_ns").unionByName(b.drop("expire_at_ns")), "minute")


def store(rollup: DataFrame, path: str, tier: str) -> None:
    """Append a tier's table with its time of expiry, in a folder for each field and day."""
    rows = expiring(rollup, tier).withColumn("day", F.to_date("bucket_start"))
    rows.repartitionByRange("field", "bucket_start").sortWithinPartitions("field", "bucket_start").write.mode("append").partitionBy("field", "day").parquet(path)


def stored(spark: SparkSession, path: str, now_ns: int | None = None) -> DataFrame:
    """A stored tier; rows that have expired at ``now_ns`` are left out."""
    rows = spark.read.parquet(path).drop("day")
    return rows if now_ns is None else rows.filter(F.col("expire_at_ns") > now_ns)


def prune_tier(spark: SparkSession, path: str, now_ns: int) -> int:
    """Delete the folders (a field's day) of a stored tier in which every row has expired; gives their number."""
    last = spark.read.parquet(path).groupBy("field", F.col("day").cast("string").alias("day")).agg(F.max("expire_at_ns").alias("last"))
    gone = [f"{path}/field={r['field']}/day={r['day']}" for r in last.filter(F.col("last") <= now_ns).collect()]  # a row for each folder
    drop_folders(spark, gone)
    return len(gone)


def pick_tier(start_ns: int, end_ns: int) -> str:
    hours = (end_ns - start_ns) / 3_600_000_000_000
    return "minute" if hours <= 1 else "hour" if hours <= 24 else "day" if hours <= 31 * 24 else "month"


def in_range(rollup: DataFrame, field: str, start_ns: int, end_ns: int) -> DataFrame:
    """Buckets whose start lies in [start, end); compared as times, so that the condition reaches the scan."""
    at = lambda ns: F.lit(datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=-(-ns // 1000)))
    far = 9_000_000_000_000_000_000  # Python's times end before those of a LONG of nanoseconds do not
    return rollup.filter((F.col("field") == field) & (F.col("bucket_start") >= at(max(start_ns, -far))) & (F.col("bucket_start") < at(min(end_ns, far))))


def counts(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("value").agg(F.sum("cnt").alias("cnt"))


def top_k(rollup: DataFrame, k: int = TOP_K) -> DataFrame:
    return counts(rollup).orderBy(F.desc("cnt"), "value").limit(k)


def cardinality(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).cast("double").alias("estimate"))


def quantile(rollup: DataFrame, q: float) -> DataFrame:
    """One row: the value at rank floor(q * (n - 1)), to ALPHA; null outside [0, 1]. Bins are few (thousands at most), whatever the rows were."""
    bins = rollup.groupBy("bin").agg(F.sum("cnt").alias("cnt"))
    run = bins.withColumn("upto", F.sum("cnt").over(Window.orderBy("bin"))).withColumn("n", F.sum("cnt").over(Window.partitionBy()))
    rank = F.floor(F.lit(float(q)) * (F.col("n") - 1))
    middle = 2 * F.pow(F.lit(GAMMA), F.abs("bin") - 100_000) / F.lit(GAMMA + 1)
    value = F.when(F.col("bin") == 0, 0.0).when(F.col("bin") > 0, middle).otherwise(-middle)
    found = run.filter(F.col("upto") > rank).agg(F.min_by(value, F.col("bin")).alias("value"))
    return found if 0 <= q <= 1 else found.select(F.lit(None).cast("double").alias("value"))


def approximate_top_k(rollup: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k most frequent values by a top-k rollup; counts are estimates."""
    top = rollup.agg(_combined("topk")).select(F.explode(F.expr(f"approx_top_k_estimate(top, {k})")).alias("t"))
    return top.select(F.col("t.item").alias("value"), F.col("t.count").alias("cnt"))


KINDS = {"count": "exact", "topk": "exact", "cardinality": "hll", "quantile": "ddsketch"}


def aggregate(tables: dict[tuple[str, str], DataFrame], field: str, start_ns: int, end_ns: int, op: str = "count", k: int = 10, q: float | None = None, strict: bool = True) -> DataFrame | None:
    """Read one tier's table, chosen by the span. tables: (tier, kind) -> rollup."""
    if op not in KINDS or (op == "quantile" and q is None):
        raise BadRequest(f"unknown op, or q is missing: {op}")
    rollup = tables.get((pick_tier(start_ns, end_ns), KINDS[op]))
    if rollup is None and op == "topk" and (sketch := tables.get((pick_tier(start_ns, end_ns), "topk"))) is not None:
        return approximate_top_k(in_range(sketch, field, start_ns, end_ns), k)
    if rollup is None:
        if strict:
            raise BadRequest(f"the field has no {KINDS[op]} rollup")
        return None
    rows = in_range(rollup, field, start_ns, end_ns)
    if rows.isEmpty():
        raise NotFound("no rollup data in the range")
    return {"count": lambda: counts(rows), "topk": lambda: top_k(rows, k), "cardinality": lambda: cardinality(rows), "quantile": lambda: quantile(rows, q)}[op]()
