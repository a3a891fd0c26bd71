"""Selection, streams, context and anomalies over log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.functions.core import FIELDS, BadRequest, NotFound, all_of, bounded_message
from loglake.plans.logql import ParsedQuery, parse


def time_range(logs: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open; reaches the scan as a pushed filter, and as a partition filter where the table is split by day."""
    rows = logs.filter((F.col("timestamp_ns") >= start) & (F.col("timestamp_ns") < end))
    if "day" in logs.columns:
        day = 86_400_000_000_000
        rows = rows.filter((F.col("day") >= start // day) & (F.col("day") <= (end - 1) // day))
    return rows


def matching(logs: DataFrame, labels: dict[str, str]) -> DataFrame:
    """All labels equal; a row without a label doesn't match. Promoted columns are used where there are any."""
    of = lambda k: F.col(f"f_{k}") if f"f_{k}" in logs.columns else F.col("fields")[k]
    return logs.filter(all_of([of(k) == v for k, v in labels.items()])) if labels else logs


def select_logs(logs: DataFrame, start: int, end: int, labels: dict[str, str] | None = None) -> DataFrame:
    return matching(time_range(logs, start, end), labels or {}).orderBy("timestamp_ns", "doc_id")


def query_lines(logs: DataFrame, query: str | ParsedQuery, start: int, end: int) -> DataFrame:
    q = parse(query) if isinstance(query, str) else query
    rows = matching(time_range(logs, start, end), dict(q.labels))
    return rows.filter(F.col("message").contains(q.contains)) if q.contains is not None else rows


def query_range(logs: DataFrame, query: str | ParsedQuery, start: int, end: int) -> DataFrame:
    """The lines of each stream in time order, as rows: stream_key, timestamp_ns, doc_id, message."""
    return query_lines(logs, query, start, end).select("stream_key", "timestamp_ns", "doc_id", "message").orderBy("stream_key", "timestamp_ns", "doc_id")


def query_range_streams(logs: DataFrame, query: str | ParsedQuery, start: int, end: int) -> DataFrame:
    """A row for each stream: its key, count, first and last time."""
    rows = query_lines(logs, query, start, end).groupBy("stream_key")
    return rows.agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns")).orderBy("stream_key")


def point_lookup(logs: DataFrame, key: str) -> DataFrame:
    if len(key) != 32 or not all(c in "0123456789abcdef" for c in key):
        raise BadRequest("a doc_id is 32 hex digits")
    return logs.filter(F.col("doc_id") == key)


def page(rows: DataFrame, cursor: str | None, size: int) -> tuple[DataFrame, str | None]:
    """One page of ordered rows, and the next page's cursor if there is one; a cursor that isn't a number starts at 0."""
    offset = int(cursor) if cursor and cursor.isdecimal() else 0
    more = rows.offset(offset + size).limit(1).count()
    return rows.offset(offset).limit(size), str(offset + size) if more else None


def bounded(rows: DataFrame, most: int = 240) -> DataFrame:
    return rows.withColumn("truncated", F.char_length("message") > most).withColumn("message", bounded_message(F.col("message"), most))


def list_streams(logs: DataFrame, start: int, end: int, fields: tuple[str, ...] = FIELDS, sketches: DataFrame | None = None) -> DataFrame:
    """field, distinct values in the window, its first ten values, and where the number comes from.

    sketches: a HyperLogLog rollup (bucket_start, field, sketch); its fields get its estimate and no samples, and the
    records are not read for them. For the others distinct pairs are made first, so no list grows with the rows.
    """
    estimated = []
    if sketches is not None:
        ns = F.unix_micros("bucket_start") * 1000
        found = sketches.filter(F.col("field").isin(*fields) & (ns >= start) & (ns < end)).groupBy("field").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
        estimated = [(r["field"], r["n"], "", "hll_rollup_estimate") for r in found.collect()]  # a row for each field
    rest = [k for k in fields if k not in {e[0] for e in estimated}]
    out = logs.sparkSession.createDataFrame(estimated, "field string, distinct_values long, samples string, cardinality_source string")
    if rest:
        pairs = time_range(logs, start, end).select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"f_{k}").alias("value")) for k in rest])).alias("e")).select("e.*")
        pairs = pairs.filter("value is not null").distinct()
        # the limit is known to the plan: every task ranks its own values and passes ten on
        first = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("field").orderBy("value"))).filter(F.col("rn") <= 10)
        samples = first.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("samples"))
        exact = pairs.groupBy("field").agg(F.count("*").alias("distinct_values")).join(samples, "field")
        out = out.unionByName(exact.withColumn("cardinality_source", F.lit("exact_in_window")))
    return out


def find_anomalies(logs: DataFrame, start: int, end: int, baseline: tuple[int, int] | None = None, ratio: float = 3.0) -> DataFrame:
    """Templates that are new, or at least ``ratio`` times as frequent as in the baseline (the window before, if none is given)."""
    if baseline is None:
        baseline = (start - (end - start), start)
    lo, hi = min(start, baseline[0]), max(end, baseline[1])
    t = F.col("timestamp_ns")
    current, before = (t >= start) & (t < end), (t >= baseline[0]) & (t < baseline[1])
    counts = time_range(logs, lo, hi).groupBy("template_sig").agg(
        F.count(F.when(current, 1)).alias("current"), F.count(F.when(before, 1)).alias("baseline"), F.min_by(F.when(current, F.col("message")), F.when(current, F.struct("timestamp_ns", "doc_id"))).alias("example")
    )
    kind = F.when(F.col("baseline") == 0, "new").when(F.col("current") / F.col("baseline") >= ratio, "volume_spike")
    return counts.filter("current > 0").withColumn("kind", kind).filter("kind is not null").orderBy(F.desc("current"), "template_sig")


def get_context(logs: DataFrame, key: str, n: int, span_ns: int = 600_000_000_000) -> DataFrame:
    """The anchor and n lines of its stream on either side, within ``span_ns`` of it."""
    anchor = point_lookup(logs, key).select("timestamp_ns", "stream_key").first()
    if anchor is None:
        raise NotFound("no record has this doc_id")
    at = anchor["timestamp_ns"]
    rows = time_range(logs, at - span_ns, at + span_ns).filter(F.col("stream_key") == anchor["stream_key"])
    before = (F.col("timestamp_ns") < at) | (F.col("timestamp_ns") == at) & (F.col("doc_id") < key)
    # the first lines on either side, each a bounded sort
    sides = rows.filter(before).orderBy(F.desc("timestamp_ns"), F.desc("doc_id")).limit(n).unionAll(rows.filter(~before).orderBy("timestamp_ns", "doc_id").limit(n + 1))
    return sides.select("timestamp_ns", "doc_id", "message", (F.col("doc_id") == key).alias("is_anchor")).orderBy("timestamp_ns", "doc_id")
