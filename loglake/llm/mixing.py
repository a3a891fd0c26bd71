"""Mixing sources to target weights with DataFrame functions only.

Each document gets a hash-random key. The key's top bits cut every source into ranges; sums of the ranges give each
range's offset, and a running sum inside a range gives each document's place in its source's random order. A source's
budget is cut at exactly that many words, whole passes first.

Defined cases: a null text has no words; the null source is one source, last in order; repeated rows each count;
a source without words has target 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.llm.common import cut, pieces, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0
RANGES, RANGE_ROWS = 1024, 100_000  # ranges of keys, at least; rows of all sources that share a range, about
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """sizes: a row for each source (source, source_size). Adds target: the weighted share, no more than most_epochs times the size.

    A source is at its ceiling when the common level (words for each unit of weight) reaches ceiling / weight. With
    sources in that order, the level after k of them are full is (all - ceilings before) / (weights left); the largest
    such level is the one that holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(most_epochs))
    whole = Window.partitionBy()
    first = Window.orderBy((F.col("ceiling") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(whole) * F.lit(share) - F.coalesce(F.sum("ceiling").over(first), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(first), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return rows.select("source", "source_size", F.least("ceiling", F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken (words taken, repeats counted), and the columns in ``keep``."""
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))), 1, 15), 16, 10).cast("long")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), *keep)
    sized = cut(sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix")
    ranges = pieces(sized.count(), RANGE_ROWS, RANGES)  # they grow with the rows, so a range's rows fit a task at every size
    sized = sized.withColumn("range", F.floor(F.col("key") / F.lit((1 << 60) / ranges)).cast("int"))
    sums = sized.groupBy("skey", "source", "range").agg(F.sum("size").alias("range_size"))
    sums = cut(sums, "mix-ranges")
    of_source = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most_epochs)
    of_source = of_source.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset")).join(of_source, "skey")
    inside = Window.partitionBy("skey", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["skey", "range"])
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - passes * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("offset") - F.col("before"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"), *keep)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, ''))))[1:15])::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{', '.join(f'{float(x)}::DOUBLE' for x in WEIGHTS)}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM s),
c AS (SELECT *, source_size * {MOST_EPOCHS}::DOUBLE AS ceiling FROM w),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () * {SHARE}::DOUBLE - coalesce(sum(ceiling) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM c WINDOW f AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(ceiling, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (passes * size + least(greatest(floor(target)::BIGINT - passes * source_size - before, 0), size))::BIGINT AS taken FROM p
"""
