"""Full-text search in time buckets, vectors, and their fusion by reciprocal ranks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.functions.core import BadRequest, bucket, cosine_distance
from loglake.operators.query import bounded, matching, time_range
from loglake.operators.storage import drop_folders

BUCKET_NS = 300_000_000_000
MOST_BUCKETS = 200
PIECE_WORDS = 4_000_000
MOST_HITS = 1000
K1, B = 1.2, 0.75
RRF = 60


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def corpus(docs: DataFrame, width_ns: int | None = BUCKET_NS) -> DataFrame:
    """doc_id, bucket (0 for a corpus without time), text."""
    when = bucket(F.col("timestamp_ns"), width_ns) if width_ns else F.lit(0).cast("long")
    text = F.col("message") if "message" in docs.columns else F.col("text")
    return docs.select("doc_id", when.alias("bucket"), text.alias("text"))


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "bucket", tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))


def _postings(docs: DataFrame) -> DataFrame:
    """A row for each document and different word in it. The words of a document are counted inside its row, as runs of its sorted words: no table of all words is kept or shuffled for that."""
    w, n = F.col("sorted"), F.col("dl")
    rows = _words(docs).select("doc_id", "bucket", "dl", F.sort_array("w").alias("sorted"))
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1))))
    rows = rows.withColumn("starts", starts)
    after = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(n))
    counted = F.zip_with("starts", after, lambda a, b: F.struct(F.get(w, a).alias("term"), (b - a).cast("long").alias("tf")))
    # outer: else a filter on the size of the list goes below the exchange, where it makes all lists once more
    return rows.select("doc_id", "bucket", "dl", F.inline_outer(counted)).filter("term is not null").select("bucket", "term", "doc_id", "dl", "tf")


def build_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings (bucket, term, doc_id, dl, tf; rows of one document add up) and the buckets' facts (bucket, n, avgdl)."""
    return _postings(docs), _words(docs).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def write_index(docs: DataFrame, path: str) -> None:
    """Append the index of ``docs`` (see ``corpus``): postings and facts, in a folder for each bucket.

    Documents are dealt into pieces of about PIECE_WORDS words, by bucket, and a piece is sorted by term: a task's memory
    doesn't grow with the table or with the most frequent word, and a query reads few pages of each file. A bucket's facts
    are rows that add up, so later records of a bucket are indexed by themselves.
    """
    facts = _words(docs).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("dl").alias("length")).persist()  # a row for each bucket
    try:
        pieces = 1 + (facts.agg(F.sum("length")).first()[0] or 0) // PIECE_WORDS
        dealt = docs.repartitionByRange(pieces, "bucket", F.xxhash64("doc_id", "text"))
        _postings(dealt).sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
        facts.write.mode("append").partitionBy("bucket").parquet(f"{path}/facts")
    finally:
        facts.unpersist()


def read_index(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, width_ns: int = BUCKET_NS) -> tuple[DataFrame, DataFrame]:
    """postings and facts of the stored index; only of the buckets that touch [start, end) if these are given."""

    def own(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{name}")
        rows = rows if start is None else rows.filter((F.col("bucket") >= start - start % width_ns) & (F.col("bucket") < end))
        return rows.withColumn("bucket", F.col("bucket").cast("long"))

    facts = own("facts").groupBy("bucket").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl"))
    return own("postings"), facts


def strip_index(spark: SparkSession, path: str, start: int, end: int, width_ns: int = BUCKET_NS) -> int:
    """Delete the postings and facts of the buckets that lie whole in [start, end), as after archiving; gives their number."""
    whole = (F.col("bucket") >= start) & (F.col("bucket") + width_ns <= end)
    gone = [r[0] for r in spark.read.parquet(f"{path}/facts").select("bucket").distinct().filter(whole).collect()]
    drop_folders(spark, [f"{path}/{name}/bucket={b}" for b in gone for name in ("postings", "facts")])
    return len(gone)


def rebuild_index(spark: SparkSession, logs: DataFrame, path: str, start: int, end: int, width_ns: int = BUCKET_NS) -> None:
    """Index the buckets that lie whole in [start, end) anew from the records: nothing stays unsearchable after a loss."""
    strip_index(spark, path, start, end, width_ns)
    first, last = start + (-start) % width_ns, end - end % width_ns
    write_index(corpus(time_range(logs, first, last), width_ns), path)


def check_buckets(start: int, end: int, width_ns: int = BUCKET_NS) -> None:
    if (end - start) // width_ns + 1 > MOST_BUCKETS:
        raise BadRequest("the range spans too many buckets")


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in query.lower()).split()))


def scores(postings: DataFrame, facts: DataFrame, query: str) -> DataFrame:
    """bucket, doc_id and BM25 score (to 6 places) of every document with a term of the query."""
    terms = terms_of(query)
    hits = postings.filter(F.col("term").isin(terms) if terms else F.lit(False))
    # a document's hits meet in one task before they are counted: none adds up all that its part of the index holds
    rows = hits.repartition("bucket", "doc_id").groupBy("bucket", "doc_id", "term", "dl").agg(F.sum("tf").alias("tf"))
    df = rows.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    rows = rows.join(F.broadcast(df.join(facts, "bucket")), ["bucket", "term"])  # a row for each bucket and term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("bucket", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25(postings: DataFrame, facts: DataFrame, query: str, k: int, per_bucket: bool = True) -> DataFrame:
    """The k best doc_ids (bucket, doc_id, score to 6 places): the best of each bucket first, then of all."""
    scored = scores(postings, facts, query)
    if per_bucket:
        best = Window.partitionBy("bucket").orderBy(F.desc("score"), "doc_id")
        scored = scored.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).drop("rn")
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def search_logs(logs: DataFrame, query: str | None, start: int, end: int, k: int = 10, offset: int = 0, labels: dict[str, str] | None = None, width_ns: int = BUCKET_NS, exact_range: bool = True, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Best records of a time range: doc_id, score, timestamp_ns, message.

    Labels filter before the cut; edge buckets give rows outside the range unless ``exact_range``. Without a query all
    records of the range match, in time order, without scores. ``index`` is a stored one; else the range is indexed here.
    """
    k = min(k, MOST_HITS)
    if query is None:
        rows = matching(time_range(logs, start, end), labels or {})
        return rows.orderBy("timestamp_ns", "doc_id").offset(offset).limit(k).select("doc_id", F.lit(None).cast("double").alias("score"), "timestamp_ns", "message")
    check_buckets(start, end, width_ns)
    whole = time_range(logs, start - start % width_ns, end + (-end) % width_ns)
    postings, facts = index or build_index(corpus(whole, width_ns))
    scored = scores(postings, facts, query).select("doc_id", "score")
    wanted = matching(time_range(whole, start, end) if exact_range else whole, labels or {}).select("doc_id", "timestamp_ns", "message")
    if labels or exact_range:  # the records must be looked at before the cut
        return scored.join(wanted, "doc_id").orderBy(F.desc("score"), "doc_id").offset(offset).limit(k).select("doc_id", "score", "timestamp_ns", "message")
    top = scored.orderBy(F.desc("score"), "doc_id").offset(offset).limit(k)  # MOST_HITS rows at most
    return wanted.join(F.broadcast(top), "doc_id").orderBy(F.desc("score"), "doc_id").select("doc_id", "score", "timestamp_ns", "message")


def search_records(records: DataFrame, postings: DataFrame, facts: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The k best hits (doc_id, score) with their record's columns. Twice as many are fetched, so that hits whose record is gone can give way; those come last, with nulls."""
    if not query.strip():
        raise BadRequest("a query is missing")
    k = min(k, MOST_HITS)
    hits = F.broadcast(bm25(postings, facts, query, 2 * k).select("doc_id", "score"))  # 2 * MOST_HITS rows at most
    found = records.withColumn("found", F.lit(True)).join(hits, "doc_id", "right")
    return found.orderBy(F.col("found").asc_nulls_last(), F.desc("score"), "doc_id").limit(k).drop("found")


def search_page(logs: DataFrame, query: str | None, start: int, end: int, k: int = 10, cursor: str | None = None, **kw) -> tuple[DataFrame, str | None, int]:
    """One page of ``search_logs`` with bounded messages, the next page's cursor if there is one, and how many records were considered: all before the page, its own, and the one after.

    A cursor that isn't a number starts at 0.
    """
    offset, k = int(cursor) if cursor and cursor.isdecimal() else 0, min(k, MOST_HITS - 1)
    found = search_logs(logs, query, start, end, k + 1, offset, **kw).collect()  # a page and one row
    rows = logs.sparkSession.createDataFrame(found[:k], "doc_id string, score double, timestamp_ns long, message string")
    return bounded(rows), str(offset + k) if len(found) > k else None, offset + len(found)


def embed(docs: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "message", batch: int = 256) -> DataFrame:
    """doc_id and embedding (array<float>) by a function that gives vectors for a list of texts; null texts count as empty."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            part = part.fillna("")
            yield pd.Series([v for i in range(0, len(part), batch) for v in embedder(part.iloc[i : i + batch].tolist())], dtype=object)

    vectors = F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)
    return docs.select("doc_id", vectors(F.col(text)).alias("embedding"))


def put_vectors(vectors: DataFrame, path: str) -> None:
    """Append (doc_id, embedding) rows to a vector table; ``vectors_of`` reads the last vector put for each id."""
    vectors.select("doc_id", "embedding", F.current_timestamp().alias("put_at")).write.mode("append").parquet(path)


def vectors_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("doc_id").agg(F.max_by("embedding", "put_at").alias("embedding"))


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """doc_id and cosine distance, nearest first; the query is one literal. Zero vectors and null ones are near to nothing."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = F.lit(math.sqrt(reduce(lambda s, x: s + float(x) * float(x), query, 0.0)))
    near = vectors.select("doc_id", (F.round(cosine_distance(F.col("embedding"), q, length), 6) + 0.0).alias("distance"))
    # NaN and then null sort behind every distance, so they are left out of the k rows: a filter before works out the distance three times a row
    return near.orderBy(F.asc_nulls_last("distance"), "doc_id").limit(k).filter("distance is not null and not isnan(distance)")


def rrf(lists: list[tuple[DataFrame, list[Column]]], k: int) -> DataFrame:
    """Fuse ranked lists (doc_id, order): the sum of 1 / (60 + rank). Each list is already cut to a few rows."""
    ranked = [rows.select("doc_id", F.row_number().over(Window.orderBy(*order)).alias("rn")) for rows, order in lists]
    fused = reduce(DataFrame.unionAll, ranked).groupBy("doc_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rn"))), 6).alias("score"))
    return fused.orderBy(F.desc("score"), "doc_id").limit(k)


def hybrid(hits: DataFrame, vectors: DataFrame | None, query: list[float] | None, k: int) -> DataFrame:
    """Text hits (doc_id, score) fused with the nearest vectors; without vectors the text order holds."""
    if vectors is None or query is None:
        return hits.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(k)
    return rrf([(hits, [F.desc("score"), F.col("doc_id")]), (knn(vectors, query, 2 * k), [F.col("distance"), F.col("doc_id")])], k)
