"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts by repeated bisection; a small classifier learns each
vector's part. It files every row, and sends each query to the several parts that it finds most probable, whose rows
are ranked exactly. The number of parts probed is the least with which the sample's own queries find their neighbours.
There are LEAST_PARTS parts at least, and more as the rows grow; beyond MOST_PARTS of them each part is cut again, by a
classifier of its own that a sample of its rows teaches. Rows of a part meet its queries in slices and blocks of bounded
size.

Defined cases: vectors that are null, zero, hold a null or non-finite component, or have another dimension than most
take no part, nor do rows with a null vec_id; an empty table gives no rows; with fewer than k candidates a query gets
them all; repeated rows are candidates each, but ask once; an id with several different vectors asks with each of them,
and a candidate row then counts once, with its best score; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.llm.common import cut, runs, table, tasks

K = 20
QUERIES = 20  # ids that it divides are queries
SAMPLE = 4096  # vectors that a partition is learned on, at most
LEAST_PARTS, MOST_PARTS = 16, 256
PART_ROWS = 4000
GRAPH_NEIGHBOURS = 10
SAMPLE_RECALL = 0.98
SLICE_ROWS, QUERY_BLOCK = 32_768, 16_384  # rows of a part, and its queries, that meet in one task


def graph_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """Balanced parts of the neighbour graph: bisections at the median of a smooth vector of the graph."""
    n = len(x)
    near = np.argpartition(-(x @ x.T), min(GRAPH_NEIGHBOURS, n - 1), axis=1)[:, : GRAPH_NEIGHBOURS + 1]
    part, rng = np.zeros(n, np.int64), np.random.default_rng(0)
    for _ in range(parts.bit_length() - 1):
        new = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            rows = np.repeat(np.arange(len(own)), near.shape[1])
            cols = place[near[own]].ravel()
            rows, cols = rows[cols >= 0], cols[cols >= 0]
            v = rng.normal(size=len(own))
            degree = np.maximum(np.bincount(rows, minlength=len(own)) + np.bincount(cols, minlength=len(own)), 1)
            for _ in range(60):  # power steps of the lazy walk, without its constant part
                v -= (v * degree).sum() / degree.sum()
                v = (v + (np.bincount(rows, v[cols], len(own)) + np.bincount(cols, v[rows], len(own))) / degree) / 2
                v /= np.linalg.norm(v) or 1.0
            rank = np.empty(len(own), np.int64)
            rank[np.argsort(v, kind="stable")] = np.arange(len(own))
            new[own] += rank >= len(own) // 2
        part = new
    return part


def fit(x: np.ndarray, parts: int, k: int = K, recall: float = SAMPLE_RECALL) -> dict:
    """A softmax classifier of the parts, and how many parts to probe."""
    n, d = x.shape
    scale = np.sqrt((x**2).sum(1).mean())
    w, b = np.zeros((d, parts)), np.zeros(parts)
    part = graph_parts(x, parts)
    hot, xs = np.eye(parts)[part], x / scale
    m, s = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, 201):
        z = xs @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, g in enumerate((xs.T @ (p - hot) / n + 1e-4 * w, (p - hot).mean(0))):
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.99 * s[i] + 0.01 * g * g
            (w, b)[i][...] -= 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-9)
    z = xs @ w + b
    home, order = z.argmax(1), np.argsort(-z, axis=1)
    if n <= k:
        return {"w": w, "b": b, "scale": scale, "probes": parts}
    q = np.arange(min(n, 512))
    sims = x[q] @ x.T
    sims[q, q] = -np.inf
    best = np.argpartition(-sims, k, axis=1)[:, :k]
    rank = np.argsort(order[q], axis=1)  # rank[i, p]: when query i probes part p
    when = np.take_along_axis(rank, home[best], axis=1)
    probes = next(m for m in range(1, parts + 1) if (when < m).mean() >= recall or m == parts)
    return {"w": w, "b": b, "scale": scale, "probes": min(parts, probes + 1)}


def route(model: dict, x: np.ndarray) -> np.ndarray:
    """For each row the parts that it most probably belongs to, best first, as many as are probed."""
    return np.argsort(-(x / model["scale"] @ model["w"] + model["b"]), axis=1, kind="stable")[:, : model["probes"]]


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).filter("vec_id is not null and v is not null")
    fine: Column = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("v", lambda v: v != 0)
    return rows.filter(fine)


class Nearest:
    """The best ``k`` rows met so far by each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.low = np.full(len(ids), -np.inf)  # a row under it is not among the best
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # place of the query, vec_id, score
        self.rows = np.empty(0, np.int64)  # of each of the best, the number of its row

    def _without_idle_copies(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rows that can be among a query's best: of equal vectors, those of the k + 1 smallest ids, k rows of an id (one may be the query's)."""
        h = (x * np.cos(np.arange(x.shape[1]))).sum(1)
        order = np.lexsort((ids, h))
        near, rows = ids[order], x[order]
        same = np.r_[False, (rows[1:] == rows[:-1]).all(1)]
        same_id = same & np.r_[False, near[1:] == near[:-1]]
        count = np.arange(len(near))
        of_id = count - np.maximum.accumulate(np.where(same_id, 0, count))
        new_ids = np.cumsum(~same_id)
        rank = new_ids - np.maximum.accumulate(np.where(same, 0, new_ids))
        return order[(of_id < self.k) & (rank <= self.k)]

    def meet(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Rank rows for the queries."""
        rows = np.zeros(len(ids), np.int64) if rows is None else rows
        live = self._without_idle_copies(ids, x)
        ids, x, rows, found = ids[live], x[live], rows[live], [(*self.best, self.rows)]
        for i in range(0, len(self.ids), 256):
            own = np.arange(i, min(i + 256, len(self.ids)))
            sims = self.q[own] @ x.T
            sims[self.ids[own, None] == ids[None, :]] = -np.inf
            if len(ids) >= self.k:
                kth = np.partition(sims, -self.k, axis=1)[:, -self.k]
                self.low[own] = np.maximum(self.low[own], self._slack(kth))
            a, c = np.nonzero((sims >= self.low[own, None]) & (sims > -np.inf))
            exact = (x[c] * self.q[own[a]]).sum(1)  # the same sum for equal vectors wherever they lie
            found.append((own[a], ids[c], exact, rows[c]))
        query, near, score, rows = map(np.concatenate, zip(*found))
        order = np.lexsort((near, -score, query))
        query, near, score, rows = query[order], near[order], score[order], rows[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        last, top = rank == self.k - 1, rank < self.k
        self.low[query[last]] = np.maximum(self.low[query[last]], self._slack(score[last]))
        self.best, self.rows = (query[top], near[top], score[top]), rows[top]

    @staticmethod
    def _slack(score: np.ndarray) -> np.ndarray:
        """A little less: products of matrices and sums of products can differ in their last digits."""
        return score - 1e-9 * (1 + np.abs(score))

    def found(self) -> pa.RecordBatch:
        query, near, score = self.best
        columns = [pa.array(c, pa.int64()) for c in (self.ids[query], near, self.rows)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], ["query_id", "vec_id", "row", "score"])


def vectors_of(b: pa.RecordBatch, d: int) -> np.ndarray:
    return b["v"].flatten().to_numpy().reshape(-1, d)


def _learn(rows: DataFrame, n: int, sample: int) -> np.ndarray:
    """At most ``sample`` different vectors, chosen by their hash."""
    some = rows.filter(F.pmod(F.xxhash64("v"), F.lit(max(1, n // (8 * sample)))) == 0).select("v").dropDuplicates(["v"])
    learned = some.orderBy(F.xxhash64("v"), "v").limit(sample).collect() or rows.limit(1).collect()
    return np.array([r["v"] for r in learned], float)


def _cut_again(home: DataFrame, asks: DataFrame, n: int, parts: int, inner: int, sample: int, k: int, recall: float, d: int) -> tuple[DataFrame, DataFrame]:
    """Every part in ``inner`` parts, by a classifier of its own: the same tables, with finer parts."""
    h = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    some = home.filter(h < int((1 << 30) * min(1.0, 4 * sample * parts / n)))
    order = Window.partitionBy("part").orderBy(F.xxhash64("v"), "v")
    some = some.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= sample)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(np.array(rows["v"].tolist(), float), axis=0)
        return pd.DataFrame({"part": rows["part"][:1], "model": [pickle.dumps(fit(x, inner, k, recall))]})

    models = cut(some.select("part", "v").groupBy("part").applyInPandas(learn, "part int, model binary"), "models")
    share = lambda kind, df: df.select("part", F.pmod(F.xxhash64("row"), F.lit(inner)).alias("share"), F.lit(kind).alias("kind"), "vec_id", "v", "row", F.lit(None).cast("binary").alias("model"))
    first = models.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(inner - 1).cast("long"))).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("long").alias("row"), "model")
    met = first.unionAll(share(1, home)).unionAll(share(2, asks)).repartition(tasks(home.sparkSession), "part", "share").sortWithinPartitions("part", "share", "kind")

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = whole = {"w": np.zeros((d, inner)), "b": np.zeros(inner), "scale": 1.0, "probes": inner}
        at = None
        for (part, share, kind), b in runs(batches, "part", "share", "kind"):
            if (part, share) != at:
                at, model = (part, share), whole  # a part without a sample is one part inside
            if kind == 0:
                model = pickle.loads(b["model"][0].as_py())
                continue
            to = route(model, vectors_of(b, d))
            to = to[:, :1] if kind == 1 else to
            rows = pa.array(np.repeat(np.arange(b.num_rows), to.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array((part * inner + to).ravel(), pa.int32()), *[b[c].take(rows) for c in ("kind", "vec_id", "v", "row")]], ["part", "kind", "vec_id", "v", "row"])

    finer = cut(met.mapInArrow(refine, "part int, kind int, vec_id long, v array<double>, row long"), "finer")
    return finer.filter("kind = 1").drop("kind"), finer.filter("kind = 2").drop("kind")


def search(vectors: DataFrame, k: int = K, every: int = QUERIES, sample: int = SAMPLE, recall: float = SAMPLE_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = _valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes["d"], sizes["count"]
    rows = rows.filter(F.size("v") == d)
    wanted = max(LEAST_PARTS, 1 << (n // PART_ROWS).bit_length())
    parts = min(MOST_PARTS, wanted)
    shared = spark.sparkContext.broadcast(fit(_learn(rows, n, sample), parts, k, recall))  # d * MOST_PARTS numbers at most

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            to, ids = route(shared.value, vectors_of(b, d)), b["vec_id"].to_numpy()
            probes = np.where(ids % every == 0, to.shape[1], 1)  # only queries are sent to more than the first
            chosen = pa.array(to[np.arange(to.shape[1]) < probes[:, None]], pa.int32())
            row = np.arange(count, count + len(ids))
            count += len(ids)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(probes)], pa.int32()), chosen)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], lists, pa.array(row)], ["vec_id", "v", "parts", "row"])

    filed = cut(rows.mapInArrow(file, "vec_id long, v array<double>, parts array<int>, row long"), "filed")
    home = filed.select(F.get("parts", F.lit(0)).alias("part"), "vec_id", "v", "row")
    asks = cut(filed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]), "asking")  # it is read twice, and the two must agree on the parts of repeated rows
    asks = asks.select(F.explode("parts").alias("part"), "vec_id", "v", "row")
    if wanted > MOST_PARTS:
        home, asks = _cut_again(home, asks, n, parts, min(MOST_PARTS, wanted // MOST_PARTS), sample // 4, k, recall, d)
    # rows of a part meet its queries in slices and blocks; the facts have a row for each part, MOST_PARTS^2 at most
    counts = lambda df, most, name: df.groupBy("part").agg(F.ceil(F.count("*") / most).alias(name))
    facts = F.broadcast(cut(counts(home, SLICE_ROWS, "slices").join(counts(asks, QUERY_BLOCK, "blocks"), "part"), "facts"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    base = home.join(facts, "part").select("part", F.pmod(F.xxhash64("row"), "slices").alias("slice"), each("blocks").alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "row")
    queries = asks.join(facts, "part").select("part", each("slices").alias("slice"), F.pmod(F.xxhash64("row"), "blocks").alias("block"), F.lit(0).alias("kind"), "vec_id", "v", "row")
    keys = ["part", "slice", "block"]
    met = queries.unionByName(base).repartition(tasks(spark), *keys).sortWithinPartitions(*keys, "kind")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, asked, nearest = None, [], None
        for (*key, kind), b in runs(batches, *keys, "kind"):
            if key != unit:
                if nearest:
                    yield nearest.found()
                unit, asked, nearest = key, [], None
            ids, x = b["vec_id"].to_numpy(), vectors_of(b, d)
            if kind == 0:
                asked.append((ids, x))
            elif asked:
                nearest = nearest or Nearest(*map(np.concatenate, zip(*asked)), k)
                nearest.meet(ids, x, b["row"].to_numpy())
        if nearest:
            yield nearest.found()

    found = met.mapInArrow(rank, "query_id long, vec_id long, row long, score double").repartition(tasks(spark), "query_id")
    # several vectors of one id can find the same row: it keeps its best score
    found = found.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
