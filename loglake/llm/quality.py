"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are trained here, on the statistics of a bounded sample of labelled documents, and flattened into arrays
(feature, threshold, children, value) that every task walks with numpy, one level of all documents at a time.

Defined cases: a null text counts as empty and both get a score; a null doc_id is held out; labels of one doc_id are
averaged and null labels ignored; of a doc_id with several texts the one of least hash teaches; without any label every
score is 0.5; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import fold, table

FOLDS = 5
SAMPLE_ROWS = 20_000  # labelled rows that the trees are fitted on, at most
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAST_LEAF, RIDGE = 80, 5, 64, 0.12, 20, 1.0
FEATURES = (
    "bytes", "words", "word_bytes", "distinct_words", "top_word", "top_5_words", "repeats", "distinct_pairs", "lines",
    "distinct_lines", "upper", "lower", "digits", "spaces", "marks", "exclamations", "stops", "high_bytes", "longest_word",
    "deflated", "capital_words", "one_letter_words",
)


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words, n = raw.split(), max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(5)] or [0]
    w, lines = max(len(words), 1), [x for x in raw.split(b"\n") if x.strip()]
    pairs = max(len(words) - 1, 1)
    marks = hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w, len(counts) / w, top[0] / w, sum(top) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, len(set(zip(words, words[1:]))) / pairs, np.log1p(len(lines)),
        len(set(lines)) / max(len(lines), 1), hist[65:91].sum() / n, hist[97:123].sum() / n, hist[48:58].sum() / n,
        (hist[9:14].sum() + hist[32]) / n, marks / n, hist[33] / w, hist[46] / w, hist[128:].sum() / n,
        np.log1p(max(map(len, words), default=0)), len(zlib.compress(raw, 1)) / n, sum(x[:1].isupper() for x in words) / w,
        sum(len(x) == 1 for x in words) / w,
    ]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> dict:
    """Boosted trees of logistic loss. Each tree is a full binary tree in arrays: node i has children 2i+1 and 2i+2."""
    n, m = x.shape if len(y) else (0, len(FEATURES))
    p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    nodes = 2 ** (depth + 1) - 1
    model = {"base": np.log(p0 / (1 - p0)), "depth": depth, "feature": np.zeros((trees, nodes), np.int32), "threshold": np.full((trees, nodes), np.inf), "value": np.zeros((trees, nodes))}
    if not n:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)])
    score = np.full(n, model["base"])
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h, node = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            at_feature, at_bin = np.zeros(width, np.int64), np.full(width, -1)
            for j in range(m):
                slot = (node - first) * bins + binned[j]
                live = node >= first
                hist = [np.bincount(slot[live], w[live], width * bins).reshape(width, bins).cumsum(1) for w in (g, h, np.ones(n))]
                (gl, hl, cl), (gt, ht, ct) = hist, (a[:, -1:] for a in hist)
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain = np.where((cl >= LEAST_LEAF) & (ct - cl >= LEAST_LEAF), gain, -1.0)
                k = gain.argmax(1)
                more = gain[np.arange(width), k]
                won = more > best
                best[won], at_feature[won], at_bin[won] = more[won], j, k[won]
            for i in np.flatnonzero(at_bin >= 0):
                j, b = at_feature[i], at_bin[i]
                if b < len(edges[j]):
                    model["feature"][t, first + i], model["threshold"][t, first + i] = j, edges[j][b]
            go_right = x[np.arange(n), model["feature"][t, node]] > model["threshold"][t, node]
            node = 2 * node + 1 + go_right
        gs, hs = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        model["value"][t] = -rate * gs / (hs + RIDGE)
        score += model["value"][t, node]
    return model


def walk(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores in (0, 1); all rows go down one level of a tree at a time."""
    total, rows = np.full(len(x), float(model["base"])), np.arange(len(x))
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        total += value[node]
    return 1 / (1 + np.exp(-total))


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fit on at most ``sample_rows`` labelled documents outside fold 0, chosen by a hash of their ids."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("__id"), "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).withColumn("k", F.xxhash64("doc_id", "text"))
    # a label teaches with one text, however many rows its id has
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct("k", "text")).alias("text"), F.first("y").alias("y"), F.min("k").alias("k")).select("text", "y", "k")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_matrix(b["text"])), pa.list_(pa.float64())), b["y"], b["k"]], ["x", "y", "k"])

    found = rows.mapInArrow(measure, "x array<double>, y double, k long").toPandas().sort_values("k")
    return fit(np.array(found["x"].tolist()).reshape(-1, len(FEATURES)), found["y"].to_numpy(float))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with score (double) and predicted (int)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size is fixed by TREES and DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = walk(shared.value, _matrix(b["__text"]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    kept = docs.select(*keep, F.col("text").alias("__text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return kept.mapInArrow(run, f"{out}, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
