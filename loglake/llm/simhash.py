"""SimHash near-dedup: vantage-point trees over 64-bit fingerprints.

Distances between unrelated fingerprints lie close about 32, so a boundary of 4 bits on either side of it would copy over a
third of all fingerprints at every split and prune next to nothing. The trees that deal all fingerprints out therefore
measure thirds: two fingerprints within 4 bits are within 1 bit in one of three blocks. For each block a tree of vantage
points, learned from a bounded sample, splits by the Hamming distance of that block; fingerprints within 1 bit of a
boundary go to both sides, so every link lies whole in a shard. A shard of too many fingerprints is dealt again by trees
over the other two blocks, in one of which a link keeps within 2 bits. Inside a shard a vantage-point tree over whole
fingerprints joins it with itself: the triangle bound leaves only fingerprints near a boundary to be compared across it,
and all within 4 bits of a vantage point are one class at once, so that dense clouds are not compared pair by pair. Each
shard gives a spanning forest of its links, never all pairs, and contraction joins the forests into components.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; repeated rows each get a
row; a null doc_id takes part but never names a component (a component of null ids only has a null component_id); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import cut, table, tasks

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit and bits
SAMPLE = 131_072  # fingerprints that trees are learned from, at most
SHARD = 1024  # fingerprints of a shard, about
HOT_SHARD = 16_384
LEAF = 256


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, and only 0x20 and 0x09-0x0D divide
    if not words:
        return 0
    grams = [b" ".join(g) for g in zip(*[words[i:] for i in range(shingle)])] if len(words) >= shingle else [b" ".join(words)]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(grams), 16384):
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[i : i + 16384]], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(grams), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (long) and the columns ``keep`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint_of(t.as_py(), shingle) for t in b["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], fp, *[b[k] for k in keep]], ["doc_id", "fp", *keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; label[i] is the smallest member's place."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label[:] = label[label]


def tree_links(fp: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """Class of each fingerprint (uint64) under links of at most ``radius`` bits, by a vantage-point tree joined with itself."""
    label = np.arange(len(fp))
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(label.copy(), None)]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 1024):
            for j in range(0, len(b), 1024):
                x, y = np.nonzero(np.bitwise_count(fp[a[i : i + 1024], None] ^ fp[None, b[j : j + 1024]]) <= radius)
                merge(label, a[i + x], b[j + y])

    while todo:
        a, b = todo.pop()
        if len(a) <= leaf or (b is not None and len(b) <= leaf):
            compare(a, a if b is None else b)
            continue
        da = np.bitwise_count(fp[a] ^ fp[a[0]]).astype(np.int64)
        db = da if b is None else np.bitwise_count(fp[b] ^ fp[a[0]]).astype(np.int64)
        for x, d in ((a, da), (b, db)):  # the ball about the vantage point is one class
            if x is not None:
                ball = x[d <= radius]
                merge(label, np.full(len(ball), a[0]), ball)
        mid = int(np.median(da))
        if b is None and (da <= radius).mean() >= 0.1:  # a dense cloud: split off the ball, in which nothing is left to compare
            mid = radius
        elif not (da > mid).any():
            mid -= 1
        near, far = da <= mid, da > mid
        if not near.any() or b is not None and not far.any():
            compare(a, a if b is None else b)
            continue
        edge_near, edge_far = da > mid - radius, da <= mid + radius
        if b is None:
            pairs = [(a[near], None), (a[far], None), (a[near & edge_near], a[far & edge_far])]
        else:
            near_b, far_b, edge_b, edge_far_b = db <= mid, db > mid, db > mid - radius, db <= mid + radius
            pairs = [(a[near], b[near_b]), (a[far], b[far_b]), (a[near & edge_near], b[far_b & edge_far_b]), (a[far & edge_far], b[near_b & edge_b])]
        todo += [(x, y) for x, y in pairs[mid <= radius :] if len(x) and (y is None or len(y))]
    return label


def learn_tree(values: np.ndarray, edge: int, most: float) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, distance, near child, far child) of a tree over a sample; a child under 0 is the shard -1 - child.

    A node is split while its part of the sample is over ``most``, at the distance that leaves the least to compare,
    those within ``edge`` beyond it counted on both sides.
    """
    nodes: list[list[int]] = []
    shards = 0
    todo = [(values, -1, 0)]  # values, parent, which of its children
    while todo:
        own, parent, side = todo.pop()
        best = None
        if len(own) > max(most, 8):
            d = np.bitwise_count(own ^ own[len(own) // 2]).astype(np.int64)
            upto = np.cumsum(np.bincount(d, minlength=65))
            near, far = upto[np.minimum(np.arange(65) + edge, 64)], len(own) - upto
            cost = near.astype(float) ** 2 + far.astype(float) ** 2
            mid = int(cost.argmin())
            if max(near[mid], far[mid]) < 0.9 * len(own) and far[mid]:
                best = mid
        at = len(nodes) if best is not None else -1 - shards
        if parent >= 0:
            nodes[parent][2 + side] = at
        if best is None:
            shards += 1
            continue
        nodes.append([int(own[len(own) // 2]), best, 0, 0])
        todo += [(own[d <= best + edge], at, 0), (own[d > best], at, 1)]
    return [tuple(x) for x in nodes]


def deal(values: np.ndarray, tree: list[tuple[int, int, int, int]], edge: int) -> Iterator[tuple[int, np.ndarray]]:
    """The shards of the tree, and the places of the values in each."""
    todo = [(0 if tree else -1, np.arange(len(values)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at < 0:
            yield -1 - at, own
            continue
        vantage, mid, near, far = tree[at]
        d = np.bitwise_count(values[own] ^ np.uint64(vantage))
        todo += [(near, own[d <= mid + edge]), (far, own[d > mid])]


def _block(fp: np.ndarray, j: int) -> np.ndarray:
    first, bits = BLOCKS[j]
    return fp.view(np.uint64) >> np.uint64(first) & np.uint64((1 << bits) - 1)


def _trees(fps: DataFrame, n: int, edge: int) -> list[list[tuple[int, int, int, int]]]:
    """A tree for each block; fps: fp, of which ``n`` at most can meet in one shard."""
    sample = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp", F.lit("sample"))).limit(SAMPLE).collect()], np.int64)
    return [learn_tree(_block(sample, j), edge, len(sample) * SHARD / max(n, 1)) for j in range(len(BLOCKS))]


def _dealt(rows: DataFrame, trees: list, edge: int, others: bool) -> DataFrame:
    """rows: shard, fp. To finer shards, by the tree of each block; with ``others`` by those of the blocks that the shard's own isn't."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # nodes are fewer than 3 * SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, fp = b["shard"].to_numpy(), b["fp"].to_numpy()
            for j, tree in enumerate(shared.value):
                own = np.flatnonzero(shard % 3 != j) if others else np.arange(len(fp))
                leaves = list(deal(_block(fp[own], j), tree, edge))
                if leaves:
                    at = own[np.concatenate([x for _, x in leaves])]
                    leaf = np.repeat([x for x, _ in leaves], [len(x) for _, x in leaves])
                    # the last digit (of base 3) names the block
                    finer = (shard[at] * 1_000_003 + leaf) % (1 << 58) * 3 + j
                    yield pa.RecordBatch.from_arrays([pa.array(finer), pa.array(fp[at])], ["shard", "fp"])

    return rows.mapInArrow(run, "shard long, fp long")


def _shards(fps: DataFrame) -> DataFrame:
    """shard, fp: every link lies whole in at least one shard."""
    n = fps.count()
    dealt = cut(_dealt(fps.select(F.lit(0).cast("long").alias("shard"), "fp"), _trees(fps, n, RADIUS // 3), RADIUS // 3, False), "shards")
    counts = cut(dealt.groupBy("shard").count().filter(F.col("count") > HOT_SHARD), "hot-shards")
    most = counts.agg(F.max("count")).first()[0]
    if most is None:
        return dealt
    both = dealt.join(counts.select("shard", F.lit(True).alias("hot")), "shard", "left")
    hot = cut(both.filter("hot").select("shard", "fp"), "hot")
    finer = _dealt(hot, _trees(hot.select("fp").distinct(), most, RADIUS // 2), RADIUS // 2, True)
    return both.filter("hot is null").select("shard", "fp").unionAll(finer)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest of each shard's links; fps: distinct fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(s: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            for own in np.split(f, np.flatnonzero(np.diff(s)) + 1):
                if len(own) < 2:
                    continue
                own = np.unique(own)
                label = tree_links(own.view(np.uint64))
                member = np.flatnonzero(label != np.arange(len(own)))
                if len(member):
                    a.append(own[label[member]])
                    b.append(own[member])
            both = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], ["a", "b"])

        for batch in batches:
            s = np.concatenate([held_s, batch["shard"].to_numpy()])
            f = np.concatenate([held_f, batch["fp"].to_numpy()])
            if len(s):
                done = int(np.searchsorted(s, s[-1], side="left"))  # the last shard may go on in the next batch
                if done:
                    yield edges(s[:done], f[:done])
                held_s, held_f = s[done:], f[done:]
        if len(held_s):
            yield edges(held_s, held_f)

    dealt = _shards(fps).repartition(tasks(fps.sparkSession), "shard").sortWithinPartitions("shard", "fp")
    return dealt.select("shard", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node -> root for every node of ``edges`` (a, b), by contraction: each node takes its smallest neighbour's name by turns.

    Names are compared by hash, so that chains are short; a round's edges and names are written tables.
    """
    both = edges.filter("a != b").select("a", "b").unionAll(edges.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, "edges")
    roots = None
    while True:
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        hop = cut(least.select("a", F.least("m", own)["b"].alias("to")), "hop")
        jump = hop.select(F.col("a").alias("to"), F.col("to").alias("to2"))
        hop = cut(hop.join(jump, "to", "left").select("a", F.coalesce("to2", "to").alias("to")), "hop")
        if roots is None:
            roots = hop.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            roots = roots.join(hop.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = cut(roots, "roots")
        a, b = hop.select("a", F.col("to").alias("ra")), hop.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        both = cut(both.join(a, "a").join(b, "b").filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if both.isEmpty():
            return roots


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach), root (a fingerprint, one for each component) and ``keep`` of each row."""
    marked = cut(fingerprints(docs, keep=keep), "fingerprints")
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(links(fps.select("fp")))
    named = cut(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "named")
    # written, so that the join can split a component of very many fingerprints
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    of_fp = named.join(least, "root").select("fp", "component_id", "root")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id", "root", *keep)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
