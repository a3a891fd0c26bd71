"""Suffix-array dedup with run-length compressed indexes.

Every 200-byte window owns one of its 32-byte strings, its anchor: the one of least hash. Equal windows own equal strings,
so the windows of one anchor string can repeat only among themselves; anchors that occur once end there. Anchors deal the
work out: the different surroundings of an anchor (all windows it owns), each with the number of its copies, go to one
index. An index is the Burrows-Wheeler transform of its texts in runs, with a text place and a shared length at the two
ends of each run; the suffix array that it is made of is dropped. Inside a run a match shrinks by one byte at each step, so
the samples give the matching statistics of every place as the texts are streamed past them, and windows that match
elsewhere for 200 bytes are marked. What is marked in a surroundings holds for all its copies. An anchor of too many
surroundings is dealt again: by its distance to the window and the bytes that windows of like distance have in common.

Texts of a row and surroundings are told apart by 128-bit hashes.

Defined cases: a null text has no bytes; texts under 200 bytes never match; repeated rows match each other and each get
a row; a null doc_id is an id like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import cut, slices, table, tasks

LENGTH = 200
ANCHOR = 32
SEGMENT = 1 << 18  # window starts that are hashed at a time
INDEX_BYTES = 1 << 18  # text of one index, about
HOT_GROUP = 500  # different surroundings of one anchor that an index takes; more are split by their common bytes
SPLITS = (21, 1)  # distances to the anchor that a split group's windows share, first and again
_BYTE_HASH = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.array([0x9E3779B97F4A7C15], np.uint64)  # an array: it wraps without a warning


def _window_owners(data: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For window starts first..last-1 of ``data``: place of the owned anchor, and its hash."""
    part = data[first : last + LENGTH - 1]
    h, power, size = _BYTE_HASH[part], _STEP, 1
    while size < ANCHOR:
        h = h[:-size] * power + h[size:]
        power, size = power * power, size * 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << 22) - 1)  # a segment's places fit; ties of the rest go to the first place
    m, size, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, LENGTH - ANCHOR + 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if width > size:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    at = (m & low).astype(np.int64)
    return at + first, h[at].view(np.int64)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals by doc."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = (doc.astype(np.int64) - doc[0]) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.r_[True, start[1:] + shift[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
    return doc[new], start[new], (reach - shift)[last]


def _hashes(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each, in two numbers."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in parts), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _row_keys(ids: list[int | None], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _hashes(b"%d" % i + xxhash.xxh3_128_digest(x) if i is not None else xxhash.xxh3_128_digest(x) for i, x in zip(ids, raw))


ANCHORS = "ah long, c1 long, c2 long, n int, p int, size int, k1 long, k2 long, s int, more array<struct<k1:long,k2:long,s:int>>"
_PLACE = pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int32())])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each anchor and surroundings in a piece of the texts: how often they occur, and where."""
    for b in slices(batches, "text", 4 << 20):
        raw = [(t.as_py() or "").encode() for t in b["text"]]
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
        doc_of, place, hashes, starts = [], [], [], []
        for first in range(0, len(data) - LENGTH + 1, SEGMENT):
            last = min(first + SEGMENT, len(data) - LENGTH + 1)
            at, h = _window_owners(data, first, last)
            start = np.arange(first, last)
            doc = np.searchsorted(ends, start, side="right")
            inside = start + LENGTH <= ends[doc]
            at, h, start, doc = at[inside], h[inside], start[inside], doc[inside]
            new = np.r_[True, at[1:] != at[:-1]][: len(at)]
            closing = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1][: int(new.sum())]
            doc_of.append(doc[new])
            place.append(at[new])
            hashes.append(h[new])
            starts.append(np.stack([start[new], start[closing]]))
        if not doc_of or not sum(map(len, doc_of)):
            continue
        doc, at, ah, (s, e) = np.concatenate(doc_of), np.concatenate(place), np.concatenate(hashes), np.concatenate(starts, axis=1)
        view = memoryview(data)
        # the anchor's place belongs to the surroundings: equal bytes around it at another place are others
        c1, c2 = _hashes(b"%d " % (z - x) + view[x : y + LENGTH] for x, y, z in zip(s.tolist(), e.tolist(), at.tolist()))
        k1, k2 = (k[doc] for k in _row_keys(b["doc_id"].to_pylist(), raw))
        begin = s - np.r_[0, ends[:-1]][doc]
        order = np.lexsort((begin, k2, k1, c2, c1, ah))
        same = np.r_[False, (ah[order][1:] == ah[order][:-1]) & (c1[order][1:] == c1[order][:-1]) & (c2[order][1:] == c2[order][:-1])]
        lead, count = order[~same], np.bincount(np.cumsum(~same) - 1)
        firsts = np.flatnonzero(~same)
        others: list[list | None] = [None] * len(lead)
        for g in np.flatnonzero(count > 1).tolist():  # repeated rows have one place, and count each
            own = order[firsts[g] : firsts[g] + count[g]].tolist()
            places = dict.fromkeys(zip(k1[own].tolist(), k2[own].tolist(), begin[own].tolist()))
            others[g] = [dict(zip(("k1", "k2", "s"), x)) for x in list(places)[1:]] or None
        columns = [ah[lead], c1[lead], c2[lead], np.minimum(count, 2), (at - s)[lead], (e - s)[lead] + LENGTH, k1[lead], k2[lead], begin[lead]]
        types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)] + [pa.array(others, pa.list_(_PLACE))]
        yield pa.RecordBatch.from_arrays(arrays, ["ah", "c1", "c2", "n", "p", "size", "k1", "k2", "s", "more"])


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of the suffixes by prefix doubling, and the ranks of their first h, 2h, 4h... symbols. symbols: small numbers over 0.

    As many symbols as fit make the first key; after that only suffixes that still equal others are sorted on.
    """
    n, bits = len(symbols), int(symbols.max()).bit_length()
    h, key = 63 // bits, np.zeros(n, np.int64)
    padded = np.r_[symbols, np.zeros(h, np.int64)]
    for k in range(h):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    key, place, rank = key[order], np.arange(n), np.empty(n, np.int64)
    new = np.r_[True, key[1:] != key[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))  # the number of suffixes before its group
    levels, open_ = [(h, rank.astype(np.int32))], order[~(new & np.r_[new[1:], True])]
    while len(open_):
        after = open_ + h
        key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.argsort(key)
        open_, key = open_[sort], key[sort]
        group, place = rank[open_], np.arange(len(open_))
        new, old = np.r_[True, key[1:] != key[:-1]], np.r_[True, group[1:] != group[:-1]]
        first = np.maximum.accumulate(np.where(old, place, 0))
        order[group + place - first] = open_
        rank[open_] = group + np.maximum.accumulate(np.where(new, place, 0)) - first
        h *= 2
        levels.append((h, rank.astype(np.int32)))
        open_ = open_[~(new & np.r_[new[1:], True])]
    return order, levels


def _common(levels: list[tuple[int, np.ndarray]], symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i]."""
    a, b, n, total = a.copy(), b.copy(), len(symbols), np.zeros(len(a), np.int64)
    steps = [(h, r) for h, r in reversed(levels)] + [(1, symbols)] * (levels[0][0] - 1)
    for h, r in steps:
        fits = (a < n) & (b < n)
        same = fits & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        total += h * same
        a, b = a + h * same, b + h * same
    return total


class RunIndex:
    """A run-compressed index of texts, of which ``weights`` copies exist.

    It holds the runs of the Burrows-Wheeler transform (symbols, lengths), and for the suffixes at both ends of each run
    their places in the texts and what they share with the suffix of the neighbouring run; nothing for the rest.
    """

    def __init__(self, texts: list[bytes], weights: list[int]) -> None:
        self.sizes, self.weights = np.array([len(t) for t in texts]), np.array(weights)
        self.base = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        code = np.cumsum(np.bincount(data, minlength=256) > 0) + 1  # few different bytes make short symbols
        symbols = code[data]
        symbols[self.base + self.sizes] = 1  # the end of a text; what is shared beyond it does not count
        order, levels = suffix_array(symbols)
        bwt = np.where(order > 0, symbols[order - 1], 0)
        head = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        tail = np.r_[head[1:] - 1, len(bwt) - 1]
        shared = _common(levels, symbols, order[tail[:-1]], order[head[1:]])  # over the border between two runs
        self.run_symbols, self.run_lengths = bwt[head], tail - head + 1
        self.heads, self.tails = ((place[sort], length[sort]) for place, length in ((order[head], np.r_[0, shared]), (order[tail], np.r_[shared, 0])) for sort in [np.argsort(place)])

    def matches(self, first: int, last: int) -> np.ndarray:
        """Texts first..last-1, with their ends, streamed past the samples: for each place the longest match elsewhere.

        The neighbour of a suffix inside a run is the neighbour of the text's next place too, so from one sampled place
        to the next the shared length falls by one at each step.
        """
        ends = np.repeat(self.base[first:last] + self.sizes[first:last], self.sizes[first:last] + 1)
        places = np.arange(self.base[first], self.base[first] + len(ends))
        rest, best = ends - places, np.zeros(len(places), np.int64)
        for at, shared in (self.heads, self.tails):  # place 0 is a sample
            latest = np.searchsorted(at, places, side="right") - 1
            best = np.maximum(best, shared[latest] - (places - at[latest]))
        copied = np.repeat(self.weights[first:last] > 1, self.sizes[first:last] + 1)
        return np.where(copied, rest, np.minimum(best, rest))


def marked(texts: list[bytes], weights: list[int], length: int = LENGTH, at_a_time: int = 256) -> list[np.ndarray]:
    """For each text the starts of windows of ``length`` bytes that occur more than once in all copies of all texts."""
    index, out = RunIndex(texts, weights), []
    for first in range(0, len(texts), at_a_time):
        last = min(first + at_a_time, len(texts))
        hits = np.flatnonzero(index.matches(first, last) >= length)
        base = index.base[first:last] - index.base[first]
        out += [x - b for x, b in zip(np.split(hits, np.searchsorted(hits, base[1:])), base)]
    return out


_KIND = pa.schema([("g", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (g, c1, c2, n, ctx); emits the intervals [a, b) of each ctx."""
    held: list[tuple] = []

    def solve() -> pa.RecordBatch:
        out = []
        for (g, c1, c2, _, _), starts in zip(held, marked([r[4] for r in held], [r[3] for r in held])):
            if len(starts):
                parts = np.split(starts, np.flatnonzero(np.diff(starts) > LENGTH) + 1)
                out += [(g, c1, c2, int(r[0]), int(r[-1]) + LENGTH) for r in parts]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, _KIND)], schema=_KIND)

    size = 0
    for b in slices(batches, "ctx", 1 << 18):
        for row in zip(*(b[c].to_pylist() for c in ("g", "c1", "c2", "n", "ctx"))):
            if size >= INDEX_BYTES and row[0] != held[-1][0]:
                yield solve()
                held, size = [], 0
            held.append(row)
            size += len(row[4]) + 1
    if held:
        yield solve()


def _packed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The row's key (k1, k2), its id, its text as zstandard bytes (a shuffle of texts is the largest here), and the columns in ``keep`` as k_<name>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, "__text"):
            raw = [None if t is None else t.encode() for t in b["__text"].to_pylist()]
            k1, k2 = _row_keys(b["__id"].to_pylist(), [x or b"" for x in raw])
            z = pa.array([None if x is None else c.compress(x) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), b["__id"], z, *b.columns[2:]], ["k1", "k2", "doc_id", "z", *[f"k_{x}" for x in keep]])

    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"), *keep)
    kept = "".join(f", `k_{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"k1 long, k2 long, doc_id long, z binary{kept}")


KINDS = "g long, c1 long, c2 long, n int, p int, ctx binary"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for b in slices(batches, "z", 1 << 20):
        out: list[tuple] = []
        for z, wants in zip(b["z"].to_pylist(), b["wants"].to_pylist()):
            raw = d.decompress(z) if z else b""
            out += [(w["ah"], w["c1"], w["c2"], w["n"], w["p"], raw[w["s"] : w["s"] + w["size"]]) for w in wants]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], ["g", "c1", "c2", "n", "p", "ctx"])


def _split(rows: DataFrame, width: int) -> DataFrame:
    """Deal windows by their distance to the anchor, ``width`` distances to a group, and by the bytes that those have in common.

    A row for each part of a surroundings: its new group, its digest, and where it lies in what it is a part of (g, c1, c2, at, size).
    """
    far, near = F.col("p"), F.col("p") - (F.length("ctx") - LENGTH)  # distance of the anchor from the first start, and from the last
    k = F.explode(F.sequence(F.expr(f"greatest(p - length(ctx) + {LENGTH}, 0) div {width}").cast("int"), F.expr(f"p div {width}").cast("int"))).alias("k")
    rows = rows.select("*", k).withColumns({"hi": F.least(far, F.col("k") * width + width - 1), "lo": F.greatest(near, F.col("k") * width)})
    skip = far - F.col("hi")
    part = F.substring("ctx", skip + 1, F.col("hi") - F.col("lo") + LENGTH)
    nearest, farthest = F.col("k") * width, F.col("k") * width + width - 1
    common = F.substring("ctx", F.greatest(far - nearest, F.lit(0)) + 1, LENGTH - farthest + nearest)
    digest = F.md5(F.concat(F.col("hi").cast("string").cast("binary"), part))
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("long")
    return rows.select(F.xxhash64("g", "k", common).alias("part_g"), half(1).alias("p1"), half(17).alias("p2"), "n", "g", "c1", "c2", skip.alias("at"), F.length(part).alias("size"), F.col("hi").alias("p"))


def repeated(kinds: DataFrame, splits: tuple[int, ...] = SPLITS) -> DataFrame:
    """Intervals (g, c1, c2, a, b) of the surroundings ``kinds`` (KINDS, all different) whose windows occur more than once in their copies."""
    n = tasks(kinds.sparkSession)
    own, found = ["g", "c1", "c2"], None
    cool = kinds
    if splits:
        hot = cut(kinds.groupBy("g").count().filter(F.col("count") > HOT_GROUP).select("g", F.lit(True).alias("hot")), "hot")
        both = kinds.join(hot, "g", "left")
        cool, hot = both.filter("hot is null").drop("hot"), both.filter("hot").drop("hot")
        parts = cut(_split(hot, splits[0]), "parts")
        if not parts.isEmpty():
            place = F.min(F.struct(*own, "at", "size", "p")).alias("rep")
            different = parts.groupBy("part_g", "p1", "p2").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), place)
            # as with anchors, what occurs once ends here
            again = parts.groupBy("part_g").agg(F.sum("n").alias("all_n")).filter("all_n > 1").select("part_g")
            different = different.join(again, "part_g").select("part_g", "p1", "p2", "n", *[f"rep.{c}" for c in (*own, "at", "size", "p")])
            texts = different.join(hot.select(*own, "ctx"), own)
            finer = cut(texts.select(F.col("part_g").alias("g"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), "n", "p", F.substring("ctx", F.col("at") + 1, F.col("size")).alias("ctx")), "kinds")
            marks = repeated(finer, splits[1:]).withColumnsRenamed({"g": "part_g", "c1": "p1", "c2": "p2"})
            met = parts.select("part_g", "p1", "p2", *own, "at").join(marks, ["part_g", "p1", "p2"])
            found = met.select(*own, (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    index = cool.select(*own, "n", "ctx").repartition(n, "g").sortWithinPartitions("g").mapInArrow(_index, "g long, c1 long, c2 long, a int, b int")
    return index if found is None else index.unionAll(found)


def intervals(docs: DataFrame) -> DataFrame:
    """Lists of byte intervals (k1, k2, spans of s, e) whose windows occur more than once; they overlap."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_anchors, ANCHORS), "anchors")
    # written, so that the join can split an anchor of very many rows
    seen = cut(rows.groupBy("ah").agg(F.sum("n").alias("all_n")).filter("all_n > 1").select("ah"), "seen")
    again = cut(rows.join(seen, "ah"), "repeated-anchors")
    # one of each surroundings stands for its copies
    same = ["ah", "c1", "c2"]
    kinds = again.groupBy(*same).agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.min(F.struct("k1", "k2", "p", "s", "size")).alias("rep"))
    wants = kinds.groupBy("rep.k1", "rep.k2").agg(F.collect_list(F.struct(*same, "n", "rep.p", "rep.s", "rep.size")).alias("wants"))
    texts = _packed(docs).groupBy("k1", "k2").agg(F.first("z").alias("z")).join(wants, ["k1", "k2"]).select("z", "wants")
    marks = repeated(cut(texts.mapInArrow(_surroundings, KINDS), "texts")).withColumnRenamed("g", "ah")
    marks = marks.groupBy(*same).agg(F.collect_set(F.struct("a", "b")).alias("ab"))  # a row for each surroundings, so that each place is one row too
    met = again.select(*same, "k1", "k2", "s", "more").join(marks, same)
    places = F.concat(F.array(F.struct("k1", "k2", "s")), F.coalesce("more", F.array().cast("array<struct<k1:long,k2:long,s:int>>")))
    own = F.transform("ab", lambda r: F.struct((F.col("x.s") + r["a"]).alias("s"), (F.col("x.s") + r["b"]).alias("e")))
    return met.select(F.explode(places).alias("x"), "ab").select("x.k1", "x.k2", own.alias("spans"))


def dedup(docs: DataFrame, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also text (what is left, whole characters), and the columns in ``keep``."""
    found = intervals(docs).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = _packed(docs, keep).join(found, ["k1", "k2"], "left").select("doc_id", "z", "spans", *[f"k_{x}" for x in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in slices(batches, "z", 1 << 20):
            out: list[list] = [[], [], [], [], []]
            for z, spans in zip(b["z"].to_pylist(), b["spans"].to_pylist()):
                raw = d.decompress(z) if z else b""
                s, e = np.array(sorted((x["s"], x["e"]) for x in spans or ()), np.int64).reshape(-1, 2).T
                if len(s):  # runs that overlap or touch are one run
                    reach = np.maximum.accumulate(e)
                    new = np.r_[True, s[1:] > reach[:-1]]
                    s, e = s[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]
                kept = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)]))
                values = (len(raw), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), None if z is None else kept.decode(errors="ignore"))
                for column, v in zip(out, values):
                    column.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(out, types)][: 5 if with_text else 4]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *arrays, *b.columns[3:]], ["doc_id", *names[: len(arrays)], *keep])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text + kept)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


# Bytes as hexadecimal digits; windows are cut from pieces of 500 places, as a place far inside a long text is slow to find.
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, i * 500 AS pos, substr(h, 1000 * i + 1, {998 + 2 * LENGTH}) AS x FROM d, unnest(generate_series(0, (len(h) - {2 * LENGTH}) // 1000)) t(i) WHERE len(h) >= {2 * LENGTH}),
w AS (SELECT r, pos + j AS s, md5(substr(x, 2 * j + 1, {2 * LENGTH})) AS k FROM p, unnest(generate_series(0, least(499, len(x) // 2 - {LENGTH}))) t(j)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {LENGTH} THEN 0 ELSE 1 END AS new FROM w SEMI JOIN twice USING (k)),
span AS (SELECT r, min(s) AS a, max(s) + {LENGTH} AS b FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM hit) GROUP BY r, g),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM span),
kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN e IS NULL THEN h ELSE k || substr(h, 2 * e + 1) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
