"""Edit-aware token counts.

A document is cut into pre-tokens by the tokenizer's pattern, and a segment tree over them sums token counts and
lengths. Trees are rows of a table, which is kept between batches of edits: ``build_trees`` makes it, ``apply_edits``
gives the next one. An edit finds its place by walking the tree, cuts anew from a few pre-tokens before it until the
cuts meet the old ones again, encodes only the new pre-tokens, and updates the sums on the way to the root. Leaves hold
their own text, so an edit copies the leaves that it touches only.

Defined cases: a null or empty text has no tokens; edits out of range are clamped to the text; null insertions insert
nothing; edits of a document apply in order of ``seq``, each to the text that the one before left; repeated documents
rows each get all edits of their id; a null doc_id has no edits; edits of unknown documents are ignored; an empty table
gives no rows; other columns are ignored. All edits of one document in one batch are applied in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import slices, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this vocabulary's pre-tokens follow.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARGIN = 4  # characters before an edit that its pre-tokens can depend on
BLOCK = 64  # pre-tokens of a leaf
CACHED = 200_000  # pre-tokens whose counts a task remembers at a time


class Counter:
    """Token counts of pre-tokens; remembers a bounded number of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def count(self, token: str) -> int:
        n = self.seen.get(token)
        if n is None:
            if len(self.seen) >= CACHED:
                self.seen.clear()
            n = self.seen[token] = len(self.encoding.encode_ordinary(token))
        return n


class Tree:
    """Leaves (text, sizes, counts) of up to 2 * BLOCK pre-tokens under a binary tree of (characters, tokens) sums."""

    def __init__(self, leaves: list[tuple[str, list[int], list[int]]], counter: Counter) -> None:
        self.counter = counter
        self.encoded = 0  # characters encoded by edits
        self._build(leaves or [("", [], [])])

    @staticmethod
    def leaves_of(text: str, sizes: list[int], counts: list[int]) -> list[tuple[str, list[int], list[int]]]:
        out, at = [], 0
        for i in range(0, len(sizes), BLOCK):
            n = sum(sizes[i : i + BLOCK])
            out.append((text[at : at + n], sizes[i : i + BLOCK], counts[i : i + BLOCK]))
            at += n
        return out

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        tokens = counter.cut.findall(text)
        return cls(cls.leaves_of(text, [len(t) for t in tokens], [counter.count(t) for t in tokens]), counter)

    def pack(self) -> bytes:
        """The tree as compressed bytes; ``unpack`` gives it back without encoding anything."""
        sizes, counts = ([x for leaf in self.leaves for x in leaf[k]] for k in (1, 2))
        numbers = np.array([len(self.leaves), len(sizes), *(len(leaf[1]) for leaf in self.leaves), *sizes, *counts], "<i4")
        return zstandard.compress(numbers.tobytes() + "".join(leaf[0] for leaf in self.leaves).encode(), 1)

    @classmethod
    def unpack(cls, packed: bytes, counter: Counter) -> Tree:
        raw = zstandard.decompress(packed)
        m, n = np.frombuffer(raw, "<i4", 2).tolist()
        numbers = np.frombuffer(raw, "<i4", m + 2 * n, 8).tolist()
        text, leaves, at, place = raw[4 * (2 + m + 2 * n) :].decode(), [], m, 0
        for size in numbers[:m]:
            sizes = numbers[at : at + size]
            end = place + sum(sizes)
            leaves.append((text[place:end], sizes, numbers[at + n : at + n + size]))
            at, place = at + size, end
        return cls(leaves, counter)

    def _build(self, leaves: list[tuple[str, list[int], list[int]]]) -> None:
        self.leaves, self.width = leaves, 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.width)
        for i, (text, _, counts) in enumerate(leaves):
            self.sums[self.width + i] = (len(text), sum(counts))
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + c, b + d)

    @property
    def characters(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one if none), and its first character."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place >= start + self.sums[i][0] and self.sums[i + 1][0]:
                start += self.sums[i][0]
                i += 1
        return i - self.width, start

    def replace(self, at: int, deleted: int, inserted: str) -> None:
        at = min(max(at, 0), self.characters)
        deleted = min(max(deleted, 0), self.characters - at)
        first, begin = self._leaf_at(max(0, at - MARGIN))
        stop, reach = self._leaf_at(at + deleted)[0] + 2, 2
        while not self._cut_anew(first, begin, min(stop, len(self.leaves)), at, deleted, inserted):
            stop, reach = stop + reach, 2 * reach  # the cuts didn't meet inside: more leaves

    def _cut_anew(self, first: int, begin: int, stop: int, at: int, deleted: int, inserted: str) -> bool:
        """The edit inside leaves first..stop-1, whose text begins at ``begin``; False if new cuts don't meet old ones in them."""
        own = self.leaves[first:stop]
        old = "".join(leaf[0] for leaf in own)
        text = old[: at - begin] + inserted + old[at - begin + deleted :]
        sizes, counts = ([x for leaf in own for x in leaf[k]] for k in (1, 2))
        kept, place = 0, 0
        while kept < len(sizes) and place + sizes[kept] + MARGIN <= at - begin:  # pre-tokens that end well before the edit stay
            place += sizes[kept]
            kept += 1
        settled, j, cut = at - begin + len(inserted), kept, place + len(inserted) - deleted  # cut: an old cut by its new place
        new_sizes, new_counts, encoded = [], [], 0
        while True:
            while j < len(sizes) and (cut < place or cut < settled):
                cut += sizes[j]
                j += 1
            if place == cut and place >= settled and j < len(sizes):
                break
            if place >= len(text):
                if stop < len(self.leaves):
                    return False
                j = len(sizes)
                break
            m = self.counter.cut.match(text, place)
            token = m[0] if m else text[place:]
            if place + len(token) + MARGIN > len(text) and stop < len(self.leaves):
                return False  # what follows the leaves could change this cut
            new_sizes.append(len(token))
            new_counts.append(self.counter.count(token))
            encoded += len(token)
            place += len(token)
        self.encoded += encoded
        sizes, counts = sizes[:kept] + new_sizes + sizes[j:], counts[:kept] + new_counts + counts[j:]
        leaves = self.leaves_of(text, sizes, counts)
        if len(leaves) <= len(own):  # sums change on the way up from the leaves that changed
            changed = set()
            for i in range(first, stop):
                self.leaves[i] = leaves[i - first] if i - first < len(leaves) else ("", [], [])
                self.sums[self.width + i] = (len(self.leaves[i][0]), sum(self.leaves[i][2]))
                changed.add((self.width + i) // 2)
            while changed and changed != {0}:
                for i in changed:
                    self._sum(i)
                changed = {i // 2 for i in changed}
        else:
            self._build(self.leaves[:first] + leaves + self.leaves[stop:])
        return True


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


TREES = "doc_id long, n_tokens long, n_chars long, tree binary"


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A tree for each row: doc_id, n_tokens, n_chars, tree."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))  # one vocabulary: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for b in slices(batches, "text"):
            trees = [Tree.of(t.as_py() or "", counter) for t in b["text"]]
            columns = [pa.array([f(t) for t in trees], kind) for f, kind in ((lambda t: t.tokens, pa.int64()), (lambda t: t.characters, pa.int64()), (Tree.pack, pa.binary()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], ["doc_id", "n_tokens", "n_chars", "tree"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TREES)


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The trees after a batch of edits (doc_id, seq, at, deleted, inserted), with n_tokens_before, n_edits and chars_encoded of this batch."""
    ranks = trees.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    edit = F.struct("seq", F.col("at").cast("int").alias("at"), F.col("deleted").cast("int").alias("deleted"), "inserted")
    own = edits.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    rows = trees.select("doc_id", "n_tokens", "n_chars", "tree").join(own, F.col("doc_id") == F.col("__id"), "left").drop("__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for b in slices(batches, "tree", 1 << 20):
            out = []
            for tokens, chars, packed, todo in zip(*(b[c].to_pylist() for c in ("n_tokens", "n_chars", "tree", "edits"))):
                if not todo:
                    out.append((tokens, chars, packed, tokens, 0, 0))
                    continue
                tree = Tree.unpack(packed, counter)
                for e in todo:
                    tree.replace(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
                out.append((tree.tokens, tree.characters, tree.pack(), tokens, len(todo), tree.encoded))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], ["doc_id", "n_tokens", "n_chars", "tree", "n_tokens_before", "n_edits", "chars_encoded"])

    return rows.mapInArrow(run, f"{TREES}, n_tokens_before long, n_edits long, chars_encoded long")


def planned_edits(docs: DataFrame) -> DataFrame:
    """Three edits of each document, at places that a hash of its id names: an insertion, a deletion and a replacement."""
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.length("text") + 1).cast("int")
    edits = F.array(
        F.struct(F.lit(1).alias("seq"), place(1).alias("at"), F.lit(0).alias("deleted"), F.concat(F.lit(" edit "), F.col("doc_id").cast("string")).alias("inserted")),
        F.struct(F.lit(2).alias("seq"), place(2).alias("at"), F.lit(25).alias("deleted"), F.lit("").alias("inserted")),
        F.struct(F.lit(3).alias("seq"), place(3).alias("at"), F.lit(7).alias("deleted"), F.lit("'re  \n done").alias("inserted")),
    )
    return docs.select("doc_id", F.explode(edits).alias("e")).select("doc_id", "e.*")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    edited = apply_edits(build_trees(docs), planned_edits(docs))
    return edited.select("doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_chars", "chars_encoded")
