"""LM scoring by prediction by partial matching over bytes.

Training documents give counts of five-byte strings; the suffixes of those strings are the shorter contexts, so their
sorted tables are the context trie. The probability of a byte is taken at the longest context that has seen it; each
longer context that has not costs an escape (method C: distinct symbols over all), and the symbols that it has seen are
excluded below it.

The texts are cut into chunks. A chunk sends its distinct strings and words, sorted and packed, to buckets. A bucket of
strings holds all that have the same two symbols before the last, so every context of two symbols or more lies whole in
one bucket (a pair of symbols has at most SYMBOLS^3 strings), and the shorter ones are a table of SYMBOLS^2 numbers that
is broadcast; a bucket of words holds one part in BUCKETS of the vocabulary. Buckets add up the counts, then answer each
chunk with the log probabilities of its own strings and the counts of its own words; no chunk receives the whole model.

Defined cases: a null text is empty: one end and no words; a null doc_id trains (its fold is 0); without any training
document all counts are zero and bytes are uniform; an empty table gives no rows; a text of any length is read in pieces;
repeated rows each count and each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import cut, fold, pieces, runs, slices, table, tasks

FOLDS, HELD_OUT = 7, 2
ORDER = 4  # bytes of the longest context
SYMBOLS = 257  # bytes, and 256 for either end of a text
END = 256
CHUNK_BYTES = 8 << 20  # of text; a longer text is a chunk of its own
BLOCK = 1 << 20  # symbols that are coded at a time
BUCKETS = 512  # of strings; as many of words follow them
PART_CHUNKS = 256  # chunks whose strings or words one task adds up or answers, of one bucket
CHUNKS = "chunk long, bucket int, keys binary, counts binary, ids array<long>, train array<boolean>, sizes array<int>, data binary"


def coded(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks: the code of each symbol with its ORDER symbols before, ends included; the texts in the block, and where each begins."""
    parts: list[tuple[int, int, bytes, int]] = []  # text, symbols of the start before it, bytes, symbols that are coded

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, head, body, count = zip(*parts)
        head, count, sizes = np.array(head), np.array(count), np.array([len(b) for b in body])
        start = np.cumsum(count + ORDER) - (count + ORDER)
        data = np.full(int((count + ORDER).sum()), END, np.int64)
        shift = start + head - (np.cumsum(sizes) - sizes)
        data[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)] = np.frombuffer(b"".join(body), np.uint8)
        code = np.zeros(len(data) - ORDER, np.int64)
        for k in range(ORDER + 1):
            code = code * SYMBOLS + data[k : len(data) - ORDER + k]
        first = np.cumsum(count) - count
        return code[np.arange(int(count.sum())) + np.repeat(start - first, count)], np.array(owner), first

    room = BLOCK
    for i, r in enumerate(raw):
        for at in range(0, len(r) + 1, BLOCK):
            count = min(BLOCK, len(r) + 1 - at)
            parts.append((i, ORDER - min(at, ORDER), r[max(at - ORDER, 0) : at + BLOCK], count))
            room -= count
            if room <= 0:
                yield block()
                parts, room = [], BLOCK
    if parts:
        yield block()


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(x, prepend=0).astype(np.int64).tobytes(), 1)


def unpack(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(x), np.int64))


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(b"".join(w + b"\n" for w in words), 3)


def unpack_words(x: bytes) -> list[bytes]:
    return zstandard.decompress(x).split(b"\n")[:-1]


def bucket_of(grams: np.ndarray) -> np.ndarray:
    pair = grams // SYMBOLS % SYMBOLS**2
    return (pair * 2_654_435_761 >> 8) % BUCKETS


def _rows(schema: pa.Schema, size: int, /, **columns) -> pa.RecordBatch:
    """A batch of ``size`` rows; columns that aren't given are null."""
    of = lambda f: pa.nulls(size, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
    return pa.RecordBatch.from_arrays([of(f) for f in schema], schema=schema)


_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary()),
])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: its distinct strings and words by bucket, with how often training documents hold them; and its texts (no bucket)."""
    for number, b in enumerate(slices(batches, "text", CHUNK_BYTES)):
        chunk = TaskContext.get().partitionId() << 32 | number
        train, raw = b["train"].to_numpy(zero_copy_only=False), [t.as_py().encode() for t in b["text"]]
        grams, counts, words = [], [], Counter()
        for code, owner, first in coded(raw):
            label, own = pd.factorize(code)
            used = np.repeat(train[owner], np.diff(np.r_[first, len(code)]))
            grams.append(own)
            counts.append(np.bincount(label[used], minlength=len(own)))
        for r, used in zip(raw, train):
            w = r.lower().split() + [b""]  # the empty word is the end
            words.update(w) if used else words.update(dict.fromkeys(w, 0))
        own, n = totals(np.concatenate(grams), np.concatenate(counts))
        to = bucket_of(own)
        order = np.argsort(to, kind="stable")
        own, n, to = own[order], n[order], to[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        packs = [(int(to[x]), pack(own[x:y]), pack(n[x:y])) for x, y in zip(starts, np.r_[starts[1:], len(to)])]
        lists: list[list[bytes]] = [[] for _ in range(BUCKETS)]
        for w in sorted(words):
            lists[zlib.crc32(w) % BUCKETS].append(w)
        # a chunk asks every bucket of words, without words too: the answers add up to the size of the vocabulary
        packs += [(BUCKETS + i, pack_words(ws), pack(np.array([words[w] for w in ws], np.int64))) for i, ws in enumerate(lists)]
        bucket, keys, n = zip(*packs)
        yield _rows(_CHUNK, len(packs), chunk=np.full(len(packs), chunk), bucket=bucket, keys=keys, counts=n)
        yield _rows(_CHUNK, 1, chunk=[chunk], ids=[b["doc_id"].to_pylist()], train=[train.tolist()], sizes=[[len(r) for r in raw]], data=[zstandard.compress(b"".join(raw), 3)])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of two-symbol strings; at -1 that of all words."""
    for b in batches:
        keys, counts = [], []
        for bucket, k, n in zip(*(b[c].to_pylist() for c in ("bucket", "keys", "counts"))):
            n = unpack(n)
            keys.append(unpack(k) % SYMBOLS**2 if bucket < BUCKETS else np.full(len(n), -1))
            counts.append(n)
        if keys:
            key, n = totals(np.concatenate(keys), np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def add_up(bucket: int, packs: list[tuple[bytes, bytes]]):
    """Strings and counts as two arrays, words as a dictionary."""
    if bucket < BUCKETS:
        known, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for i in range(0, len(packs), 64):
            known, counts = (np.concatenate([x, *(unpack(p[j]) for p in packs[i : i + 64])]) for j, x in enumerate((known, counts)))
            known, counts = totals(known, counts)
        return known, counts
    found: dict[bytes, int] = {}
    for words, counts in packs:
        for w, n in zip(unpack_words(words), unpack(counts).tolist()):
            found[w] = found.get(w, 0) + n
    return found


_MERGED = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, part), to one row for each."""

    def row(key: tuple, packs: list) -> pa.RecordBatch:
        found = add_up(key[0], packs)
        keys, counts = found if key[0] < BUCKETS else (sorted(found), np.array([found[w] for w in sorted(found)], np.int64))
        return _rows(_MERGED, 1, bucket=[key[0]], part=[key[1]], keys=[pack(keys) if key[0] < BUCKETS else pack_words(keys)], counts=[pack(counts)])

    at, packs = None, []
    for key, b in runs(batches, "bucket", "part"):
        if key != at and packs:
            yield row(at, packs)
            packs = []
        at = key
        packs += zip(b["keys"].to_pylist(), b["counts"].to_pylist())
        if len(packs) >= PART_CHUNKS:
            packs = [tuple(row(key, packs).to_pylist()[0][c] for c in ("keys", "counts"))]
    if packs:
        yield row(at, packs)


def log_probabilities(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each string's last symbol after the others.

    grams: the sorted strings of a bucket, counts: how often training holds them; pairs: counts of all two-symbol strings.
    """
    keys, count = {ORDER: grams[counts > 0]}, {ORDER: counts[counts > 0]}
    for j in range(ORDER - 1, 1, -1):
        keys[j], count[j] = totals(keys[j + 1] % SYMBOLS ** (j + 1), count[j + 1])
    singles, flat = pairs.sum(0), pairs.ravel()

    def at(known: np.ndarray, values: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(key), np.int64)
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return np.where(known[place] == key, values[place], 0)

    def counted(j: int, key: np.ndarray) -> np.ndarray:
        return singles[key] if j == 0 else flat[key] if j == 1 else at(keys[j], count[j], key)

    def node(j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each string, of its context of j symbols: all counts, distinct symbols, and what the shorter context holds of those symbols."""
        context = grams % SYMBOLS ** (j + 1) // SYMBOLS
        if j < 2:
            rows = singles[None] if j == 0 else pairs
            lower = np.zeros(len(rows), np.int64) if j == 0 else (rows > 0) @ singles
            return rows.sum(1)[context], (rows > 0).sum(1)[context], lower[context]
        of = keys[j] // SYMBOLS
        return tuple(at(*totals(of, x), context) for x in (count[j], np.ones(len(of), np.int64), counted(j - 1, keys[j] % SYMBOLS**j)))

    distinct = int((singles > 0).sum())
    lp = np.full(len(grams), -math.log10(SYMBOLS - distinct) if distinct < SYMBOLS else 0.0)
    nodes = [node(j) for j in range(ORDER + 1)]
    with np.errstate(divide="ignore", invalid="ignore"):
        for j, (t, d, _) in enumerate(nodes):
            c = counted(j, grams % SYMBOLS ** (j + 1))
            out_d, out_t = nodes[j + 1][1:] if j < ORDER else (0, 0)
            left, kinds = t - out_t, d - out_d
            lp = np.where(c > 0, np.log10(c / (left + kinds)), np.where((t == 0) | (kinds <= 0), lp, np.log10(kinds / (left + kinds)) + lp))
    return lp


_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("kinds", pa.int64())])


def _answer(pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bucket, part, kind): a bucket's counts if it has several parts, then what chunks ask, which else is all there is."""
        at, model, asked = None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            found = add_up(at[0], model or [(k, n) for _, k, n in asked])
            if at[0] < BUCKETS:
                lp, kinds = log_probabilities(*found, pairs.value), 0
                of = lambda k: lp[np.searchsorted(found[0], unpack(k))].tobytes()
            else:
                kinds = sum(n > 0 for n in found.values())
                of = lambda k: pack(np.array([found[w] for w in unpack_words(k)], np.int64))
            for i in range(0, len(asked), 64):
                chunks, keys, _ = zip(*asked[i : i + 64])
                yield _rows(_ANSWER, len(chunks), chunk=chunks, bucket=[at[0]] * len(chunks), keys=keys, values=[of(k) for k in keys], kinds=[kinds] * len(chunks))

        for (*key, kind), b in runs(batches, "bucket", "part", "kind"):
            if key != at:
                if asked:
                    yield from answers()
                at, model, asked = key, [], []
            if kind == 0:
                model += zip(b["keys"].to_pylist(), b["counts"].to_pylist())
            else:
                asked += zip(*(b[c].to_pylist() for c in ("chunk", "keys", "counts")))
        if asked:
            yield from answers()

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (chunk, text or not): answers, then the texts."""
        own, grams, lps, known, vocabulary = None, [], [], {}, 0
        for (chunk, is_text), b in runs(batches, "chunk", "is_text"):
            if chunk != own:
                own, grams, lps, known, vocabulary = chunk, [], [], {}, 0
            if not is_text:
                for bucket, keys, values, kinds in zip(*(b[c].to_pylist() for c in ("bucket", "keys", "values", "kinds"))):
                    if bucket < BUCKETS:
                        grams.append(unpack(keys))
                        lps.append(np.frombuffer(values, np.float64))
                    else:
                        known.update(zip(unpack_words(keys), unpack(values).tolist()))
                        vocabulary += kinds
                continue
            index, lp = pd.Index(np.concatenate(grams)), np.concatenate(lps)
            scale = float(tokens + vocabulary + 1)
            of = {w: (math.log10((c + 1) / scale), c > 0) for w, c in known.items()}
            for ids, train, sizes, data in zip(*(b[c].to_pylist() for c in ("ids", "train", "sizes", "data"))):
                ends, whole = np.cumsum(sizes).tolist(), zstandard.decompress(data)
                raw = [whole[e - n : e] for e, n in zip(ends, sizes)]
                total, facts = np.zeros(len(raw)), []
                for code, owner, first in coded(raw):
                    np.add.at(total, owner, np.add.reduceat(lp[index.get_indexer(code)], first))
                for r in raw:
                    found = [of[x] for x in r.lower().split()] + [of[b""]]
                    facts.append((len(found), sum(k for _, k in found), math.fsum(p for p, _ in found)))
                n_tokens, n_known, base = zip(*facts)
                yield _rows(_SCORED, len(raw), doc_id=ids, train=train, n_tokens=n_tokens, n_known=n_known, base_score=base, score=total)

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    n = tasks(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold(F.col("doc_id"), FOLDS) != HELD_OUT).alias("train"))
    found = cut(rows.mapInArrow(_gather, CHUNKS), "chunks")
    texts, packs = found.filter("bucket is null"), found.filter("bucket is not null")
    pairs, tokens = np.zeros(SYMBOLS**2, np.int64), 0
    for key, count in packs.select("bucket", "keys", "counts").mapInArrow(_facts, "key long, n long").groupBy("key").agg(F.sum("n")).collect():  # SYMBOLS^2 + 1 rows at most
        if key < 0:
            tokens = count
        else:
            pairs[key] = count
    shared = spark.sparkContext.broadcast(pairs.reshape(SYMBOLS, SYMBOLS))
    parts = pieces(texts.count(), PART_CHUNKS)
    asked = packs.select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part"), F.lit(1).alias("kind"), "chunk", "keys", "counts")
    if parts > 1:  # each part adds up its own, the bucket adds up its parts, and each part receives the sums
        merge = lambda df: df.select(*_MERGED.names).repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_merge, "bucket int, part long, keys binary, counts binary")
        sums = cut(merge(merge(asked).withColumn("part", F.lit(0).cast("long"))), "counts")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
        asked = sums.select("bucket", every, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "keys", "counts").unionAll(asked)
    answers = asked.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "kind").mapInArrow(_answer(shared), "chunk long, bucket int, keys binary, values binary, kinds long")
    met = answers.withColumn("is_text", F.lit(0)).unionByName(texts.select("chunk", F.lit(1).alias("is_text"), "ids", "train", "sizes", "data"), True)
    out = met.repartition(n, "chunk").sortWithinPartitions("chunk", "is_text").mapInArrow(_score(tokens), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
