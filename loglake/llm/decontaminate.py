"""Benchmark decontamination with DataFrame functions only.

Every 13-word window of the benchmark (a shorter item is one window) becomes a row of a hash table that is broadcast
in blocks of bounded size. One scan of the documents hashes each of their windows, probes the table, compares the words
of each probe's hit, and marks the covered words.

Defined cases: null and empty texts have no words and no hits; a null benchmark text is no item; a null item_id marks
words but is not listed; repeated documents rows each get a row; other columns of either table are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import UPPER, cut, lower_ascii, pieces, table

WINDOW = 13
BROADCAST_BYTES = 48 << 20  # of windows in a block
MOST_BLOCKS = 4
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.coalesce(F.split(lower_ascii(text), NOT_WORD), F.array().cast("array<string>")), "")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row for each window of each item: window, len, key (128 bits of its words), item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    starts = items.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    return starts.select(F.slice("w", F.col("at"), F.col("len")).alias("window"), "len", "item").distinct().withColumn("key", _key(F.col("window")))


def _key(window: Column) -> Column:
    return F.md5(F.array_join(window, " "))  # words hold no blanks


def _places(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows of each document: its header (at = -1), and a row for each place and length of a window."""
    # everything from the explode to the probe is one stage of generated code: windows are hashed in place, and the
    # words that each row refers to are never copied (lambdas would run outside it, and copy the array at every slice)
    n = F.size("w")
    count = {m: F.greatest(n - m + 1, F.lit(0)) for m in lengths}
    places = F.sequence(F.lit(0), reduce(lambda a, b: a + b, count.values()))
    rows = docs.select("doc_id", "text_key", "n_words", "w", F.explode_outer(places).alias("p"))
    at, size, before = F.lit(-1), F.lit(0), F.lit(1)
    for m in lengths:
        mine = (F.col("p") >= before) & (F.col("p") < before + count[m])
        at, size, before = F.when(mine, F.col("p") - before).otherwise(at), F.when(mine, F.lit(m)).otherwise(size), before + count[m]
    return rows.withColumns({"at": at, "size": size})


def _window() -> Column:
    return F.slice("w", F.greatest("at", F.lit(0)) + 1, F.greatest("size", F.lit(1)))


def _probe(docs: DataFrame, windows: DataFrame, lengths: list[int], header: bool) -> DataFrame:
    """The header of each document, and a row for each window that the broadcast ``windows`` hold, its words compared."""
    rows = _places(docs, lengths).withColumn("h", F.when(F.col("at") >= 0, F.xxhash64(_window())))
    b = windows.select(F.xxhash64("window").alias("b_h"), F.col("len").alias("b_len"), F.col("window").alias("b_window"), "key")
    joined = rows.join(F.broadcast(b), F.col("h") == F.col("b_h"), "left")
    verified = F.col("b_h").isNotNull() & (F.col("size") == F.col("b_len")) & (_window() == F.col("b_window"))
    return joined.filter(verified | ((F.col("at") < 0) & F.lit(header))).select("doc_id", "text_key", "n_words", "at", "size", F.when(F.col("at") >= 0, F.col("key")).alias("key"))


def _meet(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same rows by a shuffle of keys, for benchmarks of too many blocks."""
    rows = _places(docs, lengths)
    headers = rows.filter("at < 0").select("doc_id", "text_key", "n_words", "at", "size", F.lit(None).cast("string").alias("key"))
    places = rows.filter("at >= 0").select("doc_id", "text_key", "n_words", "at", "size", _key(_window()).alias("key"))
    return headers.unionAll(places.join(windows.select("key"), "key").select(*headers.columns))


def mark(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, with_items: bool = True) -> DataFrame:
    """One row for each documents row: doc_id, text_key, n_words, n_hit, items (unless ``with_items`` is off), covered (places of the hit words), contaminated.

    The benchmark's windows are measured first; beyond ``broadcast_bytes`` they are probed in several blocks, each of
    which reads the documents, and beyond MOST_BLOCKS blocks by a shuffle. Items join the hits afterwards, by window.
    """
    held = cut(benchmark_windows(benchmark, n), "windows")
    windows = held.select("window", "len", "key").distinct()
    facts = windows.agg(F.sum(F.length(F.array_join("window", " ")) + 200).alias("bytes"), F.sort_array(F.collect_set("len")).alias("lengths")).first()
    lengths = facts["lengths"] or [n]
    blocks = pieces(facts["bytes"] or 0, broadcast_bytes)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    if blocks > MOST_BLOCKS:
        hits = _meet(texts, windows, lengths)
    else:
        hits = reduce(DataFrame.unionAll, [_probe(texts, windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b), lengths, b == 0) for b in range(blocks)])
    own = ["doc_id", "text_key", "n_words"]
    verdicts = hits.groupBy(*own).agg(
        F.sum((F.col("at") < 0).cast("int")).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("at") >= 0, F.struct("at", (F.col("at") + F.col("size")).alias("end"))))).alias("hit"),
        F.collect_set("key").alias("keys"),
    )
    if with_items:
        verdicts = cut(verdicts, "verdicts")  # read twice
        found = verdicts.select(*own, F.explode("keys").alias("key")).join(held.filter("item is not null").select("key", "item"), "key")
        items = found.groupBy(*own).agg(F.array_sort(F.collect_set("item")).alias("items"))
        v, i = verdicts.alias("v"), items.alias("i")
        on = F.col("v.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("v.text_key") == F.col("i.text_key")) & (F.col("v.n_words") == F.col("i.n_words"))
        verdicts = v.join(i, on, "left").select("v.*", F.coalesce("i.items", F.array().cast("array<string>")).alias("items"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("hit", lambda x: F.sequence(x["at"], x["end"] - 1)))))
    verdicts = verdicts.withColumn("covered", covered).withColumn("n_hit", F.size("covered").cast("long"))
    return verdicts.select(
        *own, "n_hit", *(["items"] if with_items else []), "covered",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of documents that are not contaminated, with all their columns."""
    bad = mark(docs, benchmark, n, with_items=False).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(bad, F.col("__id").eqNullSafe(docs["doc_id"]) & (F.col("__key") == F.xxhash64(docs["text"])), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """All documents; hit words and the separators right after them leave the text."""
    found = mark(docs, benchmark, n, with_items=False).filter("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("covered").alias("__hit")).distinct()
    joined = docs.join(found, F.col("__id").eqNullSafe(docs["doc_id"]) & (F.col("__key") == F.xxhash64(docs["text"])), "left")
    before, after = (lambda i: F.get("__hit", i - 1)), (lambda i: F.get("__hit", i + 1))
    starts = F.filter("__hit", lambda p, i: F.coalesce(before(i) != p - 1, F.lit(True)))
    ends = F.filter("__hit", lambda p, i: F.coalesce(after(i) != p + 1, F.lit(True)))
    ws = F.array_remove(F.split("text", NOT_WORD_ANY_CASE), "")
    seps = F.split("text", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    pieces_of = F.transform(F.arrays_zip(ws.alias("w"), F.slice(seps, F.lit(2), F.size(ws)).alias("s")), lambda x: F.concat(x["w"], x["s"]))
    lefts, rights = F.concat(F.array(F.lit(-1)), ends), F.concat(starts, F.array(F.size(ws)))
    gaps = F.arrays_zip(lefts.alias("left"), rights.alias("right"))  # words between the runs of hit words
    between = lambda ps: F.transform(gaps, lambda g: F.array_join(F.slice(ps, g["left"] + 2, g["right"] - g["left"] - 1), ""))
    kept = F.get(F.transform(F.array(pieces_of), lambda ps: F.array_join(between(ps), "")), F.lit(0))  # the lambda holds the pieces: they are made once
    text = F.when(F.col("__hit").isNull(), F.col("text")).otherwise(F.concat(F.get(seps, F.lit(0)), kept))
    return joined.withColumn("text", text).select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, w[s:s + least(len(w), {WINDOW}) - 1] AS win FROM b, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) t(s) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, s, w[s:s + m - 1] AS win FROM d, ms, unnest(generate_series(1, len(w) - m + 1)) t(s) WHERE len(w) >= m),
hit AS (SELECT dw.r, dw.s, dw.m, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(s, s + m - 1)) t(p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
