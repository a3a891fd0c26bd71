"""Operators on documents against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import xxhash
import zstandard
from conftest import SMALL, fold_of

from loglake.llm import decontaminate, language, mixing, quality, simhash, suffix
from loglake.llm.common import table


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# op1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_marks(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = sorted({len(k) for k in windows})
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, "The QUICK brown fox jumps over the lazy dog while seventeen other animals look on"), (2, "without an id"), (3, None), (None, "nul"), (4, " ,."), (2, "word word"), (5, "Straße İstanbul")]


def op1(docs, benchmark, **kw):
    from pyspark.sql import functions as F

    m = decontaminate.mark(docs, benchmark, **kw)
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha"), "contaminated")


def test_marks_of_hard_documents(spark, hard_docs):
    bench = spark.createDataFrame([(*x, 7) for x in ITEMS], "item_id long, text string, n_words int")
    want = brute_marks(texts_of(hard_docs), ITEMS)
    assert rows_of(op1(hard_docs, bench), "*") == want
    assert rows_of(op1(hard_docs, bench, broadcast_bytes=600), "*") == want  # several blocks
    assert rows_of(op1(hard_docs, bench, broadcast_bytes=100), "*") == want  # so many that a shuffle takes their place


def test_items_of_one_short_text(spark):
    """Very many items that are the same text: the broadcast table holds it once."""
    bench = spark.range(3000).selectExpr("id AS item_id", "'Hot phrase' AS text")
    docs = spark.createDataFrame([(1, "a hot phrase here"), (2, "cold")], "doc_id long, text string")
    assert rows_of(op1(docs, bench), "*") == brute_marks(texts_of(docs), [(i, "Hot phrase") for i in range(3000)])


def test_marks_of_the_small_table(spark):
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    assert rows_of(op1(docs, bench), "*") == brute_marks(texts_of(docs), [tuple(r) for r in bench.select("item_id", "text").collect()])


def test_marks_with_empty_tables(spark, hard_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.mark(hard_docs, bench).collect()} == {0}
    assert decontaminate.mark(hard_docs.limit(0), bench).count() == 0


def test_removal(spark, hard_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {r["doc_id"] for r in decontaminate.mark(hard_docs, bench).filter("contaminated").collect()}
    left = decontaminate.remove_documents(hard_docs, bench)
    assert left.columns == hard_docs.columns and 1 in bad
    # both null ids: one text is hit, one is null
    assert {r["doc_id"] for r in left.collect()} - {None} == {r["doc_id"] for r in hard_docs.collect()} - bad - {None}
    spans = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(hard_docs, bench).collect()}
    assert spans[4] == "" and spans[3] is None and "quick" not in spans[1] and spans[9].startswith("\x00 ") is False and "sep" in spans[9]
    again = decontaminate.mark(decontaminate.remove_spans(hard_docs, bench), bench)
    assert len(spans) and again.filter("doc_id = 1").first()["n_hit"] == 0


# op2


def test_mix_sizes_and_budgets(spark, hard_docs):
    rows = mixing.mix(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    by, targets, sizes = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
    for s, t in targets.items():
        assert by[s] == int(t)
    total = sum(sizes.values())
    level = {s: 2.0 * n for s, n in sizes.items()}
    assert sum(targets.values()) == pytest.approx(min(1.5 * total, sum(level.values())))
    assert all(t <= 2 * sizes[s] for s, t in targets.items())
    assert rows_of(mixing.mix(hard_docs), "doc_id", "taken") == rows_of(mixing.mix(hard_docs.repartition(7)), "doc_id", "taken")
    assert mixing.mix(hard_docs.limit(0)).count() == 0


def test_mix_does_not_depend_on_its_ranges(spark, monkeypatch):
    documents = table(spark, SMALL, "documents")
    want = sorted(duckdb.sql(mixing.OP2_SQL.replace("FROM documents)", f"FROM '{SMALL}/documents.parquet')")).fetchall())
    for ranges, rows in ((1, 100_000), (1, 3), (1024, 100_000)):
        monkeypatch.setattr(mixing, "RANGES", ranges)
        monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
        assert sorted(tuple(r) for r in mixing.mix(documents).select("doc_id", "size", "source_size", "target", "taken").collect()) == want


def test_targets_fill_to_ceilings(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 0, None: 400}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, full = {}, set()
    while True:  # reshare the excess by weight until none is above
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        want = {s: 2.0 * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and want[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(want)


# op3


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.op3_quality(spark, sf).filter("held_out")
    rows = scored.join(table(spark, sf, "labels"), "doc_id").select("score", "predicted", "quality").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    auc = np.mean([np.mean(g > bad) + np.mean(g == bad) / 2 for g in good])
    assert auc > 0.95 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_quality_of_hard_documents(spark, hard_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for used in (labels, labels.limit(0)):
        got = quality.score(hard_docs, quality.train(hard_docs, used))
        assert got.count() == hard_docs.count() and all(0 <= r["score"] <= 1 for r in got.collect())


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y, trees=20)

    def plain(row):
        total = model["base"]
        for f, t, v in zip(model["feature"], model["threshold"], model["value"]):
            node = 0
            for _ in range(model["depth"]):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node]
        return 1 / (1 + np.exp(-total))

    got = quality.walk(model, x)
    assert np.allclose(got, [plain(r) for r in x]) and np.mean((got > 0.5) == y) > 0.9


def test_quality_equals_a_plain_version(spark):
    """Every score of the query by the statistics of the whole text and a plain walk of the same trees."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.op3_quality(spark, SMALL).collect()}
    for doc_id, text in texts_of(docs):
        x, total = quality.statistics(text), model["base"]
        for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
            node = 0
            for _ in range(model["depth"]):
                node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
            total += value[node]
        score = 1 / (1 + np.exp(-total))
        r = got[doc_id]
        assert abs(r["score"] - score) < 1e-12 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (fold_of(doc_id, 5) == 0)
    assert len(got) == docs.count()


def test_labels_teach_with_one_text_each(spark, hard_docs):
    """Neither held-out labels nor repeated rows of an id change the trees."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "doc_id long, quality int")
    model = quality.train(hard_docs, labels)
    held = spark.createDataFrame([(i, 1 - i % 2) for i in range(1, 11) if fold_of(i, 5) == 0], "doc_id long, quality int")
    other = quality.train(hard_docs.unionAll(hard_docs.filter("doc_id = 7")), labels.join(held, "doc_id", "left_anti").unionAll(held))
    assert all(np.array_equal(model[k], other[k]) for k in ("feature", "threshold", "value")) and model["base"] == other["base"]


# op4


def brute_simhash(docs):
    def fp(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
        grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = [(d, fp(t)) for d, t in docs]
    group = list(range(len(marks)))
    for _ in marks:
        for i in range(len(marks)):
            group[i] = min(group[j] for j in range(len(marks)) if (marks[i][1] ^ marks[j][1]).bit_count() <= 4)
    ids = {}
    for g, (d, _) in zip(group, marks):
        ids[g] = min([x for x in (ids.get(g), d) if x is not None], default=None)
    return sorted(((d, f"{f:016x}", ids[g]) for g, (d, f) in zip(group, marks)), key=repr)


def op4(docs):
    from pyspark.sql import functions as F

    return simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"), "component_id")


def test_simhash_of_hard_documents(hard_docs):
    assert rows_of(op4(hard_docs), "*") == brute_simhash(texts_of(hard_docs))
    assert op4(hard_docs.limit(0)).count() == 0


def test_simhash_of_the_small_table(spark):
    docs = table(spark, SMALL, "documents")
    assert rows_of(op4(docs), "*") == brute_simhash(texts_of(docs))


def near_fingerprints(rng, centres, each):
    base = rng.integers(0, 1 << 63, centres, np.uint64)
    out = np.repeat(base, each)
    for _ in range(5):
        out ^= np.where(rng.random(len(out)) < 0.6, np.uint64(1) << rng.integers(0, 64, len(out), np.uint64), np.uint64(0))
    return np.unique(out)


def brute_classes(fp, radius=4):
    label = np.arange(len(fp))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)
    simhash.merge(label, a, b)
    return label


def test_vantage_point_tree_finds_all_links():
    fp = near_fingerprints(np.random.default_rng(1), 40, 40)
    assert (simhash.tree_links(fp, leaf=16) == brute_classes(fp)).all()


def test_dense_clouds_are_one_class_at_once():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 1 << 63, 1, np.uint64)
    for _ in range(3):  # all within 6 bits of one fingerprint, and a few far away
        fp = np.unique(np.r_[fp, np.repeat(fp, 12) ^ np.uint64(1) << rng.integers(0, 64, 12 * len(fp), np.uint64)])
    fp = np.unique(np.r_[fp, near_fingerprints(rng, 30, 5)])
    assert len(fp) > 1500 and (simhash.tree_links(fp, leaf=8) == brute_classes(fp)).all()


def test_trees_split_and_keep_links_whole():
    rng = np.random.default_rng(9)
    fp = near_fingerprints(rng, 3000, 4).view(np.int64)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    together = np.zeros(len(a), bool)
    for j in range(3):
        values = simhash._block(fp, j)
        tree = simhash.learn_tree(values[::3], 1, len(fp) / 3 * 64 / len(fp))
        shards = list(simhash.deal(values, tree, 1))
        assert len(tree) + 1 == len(shards) > 50 and max(len(x) for _, x in shards) < len(fp) / 4
        assert len(set(np.concatenate([x for _, x in shards]).tolist())) == len(fp)
        for _, own in shards:
            inside = np.isin(np.arange(len(fp)), own)
            together |= inside[a] & inside[b]
    assert len(a) > len(fp) and together.all()


@pytest.mark.parametrize("hot", [20, 1 << 20])
def test_shards_find_all_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_SHARD", hot)
    monkeypatch.setattr(simhash, "SHARD", 16)
    fp = near_fingerprints(np.random.default_rng(2), 10, 60)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    dealt = simhash._shards(df)
    assert dealt.select("shard").distinct().count() > 30
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    place = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    label = np.arange(len(fp))
    pairs = np.array([(place[a], place[b]) for a, b in roots.items()])
    simhash.merge(label, pairs[:, 0], pairs[:, 1])
    assert (label == brute_classes(fp)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(1000, 1000 + i) for i in range(1, 30)] + [(5, 5)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(31)}) == 1 and len({roots[1000 + i] for i in range(30)}) == 1 and roots[0] != roots[1000]


# op6


def brute_removed(docs):
    raw = [(d, (t or "").encode()) for d, t in docs]
    n = Counter(r[i : i + 200] for _, r in raw for i in range(len(r) - 199))
    out = []
    for d, r in raw:
        hit = bytearray(len(r))
        for i in range(len(r) - 199):
            if n[r[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", hit))
        kept = bytes(c for c, h in zip(r, hit) if not h)
        out.append((d, len(r), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_of_hard_documents(hard_docs):
    assert rows_of(suffix.dedup(hard_docs), "*") == brute_removed(texts_of(hard_docs))
    assert suffix.dedup(hard_docs.limit(0)).count() == 0


def test_repeats_of_the_small_table(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    assert rows_of(suffix.dedup(docs), "*") == brute_removed(texts_of(docs))


def test_repeats_by_sql_equal_brute_force(spark):
    documents = table(spark, SMALL, "documents").toPandas()  # noqa: F841  read by duckdb
    assert sorted(duckdb.sql(suffix.OP6_SQL).fetchall(), key=repr) == brute_removed(texts_of(table(spark, SMALL, "documents")))


@pytest.mark.parametrize("hot", [suffix.HOT_GROUP, 3])
def test_repeats_of_shared_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_GROUP", hot)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), 5))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (20, 30, 33, 34, 40, 60, 100)]
    rows = []
    for i in range(60):
        parts = [text(int(rng.integers(1, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(0, len(shared)))]
            cut = int(rng.integers(0, 40))
            parts += [s[cut:] if rng.random() < 0.5 else s[: len(s) - cut], text(int(rng.integers(0, 30)))]
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(suffix.dedup(docs), "*") == brute_removed(rows)


def test_run_ends_give_all_matching_statistics():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice(list(b"ab"), int(n)).astype(np.uint8)) for n in rng.integers(0, 40, 30)] + [b"ab" * 50, b"ab" * 50, b"", b"xyz" * 9]
    weights = [1] * (len(texts) - 1) + [2]
    index = suffix.RunIndex(texts, weights)
    assert int(index.run_lengths.sum()) == sum(len(t) + 1 for t in texts) > 1.5 * len(index.run_symbols)
    suffixes = [(k, i, t[i:]) for k, t in enumerate(texts) for i in range(len(t))]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for k, t in enumerate(texts):
        got = index.matches(k, k + 1)
        assert len(got) == len(t) + 1
        for i in range(len(t)):
            best = max(common(t[i:], x) for j, at, x in suffixes if (j, at) != (k, i))
            assert got[i] == (len(t) - i if weights[k] > 1 else best)


def test_no_byte_is_marked_without_the_index(hard_docs, monkeypatch):
    monkeypatch.setattr(suffix, "marked", lambda texts, weights: [np.empty(0, np.int64)] * len(texts))
    assert {r["n_removed"] for r in suffix.dedup(hard_docs).collect()} == {0}


# op10


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op10_language(spark, sf).filter("held_out").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["lang_pred"] != "und"]) > 0.97


def test_language_of_hard_documents(spark, hard_docs):
    got = {(r["doc_id"], r["lang_pred"], 0 <= r["score"] <= 1) for r in language.classify(hard_docs, language.learn(hard_docs)).collect()}
    assert {(3, "und", True), (4, "und", True), (5, "und", True)} <= got and all(x[2] for x in got)
    assert {r["lang_pred"] for r in language.classify(hard_docs, language.learn(hard_docs.limit(0))).collect()} == {"und"}


def test_language_equals_a_plain_version(spark):
    """Every prediction of the query by compressing the whole text with each dictionary, one after another."""
    docs = table(spark, SMALL, "documents")
    dictionaries = language.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in language.op10_language(spark, SMALL).collect()}
    for doc_id, text in texts_of(docs):
        want = ("und", 0.0)
        if regex.search(r"\p{L}", text or ""):
            sizes = []
            for lang, content in sorted(dictionaries.items()):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes.append((len(zstandard.ZstdCompressor(dict_data=d, level=language.LEVEL, write_content_size=False).compress(text.lower().encode())), lang))
            best, second = sorted(sizes)[:2]
            want = (best[1], (second[0] - best[0]) / second[0])
        assert got[doc_id] == (*want, fold_of(doc_id, 5) == 0)


def test_language_of_texts_without_letters(spark):
    schema = "doc_id long, text string, lang string, source string, score double, lang_pred string"
    rows = [(1, "the house and the garden", "en", None, 1.0, "x"), (2, "la maison et le jardin", "fr", None, 1.0, "x")]
    odd = [(10, "² ½ Ⅷ 12", "en", None, 1.0, "x"), (11, "́", "en", None, 1.0, "x"), (12, "ß", None, None, 1.0, "x"), (13, "的", "fr", None, 1.0, "x")]
    docs = spark.createDataFrame(rows * 20 + odd, schema)
    got = {r["doc_id"]: r["lang_pred"] for r in language.classify(docs, language.learn(docs)).collect()}
    assert (got[1], got[2], got[10], got[11]) == ("en", "fr", "und", "und") and got[12] != "und" != got[13]
    assert language.learn(docs.limit(0)) == {} and language.classify(docs.limit(0), {}).count() == 0


def test_dictionaries_come_from_all_of_all_texts(spark):
    """Every segment counts alike, wherever it lies, and copies count once."""
    long = " ".join(f"w{i:05d}" for i in range(40_000))  # 280,000 characters
    docs = spark.createDataFrame([(1, long, "en")] * 50 + [(2, "short text", "en")], "doc_id long, text string, lang string")
    d = language.learn(docs)["en"].decode()
    places = sorted(int(x[1:]) for x in d.split() if re.fullmatch(r"w\d{5}", x))
    assert 0.7 * language.DICTIONARY_BYTES < len(d) <= 1.1 * language.DICTIONARY_BYTES and len(set(places)) == len(places)
    counts = np.histogram(places, 4, (0, 40_000))[0]
    assert counts.min() > 0.1 * counts.sum()
    assert language.learn(spark.createDataFrame([(1, long, "en")], "doc_id long, text string, lang string"), 1 << 20)["en"].count(b"w") == len(re.findall("w", long))
