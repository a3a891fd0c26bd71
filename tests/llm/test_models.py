"""Token counts, neighbours and byte models against plain versions."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from conftest import fold_of

from loglake.llm import neighbours, ppm, tokens
from loglake.llm.common import UPPER, table


def test_edited_counts_equal_counts_of_the_edited_text(spark, small):
    docs = table(spark, small, "documents")
    rows = docs.select("doc_id", "text").collect()
    edits = {}
    for e in tokens.planned_edits(docs).orderBy("doc_id", "seq").collect():
        edits.setdefault(e["doc_id"], []).append(e)
    plain = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(tokens.VOCABULARY), special_tokens={})
    count = lambda t: len(plain.encode_ordinary(t))
    want = []
    for r in rows:
        text = r["text"] or ""
        for e in edits.get(r["doc_id"], ()):
            at = min(max(e["at"] or 0, 0), len(text))
            text = text[:at] + (e["inserted"] or "") + text[at + (e["deleted"] or 0) :]
        want.append((r["doc_id"], count(r["text"] or ""), count(text), len(text)))
    got = [(r["doc_id"], r["n_tokens_before"], r["n_tokens"], r["n_chars"]) for r in tokens.op8_tokens(spark, small).collect()]
    assert sorted(got) == sorted(want)


# the parts of this size; more of them; parts that are cut again; 500 vectors
@pytest.mark.parametrize("sf, part_rows, most", [("sf0.1", neighbours.PART_ROWS, neighbours.MOST_PARTS), ("sf0.1", 50, 256), ("sf0.1", 100, 4), ("sf0.01", neighbours.PART_ROWS, neighbours.MOST_PARTS)])
def test_recall_of_neighbours(spark, monkeypatch, sf, part_rows, most):
    for name, value in (("PART_ROWS", part_rows), ("MOST_PARTS", most), ("LEAST_PARTS", min(most, neighbours.LEAST_PARTS))):
        monkeypatch.setattr(neighbours, name, value)
    sf, fitted, fit = f"/root/testdata/{sf}", [], neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda x, parts, *a: fitted.append(parts) or fit(x, parts, *a))
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").filter("embedding is not null").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    got = {}
    for r in neighbours.op9_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % neighbours.QUERIES == 0}
    at, found = {int(v): k for k, v in enumerate(ids)}, 0
    for q, near in got.items():
        sims = x @ x[at[q]]
        sims[at[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -sims))[: neighbours.K]].tolist())
        assert sorted(r for r, _, _ in near) == list(range(1, neighbours.K + 1))
        assert all(abs(sims[at[v]] - s) < 1e-9 for _, v, s in near)
        found += len(best & {v for _, v, _ in near})
    assert found / (len(got) * neighbours.K) >= 0.9 and fitted[0] == (most if most < 16 else max(16, 1 << (len(ids) // part_rows).bit_length()))


def test_routing_probes_few_parts_of_clustered_vectors():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(64, 16))[rng.integers(0, 64, 4000)] * 4 + rng.normal(size=(4000, 16))).astype(float)
    model = neighbours.fit(x[:2000], 16)
    to, home = neighbours.route(model, x), neighbours.route(model | {"probes": 1}, x)[:, 0]
    assert model["probes"] <= 8 and np.bincount(home, minlength=16).max() < 4000 / 4
    sims = x[2000:2100] @ x.T
    sims[np.arange(100), np.arange(2000, 2100)] = -np.inf
    best = np.argpartition(-sims, 20, axis=1)[:, :20]
    assert np.mean([np.isin(home[b], t).mean() for b, t in zip(best, to[2000:2100])]) >= 0.9


def plain_ppm(train, text):
    """log10 probability by the definition, one byte after another."""
    seen = [{} for _ in range(ppm.ORDER + 1)]
    for t in train:
        s = [ppm.END] * ppm.ORDER + list(t) + [ppm.END]
        for i in range(ppm.ORDER, len(s)):
            for j in range(ppm.ORDER + 1):
                seen[j].setdefault(tuple(s[i - j : i]), Counter())[s[i]] += 1
    s, total = [ppm.END] * ppm.ORDER + list(text) + [ppm.END], 0.0
    for i in range(ppm.ORDER, len(s)):
        out = set()
        for j in range(ppm.ORDER, -1, -1):
            node = seen[j].get(tuple(s[i - j : i]), {})
            left = {k: c for k, c in node.items() if k not in out}
            if not left:
                continue
            all_of = sum(left.values()) + len(left)
            if s[i] in left:
                total += math.log10(left[s[i]] / all_of)
                break
            total += math.log10(len(left) / all_of)
            out |= set(node)
        else:
            total -= math.log10(ppm.SYMBOLS - len(out))
    return total


@pytest.mark.parametrize("batch_rows", [10000, 1])  # 1: a chunk fills several batches
def test_scores_equal_a_plain_model(spark, batch_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    texts = ["abracadabra", "abra cadabra", "the cat sat", "The cat sat on the mat", "", None, "zebra \x00 é", "cat cat cat", "new words here"]
    rows = [(i, t, "x") for i, t in enumerate(texts * 2)]
    got = {r["doc_id"]: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string, gram string").repartition(3)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    train = [t or "" for i, t, _ in rows if fold_of(i, ppm.FOLDS) != ppm.HELD_OUT]
    words = Counter(w for t in train for w in [*t.encode().lower().split(), b""])
    n, v = sum(words.values()), len(words)
    assert any(r["held_out"] for r in got.values()) and len(got) == len(rows)
    for i, t, _ in rows:
        own = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((words[w] + 1) / (n + (v + 1))) for w in own)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in words for w in own), n)
        assert abs(r["score"] - plain_ppm([t.encode() for t in train], (t or "").encode())) < 1e-6, t
        assert r["held_out"] == (fold_of(i, ppm.FOLDS) == ppm.HELD_OUT) and abs(r["base_score"] - base) < 1e-9


def test_nearest_keeps_ties_and_copies():
    """Few distinct vectors, so that most scores tie; ids that repeat; rows met in pieces."""
    rng, k = np.random.default_rng(3), 5
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    ids = rng.permutation(np.r_[np.arange(280), rng.integers(0, 280, 20)])
    asks = np.flatnonzero(ids % 7 == 0)
    met = neighbours.Nearest(ids[asks], x[asks], k)
    for i in range(0, 300, 70):
        met.meet(ids[i : i + 70], x[i : i + 70])
    query, near, score = met.best
    for j, i in enumerate(asks):
        sims, others = (x * x[i]).sum(1), np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -sims[others]))[:k]]
        assert near[query == j].tolist() == ids[best].tolist()
        assert score[query == j].tolist() == sims[best].tolist()


def test_scores_of_edge_tables(spark, monkeypatch):
    """No rows; no training document; a text of many blocks and a chunk of many parts; nulls and repeated rows; clashing columns."""
    schema = "doc_id long, text string, train int, kind string, chunk string"
    assert ppm.score(spark.createDataFrame([], schema)).count() == 0
    held = [i for i in range(60) if fold_of(i, ppm.FOLDS) == ppm.HELD_OUT]
    for r in ppm.score(spark.createDataFrame([(i, "ab c" * i, 1, "x", "y") for i in held], schema)).collect():
        n = len("ab c" * r["doc_id"]) + 1
        assert r["held_out"] and r["n_known"] == r["train_tokens"] == 0 and abs(r["score"] + n * math.log10(ppm.SYMBOLS)) < 1e-9 * n
        assert r["n_tokens"] == len(("ab c" * r["doc_id"]).split()) + 1 and r["base_score"] == 0.0
    monkeypatch.setattr(ppm, "BLOCK", 7)
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 40)
    monkeypatch.setattr(ppm, "PART_CHUNKS", 2)
    texts = ["the cat sat on the mat é " * 30, "a cat", None, "", "the mat", "x" * 100]
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)] + [(None, "no id", 1, "x", "y")] * 2 + [(1, "a cat", 1, "x", "y")]
    train = [(t or "").encode() for i, t, *_ in rows if fold_of(i, ppm.FOLDS) != ppm.HELD_OUT]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in ppm.score(spark.createDataFrame(rows, schema).repartition(3)).collect())
    assert got == sorted((i is None, i or 0, round(plain_ppm(train, (t or "").encode()), 6)) for i, t, *_ in rows)


def test_counts_and_base_scores_equal_sql(spark, small):
    want = duckdb.sql(rf"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') || [''] AS w FROM '{small}/documents.parquet'),
        t AS (SELECT doc_id, unnest(w) AS w FROM d),
        ids AS (SELECT unnest({[i for i in range(400) if fold_of(i, ppm.FOLDS) != ppm.HELD_OUT]}) AS doc_id),
        c AS (SELECT w, count(*) AS c FROM t SEMI JOIN ids USING (doc_id) GROUP BY 1),
        f AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + (v + 1))::DOUBLE)) AS base
        FROM t LEFT JOIN c USING (w), f GROUP BY doc_id""").fetchall()  # fmt: skip
    got = ppm.op7_ppm(spark, small).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score").collect()
    assert max(r["doc_id"] for r in got) < 400
    assert [(*r[:4], round(r[4], 6)) for r in sorted(map(tuple, got))] == [(*r[:4], round(r[4], 6)) for r in sorted(want)]


TEXTS = [None, "", " ", "one two  three\n\n\tfour", "don't won't we're 12345 x" * 40, "a" * 5000, "é́ 的的 \x00 👍🏽" * 30, "word " * 3000, "    " * 500]


def edited(text, edits):
    text = text or ""
    for _, at, deleted, inserted in edits:
        at = min(max(at, 0), len(text))
        text = text[:at] + (inserted or "") + text[at + max(deleted, 0) :]
    return text


def test_trees_are_kept_between_batches(spark, monkeypatch, tmp_path):
    """Nulls, repeated rows, long texts, edits out of range; a second batch reads the first one's table and encodes what it touches."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(tokens, "BLOCK", 8)
    plain = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(tokens.VOCABULARY), special_tokens={})
    rows = [(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 7, "x"), (None, "no id", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, tree string")
    pieces = ["", " ", "x", "'re", "\n\n", " new words ", "12", "的", None]
    batches = [[(i, seq, int(rng.integers(-3, len(t or "") + 4)), int(rng.integers(-1, 30)), pieces[rng.integers(0, len(pieces))]) for i, t in enumerate(TEXTS) for seq in range(6)] for _ in range(2)]
    trees, texts = tokens.build_trees(docs), {i: t for i, t, *_ in rows}
    for k, batch in enumerate(batches):
        edits = spark.createDataFrame([*batch, (99, 1, 0, 0, "x")], "doc_id long, seq int, at int, deleted int, inserted string")
        tokens.apply_edits(trees, edits).write.parquet(f"{tmp_path}/{k}")
        trees = spark.read.parquet(f"{tmp_path}/{k}")
        before = dict(texts)
        for i in range(len(TEXTS)):
            texts[i] = edited(texts[i], [e[1:] for e in batch if e[0] == i])
        for r in trees.collect():
            text = texts[r["doc_id"]]
            assert (r["n_tokens"], r["n_chars"]) == (len(plain.encode_ordinary(text or "")), len(text or ""))
            assert r["n_tokens_before"] == len(plain.encode_ordinary(before[r["doc_id"]] or "")) and r["n_edits"] == (0 if r["doc_id"] is None else 6)
            assert r["chars_encoded"] <= 6 * (30 + 40) or r["doc_id"] in (5, 8)  # one pre-token fills these texts
        assert trees.count() == len(rows)
    assert tokens.build_trees(docs.limit(0)).count() == 0 and tokens.apply_edits(trees, edits.limit(0)).agg({"n_edits": "sum"}).first()[0] == 0


def test_random_edits_of_one_tree(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 2)
    counter, rng = tokens.Counter(tokens.load_ranks(tokens.VOCABULARY)), np.random.default_rng(12)
    alphabet = list("ab c\n\t'e12. 的")
    for _ in range(300):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        tree = tokens.Tree.of(text, counter)
        for _ in range(6):
            at, deleted, inserted = int(rng.integers(-1, 62)), int(rng.integers(0, 12)), "".join(rng.choice(alphabet, rng.integers(0, 8)))
            text = edited(text, [(0, at, deleted, inserted)])
            tree.replace(at, deleted, inserted)
            assert "".join(leaf[0] for leaf in tree.leaves) == text and tree.characters == len(text)
            assert [n for leaf in tree.leaves for n in leaf[1]] == [len(t) for t in counter.cut.findall(text)]
            assert tree.tokens == len(counter.encoding.encode_ordinary(text)) if text else tree.tokens == 0
            tree = tokens.Tree.unpack(tree.pack(), counter)
