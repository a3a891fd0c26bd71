"""The corpus pipeline against brute force, with null ids and with repeated ids of unlike texts."""

import re
from collections import Counter

import duckdb
import pytest
from conftest import SMALL
from test_text_operators import brute_marks, brute_simhash

import corpus_pipeline
from loglake.llm import mixing
from loglake.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_leaders(rows):
    """The least row of each near-duplicate group: by id, null ids last."""
    places = brute_simhash([((i,), r[1]) for i, r in enumerate(rows)])  # a component's name: its first row
    groups = {}
    for (i,), _, (name,) in places:
        groups.setdefault(name, []).append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def brute_left(rows):
    """All rows without the bytes of windows that occur more than once."""
    raw = [(r[1] or "").encode() for r in rows]
    n = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for r, t in zip(rows, raw):
        hit = bytearray(len(t))
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        text = None if r[1] is None else bytes(c for c, h in zip(t, hit) if not h).decode(errors="ignore")
        out.append((r[0], text, r[2], r[3], len(text or "")))
    return out


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables: the small documents, of which seven texts get null ids and repeated ids; and the planted rows."""
    folder = tmp_path_factory.mktemp("planted")
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = [tuple(r) for r in corpus_pipeline.quality_stage(spark, docs, SMALL).collect()]
    alone = [r for r in brute_leaders(good) if r[1] and len(r[1].split()) > 60 and r[1].isascii()]
    a, b, c, d, e, f, g = (r[1] for r in sorted(alone)[:7])
    ids = [
        (None, a), (None, a), (None, b),  # groups of null ids only: two are unlike
        (9005, c), (9005, d), (9006, d.upper()),  # one id names two groups, one of which has another member
        (9003, e), (9005, e), (9011, f), (9011, g), (9010, f),  # the row that does not lead its group has an id that leads another
        (None, g),
    ]
    new = [(i, t, "en", "web", len(t)) for i, t in ids]
    rows = [r for r in rows if r[1] not in (a, b, c, d, e, f, g)] + new
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    table(spark, SMALL, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    want = [(None, a), (None, b), (9003, e), (9005, c), (9005, d), (9010, f), (9011, g)]
    return str(folder), new, want


def test_one_row_of_each_group_is_kept(spark, planted):
    _, new, want = planted
    stage = lambda docs: [(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()]
    docs = spark.createDataFrame(new, SCHEMA)
    assert sorted(stage(docs.repartition(5)), key=repr) == sorted(stage(docs.coalesce(1)), key=repr) == sorted(want, key=repr)


def test_pipeline_equals_brute_force(spark, planted):
    folder, _, want = planted
    # the classifier's own rows go in; the other four stages are done again by their definitions
    rows = [tuple(r) for r in corpus_pipeline.quality_stage(spark, table(spark, folder, "documents"), folder).collect()]
    rows = brute_leaders(rows)
    assert {r[:2] for r in rows} >= set(want)
    rows = brute_left(rows)
    bench = [tuple(r) for r in table(spark, folder, "benchmark").select("item_id", "text").collect()]
    bad = {i for (i,), *_, contaminated in brute_marks([((i,), r[1]) for i, r in enumerate(rows)], bench) if contaminated}
    documents = spark.createDataFrame([r for i, r in enumerate(rows) if i not in bad], SCHEMA).toPandas().astype({"doc_id": "Int64"})  # noqa: F841  read by duckdb
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = duckdb.sql(f"SELECT doc_id, size, taken FROM ({mixing.OP2_SQL}) WHERE taken > 0").fetchall()
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], size(r["text"]), r["taken"]) for r in got) == Counter(mixed)
    left = Counter((None if r[0] is None else int(r[0]), r[1]) for i, r in enumerate(rows) if i not in bad)
    assert not Counter((r["doc_id"], r["text"]) for r in got) - left


@pytest.mark.parametrize("rows", [0, 100])
def test_stages_of_hard_documents_and_of_none(spark, hard_docs, rows):
    docs = hard_docs.limit(rows)
    ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SMALL)
        assert set(corpus_pipeline.COLUMNS) <= set(got.columns) and (name == "mix" or got.columns == list(corpus_pipeline.COLUMNS))
        kept = Counter(r["doc_id"] for r in got.select("doc_id").collect())
        assert not kept - ids
        if name == "suffix":  # it shortens texts and keeps every row
            assert kept == ids and {r["text"] for r in got.filter("doc_id = 3").collect()} <= {None}
        if name == "simhash":  # 1 and 10 are one text but for its case and last word, 4, 5, 3 and a null id have fingerprint zero
            assert kept[2] + kept[1] + kept[10] <= 2 and kept[4] + kept[5] + kept[3] + kept[None] <= 2
