"""Reply trees against a plain walk, and the round trip of escapes."""

import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loglake.llm import chat

SCHEMA = "conv long, id long, parent long, role string, text string, score double"


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "<s>\\n"]), st.text(alphabet=st.sampled_from(list("ab\\nu<>/s[INST] 05bc3\n")), max_size=40)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_turns_read_back(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROLS)


def test_branches_equal_a_plain_walk(spark):
    rng = random.Random(5)
    rows = []
    for conv in (1, 2, None):
        for i in range(60):  # a long branch of 40, and replies to any message
            parent = None if i == 0 else i - 1 if i < 40 else rng.randrange(i)
            rows.append((conv, i, parent, rng.choice(["user", "assistant", None]), rng.choice(["x", "y</s>", None]), float(rng.randrange(9))))
        rows.append((conv, 99, 1000, "user", "its parent is not there", 2.0))
    expected = []
    for conv in (1, 2, None):
        by_id = {r[1]: r for r in rows if r[0] == conv}
        leaves = set(by_id) - {r[2] for r in by_id.values()}

        def path(i, by_id=by_id):
            return [] if i not in by_id else path(by_id[i][2]) + [i]

        ranked = sorted(leaves, key=lambda i: (-sum(by_id[j][5] for j in path(i)), i))[:3]
        for rank, leaf in enumerate(ranked, 1):
            expected += [(conv, leaf, rank, depth, *by_id[i][3:5]) for depth, i in enumerate(path(leaf), 1)]
    messages = spark.createDataFrame([*rows, rows[0], rows[5]], SCHEMA).withColumn("extra", chat.F.lit(1))
    found = [tuple(r) for r in chat.paths(messages, branches=3).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_nameless_messages_stay_and_cycles_are_an_error(spark):
    rows = [(1, 5, None, "user", "a", 1.0), (1, None, 5, "assistant", "b", 2.0), (1, None, 5, "assistant", "b", 2.0), (1, None, None, "user", "c", 9.0), (2, None, 7, "user", "long " * 100_000, 0.0)]
    found = [tuple(r) for r in chat.paths(spark.createDataFrame(rows, SCHEMA), branches=None).select("conv", "rank", "depth", "text").collect()]
    assert sorted(found) == [(1, 1, 1, "c"), (1, 2, 1, "a"), (1, 2, 2, "b"), (1, 3, 1, "a"), (1, 3, 2, "b"), (2, 1, 1, "long " * 100_000)]
    ring = spark.createDataFrame([(1, 1, 3, "user", "x", 0.0), (1, 2, 1, "user", "x", 0.0), (1, 3, 2, "user", "x", 0.0)], SCHEMA)
    with pytest.raises(ValueError, match="cycle"):
        chat.paths(ring)


def test_no_messages(spark):
    assert chat.read_back(chat.format_paths(chat.paths(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    rows = [(1, t, "assistant" if t % 2 else "user", "t[INST]\\" * (t % 5)) for t in range(70)] + [(2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "</s>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = [tuple(r) for r in chat.op5_chat(spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(found) == sorted(db.sql(chat.OP5_SQL).fetchall())
    planted = next(r for r in found if r[0] == -1)
    assert planted[4] == hashlib.sha256(chat.PLANTED.encode()).hexdigest()
