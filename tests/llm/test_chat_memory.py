"""op5_chat in small memory: few Python workers, few work tables, batches of bounded size."""

import contextlib
import io

import pyarrow as pa

from loglake.llm import chat, common


def test_one_python_step_and_few_tables(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t}") for c in range(20) for t in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    before = common.work_tables()
    out = chat.op5_chat(spark, str(tmp_path))
    # messages, their parents, and three doublings for eight turns
    assert common.work_tables() - before <= 5
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        out.explain()
    # no other Python worker a task, and no array of a whole conversation in the JVM
    assert plan.getvalue().count("MapInArrow") == 1
    assert "ObjectHashAggregate" not in plan.getvalue() and "ExistingRDD" not in plan.getvalue()
    assert out.count() == 21


def test_batches_are_bounded_and_paths_cross_them():
    paths = [[("user", "q" * 300), ("assistant", "a" * 300)] * (1 + k % 4) for k in range(200)]
    read = 0

    def batches():
        nonlocal read
        rows = [(k if k else None, k, 1, *turn) for k, path in enumerate(paths) for turn in path]
        for at in range(0, len(rows), 7):
            read += 1
            columns = zip(*rows[at : at + 7])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], ["conv", "leaf", "rank", "role", "text"])

    out, reads = [], []
    for b in chat.format_batches(batches(), most=5000):
        reads.append(read)
        assert sum(map(len, b["formatted"].to_pylist())) < 5000 + 3000  # a path more at most
        out += b.to_pylist()
    assert reads[0] < 5 and len(reads) > 20
    assert [(r["conv"], r["leaf"]) for r in out] == [(k if k else None, k) for k in range(200)]
    for r, path in zip(out, paths):
        text, spans = chat.format_turns(path)
        assert (r["formatted"], list(zip(r["mask_starts"], r["mask_ends"]))) == (text, spans)


def test_format_then_read_equals_one_step(spark):
    schema = "conv long, id long, parent long, role string, text string, score double"
    rows = [(c, t, t - 1 if t else None, ["user", "assistant", None][t % 3], [f"{t}</s>\\", None][t % 5 == 4], 1.0) for c in (None, 1, 2) for t in range(100)]
    chosen = chat.paths(spark.createDataFrame(rows, schema), branches=None)
    two = chat.read_back(chat.format_paths(chosen)).collect()
    assert sorted(map(tuple, two), key=repr) == sorted(map(tuple, chat.format_and_read_back(chosen).collect()), key=repr)
    assert {r["n_turns"] for r in two} == {100} and len(two) == 3
