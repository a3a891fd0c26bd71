"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions.core import FIELDS, bounded_message, normalize, number, template_signature
from loglake.operators import query as Q
from loglake.operators import rollup as R
from loglake.operators import search as S
from loglake.operators import storage as K
from loglake.sources import wire as W
from loglake.sources.adapters import events_as_logs, table

DAY = 86_400_000_000_000
T0 = 1_704_067_200_000_000_000  # 2024-01-01
NOON, DAY5, DAY6 = T0 + DAY // 2, T0 + 4 * DAY, T0 + 5 * DAY


LOGS = f"""logs AS (SELECT *, 9223372036854775808::UBIGINT AS flip FROM (SELECT epoch_us(ts) * 1000 AS timestamp_ns, event_id,
 event_type || ' user ' || user_id || ' took ' || CAST(round(value * 100) AS BIGINT) || 'us k=' || (props::JSON->>'$.k') AS message,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level, '/' || event_type AS path, user_id::VARCHAR AS trace_id,
 CAST(round(value * 100) AS BIGINT)::VARCHAR AS latency_ms, (200 + 100 * (event_id % 4))::VARCHAR AS status,
 lpad(lower(to_hex(epoch_us(ts)::UBIGINT * 1000 + 9223372036854775808::UBIGINT)), 16, '0') || lpad(lower(to_hex(event_id)), 16, '0') AS doc_id FROM events))"""
SIG = r"""array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '[\s\v\x{{85}}\p{{Z}}]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[0-9a-fA-F]{{8,}}') THEN '<HEX>' WHEN regexp_matches(x, '[0-9]') THEN '<NUM>' ELSE translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END), ' ')"""
KEY = """'[' || '{{"key":"latency_ms","value":"' || latency_ms || '"}},{{"key":"level","value":"' || level || '"}},{{"key":"path","value":"' || path || '"}},{{"key":"status","value":"' || status || '"}},{{"key":"trace_id","value":"' || trace_id || '"}}]'""".replace("{{", "{").replace("}}", "}")

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, logs: bool = True):
    def keep(f):
        _Q[name] = f
        if sql:
            _SQL[name] = (f"WITH {LOGS} " if logs else "") + sql
        return f

    return keep


def _simple(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    query(name, sql)(lambda spark, d: f(events_as_logs(spark, d)))


COLS = ("timestamp_ns", "message", "doc_id")
SEL = "SELECT timestamp_ns, message, doc_id FROM logs WHERE "
for _name, _labels, _start, _end in (
    ("select_range", {}, T0, DAY5), ("select_range_empty", {}, 0, 5), ("select_one_field", {"level": "error"}, T0, DAY6),
    ("select_multi_field", {"level": "info", "status": "300", "path": "/click"}, T0, T0 + 40 * DAY), ("select_missing_field", {"nothing": "x"}, T0, DAY6), ("range_negative_start", {}, -(1 << 62), T0 + DAY),
):
    _cond = "".join(f" AND {k} = '{v}'" for k, v in _labels.items()) if "nothing" not in _labels else " AND false"
    _simple(_name, lambda x, a=_start, b=_end, c=_labels: Q.select_logs(x, a, b, c).select(*COLS), f"{SEL}timestamp_ns >= {_start} AND timestamp_ns < {_end}{_cond}")

# tables that are built once for each folder of a session and then read: rollups by tier, and text indexes
_BUILT: dict[tuple[str, str, str], str] = {}
BUILD_SECONDS: dict[str, float] = {}


def stored(spark: SparkSession, d: str, name: str, build: Callable[[str], None]) -> str:
    """The folder in which ``build`` has put the table ``name`` of the folder ``d``; it builds on the first call."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        began, path = time.perf_counter(), K.work_folder(spark)
        build(path)
        BUILD_SECONDS[name] = round(time.perf_counter() - began, 3)
        _BUILT[key] = path
    return _BUILT[key]


def rollup(spark: SparkSession, d: str, kind: str, field: str, tier: str) -> DataFrame:
    """A stored tier: the minute tier is made of the records, each coarser one of the tier below."""

    def build(path: str) -> None:
        if tier == "minute":
            rows = R.MAKERS[kind](R.samples(events_as_logs(spark, d), (field,)))
        else:
            rows = R.merge_up(rollup(spark, d, kind, field, R.TIERS[R.TIERS.index(tier) - 1]), tier)
        R.store(rows, path, tier)

    return R.stored(spark, stored(spark, d, f"{kind} of {field} by {tier}", build)).drop("expire_at_ns")


def index(spark: SparkSession, d: str, name: str, start: int | None = None, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored text index of documents (one corpus) or of events (by day)."""

    def build(path: str) -> None:
        S.write_index(S.corpus(table(spark, d, "documents"), None) if name == "documents" else S.corpus(events_as_logs(spark, d), DAY), path)

    return S.read_index(spark, stored(spark, d, f"index of {name}", build), start, end, DAY)


_EDGE = "(SELECT max(timestamp_ns) FROM logs)"


@query("range_end_exclusive", f"{SEL}timestamp_ns < {_EDGE}")
def _(spark, d):
    logs = events_as_logs(spark, d)
    return Q.select_logs(logs, 0, logs.agg(F.max("timestamp_ns")).first()[0]).select(*COLS)


@query("point_lookup", f"{SEL}event_id = 17")
def _(spark, d):
    logs = events_as_logs(spark, d)
    return Q.point_lookup(logs, logs.filter(F.col("doc_id").endswith(f"{17:016x}")).first()["doc_id"]).select(*COLS)


_simple("doc_id_order", lambda x: x.select("doc_id", "timestamp_ns"), "SELECT doc_id, timestamp_ns FROM logs")
_simple("allowlist_projection", lambda x: normalize(x.select("timestamp_ns", "message", "fields"), ("level", "path")).select("timestamp_ns", "stream_key"),
        """SELECT timestamp_ns, '[{"key":"level","value":"' || level || '"},{"key":"path","value":"' || path || '"}]' AS stream_key FROM logs""")  # fmt: skip
query("bounded_message", "SELECT doc_id, CASE WHEN len(text) > 240 THEN left(text, 240) || '…' ELSE text END AS message, len(text) > 240 AS truncated FROM documents", False)(
    lambda spark, d: table(spark, d, "documents").select("doc_id", bounded_message(F.col("text")).alias("message"), (F.char_length("text") > 240).alias("truncated"))
)
_simple("logql_selector", lambda x: Q.query_lines(x, '{level="error", status="200"}', T0, DAY6).select(*COLS), f"{SEL}timestamp_ns >= {T0} AND timestamp_ns < {DAY6} AND level = 'error' AND status = '200'")
_simple("logql_line_filter", lambda x: Q.query_lines(x, '{level="error"} |= "user 8"', T0, T0 + 40 * DAY).select(*COLS), f"{SEL}level = 'error' AND contains(message, 'user 8')")
_simple("logql_empty_selector", lambda x: Q.query_lines(x, '{} |= "k=3"', T0, DAY6).select(*COLS), f"{SEL}timestamp_ns < {DAY6} AND contains(message, 'k=3')")
_simple("query_range_lines", lambda x: Q.query_range(x, '{level="error"} |= "user"', T0, T0 + 40 * DAY), f"SELECT {KEY} AS stream_key, timestamp_ns, doc_id, message FROM logs WHERE level = 'error' AND contains(message, 'user')")
_simple("query_range_streams", lambda x: Q.query_range_streams(x, '{level="error"}', T0, T0 + 40 * DAY),
        f"SELECT {KEY} AS stream_key, count(*) AS n, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM logs WHERE level = 'error' GROUP BY 1")
query("template_signature", f"SELECT doc_id, md5({SIG.format('text')}) AS sig FROM documents", False)(lambda spark, d: table(spark, d, "documents").select("doc_id", F.md5(template_signature(F.col("text"))).alias("sig")))
_simple("template_counts", lambda x: x.groupBy("template_sig").agg(F.count("*").alias("n")), f"SELECT {SIG.format('message')} AS template_sig, count(*) AS n FROM logs GROUP BY 1")
query("template_hex_vs_num", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'É <HEX>' ELSE 'É <NUM>' END AS sig FROM logs")(
    lambda spark, d: table(spark, d, "events").select("event_id", template_signature(F.concat(F.lit("É "), F.lpad(F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, 8).otherwise(7), F.lit("1")))).alias("sig"))
)
_simple("list_streams_exact", lambda x: Q.list_streams(x, T0, T0 + 3 * DAY),
        f"SELECT field, count(*) AS distinct_values, array_to_string(list_sort(list(value))[1:10], ',') AS samples, 'exact_in_window' AS cardinality_source FROM (SELECT DISTINCT field, value FROM (SELECT unnest(['level','status','trace_id','latency_ms','path']) AS field, unnest([level, status, trace_id, latency_ms, path]) AS value FROM logs WHERE timestamp_ns < {T0 + 3 * DAY})) GROUP BY 1")


@query(
    "list_streams_hll",
    """SELECT 'trace_id' AS field, '' AS samples, 'hll_rollup_estimate' AS cardinality_source, true AS within FROM (SELECT 1)
UNION ALL SELECT 'level', string_agg(DISTINCT level, ',' ORDER BY level), 'exact_in_window', true FROM logs""",
)
def _(spark, d):
    logs, end = events_as_logs(spark, d), T0 + 40 * DAY
    found = Q.list_streams(logs, T0, end, ("trace_id", "level"), rollup(spark, d, "hll", "trace_id", "hour"))
    exact = Q.list_streams(logs, T0, end, ("trace_id", "level")).select("field", F.col("distinct_values").alias("exact"))
    return found.join(exact, "field").select("field", "samples", "cardinality_source", (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("within"))


_ANOM = "SELECT template_sig, current, baseline, kind, example FROM (SELECT *, CASE WHEN baseline = 0 THEN 'new' WHEN current / baseline >= {ratio} THEN 'volume_spike' END AS kind FROM (SELECT {sig} AS template_sig, count(*) FILTER ({c}) AS current, count(*) FILTER ({b}) AS baseline, arg_min(message, (timestamp_ns, doc_id)) FILTER ({c}) AS example FROM logs GROUP BY 1)) WHERE current > 0 AND kind IS NOT NULL"
for _name, _a, _b, _base, _ratio in (("anomalies_new", NOON, NOON + 7_200_000_000_000, (NOON - 600_000_000_000, NOON), 3.0), ("anomalies_spike", DAY5, DAY6, (T0, T0 + DAY // 4), 3.0), ("anomalies_default_baseline", DAY5, DAY6, None, 1.0)):
    _lo, _hi = _base or (_a - (_b - _a), _a)
    _w = "WHERE timestamp_ns >= {} AND timestamp_ns < {}"
    _simple(_name, lambda x, a=_a, b=_b, base=_base, r=_ratio: Q.find_anomalies(x, a, b, base, r).select("template_sig", "current", "baseline", "kind", "example"), _ANOM.format(ratio=_ratio, sig=SIG.format("message"), c=_w.format(_a, _b), b=_w.format(_lo, _hi)))

_STREAM = "level = 'info'"
for _name, _n, _pick in (("context_window", 5, 40), ("context_edges", 3, 0)):

    @query(_name, f"SELECT timestamp_ns, doc_id, message, is_anchor FROM (SELECT *, doc_id = a AS is_anchor, max(rn) FILTER (doc_id = a) OVER () AS place FROM (SELECT l.timestamp_ns, l.doc_id, l.message, a, row_number() OVER (ORDER BY l.timestamp_ns, l.doc_id) AS rn FROM logs l, (SELECT doc_id AS a, timestamp_ns AS t, level AS v FROM logs ORDER BY timestamp_ns, doc_id LIMIT 1 OFFSET {_pick}) WHERE level = v AND l.timestamp_ns >= t - {DAY} AND l.timestamp_ns < t + {DAY})) WHERE abs(rn - place) <= {_n}")
    def _(spark, d, n=_n, pick=_pick):
        logs = normalize_level(events_as_logs(spark, d))
        key = logs.orderBy("timestamp_ns", "doc_id").offset(pick).limit(1).first()["doc_id"]
        return Q.get_context(logs, key, n, DAY)


def normalize_level(logs: DataFrame) -> DataFrame:
    """Streams by level alone."""
    return logs.withColumn("stream_key", F.col("f_level"))


_TR = {t: f"date_trunc('{t}', make_timestamp(timestamp_ns // 1000))" for t in R.TIERS}


for _t in R.TIERS:

    @query(f"rollup_exact_{_t}", f"""SELECT epoch_us({_TR[_t]}) AS bucket_us, field, value, count(*) AS cnt
FROM (SELECT timestamp_ns, unnest(['level', 'status']) AS field, unnest([level, status]) AS value FROM logs) GROUP BY ALL""")
    def _(spark, d, t=_t):
        both = rollup(spark, d, "exact", "level", t).unionByName(rollup(spark, d, "exact", "status", t))
        return both.select(F.unix_micros("bucket_start").alias("bucket_us"), "field", "value", "cnt")


@query("merge_up_equals_direct", f"SELECT count(*) AS buckets, 0::BIGINT AS different FROM (SELECT DISTINCT {_TR['month']}, level FROM logs)")
def _(spark, d):
    s = R.samples(events_as_logs(spark, d), ("level",))
    direct = R.exact(s.withColumn("bucket_start", F.date_trunc("month", "bucket_start"))).withColumnRenamed("cnt", "direct")
    both = rollup(spark, d, "exact", "level", "month").join(direct, ["bucket_start", "field", "value"], "full")
    return both.agg(F.count("*").alias("buckets"), F.count(F.when(~F.col("cnt").eqNullSafe(F.col("direct")), 1)).alias("different"))


@query("rollup_union", f"""SELECT epoch_us({_TR['minute']}) AS bucket_us, level AS value, 2 * count(*) AS cnt FROM logs GROUP BY ALL""")
def _(spark, d):
    one = rollup(spark, d, "exact", "level", "minute")
    return R.union(one, one).select(F.unix_micros("bucket_start").alias("bucket_us"), "value", F.col("cnt").cast("long").alias("cnt"))


for _t, _span in (("minute", 3_600_000_000_000), ("hour", DAY), ("day", 31 * DAY), ("month", 60 * DAY)):

    @query(f"agg_count_{_t}_tier", f"""SELECT level AS value, count(*) AS cnt FROM logs
WHERE epoch_us({_TR[_t]}) * 1000 >= {T0} AND epoch_us({_TR[_t]}) * 1000 < {T0 + _span} GROUP BY 1""")
    def _(spark, d, t=_t, span=_span):
        return R.aggregate({(t, "exact"): rollup(spark, d, "exact", "level", t)}, "level", T0, T0 + span)


@query("agg_cardinality", "SELECT count(DISTINCT latency_ms) AS exact, true AS within FROM logs")
def _(spark, d):
    estimate = R.aggregate({("month", "hll"): rollup(spark, d, "hll", "latency_ms", "month")}, "latency_ms", T0, T0 + 60 * DAY, "cardinality")
    exact = events_as_logs(spark, d).agg(F.countDistinct("f_latency_ms").alias("exact"))
    return exact.crossJoin(F.broadcast(estimate)).select("exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


query("agg_topk_exact", f"SELECT path AS value, count(*) AS cnt FROM logs WHERE timestamp_ns < {T0 + 30 * DAY} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")(
    lambda spark, d: R.aggregate({("day", "exact"): rollup(spark, d, "exact", "path", "day")}, "path", T0, T0 + 30 * DAY, "topk", k=3)
)
# few values: the summaries hold all of them, and their counts are exact
query("agg_topk_sketch", "SELECT path AS value, count(*) AS cnt FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")(
    lambda spark, d: R.aggregate({("month", "topk"): rollup(spark, d, "topk", "path", "month")}, "path", T0, T0 + 60 * DAY, "topk", k=3)
)


@query("agg_topk_heavy", """SELECT value, cnt FROM (SELECT trace_id AS value, count(*) AS cnt FROM (
  SELECT trace_id FROM logs UNION ALL SELECT 'heavy-' || level FROM logs) GROUP BY 1) WHERE value LIKE 'heavy-%'""")
def _(spark, d):
    """Heavy values among many rare ones: the summaries merge by minute, and the heavy ones' counts stay exact."""
    s = R.samples(events_as_logs(spark, d), ("trace_id", "level")).withColumn("value", F.when(F.col("field") == "level", F.concat(F.lit("heavy-"), "value")).otherwise(F.col("value")))
    top = R.approximate_top_k(R.top_sketch(s.withColumn("field", F.lit("both")).withColumn("bucket_start", F.date_trunc("day", "bucket_start"))), 10)
    return top.filter(F.col("value").startswith("heavy-"))


_BIN = f"CASE WHEN abs(v) <= {R.LEAST} THEN 0 WHEN v > 0 THEN (ceil(ln(abs(v)) / {__import__('math').log(R.GAMMA)!r}) + 100000)::INT ELSE -(ceil(ln(abs(v)) / {__import__('math').log(R.GAMMA)!r}) + 100000)::INT END"
query("ddsketch_bins", f"""SELECT epoch_us({_TR['hour']}) AS bucket_us, {_BIN} AS bin, count(*) AS cnt
FROM (SELECT timestamp_ns, latency_ms::DOUBLE AS v FROM logs) GROUP BY ALL""")(
    lambda spark, d: rollup(spark, d, "ddsketch", "latency_ms", "hour").select(F.unix_micros("bucket_start").alias("bucket_us"), "bin", "cnt")
)
for _q in (50, 95, 99):

    @query(f"agg_quantile_p{_q}", f"""SELECT round(2 * pow({R.GAMMA!r}, bin - 100000) / {R.GAMMA + 1!r}, 6) AS value
FROM (SELECT bin, sum(c) OVER (ORDER BY bin) AS upto, sum(c) OVER () AS n
  FROM (SELECT {_BIN} AS bin, count(*) AS c FROM (SELECT latency_ms::DOUBLE AS v FROM logs) GROUP BY 1))
WHERE upto > floor({_q / 100} * (n - 1)) ORDER BY bin LIMIT 1""")
    def _(spark, d, q=_q / 100):
        found = R.aggregate({("month", "ddsketch"): rollup(spark, d, "ddsketch", "latency_ms", "month")}, "latency_ms", T0, T0 + 60 * DAY, "quantile", q=q)
        return found.select(F.round("value", 6).alias("value"))


@query("ddsketch_error_bound", "SELECT true AS within FROM (SELECT 1)")
def _(spark, d):
    logs = events_as_logs(spark, d)
    value = R.quantile(rollup(spark, d, "ddsketch", "latency_ms", "minute"), 0.99)
    exact = logs.agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY cast(f_latency_ms AS DOUBLE))").alias("exact"))
    return value.crossJoin(F.broadcast(exact)).select((F.abs(F.col("value") - F.col("exact")) <= 0.011 * F.col("exact")).alias("within"))


_simple("ddsketch_non_numeric_dropped", lambda x: x.select(number(F.when(F.col("f_status") == "200", F.col("f_level")).when(F.col("f_status") == "300", F.concat(F.lit(" "), "f_latency_ms")).otherwise(F.col("f_latency_ms"))).alias("v")).agg(F.count("v").alias("kept"), F.count("*").alias("n")),
        "SELECT count(*) FILTER (status IN ('400', '500')) AS kept, count(*) AS n FROM logs")

_BM = """, w AS (SELECT doc_id, bucket, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM c),
p AS (SELECT doc_id, bucket, dl, term, count(*) AS tf FROM (SELECT doc_id, bucket, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN ({terms}) GROUP BY ALL),
f AS (SELECT bucket, count(*) AS n, avg(len(w)) AS avgdl FROM w GROUP BY 1), df AS (SELECT bucket, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT bucket, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN df USING (bucket, term) JOIN f USING (bucket) GROUP BY ALL)
"""
_DOCS = "WITH c AS (SELECT doc_id, 0 AS bucket, text FROM documents)"


def _terms(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


for _name, _words in (("bm25_single_corpus", "licensed"), ("bm25_multi_term", "licensed tion heit"), ("bm25_no_match", "nonexistentword")):

    @query(_name, _DOCS + _BM.format(terms=_terms(_words)) + "SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10", False)
    def _(spark, d, words=_words):
        return S.bm25(*index(spark, d, "documents"), words, 10, per_bucket=False).select("doc_id", "score")


@query("search_records", _DOCS + _BM.format(terms=_terms("licensed tion")) + "SELECT doc_id, score, source FROM s JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10", False)
def _(spark, d):
    return S.search_records(table(spark, d, "documents").select("doc_id", "source"), *index(spark, d, "documents"), "licensed tion")


_WIDE = DAY
_EV = f"WITH {LOGS}, c AS (SELECT doc_id, timestamp_ns - timestamp_ns % {_WIDE} AS bucket, message AS text FROM logs)"


@query("bm25_bucketed", _EV + _BM.format(terms=_terms("error purchase")) + "SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10", False)
def _(spark, d):
    return S.bm25(*index(spark, d, "events"), "error purchase", 10).select("doc_id", "score")


_A, _B = T0 + DAY // 2, T0 + DAY + DAY // 4
for _name, _exact, _labels, _off in (("bm25_exact_range", True, None, 0), ("bm25_bucket_granular", False, None, 0), ("search_logs_label_filter", True, {"status": "300"}, 0), ("search_logs_page2", True, None, 5)):
    _c = (f"timestamp_ns >= {_A} AND timestamp_ns < {_B}" if _exact else "true") + (" AND status = '300'" if _labels else "")

    @query(_name, _EV.replace("AS text FROM logs)", f"AS text FROM logs WHERE timestamp_ns < {T0 + 2 * DAY})") + _BM.format(terms=_terms("error user")) + f"SELECT doc_id, score, timestamp_ns, message FROM s JOIN logs USING (doc_id) WHERE {_c} ORDER BY score DESC, doc_id LIMIT 5 OFFSET {_off}", False)
    def _(spark, d, exact=_exact, labels=_labels, off=_off):
        return S.search_logs(events_as_logs(spark, d), "error user", _A, _B, 5, off, labels, _WIDE, exact, index(spark, d, "events", _A, _B))


@query("search_logs_unindexed", _EV.replace("AS text FROM logs)", f"AS text FROM logs WHERE timestamp_ns < {T0 + DAY})") + _BM.format(terms=_terms("error user")) + f"SELECT doc_id, score FROM s JOIN logs USING (doc_id) WHERE timestamp_ns >= {_A} ORDER BY score DESC, doc_id LIMIT 5", False)
def _(spark, d):
    return S.search_logs(events_as_logs(spark, d), "error user", _A, T0 + DAY, 5, 0, None, _WIDE).select("doc_id", "score")


@query("search_logs_without_text", f"SELECT doc_id, timestamp_ns, message FROM logs WHERE timestamp_ns >= {_A} AND timestamp_ns < {_B} AND level = 'error' ORDER BY timestamp_ns, doc_id LIMIT 7 OFFSET 3")
def _(spark, d):
    return S.search_logs(events_as_logs(spark, d), None, _A, _B, 7, 3, {"level": "error"}).drop("score")


@query("search_logs_cursor", f"SELECT doc_id, message, false AS truncated, '8' AS cursor, 9::BIGINT AS considered FROM logs WHERE timestamp_ns >= {_A} AND timestamp_ns < {_B} ORDER BY timestamp_ns, doc_id LIMIT 4 OFFSET 4")
def _(spark, d):
    rows, cursor, considered = S.search_page(events_as_logs(spark, d), None, _A, _B, 4, "4")
    return rows.select("doc_id", "message", "truncated", F.lit(cursor).alias("cursor"), F.lit(considered).cast("long").alias("considered"))


_KNN = "SELECT e.vec_id AS doc_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0 AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY distance, doc_id LIMIT {k}"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return v, v.filter("doc_id = 7").first()["embedding"]


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return S.bm25(*index(spark, d, "documents"), "licensed tion heit", k, per_bucket=False)


query("knn_cosine", _KNN.format(k=10), False)(lambda spark, d: S.knn(*_vectors(spark, d), 10))
_HY = _DOCS + _BM.format(terms=_terms("licensed tion heit")) + f", t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 20)), v AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS rn FROM ({_KNN.format(k=20)})) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rn)), 6) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
query("hybrid_search", _HY, False)(lambda spark, d: S.hybrid(_hits(spark, d, 20), *_vectors(spark, d), 10))
query("hybrid_fallback_text", _DOCS + _BM.format(terms=_terms("licensed tion heit")) + "SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10", False)(lambda spark, d: S.hybrid(_hits(spark, d, 20), None, None, 10))
query("rrf_fusion", "SELECT c AS doc_id, round(sum(1.0::DOUBLE / (60 + rn)), 6) AS score FROM (SELECT c_custkey AS c, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) UNION ALL SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", False)(
    lambda spark, d: S.rrf([(c.orderBy(*o).limit(50), o) for c in [table(spark, d, "customer").withColumnRenamed("c_custkey", "doc_id")] for o in ([F.desc("c_acctbal"), F.col("doc_id")], [F.col("doc_id")])], 20)
)

# wire formats: bodies made from the events, decoded again
_DEC = "SELECT timestamp_ns, message, level, path FROM logs"
REQUEST_RECORDS = 500


def _decoded(rows: DataFrame) -> DataFrame:
    return rows.select("timestamp_ns", "message", F.col("fields")["level"].alias("level"), F.col("fields")["path"].alias("path"))


def _bodies(spark: SparkSession, d: str, body) -> DataFrame:
    logs = events_as_logs(spark, d).select("timestamp_ns", "message", F.map_filter("fields", lambda k, _: k.isin("level", "path")).alias("fields"), "doc_id")
    # a request has REQUEST_RECORDS at most, whatever the size of the table and its keys: bodies stay far under the frame limit
    return logs.select(body.alias("line"), F.floor(F.monotonically_increasing_id() / REQUEST_RECORDS).alias("request"))


def _iso() -> Column:  # columns need a session: none is made at import
    return F.concat(F.date_format(F.timestamp_micros(F.expr("timestamp_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _doc() -> Column:
    return F.to_json(F.struct(F.col("message"), _iso().alias("@timestamp"), F.col("fields")["level"].alias("level"), F.col("fields")["path"].alias("path"), F.array(F.lit(1)).alias("skipped")))


@query("native_decode", _DEC)
def _(spark, d):
    b = _bodies(spark, d, F.struct("timestamp_ns", "message", "fields")).groupBy("request").agg(F.to_json(F.collect_list("line")).alias("body"))
    return _decoded(W.native(b))


@query("loki_json_decode", _DEC)
def _(spark, d):
    line = F.struct(F.col("fields").alias("stream"), F.array(F.array(F.col("timestamp_ns").cast("string"), F.col("message"))).alias("values"))
    b = _bodies(spark, d, line).groupBy("request").agg(F.to_json(F.struct(F.collect_list("line").alias("streams"))).alias("body"))
    return _decoded(W.loki_json(b))


@query("es_bulk_decode", _DEC)
def _(spark, d):
    b = _bodies(spark, d, F.concat(F.lit('{"delete":{"_id":"1"}}\n\n{"index":{}}\n'), _doc())).groupBy("request").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    bad = spark.createDataFrame([(x,) for x in (None, "", "5\n{}", "{", '{"index":{}}', '{"index":{}}\n[1]', '{"index":{}}\n{"a":NaN}')], "body string")
    return _decoded(W.es_bulk(b.select("body").unionAll(bad)))


@query("loki_protobuf_decode", _DEC)
def _(spark, d):
    """Push requests of up to REQUEST_RECORDS lines, and bodies that can't be read among them."""
    lines = _bodies(spark, d, F.struct("timestamp_ns", "message", F.concat(F.lit('{level="'), F.col("fields")["level"], F.lit('", path="'), F.col("fields")["path"], F.lit('"}')).alias("labels")))

    def encode(batches):
        for b in batches:
            for lines in b["lines"]:  # a request at a time becomes Python objects, not the batch
                body = W.push_request([(x["timestamp_ns"], x["message"], x["labels"]) for x in lines.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])

    good = lines.groupBy("request").agg(F.collect_list("line").alias("lines")).select("lines").mapInArrow(encode, "body binary")
    bad = spark.createDataFrame([(bytearray(x),) for x in (b"", b"\xff\xff\xff\xff\x0f", b"\x02\x04\x08\x01", b"\x04\x0c\x0a\x02\x08\x01", b"\x03abc")], "body binary")
    return _decoded(W.loki_protobuf(good.unionAll(bad)))


@query("otlp_json_decode", "SELECT timestamp_ns, message, level, path, event_id::VARCHAR AS attempt, '{\"a\":1}' AS nested, 'true' AS sampled, '00ff' AS raw FROM logs")
def _(spark, d):
    value = lambda kind, x: F.struct(x.alias(kind))
    attributes = F.concat(
        F.lit('[{"key":"path","value":{"stringValue":"'), F.col("fields")["path"], F.lit('"}},{"key":"attempt","value":{"intValue":"'), F.conv(F.substring("doc_id", 17, 16), 16, 10),
        F.lit('"}},{"key":"nested","value":{"kvlistValue":{"values":{"a":1}}}},{"key":"sampled","value":{"boolValue":true}},{"key":"raw","value":{"bytesValue":"AP8="}},{"key":"none"}]'),
    )
    record = F.concat(F.lit('{"timeUnixNano":"'), F.col("timestamp_ns").cast("string"), F.lit('","severityText":"'), F.upper(F.col("fields")["level"]), F.lit('","body":'), F.to_json(value("stringValue", F.col("message"))), F.lit(',"attributes":'), attributes, F.lit("}"))
    b = _bodies(spark, d, record).groupBy("request").agg(F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":['), F.array_join(F.collect_list("line"), ","), F.lit("]}]}]}")).alias("body"))
    rows = W.otlp_json(b.select("body").unionAll(spark.createDataFrame([("{",), ("[]",), (None,)], "body string")))
    return rows.select("timestamp_ns", "message", *[F.col("fields")[k].alias(k) for k in ("level", "path", "attempt", "nested", "sampled", "raw")])


query("es_import_lossy", _DEC)(lambda spark, d: _decoded(W.es_import(_bodies(spark, d, _doc()).select(F.col("line").alias("doc")), FIELDS)))
query("es_import_preserve", "SELECT timestamp_ns, message, level, '{\"path\":\"' || path || '\",\"skipped\":[1]}' AS meta FROM logs")(
    lambda spark, d: W.es_import(_bodies(spark, d, _doc()).select(F.col("line").alias("doc")), ("level",), True).select("timestamp_ns", "message", F.col("fields")["level"].alias("level"), F.col("fields")["_meta"].alias("meta"))
)
query("syslog_decode", "SELECT timestamp_ns, message, '13' AS facility, 'notice' AS level, 'app' AS app_name, true AS no_procid FROM logs")(
    lambda spark, d: W.syslog(_bodies(spark, d, F.concat(F.lit("<109>1 "), _iso(), F.lit(' host app - ID [a x="]"][b y="2"] '), F.col("message"))).select("line")).select(
        "timestamp_ns", "message", *[F.col("fields")[k].alias(k) for k in ("facility", "level", "app_name")], F.col("fields")["procid"].isNull().alias("no_procid"))
)


@query("otlp_flatten", "SELECT timestamp_ns, message, level, path, 'checkout' AS service FROM logs")
def _(spark, d):
    own = F.array(F.struct(F.lit("path").alias("key"), F.col("fields")["path"].alias("value")))
    ns = F.col("timestamp_ns").cast("decimal(20,0)")
    record = F.struct(F.lit(0).cast("decimal(20,0)").alias("time_unix_nano"), ns.alias("observed_time_unix_nano"), F.lit(0).alias("severity_number"), F.upper(F.col("fields")["level"]).alias("severity_text"), F.col("message").alias("body"), own.alias("attributes"), F.lit("").alias("trace_id"), F.lit("").alias("span_id"))
    attributes = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("service", "checkout"), ("path", "low"))])
    b = _bodies(spark, d, record).groupBy("request").agg(F.array(F.struct(F.struct(attributes.alias("attributes")).alias("resource"), F.array(F.struct(F.collect_list("line").alias("log_records"))).alias("scope_logs"))).alias("resource_logs"))
    rows = W.otlp(b)
    return rows.select("timestamp_ns", "message", *[F.col("fields")[k].alias(k) for k in ("level", "path", "service")])


# the life of stored rows
_NOW = T0 + 20 * DAY
_simple("ttl_live_rows", lambda x: K.live(K.expire(x, 7 * DAY), _NOW).select(*COLS), f"{SEL}timestamp_ns + {7 * DAY} > {_NOW}")


@query("compaction_survivors", f"""SELECT (timestamp_ns + {7 * DAY}) // {DAY} AS death_bucket, count(*) AS n, 1 AS rewritten FROM logs
WHERE timestamp_ns + {7 * DAY} > {_NOW + DAY // 2} GROUP BY 1""")
def _(spark, d):
    path = K.work_folder(spark)
    K.write_cohorts(K.expire(events_as_logs(spark, d), 7 * DAY), path)
    done = K.compact(spark, path, _NOW + DAY // 2)
    stored_rows = spark.read.parquet(path).groupBy(F.col("death_bucket").cast("long").alias("death_bucket")).agg(F.count("*").alias("n"))
    return stored_rows.withColumn("rewritten", F.lit(done["rewritten"]))


def _archived(spark: SparkSession, d: str) -> tuple[str, DataFrame, DataFrame]:
    root, first = K.work_folder(spark), T0 // DAY
    K.append(events_as_logs(spark, d).select(*COLS, "f_level"), f"{root}/local")
    for _ in range(2):  # the second time changes nothing
        K.archive(spark, f"{root}/local", f"{root}/archive", f"{root}/manifest", first, T0)
    return f"{root}/local", *(spark.read.parquet(f"{root}/{x}") for x in ("archive", "manifest"))


@query("archive_union_read", f"{SEL}timestamp_ns < {T0 + 2 * DAY}")
def _(spark, d):
    local, archived, manifest = _archived(spark, d)
    return K.read_through(spark.read.parquet(local), archived, manifest, T0, T0 + 2 * DAY).select(*COLS)


@query("prune_then_read", f"SELECT count(*) FILTER (timestamp_ns >= {T0 + DAY}) AS local_rows, count(*) AS all_rows, 1 AS pruned FROM logs")
def _(spark, d):
    local, archived, manifest = _archived(spark, d)
    pruned = K.prune(spark, local, archived, manifest, T0 + 100, 50)
    left = spark.read.parquet(local)
    whole = K.read_through(left, archived, manifest, T0, T0 + 400 * DAY).agg(F.count("*").alias("all_rows"))
    return whole.crossJoin(F.broadcast(left.agg(F.count("*").alias("local_rows")))).withColumn("pruned", F.lit(pruned))


@query("commit_counts", "SELECT count(*) AS records, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM logs")
def _(spark, d):
    counted = K.commit(events_as_logs(spark, d).select(*COLS), K.work_folder(spark))
    return spark.createDataFrame([tuple(counted[k] for k in ("records", "first_ns", "last_ns"))], "records long, first_ns long, last_ns long")


def _minutes(spark: SparkSession, d: str, kind: str, field: str) -> DataFrame:
    from loglake.streaming.ingest import minute_rollup, read_minutes, write_minutes

    root = K.work_folder(spark)
    events_as_logs(spark, d).select("timestamp_ns", f"f_{field}").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(f"timestamp_ns long, f_{field} string").parquet(f"{root}/in")
    write_minutes(minute_rollup(stream, field, kind), f"{root}/out", f"{root}/state").awaitTermination()
    return read_minutes(spark, f"{root}/out")


query("stream_rollup_minute", f"SELECT epoch_us({_TR['minute']}) AS bucket_us, level AS value, count(*) AS cnt FROM logs GROUP BY ALL")(
    lambda spark, d: _minutes(spark, d, "exact", "level").select(F.unix_micros("bucket_start").alias("bucket_us"), "value", "cnt")
)
query("stream_ddsketch_minute", f"SELECT epoch_us({_TR['minute']}) AS bucket_us, {_BIN} AS bin, count(*) AS cnt FROM (SELECT timestamp_ns, latency_ms::DOUBLE AS v FROM logs) GROUP BY ALL")(
    lambda spark, d: _minutes(spark, d, "ddsketch", "latency_ms").select(F.unix_micros("bucket_start").alias("bucket_us"), "bin", "cnt")
)
query("stream_topk_minute", "SELECT path AS value, count(*) AS cnt FROM logs GROUP BY 1")(lambda spark, d: R.approximate_top_k(_minutes(spark, d, "topk", "path"), 100))


@query("stream_cardinality_minute", "SELECT count(DISTINCT trace_id) AS exact, true AS within FROM logs")
def _(spark, d):
    exact = events_as_logs(spark, d).agg(F.countDistinct("f_trace_id").alias("exact"))
    estimate = R.cardinality(_minutes(spark, d, "hll", "trace_id"))
    return exact.crossJoin(F.broadcast(estimate)).select("exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("within"))


@query("stream_ingest", "SELECT timestamp_ns, message, level FROM logs")
def _(spark, d):
    from loglake.streaming.ingest import write_logs

    root = K.work_folder(spark)
    events_as_logs(spark, d).select("timestamp_ns", "message", "fields").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("timestamp_ns long, message string, fields map<string,string>").parquet(f"{root}/in")
    write_logs(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("timestamp_ns", "message", F.col("f_level").alias("level"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error templates of a day against the day before, beside the hour tier's p99 latency of that day."""
    logs = events_as_logs(spark, sf_dir)
    tables = {("hour", "ddsketch"): rollup(spark, sf_dir, "ddsketch", "latency_ms", "hour")}
    p99 = R.aggregate(tables, "latency_ms", DAY5, DAY6, "quantile", q=0.99).withColumnRenamed("value", "p99_latency_ms")
    counts = logs.filter((F.col("timestamp_ns") >= DAY5 - DAY) & (F.col("timestamp_ns") < DAY6)).groupBy("template_sig").agg(
        F.count(F.when(F.col("timestamp_ns") >= DAY5, 1)).alias("today"), F.count(F.when(F.col("timestamp_ns") < DAY5, 1)).alias("day_before")
    )
    return counts.crossJoin(F.broadcast(p99)).orderBy(F.desc("today"), "template_sig")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
