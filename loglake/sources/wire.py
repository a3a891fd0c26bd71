"""Decoders of the ingest formats: DataFrames of bodies to wire records (timestamp_ns, message, fields)."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.core import rfc3339_ns

WIRE = "timestamp_ns bigint, message string, fields map<string,string>"
NATIVE_LIMIT = 16 << 20
SNAPPY_LIMIT = 64 << 20
BATCH_ROWS = 10_000
EMPTY = "map<string,string>"


def now_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * 1000


def native(bodies: DataFrame) -> DataFrame:
    """body: a JSON array of records. Larger bodies than the frame limit are refused (no rows)."""
    rows = bodies.filter(F.octet_length("body") <= NATIVE_LIMIT).select(F.explode(F.from_json("body", f"array<struct<{WIRE.replace(' bigint', ':bigint').replace(' string', ':string').replace(' map', ':map')}>>")).alias("r")).select("r.*")
    return rows.filter("timestamp_ns is not null and message is not null").withColumn("fields", F.coalesce("fields", F.create_map().cast(EMPTY)))


def loki_json(bodies: DataFrame) -> DataFrame:
    """body: streams of labels and [ns, line] pairs. A body with a bad time or pair gives no rows at all."""
    parsed = bodies.select(F.from_json("body", "streams array<struct<stream:map<string,string>,values:array<array<string>>>>").alias("b"))
    fine = F.forall("b.streams", lambda s: F.forall(s["values"], lambda v: (F.size(v) == 2) & F.get(v, F.lit(0)).try_cast("long").isNotNull()))
    lines = parsed.filter(F.coalesce(fine, F.lit(False))).select(F.explode("b.streams").alias("s")).select("s.stream", F.explode("s.values").alias("v"))
    return lines.select(F.col("v")[0].cast("long").alias("timestamp_ns"), F.col("v")[1].alias("message"), F.coalesce("stream", F.create_map().cast(EMPTY)).alias("fields"))


def unsnappy(data: bytes, limit: int = SNAPPY_LIMIT) -> bytes:
    """Raw snappy block; a claimed size above ``limit`` is refused before anything is allocated."""
    size, _ = varint(data, 0)
    if size > limit:
        raise ValueError("the claimed size is above the limit")
    return pa.decompress(data, size, "snappy", asbytes=True) if size else b""


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Protocol-buffer fields: number, and an int or bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + n], "little"), at + n
        if at > len(data):
            raise ValueError("cut off inside a field")
        yield number, value


def _parts(data: bytes, kinds: dict[int, type]) -> list[tuple[int, int | bytes]]:
    """The fields that ``kinds`` names; one of another type is an error."""
    found = [(n, v) for n, v in wire_fields(data) if n in kinds]
    if not all(isinstance(v, kinds[n]) for n, v in found):
        raise ValueError("a field of another type")
    return found


def _push_request(body: bytes) -> list[tuple[int, str, list[tuple[str, str]]]]:
    from loglake.plans.logql import parse_labels

    out, top = [], (1 << 63) - 1
    signed = lambda x: x - (1 << 64) if x > top else x
    for _, stream in _parts(unsnappy(body), {1: bytes}):
        parts = _parts(stream, {1: bytes, 2: bytes})
        labels = list(parse_labels(next((v.decode() for n, v in parts if n == 1), "{}")).items())
        for n, entry in parts:
            if n == 2:
                e = dict(_parts(entry, {1: bytes, 2: bytes}))
                when = dict(_parts(e.get(1, b""), {1: int, 2: int}))
                ns = signed(when.get(1, 0)) * 1_000_000_000 + signed(when.get(2, 0))
                out.append((min(max(ns, -top - 1), top), e.get(2, b"").decode(), labels))
    return out


def push_request(lines: list[tuple[int, str, str]]) -> bytes:
    """A push request of (time, line, labels): a stream for each run of equal labels."""

    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    field = lambda n, data: number(n << 3 | 2) + number(len(data)) + data
    when = lambda ns: b"\x08" + number(ns // 1_000_000_000 % (1 << 64)) + b"\x10" + number(ns % 1_000_000_000)
    streams = []
    for labels, own in itertools.groupby(lines, lambda x: x[2]):
        streams.append(field(1, field(1, labels.encode()) + b"".join(field(2, field(1, when(ns)) + field(2, text.encode())) for ns, text, _ in own)))
    return pa.compress(b"".join(streams), "snappy", asbytes=True)


def _wire_batch(rows: list[tuple[int, str, list[tuple[str, str]]]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.map_(pa.string(), pa.string()))], ["timestamp_ns", "message", "fields"])


def loki_protobuf(bodies: DataFrame) -> DataFrame:
    """body: binary push requests; a body that can't be read gives no rows. Records leave in batches of about BATCH_ROWS, however many bodies come at once."""

    def run(batches):
        for b in batches:
            rows = []
            for body in b["body"]:
                try:
                    rows += _push_request(body.as_py() or b"\0")
                except (ValueError, IndexError, OSError):  # pyarrow's errors are ValueError and OSError
                    continue
                if len(rows) >= BATCH_ROWS:
                    yield _wire_batch(rows)
                    rows = []
            yield _wire_batch(rows)

    return bodies.select("body").mapInArrow(run, WIRE)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _json_object(line: str) -> tuple[dict, str]:
    """The line's object, and its text, in which every key is there once (the last one holds)."""
    repeated = []

    def once(pairs: list[tuple[str, object]]) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            repeated.append(True)
        return found

    found = json.loads(line, object_pairs_hook=once, parse_constant=_refuse)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    text = json.dumps(found, ensure_ascii=False, separators=(",", ":")) if repeated else line.strip()
    text.encode()  # halves of surrogate pairs are refused here
    return found, text


def es_bulk(bodies: DataFrame) -> DataFrame:
    """body: action and document lines. Lines pair up in order, so a body is read as one; lines before a bad one stay."""

    def run(batches):
        for b in batches:
            docs = []
            for body in b["body"]:
                lines = iter([x for x in (body.as_py() or "").split("\n") if x.strip()])
                try:
                    for line in lines:
                        if "delete" not in _json_object(line)[0]:
                            docs.append(_json_object(next(lines))[1])
                except (ValueError, RecursionError, StopIteration):
                    pass
                if len(docs) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string())], ["doc"])
                    docs = []
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string())], ["doc"])

    return es_documents(bodies.select("body").mapInArrow(run, "doc string"))


def _parsed(docs: DataFrame) -> DataFrame:
    """doc with its JSON value, and that value's members as a map (null if it is no object or no JSON)."""
    return docs.select("doc", F.try_parse_json("doc").alias("v")).withColumn("m", F.expr("try_cast(v AS map<string,variant>)"))


def _kind(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x), F.lit("VOID"))


def _text_of(members: Column, key: str) -> Column:
    """A member that is text, or null."""
    x = F.element_at(members, key)
    return F.when(_kind(x) == "STRING", x.cast("string"))


def es_documents(docs: DataFrame) -> DataFrame:
    """doc: a JSON object. Scalars become fields; the message is ``message``, else ``msg``, if a string, else the whole document."""
    m, rows = F.col("m"), _parsed(docs)
    own = F.when(F.map_contains_key(m, "message"), _text_of(m, "message")).otherwise(_text_of(m, "msg"))
    when = F.coalesce(rfc3339_ns(_text_of(m, "@timestamp")), now_ns())
    scalars = F.map_filter(m, lambda k, x: ~k.isin("message", "msg", "@timestamp") & ~_kind(x).rlike("^(ARRAY|OBJECT|VOID)"))
    fields = F.coalesce(F.transform_values(scalars, lambda _, x: x.cast("string")), F.create_map().cast(EMPTY))
    return rows.select(when.alias("timestamp_ns"), F.coalesce(own, F.to_json("v"), "doc").alias("message"), fields.alias("fields"))


def es_import(docs: DataFrame, fields: tuple[str, ...], preserve: bool = False) -> DataFrame:
    """doc: exported ``_source`` objects. Times are RFC 3339 texts or numbers of epoch milliseconds; other values than text keep their JSON form; with ``preserve`` the rest, if any, goes to ``_meta`` as JSON."""
    m, rows = F.coalesce("m", F.create_map().cast("map<string,variant>")), _parsed(docs)
    at = F.element_at(m, "@timestamp")
    millis = F.when(_kind(at) == "BIGINT", at.try_cast("long"))
    when = F.coalesce(rfc3339_ns(_text_of(m, "@timestamp")), F.try_multiply(millis, F.lit(1_000_000)), now_ns())
    inner = F.element_at(m, "log").try_cast("map<string,variant>")
    message = F.coalesce(_text_of(m, "message"), _text_of(inner, "message"), F.lit(""))
    kept = F.transform_values(F.map_filter(m, lambda k, _: k.isin(*fields)), lambda _, x: F.when(_kind(x) == "STRING", x.cast("string")).otherwise(F.to_json(x)))
    rest = F.map_filter(m, lambda k, _: ~k.isin(*fields, "@timestamp", "message"))
    with_meta = F.when(F.size(F.map_keys(rest)) > 0, F.map_concat(kept, F.create_map(F.lit("_meta"), F.to_json(rest)))).otherwise(kept)
    return rows.select(when.alias("timestamp_ns"), message.alias("message"), (with_meta if preserve else kept).alias("fields"))


# Names of the severities 0 to 7, as logs name them.
LEVELS = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
_HEAD = r"^<(\d{1,3})>\d{1,2} (\S+) (\S+) (\S+) (\S+) (\S+) (?s)(.*)$"
_DATA = r'^(?:-|(?:\[(?:[^"\]\\]|"(?:\\.|[^"\\])*")*\])+)(?: |$)'


def syslog(lines: DataFrame) -> DataFrame:
    """line: RFC 5424 messages; all adjacent structured data is skipped, and a line that isn't one is kept raw."""
    trimmed = F.regexp_replace("line", r"[\r\n]+\z", "")
    part = lambda k: F.regexp_extract(trimmed, _HEAD, k)
    pri = part(1).try_cast("int")
    fine = trimmed.rlike(_HEAD) & (pri <= 191) & part(7).rlike(_DATA)
    message = F.regexp_replace(F.regexp_replace(part(7), _DATA, ""), "^\ufeff", "")
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.pmod(pri, F.lit(8)) + 1)
    entries = F.array(
        F.struct(F.lit("facility").alias("key"), F.floor(pri / 8).cast("string").alias("value")), F.struct(F.lit("severity").alias("key"), F.pmod(pri, F.lit(8)).cast("string").alias("value")),
        F.struct(F.lit("level").alias("key"), level.alias("value")), *[F.struct(F.lit(k).alias("key"), part(i).alias("value")) for k, i in (("hostname", 3), ("app_name", 4), ("procid", 5), ("msgid", 6))],
    )
    fields = F.when(fine, F.map_from_entries(F.filter(entries, lambda e: e["value"] != "-"))).otherwise(F.create_map().cast(EMPTY))
    when = F.coalesce(F.when(fine, rfc3339_ns(part(2))), now_ns())
    rows = lines.filter(F.length(F.trim("line")) > 0)
    return rows.select(when.alias("timestamp_ns"), F.when(fine, message).otherwise(trimmed).alias("message"), fields.alias("fields"))


OTLP = (
    "resource_logs array<struct<resource:struct<attributes:array<struct<key:string,value:string>>>,scope_logs:array<struct<log_records:array<struct<"
    "time_unix_nano:decimal(20,0),observed_time_unix_nano:decimal(20,0),severity_number:int,severity_text:string,body:string,attributes:array<struct<key:string,value:string>>,trace_id:string,span_id:string>>>>>>"
)


def any_value(json_text: Column) -> Column:
    """An OTLP value, as JSON, to text: containers keep their JSON form, bytes are hex digits; null where no kind is set."""
    of = lambda kind: F.get_json_object(json_text, f"$.{kind}")
    scalars = [of(k) for k in ("stringValue", "boolValue", "intValue", "doubleValue")]
    return F.coalesce(*scalars, F.lower(F.hex(F.try_to_binary(of("bytesValue"), F.lit("base64")))), of("arrayValue.values"), of("kvlistValue.values"))


_JSON_VALUES = "array<struct<key:string,value:string>>"
OTLP_JSON = (
    f"resourceLogs array<struct<resource:struct<attributes:{_JSON_VALUES}>,scopeLogs:array<struct<logRecords:array<struct<"
    f"timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:string,attributes:{_JSON_VALUES},traceId:string,spanId:string>>>>>>"
)


def otlp_json(bodies: DataFrame) -> DataFrame:
    """body: log export requests in OTLP's JSON form; a body that isn't JSON gives no rows, an attribute without a value no field."""
    none = lambda of: F.coalesce(of, F.array().cast("array<struct<key:string,value:string>>"))
    values = lambda of: F.transform(F.filter(none(of), lambda a: a["value"].isNotNull()), lambda a: F.struct(a["key"].alias("key"), F.coalesce(any_value(a["value"]), F.lit("")).alias("value")))
    ns = lambda x: x.try_cast("decimal(20,0)")
    record = lambda r: F.struct(
        ns(r["timeUnixNano"]).alias("time_unix_nano"), ns(r["observedTimeUnixNano"]).alias("observed_time_unix_nano"), r["severityNumber"].alias("severity_number"), r["severityText"].alias("severity_text"),
        any_value(r["body"]).alias("body"), values(r["attributes"]).alias("attributes"), r["traceId"].alias("trace_id"), r["spanId"].alias("span_id"),
    )
    scope = lambda x: F.struct(F.transform(x["logRecords"], record).alias("log_records"))
    resource = lambda r: F.struct(F.struct(values(r["resource"]["attributes"]).alias("attributes")).alias("resource"), F.transform(r["scopeLogs"], scope).alias("scope_logs"))
    parsed = bodies.select(F.from_json("body", OTLP_JSON).alias("b"))
    return otlp(parsed.select(F.transform("b.resourceLogs", resource).alias("resource_logs")))


def otlp(requests: DataFrame) -> DataFrame:
    """Log requests (structs of OTLP; values are text already) to records; of equal names the innermost holds."""
    r = requests.select(F.explode("resource_logs").alias("r")).select("r.resource", F.explode("r.scope_logs").alias("s")).select("resource", F.explode("s.log_records").alias("l"))
    usable = lambda c: F.when((F.col(c) > 0) & (F.col(c) <= (1 << 63) - 1), F.col(c).try_cast("long"))
    own = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    number = F.when(F.col("l.severity_number") != 0, F.col("l.severity_number").cast("string"))
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.concat(F.coalesce("resource.attributes", none), F.coalesce("l.attributes", none), F.array(own("severity_number", number), own("level", F.lower(text("l.severity_text"))), own("trace_id", F.lower(text("l.trace_id"))), own("span_id", F.lower(text("l.span_id")))))
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return r.select(F.coalesce(usable("l.time_unix_nano"), usable("l.observed_time_unix_nano"), now_ns()).alias("timestamp_ns"), F.coalesce("l.body", F.lit("")).alias("message"), F.map_from_entries(last).alias("fields"))
