"""Column expressions that every log operator shares. Time is a LONG of epoch nanoseconds throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LONG = -(1 << 63)
FIELDS = ("level", "status", "trace_id", "latency_ms", "path")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


class BadRequest(ValueError):
    """The request's parameters can't be used."""


class NotFound(LookupError):
    """No data answers the request."""


def hex_long(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def doc_id(timestamp_ns: Column, suffix: Column) -> Column:
    """Hex text that sorts as time does, negative times first; ``suffix`` tells rows of one time apart."""
    return F.concat(hex_long(timestamp_ns.bitwiseXOR(F.lit(MIN_LONG))), hex_long(suffix))


def bucket(timestamp_ns: Column, width_ns: int) -> Column:
    return timestamp_ns - F.pmod(timestamp_ns, F.lit(width_ns))


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_signature(message: Column) -> Column:
    """Tokens of Unicode white space: 8 or more hex digits, then any digit, then ASCII lower case.

    The text is rewritten whole, in few passes of generated code; tokens are never made an array.
    """
    text = F.regexp_replace(lower_ascii(message), r"(?U)(?<!\S)[0-9a-f]{8,}+(?!\S)", "<HEX>")
    text = F.regexp_replace(text, r"(?U)(?<!\S)[^\s0-9]*+[0-9]\S*+", "<NUM>")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stream_key(fields: Column) -> Column:
    """Canonical text of a map: maps have no equality, their sorted entries do."""
    return F.to_json(F.array_sort(F.map_entries(fields)))


def rfc3339_ns(text: Column) -> Column:
    """Epoch nanoseconds, or null; digits 7 to 9 of the fraction are read apart, as timestamps hold microseconds."""
    micros = F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))
    rest = F.rpad(F.regexp_extract(text, r"\.\d{6}(\d{1,3})", 1), 3, "0").cast("long")
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), micros * 1000 + rest)


def number(text: Column) -> Column:
    """A finite double from text without blanks or type suffixes, or null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def allow(fields: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*names))


def normalize(wire: DataFrame, fields: tuple[str, ...] = FIELDS, preserve: bool = False, suffix: Column | None = None) -> DataFrame:
    """Wire records (timestamp_ns, message, fields) to log records: allowed fields, template, key, and a column f_<name> for each field."""
    names = (*fields, "_meta") if preserve else fields
    rows = wire.withColumn("fields", allow(F.col("fields"), names))
    # where a row comes from tells equal rows apart, and a task that is run again gives the same keys (in a stream the
    # file must do for that: there rows have no numbers)
    place = (F.input_file_name(), *(() if wire.isStreaming else (F.monotonically_increasing_id(),)))
    tail = suffix if suffix is not None else F.xxhash64("timestamp_ns", "message", stream_key(F.col("fields")), *place)
    sig = template_signature(F.col("message"))
    return rows.select(
        "timestamp_ns", "message", "fields", doc_id(F.col("timestamp_ns"), tail).alias("doc_id"), sig.alias("template_sig"), F.xxhash64(sig).alias("template_id"),
        stream_key(F.col("fields")).alias("stream_key"), *[F.col("fields")[n].alias(f"f_{n}") for n in fields],
    )


def bounded_message(message: Column, most: int = 240) -> Column:
    return F.when(F.char_length(message) > most, F.concat(F.substring(message, 1, most), F.lit("…"))).otherwise(message)


def cosine_distance(a: Column, b: Column, length: Column | None = None) -> Column:
    """Null if either is zero. ``length`` is that of ``b``, where it is known: it isn't worked out for each row then."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * (F.sqrt(dot(b, b)) if length is None else length))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
