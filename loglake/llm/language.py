"""Language identification by compression.

Each language gets a zstandard raw-content dictionary of its own texts. A text is lower-cased and compressed whole with each;
the smallest output names the language, and the margin to the second is the score. Narrow margins are rejected.

The texts to learn from are cut into segments of SEGMENT characters; all segments of all different texts of a language
take part alike, and the DICTIONARY_BYTES / SEGMENT of least hash make its dictionary.

Defined cases: a null text, an empty one and one without a letter (Unicode category L) are ``und`` with score 0; without
any language to learn everything is ``und``; ties go to the language that comes first by code point; a null doc_id is
held out; repeated rows each get a row and teach once; an empty table gives no rows; other columns are ignored. More than
MOST_LANGUAGES languages are an error: the dictionaries are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.llm.common import fold, table

FOLDS = 5
DICTIONARY_BYTES = 64 << 10  # of each language's dictionary
SEGMENT = 1024  # characters
MOST_LANGUAGES = 1000
MARGIN = 0.02
LEVEL = 12  # from here on the compressor weighs matches against each other, and the sizes of short texts differ clearly
LETTER = r"\p{L}"


def learn(docs: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, segment: int = SEGMENT) -> dict[str, bytes]:
    """A dictionary for each language, of segments that a hash chooses from the different texts outside fold 0."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    n = F.ceil(F.length("text") / segment)
    # copies count once here, so that a language of many copies still fills its dictionary
    different = known.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first(n).alias("n"))
    sizes = different.groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    wanted = max(1, dictionary_bytes // segment)
    # twice as many as wanted are expected under this bound, of 2^30: what is ranked below is small whatever the rows are
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 30, 1 + (wanted << 31) // r["n"])) for r in sizes], "lang string, bound long")
    places = known.join(F.broadcast(bounds), "lang").select("lang", "text", "bound", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("i"))
    chosen = places.withColumn("h", F.pmod(F.xxhash64("text", "i"), F.lit(1 << 30))).filter("h < bound")
    chosen = chosen.select("lang", "h", F.lower(F.substring("text", F.col("i") * segment + 1, segment)).alias("text")).distinct()
    order = Window.partitionBy("lang").orderBy("h", "text")
    out: dict[str, list[bytes]] = {}
    for r in chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted).orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return {lang: b"\n".join(texts) for lang, texts in out.items()}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with lang_pred, score (margin to the second-best as a share of it) and rejected (score under ``margin``)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # about DICTIONARY_BYTES for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = []
        for lang, content in sorted(shared.value.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append((lang, zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False)))
        for b in batches:
            names, scores = [], []
            for t, letters in zip(b["__text"], b["__letters"].to_pylist()):
                text = t.as_py()
                if not packers or not letters:
                    names.append("und")
                    scores.append(0.0)
                    continue
                raw = text.lower().encode()
                sizes = sorted((len(c.compress(raw)), lang) for lang, c in packers)
                second = sizes[1][0] if len(sizes) > 1 else max(len(raw), sizes[0][0])
                names.append(sizes[0][1])
                scores.append((second - sizes[0][0]) / second)
            low = [s < margin for s in scores]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(low, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("__text"), F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("__letters")).mapInArrow(run, f"{out}, lang_pred string, score double, rejected boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, learn(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score", "rejected")
