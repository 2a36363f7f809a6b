"""Readers and writers of structured files: datasets, histories, evaluation logs, model headers, picture metadata, file catalogues."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from siltstone.functions.text import natural_key
from siltstone.operators.ranks import sorted_table
from siltstone.sources.shared import Workspace


def dataset_kind(schema: StructType) -> str:
    """``chat`` for rows with messages or conversations, ``text`` for rows with a text; anything else is an error."""
    names = set(schema.names)
    if names & {"messages", "conversations"}:
        return "chat"
    if "text" in names:
        return "text"
    raise ValueError(f"rows need messages, conversations or text; there are {sorted(names)}")


def read_dataset(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The kind and rows of JSON files, each an array of objects."""
    rows = spark.read.option("multiLine", True).json(path)
    return dataset_kind(rows.schema), rows


_PAIR = "array<array<string>>"


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """(path, turn, user, assistant, visible_user, visible_assistant, metadata) of chat histories, one JSON file each.

    Old files name their parts data and data_visible.  Files without metadata get empty times for their messages, but for the
    mark of a greeting.
    """
    schema = f"internal {_PAIR}, visible {_PAIR}, data {_PAIR}, data_visible {_PAIR}, metadata map<string,struct<timestamp:string>>"
    files = spark.read.option("multiLine", True).schema(schema).json(path).select(F.col("_metadata.file_path").alias("path"), "*")
    rows = files.select("path", F.coalesce("internal", "data").alias("i"), F.coalesce("visible", "data_visible").alias("v"), F.col("metadata").alias("m"))
    rows = rows.select("path", "v", "m", F.posexplode("i").alias("turn", "p"))
    part = lambda a, k: F.coalesce(F.get(a, F.lit(k)), F.lit(""))
    seen = F.get("v", F.col("turn"))
    out = rows.select("path", "turn", part("p", 0).alias("user"), part("p", 1).alias("assistant"), part(seen, 0).alias("visible_user"), part(seen, 1).alias("visible_assistant"), "m")
    entry = lambda role, there: F.when(there, F.map_from_arrays(F.array(F.concat(F.lit(f"{role}_"), F.col("turn").cast("string"))), F.array(F.struct(F.lit("").alias("timestamp"))))).otherwise(
        F.create_map().cast("map<string,struct<timestamp:string>>")
    )
    made = F.map_concat(entry("user", (F.col("user") != "") & (F.col("user") != "<|BEGIN-VISIBLE-CHAT|>")), entry("assistant", F.col("assistant") != ""))
    own = F.map_filter("m", lambda k, _: F.element_at(F.split(k, "_"), -1) == F.col("turn").cast("string"))
    return out.withColumn("metadata", F.when(F.col("m").isNull(), made).otherwise(own)).drop("m")


def write_histories(turns: DataFrame, path: str, by: str = "conv_id") -> None:
    """Histories (by, turn, user, assistant) as JSON lines, one history a line, in folders by nothing else."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "user", "assistant"))), lambda x: F.array(x.user, x.assistant))
    turns.groupBy(by).agg(pairs.alias("internal")).withColumn("visible", F.col("internal")).write.mode("overwrite").json(path)


#: Columns of the evaluation log; all but the perplexity are text.
EVALUATION = "Model string, LoRAs string, Dataset string, Perplexity string, stride string, max_length string, Date string, Comment string"


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation log in order of dataset, stride (as text), perplexity and date."""
    log = spark.read.schema(EVALUATION).option("header", True).csv(path)
    return log.withColumn("Perplexity", F.col("Perplexity").try_cast("double")).orderBy("Dataset", "stride", "Perplexity", "Date")


def append_evaluations(rows: DataFrame, path: str) -> None:
    """Adds rows to the log; columns go by name."""
    names = [f.split(" ")[0] for f in EVALUATION.split(", ")]
    rows.select(*(F.col(n).cast("string").alias(n) if n in rows.columns else F.lit("").alias(n) for n in names)).write.mode("append").option("header", True).csv(path)


def joined_corpus(rows: DataFrame, order: str, text: str = "text", separator: str = "\n\n") -> DataFrame:
    """All texts in order as one: for the small evaluation corpora that are scored as a single text."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x.t), separator).alias("text"))


#: Formats of the single values of a model header by number; 8 is text, 9 an array.
_VALUES = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
_TEXT, _ARRAY = 8, 9


def model_header(data: bytes) -> dict:
    """Magic number, version, number of tensors and the values of a model file's header; version 1 and cut files are errors."""
    at = 0

    def take(kind: str):
        nonlocal at
        at += struct.calcsize(kind)
        return struct.unpack_from(kind, data, at - struct.calcsize(kind))[0]

    def text() -> str:
        nonlocal at
        size = take("<Q")
        raw = data[at : at + size]
        if len(raw) < size:
            raise ValueError("the header is cut")
        at += size
        return raw.decode("utf-8", "replace")

    def value(kind: int):
        return text() if kind == _TEXT else take(_VALUES[kind])

    magic, version = take("<I"), take("<I")
    if version == 1:
        raise ValueError("version 1 isn't read")
    tensors, n, values = take("<Q"), take("<Q"), {}
    for _ in range(n):
        key, kind = text(), take("<I")
        if kind == _ARRAY:
            inner, size = take("<I"), take("<Q")
            values[key] = [value(inner) for _ in range(size)]
        else:
            values[key] = value(kind)
    return {"magic": magic, "version": version, "tensors": tensors, "values": values}


def read_model_headers(files: DataFrame) -> DataFrame:
    """(path, version, tensors, key, value) of files (path, content): values as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, h["version"], h["tensors"], k, json.dumps(v)) for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for h in (model_header(content),) for k, v in h["values"].items()]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "version", "tensors", "key", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, version int, tensors long, key string, value string")


def picture_text(data: bytes) -> dict[str, str]:
    """The text entries of a PNG file; another file has none."""
    out, at = {}, 8
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return out
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"tEXt":
            key, _, value = body.partition(b"\0")
            out[key.decode("latin-1")] = value.decode("latin-1")
        elif kind == b"iTXt":
            key, _, rest = body.partition(b"\0")
            packed, rest = rest[:1] == b"\1", rest[2:].partition(b"\0")[2].partition(b"\0")[2]
            out[key.decode("latin-1")] = (zlib.decompress(rest) if packed else rest).decode("utf-8")
        elif kind == b"IEND":
            break
        at += size + 12
    return out


def picture_settings(content: Column, key: str = "image_gen_settings") -> Column:
    """The JSON that a picture carries under a key; null where there is none or it isn't JSON."""

    @F.arrow_udf(StringType())
    def read(column: pa.Array) -> pa.Array:
        def one(data: bytes | None) -> str | None:
            try:
                found = picture_text(data or b"").get(key)
                return None if found is None else json.dumps(json.loads(found))
            except (ValueError, zlib.error, struct.error):
                return None

        return pa.array([one(x) for x in column.to_pylist()], pa.string())

    return read(content)


_PARTS = r"^(.+)-(\d+)-of-(\d+)(\.[^.]+)$"


def catalogue(files: DataFrame, suffix: str) -> DataFrame:
    """(name, parts, bytes, place) of files (path, length) with a suffix in any case: parts of one model are one entry under its first
    part's name, in natural order; places come from ranges of that order."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("name"), F.col("length")).where(F.endswith(F.lower("name"), F.lit(suffix.lower())) & ~F.startswith(F.lower("name"), F.lit("mmproj")))
    whole = F.when(F.col("name").rlike(_PARTS), F.regexp_replace("name", _PARTS, "$1$4")).otherwise(F.col("name"))
    one = rows.groupBy(whole.alias("_whole")).agg(F.min_by("name", F.coalesce(F.regexp_extract("name", _PARTS, 2).try_cast("int"), F.lit(0))).alias("name"), F.count("*").alias("parts"), F.sum("length").alias("bytes"))
    ordered = sorted_table(Workspace(files.sparkSession, "catalogue"), one.drop("_whole"), [natural_key(F.col("name")), F.col("name")])
    return ordered.numbered("place").withColumn("place", (F.col("place") + 1).cast("int"))


def sample_rows(rows: DataFrame, path: str, n: int = 10) -> None:
    """The first ``n`` rows as JSON."""
    rows.limit(n).coalesce(1).write.mode("overwrite").json(path)


def without_defaults(settings: Column, defaults: Column) -> Column:
    """The entries of a map that differ from those of ``defaults`` or aren't there."""
    return F.map_filter(settings, lambda k, v: ~v.eqNullSafe(F.try_element_at(defaults, k)))
