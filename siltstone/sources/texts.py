"""Corpora of plain text files, and texts of files of several formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Limits of a corpus.
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 10_000, 64 << 20, 512 << 20


def list_text_files(spark: SparkSession, paths: list[str], recursive: bool = True, max_files: int | None = MAX_FILES, max_file: int | None = MAX_FILE_BYTES, max_total: int | None = MAX_TOTAL_BYTES) -> DataFrame:
    """(source, modified, bytes) of the .txt files, in any case of the suffix, below folders or named themselves; each file once.

    Nothing is read but the listing.  No path, no file, or more than a limit allows is an error; a limit of None is none.  Symbolic
    links aren't told apart by the file systems that Spark reads: keep them out of the folders.
    """
    if not paths:
        raise ValueError("a corpus needs a path")
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[tT][xX][tT]").load(p) for p in paths]
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    files = files.select(F.col("path").alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).dropDuplicates(["source"])
    found = files.agg(F.count("*").alias("n"), F.max_by("source", "bytes").alias("path"), F.max("bytes").alias("most"), F.sum("bytes").alias("all")).first()
    for value, limit, what in ((found.n, max_files, "files"), (found.most, max_file, f"bytes in {found.path}"), (found["all"], max_total, "bytes")):
        if limit is not None and (value or 0) > limit:
            raise ValueError(f"the corpus has {value} {what}; the limit is {limit}")
    if not found.n:
        raise ValueError("no .txt file found")
    return files


def read_text_corpus(spark: SparkSession, path: str | list[str], recursive: bool = True, **limits) -> DataFrame:
    """(source, sha256, bytes, text) of the files of ``list_text_files``.

    Read by Spark's own reader, whole file by whole file; a text that isn't valid UTF-8 fails and names its file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    list_text_files(spark, paths, recursive, **limits)
    read = [spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[tT][xX][tT]").load(p) for p in paths]
    files = read[0]
    for r in read[1:]:
        files = files.unionByName(r)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    checked = F.when(text.isNull(), F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path")))).otherwise(text)
    files = files.dropDuplicates(["path"]) if len(paths) > 1 else files
    return files.select(F.col("path").alias("source"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), checked.cast("string").alias("text"))


def changed_files(spark: SparkSession, manifest: DataFrame, path: str | list[str], recursive: bool = True) -> DataFrame:
    """(source, change) of files that are new, gone or have another hash than in ``manifest(source, sha256)``."""
    now = read_text_corpus(spark, path, recursive, max_files=None, max_file=None, max_total=None).select("source", F.col("sha256").alias("now"))
    both = manifest.select("source", F.col("sha256").alias("then")).join(now, "source", "full")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("then") != F.col("now"), "changed")
    return both.select("source", change.alias("change")).where("change is not null")


class _Strings(HTMLParser):
    """The stripped strings of a page, without scripts and styles."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []
        self.off = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.off = max(0, self.off - (tag in ("script", "style")))

    def handle_data(self, data: str) -> None:
        if not self.off and data.strip():
            self.found.append(data.strip())


def page_strings(page: str) -> list[str]:
    reader = _Strings()
    reader.feed(page)
    reader.close()
    return reader.found


@F.arrow_udf(ArrayType(StringType()))
def _page_strings(column: pa.Array) -> pa.Array:
    return pa.array([page_strings(p or "") for p in column.to_pylist()], pa.list_(pa.string()))


def page_text(html: Column, strong: bool = False) -> Column:
    """A page's strings on lines; ``strong`` keeps those that hold a letter and a space behind it."""
    found = _page_strings(html)
    return F.array_join(F.filter(found, lambda x: x.rlike("[A-Za-z] ")) if strong else found, "\n")


def _plain(content: bytes) -> str:
    return content.decode("utf-8")


def _page(content: bytes) -> str:
    text = content.decode("utf-8", "strict")
    return "\n".join(page_strings(text)) if "<html" in text[:2000].lower() else ""


#: Readers of file contents, tried in order; one that fails or finds nothing leaves the file to the next.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"html": _page, "text": _plain}


def extract_texts(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, format, text) of files (path, content): the first extractor with a text that isn't blank; else format null and text ''.

    Readers of other formats are registered by the caller, as their libraries aren't a part of this one.
    """
    tried = dict(extractors or EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str]] = []
            for content in batch.column(1).to_pylist():
                found: tuple[str | None, str] = (None, "")
                for name, read in tried.items():
                    try:
                        text = read(content or b"")
                    except Exception:  # noqa: BLE001, S112  a reader that fails says nothing; the next one is asked
                        continue
                    if text.strip():
                        found = (name, text)
                        break
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], names=["path", "format", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, format string, text string")


def cells_as_text(rows: DataFrame, row: str) -> DataFrame:
    """One text of a table's cells, column by column and in each in order of ``row``; empty cells are left out.

    Lines of a column are gathered in one row: it's for sheets, not for tables.
    """
    names = [c for c in rows.columns if c != row]
    cells = rows.select(F.col(row).alias("_r"), F.posexplode(F.array(*(F.col(c).cast("string") for c in names))).alias("_c", "_v")).where("_v is not null")
    return cells.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_r", "_v"))), lambda x: x["_v"]), "\n").alias("text"))
