"""Headers of model files as a data source: a task for some files each, which reads their heads alone.

    register_headers(spark)
    spark.read.format("model_headers").option("glob", "*.gguf").load("/models")

A row is a key of a header: (path, bytes, version, tensors, key, value), values as JSON.  Files may be of any size; a head is read forward
in pieces of ``piece`` bytes (256 KB by default), up to its last key.  Long arrays are skipped unless ``arrays`` is true: their value is their length.
A filter on ``path`` or ``key`` is taken over: other files aren't opened, and a head is left behind its last wanted key.
"""

from __future__ import annotations

import fnmatch
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Formats of the single values by number; 8 is text, 9 an array.
SINGLE = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
TEXT, ARRAY = 8, 9
MAGIC = 0x46554747


class Head:
    """A file read forward in pieces, with what was read and passed let go."""

    def __init__(self, file, piece: int) -> None:
        self.file, self.piece, self.have, self.at, self.read = file, piece, b"", 0, 0

    def raw(self, n: int) -> bytes:
        while len(self.have) - self.at < n:
            more = self.file.read(max(self.piece, n - len(self.have) + self.at))
            if not more:
                raise ValueError("the header is cut")
            self.read += len(more)
            self.have, self.at = self.have[self.at :] + more, 0
        self.at += n
        return self.have[self.at - n : self.at]

    def skip(self, n: int) -> None:
        """Passes ``n`` bytes, in the file itself where they aren't read yet."""
        there = len(self.have) - self.at
        if n <= there:
            self.at += n
            return
        self.file.seek(n - there, 1)
        self.have, self.at = b"", 0

    def one(self, kind: str):
        return struct.unpack(kind, self.raw(struct.calcsize(kind)))[0]

    def text(self) -> str:
        return self.raw(self.one("<Q")).decode("utf-8", "replace")

    def value(self, kind: int, whole: bool):
        """The value; of an array that isn't asked for ``whole``, its length."""
        if kind == TEXT:
            return self.text()
        if kind != ARRAY:
            return self.one(SINGLE[kind])
        inner, n = self.one("<I"), self.one("<Q")
        if whole:
            return [self.value(inner, True) for _ in range(n)]
        if inner in SINGLE:
            self.skip(n * struct.calcsize(SINGLE[inner]))
        else:
            for _ in range(n):
                self.skip(self.one("<Q")) if inner == TEXT else self.value(inner, False)
        return {"length": n}


def header_rows(file, piece: int, arrays: bool, keys: frozenset[str] | None) -> Iterator[tuple[int, int, str, object]]:
    """(version, tensors, key, value) of the wanted keys; other files, version 1 and cut headers are errors."""
    head = Head(file, piece)
    if head.one("<I") != MAGIC:
        raise ValueError("not a model file")
    version = head.one("<I")
    if version == 1:
        raise ValueError("version 1 isn't read")
    tensors, n, left = head.one("<Q"), head.one("<Q"), None if keys is None else set(keys)
    for _ in range(n):
        key, kind = head.text(), head.one("<I")
        wanted = left is None or key in left
        value = head.value(kind, arrays and wanted)
        if wanted:
            yield version, tensors, key, value
            if left is not None:
                left.discard(key)
                if not left:
                    return


@dataclass
class Files(InputPartition):
    """Some files of one task, with their sizes."""

    files: tuple[tuple[str, int], ...]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*.gguf")
        self.piece, self.arrays = int(options.get("piece", 1 << 18)), options.get("arrays", "false").lower() == "true"
        self.per_task = max(1, int(options.get("filesPerTask", 16)))
        self.paths: frozenset[str] | None = None
        self.keys: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = frozenset([f.value]) if isinstance(f, EqualTo) else frozenset(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("path",), ("key",)):
                yield f
            elif f.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            else:
                self.keys = values if self.keys is None else self.keys & values

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name.lower(), self.glob.lower()))
        files = [x for x in files if self.paths is None or x[0] in self.paths]
        return [Files(tuple(files[i : i + self.per_task])) for i in range(0, len(files), self.per_task)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for path, size in partition.files:
            with system.open_input_file(path) as file:
                try:
                    for version, tensors, key, value in header_rows(file, self.piece, self.arrays, self.keys):
                        yield path, size, version, tensors, key, json.dumps(value)
                except (ValueError, KeyError, struct.error) as error:
                    raise ValueError(f"{path}: {error}") from error


def register_headers(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets it take filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ModelHeaders)


class ModelHeaders(DataSource):
    """The source ``model_headers``."""

    @classmethod
    def name(cls) -> str:
        return "model_headers"

    def schema(self) -> str:
        return "path string, bytes long, version int, tensors long, key string, value string"

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.options)
