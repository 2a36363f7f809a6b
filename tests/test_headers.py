"""Model headers as a data source: heads of sparse files of gigabytes, filters taken over, faults that name their file."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from siltstone.sources import headers as H


def text(s):
    return struct.pack("<Q", len(s.encode())) + s.encode()


def head(keys, version=3, magic=H.MAGIC):
    body = b"".join(text(k) + v for k, v in keys)
    return struct.pack("<IIQQ", magic, version, 7, len(keys)) + body


WORDS = [f"w{i}" for i in range(3000)]
KEYS = [
    ("general.name", struct.pack("<I", 8) + text("Möwe")), ("layers", struct.pack("<II", 4, 32)), ("rate", struct.pack("<Id", 12, 0.25)), ("on", struct.pack("<I?", 7, True)),
    ("vocabulary", struct.pack("<IIQ", 9, 8, len(WORDS)) + b"".join(map(text, WORDS))), ("scores", struct.pack("<IIQ", 9, 6, 5000) + struct.pack("<5000f", *range(5000))),
    ("nested", struct.pack("<IIQ", 9, 9, 2) + struct.pack("<IQbb", 1, 2, 1, -2) + struct.pack("<IQ", 8, 1) + text("x")), ("last", struct.pack("<Iq", 11, -5)),
]
WANT = {"general.name": "Möwe", "layers": 32, "rate": 0.25, "on": True, "vocabulary": WORDS, "scores": [float(i) for i in range(5000)], "nested": [[1, -2], ["x"]], "last": -5}


@pytest.fixture
def folder(spark, tmp_path):
    H.register_headers(spark)
    (tmp_path / "deep").mkdir()
    for name in ("a.gguf", "deep/B.GGUF"):
        (tmp_path / name).write_bytes(head(KEYS))
    (tmp_path / "notes.txt").write_text("no")
    os.truncate(tmp_path / "a.gguf", 5 << 30)  # sparse: five gigabytes of which the head alone is there
    return tmp_path


def load(spark, folder, **options):
    return spark.read.format("model_headers").options(**options).load(str(folder))


@pytest.mark.parametrize("piece", [64, 1 << 18])
def test_whole_headers(spark, folder, piece):
    rows = load(spark, folder, arrays=True, piece=piece).collect()
    for name, size in (("a.gguf", 5 << 30), ("deep/B.GGUF", len(head(KEYS)))):
        own = [r for r in rows if r.path == str(folder / name)]
        assert {r.key: json.loads(r.value) for r in own} == WANT and {(r.bytes, r.version, r.tensors) for r in own} == {(size, 3, 7)}


def test_lengths_and_filters(spark, folder):
    df = load(spark, folder, filesPerTask=1)
    assert df.rdd.getNumPartitions() == 2
    lengths = {r.key: json.loads(r.value) for r in df.where(F.col("path") == str(folder / "a.gguf")).collect()}
    assert lengths == {**WANT, "vocabulary": {"length": 3000}, "scores": {"length": 5000}, "nested": {"length": 2}}
    assert sorted((r.key, r.value) for r in df.where("key in ('layers', 'last')").select("key", "value").collect()) == [("last", "-5"), ("last", "-5"), ("layers", "32"), ("layers", "32")]
    assert df.where("value = '32' and key = 'layers'").count() == 2 and df.where("key = 'none'").count() == 0


def test_little_is_read(folder):
    with open(folder / "a.gguf", "rb") as file:
        found = list(H.header_rows(file, 4096, False, frozenset(["layers"])))
        assert found == [(3, 7, "layers", 32)] and file.tell() == 4096


@pytest.mark.parametrize(("content", "fault"), [(head(KEYS)[:90], "cut"), (head(KEYS, version=1), "version 1"), (head(KEYS, magic=5), "not a model file"), (b"", "cut")])
def test_faults_name_the_file(spark, folder, content, fault):
    (folder / "bad.gguf").write_bytes(content)
    with pytest.raises(Exception, match=rf"bad.gguf: .*{fault}"):
        load(spark, folder).collect()


def test_no_files(spark, tmp_path):
    H.register_headers(spark)
    assert load(spark, tmp_path).count() == 0
