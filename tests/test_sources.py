"""Readers, the published index, and datasets, by round trips."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.sources import index, structured, texts


def test_corpus_limits_and_changes(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "one.txt").write_text("One.")
    (b / "two.TXT").write_text("Two two.")
    (b / "three.md").write_text("no")
    both = texts.read_text_corpus(spark, [str(a), str(b), str(a)])
    assert sorted(r.text for r in both.collect()) == ["One.", "Two two."]
    for limit in ({"max_files": 1}, {"max_file": 5}, {"max_total": 9}):
        with pytest.raises(ValueError, match="limit"):
            texts.read_text_corpus(spark, [str(a), str(b)], **limit)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no .txt"):
        texts.read_text_corpus(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="needs a path"):
        texts.list_text_files(spark, [])
    manifest = spark.createDataFrame([tuple(r) for r in both.select("source", "sha256").collect()], "source string, sha256 string")
    (a / "one.txt").write_text("Other.")
    (b / "two.TXT").unlink()
    (b / "four.txt").write_text("Four.")
    got = {r.source.rsplit("/", 1)[1]: r.change for r in texts.changed_files(spark, manifest, [str(a), str(b)]).collect()}
    assert got == {"one.txt": "changed", "two.TXT": "gone", "four.txt": "new"}


def test_pages_and_extractors(spark, tmp_path):
    page = "<html><head><style>x</style><script>var a;</script></head><body><p> A word <b>bold</b></p><i> 7 </i></body></html>"
    row = spark.createDataFrame([(page,), (None,)], "h string").select(texts.page_text(F.col("h")).alias("a"), texts.page_text(F.col("h"), True).alias("b")).collect()
    assert (row[0].a, row[0].b, row[1].a) == ("A word\nbold\n7", "A word", "")
    files = spark.createDataFrame([("p.html", bytearray(page.encode())), ("q.txt", bytearray(b"plain")), ("r.bin", bytearray(b"\xff\xfe\x00"))], "path string, content binary")
    assert {r.path: (r.format, r.text) for r in texts.extract_texts(files).collect()} == {"p.html": ("html", "A word\nbold\n7"), "q.txt": ("text", "plain"), "r.bin": (None, "")}
    sheet = spark.createDataFrame([(2, "c", 4), (1, "a", None), (3, None, 6)], "r int, x string, y int")
    assert texts.cells_as_text(sheet, "r").first().text == "a\nc\n4\n6"


def test_datasets(spark, tmp_path):
    for name, rows in (("chat", [{"conversations": [{"from": "human", "value": "hi"}]}]), ("text", [{"text": "a"}, {"text": "b"}]), ("bad", [{"x": 1}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=1))
    assert structured.read_dataset(spark, str(tmp_path / "chat.json"))[0] == "chat"
    kind, rows = structured.read_dataset(spark, str(tmp_path / "text.json"))
    assert kind == "text" and rows.count() == 2
    with pytest.raises(ValueError, match="need messages"):
        structured.read_dataset(spark, str(tmp_path / "bad.json"))
    structured.sample_rows(rows, str(tmp_path / "sample"), 1)
    assert spark.read.json(str(tmp_path / "sample")).count() == 1
    assert structured.joined_corpus(spark.createDataFrame([(2, "b"), (1, "a")], "i int, text string"), "i").first().text == "a\n\nb"


def test_histories(spark, tmp_path):
    (tmp_path / "new.json").write_text(json.dumps({"internal": [["<|BEGIN-VISIBLE-CHAT|>", "hello"], ["q", "a"]], "visible": [["", "hello"], ["Q", "A"]]}))
    (tmp_path / "old.json").write_text(json.dumps({"data": [["x", "y"]], "data_visible": [["X", "Y"]], "metadata": {"user_0": {"timestamp": "t"}, "user_1": {"timestamp": "u"}}}))
    got = {(r.path.rsplit("/", 1)[1], r.turn): r for r in structured.read_histories(spark, str(tmp_path)).collect()}
    assert set(got[("new.json", 0)].metadata) == {"assistant_0"} and set(got[("new.json", 1)].metadata) == {"user_1", "assistant_1"}
    old = got[("old.json", 0)]
    assert (old.user, old.visible_assistant, {k: v.timestamp for k, v in old.metadata.items()}) == ("x", "Y", {"user_0": "t"})
    turns = spark.createDataFrame([(1, 1, "c", "d"), (1, 0, "a", "b")], "conv_id int, turn int, user string, assistant string")
    structured.write_histories(turns, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().internal == [["a", "b"], ["c", "d"]]


def test_evaluation_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for values in (("m", "d2", "512", 9.5), ("m", "d1", "512", 3.25), ("m", "d1", "1024", None)):
        structured.append_evaluations(spark.createDataFrame([values], "Model string, Dataset string, stride string, Perplexity double"), path)
    got = structured.read_evaluations(spark, path).collect()
    assert [(r.Dataset, r.stride, r.Perplexity) for r in got] == [("d1", "1024", None), ("d1", "512", 3.25), ("d2", "512", 9.5)]


def model_file(version=3):
    text = lambda t: struct.pack("<Q", len(t.encode())) + t.encode()
    values = [("name", 8, text("Lumen")), ("blocks", 4, struct.pack("<I", 32)), ("scale", 12, struct.pack("<d", 0.5)), ("on", 7, b"\x01"), ("words", 9, struct.pack("<IQ", 8, 2) + text("a") + text("é"))]
    return struct.pack("<IIQQ", 0x46554747, version, 7, len(values)) + b"".join(text(k) + struct.pack("<I", kind) + raw for k, kind, raw in values)


def test_model_headers(spark):
    files = spark.createDataFrame([("m", bytearray(model_file()))], "path string, content binary")
    got = {r.key: json.loads(r.value) for r in structured.read_model_headers(files).collect()}
    assert got == {"name": "Lumen", "blocks": 32, "scale": 0.5, "on": True, "words": ["a", "é"]}
    with pytest.raises(ValueError, match="version 1"):
        structured.model_header(model_file(1))
    with pytest.raises((ValueError, struct.error)):
        structured.model_header(model_file()[:40])


def test_pictures(spark):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = b"\x89PNG\r\n\x1a\n"
    plain = head + chunk(b"IHDR", b"\0" * 13) + chunk(b"tEXt", b"image_gen_settings\0" + b'{"steps": 9}') + chunk(b"IEND", b"")
    packed = head + chunk(b"iTXt", b"image_gen_settings\0\1\0\0\0" + zlib.compress('{"p": "é"}'.encode()))
    rows = [(0, bytearray(plain)), (1, bytearray(packed)), (2, bytearray(b"no")), (3, None), (4, bytearray(plain.replace(b"{", b"[")))]
    got = [r.s for r in sorted(spark.createDataFrame(rows, "i int, c binary").select("i", structured.picture_settings(F.col("c")).alias("s")).collect())]
    assert [x and json.loads(x) for x in got] == [{"steps": 9}, {"p": "é"}, None, None, None]


def test_catalogue(spark):
    names = [("/m/b10.gguf", 5), ("/m/B2.GGUF", 3), ("/m/big-00002-of-00002.gguf", 7), ("/m/big-00001-of-00002.gguf", 9), ("/m/mmproj-x.gguf", 1), ("/m/c.bin", 1)]
    got = [tuple(r) for r in structured.catalogue(spark.createDataFrame(names, "path string, length long"), ".gguf").orderBy("place").collect()]
    assert got == [("B2.GGUF", 1, 3, 1), ("b10.gguf", 1, 5, 2), ("big-00001-of-00002.gguf", 2, 16, 3)]


def test_defaults(spark):
    row = spark.sql("select map('a', 1, 'b', 2, 'c', cast(null as int)) s, map('a', 1, 'b', 3) d").select(structured.without_defaults(F.col("s"), F.col("d")).alias("x")).first()
    assert row.x == {"b": 2}


def test_index(spark, tmp_path):
    files = spark.createDataFrame([("x", "1"), ("y", "2")], "source string, sha256 string")
    sign = index.signature({"k": 1}, "enc", files)
    assert sign == index.signature({"k": 1}, "enc", files.orderBy(F.desc("source"))) != index.signature({"k": 2}, "enc", files)
    assert index.config_key({"a": 1, "b": [2]}) == index.config_key({"b": [2], "a": 1})
    found = index.Index(spark, str(tmp_path / "idx"))
    assert found.manifest() is None and not found.current(sign)
    with pytest.raises(ValueError, match="no index"):
        found.table("t")
    first = found.refresh(sign, lambda: {"t": spark.range(3), "u": spark.range(1)})
    assert found.table("t", sign).count() == 3 and found.refresh(sign, lambda: 1 / 0) == first
    bad = spark.range(2).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        found.publish({"t": spark.range(9), "v": bad}, "other")
    assert found.table("t", sign).count() == 3
    found.publish({"t": spark.range(5)}, "new")
    assert found.table("t").count() == 5
    with pytest.raises(ValueError, match="out of date"):
        found.table("t", sign)
    assert sorted(p.name for p in (tmp_path / "idx").iterdir() if not p.name.startswith(".")) == [f"generation-{found.manifest()['generation']}", "manifest.json"]
