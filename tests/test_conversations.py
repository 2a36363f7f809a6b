"""Tool calls, reasoning, messages, hits and small tools on small cases."""

import json
import math
import random
import struct
from base64 import b64decode

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import budget, messages, reasoning, small, tools, vectors
from siltstone.operators import retrieval, windows

NAMES = frozenset({"find", "find_all"})


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('<｜tool▁call▁begin｜>find<｜tool▁sep｜>{"q": "a}"}x<｜tool▁call▁begin｜>other<｜tool▁sep｜>{}', [("find", {"q": "a}"})]), ('<|tool_call_begin|>functions.find_all:3<|tool_call_argument_begin|> {"n": 1}', [("find_all", {"n": 1})]),
        ('<|channel|>commentary to=functions.find <|constrain|>json<|message|>{"n": 2}', [("find", {"n": 2})]), ('<|tool_call>call:find{a:<|"|>x{"y<|"|>,b:{c:[1,2]}}<tool_call|>', [("find", {"a": 'x{"y', "b": {"c": [1, 2]}})]),
        ('<minimax:tool_call><invoke name="find"><parameter name="a">1</parameter></invoke><invoke name="find_all"></invoke></minimax:tool_call>', [("find", {"a": 1}), ("find_all", {})]),
        ("<tool_call>find<arg_key>a</arg_key><arg_value>true</arg_value></tool_call>", [("find", {"a": True})]), ("<tool_call>find<arg_key>a</arg_key></tool_call>", []),
        ("<tool_call>\n<function=find>\n<parameter=a>\nx y\n</parameter>\n</function>\n</tool_call>", [("find", {"a": "x y"})]), ('[TOOL_CALLS]find[ARGS]{"a": null}', [("find", {"a": None})]),
        ('find{"a": 1} find_all {"b": 2} finder{"c": 3}', [("find", {"a": 1}), ("find_all", {"b": 2})]), ("so [find(a='x, y', b=2), find_all()]", [("find", {"a": "x, y", "b": 2}), ("find_all", {})]),
        ('```json\n{"name": "find", "parameters": {"a": 1}}\n{"name": "find"}\n```', [("find", {"a": 1}), ("find", {})]), ('<tools>{"function": "find", "arguments": {"z": 0}}</tools>', [("find", {"z": 0})]), ('{"name": "find"}', [("find", {})]),
        ('<think>find{"a": 1}</think>nothing', []), ('find{"a": ', []), ("", []), ('{"name": "other"}', []),
    ],
)
def test_calls(text, found):
    assert [(n, json.loads(a)) for n, a in tools.calls(text, NAMES)] == found


def test_formats_of_templates():
    every, marks, bare = tools.detect("")
    assert bare and marks == tools.MARKERS and len(every) == 10
    some, marks, bare = tools.detect("... <tool_call> ... <arg_key>")
    assert not bare and some == ("paired_tags", "parameters", "bare", "pythonic") and marks == ("<tool_call>",)
    assert tools.calls("[find(a=1)]", NAMES, ("bracketed",)) == []
    assert tools.sane({"function": {"name": "find", "arguments": 1}}, NAMES) == ("find", 1) and tools.sane([1], NAMES) is None and tools.sane({"name": 3}, NAMES) is None


def test_held_back(spark):
    rows = ["say <tool_call>", "say <tool", "say <tool.", "find {", "say fin", "", "to=functions."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", tools.held_back(F.col("t")).alias("a"), tools.held_back(F.col("t"), ("find",), bare_names=True).alias("b"), tools.held_back(F.col("t"), ("find",), partial=False).alias("c")).orderBy("i").collect()
    assert [r.a for r in got] == [True, True, False, False, False, False, True]
    assert [r.b for r in got] == [True, True, False, True, True, False, True] and [r.c for r in got] == [True, False, False, True, False, False, True]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("<think>a</think>\n b", ("a", "b")), ("<think>a", ("a", "")), ("x</think>y", ("x", "y")), ("<thi", ("", "")), ("plain", (None, "plain")), ("", (None, "")), ("<seed:think>a</seed:think>b", ("a", "b")),
        ("<|channel|>analysis<|message|>a<|end|><|start|>assistant<|channel|>final<|message|>b", ("a", "b")), ("<|channel|>analysis<|message|>a<|end|><|start|>assis", ("a", "")), ("<|channel|>analysis<|message|>a<|channel|>final<|message|>b", ("a", "b")),
        ("<|channel>thought a<channel|>b", (" a", "b")), ("<|think|>a<|end|><|content|>b", ("a", "b")), ("w <|channel|>final<|message|>b", ("w", "b")),
    ],
)
def test_reasoning(text, parts):
    assert reasoning.split_block(text) == parts


def test_pairs_of_messages():
    m = lambda role, content, **kw: {"role": role, "content": content, **kw}
    got = messages.pair([m("system", "s1"), m("developer", "s2"), m("user", "a"), m("user", "b"), m("assistant", "c", tool_calls="[]"), m("tool", "d", tool_call_id="t"), m("assistant", "e"), m("user", "f"), m("system", "g"), m("user", "h")])
    rows = [(r["user"], r["assistant"], r["tool"]) for r in got["rows"]]
    assert rows == [("a", "", ""), ("b", "c", ""), ("", "", "d"), ("", "e", ""), ("f", "", ""), ("g", "", "")] and (got["system"], got["pending"]) == ("s1\ns2", "h")
    assert got["rows"][2]["tool_call_id"] == "t" and got["rows"][5]["role"] == "system"
    assert messages.pair([]) == {"rows": [], "system": "", "pending": ""}


def test_message_functions(spark):
    calls = spark.createDataFrame([(1, "a", "up", "x"), (1, "b", "nope", "y")], "c int, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, "a", "done")], "c int, call_id string, content string")
    assert {(r.call_id, r.content) for r in messages.answered_calls(calls, results, ["c"]).collect()} == {("a", "done"), ("b", "")}
    ran = {r.name: r.content for r in messages.run_registry(calls, {"up": F.upper}).collect()}
    assert ran["up"] == "X" and json.loads(ran["nope"])["error"] == "Unknown tool: nope"
    said = ("u1", "a1", "u2", "a2")
    assert messages.template_stops("<U>u1</U>\n<A> a1 </A>\n<U>u2</U>\n<A> a2 </A>\n", said) == ["</U>", "</A>"]
    assert messages.template_stops("Q: u1\nReply: a1\n\nQ: u2\nReply: a2", said) == ["\nReply:", "\n\nQ:"]
    assert messages.template_stops("[x] u1 [/x] a1 [x] u2 [/x] a2 (end", said) == ["[/x]", "[x]"]
    row = spark.range(1).select(
        messages.title(F.lit("20240102-03-04-05"), F.array(F.lit("<|BEGIN-VISIBLE-CHAT|>"), F.lit(" a &amp; b "))).alias("a"), messages.title(F.lit("my notes on a very long subject indeed"), F.array(F.lit("x"))).alias("b"),
        messages.without_speaker(F.lit(" Ada: hi"), F.lit("Ada")).alias("c"), messages.padded(F.array(F.lit(1)), F.lit(3), 0).alias("d"), messages.title(F.lit("20240102-03-04-05"), F.array().cast("array<string>")).alias("e"),
        messages.labels_of(F.array(F.struct(F.lit("user").alias("role"), F.array(F.lit(1)).alias("header"), F.array(F.lit(2), F.lit(3)).alias("ids")), F.struct(F.lit("assistant").alias("role"), F.array(F.lit(4)).alias("header"), F.array(F.lit(5)).alias("ids")))).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("a & b", "my notes on a very long s...", "hi", [1, 0, 0], "New chat", [-100, -100, -100, -100, 5])


def test_diverse_against_loops(spark):
    rng = random.Random(6)
    hits = [(q, i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 5))), round(rng.random(), 2)) for q in range(8) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(hits, "q int, id long, text string, score double")
    got = retrieval.diverse(retrieval.best(df, ["q"], 9, "score"), ["q"], 4, 0.4).collect()
    for q in range(8):
        left = sorted((h for h in hits if h[0] == q), key=lambda h: (-h[3], h[1]))[:9]
        chosen = []
        while left and len(chosen) < 4:
            words = lambda h: set(h[2].split())
            overlap = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b)) if words(a) | words(b) else 0.0
            pick = max(left, key=lambda h: (round(h[3] - 0.4 * max((overlap(h, c) for c in chosen), default=0.0), 12), -left.index(h)))
            chosen.append(pick)
            left.remove(pick)
        assert [(r.id, r.score) for r in sorted((r for r in got if r.q == q), key=lambda r: r.place)] == [(h[1], h[3]) for h in chosen]


def test_retrieval_rules(spark):
    assert [retrieval.pool_size(5, 20, True, 0.3), retrieval.pool_size(30, 20, True, 0), retrieval.pool_size(5, 20, False, 0.3), retrieval.pool_size(5, 20, False, 0)] == [20, 30, 40, 5]
    hits = spark.createDataFrame([(1, 0.2, 0.1), (2, 0.9, 0.8), (3, 0.7, 0.2)], "id int, semantic double, contradiction double")
    assert [r.id for r in retrieval.within_limits(hits, 0.5, 0.5).collect()] == [3]
    with pytest.raises(ValueError, match="limits"):
        retrieval.within_limits(hits, 0.95, required=True)
    parts = spark.createDataFrame([(1, 0, 4, "abcd", 0.4), (1, 3, 6, "def", 0.1), (1, 6, 7, "g", 0.9), (1, 9, 10, "j", 0.5), (1, 4, 5, "e", 0.2)], "d int, start int, stop int, text string, distance double")
    got = sorted((r.start, r.stop, r.text, r.members, round(r.distance, 6)) for r in retrieval.merge_passages(parts, ["d"], "arithmetic").collect())
    assert got == [(0, 7, "abcdefg", 4, round((((0.4 + 0.1) / 2 + 0.2) / 2 + 0.9) / 2, 6)), (9, 10, "j", 1, 0.5)]


def test_token_windows_in_a_row(spark):
    docs = [(5000, ["a"] * 3), (1, ["b"] * 4), (2, []), (9000, ["c"] * 5)]
    got = sorted(tuple(r) for r in windows.token_windows(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), 5, 2).collect())
    row = list("bbbbaaaccccc")
    assert got == [(s, len(row[s : s + 5]), row[s : s + 5]) for s in range(0, 12, 3)]
    with pytest.raises(ValueError, match="stride"):
        windows.token_windows(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), 5, 5)


def test_matrices(spark):
    rows = [(0, [[3.0, 4.0], [0.0, 2.0]]), (1, [[1.0, 0.0]]), (2, []), (3, None), (4, [[0.0, 0.0]]), (5, [[1.0], [1.0, 2.0]]), (6, [[math.nan, 1.0]]), (7, [[1.0, None]])]
    df = spark.createDataFrame(rows, "i int, m array<array<double>>")
    assert [r.v for r in sorted(df.select("i", vectors.valid_matrix(F.col("m")).alias("v")).collect())] == [True, True] + [False] * 6
    good = df.where("i < 2")
    unit = {r.i: r.u for r in good.select("i", vectors.unit_rows(F.col("m")).alias("u")).collect()}
    assert np.allclose(unit[0], [[0.6, 0.8], [0, 1]])
    with pytest.raises(Exception, match="isn't valid"):
        df.where("i = 4").select(vectors.unit_rows(F.col("m"))).collect()
    query = [[1.0, 0.0], [0.0, 5.0]]
    q = F.array(*(F.array(*map(F.lit, r)) for r in [[1.0, 0.0], [0.0, 1.0]]))
    one = {r.i: r.s for r in good.select("i", vectors.symmetric_maxsim(q, vectors.unit_rows(F.col("m"))).alias("s")).collect()}
    many = {r.i: r.s for r in df.where("i < 4").select("i", vectors.maxsim_with(query, F.col("m")).alias("s")).collect()}
    assert math.isclose(one[0], ((0.6 + 1) / 2 + (0.8 + 1) / 2) / 2) and math.isclose(one[1], (0.5 + 1) / 2) and all(math.isclose(one[i], many[i]) for i in one) and many[2] is many[3] is None
    assert struct.unpack("<2f", b64decode(spark.range(1).select(vectors.packed(F.array(F.lit(0.5), F.lit(-2.0))).alias("p")).first().p)) == (0.5, -2.0)


def test_budgets(spark):
    text = "one two, three  four"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = df.select(budget.within_tokens(F.col("t"), 3).alias("a"), budget.within_words(F.col("t"), 3).alias("b")).collect()
    assert got[0].a.strip() == "one two," and got[0].b == "one two, three" and got[1].a is got[1].b is None
    assert [budget.cut_to(text, n, len) for n in (0, 5, 99)] == ["", "one t", text]
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    ids = df.select(budget.encoded(F.col("t"), path).alias("i")).select("i", budget.decoded(F.col("i"), path).alias("d")).collect()
    assert ids[0].d == text and ids[1].i == []


def test_small_tools(spark):
    df = spark.sql("select timestamp'2024-03-05 07:09:11' t")
    row = df.select(small.message_time(F.col("t")).alias("c"), small.chat_id(F.col("t")).alias("d"), small.dice_total(F.array(F.lit(0.0), F.lit(0.99)), 6).alias("e"), small.time_sentence(F.col("t")).alias("s")).first()
    assert (row.c, row.d, row.e) == ("Mar 05, 2024 07:09", "20240305-07-09-11", 7) and row.s == "Current time is 07:09:11. Today is Tuesday. The current date is 2024-03-05."
    hooks = small.Hooks()
    hooks.add("input", F.upper)
    hooks.add("input", lambda t: F.concat(t, F.lit("!")))
    hooks.override("prompt", lambda t: F.when(t == "x", "first"))
    hooks.override("prompt", lambda t: F.lit("second"))
    row = spark.createDataFrame([("x",)], "t string").select(hooks.apply("input", F.col("t")).alias("a"), hooks.first("prompt", F.lit("none"), F.col("t")).alias("b"), hooks.first("other", F.lit("none")).alias("c"), hooks.apply("nothing", F.col("t")).alias("d")).first()
    assert tuple(row) == ("X!", "first", "none", "x")


def test_streams_of_replies(spark, tmp_path):
    from siltstone.streaming import replies

    assert replies.cut("ab END c", ("END",), False) == ("ab ", True) and replies.cut("ab EN", ("END",), False) == ("ab ", False) and replies.cut("ab EN", ("END",), True) == ("ab EN", False)
    schema = "request string, ordinal long, part string, last boolean"
    for p in (("a", 0, "one E", False), ("a", 1, "ND two", False), ("a", 2, "late", True), ("b", 0, "x", True)):
        spark.createDataFrame([p], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replies.reply_snapshots(stream, ("END",)).writeStream.format("memory").queryName("snapshots").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("snapshots").collect()} == {("a", "one ", False), ("a", "one ", True), ("b", "x", True)}
    counts = spark.createDataFrame([("a", 0.0, 0), ("a", 2.0, 10), ("a", 3.0, 4), ("a", 5.0, 10)], "request string, at double, tokens long")
    counts.coalesce(1).write.parquet(str(tmp_path / "n"))
    stream = spark.readStream.schema(counts.schema).parquet(str(tmp_path / "n"))
    q = replies.token_speed(stream).writeStream.format("memory").queryName("speeds").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.speed for r in spark.table("speeds").collect()) == [0.0, 0.0, 3.0, 5.0]


def test_streams_that_forget(spark, tmp_path):
    from siltstone.streaming import replies
    from siltstone.streaming.sentences import first_sentences

    schema = "request string, ordinal long, part string, last boolean"
    spark.createDataFrame([("a", 0, "One. two", True)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for i, out in enumerate((first_sentences(stream, 60_000), replies.reply_snapshots(stream, ("!",), 60_000))):
        q = out.writeStream.format("memory").queryName(f"forgets{i}").option("checkpointLocation", str(tmp_path / f"ck{i}")).start()
        q.awaitTermination(8)  # with a timeout of state it never runs out of batches
        q.stop()
        assert spark.table(f"forgets{i}").count() == 1
