"""Conversations as arrays of messages: pairing, tool results, labels, stop strings, versions."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from siltstone.functions.text import strip

_ROW = pa.struct([(n, pa.string()) for n in ("user", "assistant", "tool", "role", "tool_call_id", "tool_calls")])
_PAIRED = pa.struct([("rows", pa.list_(_ROW)), ("system", pa.string()), ("pending", pa.string())])


def _row(user: str = "", assistant: str = "", tool: str = "", **more) -> dict:
    return {"user": user, "assistant": assistant, "tool": tool, **more}


def pair(messages: list[dict]) -> dict:
    """Rows of (user, assistant, tool) as they follow each other; system messages ahead of all others are joined by lines.

    A user's message waits for its reply; another one, or a later system message, sends it off without.  ``pending`` is the last
    message, if it's a user's.
    """
    rows, system, waiting, started = [], [], "", False
    for m in messages:
        role, content = m["role"], m.get("content") or ""
        if role in ("system", "developer") and not started:
            system.append(content)
            continue
        started = True
        if role == "assistant":
            rows.append(_row(waiting, content, tool_calls=m.get("tool_calls")))
            waiting = ""
        elif role == "tool":
            rows.append(_row(tool=content, tool_call_id=m.get("tool_call_id")))
        else:
            if waiting:
                rows.append(_row(waiting))
            waiting = content if role == "user" else ""
            if role in ("system", "developer"):
                rows.append(_row(content, role="system"))
    last = messages[-1] if messages else {"role": ""}
    return {"rows": rows, "system": "\n".join(x for i, x in enumerate(system) if x or i), "pending": (last.get("content") or "") if last["role"] == "user" else ""}


@F.arrow_udf(from_arrow_type(_PAIRED))
def _pair(column: pa.Array) -> pa.Array:
    return pa.array([None if m is None else pair(m) for m in column.to_pylist()], _PAIRED)


def paired(messages: Column) -> Column:
    """Struct of rows, system and pending of an array of (role, content, tool_calls, tool_call_id); see ``pair``."""
    return _pair(messages)


def unpaired(rows: Column, system: Column) -> Column:
    """The messages of paired rows, (role, content), with the system message ahead of them; empty parts make none."""
    message = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    one = lambda r: F.array(message(F.coalesce(r.role, F.lit("user")), r.user), message(F.lit("assistant"), r.assistant), message(F.lit("tool"), r.tool))
    return F.filter(F.concat(F.array(message(F.lit("system"), system)), F.flatten(F.transform(rows, one))), lambda m: m.content != "")


def flat_content(parts: Column) -> Column:
    """The text of an array of (type, text): texts on lines, a placeholder for each image ahead of them."""
    texts = F.array_join(F.transform(F.filter(parts, lambda p: p.type == "text"), lambda p: F.coalesce(p.text, F.lit(""))), "\n")
    images = F.size(F.filter(parts, lambda p: p.type == "image_url"))
    return F.when(parts.isNull(), "").when(images > 0, F.concat(F.repeat(F.lit("<__media__>"), images), F.lit("\n\n"), texts)).otherwise(texts)


def answered_calls(calls: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """(by, call_id, name, content): every call with its result; one without has an empty one."""
    return calls.join(results.select(*by, "call_id", "content"), [*by, "call_id"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def run_registry(calls: DataFrame, tools: dict[str, object]) -> DataFrame:
    """``calls`` (…, name, arguments) with ``content``: what each registered tool, a function of a column, makes of the arguments; unknown tools give an error as JSON."""
    out = F.to_json(F.struct(F.concat(F.lit("Unknown tool: "), F.col("name")).alias("error")))
    for name, tool in tools.items():
        out = F.when(F.col("name") == name, tool(F.col("arguments"))).otherwise(out)
    return calls.withColumn("content", out)


def within_budget(messages: DataFrame, by: list[str], budget: int) -> DataFrame:
    """(…, role, turn, tokens) that fit a budget, with ``taken``: system messages stay, others go from the oldest on, and so do tool
    results whose call is gone; the last message is cut if it's too long alone."""
    late = Window.partitionBy(*by).orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    system = F.col("role") == "system"
    m = messages.withColumn("_system", F.sum(F.when(system, F.col("tokens")).otherwise(0)).over(whole))
    m = m.withColumn("_used", F.sum(F.when(system, 0).otherwise(F.col("tokens"))).over(late) + F.col("_system")).withColumn("_last", F.max(F.when(~system, F.col("turn"))).over(whole))
    m = m.where(system | (F.col("_used") <= budget) | (F.col("turn") == F.col("_last")))
    m = m.withColumn("_first", F.min(F.when(~system & (F.col("role") != "tool"), F.col("turn"))).over(whole)).where((F.col("role") != "tool") | (F.col("turn") > F.col("_first")))
    room = F.greatest(F.lit(budget) - F.col("_system"), F.lit(0))
    return m.withColumn("taken", F.when(~system & (F.col("turn") == F.col("_last")), F.least("tokens", room)).otherwise(F.col("tokens"))).drop("_system", "_used", "_last", "_first")


#: Role names of the other public chat format.
ROLES = {"human": "user", "gpt": "assistant"}


def normal_role(name: Column) -> Column:
    out = name
    for theirs, ours in ROLES.items():
        out = F.when(name == theirs, ours).otherwise(out)
    return out


def normal_messages(messages: Column, turns: Column) -> Column:
    """``messages`` (role, content) where there are any, else ``turns`` (from, value) under normal roles."""
    return F.coalesce(messages, F.transform(turns, lambda t: F.struct(normal_role(t["from"]).alias("role"), t.value.alias("content"))))


def labels_of(turns: Column, ignored: int = -100) -> Column:
    """The labels of an array of (role, header, ids): ids of assistants' turns, and ``ignored`` for headers and all other turns."""
    blank = lambda a: F.transform(a, lambda _: F.lit(ignored))
    return F.flatten(F.transform(turns, lambda t: F.concat(blank(t.header), F.when(t.role == "assistant", t.ids).otherwise(blank(t.ids)))))


def padded(ids: Column, size: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0))))


def fitted(ids: Column, cutoff: int, truncate: bool) -> Column:
    """``ids`` of at most ``cutoff``: a longer array is cut, or empty."""
    return F.when(F.size(ids) <= cutoff, ids).otherwise(F.slice(ids, 1, cutoff) if truncate else F.slice(ids, 1, 0))


def needed_stops(stops: Column) -> Column:
    """Distinct stop strings without those that start with another."""
    return F.array_distinct(F.filter(stops, lambda x: ~F.exists(stops, lambda y: (x != y) & F.startswith(x, y))))


_BRACKETS = {"<": ">", "[": "]", "(": ")", "{": "}"}


def template_stops(rendered: str, said: tuple[str, str, str, str]) -> list[str]:
    """Stop strings of a template, from what it makes of two exchanges ``said`` (user, assistant, user, assistant).

    What stands behind the first message, behind the first answer and at the end opens a turn: its first mark in brackets, or
    else all up to its first colon.  Strings that start with another are left out.
    """
    ends = [rendered.index(x) + len(x) for x in said]
    starts = [rendered.index(x) for x in said]
    found = []
    for gap in (rendered[ends[0] : starts[1]], rendered[ends[1] : starts[2]], rendered[ends[3] :]):
        bare = gap.strip()
        closing = bare.find(_BRACKETS[bare[0]]) if bare[:1] in _BRACKETS else -1
        if closing > 0:
            found.append(bare[: closing + 1])
        elif ":" in gap:
            found.append(gap[: gap.index(":") + 1])
    return [x for x in dict.fromkeys(found) if not any(x != y and x.startswith(y) for y in found)]


def version_at(versions: Column, current: Column, step: Column) -> Column:
    """The number of the version ``step`` places on, within the first and the last."""
    return F.least(F.greatest(current + step, F.lit(0)), F.size(versions) - 1)


def branch(messages: DataFrame, turn: Column | int, metadata: str | None = None) -> DataFrame:
    """Messages up to a turn; keys of a map ``metadata`` named role_turn that lie beyond it go."""
    kept = messages.where(F.col("turn") <= turn)
    if metadata:
        kept = kept.withColumn(metadata, F.map_filter(metadata, lambda k, _: F.element_at(F.split(k, "_"), -1).cast("int") <= turn))
    return kept


@F.arrow_udf(StringType())
def _unescaped(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in column.to_pylist()], pa.string())


def title(file_name: Column, prompts: Column, sentinel: str = "<|BEGIN-VISIBLE-CHAT|>", size: int = 28) -> Column:
    """A chat's title: its file name, or where that is a time the first prompt, the second where the first is the greeting's mark; ``New chat`` without."""
    first = F.when(F.get(prompts, F.lit(0)) == sentinel, F.get(prompts, F.lit(1))).otherwise(F.get(prompts, F.lit(0)))
    name = strip(F.when(file_name.rlike(r"^[0-9]{8}-[0-9]{2}-[0-9]{2}-[0-9]{2}$"), F.coalesce(_unescaped(first), F.lit("New chat"))).otherwise(file_name))
    return shortened(name, size)


def shortened(text: Column, size: int = 28) -> Column:
    """At most ``size`` characters, three of them full stops where it was longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def without_speaker(reply: Column, name: Column) -> Column:
    """A reply without its speaker's name and colon at its start."""
    lead = F.concat(name, F.lit(":"))
    return F.when(F.startswith(F.ltrim(reply), lead), F.ltrim(F.substring(F.ltrim(reply), F.length(lead) + 1, F.length(reply)))).otherwise(reply)


def rendered(messages: Column, before: str = "<|im_start|>", between: str = "\n", after: str = "<|im_end|>\n", prompt: bool = False) -> Column:
    """Messages (role, content) in a template of marks around role and content, with the start of a reply behind them where asked for."""
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(before), m.role, F.lit(between), m.content, F.lit(after))), "")
    return F.concat(text, F.lit(f"{before}assistant{between}")) if prompt else text
