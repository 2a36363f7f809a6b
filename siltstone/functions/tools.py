"""Tool calls in a model's reply: the formats that models write them in, and which of them a template asks for."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.reasoning import split_block

Call = tuple[int, str, object]  # where it starts, name, arguments

_JSON = json.JSONDecoder()
_KIND = pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())]))


def _object_at(text: str, at: int) -> dict | None:
    if text[at : at + 1] != "{":
        return None
    try:
        return _JSON.raw_decode(text, at)[0]
    except (ValueError, RecursionError):
        return None


def _value(raw: str):
    """A JSON value, or the string that it is."""
    try:
        return json.loads(raw)
    except ValueError:
        return raw


def _before_objects(*openers: str) -> Callable[[str, frozenset[str]], list[Call]]:
    """Calls whose name stands in an opener right before an object; of several openers the first that finds any counts."""

    def read(text: str, names: frozenset[str]) -> list[Call]:
        for opener in openers:
            found = [(m.start(), m[1].strip(), _object_at(text, m.end())) for m in re.finditer(opener, text) if m[1].strip() in names]
            if kept := [c for c in found if c[2] is not None]:
                return kept
        return []

    return read


def _blocks(block: str, head: str, pairs: str, inner: str = "") -> Callable[[str, frozenset[str]], list[Call]]:
    """Calls in blocks: a name by ``head``, and arguments as pairs of name and value; ``inner`` splits a block into several calls."""

    def read(text: str, names: frozenset[str]) -> list[Call]:
        out = []
        for outer in re.finditer(block, text, re.S):
            for part in re.finditer(inner, outer[1], re.S) if inner else (outer,):
                body = part[0] if inner else part[1]
                name = re.search(head, body.strip())
                if name and name[1].strip() in names:
                    out.append((outer.start(), name[1].strip(), {m[1].strip(): _value(m[2].strip()) for m in re.finditer(pairs, body, re.S)}))
        return out

    return read


def _paired_tags(text: str, names: frozenset[str]) -> list[Call]:
    """Keys and values in tags of their own; a block with unequal numbers of them is no call."""
    out = []
    for m in re.finditer(r"<tool_call>\s*([^<\s]+)(.*?)</tool_call>", text, re.S):
        keys, values = (re.findall(rf"<arg_{x}>\s*(.*?)\s*</arg_{x}>", m[2], re.S) for x in ("key", "value"))
        if m[1] in names and len(keys) == len(values):
            out.append((m.start(), m[1], {k: _value(v) for k, v in zip(keys, values, strict=True)}))
    return out


def _bare(text: str, names: frozenset[str]) -> list[Call]:
    """A name right before an object; the longest name that fits."""
    known = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return _before_objects(rf"({known})\s*(?=\{{)")(text, names) if names else []


#: A string between quote tokens, a bracket, a key, or anything else.
_PIECE = re.compile(r'<\|"\|>(?P<string>.*?)<\|"\|>|(?P<brace>[{}])|(?P<key>\w+)(?=\s*:)|(?:[^<{}\w]+|.)', re.S)


def _quote_tokens(text: str, names: frozenset[str]) -> list[Call]:
    """Objects with bare keys whose strings stand between quote tokens: written as JSON piece by piece, up to the closing brace."""
    out = []
    for call in re.finditer(r"<\|tool_call>call:([^\s{]+)\s*(?=\{)", text):
        depth, made = 0, []
        for piece in _PIECE.finditer(text, call.end()):
            bare = piece[piece.lastgroup] if piece.lastgroup in ("string", "key") else None
            made.append(piece[0] if bare is None else json.dumps(bare, ensure_ascii=False))
            depth += {"{": 1, "}": -1}.get(piece["brace"], 0)
            if not depth:
                break
        found = None if depth else _object_at("".join(made), 0)
        if found is not None and call[1] in names:
            out.append((call.start(), call[1], found))
    return out


def _named_arguments(text: str, at: int) -> dict:
    """The arguments ``key=value`` from ``at`` to the bracket that closes them; commas and brackets in quotes are text."""
    given, key, begin, quote = {}, "", at, ""
    while at < len(text):
        c = text[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'" and key and not text[begin:at].strip():
            quote = c
        elif c == "=" and not key:
            key, begin = text[begin:at].strip(), at + 1
        elif c in ",)":
            value = text[begin:at].strip()
            if key and value:
                given[key] = _value(value[1:-1] if value[0] in "\"'" and value[-1] == value[0] and len(value) > 1 else value)
            key, begin = "", at + 1
            if c == ")":
                break
        at += 1
    return given


def _pythonic(text: str, names: frozenset[str]) -> list[Call]:
    """A bracketed list of calls with named arguments: the first bracket alone."""
    bracket = re.search(r"\[([^\[\]]+)\]", text)
    if not bracket or not names:
        return []
    known = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return [(bracket.start(), m[1], _named_arguments(bracket[1], m.end())) for m in re.finditer(rf"({known})\(", bracket[1])]


@dataclass(frozen=True)
class Format:
    """``hints`` are what a template holds that asks for the format, ``markers`` what opens a call."""

    name: str
    read: Callable[[str, frozenset[str]], list[Call]] | None
    hints: tuple[str, ...] = ()
    markers: tuple[str, ...] = field(default=())


#: Marks of the formats, in the order in which they're tried.
FORMATS = (
    Format("fullwidth", _before_objects(r"<｜tool▁call▁begin｜>\s*(\S+?)\s*<｜tool▁sep｜>\s*"), ("tool▁call▁begin", "tool▁calls▁begin"), ("<｜tool▁call▁begin｜>", "<｜tool▁calls▁begin｜>")),
    Format("sections", _before_objects(r"<\|tool_call_begin\|>\s*(?:functions\.)?(\S+?)(?::\d+)?\s*<\|tool_call_argument_begin\|>\s*"), ("<|tool_call_begin|>", "tool_calls_section"), ("<|tool_call_begin|>", "<|tool_calls_section_begin|>")),
    Format("channel", _before_objects(r"to=functions\.([^<\s]+)\s*<\|channel\|>[^<]*<\|message\|>", r"<\|channel\|>\w+ to=functions\.([^<\s]+).*?<\|message\|>"), ("to=functions.", "<|channel|>"), ("to=functions.", "<|channel|>commentary")),
    Format("quote_tokens", _quote_tokens, ("<|tool_call>call:",), ("<|tool_call>call:",)),
    Format("invoke", _blocks(r"<minimax:tool_call>\s*(.*?)\s*</minimax:tool_call>", r'^<invoke\s+name="([^"]+)">', r'<parameter\s+name="([^"]+)">\s*(.*?)\s*</parameter>', r'<invoke\s+name="[^"]+">.*?</invoke>'), ("minimax:tool_call",), ("<minimax:tool_call>",)),
    Format("paired_tags", _paired_tags, ("<arg_key>",), ("<tool_call>",)),
    Format("parameters", _blocks(r"<tool_call>\s*(.*?)\s*</tool_call>", r"<function=([^>]+)>", r"<parameter=([^>]+)>\s*(.*?)\s*</parameter>"), ("<tool_call>",), ("<tool_call>",)),
    Format("bracketed", _before_objects(r"\[TOOL_CALLS\]\s*(\S+?)\s*\[ARGS\]\s*"), ("[TOOL_CALLS]",), ("[TOOL_CALLS]",)),
    Format("bare", _bare),
    Format("pythonic", _pythonic),
    Format("function_call", None, ("<function_call>",), ("<function_call>",)),
)
#: All marks that open a call, in the order in which a stream is looked through for them.
MARKERS = (
    "<tool_call>", "<function_call>", "<minimax:tool_call>", "<|tool_call_begin|>", "<|tool_calls_section_begin|>", "<｜tool▁call▁begin｜>", "<｜tool▁calls▁begin｜>", "[TOOL_CALLS]", "to=functions.",
    "<|channel|>commentary", "<|tool_call>call:",
)


def detect(template: str) -> tuple[tuple[str, ...], tuple[str, ...], bool]:
    """(formats, markers, whether bare names count) that a template asks for; one without any hint may be any."""
    every = tuple(f.name for f in FORMATS if f.read)
    asked = [f for f in FORMATS if f.hints and any(h in template for h in f.hints)]
    if not asked:
        return every, MARKERS, True
    wanted = {m for f in asked for m in f.markers}
    return tuple(f.name for f in FORMATS if f.read and (not f.hints or f in asked)), tuple(m for m in MARKERS if m in wanted), False


def sane(found, names: frozenset[str]) -> tuple[str, object] | None:
    """(name, arguments) of an object that calls a known tool, in or without ``function``; ``parameters`` are arguments."""
    if not isinstance(found, dict):
        return None
    call = found.get("function", found)
    if isinstance(call, str):
        call = {**found, "name": call}
    if not isinstance(call, dict) or not isinstance(call.get("name"), str) or call["name"] not in names:
        return None
    return call["name"], call.get("arguments", call.get("parameters", {}))


def json_objects(text: str) -> Iterator[tuple[int, dict]]:
    """Complete JSON objects in a text with their places, from the left, none inside another.  An opening brace that starts none is text."""
    at = text.find("{")
    while at >= 0:
        try:
            found, end = _JSON.raw_decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            yield at, found
        at = text.find("{", end)


def _generic(text: str, names: frozenset[str]) -> list[Call]:
    """Objects in code fences, else in tags, else by themselves."""
    for enclosed in (r"```[^\n]*\n(?P<body>.*?)```", r"<(?P<tag>[^>]+)>(?P<body>.*?)</(?P=tag)>", r"(?P<body>.*)"):
        out = [(m.start(), *call) for m in re.finditer(enclosed, text, re.S) for _, o in json_objects(m["body"]) if (call := sane(o, names))]
        if out:
            return out
    return []


def calls(text: str, names: frozenset[str], formats: tuple[str, ...] | None = None) -> list[tuple[str, str]]:
    """(name, arguments as JSON) of calls of known tools by the first format that finds any; reasoning is left out unless it's all there is."""
    content = split_block(text)[1]
    content = content if content.strip() else text
    for f in FORMATS:
        if f.read and (formats is None or f.name in formats) and (found := f.read(content, names)):
            break
    else:
        found = _generic(content, names)
    return [(name, given if isinstance(given, str) else json.dumps(given, ensure_ascii=False)) for _, name, given in found]


def tool_calls(text: Column, names: tuple[str, ...], formats: tuple[str, ...] | None = None) -> Column:
    """Array of (name, arguments); empty without calls or text."""
    known = frozenset(names)

    @F.arrow_udf("array<struct<name:string,arguments:string>>")
    def parse(column: pa.Array) -> pa.Array:
        return pa.array([[{"name": n, "arguments": a} for n, a in calls(t or "", known, formats)] for t in column.to_pylist()], _KIND)

    return parse(text)


def held_back(text: Column, names: tuple[str, ...] = (), markers: tuple[str, ...] = MARKERS, bare_names: bool = False, partial: bool = True) -> Column:
    """Whether what a stream has sent so far may be a call: a mark or a name before a brace stands in it, or it ends with the start of one.

    ``text`` is content without reasoning.  At the end of a stream, ``partial`` starts are ordinary text.
    """
    whole = [F.contains(text, F.lit(m)) for m in MARKERS] + [F.contains(text, F.lit(n + b)) for n in names for b in ("{", " {")]
    begun = {m[:k] for m in markers for k in range(1, len(m))} | {n[:k] for n in names if bare_names for k in range(1, len(n) + 1)}
    checks = whole + [F.endswith(text, F.lit(p)) for p in sorted(begun)] * partial
    out = checks[0]
    for c in checks[1:]:
        out = out | c
    return out
