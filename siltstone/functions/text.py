"""Text functions as Spark columns.  Regular expressions use Unicode classes; offsets are code points."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: English function words that are removed by default.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it
    it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above
    below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such
    no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn
    didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn
    wasn't weren weren't won won't wouldn wouldn't
    """.split()
)
#: A word is a run of letters, numbers and underscores.
WORD_OR_NOT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_tokens(text: Column) -> Column:
    """The runs between ASCII white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _by_word(text: Column, change) -> Column:
    """``change`` applied to each word and each run between words."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(WORD_OR_NOT), F.lit(0)), change), "")


def smart_lower(text: Column) -> Column:
    """Lower case, but words of ASCII capitals and underscores stay."""
    return _by_word(text, lambda p: F.when(p.rlike("^[A-Z_]+$"), p).otherwise(F.lower(p)))


def _numbers(text: Column, change, least: int) -> Column:
    return _by_word(text, lambda p: F.when(p.rlike(f"^[0-9]{{{least},}}$"), change(p)).otherwise(p))


def digits_to_letters(text: Column, least: int = 1) -> Column:
    """Each digit of a word of at least ``least`` digits and nothing else as the letter with its number: 0 is A."""
    return _numbers(text, lambda p: F.translate(p, "0123456789", "ABCDEFGHIJ"), least)


def digits_to_runs(text: Column, least: int = 1) -> Column:
    """Each digit of such a word as its letter, repeated by its place from the right: 305 is DDDAAF."""

    def runs(number: Column) -> Column:
        letters = F.split(F.translate(number, "0123456789", "ABCDEFGHIJ"), "(?<=.)(?=.)")
        return F.array_join(F.transform(letters, lambda x, i: F.repeat(x, F.size(letters) - i)), "")

    return _numbers(text, runs, least)


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = ["", *"thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()]


def number_words(digits: str) -> str:
    """A number in British words, without commas; one beyond the decillions stays as it is."""
    number = int(digits)
    if number >= 1000 ** len(_SCALES):
        return digits

    def below_thousand(n: int) -> str:
        hundreds, rest = divmod(n, 100)
        small = _ONES[rest] if rest < 20 else _TENS[rest // 10] + (f"-{_ONES[rest % 10]}" if rest % 10 else "")
        return f"{_ONES[hundreds]} hundred" + (f" and {small}" if rest else "") if hundreds else small

    if number < 1000:
        return below_thousand(number)
    parts, scale = [], 0
    rest, low = divmod(number, 1000)
    while rest:
        rest, group = divmod(rest, 1000)
        scale += 1
        if group:
            parts.insert(0, f"{below_thousand(group)} {_SCALES[scale]}")
    if low:
        parts.append(f"and {below_thousand(low)}" if low < 100 else below_thousand(low))
    return " ".join(parts)


def digits_to_words(text: Column, least: int = 1) -> Column:
    """Words of digits alone in British words."""

    @F.arrow_udf("string")
    def spelled(column: pa.Array) -> pa.Array:
        number = re.compile(rf"(?<![^\W])[0-9]{{{least},}}(?![^\W])")
        return pa.array([t if t is None else number.sub(lambda m: number_words(m[0]), t) for t in column.to_pylist()], pa.string())

    return spelled(text)


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")


def merge_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def remove_stop_words(text: Column, words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Drops words of the list, case counts; what stands between words stays."""
    return F.array_join(F.filter(F.regexp_extract_all(text, F.lit(WORD_OR_NOT), F.lit(0)), lambda p: ~p.isin(*words)), "")


#: The passes of clean-up in order: kind, pattern, replacement, modes (c conservative, s scanned, h hyphens are joined).
_GAP, _JOINED = r"[^\S\n]", r"[\p{L}\p{Nl}\p{No}]"
CLEAN_PASSES = (
    ("byte_order_mark", r"\A\x{FEFF}", "", "cs"),
    ("line_endings", r"\r\n?", "\n", "cs"),
    ("paragraph_separators", r"[\x{2029}\f]", "\n\n", "cs"),
    ("line_separators", r"\x{2028}", "\n", "cs"),
    ("furniture_lines", rf"(?im)^{_GAP}*(?:\d+|(?:page|chapter){_GAP}+(?:\d+|[ivxlcdm]+)){_GAP}*(?:\n|\z)", "", "s"),
    ("soft_hyphen_wraps", rf"(?<={_JOINED})\x{{AD}}{_GAP}*\n{_GAP}*(?={_JOINED})", "", "cs"),
    ("soft_hyphens", r"\x{AD}", "", "cs"),
    ("ocr_wraps", rf"(?<={_JOINED})\x{{AC}}{_GAP}*\n{_GAP}*(?={_JOINED})", "", "s"),
    ("hyphenated_wraps", rf"(?<={_JOINED})-{_GAP}*\n{_GAP}*(?={_JOINED})", "", "h"),
    ("horizontal_whitespace", rf"{_GAP}+", " ", "cs"),
    ("paragraph_whitespace", r" *\n(?: *\n)+ *", "\n\n", "cs"),
    ("line_wraps", r"(?<!\n) *\n *(?!\n)", " ", "cs"),
)


def clean_passes(mode: str, join_hyphens: bool) -> list[tuple[str, str, str]]:
    wanted = {"none": "", "conservative": "c", "scanned_book": "s"}[mode]
    return [(kind, pattern, new) for kind, pattern, new, modes in CLEAN_PASSES if wanted and (wanted in modes or (join_hyphens and modes == "h"))]


def clean(text: Column, join_hyphens: bool = False, mode: str = "conservative") -> Column:
    """Clean-up of byte order mark, line ends, soft hyphens, runs of blanks, wrapped lines and paragraph breaks; scanned books also lose page furniture."""
    for _, pattern, new in clean_passes(mode, join_hyphens):
        text = F.regexp_replace(text, f"(?U){pattern}", new)
    return text


_CLEANED = pa.struct([
    ("text", pa.string()), ("offsets", pa.list_(pa.int32())), ("counts", pa.map_(pa.string(), pa.int32())), ("changes", pa.int32()),
    ("snippets", pa.list_(pa.struct([("kind", pa.string()), ("before", pa.string()), ("after", pa.string())]))),
])


def clean_one(text: str, mode: str = "conservative", join_hyphens: bool = False, with_offsets: bool = True) -> dict:
    """The cleaned text, for each of its characters the offset it came from, and what was changed: counts and a first sample by kind."""
    offsets, counts, snippets = np.arange(len(text) if with_offsets else 0, dtype=np.int32), {}, []
    for kind, pattern, new in clean_passes(mode, join_hyphens):
        edits = [m.span() for m in regex.finditer(_python_pattern(pattern), text) if m[0] != new]
        if not edits:
            continue
        counts[kind] = len(edits)
        if len(snippets) < 10:
            s, e = edits[0]
            left, right = text[max(0, s - 40) : s], text[e : e + 40]
            snippets.append({"kind": kind, "before": (left + text[s:e][:80] + right)[:160], "after": (left + new + right)[:160]})
        kept = [0, *(x for span in edits for x in span), len(text)]
        parts = list(zip(kept[::2], kept[1::2], strict=True))
        if not with_offsets:
            text = new.join(text[a:b] for a, b in parts)
            continue
        made = [np.repeat(offsets[s], len(new)) for s, _ in edits]
        text = new.join(text[a:b] for a, b in parts)
        offsets = np.concatenate([x for (a, b), add in zip(parts, [*made, offsets[:0]], strict=True) for x in (offsets[a:b], add)])
    return {"text": text, "offsets": offsets, "counts": list(counts.items()), "changes": sum(counts.values()), "snippets": snippets}


@functools.cache
def _python_pattern(pattern: str):
    return regex.compile(pattern.replace(r"\z", r"\Z").replace(r"\x{FEFF}", "\ufeff").replace(r"\x{2029}", "\u2029").replace(r"\x{2028}", "\u2028").replace(r"\x{AD}", "\xad").replace(r"\x{AC}", "\xac"))


def clean_report(text: Column, mode: str = "conservative", join_hyphens: bool = False) -> Column:
    """Struct of text, offsets, counts, changes and snippets; null stays null.  Without any pass offsets are null: each character stands where it stood."""
    if not clean_passes(mode, join_hyphens):
        same = F.struct(text.alias("text"), F.lit(None).alias("offsets"), F.create_map().alias("counts"), F.lit(0).alias("changes"), F.array().alias("snippets"))
        return F.when(text.isNotNull(), same.cast(from_arrow_type(_CLEANED)))

    @F.arrow_udf(from_arrow_type(_CLEANED))
    def run(column: pa.Array) -> pa.Array:
        return in_slices(column, lambda t: clean_one(t, mode, join_hyphens), _CLEANED)

    return run(text)


def clean_counts(text: Column, mode: str = "conservative", join_hyphens: bool = False) -> Column:
    """Struct of counts and snippets alone: neither texts nor offsets are kept, so that a task holds those of one text; null stays null."""
    kind = pa.struct([_CLEANED.field("counts"), _CLEANED.field("snippets")])

    @F.arrow_udf(from_arrow_type(kind))
    def run(column: pa.Array) -> pa.Array:
        def changed(t: str) -> dict:
            made = clean_one(t, mode, join_hyphens, with_offsets=False)
            return {"counts": made["counts"], "snippets": made["snippets"]}

        return in_slices(column, changed, kind)

    return run(text)


def in_slices(column: pa.Array, change, kind: pa.DataType, rows: int = 128) -> pa.Array:
    """``change`` of each text of a column; of texts and results as Python objects only those of ``rows`` rows are held at a time."""
    made = [pa.array([t if t is None else change(t) for t in column.slice(at, rows).to_pylist()], kind) for at in range(0, len(column), rows)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def source_span(cleaned: Column, start: Column, stop: Column, size: Column | None = None) -> Column:
    """Where ``start`` to ``stop`` of a cleaned text stood in its source; an empty or outlying span is an error.

    ``size`` is the cleaned text's length, for callers with many spans of one text: it's counted anew for each otherwise.
    """
    same = cleaned.offsets.isNull()
    size = F.length(cleaned.text) if size is None else size
    bad = (start < 0) | (start >= stop) | (stop > F.when(same, size).otherwise(F.size(cleaned.offsets)))
    found = F.struct(F.when(same, start).otherwise(F.get(cleaned.offsets, start)).alias("start"), F.when(same, stop).otherwise(F.get(cleaned.offsets, stop - 1) + 1).alias("stop"))
    return F.when(bad, F.raise_error(F.lit("no such span of the cleaned text"))).otherwise(found)


def assemble_context(parts: Column, prefix: str, separator: str, postfix: str) -> Column:
    """Prefix, the parts with separators between them, postfix."""
    return F.concat(F.lit(prefix), F.array_join(parts, separator), F.lit(postfix))


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the next ``end``; null without both."""
    after = F.when(F.contains(text, F.lit(start)), F.substring(text, F.instr(text, start) + len(start), F.length(text)))
    return F.when(F.contains(after, F.lit(end)), F.substring_index(after, end, 1))


def without_tagged(text: Column, start: str, end: str) -> Column:
    """The text without its tagged parts, tags included."""
    return F.regexp_replace(text, rf"(?s)\Q{start}\E.*?\Q{end}\E", "")


def fill_names(text: Column, user: Column, char: Column) -> Column:
    """Placeholders of both spellings replaced by the names."""
    for mark, name in (("{{user}}", user), ("{{char}}", char), ("<USER>", user), ("<BOT>", char)):
        text = F.replace(text, F.lit(mark), name)
    return text


def trim_framing(text: Column, before: tuple[str, ...], after: tuple[str, ...]) -> Column:
    """Without any of ``before`` at its start and of ``after`` at its end, repeated and with white space between them."""
    either = lambda marks: "|".join(rf"\Q{m}\E" for m in marks)
    text = F.regexp_replace(text, rf"(?U)^(?:\s|{either(before)})+", "") if before else strip(text)
    return F.regexp_replace(text, rf"(?U)(?:\s|{either(after)})+$", "") if after else text


def preprocess(text: Column, lower: bool = False, punctuation: bool = False, stop_words: bool = False, spaces: bool = False, numbers: str = "") -> Column:
    """The steps in their fixed order: lower case, punctuation, stop words, spaces, ends, numbers (letters, runs or words)."""
    text = smart_lower(text) if lower else text
    text = strip_punctuation(text) if punctuation else text
    text = remove_stop_words(text) if stop_words else text
    text = merge_spaces(text) if spaces else text
    return {"": lambda t: t, "letters": digits_to_letters, "runs": digits_to_runs, "words": digits_to_words}[numbers](strip(text))


def asks_memory(text: Column) -> Column:
    """Whether a message starts a line or ends with the mark of a manual query."""
    return text.rlike(r"(?m)^\s*!c|!c\s*\z")


def without_memory_mark(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"^\s*!c|!c\s*\z", ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all words of two arrays of distinct words; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def regex_chunks(text: Column, pattern: str, context: int) -> Column:
    """Array of (start, stop, text, context_text) for each match of a pattern, with ``context`` characters on both sides."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string()), ("context_text", pa.string())]))

    @F.arrow_udf(from_arrow_type(kind))
    def cut(column: pa.Array) -> pa.Array:
        found = re.compile(pattern)
        row = lambda t, m: {"start": m.start(), "stop": m.end(), "text": m[0], "context_text": t[max(0, m.start() - context) : m.end() + context]}
        return pa.array([[row(t, m) for m in found.finditer(t)] for t in (t or "" for t in column.to_pylist())], kind)

    return cut(text)


def natural_key(text: Column) -> Column:
    """Sorts digit runs of any length as numbers and the rest in lower case: a run is led by the number of its digits."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    number = lambda p: F.concat(F.lit("\x01"), F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "")


def cut_at_stop(text: Column, stops: tuple[str, ...]) -> Column:
    """Up to the first stop string in the order of the list, or without the longest partial stop string at the end."""
    out = text
    for stop in reversed(stops):
        partial = [F.when(F.endswith(text, F.lit(stop[:n])), F.substring(text, F.lit(1), F.length(text) - n)) for n in range(len(stop) - 1, 0, -1)]
        out = F.coalesce(*partial, out) if partial else out
    for stop in reversed(stops):
        out = F.when(F.contains(text, F.lit(stop)), F.substring_index(text, stop, 1)).otherwise(out)
    return out
