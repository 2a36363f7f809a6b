"""Operator 5: benchmark leaks in documents, re-parameterised questions included.  DataFrame functions only.

Numbers, names (runs of capitalised words, but for function words of four languages that don't stand inside a sentence) and units
after numbers become typed placeholders.  Lower-cased template words are joined by the hash of windows of ``window`` words in two forms: with names
as placeholders, and, where too few of these are found, with their letters, so that a copy in other case is found too.  An item
leaks into a document when at least ``coverage`` of its windows stand there and its slots agree, inside the windows that matched,
each at its own shift:

- Of the values that stand more than once, on either side, the share that goes along with the commonest partner is at least
  ``agreement`` for names and ``number_agreement`` for numbers and for units.  A value that stands once tells nothing.
- Names that stand once and have changed need something to hold them: names that are equal or change alike at two places or more
  count twice, and literal words of content once; together they must be at least twice as many as such names.  So a renamed
  question is caught, and a sentence of the same build with other nouns, which some languages write like names, is not.
- Where more than half of the matched words are slots, all kinds together must agree by ``agreement``, values that stand once included.

An item of fewer than ``window`` template words, but ``shortest`` at least, is one window as long as itself.  Windows of nothing
but placeholders tell nothing and are no windows: without that, a table of numbers would meet itself at every shift.

Windows are made and probed inside one pass; the items' windows are broadcast only while they are at most
``broadcast_windows``, beyond that both sides are shuffled by hash.  Texts are read again for documents that matched alone.

Nulls, empty texts, and items of fewer than ``shortest`` template words or of placeholders alone match nothing.  Rows that share a
doc_id are one document; repeated item_ids pool their windows.  An empty table on either side gives an empty result; other columns are
ignored, whatever their names.  Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.storage import Workspace

#: Units that stand after a number.
UNITS = "kg|g|mg|km|m|cm|mm|mi|ft|in|lb|oz|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|feet|inches|pounds?|dollars?|euros?|cents?|percent|degrees?|litres?|liters?|grams?|kilograms?|kilometers?|kilometres?"
NAME, NUMBER, UNIT = "⟦name⟧", "⟦num⟧", "⟦unit⟧"
#: Words that are no names where a sentence or a quote starts with them, and no words of content anywhere.
FUNCTION_WORDS = (
    "The|An|And|But|Or|Nor|So|Yet|If|Then|Than|When|While|Where|Who|Whom|Whose|Which|What|Why|How|That|This|These|Those|There|Here|He|She|It|We|You|They|His|Her|Its|Our|Your|Their|My|"
    "Is|Are|Was|Were|Be|Am|Do|Does|Did|Has|Have|Had|Can|Could|Will|Would|Shall|Should|May|Might|Must|Not|No|Of|In|On|At|By|For|From|With|To|As|After|Before|During|Each|Every|All|Some|Any|Both|One|Now|Also|"
    "Der|Die|Das|Den|Dem|Des|Ein|Eine|Einen|Einem|Einer|Eines|Und|Oder|Aber|Wenn|Als|Wie|Was|Wer|Wo|Warum|Er|Sie|Es|Wir|Ihr|Ich|Ist|Sind|War|Waren|Hat|Haben|Wird|Werden|Nicht|Kein|Keine|Im|Am|Auf|Aus|Bei|Mit|Nach|Von|Zu|Zum|Zur|Vor|Neben|Unter|Zwischen|Durch|Ohne|Um|Bis|Seit|Auch|Dann|Noch|Nur|Schon|Sehr|Dieser|Diese|Dieses|"
    "Le|La|Les|Un|Une|Du|De|Et|Ou|Mais|Si|Quand|Comme|Que|Qui|Quoi|Pourquoi|Il|Elle|Nous|Vous|Ils|Elles|Je|Est|Sont|Sur|Sous|Dans|Avec|Sans|Par|Pour|Ce|Cet|Cette|Ces|Au|Aux|"
    "El|Los|Las|Unos|Unas|Una|Uno|Del|Al|Pero|Cuando|Como|Qué|Quién|Por|Para|Con|Sin|Sobre|Entre|Hasta|Desde|Él|Ella|Nosotros|Ellos|Ellas|Yo|Es|Son|Era|Este|Esta|Estos|Estas|Se|Su|Sus|Más|Muy|También|Donde|Dónde"
)
#: The groups that repeat are possessive, which changes no match: Java calls itself for each word of a greedy one, and a long run of them ends the executor.
_NAME = rf"(?=\p{{Lu}})(?:.(?<=[\p{{Ll}},;:] .)\p{{L}}+|(?<!\p{{L}})(?!(?:{FUNCTION_WORDS})(?!\p{{L}})).\p{{L}}+)(?: \p{{Lu}}\p{{L}}+)*+"
_NUMBER = r"\d+(?:[.,:/]\d+)*+"
_UNIT = rf"(?<={NUMBER}) ?(?:{UNITS})(?!\p{{L}})"
_SEPARATORS = r"[^\p{L}\p{M}\p{Nd}⟦⟧]+"


@dataclass(frozen=True)
class DecontaminationConfig:
    window: int = 5
    shortest: int = 3
    coverage: float = 0.5
    agreement: float = 0.75
    number_agreement: float = 0.5
    broadcast_windows: int = 1_000_000
    broadcast_docs: int = 1_000_000


def template(text: Column, names: bool = True) -> Column:
    """The text with typed placeholders, in lower case."""
    text = F.coalesce(text, F.lit(""))
    text = F.regexp_replace(text, _NAME, NAME) if names else text
    text = F.regexp_replace(text, _NUMBER, NUMBER)
    return F.lower(F.regexp_replace(text, _UNIT, f" {UNIT}"))


def template_words(text: Column, names: bool = True) -> Column:
    return F.array_remove(F.split(template(text, names), _SEPARATORS), "")


def slot_values(text: Column) -> Column:
    """The original strings of all placeholders of ``template`` by kind, in order of standing."""
    text = F.coalesce(text, F.lit(""))
    named = F.regexp_replace(text, _NAME, NAME)
    numbered = F.regexp_replace(named, _NUMBER, NUMBER)
    return F.struct(
        F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)).alias("names"),
        F.regexp_extract_all(named, F.lit(_NUMBER), F.lit(0)).alias("numbers"),
        F.transform(F.regexp_extract_all(numbered, F.lit(_UNIT), F.lit(0)), F.trim).alias("units"),
    )


#: The two forms of a template: names as placeholders, and with their letters.
FORMS = ((1, True), (2, False))


def _hashed(rows: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, w1, w2): the hashes of the template words of ``text`` in both forms."""
    return rows.select(*ids, *(F.transform(template_words(F.col("text"), names), lambda w: F.xxhash64(w)).alias(f"w{form}") for form, names in FORMS))


def _window_hash(form: int, words: Column, at: Column, size: int) -> Column:
    """The hash of ``size`` words from ``at`` on; single words cost less to read than a slice."""
    return F.xxhash64(F.lit(form), *(F.get(words, at + k) for k in range(size)))


def _spread(words: DataFrame, ids: list[str], sizes: list[int]) -> DataFrame:
    """(ids, n1, n2, pos, h): windows of each of ``sizes`` words, numbered through all forms and sizes; one row of nulls where there is none.

    No filter stands on the words and the generator is an outer one: Spark would copy the whole chain of expressions
    into each filter that it pushes down or infers.
    """

    def windows(form: int, size: int) -> Column:
        column = F.col(f"w{form}")
        made = F.transform(F.sequence(F.lit(0), F.size(column) - size), lambda i: _window_hash(form, column, i, size))
        return F.when(F.size(column) >= size, made).otherwise(F.array().cast("array<bigint>"))

    every = F.concat(*(windows(form, size) for form, _ in FORMS for size in sizes))
    return words.select(*ids, F.size("w1").alias("n1"), F.size("w2").alias("n2"), every.alias("hs")).select(*ids, "n1", "n2", F.posexplode_outer("hs").alias("pos", "h"))


def _place(sizes: list[int]) -> Column:
    """The place in its text of window ``pos`` of ``_spread``, given the item's ``form`` and ``size``."""
    before, out = F.lit(0), F.lit(None).cast("int")
    for form, _ in FORMS:
        for size in sizes:
            out = F.when((F.col("form") == form) & (F.col("size") == size), F.col("pos") - before).otherwise(out)
            before = before + F.greatest(F.col(f"n{form}") - (size - 1), F.lit(0))
    return out


def _item_windows(items: DataFrame, cfg: DecontaminationConfig) -> DataFrame:
    """(item_id, form, item_pos, size, h) of the items' windows, without those of placeholders alone."""
    words = _hashed(items, ["item_id"])
    parts = []
    for form, _ in FORMS:
        column = F.col(f"w{form}")
        size = F.least(F.lit(cfg.window), F.size(column))
        slots = F.transform(F.array(*(F.lit(x) for x in (NAME, NUMBER, UNIT))), lambda x: F.xxhash64(x))
        made = F.transform(F.sequence(F.lit(0), F.size(column) - size), lambda i: F.struct(i.alias("item_pos"), F.slice(column, i + 1, size).alias("words")))  # noqa: B023
        rows = words.where(F.size(column) >= cfg.shortest).select("item_id", F.lit(form).alias("form"), size.alias("size"), F.explode(made).alias("w"))
        rows = rows.where(F.size(F.array_except("w.words", slots)) > 0)
        hashes = [F.when(F.col("size") == k, _window_hash(form, F.col("w.words"), F.lit(0), k)) for k in range(1, cfg.window + 1)]
        parts.append(rows.select("item_id", "form", "w.item_pos", "size", F.coalesce(*hashes).alias("h")))
    return parts[0].unionByName(parts[1])


def _with_slots(rows: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, form, slots, plain), for each form: position, kind and value of every slot; position and letters of every word of content."""

    def slots_of(words: Column, kind: str, name: str) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w == kind, i)), lambda i: i.isNotNull())
        return F.zip_with(at, F.col(f"values.{name}"), lambda p, v: F.struct(p.alias("pos"), F.lit(name).alias("kind"), F.lower(v).alias("value")))

    forms = []
    for form, names in FORMS:
        text = F.col("text") if names else F.lower("text")  # small letters alone hold no names
        made = rows.select(*ids, template_words(F.col("text"), names).alias("words"), slot_values(text).alias("values"))
        plain = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda p: ~p.word.isin([NAME, NUMBER, UNIT, *FUNCTION_WORDS.lower().split("|")]))
        slots = [slots_of(F.col("words"), NUMBER, "numbers"), slots_of(F.col("words"), UNIT, "units"), *([slots_of(F.col("words"), NAME, "names")] if names else [])]
        forms.append(made.select(*ids, F.lit(form).alias("form"), F.filter(F.concat(*slots), lambda s: s.pos.isNotNull()).alias("slots"), plain.alias("plain")))
    return forms[0].unionByName(forms[1])


def _pairs(met: Column) -> Column:
    """Each distinct (kind, ours, theirs) of ``met`` with the number n of its places."""
    distinct = F.array_distinct(F.transform(met, lambda m: F.struct(m.kind.alias("kind"), m.ours.alias("ours"), m.theirs.alias("theirs"))))
    same = lambda p: F.filter(met, lambda m: (m.kind == p.kind) & (m.ours == p.ours) & (m.theirs == p.theirs))
    return F.transform(distinct, lambda p: F.struct(p.kind.alias("kind"), p.ours.alias("ours"), p.theirs.alias("theirs"), F.size(same(p)).alias("n")))


def _agreement(pairs: Column, least: int = 1) -> Column:
    """The share of places that the commonest partner of each value accounts for, in the worse direction; of values at ``least`` places alone."""

    def one_way(name: str) -> Column:
        values = F.array_distinct(F.transform(pairs, lambda p: F.struct(p.kind.alias("kind"), p[name].alias("value"))))
        counts = lambda v: F.transform(F.filter(pairs, lambda p: (p.kind == v.kind) & (p[name] == v.value)), lambda p: p.n)
        summed = lambda xs: F.aggregate(xs, F.lit(0), lambda a, n: a + n)
        shares = F.filter(F.transform(values, lambda v: F.struct(F.array_max(counts(v)).alias("best"), summed(counts(v)).alias("all"))), lambda s: s["all"] >= least)
        total = summed(F.transform(shares, lambda s: s["all"]))
        return F.when(total == 0, F.lit(1.0)).otherwise(summed(F.transform(shares, lambda s: s.best)) / total)

    return F.least(one_way("ours"), one_way("theirs"))


def _held(pairs: Column, content: Column) -> Column:
    """Whether names that stand once and have changed are outweighed by names that agree and words of content."""
    names = F.filter(pairs, lambda p: p.kind == "names")
    loose = F.size(F.filter(names, lambda p: (p.n == 1) & (p.ours != p.theirs)))
    firm = F.aggregate(F.filter(names, lambda p: (p.n > 1) | (p.ours == p.theirs)), F.lit(0), lambda a, p: a + p.n)
    return 2 * firm + content >= 2 * loose


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """(doc_id, item_id, hits, windows, slots, changed, coverage) for every item that leaks into a document."""
    ws = Workspace(spark, "leaks")
    docs, items = docs.select("doc_id", "text"), benchmark.select("item_id", "text").where("item_id is not null")
    item_windows = ws.save(_item_windows(items, cfg), "windows")
    few = item_windows.count() <= cfg.broadcast_windows
    sizes = sorted(r[0] for r in item_windows.select("size").distinct().collect())  # window sizes: at most cfg.window numbers
    probe = F.broadcast(item_windows) if few else item_windows
    found = _spread(_hashed(docs.where("doc_id is not null"), ["doc_id"]), ["doc_id"], sizes or [cfg.window]).join(probe, "h").withColumn("pos", _place(sizes or [cfg.window]))
    pair = ["doc_id", "item_id", "form"]
    shifts = found.groupBy(*pair, (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("item_pos").alias("at"))
    totals = item_windows.groupBy("item_id", "form").agg(F.countDistinct("item_pos").alias("windows"), F.max("size").alias("size"))
    best = shifts.select(*pair, "shift", F.size("at").alias("n"), F.explode("at").alias("item_pos")).groupBy(*pair, "item_pos").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    hits = best.groupBy(*pair).agg(F.count("*").alias("hits"), F.collect_list(F.struct("item_pos", "shift")).alias("aligned"))
    hits = ws.save(hits.join(totals, ["item_id", "form"]).where(F.col("hits") >= cfg.coverage * F.col("windows")), "hits")

    ids = hits.select("doc_id").distinct()
    bounded = hits.count() <= cfg.broadcast_docs
    texts = _with_slots(docs.join(F.broadcast(ids) if bounded else ids, "doc_id", "left_semi"), ["doc_id"])
    pairs = hits.join(texts.drop("plain").withColumnRenamed("slots", "theirs"), ["doc_id", "form"]).join(_with_slots(items, ["item_id"]).withColumnRenamed("slots", "ours"), ["item_id", "form"])
    inside = lambda w: F.transform(
        F.filter("ours", lambda o: (o.pos >= w.item_pos) & (o.pos < w.item_pos + F.col("size"))), lambda o: F.struct(o.pos.alias("pos"), w["shift"].alias("shift"), o.kind.alias("kind"), o.value.alias("ours"))
    )
    pairs = pairs.withColumn("stood", F.array_distinct(F.flatten(F.transform("aligned", inside))))
    covered = F.array_distinct(F.flatten(F.transform("aligned", lambda w: F.sequence(w.item_pos, w.item_pos + F.col("size") - 1))))
    pairs = pairs.withColumn("covered", covered)
    content = F.size(F.array_distinct(F.transform(F.filter("plain", lambda p: F.array_contains("covered", p.pos)), lambda p: p.word)))
    opposite = lambda o: F.get(F.filter("theirs", lambda t: (t.pos == o.pos + o["shift"]) & (t.kind == o.kind)), F.lit(0)).value
    # a name beside the item's own in the document is a part of its run there, not another name
    same = lambda ours, theirs: F.when(F.endswith(theirs, F.concat(F.lit(" "), ours)) | F.startswith(theirs, F.concat(ours, F.lit(" "))), ours).otherwise(theirs)
    met = F.transform("stood", lambda o: F.struct(o.pos.alias("pos"), o.kind.alias("kind"), o.ours.alias("ours"), same(o.ours, opposite(o)).alias("theirs")))
    pairs = pairs.select(*pair, "hits", "windows", F.size("covered").alias("words"), content.alias("content"), F.filter(met, lambda m: m.theirs.isNotNull()).alias("met"))
    pairs = pairs.withColumn("paired", _pairs(F.col("met")))
    of = lambda kind: F.filter("paired", lambda p: p.kind == kind)
    names = (_agreement(of("names"), 2) >= cfg.agreement) & _held(F.col("paired"), F.col("content"))
    numbers = (_agreement(of("numbers"), 2) >= cfg.number_agreement) & (_agreement(of("units"), 2) >= cfg.number_agreement)
    literal = 2 * F.size(F.array_distinct(F.transform("met", lambda m: m.pos))) <= F.col("words")
    leaks = pairs.withColumn("leaks", names & numbers & (literal | (_agreement(F.col("paired")) >= cfg.agreement))).withColumn("met", F.array_distinct(F.transform("met", lambda m: F.struct(m.kind.alias("kind"), m.ours.alias("ours"), m.theirs.alias("theirs")))))
    changed = F.size(F.filter("met", lambda m: m.ours != m.theirs)).cast("long")
    # rows of one doc_id: the one that leaks counts; letters count only where the form with placeholders has too few windows
    row = F.struct("form", (~F.col("leaks")).alias("clean"), -F.col("hits"), F.col("hits").cast("long").alias("hits"), F.col("windows").cast("long").alias("windows"), F.size("met").cast("long").alias("slots"), changed.alias("changed"))
    out = leaks.groupBy("doc_id", "item_id").agg(F.min(row).alias("best")).where("not best.clean")
    return out.select("doc_id", "item_id", "best.hits", "best.windows", "best.slots", "best.changed", (F.col("best.hits") / F.col("best.windows")).alias("coverage"))


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """``docs`` without the documents that hold a leak."""
    return docs.join(find_leaks(spark, docs, benchmark, cfg).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all benchmark items in all documents."""
    return find_leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
