"""Quality flags, clean-up and word functions on small cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from siltstone.functions import sentences as S
from siltstone.functions import text as T


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def flags_of(spark, text):
    return [[f for f in s.flags if f != "short_reference"] for s in frame(spark, text).select(S.assessed(F.col("t"), True).alias("s")).first().s]


GOOD = "Three boats crossed the wide bay at dawn."


def framed(middle):
    """A sentence between two that have no flag: the flags of all three."""
    return f"{GOOD} {middle} The crew slept until late in the evening."


def test_no_flags_without_damage(spark):
    assert flags_of(spark, framed("Nobody on the shore had seen them leave.")) == [[], [], []]


def test_symbols_need_a_run_and_a_share(spark):
    """From three marks in a row, six in all and two fifths of what is visible."""
    for marks, letters, found in [("|||___", 5, True), ("|||___", 20, False), ("|| __ ¦¦", 2, False), ("|||__", 3, False), ("¦¦¦¦¦¦¦¦", 10, True)]:
        text = f"{GOOD} {marks} {'k' * letters}. {GOOD}"
        assert flags_of(spark, text)[1] == (["symbol_noise"] if found else []), text


def test_borders_inside_a_paragraph(spark):
    """A short rest in small letters behind a full stop casts doubt on both sides; a new paragraph, quotes, dots or a long rest don't."""
    head = "The ferry to the northern islands was late"
    both = [["suspicious_boundary"], ["suspicious_boundary"]]
    assert flags_of(spark, f"{head}. again today.") == both
    for join in (".\n\n", "... ", ".” ", ".\f"):
        assert flags_of(spark, f"{head}{join}again today.") == [[], []], join
    assert flags_of(spark, f"{head}. and it stayed away for the whole day.") == [[], []]
    assert flags_of(spark, f"{head.lower()}. again today.") == [[], []]
    assert flags_of(spark, "Late. again today.") == [[], []]


@pytest.mark.parametrize("word", ["if", "in", "of", "to"])
def test_borders_behind_function_words(spark, word):
    found = flags_of(spark, f"Every morning the baker thought {word}. new kinds of bread and of cake for us.")
    assert found == [["dangling_function_boundary"], ["dangling_function_boundary"]]
    assert flags_of(spark, f"Every morning the baker thought {word}. New kinds of bread and of cake came.") == [[], []]


@pytest.mark.parametrize("who", ["it", "He", "what", "There"])
def test_a_five_in_place_of_an_s(spark, who):
    assert flags_of(spark, f"{who} 5 s cold up here in winter.") == [["ocr_quote_digit"]]
    assert flags_of(spark, f"So {who} 5 s cold up here in winter.") == [[]] and flags_of(spark, f"{who} 5 sheep.") == [[]]


def test_a_digit_in_place_of_a_quote(spark):
    for verb in ("asked", "muttered", "shouted"):
        assert flags_of(spark, f"“Is the road open? 9 they {verb} from the cart.")[0] == ["ocr_quote_digit"]
    assert flags_of(spark, "“Is the road open?” they asked from the cart.") == [[]] and flags_of(spark, "Is the road open? 9 they asked from the cart.") == [[]]


@pytest.mark.parametrize(("lead", "found"), [("4\n\n", True), ("  4 \n \n", True), ("4\f", True), ("4 ", False), ("4\n", False), ("41\n\n", False)])
def test_a_digit_on_its_own_ahead(spark, lead, found):
    assert flags_of(spark, lead + GOOD) == [["leading_digit_paragraph"] if found else []]
    assert flags_of(spark, lead + "Go.") == [[]]


def test_policy_and_names(spark):
    row = frame(spark, "Yes. \x02 a long enough sentence stands here for this.").select(S.assessed(F.col("t")).alias("s")).select(F.transform("s", lambda s: S.exclusions(s.flags)).alias("b"), F.transform("s", lambda s: S.exclusions(s.flags, "off")).alias("o"), F.transform("s", lambda s: s.flags).alias("f")).first()
    assert row.f == [["short_reference"], ["control_character"]] and row.b == [[], ["control_character"]] and row.o == [[], []]
    with pytest.raises(ValueError, match="balanced"):
        S.exclusions(F.col("x"), "strict")


def test_word_counts_by_categories(spark):
    """Against a count by Unicode category, character by character."""
    rng = random.Random(4)
    letters = "ab9é世éक्ष-'’‐‑ʼ .,_\n²Ⅷ؀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(300)]

    def count(t):
        units, inside = 0, False
        for i, c in enumerate(t):
            k = unicodedata.category(c)[0]
            if k in "LN":
                units, inside = units + (not inside), True
            elif not (inside and (k == "M" or (c in "'’ʼ-‐‑" and i + 1 < len(t) and unicodedata.category(t[i + 1])[0] in "LN"))):
                inside = False
        return units, sum(unicodedata.category(c)[0] == "L" for c in t)

    got = frame(spark, *texts).select("i", S.word_count(F.col("t")).alias("w"), S.letter_count(F.col("t")).alias("l")).collect()
    assert [(r.w, r.l) for r in sorted(got)] == [count(t) for t in texts]


def test_clean_up(spark):
    text = "﻿  Lamps\tand\r\nbells ring.\r\n\r\n\r\n 31 \nchapter xii\nA long\xad\n way¬\nward re-\nturn.\x0cEnd"
    col = F.col("t")
    row = frame(spark, text).select(T.clean(col).alias("c"), T.clean(col, True, "scanned_book").alias("s"), T.clean_report(col, "scanned_book", True).alias("r"), T.clean(col, mode="none").alias("n")).first()
    assert row.c == " Lamps and bells ring.\n\n31 chapter xii A longway¬ ward re- turn.\n\nEnd" and row.n == text
    assert row.s == row.r.text == " Lamps and bells ring.\n\nA longwayward return.\n\nEnd"
    assert row.r.counts["furniture_lines"] == 2 and row.r.changes == sum(row.r.counts.values()) and row.r.snippets[0].kind == "byte_order_mark"
    kept = [(a, text[o]) for a, o in zip(row.r.text, row.r.offsets, strict=True) if not a.isspace()]
    assert all(a == b for a, b in kept) and row.r.offsets == sorted(row.r.offsets)


def test_spans_of_the_source(spark):
    source = "One\xad\ntwo  three"
    df = frame(spark, source).select(T.clean_report(F.col("t")).alias("c"))
    row = df.select("c.text", T.source_span(F.col("c"), F.lit(0), F.lit(6)).alias("a"), T.source_span(F.col("c"), F.lit(7), F.lit(12)).alias("b")).first()
    assert row.text == "Onetwo three" and source[row.a.start : row.a.stop] == "One\xad\ntwo" and source[row.b.start : row.b.stop] == "three"
    with pytest.raises(Exception, match="no such span"):
        df.select(T.source_span(F.col("c"), F.lit(3), F.lit(99))).collect()


def test_words_and_numbers(spark):
    col = F.col("t")
    row = frame(spark, "I saw 3 of NASA's a1b in HI_X and NASA_2: 305").select(
        T.smart_lower(col).alias("low"), T.digits_to_letters(col).alias("letters"), T.digits_to_letters(col, 2).alias("least"), T.digits_to_runs(col).alias("runs"), T.digits_to_words(col).alias("words"), T.remove_stop_words(col).alias("stop")
    ).first()
    assert row.low == "I saw 3 of NASA's a1b in HI_X and nasa_2: 305" and row.letters == "I saw D of NASA's a1b in HI_X and NASA_2: DAF" and row.least.startswith("I saw 3 of")
    assert row.runs.endswith(": DDDAAF") and row.words == "I saw three of NASA's a1b in HI_X and NASA_2: three hundred and five" and row.stop == "I saw 3  NASA' a1b  HI_X  NASA_2: 305"
    assert [T.number_words(x) for x in ("0", "21", "100", "1001", "1100", "2000013", "90000000000")] == [
        "zero", "twenty-one", "one hundred", "one thousand and one", "one thousand one hundred", "two million and thirteen", "ninety billion"
    ]


def test_small_text_functions(spark):
    col = F.col("t")
    row = frame(spark, "<a>one</a> x <a>two</a> {{user}} and <BOT>").select(
        T.between(col, "<a>", "</a>").alias("b"), T.without_tagged(col, "<a>", "</a>").alias("w"), T.fill_names(col, F.lit("Ada"), F.lit("Bo")).alias("f"), T.trim_framing(F.lit(" <s> <s>hi</s>\n"), ("<s>",), ("</s>",)).alias("t"),
        T.assemble_context(F.array(F.lit("p"), F.lit("q")), "[", "; ", "]").alias("c"), T.jaccard(T.word_set(F.lit("A b b c")), T.word_set(F.lit("b C d"))).alias("j"), T.regex_chunks(col, r"\w+>", 2).alias("r"),
        T.asks_memory(F.lit("what was it !c ")).alias("m"), T.without_memory_mark(F.lit("!c what was it")).alias("u"), T.preprocess(F.lit("  The CAT, 2 dogs "), lower=True, punctuation=True, stop_words=True, spaces=True, numbers="letters").alias("p"),
    ).first()
    assert (row.b, row.w, row.f, row.t, row.c, row.j) == ("one", " x  {{user}} and <BOT>", "<a>one</a> x <a>two</a> Ada and Bo", "hi", "[p; q]", 0.5)
    assert row.r[0].text == "a>" and row.r[0].context_text == "<a>on" and row.m and row.u == "what was it" and row.p == "CAT C dogs"


def test_replacing_a_sentence(spark):
    """Any sentence of a set takes the last one's place; whatever isn't one sentence as a whole is refused."""
    sound = ["Fog hid the pier.", "At 5 p.m. the bell rang.", "So it was late or early..."]
    for old in sound:
        for new in sound:
            df = frame(spark, f"{GOOD}\n{old} and so")
            assert df.select(S.replace_sentence(F.col("t"), F.lit(f"\t{new}\n")).alias("x")).first().x == f"{GOOD}\n{new} and so"
    df = frame(spark, GOOD)
    for bad in (" ", "no stop", " ".join(sound[:2]), sound[0] + " rest", "Dr."):
        with pytest.raises(Exception, match="one complete sentence"):
            df.select(S.replace_sentence(F.col("t"), F.lit(bad))).collect()
    with pytest.raises(Exception, match="one complete sentence"):
        frame(spark, "nothing to replace").select(S.replace_sentence(F.col("t"), F.lit(sound[0]))).collect()


def test_context(spark):
    row = frame(spark, "abcdef").select(S.context_of(F.col("t"), F.lit(2), F.lit(4), 1).alias("a"), S.context_of(F.col("t"), F.lit(0), F.lit(4)).alias("b")).first()
    assert tuple(row.a) == ("b", "e") and tuple(row.b) == ("", "ef")


def test_totals_of_every_pass(spark):
    import duckdb
    import pandas as pd

    from siltstone.plans import documents

    texts = ["\ufeffa\r\nb\rc\n\nd", "so\xad\nft hy\xadphen\xad \n x", "a\u2029b\fc\u2028d", "two  blanks\t\tand\u00a0one \n \n end\n\n\nlast \n line", "plain", "", None, "a\xad\nb\xad\nc", "\r\r\n\n"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841  read by DuckDB
    con = duckdb.connect()
    con.register("documents", docs)
    want = sorted(con.execute(documents._PASS_COUNTS).fetchall())
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, documents.cleanup_totals(given).select("kind", "changes", "files").collect())) == want
    assert {k for k, *_ in want} == {kind for kind, *_ in T.clean_passes("conservative", False)}
