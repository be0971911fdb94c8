import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from linekeeper.functions import text as tx
from linekeeper.functions import timing as tm


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [("Ｈello, ワールド 漢字!", "Helloワールド漢字"), ("A b-C 9", "AbC9"), ("", "")])
def test_match_text(spark, text, want):
    assert one(spark, text, tx.match_text) == want


@pytest.mark.parametrize("text,want", [("かな", "japanese"), ("ab 漢", "latin"), ("漢字a", "han"), ("1 !", "other")])
def test_script(spark, text, want):
    assert one(spark, text, tx.line_script) == want


def test_split_group(spark):
    assert one(spark, "first part  second part", tx.split_group) == ["first part", "second part"]
    assert one(spark, "one two three", tx.split_group) == ["one two three"]
    assert one(spark, " a / b\tc ", tx.split_group) == ["a", "b", "c"]
    assert one(spark, " kept as is ", lambda c: tx.split_group(c, True)) == [" kept as is "]
    assert one(spark, "  ", lambda c: tx.split_group(c, True)) == []


@pytest.mark.parametrize("romaji,want", [("konnichiha", ["ko", "n", "ni", "chi", "ha"]), ("sen", ["se", "n"]), ("x", ["x"]), ("kyanya", ["kya", "nya"])])
def test_morae(spark, romaji, want):
    assert one(spark, romaji, tx.romaji_morae) == want


def test_leading_term(spark):
    assert tuple(one(spark, "over, over, overall the end", tx.leading_term)) == ("over", 3)
    assert tuple(one(spark, "a, a, a", tx.leading_term)) == ("", 0)
    assert tuple(one(spark, "over then over", tx.leading_term)) == ("", 0)


def test_weight(spark):
    assert one(spark, "two words", tx.text_weight) == pytest.approx(3.4)
    assert one(spark, "漢字かな!", tx.text_weight) == pytest.approx(3.5)
    assert one(spark, "!", tx.text_weight) == 1.0


def test_markers(spark):
    assert [one(spark, x, tx.is_marker) for x in ("♪", "(Interlude)", "...", "(hello)", "intro")] == [True, True, True, False, False]
    assert one(spark, "...", lambda c: tx.is_marker(c, strict=False)) is False


def test_language(spark):
    got = [one(spark, x, tx.spoken_language, "array<string>") for x in ([], ["hello there"], ["漢字", "かな"], ["漢字"])]
    assert got == ["ja", "en", "ja", "zh"]


@pytest.mark.parametrize("a,b", [("abcdef", "abxdef"), ("abc", "zzabczz"), ("abcdefgh", "cdef"), ("", "x"), ("x", None)])
def test_segment_score(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(tx.segment_score(F.col("a"), F.col("b")).alias("s")).first().s
    want = 0.0
    if a and b:
        want = SequenceMatcher(None, a, b).ratio()
        want = max(want, 0.96) if a in b else max(want, 0.72) if b in a and len(b) >= 4 else want
    assert got == pytest.approx(want)


def test_nfkc_agrees_with_unicodedata(spark):
    for x in ("ﬁ½①ｶﾞ", "plain", None):
        assert one(spark, x, tx.nfkc) == (None if x is None else unicodedata.normalize("NFKC", x))


@pytest.mark.parametrize("text,want", [("[01:02.3]x", 6230), ("[00:01.999]", 199), ("[100:00]", 600000), ("none", None)])
def test_tags(spark, text, want):
    assert one(spark, text, tm.tag_cs) == want


@pytest.mark.parametrize("t,want", [(-1.0, "00:00.00"), (59.996, "01:00.00"), (61.5, "01:01.50"), (0.125, "00:00.12")])
def test_clock(spark, t, want):
    assert one(spark, t, tm.clock, "double") == want


def test_audit_clock_does_not_carry(spark):
    assert one(spark, 59.996, tm.audit_clock, "double") == "00:60.00"
    assert one(spark, None, tm.audit_clock, "double") == ""


def test_truthy(spark):
    assert [one(spark, x, lambda c: tm.truthy(c, 1.0), "double") for x in (0.0, None, 0.3)] == [1.0, 1.0, 0.3]


def test_report_key(spark):
    assert one(spark, "/a/b/ Song Name.checked--x.lrc", tx.report_key) == "songname"
