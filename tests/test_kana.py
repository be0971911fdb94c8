"""Kana spellings."""

import pytest
from pyspark.sql import functions as F

from linekeeper.functions import kana


def spelt(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.x for r in df.select("k", kana.kana_romaji(F.col("t")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("きみがよは", "kimigayoha"), ("ラーメン", "raamen"), ("がっこう", "gakkou"), ("マッチ", "matchi"), ("ざっし", "zasshi"), ("いっつう", "ittsuu"), ("あっ", "a"), ("ちょっと", "chotto"), ("しんよう", "shinyou"), ("ジャズ", "jazu"),
        ("ファイル", "fairu"), ("ヴァイオリン", "vaiorin"), ("パーティー", "paatii"), ("ーあ", "ーa"), ("きゃりー", "kyarii"), ("キッチン!", "kitchin!"), ("a あ 漢", "a a 漢"), ("", ""), (None, None), ("ひょう\nみゅ", "hyou\nmyu"), ("スーーー", "suu"),
    ],
)
def test_words(spark, text, want):
    assert spelt(spark, text) == [want]


def test_every_syllable(spark):
    table = kana.syllables()
    assert len(table) >= 140 and spelt(spark, *table) == list(table.values())
    katakana = ["".join(chr(ord(c) + 96) for c in k) for k in table]
    assert spelt(spark, *katakana) == list(table.values())
    assert (table["しゃ"], table["ちゅ"], table["じょ"], table["りゃ"], table["ぴょ"], table["を"]) == ("sha", "chu", "jo", "rya", "pyo", "wo")


def test_lines_with_han(spark):
    df = spark.createDataFrame([("君が代", None), ("君が代", "きみがよ"), ("よは", ""), ("Latin", None), (None, None)], "t string, r string")
    assert [r.x for r in df.select(kana.romaji(F.col("t"), F.col("r")).alias("x")).collect()] == [None, "kimigayo", "yoha", None, None]
