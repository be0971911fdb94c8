"""Kana to Latin letters, as one pass of longest matches over a text, in native expressions.

Readings of han characters need a dictionary and stay a column of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linekeeper.functions.text import HAN, KANA

# The syllables of each consonant in the order of the vowels, and those that are spelt otherwise.
VOWELS = "aiueo"
ROWS = {
    "": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの",
    "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ",
}
OTHERWISE = {"し": "shi", "じ": "ji", "ち": "chi", "ぢ": "ji", "つ": "tsu", "づ": "zu", "ふ": "fu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "wo", "ん": "n", "ゔ": "vu"}
SMALL = {"ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ゎ": "wa"}
# Two kana that stand for one syllable of foreign words.
FOREIGN = {
    "ふぁ": "fa", "ふぃ": "fi", "ふぇ": "fe", "ふぉ": "fo", "てぃ": "ti", "でぃ": "di", "とぅ": "tu", "どぅ": "du", "でゅ": "dyu", "うぃ": "wi", "うぇ": "we", "うぉ": "wo", "しぇ": "she", "じぇ": "je", "ちぇ": "che",
    "つぁ": "tsa", "つぃ": "tsi", "つぇ": "tse", "つぉ": "tso", "ゔぁ": "va", "ゔぃ": "vi", "ゔぇ": "ve", "ゔぉ": "vo",
}
DOUBLED, LONG = "っ", "ー"


def syllables() -> dict[str, str]:
    """Every kana, and every two that are one syllable, with its Latin spelling."""
    out = {kana: consonant + vowel for consonant, row in ROWS.items() for kana, vowel in zip(row, VOWELS, strict=True)} | OTHERWISE | SMALL | FOREIGN
    for row in ROWS.values():
        kana = row[1]  # those in i take a small ya, yu, yo
        if row[0] != "あ":
            stem = out[kana][:-1]
            out |= {kana + small: stem + (y[1:] if stem in ("sh", "ch", "j") else y) for small, y in SMALL.items() if y[0] == "y"}
    return out


def hiragana(text: Column) -> Column:
    """Katakana as hiragana: its block lies 96 places further on, in the same order."""
    codes = range(0x30A1, 0x30F7)
    return F.translate(text, "".join(map(chr, codes)), "".join(chr(c - 96) for c in codes))


def kana_romaji(text: Column) -> Column:
    """Latin spelling of the kana of a text; other characters stay.

    A small tsu doubles the consonant behind it (t before ch) and is left out before anything
    else; a long mark repeats the vowel before it; n is n before vowels too.
    """
    table = syllables()
    pairs = "|".join(sorted(k for k in table if len(k) == 2))
    parts = F.regexp_extract_all(hiragana(text), F.lit(f"(?s){pairs}|."), F.lit(0))
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    spelt = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    spelt = F.regexp_replace(spelt, f"{DOUBLED}(?=ch)", "t")
    spelt = F.regexp_replace(spelt, f"{DOUBLED}(?=([bcdfghjklmpqrstvwxyz]))", "$1")
    spelt = F.regexp_replace(spelt, DOUBLED, "")
    return F.regexp_replace(spelt, f"(?<=([aeiou])){LONG}+", "$1")


def romaji(text: Column, reading: Column | None = None) -> Column:
    """Spelling of a line: that of its reading where one is given, else of its own kana; null where it has han characters without a reading, or no kana."""
    own = F.when(text.rlike(f"[{KANA}]") & ~text.rlike(f"[{HAN}]"), kana_romaji(text))
    return own if reading is None else F.coalesce(F.when(reading != "", kana_romaji(reading)), own)
