"""Text functions over string columns: normal forms, scripts, weights, morae, phrases."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from linekeeper.functions import blocks

# The character classes that matching keeps.
KANA = "\\u3040-\\u30ff"
HAN = "\\u3400-\\u9fff"
# Words that mark an instrumental passage.
MARKER_WORDS = ("instrumental", "intro", "interlude", "outro", "間奏", "イントロ", "アウトロ")
# Fixed value: between display lines of one entry: a slash with spaces, two spaces or more, or tabs.
GROUP_GAP = r"\s+/\s+|(?:[ 　]{2,}|\t+)"
#: Between the terms of a phrase.
TERM_GAP = r"[\s　,、，。！？!?・]+"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has none, and ASCII needs none, so only other texts go through Python."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfkc(text))


def match_text(text: Column, normal: bool = True) -> Column:
    """What matching compares: Latin letters, digits, kana and han, in their own case."""
    return F.regexp_replace(nfkc(text) if normal else text, f"[^0-9A-Za-z{KANA}{HAN}]+", "")


def compact_latin(text: Column, digits: bool = True, normal: bool = True) -> Column:
    """Lower-case Latin letters (and digits) alone."""
    return F.regexp_replace(F.lower(nfkc(text) if normal else text), "[^a-z0-9]+" if digits else "[^a-z]+", "")


def line_script(text: Column) -> Column:
    """japanese, latin, han or other: the first that applies."""
    return (
        F.when(text.rlike(f"[{KANA}]"), "japanese")
        .when(F.regexp_count(text, F.lit("[A-Za-z]")) >= 2, "latin")
        .when(text.rlike(f"[{HAN}]"), "han")
        .otherwise("other")
    )


def split_group(text: Column, keep_single: bool = False) -> Column:
    """Display lines of a text line; ``keep_single``: a line without a gap stays as it is."""
    parts = F.filter(F.transform(F.split(F.trim(text), GROUP_GAP), lambda x: F.trim(x)), lambda x: x != "")
    if not keep_single:
        return parts
    blank = F.trim(text) == ""
    whole = F.when(blank, F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(text.rlike(GROUP_GAP), parts).otherwise(whole)


def text_weight(line: Column) -> Column:
    """Sung weight of a line: Latin words 1.7, CJK characters 0.75, others 0.5; 1 at least."""
    compact = F.regexp_replace(line, r"\s+", "")
    words = F.regexp_extract_all(line, F.lit(r"[A-Za-z0-9']+"), F.lit(0))
    cjk = F.regexp_count(compact, F.lit(f"[{KANA}{HAN}\\uff00-\\uffef]"))
    other = F.greatest(F.lit(0), F.length(compact) - F.length(F.array_join(words, "")) - cjk)
    return F.greatest(F.lit(1.0), F.size(words) * 1.7 + cjk * 0.75 + other * 0.5)


def romaji_morae(romaji: Column) -> Column:
    """Morae: a bare n, consonants with a vowel, or else one character."""
    return F.regexp_extract_all(romaji, F.lit(r"n(?![aeiouy])|[b-df-hj-np-tv-z]*[aeiou]|."), F.lit(0))


def leading_term(text: Column) -> Column:
    """(term, count) of a text in normal form (a column of its own: no Python in array functions): a phrase's first term of two characters or more, and how often it opens the terms that follow without a break; ('', 0) if it doesn't repeat."""
    raw = F.split(F.trim(text), TERM_GAP)
    terms = F.filter(F.transform(raw, lambda x: match_text(x, False)), lambda x: x != "")
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def opening(held: Column) -> Column:
        first = F.coalesce(F.try_element_at(held, F.lit(1)), F.lit(""))
        run = F.aggregate(
            held, state, lambda a, x: F.struct(F.when(a["on"] & x.startswith(held[0]), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & x.startswith(held[0])).alias("on")), lambda a: a["n"]
        )
        return F.struct(first.alias("term"), run.alias("count"))

    # the array of one array binds the terms to a name: an expression used twice is worked out twice in a lambda
    found = F.transform(F.array(terms), opening)
    good = lambda x: (F.length(x["term"]) >= 2) & (x["count"] >= 2)
    return F.transform(found, lambda x: F.struct(F.when(good(x), x["term"]).otherwise("").alias("term"), F.when(good(x), x["count"]).otherwise(0).alias("count")))[0]


def is_marker(line: Column, strict: bool = True, normal: bool = True) -> Column:
    """Whether a line marks a passage without words.

    ``strict``: as in alignment, where a line with nothing to match is a marker; else as in
    evaluation, where only an empty one is.
    """
    text = F.trim(line)
    inner = F.lower(F.trim(F.regexp_replace(text, r"^[()\[\]{}]+|[()\[\]{}]+$", "")))
    words = F.lit(False)
    for w in MARKER_WORDS:
        words = words | inner.contains(w)
    empty = match_text(text, normal) == "" if strict else text == ""
    return (text == "♪") | empty | (text.startswith("(") & words)


def spoken_language(lines: Column) -> Column:
    """en, ja or zh of an ordered array of lines, from the first twelve."""
    sample = F.array_join(F.slice(lines, 1, 12), "")
    latin, kana, han = (F.regexp_count(sample, F.lit(f"[{c}]")) for c in ("A-Za-z", KANA, HAN))
    return (
        F.when(F.length(sample) == 0, "ja")
        .when(latin / F.greatest(F.lit(1), latin + kana + han) >= 0.55, "en")
        .when(kana > 0, "ja")
        .when(han > 0, "zh")
        .otherwise("ja")
    )


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings; 0 if one is empty or null."""
    return pd.Series(blocks.ratios(*([x if isinstance(x, str) else "" for x in side] for side in (left, right))), dtype="float64")


def segment_score(entry: Column, segment: Column) -> Column:
    """How well a segment's text fits an entry's: the ratio, raised where one holds the other."""
    ratio = sequence_ratio(entry, segment)
    return (
        F.when((F.length(entry) == 0) | (F.length(segment) == 0) | entry.isNull() | segment.isNull(), 0.0)
        .when(F.contains(segment, entry), F.greatest(ratio, F.lit(0.96)))
        .when(F.contains(entry, segment) & (F.length(segment) >= 4), F.greatest(ratio, F.lit(0.72)))
        .otherwise(ratio)
    )


#: White space as the domain's names have it, beyond ASCII too.
NAME_GAP = "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]+"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot begins none."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    """The path with its last suffix replaced."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]*$", ""), F.lit(suffix))


def report_key(name: Column) -> Column:
    """Key under which checked files and reports meet: stem up to '--', without a last '.checked', without white space, lower case."""
    stem = F.regexp_replace(F.regexp_replace(file_stem(name), "(?s)--.*$", ""), r"(?i)\.checked$", "")
    return F.lower(F.regexp_replace(stem, NAME_GAP, ""))


def safe_stem(name: Column) -> Column:
    """A name that any file system takes: illegal characters as '_', no outer white space and dots; 'case' if nothing is left."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.regexp_replace(F.regexp_replace(clean, f"^{NAME_GAP}|{NAME_GAP}$", ""), r"^\.+|\.+$", "")
    return F.when(clean == "", "case").otherwise(clean)


def number_list(text: Column) -> Column:
    """Whole numbers of a comma-separated text, sorted; blank parts are left out."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_sort(F.transform(parts, lambda x: x.cast("int")))


def anchor_profile(text: Column, romaji: Column | None = None) -> Column:
    """What a line begins and ends with: normal form, romaji where it is known, else its Latin letters."""
    norm = match_text(text)
    latin = compact_latin(text)
    known = F.lit(None).cast("string") if romaji is None else F.when(romaji != "", romaji)
    sound = F.coalesce(known, F.when(latin != "", latin))
    morae = romaji_morae(known)
    last = lambda x, n: F.substring(x, -n, n)
    return F.struct(
        text.alias("entry_text"),
        F.left(norm, F.lit(8)).alias("normalized_prefix"),
        F.when(F.length(norm) <= 8, norm).otherwise(last(norm, 8)).alias("normalized_suffix"),
        F.when(known.isNotNull(), "ja-hepburn-pykakasi").when(sound.isNotNull(), "latin-fallback").otherwise("unavailable").alias("phonetic_system"),
        sound.alias("romaji"),
        F.left(sound, F.lit(12)).alias("romaji_prefix"),
        F.when(F.length(sound) <= 12, sound).otherwise(last(sound, 12)).alias("romaji_suffix"),
        F.when(known.isNotNull(), F.coalesce(F.try_element_at(morae, F.lit(1)), F.lit(""))).alias("first_mora"),
        F.when(known.isNotNull(), F.coalesce(F.try_element_at(morae, F.lit(-1)), F.lit(""))).alias("last_mora"),
    )
