"""Quality rules: base heuristics and a hashed n-gram log-likelihood ratio, in SQL expressions only.

Two multinomials over hashed token n-grams (n = 1, 2) are counted: the raw corpus, over all
documents, and a trusted target, over all of its rows.  A document's score is the mean over
its n-grams of log(p_target / p_raw).  The threshold follows from the two: SPREAD standard
deviations of an n-gram's ratio under the target below its mean there.  Counts are integers
and every sum runs in a fixed order, so the verdicts are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.secrets import in_filter, uid_filter
from linekeeper.llm.store import come_back, materialize, stand_aside

#: Cells of the hashed multinomials; the tables hold this many rows, whatever the data.
CELLS = 1 << 14
#: Standard deviations of an n-gram's log-likelihood ratio by which a document's mean may fall below the target's.
SPREAD = 2.0

#: Ids of a target that are broadcast, at most (some 16 MB).
BROADCAST_IDS = 1 << 19

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Words and punctuation apart; letters, digits, other.
TOKEN = r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+"
#: Shouting or doubled marks: not in a text of the default target.
LOUD = r"\p{Lu}{2}|[!?]{2}"


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def base_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed, and __text, to columns without inner names."""
    own = df.columns
    df = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("__n", F.size("__words"))
    df = df.withColumn(
        "__keys",
        F.expr("if(__n < 3, array(), transform(sequence(0, greatest(__n - 3, 0)), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"),
    )
    # windows that occur twice: most texts have none, their keys are all distinct
    df = df.withColumn("__sorted", F.expr("if(size(array_distinct(__keys)) = size(__keys), array(), array_sort(transform(__keys, (k, i) -> struct(k, i))))"))
    repeated = F.expr(
        "filter(__sorted, (x, j) -> (j > 0 and x.k = __sorted[j - 1].k) or (j + 1 < size(__sorted) and x.k = __sorted[j + 1].k))"
    )
    df = df.withColumn("__repeated", repeated)
    df = df.withColumn("__lines", F.expr(f"filter(split(__text, '\\n', -1), x -> x rlike '{WORD}')".replace("\\", "\\\\")))
    return df.select(
        *own,
        F.col("__text"),
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr("size(array_distinct(flatten(transform(__repeated, x -> array(x.i, x.i + 1, x.i + 2)))))").cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def trusted(text: str = "__text", cells: str = "__cells") -> Column:
    """The default target, where no rows are given: texts of 50 tokens at least without symbols of markup, shouting or doubled marks."""
    return (F.size(cells) >= 99) & ~F.col(text).rlike(f"{SYMBOL}|{LOUD}")


def labelled_target(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", good: int = 1) -> DataFrame:
    """All rows of ``docs`` that some label calls good: the target of the rules.

    Ids are stored and counted: up to BROADCAST_IDS are sent to all tasks; with more, a
    filter of fixed size drops most other rows and the rest meet their ids in a shuffle.
    """
    ids = labels.filter((F.col(label_col) == good) & F.col(id_col).isNotNull()).select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("__id")).distinct()
    ids = materialize(ids.withColumn("__uid", F.xxhash64("__id")), "target-ids")
    docs, names = stand_aside(docs)
    own = names[id_col]
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids.select("__id")), F.col(own) == F.col("__id"), "left_semi").select(*come_back(names))
    marked = docs.withColumn("__bits", uid_filter(ids)).withColumn("__uid", F.xxhash64(own))
    return marked.filter(in_filter()).join(ids.select("__id"), F.col(own) == F.col("__id"), "left_semi").select(*come_back(names))


def ngram_cells(text: str = "__text", cells: int = CELLS) -> Column:
    """Cells (int) of a text's hashed tokens and token pairs, in text order."""
    tokens = f"regexp_extract_all({text}, '{TOKEN}', 0)".replace("\\", "\\\\")
    unigrams = f"transform({tokens}, t -> hash(t))"
    return F.expr(
        f"""transform(array({unigrams}), u -> concat(
              transform(u, h -> pmod(h, {cells})),
              if(size(u) < 2, cast(array() as array<int>), transform(sequence(0, greatest(size(u) - 2, 0)), i -> pmod(hash(u[i], u[i + 1]), {cells})))))[0]"""
    )


def _counts(rows: DataFrame, name: str) -> DataFrame:
    """(cell, name): how often each cell occurs in the arrays ``__cells``."""
    # explode_outer: explode would have its array evaluated once more, in an inferred filter
    return rows.select(F.explode_outer("__cells").alias("cell")).filter("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias(name))


def llr_table(raw: DataFrame, target: DataFrame, cells: int = CELLS, spread: float = SPREAD) -> DataFrame:
    """One row: array ``llr`` of ``cells`` log-likelihood ratios and, last, the threshold, from rows with cell arrays ``__cells``.

    A cell's count gets 1 added in either multinomial; the threshold's mean and deviation are
    over the target's own n-grams.  Without a target there is no threshold (-Infinity).
    """
    every = raw.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"))
    every = every.join(_counts(raw, "raw"), "cell", "left").join(_counts(target, "good"), "cell", "left").na.fill(0, ["raw", "good"])
    packed = every.agg(
        F.array_sort(F.collect_list(F.struct("cell", "raw", "good"))).alias("c"), F.sum("raw").alias("raw"), F.sum("good").alias("good")
    )
    packed = packed.select("good", F.expr(f"transform(c, x -> named_struct('p', x.good / greatest(good, 1), 'v', ln((x.good + 1) / (good + {cells})) - ln((x.raw + 1) / (raw + {cells}))))").alias("t"))
    packed = packed.select("good", "t", F.expr("aggregate(t, 0D, (a, x) -> a + x.p * x.v)").alias("mean"), F.expr("aggregate(t, 0D, (a, x) -> a + x.p * x.v * x.v)").alias("square"))
    cut = F.when(F.col("good") > 0, F.col("mean") - spread * F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")))).otherwise(F.lit(float("-inf")))
    return packed.select(F.concat(F.transform("t", lambda x: x["v"]), F.array(cut)).alias("llr"))


def verdicts(docs: DataFrame, target: DataFrame | None = None, spread: float = SPREAD, cells: int = CELLS, text_col: str = "text") -> DataFrame:
    """For every row of ``docs`` a row (doc, verdict): the struct of all its columns, whatever their names, and that of RESULTS."""
    plain = lambda d: d.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__cells", ngram_cells("__text", cells))
    chosen = plain(docs).filter(trusted()) if target is None else plain(target)
    table = llr_table(plain(docs).select("__cells"), chosen.select("__cells"), cells, spread).scalar()
    docs, names = stand_aside(docs, *RESULTS)
    scored = base_features(docs, names[text_col])
    scored = scored.withColumn("__cells", ngram_cells("__text", cells)).withColumn("__llr", table)
    scored = scored.withColumn("llr", F.expr("if(size(__cells) = 0, 0D, aggregate(__cells, 0D, (a, c) -> a + __llr[c]) / size(__cells))"))
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.expr(f"__llr[{cells}]")))
    # a generator's output is a barrier: filters on the results are not pushed into the expressions behind them, which would then run once for each use
    results = F.explode_outer(F.array(F.struct(*RESULTS))).alias("__r")
    return scored.select(*docs.columns, results).select(F.struct(*come_back(names)).alias("doc"), F.col("__r").alias("verdict"))


def judged(docs: DataFrame, target: DataFrame | None = None, spread: float = SPREAD, cells: int = CELLS, text_col: str = "text") -> DataFrame:
    """Every row of ``docs``, all its columns as they are, with ``__r``: the struct of RESULTS (a column of that name gives way; ``verdicts`` keeps it)."""
    rows = verdicts(docs, target, spread, cells, text_col)
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "__r"], F.col("verdict").alias("__r"))


def quality_rules(docs: DataFrame, target: DataFrame | None = None, spread: float = SPREAD, cells: int = CELLS, text_col: str = "text") -> DataFrame:
    """Every row with the base features, llr (mean per n-gram, 0 without any) and ``kept``.

    ``kept`` is false if the base rules fail, else whether llr reaches the threshold.
    ``target``: the rows (with the same text column) that form the trusted multinomial;
    without it the rows of ``docs`` that ``trusted`` takes.  Null text counts as empty
    (base_failed); texts of any length are read whole; repeated rows are judged alike, each
    its own row; null ids are kept; with an empty corpus there are no rows; with an empty
    target the base rules alone decide; a score equal to the threshold is kept; columns of
    the input that have names of results give way to these (``verdicts`` keeps both), all
    others keep their values, whatever their names.
    """
    rows = verdicts(docs, target, spread, cells, text_col)
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in RESULTS], "verdict.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The target: all documents that labels call good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = labelled_target(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs, target).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
