"""A training corpus from ``documents``: quality rules, near copies, decontamination, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all rows
that the stage before kept, and its result is stored and reread as the next one's docs.

Every stage takes null ids and texts, texts of any length, repeated rows, ids that several
texts share, extra columns of any name and empty tables; rows are told apart by id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linekeeper.llm.decontaminate import leaks
from linekeeper.llm.near_copies import surplus_rows
from linekeeper.llm.packing import pack_documents
from linekeeper.llm.quality_rules import labelled_target, verdicts
from linekeeper.llm.secrets import in_filter, redact, uid_filter
from linekeeper.llm.store import come_back, materialize, row_uid, stand_aside


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio against the documents that labels call good.

    A null or empty text fails (under 50 words); repeated rows are judged alike and stay
    repeated; columns of any name keep their values.
    """
    target = labelled_target(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return verdicts(docs, target).filter("verdict.kept").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def _apart(docs: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Rows that may be among ``told`` (__uid), which alone have to meet it in a shuffle; all others; the columns' names."""
    own, names = stand_aside(docs)
    marked = own.withColumn("__uid", row_uid(names["doc_id"], names["text"])).withColumn("__bits", uid_filter(told))
    return marked.filter(in_filter()).drop("__bits"), marked.filter(~in_filter()).drop("__bits"), names


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the row with the smallest id.

    A null id comes last; of rows with one id and other texts in a group one stays, by a
    hash; rows that repeat id and text count once; texts without words are in no group and
    stay; other columns are those of any of the repeated rows.
    """
    told = surplus_rows(docs, size=5, percent=80).select(F.col("uid").alias("__uid"), F.col("gone").alias("__gone"))
    asked, others, names = _apart(docs, told)
    met = asked.join(told, "__uid", "left")
    again = met.filter("not __gone").dropDuplicates([names["doc_id"], names["text"]])
    kept, *more = (x.select(*come_back(names)) for x in (others, met.filter("__gone is null"), again))
    return kept.union(more[0]).union(more[1])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Rows that share an id, or have none, are judged each by their own text; repeated rows
    stay or go together; null and empty texts stay; without items all rows stay.
    """
    found = leaks(docs.select(row_uid("doc_id", "text").alias("uid"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="uid")
    # stored: the texts are searched once, and the join is of two plain sides
    found = materialize(found.select(F.col("doc_id").alias("__uid")).distinct(), "leaking")
    asked, others, names = _apart(docs, found)
    return others.select(*come_back(names)).union(asked.join(found, "__uid", "left_anti").select(*come_back(names)))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars, where it exists, counted anew.

    Null texts stay null, with their n_chars; repeated rows stay repeated; columns of any
    other name keep their values.
    """
    hidden = redact(docs)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return hidden.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces and their places in sequences of 4096 tokens.

    A null or empty text is one piece, its end id; repeated rows and ids get places of their
    own; an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

#: Token ids, hashed likelihood ratios and link components: not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
