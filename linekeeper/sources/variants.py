"""Reports without a schema: fields differ by backend and version, so a report is one VARIANT value.

A report that can't be read is a row with an error.  A field is asked for by the places where
versions keep it; a value of another kind than the one asked for is null, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where versions keep a metric, a backend and a report's assignments: the first place that holds one counts.
PLACES = {
    "backend": ("$.candidate_selection.selected_backend", "$.backend", "$.report.backend"),
    "assignments": ("$.assignments", "$.report.assignments", "$.lines"),
}
#: A metric lies at the top, in the report proper or among metrics.
METRIC_PLACES = ("$.{name}", "$.report.{name}", "$.metrics.{name}")


def load_reports(docs: DataFrame) -> DataFrame:
    """(doc_id, report, error) of JSON texts (doc_id, content): ``report`` is a VARIANT object, or null with an error.

    Null and blank contents, texts that are no JSON, and values that are no objects have
    errors; a byte-order mark is dropped; of a key that is there twice a text is malformed.
    """
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"^\ufeff?\s*|\s+$", "")
    value = F.try_parse_json(text)
    # only an object's schema begins so
    thing = F.schema_of_variant(value).startswith("OBJECT")
    error = F.when(text == "", "empty").when(value.isNull(), "malformed").when(~thing, "not an object")
    rows = docs.select("doc_id", value.alias("value"), error.alias("error"))
    return rows.select("doc_id", F.when(F.col("error").isNull(), F.col("value")).alias("report"), "error")


def field(report: str, kind: str, *places: str) -> Column:
    """The first of the ``places`` (paths) of a report that holds a value of this kind; null if none does."""
    return F.coalesce(*[F.try_variant_get(report, place, kind) for place in places])


def metric(name: str, report: str = "report") -> Column:
    """A metric as a finite number, also where it is written as a text; null where it is none."""
    number = field(report, "double", *[place.format(name=name) for place in METRIC_PLACES])
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def backend(report: str = "report") -> Column:
    """The backend that the choice of candidates names, else the report's own; '' if there is none."""
    return F.coalesce(field(report, "string", *PLACES["backend"]), F.lit(""))


def elements(rows: DataFrame, report: str = "report", places: tuple[str, ...] = PLACES["assignments"]) -> DataFrame:
    """``rows`` (without the report) with pos and item: a row for each element of the first place that holds an array."""
    held = field(report, "array<variant>", *places)
    return rows.select(*[c for c in rows.columns if c != report], F.posexplode(held).alias("pos", "item"))


def timestamps(rows: DataFrame, report: str = "report") -> DataFrame:
    """(rows without the report, entry, timestamp, score, trusted): assignments of any version; an entry that is missing is the element's place, a value of another kind is null."""
    each = elements(rows, report)
    own = [c for c in each.columns if c not in ("pos", "item")]
    entry = F.coalesce(F.try_variant_get("item", "$.entry", "int"), F.try_variant_get("item", "$.index", "int") + 1, F.col("pos") + 1)
    return each.select(*own, entry.alias("entry"), field("item", "double", "$.timestamp", "$.time", "$.start").alias("timestamp"), F.coalesce(field("item", "double", "$.score", "$.confidence"), F.lit(0.0)).alias("score"), F.coalesce(field("item", "boolean", "$.timing_trusted", "$.trusted"), F.lit(False)).alias("trusted"))


def summaries(reports: DataFrame, names: tuple[str, ...] = ("trusted_percent", "assigned_percent", "review_required_count")) -> DataFrame:
    """(doc_id, error, backend, lines, names...): what a corpus of reports of all versions says; a report with an error has nulls."""
    lines = F.size(field("report", "array<variant>", *PLACES["assignments"]))
    there = F.col("report").isNotNull()
    return reports.select("doc_id", "error", F.when(there, backend()).alias("backend"), F.when(there, F.coalesce(F.when(lines >= 0, lines), F.lit(0))).cast("long").alias("lines"), *[metric(n).alias(n) for n in names])
