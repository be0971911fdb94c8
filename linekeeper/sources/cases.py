"""Benchmark cases: a table of what is compared, how it is made and which gates it must pass.

Cases are data: a JSON file of rows, or one row from settings.  Their gates are the columns
that ``metrics.evaluate_cases`` reads (``require_`` and a gate's name; null: not applied).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a case names, how it is made, and its gates.
FIELDS = {
    "name": "string", "reference": "string", "generated": "string", "audio": "string", "lyrics": "string", "timing_source": "string",
    "ignore_markers": "boolean", "no_checked_lrc_hint": "boolean", "no_anchor_hints": "boolean", "strict_review": "boolean",
    "require_text_mismatches": "long", "require_within_25cs": "double", "require_within_50cs": "double", "require_max_abs_delta_cs": "long", "require_max_abs_delta_cs_at_most": "long",
    "require_backend": "string", "require_selected_backend": "string", "require_report_device": "string", "require_trusted_percent": "double",
    "require_review_required_count": "long", "require_review_entries": "array<int>", "require_ctc_local_fusion_count": "long",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
#: Where a case with a reference says nothing: no mismatch, and all lines within half a second.
DEFAULTS = {"require_text_mismatches": 0, "require_within_50cs": 100.0, "ignore_markers": False, "no_checked_lrc_hint": False, "no_anchor_hints": False, "strict_review": False}


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON file (an array of objects), with the defaults filled in; a case without a reference has no gates on one."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    filled = {k: F.coalesce(k, F.when(F.col("reference").isNotNull() | F.lit(not k.startswith("require_")), F.lit(v))) for k, v in DEFAULTS.items()}
    return rows.withColumns(filled)


def existing_cases(cases: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases whose reference, sound and lyrics all exist, the others with the names of what is missing).  files: path."""
    asked = cases.select("name", F.explode(F.array_compact(F.array("reference", "audio", "lyrics"))).alias("path"))
    missing = asked.join(files.select("path").distinct(), "path", "left_anti").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("missing"))
    return cases.join(missing, "name", "left_anti"), cases.join(missing, "name")


def private_case(spark: SparkSession, settings: Mapping[str, str], prefix: str = "PRIVATE_AUDIT_") -> DataFrame:
    """One case from settings (such as the environment): a run without a reference, gated by its report.

    Sound, lyrics, review count and fusion count must be given; review entries too, unless no
    review is expected; anything else has a default.  A missing setting is an error.
    """

    def ask(name: str, default: str | None = None) -> str:
        value = settings.get(prefix + name)
        if value or (value is not None and name == "REVIEW_ENTRIES"):
            return value
        if default is None:
            raise ValueError(f"{prefix}{name} is required")
        return default

    count = int(ask("REVIEW_COUNT"))
    entries = ask("REVIEW_ENTRIES", "" if count == 0 else None)
    trusted = ask("TRUSTED_PERCENT", "")
    row = {
        "name": ask("NAME", "private risk audit"), "generated": ask("OUTPUT", "private_auto_audit.lrc"), "audio": ask("AUDIO"), "lyrics": ask("LYRICS"), "timing_source": "auto",
        "ignore_markers": False, "no_checked_lrc_hint": True, "no_anchor_hints": True, "strict_review": ask("STRICT", "1") != "0",
        "require_backend": ask("BACKEND", "hybrid"), "require_selected_backend": ask("SELECTED_BACKEND", "hybrid"), "require_report_device": ask("DEVICE", "cuda"),
        "require_trusted_percent": float(trusted) if trusted.strip() else None, "require_review_required_count": count,
        "require_review_entries": sorted(int(x) for x in entries.split(",") if x.strip()), "require_ctc_local_fusion_count": int(ask("FUSION_COUNT")),
    }
    return spark.createDataFrame([tuple(row.get(k) for k in FIELDS)], SCHEMA)
