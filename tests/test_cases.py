import json

import pytest

from linekeeper.operators import metrics
from linekeeper.sources import cases


def test_cases_from_a_file(spark, tmp_path):
    rows = [{"name": "a", "reference": "/r/a.lrc", "audio": "/m/a.flac", "require_within_25cs": 90.0}, {"name": "b", "audio": "/m/b.flac", "require_backend": "ctc", "require_text_mismatches": 3}]
    (tmp_path / "cases.json").write_text(json.dumps(rows, indent=2))
    got = cases.read_cases(spark, str(tmp_path / "cases.json"))
    assert {r.name: (r.require_text_mismatches, r.require_within_50cs, r.ignore_markers) for r in got.collect()} == {"a": (0, 100.0, False), "b": (3, None, False)}
    there, gone = cases.existing_cases(got, spark.createDataFrame([("/r/a.lrc",), ("/m/a.flac",)], "path string"))
    assert [r.name for r in there.collect()] == ["a"] and [(r.name, r.missing) for r in gone.collect()] == [("b", "/m/b.flac")]


def test_private_case(spark):
    given = {"PRIVATE_AUDIT_AUDIO": "x", "PRIVATE_AUDIT_LYRICS": "y", "PRIVATE_AUDIT_REVIEW_COUNT": "2", "PRIVATE_AUDIT_FUSION_COUNT": "1"}
    with pytest.raises(ValueError):
        cases.private_case(spark, given)
    row = cases.private_case(spark, given | {"PRIVATE_AUDIT_REVIEW_ENTRIES": "7, 3"})
    judged = metrics.evaluate_cases(row.selectExpr("*", "2L review_required_count", "array(3, 7) review_entries", "'hybrid' backend", "'ctc' selected_backend"))
    assert row.first().require_review_entries == [3, 7] and judged.first().failures == ["selected_backend"]
    none = cases.private_case(spark, given | {"PRIVATE_AUDIT_REVIEW_COUNT": "0", "PRIVATE_AUDIT_STRICT": "0"}).first()
    assert none.require_review_entries == [] and not none.strict_review
