"""Reports of several versions in one table."""

from linekeeper.sources import variants

REPORTS = {
    "new": '{"backend": "ctc", "candidate_selection": {"selected_backend": "whisperx"}, "trusted_percent": 91.5, "assignments": [{"entry": 3, "timestamp": 1.5, "score": 0.9, "timing_trusted": true}, {"timestamp": "2.25"}]}',
    "old": '﻿{"report": {"backend": "ctc", "trusted_percent": "88.25", "assignments": [{"index": 4, "time": 7, "confidence": 0.5, "trusted": "true"}]}}',
    "flat": '{"metrics": {"trusted_percent": 12}, "lines": [{"start": 0.5}, 7, {"start": [1]}], "assignments": "none"}',
    "odd": '{"trusted_percent": "n/a", "assigned_percent": [1], "review_required_count": null, "backend": 5}',
    "cut": '{"backend": "ctc", "assi',
    "list": "[1, 2]",
    "text": '"x"',
    "blank": " \n",
    "none": None,
    "nan": '{"trusted_percent": "NaN"}',
}


def test_reports_of_all_versions(spark):
    docs = spark.createDataFrame(list(REPORTS.items()), "doc_id string, content string")
    reports = variants.load_reports(docs)
    assert {r.doc_id: r.error for r in reports.collect() if r.error} == {"cut": "malformed", "list": "not an object", "text": "not an object", "blank": "empty", "none": "empty"}
    got = {r.doc_id: (r.backend, r.lines, r.trusted_percent, r.assigned_percent, r.review_required_count) for r in variants.summaries(reports).collect()}
    assert got["new"] == ("whisperx", 2, 91.5, None, None) and got["old"] == ("ctc", 1, 88.25, None, None) and got["flat"] == ("", 3, 12.0, None, None)
    assert got["odd"] == ("5", 0, None, None, None) and got["nan"][2] is None and got["cut"] == (None, None, None, None, None)


def test_assignments_of_all_versions(spark):
    docs = spark.createDataFrame(list(REPORTS.items()), "doc_id string, content string")
    rows = variants.timestamps(variants.load_reports(docs))
    got = sorted((r.doc_id, r.entry, r.timestamp, r.score, r.trusted) for r in rows.collect())
    assert got == sorted([("new", 3, 1.5, 0.9, True), ("new", 2, 2.25, 0.0, False), ("old", 5, 7.0, 0.5, True), ("flat", 1, 0.5, 0.0, False), ("flat", 2, None, 0.0, False), ("flat", 3, None, 0.0, False)], key=lambda x: x[:2])
