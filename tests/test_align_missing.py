from linekeeper.plans.align import align

SPAN = "array<struct<char: string, start: double, end: double, score: double>>"
PEAK = "array<struct<time: double, score: double>>"


def tables(spark, lines, words, tokens):
    return (
        spark.createDataFrame(lines, "song string, entry int, text string, norm string, duration double"),
        spark.createDataFrame(words, "song string, entry int, timestamp double, score double, segment int, borrowed boolean"),
        spark.createDataFrame(tokens, f"song string, entry int, timestamp double, ctc_score double, missing boolean, token_spans {SPAN}, peaks {PEAK}"),
        spark.createDataFrame([], "song string, entry int, timestamp double, score double"),
    )


def test_lines_without_candidates_are_kept(spark):
    lines = [(s, i, "text", f"text{i}" * 2, 60.0) for s in "abc" for i in (1, 2, 3)]
    words = [("a", i, 10.0 * i, 0.9, i, False) for i in (1, 2)] + [("b", i, 10.0 * i, 0.9, i, False) for i in (1, 3)]
    tokens = [("a", i, 10.0 * i, 0.5, False, [("x", 10.0 * i, 10.0 * i + 1, 0.6)], []) for i in (1, 2, 3)] + [("b", 1, 10.0, 0.5, False, [("x", 10.0, 11.0, 0.6)], [])]
    decisions, report = align(*tables(spark, lines, words, tokens))
    got = {(r.song, r.entry): r for r in decisions.collect()}
    assert sorted(got) == [(s, i) for s in "abc" for i in (1, 2, 3)]
    assert got["a", 3].selected == "ctc" and got["a", 3].time == 30.0 and got["a", 3].trusted
    assert got["b", 2].time >= 10.0 and got["b", 2].review and not got["b", 2].trusted
    assert all(got["c", i].review and not got["c", i].trusted for i in (1, 2, 3))
    assert {r.song: (r.timing_entries, r.review_required_count) for r in report.collect()}.items() >= {"c": (3, 3)}.items()


def test_collapsed_words_lose_to_tokens(spark):
    lines = [("a", i, "text", f"text{i}", 90.0) for i in range(1, 7)]
    words = [("a", i, 10.0 * i, 0.9 if i < 3 else 0.1, i if i < 3 else 3, False) for i in range(1, 7)]
    tokens = [("a", i, 10.0 * i, None if i < 3 else 0.5, i < 3, None, []) for i in range(1, 7)]
    decisions, _ = align(*tables(spark, lines, words, tokens))
    assert {r.selected for r in decisions.collect()} == {"ctc"}
