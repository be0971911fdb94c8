from linekeeper.operators import matching


def test_matches_move_to_near_duplicates(spark):
    segs = [("a", 0, 0.0, "sing the song"), ("a", 1, 2.0, "sing the song"), ("a", 2, 20.0, "other words"), ("a", 3, 23.0, "other words"), ("a", 4, 27.0, "other word"), ("a", 5, 60.0, "other word")]
    lines = [("a", 1, "sing the song", 1, 1.0), ("a", 2, "other words here", 3, 0.72), ("a", 3, "other words here", 4, 0.72), ("a", 4, "other word", 5, 1.0), ("a", 5, "nothing", None, 0.1), ("a", 6, "sing the song", 0, 1.0)]
    matches = spark.createDataFrame(lines, "song string, entry int, norm string, segment int, score double")
    segments = spark.createDataFrame(segs, "song string, seg_idx int, start double, norm string")
    got = {r.entry: (r.segment, round(r.score, 2)) for r in matching.earlier_duplicates(matches, segments).collect()}
    # 2.0 s back and equal; 3.0 s back and the line's opening; 4.0 s back likewise; 33 s back; no match; the first
    assert got == {1: (0, 1.0), 2: (2, 0.8), 3: (3, 0.8), 4: (5, 1.0), 5: (None, 0.1), 6: (0, 1.0)}
