"""Repairs from forced times: the time of a line's first character when its text is aligned by force.

A rule is a box: ranges of a line's measures and a flag that it must have.  Which boxes hold
a line is told in columns, and each leaves an option there: a time, and how it has to lie to
the time of the line before, which is all that the fold over a song still decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.operators.folds import fold_by_song
from linekeeper.operators.repairs import OUT, _num

# Words that a segment may lack where its line goes on into the next segment.
SPAN_WORDS = ("私",)
INF = math.inf


def first_char_time(chars: Column, start: Column) -> Column:
    """Time of a segment's first character, else its start."""
    return F.coalesce(F.try_element_at(chars, F.lit(1))["t"], start)


@dataclass(frozen=True)
class Box:
    """Closed ranges of a line's letters, score, seconds behind its forced time and seconds behind the line before; a flag; where the forced time has to lie.

    ``floor``: inside (between the line before, 0.10 s behind it, and the line itself), after
    (0.10 s behind the line before) or heard (0.05 s behind the segment of the line before).
    ``lead``: seconds by which the time is set before the forced one.  ``short``: a short
    line's time, and behind the line before by 0.10 s in any case.
    """

    reason: str
    floor: str
    letters: tuple[float, float] = (0, INF)
    score: tuple[float, float] = (-INF, INF)
    late: tuple[float, float] = (-INF, INF)
    gap: tuple[float, float] = (-INF, INF)
    flag: str | None = None
    lead: float = 0.0
    short: bool = False


# The limits and reasons of the rules, those that win first.
BOXES = (
    Box("low-confidence-late-asr-forced", "heard", letters=(8, INF), score=(-INF, math.nextafter(0.55, 0)), late=(1.2, 2.2), gap=(4.0, INF), flag="other_segment"),
    Box("close-following-line", "heard", letters=(4, INF), late=(0.55, 0.8), gap=(2.0, 2.6)),
    Box("line-spans-next-segment", "heard", letters=(0, 3), late=(0.5, 1.5), gap=(3.0, INF), flag="spans_on_short_late", short=True),
    Box("line-spans-next-segment", "heard", late=(0.5, 1.5), flag="spans_on"),
    Box("short-line-late-asr", "after", letters=(0, 3), gap=(3.0, INF), flag="short_late", short=True),
    Box("post-borrowed-line-forced", "after", letters=(4, INF), score=(0.90, INF), late=(1.3, 2.5), gap=(2.5, INF), flag="after_borrowed", lead=0.25),
    Box("suffix-after-unmatched-same-segment", "inside", score=(0.90, INF), late=(0.8, 1.5), flag="suffix_of_unmatched"),
    Box("medium-confidence-forced", "inside", score=(0.64, 0.75), late=(1.2, 1.8), gap=(4.0, INF)),
    Box("high-confidence-small-forced", "inside", score=(0.90, INF), late=(0.25, 0.45)),
    Box("low-confidence-same-segment-forced", "inside", score=(0.50, 0.65), late=(0.50, 1.00), gap=(3.0, INF), flag="same_segment"),
)
# A line that no rule moves goes a part of the way if it is late by so much (more where it shares its segment); the part by its score.
BLENDS = (
    Box("bounded-forced-asr-blend", "after", letters=(5, INF), score=(0.55, 0.88), late=(1.0, 3.0), gap=(2.5, INF), flag="same_segment"),
    Box("bounded-forced-asr-blend", "heard", letters=(5, INF), score=(0.55, 0.88), late=(1.0, 2.0), gap=(2.5, INF), flag="no_shared_segment"),
)
BLEND_PARTS = ((0.80, 0.20), (-INF, 0.35))
#: A short line goes back by so many seconds at most where its segment doesn't begin with it, and has to be so late.
SHORT_BACK, SHORT_LATE = 2.80, 1.2


def _measured(df: DataFrame) -> DataFrame:
    """Columns that the boxes ask for, of lines that may be moved; ``may`` is false for all others."""
    order = Window.partitionBy("song").orderBy("entry")
    before = lambda c: F.lag(c).over(order)
    yes = lambda c: F.coalesce(c, F.lit(False))
    norm, heard = F.coalesce("norm", F.lit("")), F.coalesce("asr_norm", F.lit(""))
    now, aim = F.col("timestamp").cast("double"), F.when(~F.isnan(F.col("forced").cast("double")), F.col("forced").cast("double"))
    known = yes(before("segment") >= 0)
    same = known & yes(before("segment") == F.col("segment"))
    short = F.when((F.length(norm) <= 3) & ~heard.startswith(norm), F.greatest(aim, now - SHORT_BACK)).otherwise(aim)
    lacks = F.lit(False)
    for w in SPAN_WORDS:
        lacks = lacks | (F.coalesce("text", F.lit("")).contains(w) & ~F.coalesce("asr_text", F.lit("")).contains(w))
    # to the microsecond: what far times leave over in a difference decides no limit
    behind = lambda c: F.round(now - c, 6)
    score = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    marks = {
        "same_segment": same, "no_shared_segment": ~same, "other_segment": known & ~same, "spans_on": lacks, "short_late": behind(short) >= SHORT_LATE, "spans_on_short_late": lacks & (behind(short) >= SHORT_LATE),
        "after_borrowed": before("borrowed"), "suffix_of_unmatched": same & (score(before("score")) <= 0.05) & heard.endswith(norm),
    }
    return df.withColumns(
        {
            "may": (F.row_number().over(order) > 1) & ~yes(F.col("settled")) & yes(F.col("segment") >= 0) & aim.isNotNull(),
            "now": now, "aim": aim, "short": short, "letters": F.length(norm), "sure": score(F.col("score")), "late": behind(aim), "next": F.lead(now).over(order),
            "heard_until": F.when(known, before("segment_end").cast("double") + 0.05), "marks": F.array_compact(F.array(*[F.when(yes(held), name) for name, held in marks.items()])),
        }
    )


def _options(boxes: tuple[Box, ...]) -> Column:
    """What the boxes that hold a line leave for the fold, those that win first: the boxes are one constant array, filtered."""
    rows = []
    for box in boxes:
        ranges = [F.lit(float(x)).alias(f"{name}_{end}") for name in ("letters", "score", "late", "gap") for end, x in zip(("from", "to"), getattr(box, name), strict=True)]
        rows.append(F.struct(F.lit(box.reason).alias("reason"), F.lit(box.floor).alias("floor"), F.lit(box.flag or "").alias("flag"), F.lit(box.lead).alias("lead"), F.lit(box.short).alias("short"), *ranges))
    time = lambda b: F.when(b["short"], F.col("short")).otherwise(F.col("aim"))
    within = lambda b, name, value: F.col(value).between(b[f"{name}_from"], b[f"{name}_to"])

    def holds(b: Column) -> Column:
        measures = within(b, "letters", "letters") & within(b, "score", "sure") & within(b, "late", "late") & ((b["flag"] == "") | F.array_contains("marks", b["flag"]))
        inside = (b["floor"] != "inside") | (time(b) < F.col("now"))
        # behind the segment heard before, where it is known
        return measures & inside & ((b["floor"] != "heard") | F.col("heard_until").isNull() | (time(b) >= F.col("heard_until")))

    def left(b: Column) -> Column:
        # or else behind the line before
        behind = F.when(b["floor"] != "heard", 0.10).when(b["short"], 0.10).when(F.col("heard_until").isNotNull(), -INF).otherwise(0.05)
        return F.struct(b["reason"].alias("reason"), time(b).alias("time"), b["lead"].alias("lead"), b["gap_from"].alias("gap_from"), b["gap_to"].alias("gap_to"), behind.alias("behind"), (b["floor"] == "inside").alias("strictly"))

    return F.when(F.col("may"), F.transform(F.filter(F.array(*rows), holds), left))


def lyric_refinement(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): lines moved to their forced time, or towards it.

    Rows: timestamp, duration, norm, text, score, segment (number, null: none), segment_end,
    asr_norm and asr_text (of the segment), borrowed, forced (null: none), settled.  Times
    rise by 0.10 at least and stay within the song.
    """
    kind = df.schema["song"].dataType.simpleString()
    part = F.lit(BLEND_PARTS[-1][1])
    for least, share in BLEND_PARTS[-2::-1]:
        part = F.when(F.col("sure") >= least, share).otherwise(part)
    rows = _measured(df)
    asked = rows.select("song", "entry", "now", F.col("duration").cast("double").alias("end"), _options(BOXES).alias("options"), F.try_element_at(_options(BLENDS), F.lit(1)).alias("blend"), F.least(F.col("now") - (F.col("now") - F.col("aim")) * part, F.col("next") - 0.50).alias("part"))

    def fits(option: dict, time: float, before: float, now: float) -> bool:
        low = before + option["behind"]
        return option["gap_from"] <= now - before <= option["gap_to"] and (time > low if option["strictly"] else time >= low)

    def moved(before: float, now: float, end: float, options: list, blend: dict | None, part: float) -> tuple[float, str | None]:
        held = next((o for o in options if fits(o, o["time"], before, now)), None)
        time = None
        if held is not None:
            time = max(before + 0.10, held["time"] - held["lead"]) if held["lead"] else held["time"]
            if before + 0.10 < time < min(end, now):
                return time, held["reason"]
        if blend is not None:
            aim = time if held is not None and held["lead"] else blend["time"]
            if fits(blend, aim, before, now) and before + 0.50 < aim < now and before + 0.10 < part < now:
                return part, blend["reason"]
        return now, None

    def step(lines: list[dict]) -> list[dict]:
        before, last, out = None, None, []
        for r in lines:
            time, reason = r["now"], None
            if r["options"] or r["blend"] is not None:
                time, reason = moved(before, r["now"], r["end"], r["options"], r["blend"], r["part"])
            before, last = time, time if last is None else max(time, last + 0.10)
            out.append({"song": r["song"], "entry": r["entry"], "time": max(0.0, min(r["end"], last)), "reason": reason})
        return out

    return fold_by_song(asked, step, OUT.format(kind=kind))


def tail_blend(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): lines of a repaired tail at their forced time where it is near, or a third of the way to it.

    Rows: timestamp, duration, timing_repair, forced.
    """
    kind = df.schema["song"].dataType.simpleString()

    def step(rows: list[dict]) -> list[dict]:
        times, out = [float(r["timestamp"]) for r in rows], []
        for i, r in enumerate(rows):
            before, after = times[i - 1] if i else 0.0, times[i + 1] if i + 1 < len(times) else float(r["duration"])
            forced, reason = _num(r["forced"], float("nan")), None
            if r["timing_repair"] == "tail-hallucination-acoustic" and before + 0.35 < forced < after - 0.35:
                lead = times[i] - forced
                t = forced if abs(lead) <= 0.35 else times[i] - min(1.60, lead * 0.34) if 0.35 < lead <= 6.0 else None
                if t is not None and before + 0.35 < t < after - 0.35:
                    times[i], reason = t, "tail-forced-blend"
            out.append({"song": r["song"], "entry": r["entry"], "time": times[i], "reason": reason})
        return out

    return fold_by_song(df, step, OUT.format(kind=kind))


def hybrid_windows(lines: DataFrame) -> DataFrame:
    """(song, run, first_target, last_target, first_entry, last_entry, start, end): runs of lines on which two paths disagree, with a line of context on either side.

    lines: song, entry, timestamp, duration, ctc, wx, first_score (of the first token, null:
    none).  A window has 1 to 45 s.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("song").orderBy("entry")
    # a time of 0 counts as missing
    ctc = F.when(F.col("ctc").isNull() | (F.col("ctc") == 0), F.col("timestamp")).otherwise(F.col("ctc"))
    off = F.abs(ctc - F.col("wx"))
    target = (off >= 1.0) | ((off >= 0.45) & (F.coalesce("first_score", F.lit(1.0)) <= 0.05))
    last = F.max("entry").over(Window.partitionBy("song"))
    rows = lines.withColumns({"__target": F.coalesce(target, F.lit(False)), "__last": last, "__before": F.lag("timestamp").over(order), "__after2": F.lead("timestamp", 2).over(order)})
    rows = rows.filter("__target").withColumn("__run", F.col("entry") - F.row_number().over(order))
    runs = rows.groupBy("song", "__run").agg(
        F.min("entry").alias("first_target"), F.max("entry").alias("last_target"), F.max("__last").alias("__last"), F.max("duration").alias("duration"),
        F.min_by(F.coalesce("__before", "timestamp"), "entry").alias("__from"), F.max_by("__after2", "entry").alias("__to"),
    )
    first, final = F.greatest(F.lit(1), F.col("first_target") - 1), F.least("__last", F.col("last_target") + 1)
    start = F.greatest(F.lit(0.0), F.col("__from") - 0.08)
    end = F.when(final >= F.col("__last"), F.col("duration")).otherwise(F.greatest(start + 1.0, F.col("__to") - 0.05))
    out = runs.select("song", "first_target", "last_target", first.cast("int").alias("first_entry"), final.cast("int").alias("last_entry"), start.alias("start"), end.alias("end"))
    return out.filter((F.col("end") - F.col("start")).between(1.0, 45.0)).withColumn("run", F.row_number().over(Window.partitionBy("song").orderBy("first_target")))


def apply_windows(lines: DataFrame, windows: DataFrame, results: DataFrame, weak: float = 0.05) -> DataFrame:
    """Adds realigned and sets timestamp, ctc_score, token_spans and peaks of the lines that a window's result moves.

    results: song, run, entry, start, ctc_score, token_spans (score), peaks (time, score).
    Targets are updated; the line after them only where its first token is weak, or has a
    strong peak well before.
    """
    inside = windows.select("song", "run", "first_target", "last_target", F.col("start").alias("__s"), F.col("end").alias("__e"))
    rows = results.join(inside, ["song", "run"])
    faint = F.coalesce(F.try_element_at("token_spans", F.lit(1))["score"], F.lit(1.0)) <= weak
    early = F.exists("peaks", lambda p: (p["time"] < F.coalesce(F.col("start"), F.lit(0.0)) - 0.45) & (p["score"] >= 0.05))
    asked = F.col("entry").between(F.col("first_target"), F.col("last_target")) | ((F.col("entry") == F.col("last_target") + 1) & (faint | F.coalesce(early, F.lit(False))))
    kept = rows.filter(asked & F.col("start").between(F.col("__s"), F.col("__e")))
    # a line may be the context of one window and the target of the next: the later window counts
    new = kept.groupBy("song", "entry").agg(F.max_by(F.struct("start", "ctc_score", "token_spans", "peaks"), "run").alias("n"))
    out = lines.join(new, ["song", "entry"], "left")
    hit = F.col("n").isNotNull()
    changed = {"timestamp": F.when(hit, F.col("n.start")).otherwise(F.col("timestamp"))}
    changed |= {c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(c)) for c in ("ctc_score", "token_spans", "peaks")}
    return out.withColumns({**changed, "realigned": hit}).drop("n")


def boundary_windows(lines: DataFrame) -> DataFrame:
    """(song, entry, first_entry, last_entry, start, end): lines that begin where the one before ends (0.04 s or less), with their neighbours; 1 to 16 s.

    lines: song, entry, timestamp, duration, token_end (of the last token, null: none).
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("song").orderBy("entry")
    rows = lines.withColumns({"__pt": F.lag("timestamp").over(order), "__pe": F.lag("token_end").over(order), "__nt": F.lead("timestamp").over(order)})
    rows = rows.filter(F.col("token_end").isNotNull() & (F.col("timestamp") - F.col("__pe") <= 0.04))
    start = F.greatest(F.lit(0.0), F.col("__pt") - 0.50)
    end = F.least("duration", F.coalesce(F.col("__nt") + 0.75, F.col("timestamp") + 5.0))
    last = F.when(F.col("__nt").isNull(), F.col("entry")).otherwise(F.col("entry") + 1)
    out = rows.select("song", "entry", (F.col("entry") - 1).alias("first_entry"), last.alias("last_entry"), start.alias("start"), end.alias("end"))
    return out.filter((F.col("end") - F.col("start")).between(1.0, 16.0))


def apply_boundaries(lines: DataFrame) -> DataFrame:
    """(song, entry, time, reason): lines at their local time where that repairs a collapsed boundary.

    Rows: timestamp, duration, ctc_score, token_end, local_time, local_score, local_end
    (null: no local result).  An accepted line's end is the local one for the line after.
    """
    kind = lines.schema["song"].dataType.simpleString()

    def step(rows: list[dict]) -> list[dict]:
        ends, out = [_num(r["token_end"], float("nan")) for r in rows], []
        for i, r in enumerate(rows):
            now, local, reason = float(r["timestamp"]), _num(r["local_time"], float("nan")), None
            gap = now - ends[i - 1] if i and ends[i] == ends[i] else float("nan")
            if gap <= 0.04 and local - now >= 0.30 and _num(r["local_score"]) >= max(0.05, _num(r["ctc_score"]) * 1.05):
                now, reason = local, "zero-gap-boundary-realign"
                ends[i] = _num(r["local_end"], ends[i])
            out.append({"song": r["song"], "entry": r["entry"], "time": now, "reason": reason})
        return out

    return fold_by_song(lines, step, OUT.format(kind=kind))
