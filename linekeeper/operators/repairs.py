"""Repairs of a song's times from acoustic and token evidence, as rule tables over a fold.

Rows hold a line with its evidence; the fold knows the revised time before and the original
time after.  Onsets of a song come as an array of peaks (time, strength, plateau middles
already taken), so a rule looks the first one up in its span.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.operators.folds import fold_by_song
from linekeeper.operators.joins import plateaus
from linekeeper.operators.windows import COLLAPSE, TRUSTED

OUT = "song {kind}, entry int, time double, reason string"


def with_peaks(lines: DataFrame, frames: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Adds onsets: the song's peaks, in the order of time."""
    top = plateaus(frames, threshold).groupBy("song").agg(F.array_sort(F.collect_list(F.struct("t", "onset", "times"))).alias("onsets"))
    return lines.join(top, "song", "left")


def _first(onsets: list | None, start: float, end: float, threshold: float, lead_in: float = 0.20) -> float | None:
    """The first peak in the span; with a lead-in the middle of its plateau up to the span's end."""
    if end <= start or onsets is None:
        return None
    peak = next((o for o in onsets if start + lead_in <= o["t"] <= end and o["onset"] >= threshold), None)
    if peak is None:
        return None
    times = [x for x in _field(peak, "times") if x <= end] if lead_in else []
    return float(peak["t"] + times[-1]) / 2 if len(times) > 1 else float(peak["t"])


def _field(peak: dict, name: str) -> list:
    try:
        got = peak[name]
    except (KeyError, ValueError):
        return []
    return [] if got is None else list(got)


@dataclass(frozen=True)
class Rule:
    """Where to look for an onset, and by how much it may move the line (seconds, earlier is positive)."""

    reason: str
    when: Callable[[dict], bool]
    span: Callable[[dict], tuple[float, float]]
    least: float
    most: float
    thresholds: tuple[float, ...] = (0.65,)


def _only(*names: str) -> Callable[[dict], bool]:
    return lambda v: v["score"] >= 0.95 and v["flags"] == list(names)


def _with(*names: str, **limits: float) -> Callable[[dict], bool]:
    """Score 0.95, all flags, and limits: max_len, min_before, min_after, max_after."""

    def test(v: dict) -> bool:
        fits = all(n in v["flags"] for n in names) and v["score"] >= 0.95
        fits = fits and v["norm_len"] <= limits.get("max_len", 10**9) and v["before_gap"] >= limits.get("min_before", float("-inf"))
        return fits and v["after_gap"] >= limits.get("min_after", float("-inf")) and v["after_gap"] <= limits.get("max_after", float("inf"))

    return test


_SPLIT = ("follows_suspicious_long_line", "possible_bad_split_boundary")
# Reasons and limits; the first rule whose condition holds decides.
BOUNDARY_RULES = (
    Rule("first-line-acoustic-onset", lambda v: v["first"] and v["now"] <= 1.0, lambda v: (0.20, max(0.21, v["now"] - 0.10)), 0.12, 0.35),
    Rule("candidate-disagreement-acoustic-backtrack", _only("candidate_disagreement"), lambda v: (max(v["before"] + 0.10, v["now"] - 0.85), v["now"] - 0.12), 0.45, 0.65),
    Rule("short-line-acoustic-backtrack", _with("close_neighbor_onset_uncertain", max_len=4), lambda v: (max(v["before"] + 0.10, v["now"] - 0.85), v["now"] - 0.12), 0.45, 0.65),
    Rule(
        "lead-in-acoustic-forward-onset",
        lambda v: "candidate_disagreement" not in v["flags"] and _with("close_neighbor_onset_uncertain", min_before=2.50, min_after=2.50)(v),
        lambda v: (v["now"] + 0.20, min(v["after"] - 0.10, v["now"] + 0.70)),
        -0.60,
        -0.35,
    ),
    Rule("short-duplicate-bad-split-acoustic-backtrack", _with(*_SPLIT, max_len=12, min_before=3.50, max_after=2.20), lambda v: (max(v["before"] + 0.40, v["now"] - 6.80), v["now"] - 0.45), 1.20, 6.50, (0.65, 0.55)),
    Rule("bad-split-acoustic-forward-onset", _with(*_SPLIT, max_after=2.20), lambda v: (v["now"] + 0.10, min(v["after"] - 0.10, v["now"] + 0.85)), -0.45, -0.25),
)


def _num(x: object, default: float = 0.0) -> float:
    return default if x is None or x != x else float(x)


def _sweep(df: DataFrame, propose: Callable[[dict], tuple[float, str] | None], slack: float) -> DataFrame:
    """The fold that the refinements share: a proposal is taken strictly between the neighbours by ``slack``."""
    kind = df.schema["song"].dataType.simpleString()

    def step(rows: list[dict]) -> list[dict]:
        times, out = [float(r["timestamp"]) for r in rows], []
        for i, r in enumerate(rows):
            before, after = times[i - 1] if i else 0.0, times[i + 1] if i + 1 < len(times) else float(r["duration"])
            got = propose({**r, "first": i == 0, "now": times[i], "before": before, "after": after, "before_gap": times[i] - before, "after_gap": after - times[i]})
            reason = None
            if got and before + slack < got[0] < after - slack:
                times[i], reason = got
            out.append({"song": r["song"], "entry": r["entry"], "time": times[i], "reason": reason})
        return out

    return fold_by_song(df, step, OUT.format(kind=kind))


def acoustic_boundaries(df: DataFrame, rules: tuple[Rule, ...] = BOUNDARY_RULES) -> DataFrame:
    """(song, entry, time, reason) of lines moved to an onset.  Rows: timestamp, duration, score, flags, norm_len, onsets, settled."""

    def propose(v: dict) -> tuple[float, str] | None:
        if v["settled"]:
            return None
        v = {**v, "score": _num(v["score"]), "flags": list(v["flags"]) if v["flags"] is not None else [], "norm_len": int(_num(v["norm_len"]))}
        rule = next((r for r in rules if r.when(v)), None)
        if rule is None:
            return None
        found = next((t for x in rule.thresholds if (t := _first(v["onsets"], *rule.span(v), x)) is not None), None)
        return (found, rule.reason) if found is not None and rule.least <= v["now"] - found <= rule.most else None

    return _sweep(df, propose, 0.05)


def micro_refinement(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): small moves to token-level onsets.

    Rows: timestamp, duration, score, ctc, ctc_score, first_score, raw, raw_score, suspicious.
    Lines under suspicion move by 0.05 to 0.65 s; others only if both recognisers agree on a
    late time and the tokens are clearly earlier.
    """

    def propose(v: dict) -> tuple[float, str] | None:
        ctc, cs, ws = _num(v["ctc"], float("nan")), _num(v["ctc_score"]), _num(v["score"])
        delta = ctc - v["now"]
        if not 0.05 <= abs(delta) <= 0.65 or cs < 0.02 or ws < 0.55 or (delta > 0.30 and ws < 0.85 and cs >= 0.22):
            return None
        if v["suspicious"]:
            return ctc, "small-ctc-whisperx-refinement"
        late = _num(v["raw_score"]) >= 0.65 and abs(_num(v["raw"], float("inf")) - v["now"]) <= 0.08 and -0.55 <= delta <= -0.18
        strong = cs >= 0.18 and ws >= 0.65 and _num(v["first_score"]) >= 0.18
        return (ctc, "asr-late-ctc-onset-refinement") if late and strong else None

    return _sweep(df, propose, 0.10)


def vocal_tiebreak(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): the token-level time where the onset near it is strong and beats the one near the line's.

    Rows: timestamp, duration, ctc, near_onset, ctc_onset (strengths).
    """

    def propose(v: dict) -> tuple[float, str] | None:
        ctc, own, other = _num(v["ctc"], float("nan")), _num(v["near_onset"]), _num(v["ctc_onset"])
        if 0.40 <= abs(ctc - v["now"]) <= 2.0 and other >= 0.50 and other >= own + 0.15:
            return ctc, "demucs-vocal-onset-prefers-ctc"
        return None

    return _sweep(df, propose, 0.10)


def _near_intro(df: DataFrame) -> DataFrame:
    """``df`` with those onsets alone that ``intro_repair`` may ask for: of a song's first line, around the span before its anchor; the fold's shuffle carries no others."""
    place = F.row_number().over(Window.partitionBy("song").orderBy("entry"))
    rows = df.withColumn("__i", place)
    score, time = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)), F.col("timestamp").cast("double")
    found = F.min(F.when((F.col("__i") > 1) & (score >= TRUSTED) & (time >= 20.0), F.struct("__i", time.alias("t")))).over(Window.partitionBy("song"))
    rows = rows.withColumn("__a", found)
    at = F.col("__a.t")
    start = F.greatest(F.lit(0.0), at - F.least(F.lit(12.0), 4.0 * F.col("__a.__i")))
    # a second more on either side: the fold itself decides
    near = F.filter("onsets", lambda o: (o["t"] >= start - 1.0) & (o["t"] <= F.greatest(start + 0.2, at - 6.0) + 1.0) & (o["onset"] >= 0.55))
    asked = (F.col("__i") == 1) & F.col("__a").isNotNull()
    return rows.withColumn("onsets", F.when(asked, near)).drop("__i", "__a")


def intro_repair(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): lines before the first trusted one from 20 s on, spread from an onset, where the first is early and poor.

    Rows: timestamp, duration, score, segment, borrowed, onsets.
    """
    kind = df.schema["song"].dataType.simpleString()
    df = _near_intro(df)

    def step(rows: list[dict]) -> list[dict]:
        times = [float(r["timestamp"]) for r in rows]
        reasons: list[str | None] = [None] * len(rows)
        head = rows[0]
        poor = _num(head["score"]) < COLLAPSE and (head["borrowed"] or _num(head["segment"], -1.0) != -1.0) and times[0] < 10.0
        anchor = next((i for i in range(1, len(rows)) if _num(rows[i]["score"]) >= TRUSTED and times[i] >= 20.0), 0)
        if poor and len(rows) >= 3 and anchor >= 2:
            start = max(0.0, times[anchor] - min(12.0, 4.0 + 4.0 * anchor))
            onset = _first(head["onsets"], start, max(start + 0.2, times[anchor] - 6.0), 0.55)
            if onset is not None and onset > times[0] + 1.0:
                width = max(0.2, times[anchor] - onset)
                for i in range(anchor):
                    spread = onset + width * i / anchor
                    floor = times[i - 1] + 0.10 if i else spread
                    times[i] = min(max(spread, floor), times[anchor] - 0.10 * (anchor - i))
                    reasons[i] = "intro-hallucination-prefix-redistribution"
        return [{"song": r["song"], "entry": r["entry"], "time": t, "reason": why} for r, t, why in zip(rows, times, reasons, strict=True)]

    return fold_by_song(df, step, OUT.format(kind=kind))


def long_segment_repair(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): a line at the start of a segment of 18 s or more that ends with the next line moves to just before that.

    Rows: timestamp, duration, score, segment_start, segment_end, norm_len.
    """

    def propose(v: dict) -> tuple[float, str] | None:
        end = _num(v["segment_end"], float("nan"))
        long = end - _num(v["segment_start"], float("nan")) >= 18.0 and _num(v["score"]) >= 0.80
        if v["first"] or not long or v["after_gap"] < 12.0 or abs(v["after"] - end) > 0.30:
            return None
        t = max(v["before"] + 0.10, v["after"] - min(2.2, max(1.4, _num(v["norm_len"]) * 0.055)))
        return (t, "long-segment-pre-vocal-hallucination") if v["now"] + 5.0 < t < v["after"] - 0.20 else None

    return _sweep(df, propose, 0.0)


def tail_repair(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): a low tail that repeats itself is spread by text weight from a sustained onset.

    Rows: timestamp, duration, weight, tail_entry, repeated_tail, tail_onset (12 s after the
    last good line if null), voice_end.
    """
    kind = df.schema["song"].dataType.simpleString()

    def step(rows: list[dict]) -> list[dict]:
        times = [float(r["timestamp"]) for r in rows]
        reasons: list[str | None] = [None] * len(rows)
        first = int(_num(rows[0]["tail_entry"])) - 1
        if first > 0 and rows[0]["repeated_tail"] and times[first - 1] > 0:
            end = float(rows[0]["duration"])
            start = _num(rows[0]["tail_onset"], min(end, times[first - 1] + 12.0))
            stop = max(start + 1.0, min(end, _num(rows[0]["voice_end"], end)))
            rest = rows[first:]
            if start - times[first - 1] >= 12.0 and stop - start >= max(8.0, 1.4 * len(rest)):
                total, done = sum(float(r["weight"]) for r in rest), 0.0
                for i, r in enumerate(rest, first):
                    times[i] = min(end, max(times[i - 1] + 0.35, start + (stop - start) * done / total))
                    reasons[i] = "tail-hallucination-acoustic"
                    done += float(r["weight"])
        return [{"song": r["song"], "entry": r["entry"], "time": t, "reason": why} for r, t, why in zip(rows, times, reasons, strict=True)]

    return fold_by_song(df, step, OUT.format(kind=kind))


def opening_backtrack(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): a fused line whose first four tokens are weak and later ones strong goes back to an onset.

    Rows: timestamp, duration, fused, ctc_score, token_scores, onsets.
    """

    def propose(v: dict) -> tuple[float, str] | None:
        scores = [_num(s) for s in v["token_scores"]] if v["token_scores"] is not None else []
        weak = len(scores) >= 5 and max(scores[:4]) <= 0.08 and max(scores[4:10]) >= 0.30
        start, end = max(v["before"] + 0.20, v["now"] - 0.90), v["now"] - 0.08
        if not v["fused"] or _num(v["ctc_score"]) < 0.12 or not weak or end - start < 0.20:
            return None
        found = next((t for x in (0.65, 0.55) if (t := _first(v["onsets"], start, end, x)) is not None), None)
        fits = found is not None and 0.25 <= v["now"] - found <= 0.80
        return (found, "weak-opening-ctc-local-fusion-acoustic-onset") if fits else None

    return _sweep(df, propose, 0.05)


# Score and forced lead for which a late onset may move a line forward by so much at most.
LATE_LIMITS = (
    (lambda score, lead: score <= 0.80, 0.65),
    (lambda score, lead: score > 0.90 and lead < 0.90, 0.75),
    (lambda score, lead: score > 0.90 and lead >= 1.60, 0.50),
)


def late_onset(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): a line that is later than its forced time moves on to an onset 0.42 to 0.90 s away.

    Rows: timestamp, duration, score, forced, onsets.
    """

    def propose(v: dict) -> tuple[float, str] | None:
        score, lead = _num(v["score"]), v["now"] - _num(v["forced"], float("nan"))
        if not 0.45 <= lead <= 3.0 or (score > 0.80 and lead > 2.10) or v["after_gap"] < 1.0:
            return None
        found = _first(v["onsets"], v["now"] + 0.42, min(v["now"] + 0.90, v["after"] - 0.12), 0.55, lead_in=0.0)
        fits = found is not None and any(test(score, lead) and found - v["now"] <= most for test, most in LATE_LIMITS)
        return (found, "acoustic-late-onset") if fits else None

    return _sweep(df, propose, 0.10)


@dataclass(frozen=True)
class Initial:
    """How a line may go back, by the first sound of its romaji: to an onset in a span, or to an early token peak."""

    mode: str
    sounds: tuple[str, ...]
    most_score: float
    min_before: float
    min_after: float
    shift: tuple[float, float]
    onset: tuple[float, float, float] | None = None  # least distance from the line before, span's begin and end before the line
    onset_levels: tuple[float, ...] = ()
    peak: tuple[float, float] | None = None  # least score, least share of the strongest


# Modes and limits.
INITIALS = (
    Initial("r-initial-acoustic", ("r",), 0.22, 0.0, 1.2, (0.45, 0.75), (0.80, 0.90, 0.10), (0.55, 0.45)),
    Initial("ctc-first-token-posterior", ("m", "f", "t"), 0.28, 4.0, 7.0, (1.20, 1.90), peak=(0.0005, 0.06)),
    Initial("ctc-near-first-token-posterior", ("m",), 0.12, 2.5, 1.2, (0.55, 0.85), peak=(0.01, 0.55)),
    Initial("ctc-short-acoustic-onset", ("s", "t", "o"), 0.05, 2.5, 2.0, (0.20, 0.55), (0.35, 0.72, 0.10), (0.50, 0.45)),
)


def _pacing_harmed(v: dict, t: float) -> bool:
    """Whether lines of so many characters would be sung less evenly."""

    def error(at: float) -> float:
        return abs((at - v["before"]) / max(1, v["before_len"]) - (v["after"] - at) / max(1, v["norm_len"]))

    return error(v["now"]) <= 0.025 or error(t) > max(0.01, 1.30 * error(v["now"]))


def initial_backtrack(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason): lines back to where their first consonant may have begun.

    Rows: timestamp, duration, romaji, ctc_score, first_score, peaks, onsets, norm_len.
    """
    kind = df.schema["song"].dataType.simpleString()

    def find(rule: Initial, v: dict) -> float | None:
        if rule.onset:
            start, end = max(v["before"] + rule.onset[0], v["now"] - rule.onset[1]), v["now"] - rule.onset[2]
            return next((t for x in rule.onset_levels if (t := _first(v["onsets"], start, end, x)) is not None), None)
        top = max((p["score"] for p in v["peaks"]), default=0.0)
        early = [(p["time"], p["score"]) for p in v["peaks"] if rule.shift[0] <= v["now"] - p["time"] <= rule.shift[1] and p["score"] >= rule.peak[0] and top > 0 and p["score"] / top >= rule.peak[1]]
        time, score = min(early, default=(None, 0.0))
        return None if v["romaji"].startswith("t") and score < 0.02 else time

    def step(rows: list[dict]) -> list[dict]:
        times, out = [float(r["timestamp"]) for r in rows], []
        for i, r in enumerate(rows):
            reason = None
            if i and r["romaji"]:
                before, after = times[i - 1], times[i + 1] if i + 1 < len(times) else float(r["duration"])
                peaks_ = list(r["peaks"]) if r["peaks"] is not None else []
                v = {**r, "peaks": peaks_, "now": times[i], "before": before, "after": after, "before_len": int(_num(rows[i - 1]["norm_len"])), "norm_len": int(_num(r["norm_len"]))}
                fits = lambda x: r["romaji"].startswith(x.sounds) and _num(r["ctc_score"]) <= x.most_score and times[i] - before >= x.min_before and after - times[i] >= max(1.2, x.min_after)  # noqa: B023, E731
                rule = next((x for x in INITIALS if fits(x)), None)
                t = float(found) if rule and (found := find(rule, v)) is not None else None
                if t is not None and rule.shift[0] <= times[i] - t <= rule.shift[1] and before + 0.20 < t < after - 0.20:
                    first = _num(r["first_score"])
                    if rule.mode != "ctc-short-acoustic-onset" or (first < 0.05 and not (first >= 0.04 and _pacing_harmed(v, t))):
                        times[i], reason = t, rule.mode
            out.append({"song": r["song"], "entry": r["entry"], "time": times[i], "reason": reason})
        return out

    return fold_by_song(df, step, OUT.format(kind=kind))


def apply_anchors(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason, error): anchored lines at their anchor's time; an anchor that isn't strictly between its neighbours is an error.

    Rows: timestamp, duration, anchor (seconds, null without one).
    """
    kind = df.schema["song"].dataType.simpleString()

    def step(rows: list[dict]) -> list[dict]:
        times, out = [float(r["timestamp"]) for r in rows], []
        for i, r in enumerate(rows):
            anchor, reason, error = _num(r["anchor"], float("nan")), None, None
            if anchor == anchor:
                anchor = max(0.0, min(float(r["duration"]), anchor))
                if i and anchor <= times[i - 1] + 0.05:
                    error = "not after the line before"
                elif i + 1 < len(times) and anchor >= times[i + 1] - 0.05:
                    error = "not before the next line"
                else:
                    times[i], reason = anchor, "manual-anchor-hint"
            out.append({"song": r["song"], "entry": r["entry"], "time": times[i], "reason": reason, "error": error})
        return out

    return fold_by_song(df, step, OUT.format(kind=kind) + ", error string")


def short_duplicate_recovery(df: DataFrame) -> DataFrame:
    """(song, entry, time, reason, supporting): a short line that was put on a later occurrence goes back to an onset that neighbours' evidence supports.

    Rows: timestamp, duration, onsets, short_duplicate (in the context of a longer line),
    flags, evidence (map of a risk's candidate times).  The onset is within 0.45 s of the
    earliest of the times that the line and five before it hold in the span, 1.20 to 6.80 s
    before the line.
    """
    kind = df.schema["song"].dataType.simpleString()
    sources = ("raw", "raw_asr", "whisperx", "whisperx_forced_first")

    def step(rows: list[dict]) -> list[dict]:
        times, out = [float(r["timestamp"]) for r in rows], []
        held = [dict(r["evidence"]) if r["evidence"] is not None else {} for r in rows]
        for i, r in enumerate(rows):
            now, reason, support = times[i], None, []
            before, after = times[i - 1] if i else 0.0, times[i + 1] if i + 1 < len(times) else float(r["duration"])
            low, high = max(before + 0.40, now - 7.00), now - 0.45
            flagged = r["flags"] is not None and "short_duplicate_asr_consensus_untrusted" in list(r["flags"])
            if r["short_duplicate"] and flagged and now - before >= 3.50 and high - low >= 0.50:
                near = ((rows[k]["entry"], next((held[k][s] for s in sources if held[k].get(s) is not None and low <= held[k][s] <= high), None)) for k in range(max(0, i - 5), i + 1))
                support = [(e, t) for e, t in near if t is not None]
            if support:
                focus = min(t for _, t in support)
                span = max(low, focus - 0.45), min(high, focus + 0.45)
                found = _first(r["onsets"], *span, 0.65) or _first(r["onsets"], *span, 0.55)
                if found and min(abs(found - t) for _, t in support) <= 1.20 and 1.20 <= now - found <= 6.80 and before + 0.05 < found < after - 0.05:
                    times[i], reason = found, "short-duplicate-acoustic-onset-with-neighbor-asr-context"
            out.append({"song": r["song"], "entry": r["entry"], "time": times[i], "reason": reason, "supporting": [e for e, _ in support] if reason else None})
        return out

    return fold_by_song(df, step, OUT.format(kind=kind) + ", supporting array<int>")
