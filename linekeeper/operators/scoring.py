"""Line scoring: candidates of a line's time, penalties, the decision, review and trust.

A row holds what is known of a line; the fold carries the revised time of the line before.
Rows: song, entry, timestamp, duration, score, norm_len, manual, raw, raw_score, forced,
risk_review, window_realigned, ctc_score, spans (start, end, score), peaks (time, score),
repeats (of the leading term), ambiguous, duplicate, asr_only_trust, mora_known; where the
columns exist also repeated (one of the twelve lines before has the same text),
timing_trusted and text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekeeper.operators.folds import fold_by_song

# What each finding costs, and the flag that goes with it.
PENALTIES = {
    "candidate_disagreement": 0.25,
    "previous_line_tail_attachment": 0.20,
    "long_line_disagreement": 0.18,
    "short_line_onset_uncertain": 0.16,
    "short_duplicate_asr_consensus": 0.24,
    "phonetic_anchor_disagreement": 0.12,
}
FLAG_OF = {"short_duplicate_asr_consensus": "short_duplicate_asr_consensus_untrusted"}
# How a review is resolved: flag and resolution.
RESOLUTIONS = {
    "local": ("local_vocal_ctc_confirmed", "local-vocal-ctc-confirms-first-token"),
    "weak": ("weak_local_vocal_ctc_resolved", "high-confidence-raw-resolves-weak-local-vocal-ctc"),
    "detached": ("detached_ctc_initial_token_resolved", "high-confidence-raw-resolves-detached-ctc-initial-token"),
}
OUT_OF_BOUNDS = 0.35
ADOPT_SCORE, ADOPT_CONFIDENCE, REVIEW_CONFIDENCE, REVIEW_SPREAD = 0.74, 0.70, 0.68, 1.25

SCHEMA = (
    "song {kind}, entry int, time double, chosen string, confidence double, review boolean, trusted boolean, "
    "candidates array<struct<source: string, time: double, score: double>>, penalties array<string>, flags array<string>, "
    "severity string, resolution string, split string"
)


def _num(x: object, default: float | None = None) -> float | None:
    return default if x is None or x != x else float(x)


@dataclass
class Line:
    """One line with its neighbours' bounds; ``tail``: the end of the last token before it, if there are any."""

    row: dict
    before: float
    after: float
    tail: float | None
    opening: bool = False
    full: float = 1.0
    found: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        r = self.row
        # a time or a score of 0 counts as missing where the rules say so
        self.now = float(r["timestamp"])
        self.spans = list(r["spans"]) if r["spans"] is not None else []
        self.peaks = list(r["peaks"]) if r["peaks"] is not None else []
        pair = len(self.spans) > 1
        self.first = _num(self.spans[0]["score"], 1.0) if pair else 1.0
        self.detached = pair and self.spans[1]["start"] - self.spans[0]["start"] >= 0.45
        self.raw, self.raw_score = _num(r["raw"]), _num(r["raw_score"], 0.0)
        self.ctc = _num(r["ctc_score"], 0.0) or 1.0
        self.local = bool(r["window_realigned"]) and self.first >= 0.50
        unique = not r["ambiguous"] and not r.get("repeated")
        weak = bool(r["window_realigned"]) and self.first <= 0.12 and self.raw_score >= 0.80 and unique
        self.weak = self.raw is not None and weak and self.inside(self.raw) and self.beyond_tail(self.raw, 0.05)
        self.near = [p for p in self.peaks if abs(p["time"] - self.now) <= 0.45 and self.beyond_tail(p["time"], 0.03)]

    def inside(self, t: float, slack: float = 0.05) -> bool:
        return self.before + slack < t < self.after - slack

    def beyond_tail(self, t: float, slack: float) -> bool:
        return self.tail is None or t > self.tail + slack

    def candidates(self) -> list[tuple[str, float, float]]:
        out = [("selected_path", self.now, 0.55 + min(0.35 * self.full, 0.35 * max(0.0, _num(self.row["score"], 0.0))))]
        return out + [c for c in (self._raw(), self._second_token(), self._forced(), self._peak(), self._repeated()) if c]

    def _raw(self) -> tuple[str, float, float] | None:
        """The last rule that applies sets the score."""
        if self.raw is None:
            return None
        score = 0.35 + min(0.45 * self.full, 0.45 * _num(self.row["raw_score"], 0.50))
        if not self.beyond_tail(self.raw, 0.03):
            score = min(score, 0.10)
        if self.local:
            score = 0.05
        elif self.weak:
            score = 0.98
        if self.detached and self.raw_score >= 0.90:
            score = 0.98
        return "raw_asr", self.raw, score

    def _second_token(self) -> tuple[str, float, float] | None:
        if self.detached and self.first < 0.02 and self.raw_score < 0.90 and self.inside(self.spans[1]["start"]):
            return "ctc_detached_initial_token_recovery", float(self.spans[1]["start"]), 0.98
        return None

    def _forced(self) -> tuple[str, float, float] | None:
        t = _num(self.row["forced"])
        return None if t is None else ("whisperx_forced_first", t, 0.58)

    def _peak(self) -> tuple[str, float, float] | None:
        if not self.near:
            return None
        best = max(self.near, key=lambda p: _num(p["score"], 0.0))
        return "ctc_nearby_phonetic_peak", float(best["time"]), 0.48 + min(0.30 * self.full, 0.30 * _num(best["score"], 0.0))

    def _repeated(self) -> tuple[str, float, float] | None:
        if (self.row["repeats"] or 0) < 2 or self.ctc > 0.18 or self.first > 0.05:
            return None
        floor = self.before + 0.20 if self.tail is None else max(self.before + 0.20, self.tail + 0.03)
        early = [(p["time"], p["score"]) for p in self.peaks if floor < p["time"] <= self.now - 0.45 and _num(p["score"], 0.0) >= 0.005]
        if not early:
            return None
        least = max(0.005, 0.65 * max(s for _, s in early))
        return "ctc_repeated_leading_term_onset", float(min(t for t, s in early if s >= least)), 0.97

    def penalties(self, spread: float) -> list[str]:
        n = int(self.row["norm_len"] or 0)
        tests = {
            "candidate_disagreement": spread >= 0.75 and not self.weak,
            "previous_line_tail_attachment": not self.opening and self.now <= self.before + 0.12,
            "long_line_disagreement": n >= 18 and spread >= 1.25 and not self.weak,
            "short_line_onset_uncertain": n <= 4 and spread >= 0.45,
            "short_duplicate_asr_consensus": bool(self.row["duplicate"]) and bool(self.row["asr_only_trust"]),
            "phonetic_anchor_disagreement": bool(self.row["mora_known"]) and bool(self.near) and min(abs(p["time"] - self.now) for p in self.near) > 0.35,
        }
        return [k for k, hit in tests.items() if hit]

    def resolution(self, adopted: str) -> str | None:
        """What settles a review: the local path, or the raw time where it was adopted."""
        if self.local:
            return "local"
        if adopted == "raw_asr" and self.weak:
            return "weak"
        return "detached" if adopted == "raw_asr" and self.detached and self.raw_score >= 0.90 else None


def _decide(line: Line) -> dict:
    r = line.row
    if r["manual"]:
        fixed = {"time": line.now, "chosen": "manual_anchor", "confidence": 1.0, "review": False, "trusted": True, "candidates": [("manual_anchor", line.now, 1.0)]}
        return fixed | {"penalties": [], "flags": ["manual_anchor_resolved"], "severity": None, "resolution": None, "split": None}
    made = [(s, round(t, 3), round(p, 3)) for s, t, p in line.candidates()]
    times = [t for _, t, _ in made]
    spread = max(times) - min(times)
    found = line.penalties(spread)
    flags = [FLAG_OF.get(k, k) for k in found]
    bounded = [(s, t, p if line.inside(t) else round(max(0.0, p - OUT_OF_BOUNDS), 3)) for s, t, p in made]
    ranked = sorted(bounded, key=lambda x: -x[2])  # stable: ties keep their order
    source, time, top = ranked[0]
    confidence = min(1.0, max(0.0, top - sum(PENALTIES[k] for k in found)))
    adopt = source != "selected_path" and top >= ADOPT_SCORE and confidence >= ADOPT_CONFIDENCE and line.inside(time)
    chosen = source if adopt else "selected_path"
    isolated = line.ctc < 0.03 and not flags and spread < 0.75 and not r["risk_review"]
    review = bool(r["risk_review"]) or (confidence < REVIEW_CONFIDENCE and not isolated) or spread >= REVIEW_SPREAD or "short_duplicate_asr_consensus" in found
    settled = line.resolution(chosen)
    review = review and settled is None
    timed = bool(r.get("timing_trusted"))
    if review and timed:
        flags.append("timing_trust_removed_for_review")
    severity = None
    if review:
        severity = "medium" if confidence >= 0.45 else "high"
    elif settled:
        severity = "resolved"
        flags.append(RESOLUTIONS[settled][0])
    text = r.get("text") or ""
    split = text[: max(1, len(text) // 2)] if int(r["norm_len"] or 0) >= 18 and spread >= 1.25 else None
    return {
        "time": time if adopt else line.now,
        "chosen": chosen,
        "confidence": confidence,
        "review": review,
        "trusted": _num(r["score"], 0.0) >= 0.62 or (timed and not review),
        "candidates": ranked,
        "penalties": found,
        "flags": flags,
        "severity": severity,
        "resolution": RESOLUTIONS[settled][1] if settled else None,
        "split": split,
    }


def score_lines(df: DataFrame, full: float = 1.0) -> DataFrame:
    """The decision on each line; returned times rise by 0.05 at least.  A score counts up to ``full``."""
    kind = df.schema["song"].dataType.simpleString()

    def step(rows: list[dict]) -> list[dict]:
        times, out = [float(r["timestamp"]) for r in rows], []
        for i, r in enumerate(rows):
            spans = rows[i - 1]["spans"] if i and rows[i - 1]["spans"] is not None else []
            ends = [s["end"] for s in spans if s["end"] is not None]
            after = times[i + 1] if i + 1 < len(rows) else float(r["duration"])
            got = _decide(Line(r, times[i - 1] if i else 0.0, after, max(ends, default=None), opening=not i, full=full))
            times[i] = got["time"]
            out.append({"song": r["song"], "entry": r["entry"], **got})
        for a, b in zip(out, out[1:], strict=False):
            b["time"] = max(b["time"], a["time"] + 0.05)
        return out

    return fold_by_song(df, step, SCHEMA.format(kind=kind))


def upsert_risks(risks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(song, entry, flags, severity, review_required, resolution, chosen_time, confidence): risks after the decisions.

    A line for review adds its flags to its risk, or makes a new one (medium from a
    confidence of 0.45 on, else high); a resolved line's risk is resolved and gets the flag
    of that alone; all other risks stay.  risks: song, entry, flags, severity, review_required.
    """
    made = decisions.select("song", "entry", F.col("flags").alias("__f"), F.col("review").alias("__r"), F.col("severity").alias("__s"), F.col("resolution").alias("__n"), F.col("time").alias("__t"), F.col("confidence").alias("__c"))
    both = risks.withColumn("__old", F.lit(True)).join(made, ["song", "entry"], "full_outer").filter("__old or __r")
    old, review, settled = F.coalesce("__old", F.lit(False)), F.coalesce("__r", F.lit(False)), F.col("__n").isNotNull()
    own = F.coalesce("flags", F.array().cast("array<string>"))
    flags = F.when(review, F.array_distinct(F.concat(own, F.coalesce("__f", F.array().cast("array<string>"))))).when(settled, F.array_distinct(F.concat(own, F.slice("__f", -1, 1)))).otherwise(own)
    severity = F.when(old & settled & ~review, "resolved").when(old, F.col("severity")).otherwise(F.col("__s"))
    needed = F.when(review, True).when(settled, False).otherwise(F.col("review_required"))
    touched = lambda c: F.when(review, F.col(c))
    return both.select("song", "entry", flags.alias("flags"), severity.alias("severity"), needed.alias("review_required"), F.when(~review, F.col("__n")).alias("resolution"), touched("__t").alias("chosen_time"), touched("__c").alias("confidence"))
