"""From matched segments to times: the place in a segment, lines without one, lines that share one.

``fuzzy_match`` (joins) gives each line's segment; here a song's lines and segments become times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions import blocks
from linekeeper.operators.folds import fold_pairs


def place_in_segment(norm: Column, start: Column, end: Column, seg_norm: Column, chars: Column) -> Column:
    """Time of a line's text in its segment: that of the matching character, else by its share of the text; the start where it isn't found.

    chars: array of (ch, t), whose characters are the segment's matching text.
    """
    spelled = F.array_join(F.transform(chars, lambda c: c["ch"]), "")
    at = F.instr(spelled, norm)
    exact = F.when(at > 0, F.try_element_at(chars, at)["t"])
    near = exact.between(start - 0.10, end + 0.10)
    share = (F.instr(seg_norm, norm) - 1) / F.length(seg_norm)
    guess = F.when((F.instr(seg_norm, norm) > 1) & (end - start > 0.05), start + (end - start) * F.least(F.lit(0.95), share))
    has_chars = F.coalesce(F.size(chars), F.lit(0)) > 0
    return F.when(has_chars & near, exact).when(~has_chars, F.coalesce(guess, start)).otherwise(start)


def suffix_time(norm: Column, start: Column, end: Column, chars: Column) -> Column:
    """Time of a text that ends its segment and is most of it (ratio 0.75), where it begins within a second of the segment; else null.

    The longest block that both share is the text itself, so the ratio follows from the lengths.
    Seconds count to the microsecond: what far times leave over in a difference decides nothing.
    """
    spelled = F.array_join(F.transform(chars, lambda c: c["ch"]), "")
    n, total = F.length(norm), F.length(norm) + F.length(spelled)
    at = F.instr(spelled, norm)
    t = F.try_element_at(chars, at)["t"]
    fits = (n > 0) & spelled.endswith(norm) & (2 * n >= 0.75 * total) & (at > 1)
    return F.when(fits & t.between(start - 0.10, end + 0.10) & (F.round(t - start, 6) <= 1.0), t)


def char_time(norm: Column, start: Column, end: Column, chars: Column) -> Column:
    """Time of the character at which a text begins in its segment's characters, else by its suffix; null if it is out of the segment or not there."""
    spelled = F.array_join(F.transform(chars, lambda c: c["ch"]), "")
    at = F.instr(spelled, norm)
    t = F.try_element_at(chars, at)["t"]
    exact = F.when(t.between(start - 0.10, end + 0.10), t)
    return F.when((F.length(norm) > 0) & (F.size(chars) > 0), F.when(at > 0, exact).otherwise(suffix_time(norm, start, end, chars)))


def text_time(norm: Column, start: Column, end: Column, seg_norm: Column, latin: Column | None = None, seg_latin: Column | None = None) -> Column:
    """Time of a text in its segment by its share of the characters; by the longest romaji prefix (18 to 5) where the text itself isn't there; else null."""
    at, basis = F.instr(seg_norm, norm), F.length(seg_norm)
    if latin is not None and seg_latin is not None:
        lengths = F.sequence(F.least(F.length(latin), F.lit(18)), F.lit(5), F.lit(-1))
        found = F.filter(F.transform(F.when(F.length(latin) >= 5, lengths), lambda k: F.instr(seg_latin, F.left(latin, k))), lambda x: x > 0)
        sound = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(0))
        basis = F.when(at > 0, basis).otherwise(F.length(seg_latin))
        at = F.when(at > 0, at).otherwise(sound)
    seconds = F.greatest(F.lit(0.0), end - start)
    share = start + seconds * F.least(F.lit(0.95), (at - 1) / basis)
    inside = F.when(share.between(start - 0.10, end + 0.10), share)
    return F.when((F.length(norm) > 0) & (F.length(seg_norm) > 0) & (at > 0), F.when(at == 1, start).when((seconds > 0.05) & (basis > 0), inside))


def token_peaks(frames: DataFrame, seconds: float, offset: float = 0.0, limit: int = 8) -> DataFrame:
    """(song, entry, peaks): of each line's first-token posteriors (song, entry, frame, value) the highest local maxima, the later frame first on ties; beyond the ends counts as -1."""
    order = Window.partitionBy("song", "entry").orderBy("frame")
    top = frames.withColumns({"__l": F.lag("value", 1, -1.0).over(order), "__r": F.lead("value", 1, -1.0).over(order)})
    top = top.filter((F.col("value") >= F.col("__l")) & (F.col("value") >= F.col("__r")))
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("value", "frame"))))
    rows = top.groupBy("song", "entry").agg(F.slice(ranked, 1, limit).alias("r"))
    one = lambda x: F.struct(F.round(F.lit(offset) + x["frame"] * F.lit(seconds), 3).alias("time"), F.round(x["value"], 6).alias("score"))
    return rows.select("song", "entry", F.transform("r", one).alias("peaks"))


def earlier_duplicates(matches: DataFrame, segments: DataFrame) -> DataFrame:
    """(song, entry, segment, score): matches moved to a segment shortly before that is nearly the same.

    matches: song, entry, norm, segment, score; segments: song, seg_idx, start, norm.  First up
    to 2 back within 2.5 s where it fits about as well, then up to 3 back within 5 s where it
    opens the line.
    """
    number = lambda v: float("nan") if v is None else v

    def many(songs: list[tuple]) -> list[tuple]:
        lines, parts = [], []  # of all songs: [song, entry, text, segments, place among them, score]; (number, start, text)
        for key, left, right in songs:
            segs = [(s["seg_idx"], number(s["start"]), s["norm"] or "") for s in right]
            place = {s[0]: i for i, s in enumerate(segs)}
            lines += [[key, r["entry"], r["norm"] or "", len(parts), None if r["segment"] is None else place.get(r["segment"]), number(r["score"])] for r in left]
            parts.append(segs)
        # fixed values: how far back, within how many seconds, how alike
        for back, seconds, least in ((2, 2.5, 0.70), (3, 5.0, 0.86)):
            asked = []
            for n, (_, _, text, song, at, _) in enumerate(lines):
                segs = parts[song]
                for k in range(at - 1, max(-1, at - back - 1), -1) if at else ():
                    # what costs little is asked first; a null start is near none
                    if segs[k][2] and segs[at][1] - segs[k][1] <= seconds and (back == 2 or text.startswith(segs[k][2])):
                        asked.append((n, k, segs[k][2], segs[at][2]))
            alike = blocks.at_least([x[2] for x in asked], [x[3] for x in asked], least).tolist()
            asked = [x for x, y in zip(asked, alike, strict=True) if y]
            fits = blocks.scores([lines[x[0]][2] for x in asked], [x[2] for x in asked]).tolist() if back == 2 else [0.80] * len(asked)
            moved = set()
            for (n, k, _, _), fit in zip(asked, fits, strict=True):
                line = lines[n]
                if n not in moved and (back == 3 or fit >= line[5] - 0.05):
                    moved.add(n)
                    line[4], line[5] = k, max(line[5], fit)
        return [(key, entry, None if at is None else parts[song][at][0], score) for key, entry, _, song, at, score in lines]

    kind = matches.schema["song"].dataType.simpleString()
    left = matches.select("song", F.col("entry").cast("int").alias("entry"), "norm", F.col("segment").cast("int").alias("segment"), "score")
    right = segments.select("song", F.col("seg_idx").cast("int").alias("seg_idx"), "start", "norm")
    return fold_pairs(left, right, many, f"song {kind}, entry int, segment int, score double")


def _fill(rows: list[dict], segs: dict[int, dict], duration: float) -> None:
    """Lines without a time: from a shared segment, the segment after, the silence after a segment, or the neighbours."""
    after, known = [None] * len(rows), None
    for i in range(len(rows) - 1, -1, -1):
        after[i], known = known, known if rows[i]["t"] is None else i
    for i, r in enumerate(rows):
        if r["t"] is not None:
            continue
        left, right = i - 1 if i else None, after[i]  # every line before has got a time
        a, b = (rows[k] if k is not None else None for k in (left, right))
        if a and b and a["segment"] is not None and a["segment"] == b["segment"]:
            r.update(segment=a["segment"], t=segs[a["segment"]]["start"], how="shared")
            continue
        if b and b["segment"] is not None:
            start = segs[b["segment"]]["start"]
            if a is None or 0.4 < start - a["t"] <= 4.2:
                r.update(segment=b["segment"], t=start, borrowed=True, how="borrowed")
                continue
        if a and b and a["segment"] is not None and not r["marker"] and b["t"] - segs[a["segment"]]["end"] >= 6.0:
            offset = min(3.2, max(2.8, 0.45 * len(r["norm"] or "")))
            r.update(t=min(b["t"] - 0.50, segs[a["segment"]]["end"] + offset), how="tail")
        elif a and b:
            r.update(t=a["t"] + (b["t"] - a["t"]) * (i - left) / (right - left), how="between")
        elif a:
            r.update(t=min(duration, a["t"] + 2.0 * (i - left)), how="after")
        elif b:
            r.update(t=max(0.0, b["t"] - 2.0 * (right - i)), how="before")
        else:
            r.update(t=0.0, how="none")


def _split_borrowed(rows: list[dict], segs: dict[int, dict]) -> None:
    """A borrowed line and the next one divide their segment, the next from 55 % on."""
    for r, after in zip(rows, rows[1:], strict=False):
        if r["borrowed"] and r["segment"] is not None and after["segment"] == r["segment"]:
            s = segs[r["segment"]]
            r["t"] = s["start"]
            after["t"] = max(after["t"], s["start"] + 0.55 * max(0.0, s["end"] - s["start"]))


def _late_before_gaps(rows: list[dict], segs: dict[int, dict]) -> None:
    """A line on a long segment that doesn't hold its text, before a long gap, goes close to the next line."""
    for i in range(1, len(rows) - 1):
        r, before, after = rows[i], rows[i - 1], rows[i + 1]
        if None in (r["segment"], after["segment"]) or r["segment"] == after["segment"] or r["score"] < 0.60:
            continue
        s, text = segs[r["segment"]], r["norm"] or ""
        seg_text = s["norm"] or ""
        direct = bool(text) and (text in seg_text or seg_text in text or r["score"] >= 0.82)
        apart = after["t"] - s["end"] >= 6.0 and after["t"] - r["t"] >= 8.0 and r["t"] - before["t"] >= 4.5 and s["end"] - s["start"] >= 2.5
        shifted = max(before["t"] + 0.10, after["t"] - min(2.8, max(1.4, 1.0 + 0.10 * len(text))))
        if apart and not direct and r["t"] < shifted < after["t"] - 0.30:
            r["t"] = shifted


def _distribute(rows: list[dict], segs: dict[int, dict]) -> None:
    """Lines in a row on one segment spread over the time up to the next segment (18 s at most), or 3.5 s a line."""
    i = 0
    while i < len(rows):
        k = i
        while k < len(rows) and rows[k]["segment"] == rows[i]["segment"]:
            k += 1
        n, seg = k - i, rows[i]["segment"]
        if seg is not None and n > 1:
            start = segs[seg]["start"]
            later = next((segs[r["segment"]]["start"] for r in rows[k:] if r["segment"] not in (None, seg)), None)
            if later is not None and 0.5 < later - start <= 18.0:
                end = later - 0.10
            else:
                end = start + max(0.5, segs[seg]["end"] - start, 3.5 * n)
                end = end if later is None else min(end, later - 0.10)
            width = max(end - start, 0.20 * n)
            for j in range(n):
                share = j / n if n == 2 else j / max(1.0, n - 0.55)
                rows[i + j]["t"] = max(rows[i + j]["t"], start + width * share)
        i = k


def times_from_segments(lines: DataFrame, segments: DataFrame, gap: float = 0.10) -> DataFrame:
    """(song, entry, segment, time, score, borrowed, how) of matched lines.

    lines: song, entry, norm, marker, segment (null if unmatched), score, t (place in the
    segment, null if unmatched), duration.  segments: song, seg_idx, start, end, norm.
    """

    number = lambda v: float("nan") if v is None else float(v)

    def many(songs: list[tuple]) -> list[tuple]:
        out = []
        for _, rows, right in songs:
            segs = {s["seg_idx"]: {**s, "start": number(s["start"]), "end": number(s["end"])} for s in right}
            for r in rows:
                known = r["segment"] is not None and r["segment"] in segs
                r.update(segment=r["segment"] if known else None, t=number(r["t"]) if known else None, score=number(r["score"]), borrowed=False, how="matched")
            if rows:
                duration = number(rows[0]["duration"])
                _fill(rows, segs, duration)
                for repair in (_split_borrowed, _late_before_gaps, _distribute):
                    repair(rows, segs)
                for a, b in zip(rows, rows[1:], strict=False):
                    b["t"] = max(b["t"], a["t"] + gap)
                for r in rows:
                    r["t"] = max(0.0, min(duration, r["t"]))
            out += [(r["song"], r["entry"], r["segment"], r["t"], r["score"], r["borrowed"], r["how"]) for r in rows]
        return out

    kind = lines.schema["song"].dataType.simpleString()
    left = lines.select("song", F.col("entry").cast("int").alias("entry"), "norm", "marker", F.col("segment").cast("int").alias("segment"), "score", "t", "duration")
    right = segments.select("song", F.col("seg_idx").cast("int").alias("seg_idx"), "start", "end", "norm")
    return fold_pairs(left, right, many, f"song {kind}, entry int, segment int, time double, score double, borrowed boolean, how string")
