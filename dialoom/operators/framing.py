"""Framing from detections: tracks, primary faces, windows, zones and a lock on the camera."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import visual
from . import packaging, scans, walks
from .intervals import running

TRACKED = "clip long, t int, face int, x double, y double, w double, h double, speaking double, listening double, motion double, track int"


def assign_tracks(faces: DataFrame, reach: float = 0.18, memory: int = 12, cuts: DataFrame | None = None) -> DataFrame:
    """faces(clip, t, face, x, y, w, h, speaking, listening, motion) with track: greedily the nearest track not yet
    used in the frame, distance with 0.35 of the difference in area, within reach; a track lives `memory` frames
    unseen. At cuts(clip, t) of the scene every track counts as missed once more, three times at most. A clip is walked
    frame by frame."""

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        tracks: dict[int, tuple[float, float, float]] = {}
        missed: dict[int, int] = {}
        number = 1
        for _, frame in groupby(rows, itemgetter(0)):
            used = set()
            for nth, f in enumerate(frame):
                if nth == 0 and f[-1]:
                    for k in missed:
                        missed[k] = min(3, missed[k] + 1)
                x, y, a = f[2], f[3], f[4] * f[5]
                gaps = {k: ((x - v[0]) ** 2 + (y - v[1]) ** 2) ** 0.5 + abs(a - v[2]) * 0.35 for k, v in tracks.items() if k not in used}
                near = min(gaps, key=gaps.get, default=None)
                if near is None or gaps[near] > reach:
                    near, number = number, number + 1
                used.add(near)
                tracks[near], missed[near] = (x, y, a), 0
                yield (*f[:-1], near)
            for k in [k for k in tracks if k not in used]:
                missed[k] += 1
                if missed[k] > memory:
                    del tracks[k], missed[k]

    columns = ["clip", "t", "face", "x", "y", "w", "h", "speaking", "listening", "motion"]
    faces = faces.select(*columns)
    marked = faces.withColumn("cut", F.lit(False)) if cuts is None else faces.join(cuts.select("clip", "t", F.lit(True).alias("cut")).distinct(), ["clip", "t"], "left").select(*columns, F.coalesce("cut", F.lit(False)).alias("cut"))
    dealt = marked.withColumn("clip", F.col("clip").cast("long"))
    return walks.walked(dealt, ["clip"], ["t", "face"], walk, dict(x.split() for x in TRACKED.split(", ")[1:]))


def priority() -> Column:
    return F.col("speaking") * 1.05 + F.col("motion") * 0.42 + F.col("listening") * 0.20 + F.col("w") * F.col("h") * 0.36


def primary_faces(tracked: DataFrame) -> DataFrame:
    """(clip, t, track): the face of highest priority in each frame; the frame before keeps its track, 0.08 helped,
    unless another speaks 0.04 or moves 0.05 more, or is better by 0.02 even so.

    Each frame is a function of the track held before it: the tracks that it would keep stay, any other gives way to the
    best. A long clip is scanned in slices of frames."""
    scored = tracked.withColumn("p", priority())
    frames = scored.groupBy("clip", "t").agg(F.max_by(F.struct("track", "p", "speaking", "motion"), F.struct("p", -F.col("face"))).alias("best"), F.collect_list(F.struct("track", "p", "speaking", "motion")).alias("all"))
    best = F.col("best")
    keeps = F.filter("all", lambda o: ~((best["speaking"] - o["speaking"] >= 0.04) | (best["motion"] - o["motion"] >= 0.05) | (best["p"] >= o["p"] + 0.10)))
    held = F.struct(F.transform(keeps, lambda o: F.struct(o["track"].alias("k"), o["track"].alias("v"))).alias("moves"), best["track"].alias("other"))
    states = scans.scanned(frames.select("clip", F.col("t").alias("nth"), held.alias("f")), ["clip"], scans.looked_up, scans.looked_up_twice, "int")
    return states.select("clip", F.col("nth").cast("int").alias("t"), F.col("state").alias("track"))


def remembered(tracked: DataFrame, cuts: DataFrame, value: str = "speaking", share: float = 0.07, at_cut: float = 0.72, slot: int = 1_000) -> DataFrame:
    """(clip, t, track, score): `value` of each face plus `share` of the score that its track had before, within 0..1. Each
    of cuts(clip, t) of the scene in between lets that fade by at_cut.

    A score is a bounded linear function of the one before, so a long track is scanned in slices of frames."""
    marks = tracked.select(F.col("clip").alias("source_id"), F.col("t").cast("long").alias("key"), F.lit(0).alias("cut")).union(cuts.select("clip", F.col("t").cast("long"), F.lit(1))).groupBy("source_id", "key").agg(F.max("cut").alias("cut"))
    passed = running(marks, {"cuts": "cut"}, slot).select(F.col("source_id").alias("clip"), F.col("key").cast("int").alias("t"), "cuts")
    rows = tracked.select("clip", "t", "track", F.col(value).alias("v")).join(passed, ["clip", "t"])
    fade = F.coalesce(F.pow(F.lit(at_cut), F.col("cuts") - F.lag("cuts").over(Window.partitionBy("clip", "track").orderBy("t"))), F.lit(0.0))
    f = F.struct((share * F.col("fade")).alias("keep"), F.col("v").cast("double").alias("add"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    states = scans.scanned(rows.withColumn("fade", fade).select("clip", "track", F.col("t").alias("nth"), f.alias("f")), ["clip", "track"], scans.decayed, scans.decayed_twice, "double")
    return states.select("clip", F.col("nth").cast("int").alias("t"), "track", F.round("state", 6).alias("score"))


def window_targets(tracked: DataFrame, frames: int, margin: float = 0.14) -> DataFrame:
    """(clip, window, kind, track, x, y) of windows of `frames` frames: where the view aims.

    Of each track its largest face counts, and tracks rank by speaking, listening and area. The two best are shown together
    (`pair`) where they are `margin` apart, alike in size (0.35) and in speaking (0.12). Else the best one is, unless the
    clip's dominant track (that of anchors()) is in the window and is not outdone: by 0.14 in speaking or 0.12 in rank."""
    rank = F.col("speaking") * 1.15 + F.col("listening") * 0.35 + F.col("w") * F.col("h") * 0.55
    area = F.col("w") * F.col("h")
    best = tracked.withColumn("window", F.floor(F.col("t") / frames)).withColumns({"rank": rank, "area": area}).groupBy("clip", "window", "track").agg(F.max_by(F.struct("rank", "x", "y", "area", "speaking"), F.struct("area", -F.col("t"), -F.col("face"))).alias("b"))
    ranked = best.groupBy("clip", "window").agg(F.sort_array(F.collect_list(F.struct("b.rank", (-F.col("track")).alias("o"), "b.x", "b.y", "b.area", "b.speaking")), asc=False).alias("r"))
    one, two = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    pair = two.isNotNull() & (F.abs(one["x"] - two["x"]) >= margin) & (F.least(one["area"], two["area"]) >= F.greatest(one["area"], two["area"]) * 0.35) & (F.abs(one["speaking"] - two["speaking"]) <= 0.12)
    own = F.get(F.filter("r", lambda f: f["o"] == -F.col("dominant")), F.lit(0))
    held = own.isNotNull() & ~((one["speaking"] >= own["speaking"] + 0.14) | (one["rank"] >= own["rank"] + 0.12))
    both = ranked.join(anchors(tracked).select("clip", F.col("track").alias("dominant")), "clip").withColumns({"pair": F.coalesce(pair, F.lit(False)), "pick": F.when(held, own).otherwise(one)})
    kind = F.when(F.col("pair"), "pair").when(F.col("pick.o") == one["o"], "best").otherwise("dominant")
    middle = lambda c: F.round(F.when(F.col("pair"), (one[c] + two[c]) / 2.0).otherwise(F.col("pick")[c]), 4)
    return both.select("clip", "window", kind.alias("kind"), F.when(~F.col("pair"), -F.col("pick.o")).alias("track"), middle("x").alias("x"), middle("y").alias("y"))


def focus_stats(frames: DataFrame) -> DataFrame:
    """Per clip of frames(clip, t, detected, persons, x, y, w, h): presence shares and means of detected frames."""
    face, person = F.avg(F.col("detected").cast("int")), F.avg((F.col("persons") > 0).cast("int"))
    return frames.groupBy("clip").agg(
        F.round(face, 4).alias("face_presence"), F.round(person, 4).alias("person_presence"), F.round(F.greatest(face, person * 0.88), 4).alias("subject_presence"),
        F.round(F.coalesce(F.avg(F.when(F.col("detected"), F.col("w") * F.col("h"))), F.lit(0.0)), 4).alias("avg_face_size"), F.round(F.avg("x"), 4).alias("avg_center_x"), F.round(F.avg("y"), 4).alias("avg_center_y"),
    )


def anchors(tracked: DataFrame, least: float = 0.05) -> DataFrame:
    """Per clip: the centroid of faces weighted by area, `least` at least, and the track of the largest summed weight
    of speaking, listening and area."""
    weight = F.greatest(F.lit(least), F.col("w") * F.col("h"))
    centroid = tracked.groupBy("clip").agg(F.round(F.sum(F.col("x") * weight) / F.sum(weight), 4).alias("x"), F.round(F.sum(F.col("y") * weight) / F.sum(weight), 4).alias("y"))
    mass = F.greatest(F.lit(0.02), F.col("speaking") * 0.55 + F.col("listening") * 0.20 + F.col("w") * F.col("h"))
    tracks = tracked.groupBy("clip", "track").agg(F.sum(mass).alias("mass")).groupBy("clip").agg(F.max_by("track", F.struct(F.round("mass", 6), -F.col("track"))).alias("track"))
    return centroid.join(tracks, "clip")


def window_centers(tracked: DataFrame, frames: int) -> DataFrame:
    """Per (clip, window) of `frames` frames: the best face of each track, and the middle of the two best tracks where
    they are far apart (0.18) and of like weight (0.35), else the best one's center."""
    w = tracked.withColumn("window", F.floor(F.col("t") / frames)).withColumn("p", priority())
    best = w.groupBy("clip", "window", "track").agg(F.max_by(F.struct("x", "y", "p"), F.struct("p", -F.col("t"), -F.col("face"))).alias("b"))
    ranked = best.groupBy("clip", "window").agg(F.sort_array(F.collect_list(F.struct(F.col("b.p").alias("p"), (-F.col("track")).alias("o"), F.col("b.x").alias("x"), F.col("b.y").alias("y"))), asc=False).alias("r"))
    one, two = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    pair = two.isNotNull() & (F.abs(one["x"] - two["x"]) >= 0.18) & (one["p"] - two["p"] <= 0.35 * one["p"])
    middle = lambda c: F.round(F.when(pair, (one[c] + two[c]) / 2).otherwise(one[c]), 4)
    return ranked.select("clip", "window", middle("x").alias("x"), middle("y").alias("y"), F.coalesce(pair, F.lit(False)).alias("two_shot"), (-one["o"]).alias("track"))


def camera_lock(centers: DataFrame, hold: int = 2, step: float = 0.12) -> DataFrame:
    """Windows with the track the camera shows: a new one must lead for `hold` windows; the view moves at most `step`
    a window. A clip is walked window by window."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        locked, waiting, count, at, out = None, None, 0, None, []
        for r in pdf.sort_values("window").itertuples(index=False):
            state = "keep"
            if locked is None:
                locked, at, state = r.track, r.x, "start"
            elif r.track != locked:
                count = count + 1 if r.track == waiting else 1
                waiting, state = r.track, "pend"
                if count >= hold:
                    locked, waiting, count, state = r.track, None, 0, "switch"
            else:
                waiting, count = None, 0
            goal = r.x if r.track == locked else at
            at = at + max(-step, min(step, goal - at))
            out.append((r.clip, r.window, locked, round(at, 4), state))
        return pd.DataFrame(out, columns=["clip", "window", "track", "x", "state"])

    return centers.groupBy("clip").applyInPandas(walk, "clip long, window long, track int, x double, state string")


def glide(windows: DataFrame, span: int = 2) -> DataFrame:
    """windows(clip, window, track, x, state): where the track changes, the next `span` centers move over from the one
    before, later windows starting from what earlier ones were given."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window").reset_index(drop=True)
        x, track = pdf["x"].tolist(), pdf["track"].tolist()
        for i in range(1, len(x)):
            if track[i] != track[i - 1]:
                start, n = x[i - 1], min(span, len(x) - i)
                for k in range(n):
                    share = (k + 1) / (n + 1)
                    x[i + k] = start * (1 - share) + x[i + k] * share
        return pdf.assign(x=[round(v, 6) for v in x])[["clip", "window", "track", "x", "state"]]

    return windows.groupBy("clip").applyInPandas(walk, "clip long, window long, track int, x double, state string")


def merged_windows(windows: DataFrame, near: float = 0.02) -> DataFrame:
    """Neighbouring windows of one track and state whose centers are at most `near` apart as one (clip, first, last,
    track, x), x the mean weighted by length."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values("window").itertuples(index=False):
            last = out[-1] if out else None
            if last and r.window == last[2] + 1 and r.track == last[3] and r.state == last[5] and abs(r.x - last[4]) <= near:
                n = last[2] - last[1] + 1
                last[2], last[4] = r.window, (last[4] * n + r.x) / (n + 1)
            else:
                out.append([r.clip, r.window, r.window, r.track, r.x, r.state])
        return pd.DataFrame([(*o[:4], round(o[4], 6)) for o in out], columns=["clip", "first", "last", "track", "x"])

    return windows.groupBy("clip").applyInPandas(walk, "clip long, first long, last long, track int, x double")


def speaker_zones(speakers: DataFrame, width: int, height: int) -> DataFrame:
    """speakers(source_id, speaker), named ones only, with the crop zone of each in alphabetical order: the middle half
    for one, halves for two, thirds for three or more; later ones get the middle half."""
    over = Window.partitionBy("source_id")
    placed = speakers.distinct().withColumn("nth", F.row_number().over(over.orderBy("speaker")) - 1).withColumn("n", F.least(F.lit(3), F.count("*").over(over)))
    size = F.floor(F.lit(width) / F.col("n"))
    x = F.when((F.col("n") == 1) | (F.col("nth") >= 3), width // 4).otherwise(F.col("nth") * size)
    wide = F.when((F.col("n") == 1) | (F.col("nth") >= 3), width // 2).otherwise(F.least(F.greatest(size, F.lit(width // 3)), width - F.col("nth") * size))
    return placed.select("source_id", "speaker", x.cast("int").alias("x"), F.lit(0).alias("y"), wide.cast("int").alias("w"), F.lit(height).alias("h"))


def visual_conversation(switches: Column, windows: Column, centered: Column, dialogue: Column, fallback: Column, center_used: Column, preserved: Column | None = None) -> Column:
    """Score in 0..1 of a clip's switching rhythm, best near a switch in three windows, and of who is in view. centered:
    the rate of windows with a centered speaker; fallback: windows that show a listener or a person instead; center_used,
    preserved: whether the middle of the frame, or a crop that keeps faces whole, had to serve."""
    n = F.greatest(F.lit(1), windows)
    rate = F.least(F.lit(1.0), F.greatest(F.lit(0), switches) / F.greatest(F.lit(1), n - 1))
    centered = F.greatest(F.lit(0.0), F.least(F.lit(1.0), centered))
    share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0), c) / n)
    spoilt = F.when(center_used, 0.42).otherwise(0.0) + (F.lit(0.0) if preserved is None else F.when(preserved, 0.24).otherwise(0.0))
    rhythm = (1.0 - F.least(F.lit(1.0), F.abs(rate - 0.32) / 0.32)) * 0.24 + F.least(F.lit(1.0), rate * 1.2) * 0.12
    score = centered * 0.24 + share(dialogue) * 0.24 + share(fallback) * 0.16 + rhythm - F.least(F.lit(1.0), spoilt + (1.0 - centered) * 0.32) * 0.22
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def safe_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct<x, y, w, h> of the corner box of a center and size, kept inside the unit square; sizes 0.05 at least."""
    w, h = F.greatest(F.lit(0.05), F.least(F.lit(1.0), w)), F.greatest(F.lit(0.05), F.least(F.lit(1.0), h))
    corner = lambda c, s: F.round(F.greatest(F.lit(0.0), F.least(1.0 - s, c - s / 2)), 4)
    return F.struct(corner(x, w).alias("x"), corner(y, h).alias("y"), F.round(w, 4).alias("w"), F.round(h, 4).alias("h"))


def speaker_plan(segments: DataFrame, width: int, height: int, order: str = "seg_idx") -> DataFrame:
    """Cuts of segments(source_id, order, start_ms, end_ms, speaker): consecutive segments of one speaker as one cut
    (source_id, cut, start_ms, end_ms, speaker, x, y, w, h) with the speaker's zone. Generic names are NEUTRAL, which is
    shown by the middle half, like named speakers after the third; segments without length are left out."""
    named = F.when(packaging.is_generic_speaker(F.col("speaker"), packaging.GENERIC_SPEAKERS), "NEUTRAL").otherwise(F.col("speaker"))
    rows = segments.where("end_ms > start_ms").withColumn("speaker", named)
    over = Window.partitionBy("source_id").orderBy(order)
    new = F.when(F.col("speaker") == F.lag("speaker").over(over), 0).otherwise(1)
    rows = rows.withColumn("new", new).withColumn("cut", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = rows.groupBy("source_id", "cut").agg(F.min_by("start_ms", order).alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"), F.first("speaker").alias("speaker")).where("end_ms > start_ms")
    zones = speaker_zones(rows.where("speaker <> 'NEUTRAL'").select("source_id", "speaker"), width, height)
    other = {"x": width // 4, "y": 0, "w": width // 2, "h": height}
    return cuts.join(zones, ["source_id", "speaker"], "left").select("source_id", "cut", "start_ms", "end_ms", "speaker", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in other.items()))


def best_faces(faces: DataFrame, turns: DataFrame, slot: int) -> DataFrame:
    """turns(clip, turn, start, end) with the center (x, y) of the best detected face of faces(clip, t, face, x, y, w, h,
    speaking, listening, detected) within each turn, the clip's best where a turn has none, the middle where the clip has
    none. Times meet in slots of `slot`, on equal keys."""
    best = lambda by: F.max_by(F.struct("x", "y"), F.struct((F.col("speaking") * 1.15 + F.col("listening") * 0.35 + F.col("w") * F.col("h") * 0.55).alias("p"), (-F.col("t")).alias("a"), (-F.col("face")).alias("b"))).alias(by)
    seen = faces.where("detected")
    slots = turns.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor((F.col("end") - 1) / slot)))).where("end > start").alias("u")
    at = seen.withColumn("slot", F.floor(F.col("t") / slot)).alias("f")
    inside = (F.col("u.clip") == F.col("f.clip")) & (F.col("u.slot") == F.col("f.slot")) & (F.col("f.t") >= F.col("u.start")) & (F.col("f.t") < F.col("u.end"))
    own = slots.join(at, inside).select("u.clip", "turn", "x", "y", "w", "h", "speaking", "listening", "t", "face").groupBy("clip", "turn").agg(best("own"))
    every = seen.groupBy("clip").agg(best("any"))
    shown = turns.join(own, ["clip", "turn"], "left").join(every, "clip", "left")
    center = F.coalesce("own", "any")
    return shown.select("clip", "turn", "start", "end", F.coalesce(center["x"], F.lit(0.5)).alias("x"), F.coalesce(center["y"], F.lit(0.5)).alias("y"))


def acquisition(samples: DataFrame, by: str) -> DataFrame:
    """Per clip of samples(by, detected, faces, persons, memory), numbers of what is seen: presence shares, peaks, state."""
    face, person = F.avg(F.col("detected").cast("int")), F.avg((F.col("persons") > 0).cast("int"))
    found = samples.groupBy(by).agg(
        face.alias("face"), person.alias("person"), F.max("faces").alias("visible_faces_peak"), F.max("persons").alias("visible_persons_peak"), F.max("memory").alias("recent_face_memory_peak")
    )
    state = visual.acquisition_state(F.col("face"), F.col("person"), F.col("visible_faces_peak"), F.col("visible_persons_peak"), F.col("recent_face_memory_peak"))
    presence = F.greatest(F.col("face"), F.col("person") * 0.88)
    return found.select(by, state.alias("state"), F.round("face", 4).alias("face_presence"), F.round("person", 4).alias("person_presence"), F.round(presence, 4).alias("subject_presence"), "visible_faces_peak", "visible_persons_peak", "recent_face_memory_peak")


#: What evidence is compared by, in order; missing numbers count as 0.
EVIDENCE = ("visible_faces", "recent_face_memory_count", "lock_confidence", "top_tracks", "visible_persons")


def best_evidence(windows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Of each group of windows with EVIDENCE the row of the largest evidence, the first by `tie` among equals."""
    packed = F.struct(*(F.col(c) for c in windows.columns if c not in by))
    key = F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in EVIDENCE), (-F.col(tie)).alias("tie"))
    return windows.groupBy(*by).agg(F.max_by(packed, key).alias("best")).select(*by, "best.*")


def crop_probe(clips: DataFrame, samples: DataFrame, quarters: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """clips(clip, start, end) with what the final crop shows at some quarters of its length: (clip, points, face_min,
    face_avg, subject_min, drifts) of the samples(clip, t, face, subject) nearest to these points, the earlier of two.

    Points and samples are put in one order, and the last sample before and the first after each point are kept; drifts: whether
    a point shows less than 0.08 of a face and another one more. A clip without samples counts as one that shows nothing."""
    at = F.explode(F.array(*((F.col("start") + F.floor((F.col("end") - F.col("start")) * q / 4)).cast("long") for q in quarters)))
    points = clips.where("end >= start").select("clip", at.alias("t")).distinct().withColumn("asks", F.lit(True))
    seen = samples.select("clip", F.col("t").cast("long").alias("t"), F.lit(False).alias("asks"), F.struct("t", "face", "subject").alias("s")).join(clips.select("clip").distinct(), "clip", "left_semi")
    both = seen.unionByName(points, allowMissingColumns=True)
    by = Window.partitionBy("clip")
    sofar, tocome = by.orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0), by.orderBy(F.desc("t"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"a": F.last("s", True).over(sofar), "b": F.last("s", True).over(tocome)}).where("asks")
    hit = F.when(F.col("a").isNull() | (F.col("b.t") - F.col("t") < F.col("t") - F.col("a.t")), F.col("b")).otherwise(F.col("a"))
    shown = near.select("clip", hit.alias("h")).withColumns({"face": F.coalesce("h.face", F.lit(0.0)), "subject": F.coalesce("h.subject", F.lit(0.0))})
    low, high = F.min("face"), F.max("face")
    return shown.groupBy("clip").agg(F.count("*").alias("points"), F.round(low, 4).alias("face_min"), F.round(F.avg("face"), 4).alias("face_avg"), F.round(F.min("subject"), 4).alias("subject_min"), ((low < 0.08) & (high >= 0.08)).alias("drifts"))
