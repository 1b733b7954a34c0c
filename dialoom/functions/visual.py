"""Column functions over detections and windows: evidence, confidence, geometry, acquisition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def unit(x: Column) -> Column:
    """x kept within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def limited(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def log_confidence(log_probability: Column) -> Column:
    """Confidence in 0..1 of a mean log-probability."""
    return unit(1.0 + log_probability / 2.0)


def evidence(w: str = "w", h: str = "h", seen: str = "seen", missed: str = "missed", spoke: str = "last_speaking", listened: str = "last_listening", motion: str = "motion", held: str = "held", faces: str = "face_count", change: str = "scene_change") -> Column:
    """struct of a detected face's scores: visibility and stability of its track, alignment with the turn, speaking,
    listening and lock confidence. held: the face was the primary one before."""
    c, lit = F.col, F.lit
    area = c(w) * c(h)
    visibility = unit(0.35 + F.least(lit(0.55), c(seen) * 0.09) - c(missed) * 0.12 + F.least(lit(0.10), area * 1.5))
    stability = unit(F.least(lit(1.0), c(seen) / 6.0) - c(missed) * 0.08)
    size = unit(F.sqrt(F.greatest(lit(0.0), area)) / 0.24)
    turn = 0.42 + F.least(lit(0.38), c(motion) * 0.62)
    dialogue = F.when(c(faces) >= 2, 0.18).otherwise(0.0)
    bonus = F.when(c(held), 0.12).otherwise(0.0)
    steady = unit(1.0 - F.least(lit(1.0), c(change) / 0.35))
    speaking = visibility * 0.20 + stability * 0.14 + size * 0.10 + c(motion) * 0.34 + turn * 0.10 + dialogue * 0.05 + bonus * 0.55 + c(spoke) * 0.07
    listening = visibility * 0.28 + stability * 0.22 + size * 0.12 + F.when(c(faces) >= 2, 0.18).otherwise(0.04) + c(listened) * 0.12 + bonus * 0.35
    listening = listening + F.when((c(motion) <= 0.04) & (c(faces) >= 2), 0.08).otherwise(0.0)
    lock = unit(speaking) * 0.32 + stability * 0.20 + visibility * 0.18 + bonus * 0.08 + dialogue * 0.10 + steady * 0.06
    made = {
        "face_visibility_score": visibility, "track_stability_score": stability, "subtitle_turn_alignment_score": turn, "dialogue_context_score": dialogue, "previous_anchor_continuity_bonus": bonus,
        "scene_change_consistency": steady, "speaking_score": unit(speaking), "listener_score": unit(listening), "lock_confidence": unit(lock),
    }
    return F.struct(*(F.round(x, 4).alias(n) for n, x in made.items()))


def given(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def speaker_confidence() -> Column:
    """Confidence in 0..1 that a window's target speaks, from alignment, voice, lips, lock and dialogue."""
    voice = F.greatest(given("speaker_confidence"), given("speaker_turn_strength"))
    lock = F.greatest(given("lock_confidence"), given("subject_confidence"))
    dialogue = F.greatest(given("dialogue_likelihood"), given("listener_confidence") * 0.42)
    return unit(given("subtitle_turn_alignment_score") * 0.30 + voice * 0.26 + given("mouth_motion_proxy") * 0.22 + lock * 0.14 + dialogue * 0.08)


def switch_score(role: str = "target_role") -> Column:
    """How much a window's target is worth a switch to it, by its role."""
    strong = lambda times: F.least(F.lit(1.0), given("strength") * times)
    speaker, listener, subject, dialogue = (given(n) for n in ("speaker_confidence", "listener_confidence", "subject_confidence", "dialogue_likelihood"))
    role_ = F.coalesce(F.col(role), F.lit("speaker"))
    return (
        F.when(role_ == "speaker", speaker * 0.68 + subject * 0.16 + strong(6.0) * 0.16).when(role_ == "dialogue_center", dialogue * 0.62 + listener * 0.12 + strong(5.0) * 0.10 + subject * 0.16)
        .when(role_ == "listener", listener * 0.58 + dialogue * 0.18 + subject * 0.24).when(role_ == "subject_person", subject * 0.82 + strong(4.0) * 0.18)
        .when(role_ == "scene_interest", 0.18 + subject * 0.15).otherwise(subject * 0.35)
    )


def inner_height(framing: str = "framing", role: str = "target_role") -> Column:
    """Share of the frame's height that a framing shows."""
    kind, role_ = F.lower(F.coalesce(F.nullif(F.col(framing), F.lit("")), F.lit("face_locked"))), F.lower(F.coalesce(F.col(role), F.lit("")))
    shares = {"tight_crop": 0.96, "square_canvas": 0.72, "context_padded": 0.90, "wide_subject": 0.88, "shot_lock": 0.89, "scene_lock": 0.89}
    known = F.coalesce(*(F.when(kind == n, F.lit(x)) for n, x in shares.items()))
    return F.coalesce(known, F.when((kind == "dialogue_dual") | role_.isin("dialogue_center", "listener_hold"), 0.93).otherwise(0.78))


def crop_size(source_w: Column, source_h: Column, target_w: int, target_h: int) -> Column:
    """struct<w, h> of the largest crop of a source that has the target's shape; the side that is cut is even."""
    shape = target_w / target_h
    wide = source_w / F.greatest(F.lit(1), source_h) >= shape
    even = lambda x, most: F.greatest(F.lit(2), F.least(most, x - F.pmod(x, F.lit(2))))
    cut_w, cut_h = F.rint(source_h * shape).cast("int"), F.rint(source_w / shape).cast("int")
    return F.struct(F.when(wide, even(cut_w, source_w)).otherwise(source_w).alias("w"), F.when(wide, source_h).otherwise(even(cut_h, source_h)).alias("h"))


def safe_offset(center: Column, crop: Column, frame: Column, margin: Column) -> Column:
    """Where a crop begins along one side so that a face stays `margin` inside it, as far as the frame allows."""
    frame, crop, margin = F.greatest(F.lit(1), frame), F.greatest(F.lit(2), crop), F.greatest(F.lit(0), margin)
    low = F.greatest(F.lit(0), F.rint(center - crop + margin).cast("int"))
    high = F.least(frame - crop, F.rint(center - margin).cast("int"))
    middle = F.rint(center - crop / 2.0).cast("int")
    return F.when(low > high, limited(middle, F.lit(0), F.greatest(F.lit(0), frame - crop))).otherwise(limited(middle, low, high))


def smoothed(before: Column, now: Column, most: float = 0.05, blend: float = 0.32) -> Column:
    """struct<x, y>: a center moved towards another by `blend` of at most `most`; it stays where both differ little."""
    still = (F.abs(now["x"] - before["x"]) < 0.03) & (F.abs(now["y"] - before["y"]) < 0.03)
    step = lambda c: unit(before[c] + limited(now[c] - before[c], -most, most) * blend)
    moved = F.struct(step("x").alias("x"), step("y").alias("y"))
    return F.when(before.isNull(), now).when(still, before).otherwise(moved)


def interest_center(anchor: Column, last: Column, dialogue: Column) -> Column:
    """struct<x, y> to show when no subject is found: between the frame's middle, the clip's anchor and what was last seen."""
    safe_y = F.when(dialogue, 0.46).otherwise(0.5)
    unseen = F.struct((0.5 * 0.82 + anchor["x"] * 0.18).alias("x"), (safe_y * 0.76 + anchor["y"] * 0.24).alias("y"))
    seen = F.struct((last["x"] * 0.45 + anchor["x"] * 0.30 + 0.5 * 0.25).alias("x"), (last["y"] * 0.40 + anchor["y"] * 0.35 + safe_y * 0.25).alias("y"))
    return F.when(last.isNull(), unseen).otherwise(seen)


def strongest(faces: Column, keys: Sequence[str], most: int) -> Column:
    """The first `most` of an array of structs by some of their fields and area, all descending; ties in order."""
    placed = F.transform(faces, lambda f, i: F.struct(*(f[k].alias(k) for k in keys), (f["w"] * f["h"]).alias("area"), (-i).alias("nth"), f.alias("face")))
    return F.transform(F.slice(F.sort_array(placed, asc=False), 1, most), lambda f: f["face"])


def visible_faces(faces: Column, most: int = 3) -> Column:
    """The detected faces of a window, best by speaking, then listening, then area."""
    return strongest(F.filter(faces, lambda f: f["detected"]), ("speaking", "listening"), most)


def recent_faces(faces: Column, most_missed: int = 2) -> Column:
    """Faces that are detected or were lost at most `most_missed` frames ago, detected ones first, then as visible."""
    recent = F.filter(faces, lambda f: f["detected"] | (f["missed"] <= most_missed))
    placed = F.transform(recent, lambda f, i: F.struct(f["detected"].alias("d"), f["speaking"].alias("s"), f["listening"].alias("l"), (f["w"] * f["h"]).alias("a"), (-i).alias("nth"), f.alias("face")))
    return F.transform(F.sort_array(placed, asc=False), lambda f: f["face"])


def hold_candidate(faces: Column, previous: Column) -> Column:
    """The face to hold on to: the previous primary track's, else the best by listening, speaking and area."""
    old = F.get(F.filter(faces, lambda f: f["track"] == previous), F.lit(0))
    best = F.get(strongest(faces, ("listening", "speaking"), 1), F.lit(0))
    return F.coalesce(old, best)


def distinct_faces(faces: Column, dx: float = 0.08, dy: float = 0.10) -> Column:
    """Faces without those whose center is near that of an earlier kept one; the larger of the two stands in its place."""
    kind = F.slice(faces, 1, 0)

    def add(kept: Column, f: Column) -> Column:
        near = F.transform(kept, lambda k: (F.abs(f["x"] - k["x"]) < dx) & (F.abs(f["y"] - k["y"]) < dy))
        at = F.array_position(near, F.lit(True))
        larger = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (f["w"] * f["h"] > k["w"] * k["h"]), f).otherwise(k))
        return F.when(at > 0, larger).otherwise(F.concat(kept, F.array(f)))

    return F.aggregate(faces, kind, add)


def acquisition_state(face: Column, person: Column, faces_peak: Column, persons_peak: Column, memory_peak: Column) -> Column:
    """speaker_lock_ready, speaker_lock_uncertain or no_visible_subject, from shares of samples and peaks."""
    unseen = (faces_peak <= 0) & (persons_peak <= 0)
    traces = (face > 0) | (person > 0) | (memory_peak > 0)
    ready = (face >= 0.18) | (faces_peak >= 2) | (F.greatest(face, person * 0.88) >= 0.30)
    return F.when(unseen, F.when(traces, "speaker_lock_uncertain").otherwise("no_visible_subject")).when(ready, "speaker_lock_ready").otherwise("speaker_lock_uncertain")


def strict_pass_needed(strong: Column) -> Column:
    """Whether faces must be looked for again, strictly."""
    return F.coalesce(strong, F.lit(False)) | (given("subject_visibility_ratio") < 0.45) | (given("evidence_visible_faces_peak") <= 0) | (given("speaker_face_centered_windows") <= 0)


def remote_fallback(enabled: bool, mode: str | None, confidence: str = "subtitle_confidence", switches: str = "anchor_switches", risk: str = "empty_frame_risk") -> Column:
    """Whether a clip goes to the remote service: always by 'manual', when it is difficult by 'difficult_clips_only'. A
    confidence that is missing or 0 counts as 1."""
    mode = (mode or "off").lower()
    if not enabled or mode not in ("manual", "difficult_clips_only"):
        return F.lit(False)
    if mode == "manual":
        return F.lit(True)
    sure = F.coalesce(F.nullif(F.col(confidence).cast("double"), F.lit(0.0)), F.lit(1.0))
    return (sure < 0.33) | (given(switches) >= 12) | (given(risk) >= 0.65)


def presence_scores(face: Column, person: Column, subject: Column, face_size: Column, person_size: Column) -> Column:
    """struct<face_evidence_score, visual_subject_score, empty_frame_risk> of what samples of a clip show: shares of samples
    with a face, a person and a subject, and mean sizes; missing numbers count as 0."""
    face, person, subject, face_size, person_size = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (face, person, subject, face_size, person_size))
    evidence = F.least(F.lit(1.0), face * 0.62 + person * 0.22 + subject * 0.16)
    visual = F.least(F.lit(1.0), face * 0.56 + person * 0.28 + F.least(F.lit(1.0), face_size / 0.035) * 0.10 + F.least(F.lit(1.0), person_size / 0.09) * 0.06)
    risk = F.greatest(F.lit(0.0), 1.0 - (subject * 0.9 + visual * 0.45))
    return F.struct(F.round(evidence, 4).alias("face_evidence_score"), F.round(visual, 4).alias("visual_subject_score"), F.round(risk, 4).alias("empty_frame_risk"))


def fallback_scores(face: Column, person: Column, subject: Column, density: Column, clarity: Column, energy: Column, given_visual: Column | None = None, given_reframe: Column | None = None, given_risk: Column | None = None) -> Column:
    """struct<face_evidence_score, visual_subject_score, reframe_feasibility_score, empty_frame_risk> of a clip that wasn't
    looked at in time: guessed from speech where they aren't given, and held down where there is next to no evidence of a
    face (0.06). Missing numbers count as 0."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    known = lambda c, guess: guess if c is None else F.coalesce(c.cast("double"), guess)
    face, person, subject, density, clarity, energy = map(number, (face, person, subject, density, clarity, energy))
    evidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), face * 0.62 + person * 0.22 + subject * 0.16))
    unseen = evidence <= 0.06
    visual = known(given_visual, F.greatest(F.lit(0.18), evidence * 0.85 + F.when(density >= 0.24, 0.18).otherwise(0.08)))
    reframe = known(given_reframe, F.least(F.lit(1.0), visual * 0.72 + clarity * 0.18 + energy * 0.10))
    risk = known(given_risk, F.greatest(F.lit(0.0), 1.0 - (visual * 0.75 + reframe * 0.35)))
    visual = F.when(unseen, F.least(visual, F.when(density < 0.40, 0.18).otherwise(0.22))).otherwise(visual)
    reframe, risk = F.when(unseen, F.least(reframe, F.lit(0.24))).otherwise(reframe), F.when(unseen, F.greatest(risk, F.lit(0.84))).otherwise(risk)
    named = {"face_evidence_score": evidence, "visual_subject_score": visual, "reframe_feasibility_score": reframe, "empty_frame_risk": risk}
    return F.struct(*(F.round(v, 4).alias(k) for k, v in named.items()))
