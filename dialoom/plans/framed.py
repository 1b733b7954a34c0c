"""Queries over made-up detections and windows, and over corpora of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import visual
from ..operators import corpus, framing
from ..sources.adapters import records, segments, table
from .records import RECORDS, TAGGED, summarized
from .registry import SEGMENTS, listed, query


def part(k: int, n: int) -> Column:
    """A made-up number in 0..1, by integer arithmetic on event_id."""
    return F.pmod(F.col("event_id") * k, F.lit(n)) / F.lit(float(n))


def sql_part(k: int, n: int) -> str:
    return f"((event_id * {k} % {n}) / {float(n)!r}::DOUBLE)"


FACE = {"w": (3, 20), "h": (7, 25), "last_speaking": (11, 50), "last_listening": (13, 50), "motion": (17, 100), "scene_change": (19, 60)}
WHOLE = {"seen": 9, "missed": 4, "face_count": 3}
FACES_SQL = f"ev AS (SELECT event_id, {', '.join(f'{sql_part(*v)} AS {n}' for n, v in FACE.items())}, {', '.join(f'event_id % {v} AS {n}' for n, v in WHOLE.items())}, event_id % 5 = 0 AS held FROM events)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *(part(*v).alias(n) for n, v in FACE.items()), *(F.pmod("event_id", F.lit(v)).alias(n) for n, v in WHOLE.items()), (F.pmod("event_id", F.lit(5)) == 0).alias("held"))


@query(
    f"""WITH {FACES_SQL}, a AS (SELECT *, greatest(0.0, least(1.0, 0.35::DOUBLE + least(0.55::DOUBLE, seen * 0.09::DOUBLE) - missed * 0.12::DOUBLE + least(0.10::DOUBLE, w * h * 1.5::DOUBLE))) AS v, greatest(0.0, least(1.0, least(1.0, seen / 6.0::DOUBLE) - missed * 0.08::DOUBLE)) AS st,
      greatest(0.0, least(1.0, sqrt(greatest(0.0, w * h)) / 0.24::DOUBLE)) AS sz, 0.42::DOUBLE + least(0.38::DOUBLE, motion * 0.62::DOUBLE) AS tu, CASE WHEN face_count >= 2 THEN 0.18::DOUBLE ELSE 0.0 END AS dc, CASE WHEN held THEN 0.12::DOUBLE ELSE 0.0 END AS bo,
      greatest(0.0, least(1.0, 1.0 - least(1.0, scene_change / 0.35::DOUBLE))) AS sc FROM ev),
    b AS (SELECT *, v * 0.20::DOUBLE + st * 0.14::DOUBLE + sz * 0.10::DOUBLE + motion * 0.34::DOUBLE + tu * 0.10::DOUBLE + dc * 0.05::DOUBLE + bo * 0.55::DOUBLE + last_speaking * 0.07::DOUBLE AS sp,
      v * 0.28::DOUBLE + st * 0.22::DOUBLE + sz * 0.12::DOUBLE + CASE WHEN face_count >= 2 THEN 0.18::DOUBLE ELSE 0.04::DOUBLE END + last_listening * 0.12::DOUBLE + bo * 0.35::DOUBLE + CASE WHEN motion <= 0.04::DOUBLE AND face_count >= 2 THEN 0.08::DOUBLE ELSE 0.0 END AS li FROM a)
    SELECT event_id, round(v, 4) AS face_visibility_score, round(st, 4) AS track_stability_score, round(tu, 4) AS subtitle_turn_alignment_score, round(dc, 4) AS dialogue_context_score, round(bo, 4) AS previous_anchor_continuity_bonus, round(sc, 4) AS scene_change_consistency,
      round(greatest(0.0, least(1.0, sp)), 4) AS speaking_score, round(greatest(0.0, least(1.0, li)), 4) AS listener_score,
      round(greatest(0.0, least(1.0, greatest(0.0, least(1.0, sp)) * 0.32::DOUBLE + st * 0.20::DOUBLE + v * 0.18::DOUBLE + bo * 0.08::DOUBLE + dc * 0.10::DOUBLE + sc * 0.06::DOUBLE)), 4) AS lock_confidence FROM b"""
)
def face_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event_id", visual.evidence().alias("e")).select("event_id", "e.*")


ROLES = ("speaker", "dialogue_center", "listener", "subject_person", "scene_interest", "other")
FRAMINGS = ("tight_crop", "square_canvas", "dialogue_dual", "", "scene_lock")
TARGET = {"speaker_confidence": (3, 50), "listener_confidence": (7, 50), "subject_confidence": (11, 50), "dialogue_likelihood": (13, 50), "strength": (17, 400), "subtitle_turn_alignment_score": (19, 50), "speaker_turn_strength": (23, 50), "lock_confidence": (29, 50), "mouth_motion_proxy": (31, 50)}
TARGETS_SQL = f"tg AS (SELECT event_id, {', '.join(f'{sql_part(*v)} AS {n}' for n, v in TARGET.items())}, {listed(ROLES)}[event_id % {len(ROLES)} + 1] AS target_role, {listed(FRAMINGS)}[event_id % {len(FRAMINGS)} + 1] AS framing FROM events)"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod("event_id", F.lit(len(names))) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", *(part(*v).alias(n) for n, v in TARGET.items()), pick(ROLES).alias("target_role"), pick(FRAMINGS).alias("framing"))


@query(
    f"""WITH {TARGETS_SQL} SELECT event_id, round(least(1.0, subtitle_turn_alignment_score * 0.30::DOUBLE + greatest(speaker_confidence, speaker_turn_strength) * 0.26::DOUBLE + mouth_motion_proxy * 0.22::DOUBLE + greatest(lock_confidence, subject_confidence) * 0.14::DOUBLE
      + greatest(dialogue_likelihood, listener_confidence * 0.42::DOUBLE) * 0.08::DOUBLE), 6) AS confidence,
    round(CASE target_role WHEN 'speaker' THEN speaker_confidence * 0.68::DOUBLE + subject_confidence * 0.16::DOUBLE + least(1.0, strength * 6) * 0.16::DOUBLE
      WHEN 'dialogue_center' THEN dialogue_likelihood * 0.62::DOUBLE + listener_confidence * 0.12::DOUBLE + least(1.0, strength * 5) * 0.10::DOUBLE + subject_confidence * 0.16::DOUBLE
      WHEN 'listener' THEN listener_confidence * 0.58::DOUBLE + dialogue_likelihood * 0.18::DOUBLE + subject_confidence * 0.24::DOUBLE WHEN 'subject_person' THEN subject_confidence * 0.82::DOUBLE + least(1.0, strength * 4) * 0.18::DOUBLE
      WHEN 'scene_interest' THEN 0.18::DOUBLE + subject_confidence * 0.15::DOUBLE ELSE subject_confidence * 0.35::DOUBLE END, 6) AS switch_score,
    CASE WHEN framing = 'tight_crop' THEN 0.96 WHEN framing = 'square_canvas' THEN 0.72 WHEN framing = 'scene_lock' THEN 0.89 WHEN framing = 'dialogue_dual' OR target_role = 'dialogue_center' THEN 0.93 ELSE 0.78 END::DOUBLE AS inner_height FROM tg"""
)
def target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).select("event_id", F.round(visual.speaker_confidence(), 6).alias("confidence"), F.round(visual.switch_score(), 6).alias("switch_score"), visual.inner_height().alias("inner_height"))


@query(
    """WITH s AS (SELECT event_id, 640 + event_id % 1281 AS w, 360 + event_id * 7 % 721 AS h, (event_id * 11 % 100) / 100.0::DOUBLE * 1000 AS c, event_id % 90 AS m FROM events),
    k AS (SELECT *, w / h::DOUBLE >= 1080 / 1920::DOUBLE AS wide, round_even(h * (1080 / 1920::DOUBLE), 0)::BIGINT AS cw, round_even(w / (1080 / 1920::DOUBLE), 0)::BIGINT AS ch FROM s),
    g AS (SELECT *, CASE WHEN wide THEN greatest(2, least(w, cw - cw % 2)) ELSE w END AS crop_w, CASE WHEN wide THEN h ELSE greatest(2, least(h, ch - ch % 2)) END AS crop_h FROM k),
    o AS (SELECT *, greatest(0, round_even(c - crop_w + m, 0)::BIGINT) AS lo, least(w - crop_w, round_even(c - m, 0)::BIGINT) AS hi, round_even(c - crop_w / 2.0::DOUBLE, 0)::BIGINT AS mid FROM g)
    SELECT event_id, crop_w, crop_h, CASE WHEN lo > hi THEN greatest(0, least(greatest(0, w - crop_w), mid)) ELSE greatest(lo, least(hi, mid)) END AS offset_x FROM o"""
)
def crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = table(spark, sf_dir, "events").select("event_id", (640 + F.pmod(e, F.lit(1281))).cast("int").alias("w"), (360 + F.pmod(e * 7, F.lit(721))).cast("int").alias("h"), (F.pmod(e * 11, F.lit(100)) / 100.0 * 1000).alias("c"), F.pmod(e, F.lit(90)).cast("int").alias("m"))
    s = s.withColumn("crop", visual.crop_size(F.col("w"), F.col("h"), 1080, 1920))
    return s.select("event_id", F.col("crop.w").alias("crop_w"), F.col("crop.h").alias("crop_h"), visual.safe_offset(F.col("c"), F.col("crop.w"), F.col("w"), F.col("m")).alias("offset_x"))


@query(
    f"""WITH s AS (SELECT event_id, {sql_part(7, 50)} AS px, {sql_part(11, 50)} AS py, {sql_part(13, 50)} AS x, {sql_part(17, 50)} AS y FROM events)
    SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN x WHEN abs(x - px) < 0.03::DOUBLE AND abs(y - py) < 0.03::DOUBLE THEN px ELSE greatest(0.0, least(1.0, px + greatest(-0.05::DOUBLE, least(0.05::DOUBLE, x - px)) * 0.32::DOUBLE)) END, 6) AS x,
      round(CASE WHEN event_id % 10 = 0 THEN y WHEN abs(x - px) < 0.03::DOUBLE AND abs(y - py) < 0.03::DOUBLE THEN py ELSE greatest(0.0, least(1.0, py + greatest(-0.05::DOUBLE, least(0.05::DOUBLE, y - py)) * 0.32::DOUBLE)) END, 6) AS y,
      round(CASE WHEN event_id % 10 = 0 THEN 0.41::DOUBLE + x * 0.18::DOUBLE ELSE px * 0.45::DOUBLE + x * 0.30::DOUBLE + 0.125::DOUBLE END, 6) AS interest_x FROM s"""
)
def smoothed_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda a, b: F.struct(part(a, 50).alias("x"), part(b, 50).alias("y"))
    before = F.when(F.pmod("event_id", F.lit(10)) != 0, point(7, 11))
    s = table(spark, sf_dir, "events").select("event_id", before.alias("b"), point(13, 17).alias("n"))
    s = s.select("event_id", visual.smoothed(F.col("b"), F.col("n")).alias("c"), visual.interest_center(F.col("n"), F.col("b"), F.lit(False)).alias("i"))
    return s.select("event_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.round("i.x", 6).alias("interest_x"))


@query(
    """WITH s AS (SELECT event_id // 200 AS clip, event_id % 7 = 0 AS detected, CASE WHEN event_id // 200 % 3 = 0 THEN 0 ELSE event_id % 4 END AS faces, CASE WHEN event_id // 200 % 3 = 0 THEN 0 ELSE event_id % 2 END AS persons, event_id // 200 % 2 AS memory FROM events),
    g AS (SELECT clip, avg((detected AND clip % 3 <> 0)::INT) AS f, avg((persons > 0)::INT) AS p, max(faces) AS visible_faces_peak, max(persons) AS visible_persons_peak, max(memory) AS recent_face_memory_peak FROM s GROUP BY clip)
    SELECT clip, CASE WHEN visible_faces_peak <= 0 AND visible_persons_peak <= 0 THEN CASE WHEN f > 0 OR p > 0 OR recent_face_memory_peak > 0 THEN 'speaker_lock_uncertain' ELSE 'no_visible_subject' END
      WHEN f >= 0.18 OR visible_faces_peak >= 2 OR greatest(f, p * 0.88) >= 0.30 THEN 'speaker_lock_ready' ELSE 'speaker_lock_uncertain' END AS state, round(f, 4) AS face_presence, round(p, 4) AS person_presence, round(greatest(f, p * 0.88), 4) AS subject_presence,
      visible_faces_peak, visible_persons_peak, recent_face_memory_peak FROM g"""
)
def subject_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, clip = F.col("event_id"), F.floor(F.col("event_id") / 200)
    shown = lambda n: F.when(F.pmod(clip, F.lit(3)) == 0, 0).otherwise(F.pmod(e, F.lit(n)))
    s = table(spark, sf_dir, "events").select(clip.alias("clip"), ((F.pmod(e, F.lit(7)) == 0) & (F.pmod(clip, F.lit(3)) != 0)).alias("detected"), shown(4).alias("faces"), shown(2).alias("persons"), F.pmod(clip, F.lit(2)).alias("memory"))
    return framing.acquisition(s, "clip")


BEST_FACE = "speaking * 1.15::DOUBLE + listening * 0.35::DOUBLE + w * h * 0.55::DOUBLE"
SAMPLED = f"""fs AS (SELECT event_id // 200 AS clip, event_id % 200 AS t, event_id % 3 AS face, {sql_part(7, 50)} AS x, {sql_part(11, 50)} AS y, {sql_part(3, 20)} AS w, {sql_part(5, 20)} AS h, {sql_part(13, 100)} AS speaking, {sql_part(17, 100)} AS listening,
  event_id % 4 = 0 AND event_id // 200 % 10 <> 0 AS detected, event_id * 31 % 6 AS missed, event_id % 5 AS track FROM events)"""


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, clip = F.col("event_id"), F.floor(F.col("event_id") / 200)
    return table(spark, sf_dir, "events").select(
        clip.alias("clip"), F.pmod(e, F.lit(200)).alias("t"), F.pmod(e, F.lit(3)).alias("face"), part(7, 50).alias("x"), part(11, 50).alias("y"), part(3, 20).alias("w"), part(5, 20).alias("h"), part(13, 100).alias("speaking"), part(17, 100).alias("listening"),
        ((F.pmod(e, F.lit(4)) == 0) & (F.pmod(clip, F.lit(10)) != 0)).alias("detected"), F.pmod(e * 31, F.lit(6)).alias("missed"), F.pmod(e, F.lit(5)).alias("track"),
    )


@query(
    f"""WITH {SAMPLED}, tn AS (SELECT clip, u AS turn, u * 30 AS s, u * 30 + CASE WHEN u = 2 THEN 2 ELSE 25 END AS e FROM (SELECT DISTINCT clip FROM fs), (SELECT unnest(range(0, 6)) AS u)),
    o AS (SELECT tn.clip, turn, row_number() OVER (PARTITION BY tn.clip, turn ORDER BY {BEST_FACE} DESC, t, face) AS k, x, y FROM tn JOIN fs ON tn.clip = fs.clip AND detected AND t >= s AND t < e),
    a AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY {BEST_FACE} DESC, t, face) AS k, x, y FROM fs WHERE detected)
    SELECT tn.clip, tn.turn, s AS start, e AS end, coalesce(o.x, a.x, 0.5) AS x, coalesce(o.y, a.y, 0.5) AS y FROM tn LEFT JOIN o ON o.clip = tn.clip AND o.turn = tn.turn AND o.k = 1 LEFT JOIN a ON a.clip = tn.clip AND a.k = 1"""
)
def turn_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = sampled(spark, sf_dir)
    turns = faces.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("turn"))
    turns = turns.select("clip", "turn", (F.col("turn") * 30).alias("start"), (F.col("turn") * 30 + F.when(F.col("turn") == 2, 2).otherwise(25)).alias("end"))
    return framing.best_faces(faces, turns, 30)


SHOWN = "f.face || ':' || f.t"


@query(
    f"""WITH {SAMPLED}, wn AS (SELECT clip, t // 20 AS win, list({{'face': face, 't': t, 'x': x, 'y': y, 'w': w, 'h': h, 'speaking': speaking, 'listening': listening, 'detected': detected, 'missed': missed, 'track': track}} ORDER BY t, face) AS fl FROM fs GROUP BY ALL),
    u AS (SELECT clip, win, unnest(fl) AS f, generate_subscripts(fl, 1) AS i FROM wn),
    v AS (SELECT clip, win, string_agg({SHOWN}, ',' ORDER BY f.speaking DESC, f.listening DESC, f.w * f.h DESC, i) AS s FROM (SELECT * FROM u WHERE f.detected QUALIFY row_number() OVER (PARTITION BY clip, win ORDER BY f.speaking DESC, f.listening DESC, f.w * f.h DESC, i) <= 3) GROUP BY ALL),
    r AS (SELECT clip, win, string_agg({SHOWN}, ',' ORDER BY f.detected DESC, f.speaking DESC, f.listening DESC, f.w * f.h DESC, i) AS s FROM u WHERE f.detected OR f.missed <= 2 GROUP BY ALL)
    SELECT wn.clip, wn.win, coalesce(v.s, '') AS visible, coalesce(r.s, '') AS recent FROM wn LEFT JOIN v USING (clip, win) LEFT JOIN r USING (clip, win)"""
)
def window_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = F.struct("face", "t", "x", "y", "w", "h", "speaking", "listening", "detected", "missed", "track")
    windows = sampled(spark, sf_dir).groupBy("clip", F.floor(F.col("t") / 20).alias("win")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "face", face.alias("f")))), lambda x: x["f"]).alias("f"))
    shown = lambda faces: F.array_join(F.transform(faces, lambda f: F.concat_ws(":", f["face"], f["t"])), ",")
    return windows.select("clip", "win", shown(visual.visible_faces(F.col("f"))).alias("visible"), shown(visual.recent_faces(F.col("f"))).alias("recent"))


PLAN = f"""{SEGMENTS}, nm AS (SELECT source_id, seg_idx, start_ms, end_ms, CASE WHEN seg_idx % 5 = 4 THEN 'NEUTRAL' ELSE speaker END AS speaker FROM seg WHERE end_ms > start_ms),
  fl AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY source_id ORDER BY seg_idx) THEN 0 ELSE 1 END AS new FROM nm), nb AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY seg_idx)::BIGINT AS cut FROM fl),
  cu AS (SELECT source_id, cut, arg_min(start_ms, seg_idx) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms, any_value(speaker) AS speaker FROM nb GROUP BY ALL),
  zs AS (SELECT source_id, speaker, row_number() OVER (PARTITION BY source_id ORDER BY speaker) - 1 AS nth, least(3, count(*) OVER (PARTITION BY source_id)) AS n FROM (SELECT DISTINCT source_id, speaker FROM nm WHERE speaker <> 'NEUTRAL'))"""


@query(
    f"""WITH {PLAN} SELECT cu.source_id, cut, start_ms, end_ms, cu.speaker, CASE WHEN n IS NULL OR n = 1 OR nth >= 3 THEN 160 ELSE nth * (640 // n) END AS x, 0::BIGINT AS y, CASE WHEN n IS NULL OR n = 1 OR nth >= 3 THEN 320 ELSE least(greatest(640 // n, 213), 640 - nth * (640 // n)) END AS w, 480::BIGINT AS h
    FROM cu LEFT JOIN zs ON cu.source_id = zs.source_id AND cu.speaker = zs.speaker WHERE end_ms > start_ms"""
)
def speaker_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts by speaker; every fifth segment's speaker is a generic one."""
    named = F.when(F.pmod("seg_idx", F.lit(5)) == 4, "Speaker_7").otherwise(F.col("speaker"))
    return framing.speaker_plan(segments(spark, sf_dir).withColumn("speaker", named), 640, 480)


@query(
    f"""WITH {RECORDS} SELECT doc_id, (subtitle_quality_score < 0.33 AND subtitle_quality_score <> 0) OR speaker_switches * 12 >= 12 OR face_edge_clip_rate >= 0.65 AS remote,
    subject_visibility_ratio < 0.45 OR speaker_switches <= 0 OR reframe_fallback_count <= 0 AS strict, round(greatest(0.0, least(1.0, 1.0 - hook_score)), 4) AS confidence FROM rec"""
)
def fallback_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumns({"evidence_visible_faces_peak": F.col("speaker_switches"), "speaker_face_centered_windows": F.col("reframe_fallback_count"), "switches": F.col("speaker_switches") * 12})
    remote = visual.remote_fallback(True, "difficult_clips_only", "subtitle_quality_score", "switches", "face_edge_clip_rate")
    return r.select("doc_id", remote.alias("remote"), visual.strict_pass_needed(F.lit(False)).alias("strict"), F.round(visual.log_confidence(F.col("hook_score") * -2), 4).alias("confidence"))


PATHS = r"""CASE doc_id % 3 WHEN 0 THEN '/video/' || lang || '/' || source || '.s01.mkv' WHEN 1 THEN source || '.mp4' ELSE NULL END"""


@query(
    f"""WITH {TAGGED}, p AS (SELECT *, {PATHS} AS path, CASE WHEN doc_id % 4 = 0 THEN 'Series' END AS r_series, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'Own name' END AS own_episode FROM tag)
    SELECT doc_id, path AS source_file, coalesce(r_series, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source END, '') AS series_name, coalesce(nullif(own_episode, ''), CASE doc_id % 3 WHEN 0 THEN source || '.s01' WHEN 1 THEN source END, '') AS episode_name, 'now' AS created_at,
      '1.' || doc_id % 3 AS pipeline_version, final_duration::DOUBLE AS duration, clarity_score, CASE WHEN doc_id % 6 = 0 THEN 'stitched' END AS merge_reason, array_to_string(failure_reason, ',') AS failure_reason FROM p"""
)
def benchmark_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests whose fields come from the row, from its report and from its path."""
    third, name = F.pmod("doc_id", F.lit(3)), F.concat("source", F.lit(".mp4"))
    path = F.when(third == 0, F.concat(F.lit("/video/"), "lang", F.lit("/"), "source", F.lit(".s01.mkv"))).when(third == 1, name)
    report = F.struct(F.when(F.pmod("doc_id", F.lit(4)) == 0, "Series").alias("series_name"), F.concat(F.lit("1."), third.cast("string")).alias("pipeline_version"))
    own = F.when(F.pmod("doc_id", F.lit(5)) == 0, "").when(F.pmod("doc_id", F.lit(5)) == 1, "Own name")
    made = summarized(spark, sf_dir).withColumns({"source_file": path, "report": report, "episode_name": own, "stitch_reason": F.when(F.pmod("doc_id", F.lit(6)) == 0, "stitched")})
    fields = ("source_file", "series_name", "episode_name", "created_at", "pipeline_version", "duration", "clarity_score", "merge_reason")
    return corpus.manifests(made, now=F.lit("now")).select("doc_id", *fields, F.array_join("failure_reason", ",").alias("failure_reason"))


@query(
    f"""WITH {RECORDS}, c AS (SELECT doc_id FROM rec WHERE doc_id % 2 = 0), g AS (SELECT doc_id FROM rec WHERE doc_id % 5 = 0)
    SELECT (SELECT count(*) FROM c) + (SELECT count(*) FROM g) AS count, (SELECT count(*) FROM c) AS candidate_count, (SELECT count(*) FROM g) AS golden_count, (SELECT count(*) FROM c JOIN g USING (doc_id)) AS shared,
      CASE WHEN (SELECT count(*) FROM c) + (SELECT count(*) FROM g) < 100 THEN 'weak' WHEN (SELECT count(*) FROM c) + (SELECT count(*) FROM g) < 250 THEN 'minimum' WHEN (SELECT count(*) FROM c) + (SELECT count(*) FROM g) < 500 THEN 'recommended' ELSE 'strong' END AS status"""
)
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = records(spark, sf_dir).withColumn("candidate_id", F.col("doc_id").cast("string"))
    return corpus.audit(ids.where("doc_id % 2 = 0"), ids.where("doc_id % 5 = 0"))


@query(
    f"""WITH {RECORDS}, n AS (SELECT count(*) AS reviewed FROM rec WHERE doc_id % 2 = 0), s AS (SELECT *, CASE WHEN reviewed < 100 THEN 'weak' WHEN reviewed < 250 THEN 'minimum' WHEN reviewed < 500 THEN 'recommended' ELSE 'strong' END AS status FROM n)
    SELECT reviewed, status, CASE status WHEN 'weak' THEN 'insufficient_data_for_confident_iteration' WHEN 'minimum' THEN 'usable_but_still_small' WHEN 'recommended' THEN 'good_enough_for_targeted_changes' END AS warning, CASE WHEN status = 'weak' THEN 2 ELSE 0 END::BIGINT AS exit_code FROM s"""
)
def corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.gate(records(spark, sf_dir).where("doc_id % 2 = 0"))


@query(f"WITH {RECORDS} SELECT candidate_id, recommendation_readiness_score FROM (SELECT doc_id::VARCHAR AS candidate_id, recommendation_readiness_score, CASE WHEN doc_id % 2 = 0 THEN human_labels ELSE [] END AS l FROM rec) WHERE len(l) = 0 ORDER BY abs(recommendation_readiness_score - 0.64::DOUBLE), candidate_id LIMIT 20")
def corpus_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumns({"candidate_id": F.col("doc_id").cast("string"), "human_labels": F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("human_labels"))})
    return corpus.review_queue(r, 20).select("candidate_id", "recommendation_readiness_score")


@query(
    f"""WITH {RECORDS} SELECT doc_id::VARCHAR AS candidate_id, '' AS conversation_id, coalesce(story_thread_id, '') AS story_thread_id, coalesce(arc, '') AS story_arc_shape, coalesce(story_completion_score, 0.0) AS story_completion_score, coalesce(context_completeness_score, 0.0) AS context_completeness_score,
    hook_score, coalesce(story_coherence_score, 0.0) AS story_coherence_score, speaker_confidence_score, visual_conversation_score, payoff_strength AS payoff_score, needs_review, greatest(speaker_switches, reframe_fallback_count) AS listener_reaction_count, round(CASE WHEN trims = 0 THEN final_duration ELSE trims * 1.5 END, 3) AS window_duration FROM rec"""
)
def debug_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    shown = corpus.debug_snapshot(r.withColumn("candidate_id", F.col("doc_id").cast("string")))
    plan = corpus.timeline_plan(corpus.reframe_summary(r.withColumns({"listener_fallback_windows": F.col("speaker_switches"), "speaker_to_listener_switches": F.col("reframe_fallback_count"), "plan_duration": F.size("silence_trim_events") * 1.5, "duration": F.col("final_duration").cast("double")})))
    return shown.join(plan.select(F.col("doc_id").cast("string").alias("candidate_id"), "listener_reaction_count", "window_duration"), "candidate_id")


@query(f"WITH o AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/none' ELSE url END AS metadata FROM pages), m AS (SELECT url AS path, min(page_id) AS title_id FROM pages GROUP BY url) SELECT page_id, metadata, coalesce(title_id, -1) AS title_id FROM o LEFT JOIN m ON metadata = path")
def output_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outputs = pages.select("page_id", F.when(F.pmod("page_id", F.lit(3)) == 0, "/none").otherwise(F.col("url")).alias("metadata"))
    return corpus.joined_metadata(outputs, pages.groupBy(F.col("url").alias("path")).agg(F.min("page_id").alias("title_id"))).fillna(-1, ["title_id"])
