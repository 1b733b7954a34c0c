"""What clips show, in which order they are taken, what they tell."""

import pytest
from pyspark.sql import functions as F

from dialoom.functions import text, visual
from dialoom.operators import framing, ranking, story, turns


def scored(spark, column):
    return spark.range(1).select(column.alias("s")).first().s


def test_precheck_finds_faces(spark):
    s = scored(spark, visual.presence_scores(*map(F.lit, (0.80, 0.20, 0.80, 0.04, 0.08))))
    assert s.face_evidence_score >= 0.65 and s.visual_subject_score >= 0.60 and s.empty_frame_risk < 0.20
    assert tuple(scored(spark, visual.presence_scores(*[F.lit(None)] * 5))) == (0.0, 0.0, 1.0)


def test_fallback_holds_unseen_clips_down(spark):
    none = [F.lit(None)] * 3
    unseen = scored(spark, visual.fallback_scores(*none, F.lit(0.38), F.lit(0.3), F.lit(0.31)))
    seen = scored(spark, visual.fallback_scores(F.lit(0.22), F.lit(0.12), F.lit(0.18), F.lit(0.38), F.lit(0.3), F.lit(0.31)))
    assert tuple(unseen) == (0.0, 0.18, pytest.approx(0.2146, abs=1e-4), 0.84) and seen.face_evidence_score > unseen.face_evidence_score and seen.empty_frame_risk < unseen.empty_frame_risk
    assert scored(spark, visual.fallback_scores(*none, F.lit(0.40), F.lit(1.0), F.lit(1.0), F.lit(0.9), F.lit(0.9))) == (0.0, 0.22, 0.24, 0.84)


def test_probe_detects_drift(spark):
    clips = spark.createDataFrame([(1, 0, 100), (2, 0, 100), (3, 50, 50), (4, 9, 1)], "clip long, start long, end long")
    samples = spark.createDataFrame([(1, 20, 0.72, 0.72), (1, 50, 0.0, 0.0), (1, 80, 0.68, 0.68), (3, 0, 0.5, 0.6), (3, 100, 0.9, 0.9), (9, 1, 1.0, 1.0)], "clip long, t long, face double, subject double")
    found = {r.clip: tuple(r)[1:] for r in framing.crop_probe(clips, samples).collect()}
    assert found == {1: (3, 0.0, 0.4667, 0.0, True), 2: (3, 0.0, 0.0, 0.0, False), 3: (1, 0.5, 0.5, 0.6, False)}


def test_told_parts(spark):
    rows = [(1, i, t) for i, t in enumerate(["Look, already here", "Now explain", "All goes wrong", "", "This is how it ended"])] + [(2, 0, "Only one"), (3, 0, "a"), (3, 1, None), (3, 2, "c"), (3, 3, "d")]
    found = {r.source_id: tuple(r)[1:] for r in story.told_parts(spark.createDataFrame(rows, "source_id long, turn_id long, text string")).collect()}
    assert found[1] == ("Look, already here", "Now explain", "All goes wrong", "This is how it ended", False)
    assert found[2][-1] and found[2][:4] == ("Only one", None, None, None) and found[3] == ("a", "", "c", "d", True)


def test_rerank_moves_only_the_top(spark):
    rows = [(1, i, s, p) for i, s, p in ((1, 9.0, 1.0), (2, 8.0, 9.5), (3, 7.0, None), (4, 6.0, 99.0), (5, None, 3.0))]
    ranked = ranking.reranked(spark.createDataFrame(rows, "g long, id long, score double, preview double"), ["g"], "score", "preview", "id", 3)
    assert [r.id for r in ranked.orderBy("rank").collect()] == [2, 3, 1, 4, 5]


def test_reject_paths_read_reports_and_warnings(spark):
    rejected = spark.createDataFrame([(1, "insufficient_context"), (2, "insufficient_context"), (3, "subtitle_timeout"), (3, None)], "source_id long, reason string")
    warnings = spark.createDataFrame([(1, "Candidate 1 rejected: low_story_quality"), (1, "Candidate 2 downgraded: low_story_quality"), (2, "Candidate 3 rejected: starts_mid_phrase"), (2, "slow disk"), (2, None)], "source_id long, text string")
    found = {r.reason: (r.n, r.sources) for r in ranking.reject_paths(rejected, warnings).collect()}
    assert found == {"insufficient_context": (2, 2), "subtitle_timeout": (1, 1), "low_story_quality": (2, 1), "starts_mid_phrase": (1, 1)}
    assert scored(spark, ranking.quality_governor()) == "accept"


def test_three_detectors_differ(spark):
    texts = [None, "", "plain words", "Гђ Гђ two", "привет страна", "это привет страна", "Гђ привет страна моя", "wait — è", "РРРР ССС", "привет"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.misread_title(F.col("t")).alias("a"), text.misread_report(F.col("t")).alias("b"), text.looks_misread(F.col("t")).alias("c")).orderBy("i").collect()
    assert [i for i, r in enumerate(rows) if r.a] == [3, 6, 7, 8] and [i for i, r in enumerate(rows) if r.b] == [3, 4, 6, 8]
    assert rows[4].c and rows[6].c and not rows[5].c and not rows[7].c


def test_speakers_that_are_missing_are_not_merged(spark):
    seg = [(1, 0, 0, 900, "a", "x"), (1, 1, 1_000, 2_000, "b", "x"), (1, 2, 2_299, 3_000, "c", "x"), (1, 3, 3_300, 4_000, "d", "x"), (1, 4, 4_000, 5_000, "e", None), (1, 5, 5_000, 6_000, "f", ""), (1, 6, 9_000, 9_900, "g", "y"), (1, 7, 6_100, None, None, "y"), (1, 8, 6_700, 6_700, "h", "y")]
    found = turns.speaker_timeline(spark.createDataFrame(seg, "source_id long, seg_idx long, start_ms long, end_ms long, text string, speaker string"), 1_500, 8_000)
    assert sorted(tuple(r)[2:] for r in found.collect()) == [(1_500, 3_000, "x", "b c"), (3_300, 4_000, "x", "d"), (4_000, 5_000, "unknown_turn_4", "e"), (5_000, 6_000, "unknown_turn_5", "f"), (6_100, 6_600, "y", "")]
