"""Reports, summaries, corpora, titles and visual functions on small tables."""

import pytest
from pyspark.sql import functions as F

from dialoom.functions import visual
from dialoom.operators import corpus, framing, ranking, reporting, story, summary, titles
from dialoom.plans import catalog

NAMES = (
    "hook_strength hook_score first_second_hook_score sound_off_hook_score premise_signal_score retention_soft_score viral_soft_score speaker_centered_rate subject_visibility_ratio cold_open_dead_time_penalty visible_stakes_score visual_subject_score "
    "subtitle_quality_score dialogue_dependency_penalty story_completeness_score payoff_strength packaging_quality_score title_quality_score speaker_center_offset_avg speaker_center_offset_p95 final_duration story_interest_score story_context_score "
    "story_coherence_score story_completion_score visual_conversation_score speaker_confidence_score pacing_score trimmed_silence_seconds face_edge_clip_rate"
).split()
FLAGS = "reframe_scene_interest_fallback_used subject_person_fallback_used face_preserving_fallback_used rejected_for_missing_payoff rejected_for_topic_jump rejected_for_confusing_story".split()


def metadata(spark, **fields):
    schema = ", ".join([f"{n} double" for n in NAMES] + [f"{n} boolean" for n in FLAGS] + ["quality_governor_decision string", "payoff_type string", "topic_shift_events double", "subtitle_overlap_outputs int", "subtitle_blink_outputs int"])
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(fields.get(n) for n in names)], schema)


def reasons(spark, **fields):
    return metadata(spark, **fields).select(ranking.failure_reasons().alias("r")).first()["r"]


GOOD = {n: 0.9 for n in NAMES} | {n: 0.0 for n in ("cold_open_dead_time_penalty", "dialogue_dependency_penalty", "speaker_center_offset_avg", "speaker_center_offset_p95", "trimmed_silence_seconds", "face_edge_clip_rate")} | {"final_duration": 40.0}


def test_no_reason_without_a_fault(spark):
    assert reasons(spark, **GOOD) == []


@pytest.mark.parametrize(
    ("fields", "tags"),
    [
        ({"subtitle_overlap_outputs": 1}, ["subtitle_overload"]), ({"subtitle_blink_outputs": 2}, ["subtitle_overload"]), ({"speaker_center_offset_p95": 0.23}, ["crop_jitter"]), ({"face_preserving_fallback_used": True, "face_edge_clip_rate": 0.2}, ["crop_jitter"]),
        ({"reframe_scene_interest_fallback_used": True, "subject_visibility_ratio": 0.2}, ["late_entry"]), ({"payoff_type": "Unfinished"}, ["weak_payoff"]), ({"trimmed_silence_seconds": 5.0, "retention_soft_score": 0.6}, ["bad_pacing"]),
        ({"rejected_for_missing_payoff": True}, ["weak_payoff"]), ({"rejected_for_topic_jump": True}, ["confusing_dialogue"]), ({"final_duration": 70.0, "retention_soft_score": None, "viral_soft_score": 0.3}, ["bad_pacing", "too_slow"]), ({"story_coherence_score": None}, []),
    ],
)
def test_failure_reasons(spark, fields, tags):
    assert reasons(spark, **(GOOD | fields)) == tags


def test_many_reasons_of_an_empty_row(spark):
    found = reasons(spark)
    assert {"late_hook", "weak_hook", "wrong_face_focus", "speaker_unclear", "subtitle_overload", "weak_payoff", "bad_title", "confusing_dialogue", "bad_pacing", "too_fast"} == set(found) and len(found) == len(set(found))


def test_empty_session_is_a_row_of_zeros(spark):
    row = reporting.session_metrics(catalog.records.summarized(spark, "/root/testdata/sf0.001").limit(0)).first().asDict()
    assert row.pop("runtime") is None and set(row.values()) == {0}


def test_small_report_warns(spark):
    few = catalog.records.summarized(spark, "/root/testdata/sf0.001").limit(5)
    rows = {(r.section, r.key): r.value for r in reporting.baseline_report(few).collect()}
    assert rows["warnings", "small_sample_size"] == 1 and rows["warnings", "below_minimum_data_gate"] == 1 and rows["metrics", "count"] == 5
    assert rows["sufficiency", "status:weak"] == 5 and not any(s == "trend" for s, _ in rows)


def test_trend_needs_three_sessions(spark):
    two = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "created_at string, n double")
    assert reporting.session_trend(two, ["n"]).count() == 0
    five = spark.createDataFrame([("2024-01-03", 3.0), ("2024-01-01", 1.0), (None, 99.0), ("2024-01-02", None), ("2024-01-04", 7.0)], "created_at string, n double")
    assert [tuple(r) for r in reporting.session_trend(five, ["n"]).collect()] == [("n", 1.0, 7.0, 6.0)]


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 130.0)] + [("b", 61.0), ("c", None)], "k string, s double")
    got = {r.k: (r.upper_median, r.over_60, r.over_120) for r in reporting.duration_profile(rows, "k", "s").collect()}
    assert got == {"a": (3.0, 0.25, 0.25), "b": (61.0, 1.0, 0.0), "c": (None, 0.0, 0.0)}


def test_gate_of_a_small_corpus(spark):
    assert corpus.gate(spark.range(3)).first().asDict() == {"reviewed": 3, "status": "weak", "warning": "insufficient_data_for_confident_iteration", "exit_code": 2}
    assert corpus.gate(spark.range(500)).first()["exit_code"] == 0


def test_compare_warns_of_small_samples(spark):
    side = lambda n: spark.createDataFrame([("count", n), ("hook", 0.5)], "metric string, value double")
    assert {r.metric: r.warning for r in corpus.compare(side(5.0), side(50.0)).collect()} == {"count": "small_sample_size", "hook": None}


def test_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024", 1.0), ("b", "2024", 2.0)], "candidate_id string, created_at string, score double")
    corpus.write_corpus(rows, str(tmp_path / "c"))
    corpus.write_corpus(rows.where("candidate_id = 'a'").withColumns({"created_at": F.lit("2025"), "score": F.lit(9.0)}), str(tmp_path / "c"))
    got = corpus.read_corpus(spark, str(tmp_path / "c"), "candidate_id string, created_at string, score double")
    assert sorted(map(tuple, got.collect())) == [("a", "2025", 9.0), ("b", "2024", 2.0)]


def test_manifest_precedence(spark):
    rows = spark.createDataFrame([("x", "C:\\shows\\Alpha\\e01.mkv", "", 12.34567), ("y", None, "Mine", None)], "candidate_id string, source_file string, episode_name string, final_duration double")
    got = {r.candidate_id: r for r in corpus.manifests(rows, now=F.lit("now")).collect()}
    assert (got["x"].series_name, got["x"].episode_name, got["x"].duration, got["x"].created_at) == ("Alpha", "e01", 12.346, "now")
    assert (got["y"].series_name, got["y"].episode_name, got["y"].duration) == ("", "Mine", 0.0)


def test_reports_without_outputs(spark):
    reports = spark.createDataFrame([("r", None, None, 2, ["low subtitle turns", "export_failed"], {}, {})], "run string, status string, story_mode string, requested_max int, warnings array<string>, stats map<string,string>, stage_timings map<string,double>")
    row = summary.run_summary(reports, spark.createDataFrame([], "run string, needs_review boolean"), "run").first()
    assert (row.status, row.main_rejection_reason, row.outputs, row.review_required, row.avg_hook_strength, row.avg_anchor_switches) == ("unknown", "low_subtitle_turns", 0, 0, None, 0.0)


def test_speaker_plan_merges_and_zones(spark):
    segments = spark.createDataFrame([(1, 0, 0, 900, "Ann"), (1, 1, 1000, 2000, "Ann"), (1, 2, 2000, 3000, "speaker_1"), (1, 3, 3000, 3000, "Bo"), (1, 4, 3100, 4000, "Bo"), (2, 0, 0, 10, None)], "source_id int, seg_idx int, start_ms long, end_ms long, speaker string")
    got = [tuple(r) for r in framing.speaker_plan(segments, 640, 480).orderBy("source_id", "cut").collect()]
    assert got == [(1, 1, 0, 2000, "Ann", 0, 0, 320, 480), (1, 2, 2000, 3000, "NEUTRAL", 160, 0, 320, 480), (1, 3, 3100, 4000, "Bo", 320, 0, 320, 480), (2, 1, 0, 10, "NEUTRAL", 160, 0, 320, 480)]


def test_distinct_faces_keep_the_larger(spark):
    faces = "array(struct(0.50 as x, 0.5 as y, 0.1 as w, 0.1 as h), struct(0.55 as x, 0.52 as y, 0.3 as w, 0.2 as h), struct(0.8 as x, 0.5 as y, 0.1 as w, 0.1 as h))"
    got = spark.range(1).select(visual.distinct_faces(F.expr(faces)).alias("f")).first()["f"]
    assert [float(f.x) for f in got] == [0.55, 0.8]


def test_hold_candidate(spark):
    faces = "array(struct(1 as track, 0.1D as listening, 0.9D as speaking, 0.1D as w, 0.1D as h), struct(2 as track, 0.5D as listening, 0.1D as speaking, 0.1D as w, 0.1D as h))"
    row = spark.range(1).select(visual.hold_candidate(F.expr(faces), F.lit(1)).alias("a"), visual.hold_candidate(F.expr(faces), F.lit(7)).alias("b")).first()
    assert (row.a.track, row.b.track) == (1, 2)


def test_titles_are_rebuilt_where_they_are_poor(spark):
    rows = [(1, "Where is the money", "Where is the money", "", "", "Because I never had it.", "hook_setup", "question", "resolution"), (2, "story_chain", "", "", "", "", "", "", ""), (3, "Ну, послушай меня внимательно сегодня", "Ну, послушай меня внимательно сегодня", "", "", "", "hook_only", "question", "")]
    stories = spark.createDataFrame(rows, "id int, title_seed string, hook string, setup string, escalation string, payoff string, arc_shape string, hook_type string, payoff_type string")
    plain = {r.id: r for r in titles.story_titles(stories).collect()}
    assert plain[1].title_variant_a == "Where is the money" and plain[1].title and plain[2].title == "Series moment"
    serial = {r.id: r for r in titles.story_titles(stories, russian=True).collect()}
    assert serial[1].title.startswith("Сильный момент из сцены: Where is the money") and serial[1].title_cleanup_applied
    assert serial[2].title_variant_a.startswith("Разговор цепляет сразу")


def test_plan_of_one_block(spark):
    said = ["Why are you here?", "Because you lied to me.", "This is getting worse.", "Fine, here's the truth."]
    turns = spark.createDataFrame([(1, 0, k, k * 1100, k * 1100 + 1000, "AB"[k % 2], t, 0) for k, t in enumerate(said)], "source_id long, block_no long, turn_id int, start_ms long, end_ms long, speaker string, text string, frag_no int")
    row = story.plans(turns).first()
    assert [s.role for s in row.window_segments] == ["payoff"] and (row.window_plan.turn_count, row.window_plan.speaker_count) == (4, 2)
    assert row.duration_penalty == pytest.approx((25 - 4.3) / 25, abs=1e-4) and row.clarity_score == pytest.approx(0.65)


def test_oracles_are_many():
    assert len(catalog.ORACLES) >= 100


def test_settings_round_trip(tmp_path):
    pytest.importorskip("yaml")
    from dialoom.functions import settings

    path = str(tmp_path / "s.yaml")
    settings.write_settings(path, {"max_outputs": 900, "title": "Серия"})
    assert settings.read_settings(path)["max_outputs"] == 100 and settings.read_settings(path)["title"] == "Серия"
    assert settings.read_settings(str(tmp_path / "none.yaml")) == settings.normalized()


def test_long_captions_are_cut_at_pauses(spark):
    from dialoom.operators import captions

    said = "one two three four five six, seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    words = spark.createDataFrame([("a", 0, k, k * 100, k * 100 + 90, w) for k, w in enumerate(said)] + [("a", 1, 0, 0, 5, "short")], "source_id string, segment long, nth int, start_ms long, end_ms long, text string")
    got = [(r.segment, r.piece, r.text) for r in captions.split_long(words, most=20, lines=2).orderBy("segment", "piece").collect()]
    assert got[0] == (0, 0, "one two three four five six,") and got[-1] == (1, 0, "short") and " ".join(t for s, _, t in got if s == 0) == " ".join(said)


def test_hashtags_hold_emotions_and_series(spark):
    from dialoom.operators import packaging

    row = spark.sql("select array('Anna','voice') as s, 'threat' as c, array('tears') as e, 'none' as t, 'Blue Hour' as n, false as d, 'Всё будет' as x")
    tags = lambda **k: packaging.story_hashtags(F.col("s"), F.col("c"), F.col("t"), F.col("d"), F.col("e"), F.col("n"), F.lit("hook_only"), F.col("x"), most=9, **k)
    found = row.select(tags(language="en").alias("en"), tags(language="auto").alias("auto")).first()
    assert found.en == ["#Anna", "#threat", "#tears", "#Blue_Hour"] and found.auto == ["#Anna", "#угроза", "#слёзы", "#Blue_Hour", "#shorts"]
