"""Operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from dialoom.functions import lexicons, text
from dialoom.operators import captions, framing, grouping, intervals, packaging, pauses, ranking, reporting, story, turns
from dialoom.plans import catalog
from dialoom.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def segments(spark, rows):
    return spark.createDataFrame([("s", i, a, b, t, who) for i, (a, b, t, who) in enumerate(rows)], "source_id string, seg_idx int, start_ms long, end_ms long, text string, speaker string")


def test_turns_and_silence(spark):
    found = turns.dialogue_turns(segments(spark, [(0, 1000, "Привет", "A"), (2200, 3000, "Пока", "B")]))
    assert [r.turn_type for r in found.orderBy("turn_id").collect()] == ["short_reply", "short_reply"]
    totals = spark.createDataFrame([("s", 4000)], "source_id string, total_ms long")
    assert sorted(r.duration_ms for r in turns.silence_spans(found, totals).collect()) == [1000, 1200]


def test_interruption_and_blank_speaker(spark):
    found = turns.dialogue_turns(segments(spark, [(0, 1000, "<i>Why</i> {an8} now?", " "), (1100, 1500, "What! ", "B"), (1500, 900, None, None)])).orderBy("turn_id").collect()
    assert [(r.text, r.speaker, r.turn_type, r.is_interruption) for r in found] == [("Why now?", "UNKNOWN", "question", False), ("What!", "B", "exclamation", True), ("", "UNKNOWN", "empty", True)]
    assert found[2].end_ms == 1500


def test_blocks_by_gap_and_bridge(spark):
    t = turns.dialogue_turns(segments(spark, [(0, 1000, "bridge river", "A"), (6000, 7000, "bridge river", "A"), (12500, 13000, "river bridge", "B"), (40000, 41000, "later on", "A")]))
    assert [r.block_no for r in grouping.gap_blocks(t).orderBy("turn_id").collect()] == [0, 1, 2, 3]
    assert [r.block_no for r in grouping.bridged_blocks(t).orderBy("turn_id").collect()] == [0, 0, 0, 1]
    row = grouping.blocks(grouping.bridged_blocks(t)).orderBy("block_no").first()
    assert row.conversation_id.startswith("conv_") and len(row.conversation_id) == 17 and row.speakers == ["A", "B"]


def test_story_of_one_fragment_has_payoff_role(spark):
    rows = [(0, 1000, "Why are you here?", "A"), (1100, 2100, "Because you lied to me.", "B"), (2200, 3100, "This is getting worse.", "A"), (3200, 4200, "Fine, here's the truth.", "B")]
    t = grouping.bridged_blocks(turns.dialogue_turns(segments(spark, rows)))
    frags = story.roles(story.fragments(story.split_fragments(t)))
    assert [r.role for r in frags.collect()] == ["payoff"]
    chain = story.summaries(story.chains(frags)).first()
    assert (chain.setup, chain.arc_shape, chain.completion_score, chain.hook_type) == ("", "hook_setup", 0.5, "question")


def test_roles_of_three_fragments(spark):
    rows = [("s", 0, k, 0, 1, 1, h, c, e, m, p) for k, (h, c, e, m, p) in enumerate([(0.1, 0.0, 0.0, 0.0, 0.0), (0.0, 0.2, 0.1, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.3)])]
    frags = spark.createDataFrame(rows, "source_id string, block_no long, frag_no int, start_ms long, end_ms long, turn_count long, hook_score double, conflict_score double, escalation_score double, emotion_score double, payoff_score double")
    assert [r.role for r in story.roles(frags).orderBy("frag_no").collect()] == ["hook", "escalation", "payoff"]


def test_lexicon_score_and_types(spark):
    assert value(spark, F.round(text.lexicon_score(F.lit("Stop!"), lexicons.HOOK), 4)) == 0.02
    assert value(spark, text.hook_type(F.lit("Whatever"))) == "question"
    assert value(spark, text.payoff_type(F.lit("  "))) == "unfinished"
    assert value(spark, text.conflict_type(F.array().cast("array<string>"), F.lit(""))) == "none"
    assert [len(x) for x in (lexicons.HOOK, lexicons.CONFLICT, lexicons.ESCALATION, lexicons.EMOTION, lexicons.PAYOFF)] == [50, 63, 40, 68, 61]


def test_timestamp(spark):
    assert value(spark, text.timestamp(F.lit(3661500))) == "01:01:01,500"


def test_caption_lines(spark):
    assert value(spark, text.caption_lines(F.lit("a b"))) == "a b"
    lines = value(spark, text.caption_lines(F.lit("word " * 10))).split("\n")
    assert len(lines) == 2 and len(lines[0]) <= 34


def test_overlap_limited(spark):
    rows = [("s", 1, 0, 10, 0.9), ("s", 2, 2, 11, 0.8), ("s", 3, 20, 30, 0.7), ("s", 4, 21, 40, 0.6), ("s", 5, 9, 19, 0.5)]
    picked = intervals.overlap_limited(spark.createDataFrame(rows, "source_id string, id long, start_ms long, end_ms long, score double"), 3)
    assert sorted(r.id for r in picked.collect()) == [1, 3, 5]


def test_remap(spark):
    points = spark.createDataFrame([("s", t, t + 1) for t in (1, 4, 6, 8)], "source_id string, start_ms long, end_ms long")
    cuts = spark.createDataFrame([("s", 2, 3), ("s", 5, 7)], "source_id string, start_ms long, end_ms long")
    assert sorted((r.start_ms, r.end_ms) for r in intervals.remap(points, cuts).collect()) == [(1, 2), (3, 4), (5, 6)]


def test_merge_and_neighbours(spark):
    rows = spark.createDataFrame([("s", 0, 100), ("s", 150, 300), ("s", 1000, 1200), ("s", 10, 20)], "source_id string, start_ms long, end_ms long")
    assert sorted((r.start_ms, r.end_ms, r.n) for r in intervals.merge_intervals(rows).collect()) == [(0, 300, 3), (1000, 1200, 1)]


def test_neighbours_of_gaps(spark):
    """Overlapping and nested intervals, ones that lack a time, a gap that lacks both neighbours, and repeated gaps."""
    t = "source_id string, start_ms long, end_ms long"
    voiced = spark.createDataFrame([("s", 0, 100), ("s", 20, 90), ("s", None, 50), ("s", 70, None), ("s", 990, 1200), ("s", 990, 1500), ("u", 5, 6), (None, 0, 7)], t)
    gaps = spark.createDataFrame([("s", 100, 1000), ("s", 100, 1000), ("s", 75, 1011), ("t", 0, 9), (None, 7, 30)], t)
    found = sorted((str(r.source_id), r.start_ms, r.prev_ms, r.next_ms) for r in intervals.neighbours(gaps, voiced).collect())
    assert found == [("None", 7, 7, 0), ("s", 75, 70, 0), ("s", 100, 70, 210), ("s", 100, 70, 210), ("t", 0, 0, 0)]


def test_neighbours_sort_twice_in_a_stage(spark):
    """A task holds its sources in two sorts, and nothing of the steps before."""
    for name in ("voiced_neighbours", "pause_timeline"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        stage = plan.split("Exchange")[0]
        assert stage.count("Sort [") == 2 and stage.count("Aggregate") == 0


def test_dead_air_is_cut(spark):
    voiced = spark.createDataFrame([("s", 0, 200), ("s", 3600, 3800)], "source_id string, start_ms long, end_ms long")
    row = pauses.pause_timeline(voiced).first()
    assert (row.start_ms, row.end_ms, row.silence_type, row.decision) == (200, 3600, "dead_air", "cut")
    assert pauses.pause_stats(pauses.pause_timeline(voiced)).first().cut_ms == 3400


def test_publishable_needs_length(spark):
    rows = spark.createDataFrame([("x", 1, 24.0, 0.8, True, 0.5, 0.5, 0.5, 0.5), ("x", 2, 40.0, 0.6, False, 0.5, 0.5, 0.5, 0.5)], "g string, id long, duration double, story_completion_score double, has_payoff boolean, story_coherence_score double, clarity_score double, hook_score double, score double")
    assert [r.id for r in ranking.publishable(rows, ["g"], "id", least_s=35.0).collect()] == [2]


def test_sufficiency(spark):
    assert [value(spark, reporting.sufficiency(F.lit(n))) for n in (50, 150, 300, 600)] == ["weak", "minimum", "recommended", "strong"]


def test_co_occurrence(spark):
    rows = spark.createDataFrame([(["b", "a", "c"],), (["a", "b"],)], "tags array<string>")
    assert [(r.pair, r.n) for r in reporting.co_occurrence(rows, "tags").collect()] == [("a::b", 2), ("a::c", 1), ("b::c", 1)]


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (0.2,), (None,)], "v double")
    assert [r.n for r in reporting.histogram(rows, "v").orderBy("bucket").collect()] == [1, 1, 0, 0, 1]


def test_primary_face_keeps_better_speaker(spark):
    rows = [(1, 0, 0, 0.3, 0.5, 0.2, 0.3, 0.4, 0.2, 0.1, 1), (1, 0, 1, 0.7, 0.5, 0.2, 0.3, 0.6, 0.2, 0.3, 2)]
    found = framing.primary_faces(spark.createDataFrame(rows, framing.TRACKED))
    assert found.first().track == 2


def test_titles(spark):
    assert value(spark, packaging.normal_title(F.lit("well so the the plan!! worked"))) == "The plan! worked"
    assert value(spark, packaging.trimmed_title(F.lit("a quite long title, of words"), 20)) == "A quite long..."
    assert value(spark, text.slug(F.lit("big news, today"))) == "#big_news_today"


def test_output_names_do_not_clash(spark):
    rows = spark.createDataFrame([(1, "a/b"), (2, "ab"), (3, "")], "k long, title string")
    assert [r.file_name for r in packaging.output_names(rows, "k").orderBy("k").collect()] == ["ab", "ab [2]", "clip"]


def test_timeline_has_no_overlap(spark):
    rows = [(0, 1004, "a", "A"), (900, 2000, "b", "B"), (2500, 2600, "b", "B"), (9000, 9100, "c", "A")]
    found = captions.stable_timeline(segments(spark, rows)).orderBy("nth").collect()
    assert all(a.end_ms <= b.start_ms for a, b in zip(found, found[1:]))
    assert [r.state for r in found] == ["show_phrase", "show_phrase", "hold_phrase", "show_phrase"]


def test_srt_round_trip(spark, tmp_path):
    events = segments(spark, [(0, 1500, "Hello there", "A"), (2000, 3661500, "Bye", "B")])
    files.write_srt(events, str(tmp_path / "out"))
    found = files.read_srt(spark, str(tmp_path / "out" / "source_id=s")).orderBy("cue").collect()
    assert [(r.cue, r.start_ms, r.end_ms, r.text.strip()) for r in found] == [(1, 0, 1500, "Hello there"), (2, 2000, 3661500, "Bye")]


def test_feedback_keeps_given_time(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_feedback(spark.createDataFrame([("a", "2020-01-01T00:00:00Z"), ("b", None)], "event string, timestamp_utc string"), path)
    found = {r.event: r.timestamp_utc for r in spark.read.json(path).collect()}
    assert found["a"] == "2020-01-01T00:00:00Z" and found["b"].endswith("Z")


def test_percentile_interpolates(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9)], "v double")
    assert rows.agg(F.percentile("v", F.lit(0.95))).first()[0] == pytest.approx(8.25)


def test_settings():
    from dialoom.functions import settings

    one = settings.normalized({"output_root": "/a", "caption_max_chars": 3, "pause_cut_seconds": 2, "max_outputs": "x"})
    assert (one["caption_max_chars"], one["pause_keep_seconds"], one["max_outputs"]) == (16, 2.0, 5)
    assert settings.settings_hash(one) == settings.settings_hash({**one, "output_root": "/b"}) != settings.settings_hash({**one, "max_outputs": 6})


def test_misread_text_is_repaired(spark):
    from dialoom.functions import repair

    good = "Привет, это не так."
    bad = good.encode().decode("latin1")
    rows = spark.createDataFrame([(good,), (bad,), ("plain words",), (None,)], "t string")
    assert [r.v for r in rows.select(repair.repaired(F.col("t")).alias("v")).collect()] == [good, good, "plain words", ""]


def test_glide_moves_over(spark):
    rows = [(1, 0, 1, 0.2, "k"), (1, 1, 2, 0.8, "s"), (1, 2, 2, 0.8, "k"), (1, 3, 2, 0.8, "k")]
    found = framing.glide(spark.createDataFrame(rows, "clip long, window long, track int, x double, state string")).orderBy("window")
    assert [round(r.x, 4) for r in found.collect()] == [0.2, 0.4, 0.6, 0.8]


def test_clips_of_faces_are_bounded(spark, tmp_path):
    from dialoom.plans import intervals as plans

    spark.range(9000).selectExpr("id AS event_id", "if(id % 3 = 0, 7L, id) AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    found = plans.faces(spark, str(tmp_path))
    sizes = {r.clip: r["count"] for r in found.groupBy("clip").count().collect()}
    assert sum(sizes.values()) == 9000 and len(sizes) == 60 and max(sizes.values()) <= plans.CLIP_IDS / 2
    assert found.where("clip % 20 = 7 and t = 0").count() == 6


def test_overlap_limited_and_remap_gather_no_source(spark):
    rows = [(1, i, (i * 37) % 900, (i * 37) % 900 + 5 + i % 60, float(i * 13 % 101)) for i in range(400)] + [(2, 1, 5, 5, 1.0), (2, 2, 5, 5, 1.0)]
    frame = spark.createDataFrame(rows, "source_id long, id long, start_ms long, end_ms long, score double")
    cuts = [(1, s, s + 7) for s in range(10, 900, 40)]
    picked, taken = intervals.overlap_limited(frame, 20), intervals.remap(frame, spark.createDataFrame(cuts, "source_id long, start_ms long, end_ms long"))
    for f in (picked, taken):
        assert "collect_list" not in f._jdf.queryExecution().optimizedPlan().toString()
    wanted = {1: [], 2: []}
    for s, i, a, b, _ in sorted(rows, key=lambda r: (r[0], -r[4], r[1])):
        clash = lambda p: max(b, p[2]) > min(a, p[1]) and max(0, min(b, p[2]) - max(a, p[1])) / (max(b, p[2]) - min(a, p[1])) > 0.4  # noqa: B023, E731
        if len(wanted[s]) < 20 and not any(map(clash, wanted[s])):
            wanted[s].append((i, a, b))
    assert {(r.source_id, r.id, r.start_ms, r.end_ms) for r in picked.collect()} == {(s, *p) for s, own in wanted.items() for p in own}
    before = lambda t: sum(max(0, min(t, e) - s) for _, s, e in cuts)
    moved = {(s, i, a - before(a), b - before(b)) for s, i, a, b, _ in rows if s == 1 and b - before(b) > a - before(a)} | {(2, 1, 5, 5), (2, 2, 5, 5)}
    assert {(r.source_id, r.id, r.start_ms, r.end_ms) for r in taken.collect()} == moved


def test_a_capital_is_one_letter(spark):
    """As in DuckDB; upper() alone gives 'SS', 'ʼN' or 'ΑΙ'."""
    texts = spark.createDataFrame([("ßheit",), ("ŉ x",), ("ᾳb",), ("éa",), ("",), ("ẞa",)], "t string")
    assert [r[0] for r in texts.select(text.capitalise(F.col("t"))).collect()] == ["ẞheit", "ŉ x", "ᾼb", "Éa", "", "ẞa"]
    assert texts.select(packaging.hook_seed(F.col("t"))).first()[0] == "ẞheit"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_small_groups_are_walked_without_a_call_each(spark):
    """F3, F5, F7, F8, F12: a group of its own in pandas cost some 25 ms for each caption, source, block or clip."""
    events = segments(spark, [(0, 1000, "a b", "A")]).select("source_id", "start_ms", "end_ms", "text")
    talk = turns.dialogue_turns(segments(spark, [(0, 1000, "a b", "A")]))
    faces = spark.createDataFrame([(1, 0, 0, 0.1, 0.1, 0.2, 0.2, 0.5, 0.1, 0.1)], "clip long, t int, face int, x double, y double, w double, h double, speaking double, listening double, motion double")
    made = [captions.sentences(events), captions.stable_timeline(events), story.split_fragments(grouping.bridged_blocks(talk)), framing.assign_tracks(faces)]
    assert not any("FlatMapGroups" in plan(x) for x in made)


def test_walks_keep_groups_apart_and_cross_batches(spark):
    """More rows than one batch has, of groups of one row and of many; missing times compare as false."""
    rows = spark.range(30_000).select(F.when(F.col("id") < 25_000, 0).otherwise(F.col("id")).cast("string").alias("source_id"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 5).alias("end_ms"), F.lit("w").alias("text"))
    found = captions.sentences(rows).groupBy("source_id").agg(F.count("*").alias("n"), F.max("nth").alias("last")).where("n > 1 or last > 0").collect()
    assert [(r.source_id, r.n, r.last) for r in found] == [("0", 3_125, 3_124)]
    none = spark.createDataFrame([("s", None, None, "b"), ("s", 0, 10, "a")], "source_id string, start_ms long, end_ms long, text string")
    assert captions.sentences(none).first().text == "a b"


def test_long_titles_are_cleaned_once(spark):
    """each word of a title cleaned the whole title again: 4,000 words took minutes."""
    import time

    titles = spark.createDataFrame([(" ".join(f"Word{i % 7}x , {i}" for i in range(4_000)),)], "t string")
    began = time.time()
    assert titles.select(packaging.normal_title(F.col("t"))).first()[0].startswith("Word0x, 0 Word1x, 1")
    assert time.time() - began < 20


def test_lexicons_of_texts_without_cyrillic(spark):
    """F16: only entries that a text can hold are looked for; the order of entries stays."""
    texts = spark.createDataFrame([(1, "Wait, stop"), (2, "СТОЙ wait"), (3, None), (4, "")], "k int, t string")
    found = {r.k: r.h for r in texts.select("k", text.hits(F.col("t"), ("стой", "stop", "wait")).alias("h")).collect()}
    assert found == {1: ["stop", "wait"], 2: ["стой", "wait"], 3: [], 4: []}
    assert value(spark, text.occurrences(F.lit("РСРСб"), ("Р", "С"))) == 4 and value(spark, text.occurrences(F.lit("a.b."), (".",))) == 2
