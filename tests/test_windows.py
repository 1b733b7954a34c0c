"""Candidate windows, interval differences and remapped words on small tables, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from dialoom.operators import intervals as iv, windows

SPANS = "source_id long, start_ms long, end_ms long, id long"


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def walk_chains(rows, gap, most, longest):
    out = []
    for source in sorted({r[0] for r in rows}):
        chain = []
        for r in sorted({x[1:] for x in rows if x[0] == source}):
            joins = chain and r[0] - chain[-1][1] <= gap and len(chain) < most and max(*(c[1] for c in chain), r[1]) - chain[0][0] <= longest
            if not joins:
                out.append((source, chain := [r]))
            else:
                chain.append(r)
    return sorted(((s, c[0][0], max(x[1] for x in c), len(c), [x[2] for x in c]) for s, c in out), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_stitched_equals_a_walk(spark, seed):
    """One source holds most rows and spans many slots of time; some windows are longer than a chain may be."""
    rng, rows, at = random.Random(seed), [], 0
    for i in range(400):
        at += rng.choice([0, 5_000, 20_000, 71_999, 72_001, 200_000])
        rows.append((1 if i % 5 else rng.randrange(3), at, at + rng.choice([0, 3_000, 15_000, 30_000, 90_000]), i))
    rows += rows[:5]
    chains = windows.stitched(spark.createDataFrame([*rows, (None, 1, 2, 3), (1, None, 4, 9)], SPANS).repartition(5))
    assert shown(chains) == walk_chains(rows, 72_000, 4, 60_000)


def test_a_long_chain_of_pointers(spark):
    rows = [(7, 1_000 * i, 1_000 * i + 900, i) for i in range(1_500)]
    chains = windows.stitched(spark.createDataFrame(rows, SPANS), 500, 3, 60_000)
    assert chains.count() == 500 and chains.agg(F.sum("n")).first()[0] == 1_500


def test_review_pass_is_off_unless_enabled(spark):
    rows = [(1, 0, 18_000, 1, 0.42, 0.34, 0.78), (1, 18_800, 36_500, 2, 0.39, 0.33, 0.82), (1, 37_000, 54_800, 3, 0.41, 0.35, 0.80), (1, 60_000, 70_000, 4, 0.9, 0.5, 0.0), (1, 80_000, 90_000, 5, 0.9, None, 0.9)]
    df = spark.createDataFrame(rows, SPANS + ", score double, speech_density double, face_presence double")
    assert windows.review_pass(df).count() == 0
    assert shown(windows.review_pass(df, True)) == [(1, 0, 54_800, 3, [1, 2, 3], 0.4067)]


def test_no_windows(spark):
    empty = spark.createDataFrame([], SPANS)
    turns = spark.createDataFrame([], "source_id long, turn_id long, start_ms long, end_ms long")
    assert windows.stitched(empty).count() == 0 and windows.turn_windows(turns).count() == 0
    assert windows.linear_windows(turns, spark.createDataFrame([], "source_id long, from_ms long, to_ms long")).count() == 0


def made_turns(seed, n=300):
    rng, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += rng.choice([0, 0, 300, 2_000, 3_500, 3_501, 9_000])
        rows.append((1, i, at, at := at + rng.choice([400, 4_000, 12_000, 25_000, 70_000])))
    return rows


def walk_turns(rows, least, most, gap):
    out = []
    for k, (s, i, start, _) in enumerate(rows):
        ends, before = [], None
        for x in rows[k:]:
            if before is not None and (x[2] - before > gap or ends[-1][3] - ends[-1][2] > most):
                break
            ends.append(x)
            before = x[3]
        fit = [x for x in ends if x[3] <= start + most]
        first = min((x[3] for x in ends if x[3] >= start + least), default=None)
        last = fit[-1][3] if fit else None
        spoken = sum(x[3] - x[2] for x in fit)
        after = ends[len(fit) or 1][1] if len(ends) > (len(fit) or 1) else None
        head = k == 0 or start - rows[k - 1][3] > gap or rows[k - 1][3] - rows[k - 1][2] > most
        out.append((s, i, start, first if fit and first is not None and first <= last else None, last, len(fit), spoken, round(spoken / (last - start), 4) if fit else 0.0, head, after))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_turn_windows_equal_a_walk(spark, seed):
    rows = made_turns(seed)
    df = spark.createDataFrame(rows, "source_id long, turn_id long, start_ms long, end_ms long").repartition(4)
    assert shown(windows.turn_windows(df)) == walk_turns(rows, 17_500, 60_000, 3_500)


def test_single_turn_still_builds_a_window(spark):
    turns = spark.createDataFrame([(1, 0, 0, 38_000)], "source_id long, turn_id long, start_ms long, end_ms long")
    bounds = spark.createDataFrame([(1, 0, 45_000)], "source_id long, from_ms long, to_ms long")
    assert shown(windows.linear_windows(turns, bounds)) == [(1, 0, 38_650, 1, 38_000, False)]
    short = spark.createDataFrame([(1, 0, 20_000, 22_000)], "source_id long, turn_id long, start_ms long, end_ms long")
    assert shown(windows.linear_windows(short, bounds)) == [(1, 10_000, 45_000, 1, 2_000, True)]
    assert windows.linear_windows(short, bounds.withColumn("to_ms", F.lit(30_000))).count() == 0


def test_fallback_window(spark):
    df = spark.createDataFrame([(10_000, 50_000, 0.31, 3), (10_000, 50_000, 0.17, 3), (10_000, 44_999, 0.5, 3), (0, 40_000, 0.2, 0), (0, 40_000, None, 1)], "s long, e long, d double, t long")
    kinds = [r[0] and r[0].story_unit_type for r in df.select(windows.fallback_window(F.col("s"), F.col("e"), F.col("d"), F.col("t"), F.lit("scene_cluster"))).collect()]
    assert kinds == ["dialogue_cluster", None, None, "audio_window", None]


def covered(rows, source):
    return {t for s, a, b in rows if s == source for t in range(a, b)}


@pytest.mark.parametrize("slot", [3, 10, 1_000_000])
def test_sweep_and_difference_equal_sets_of_instants(spark, slot):
    rng = random.Random(slot)
    make = lambda n: [(rng.randrange(2), a := rng.randrange(120), a + rng.randrange(-1, 14)) for _ in range(n)]
    a, b = make(25), make(25)
    kind = "source_id long, start_ms long, end_ms long"
    pieces = shown(iv.sweep(spark.createDataFrame([*a, (None, 1, 9)], kind), spark.createDataFrame(b, kind), slot))
    for s in range(2):
        own = [p for p in pieces if p[0] == s]
        assert {t for p in own if p[3] for t in range(p[1], p[2])} == covered(a, s) and {t for p in own if p[4] for t in range(p[1], p[2])} == covered(b, s)
        own.sort(key=lambda p: p[1])
        assert all(x[2] <= y[1] for x, y in zip(own, own[1:])) and not any(x[2] == y[1] and x[3:] == y[3:] for x, y in zip(own, own[1:]))


def test_keep_and_cut_make_the_whole(spark):
    kind = "source_id long, start_ms long, end_ms long"
    whole, cuts = [(1, 0, 100), (2, 0, 50), (3, 0, 10)], [(1, 10, 20), (1, 15, 30), (1, 90, 120), (3, 0, 10)]
    kept = shown(iv.keep_list(spark.createDataFrame(whole, kind), spark.createDataFrame(cuts, kind), 7))
    assert kept == [(1, 0, 10), (1, 30, 90), (2, 0, 50)]


def test_overlap_limited_over_many_rounds(spark):
    """More clashing candidates than a round looks at, repeated rows, rows without a length, no lineage in memory."""
    rows = [(1, i, 0, 1_000 + i, 100.0 - i / 10) for i in range(200)] + [(1, 500 + i, 10_000 * i, 10_000 * i + 500, 10.0 - i) for i in range(1, 9)] + [(2, 7, 5, 5, 1.0)] * 3 + [(2, 8, 5, 5, 0.5)]
    df = spark.createDataFrame([(s, i, a, b, x) for s, i, a, b, x in rows], "source_id long, id long, start_ms long, end_ms long, score double")
    want = []
    for s in (1, 2):
        picked = []
        for r in sorted({x for x in rows if x[0] == s}, key=lambda x: (-x[4], x[1])):
            clash = any((h := max(p[3], r[3]) - min(p[2], r[2])) > 0 and max(0, min(p[3], r[3]) - max(p[2], r[2])) / h > 0.4 for p in picked)
            if len(picked) < 5 and not clash:
                picked.append(r)
        want += picked
    assert shown(iv.overlap_limited(df, 5).select("source_id", "id", "start_ms", "end_ms", "score")) == sorted(want, key=str)
    assert iv.overlap_limited(df.limit(0), 5).count() == 0


WORDS = "source_id long, id long, start_ms long, end_ms long, words array<struct<start_ms:long,end_ms:long,word:string>>"


def test_words_are_remapped_inside_their_rows(spark):
    rows = [(1, 1, 0, 1_000, [(0, 300, "a"), (300, 600, "b"), (600, 1_000, "c")]), (1, 2, 1_000, 2_000, None), (1, 3, 2_000, 2_500, [(2_000, 2_500, "gone")]), (2, 1, 0, 100, [(0, 100, "all")])]
    cuts = spark.createDataFrame([(1, 250, 650), (1, 2_000, 2_500), (2, 0, 100)], "source_id long, start_ms long, end_ms long")
    found = {(r.source_id, r.id): (r.start_ms, r.end_ms, [tuple(w) for w in r.words]) for r in iv.remap_words(spark.createDataFrame(rows, WORDS), cuts).collect()}
    assert found == {(1, 1): (0, 600, [(0, 250, "a"), (250, 600, "c")]), (1, 2): (600, 1_600, []), (2, 1): (0, 100, [(0, 100, "all")])}


def test_integrity_names_each_problem(spark):
    rows = [(1, 1, 0, 1_000, [(0, 300, "a"), (200, 600, "b"), (100, 100, "c")]), (1, 2, 900, 2_000, None), (1, 3, 3_000, 3_000, [(3_000, 3_100, "x")])]
    assert shown(iv.integrity(spark.createDataFrame(rows, WORDS))) == sorted(
        [(1, 1, "word_empty", 1), (1, 1, "word_order", 1), (1, 1, "word_overlap", 2), (1, 2, "overlap", 1), (1, 3, "empty", 1), (1, 3, "word_outside", 1)], key=str
    )


def test_single_block_is_not_compacted(spark):
    rows = [(1, 1, 7_600, 8_100, None), (1, 2, 8_200, 8_800, None), (2, 1, 0, 500, [(0, 400, "a")]), (2, 2, 5_000, 5_500, [(5_100, 5_400, "b")])]
    found = {(r.source_id, r.id): (r.start_ms, r.end_ms, r.changed, r.removed_ms, r.words and [tuple(w) for w in r.words]) for r in iv.compacted(spark.createDataFrame(rows, WORDS), 1_000).collect()}
    assert found[1, 1] == (7_600, 8_100, False, 0, None) and found[2, 1] == (0, 500, True, 4_500, [(0, 400, "a")]) and found[2, 2] == (500, 1_000, True, 4_500, [(600, 900, "b")])


def test_an_empty_cut_takes_nothing_away(spark):
    kind = "source_id long, start_ms long, end_ms long"
    whole, cuts = [(1, 0, 100)], [(1, 10, 20), (1, 50, 50), (1, 80, 90)]
    assert shown(iv.keep_list(spark.createDataFrame(whole, kind), spark.createDataFrame(cuts, kind), 7)) == [(1, 0, 10), (1, 20, 80), (1, 90, 100)]
