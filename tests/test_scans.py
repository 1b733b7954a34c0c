"""Running states in slices against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from dialoom.operators import framing, scans


@pytest.mark.parametrize("width", [2, 5, 256])
def test_lookup_scan_equals_a_walk(spark, width):
    """Several levels of slices, one sequence much longer than the others, gaps in the order."""
    rng = random.Random(width)
    rows, want = [], []
    for by, n in ((1, 90), (2, 3), (3, 1)):
        state, nth = None, -7
        for _ in range(n):
            nth += rng.choice([1, 1, 4, 11])
            moves = [(k, rng.randrange(5)) for k in rng.sample(range(5), 2)]
            other = rng.randrange(5)
            before, state = state, dict(moves).get(state, other)
            rows.append((by, nth, (moves, other)))
            want.append((by, nth, before, state))
    df = spark.createDataFrame(rows, "by long, nth long, f struct<moves:array<struct<k:int,v:int>>,other:int>").repartition(3)
    found = scans.scanned(df, ["by"], scans.looked_up, scans.looked_up_twice, "int", width)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("width", [3, 256])
def test_decayed_scan_equals_a_walk(spark, width):
    rng, rows, want, state = random.Random(1), [], [], 0.0
    for nth in range(60):
        keep, add = rng.choice([0.0, 0.5, 1.0, 1.5]), rng.uniform(-0.6, 0.8)
        state = min(1.0, max(0.0, keep * state + add))
        rows.append((9, nth, (keep, add, 0.0, 1.0)))
        want.append(state)
    df = spark.createDataFrame(rows, "by long, nth long, f struct<keep:double,add:double,low:double,high:double>")
    found = [r.state for r in scans.scanned(df, ["by"], scans.decayed, scans.decayed_twice, "double", width).orderBy("nth").collect()]
    assert found == pytest.approx(want, abs=1e-9)


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "by long, nth long, f struct<keep:double,add:double,low:double,high:double>")
    assert scans.scanned(df, ["by"], scans.decayed, scans.decayed_twice, "double").count() == 0


def face(t, face, x, speaking=0.5, track=None, size=0.3, motion=0.0):
    return (1, t, face, x, 0.5, size, size, speaking, 0.0, motion, track)


def test_cuts_shorten_memory(spark):
    """A face that is gone for a while is the same track only where no cuts of the scene count against it."""
    rows = [face(0, 0, 0.2)[:10]] + [face(t, 0, 0.9)[:10] for t in range(1, 5)] + [face(5, 0, 0.2)[:10]]
    faces = spark.createDataFrame(rows, framing.TRACKED.rsplit(",", 1)[0])
    cuts = spark.createDataFrame([(1, t) for t in (2, 2, 3)], "clip long, t int")
    last = lambda df: {r.t: r.track for r in df.collect()}[5]
    assert last(framing.assign_tracks(faces, memory=4)) == 1 and last(framing.assign_tracks(faces, memory=4, cuts=cuts)) == 3
    assert last(framing.assign_tracks(faces, memory=12, cuts=cuts)) == 1


def test_remembered_scores_fade_at_cuts(spark):
    rows = [face(0, 0, 0.2, 1.0, 1), face(1, 0, 0.2, 0.0, 1), face(4, 0, 0.2, 0.0, 1), face(4, 1, 0.8, 0.3, 2)]
    tracked = spark.createDataFrame(rows, framing.TRACKED)
    cuts = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "clip long, t int")
    found = {(r.t, r.track): r.score for r in framing.remembered(tracked, cuts, share=0.5, slot=2).collect()}
    assert found == {(0, 1): 1.0, (1, 1): 0.5, (4, 1): pytest.approx(0.5 * 0.72**2 * 0.5, abs=1e-6), (4, 2): 0.3}
    assert {r.score for r in framing.remembered(tracked, cuts.limit(0), share=0.0).collect()} == {1.0, 0.0, 0.3}


def test_dominant_track_is_not_given_up_lightly(spark):
    """The clip's dominant track holds a window unless another speaks or ranks clearly above it; like pairs are shown together."""
    base = [face(t, 0, 0.3, 0.60, 1) for t in range(10)]
    near, far = [face(10, 0, 0.3, 0.50, 1), face(10, 1, 0.35, 0.55, 2)], [face(20, 0, 0.3, 0.50, 1), face(20, 1, 0.35, 0.80, 2)]
    two = [face(30, 0, 0.2, 0.50, 1), face(30, 1, 0.8, 0.55, 2)]
    found = {r.window: (r.kind, r.track, r.x) for r in framing.window_targets(spark.createDataFrame(base + near + far + two, framing.TRACKED), 10).collect()}
    assert found == {0: ("best", 1, 0.3), 1: ("dominant", 1, 0.3), 2: ("best", 2, 0.35), 3: ("pair", None, 0.5)}


def test_long_clip_keeps_its_primary_over_slices(spark):
    rows = [face(t, k, 0.2 + 0.5 * k, 0.50 + 0.01 * (k == t % 2), k + 1) for t in range(600) for k in (0, 1)] + [face(600, 0, 0.2, 0.1, 1), face(600, 1, 0.7, 0.9, 2)]
    found = framing.primary_faces(spark.createDataFrame(rows, framing.TRACKED)).groupBy("track").agg(F.count("*").alias("n")).collect()
    assert {r.track: r.n for r in found} == {1: 600, 2: 1}
