"""Queries over events as intervals, points and synthetic detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import framing, intervals as iv, packaging, pauses
from ..sources import adapters, files
from ..sources.shared import written
from .registry import INTERVALS, query

HOUR = 3_600_000


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.intervals(spark, sf_dir)


MERGED = f"""{INTERVALS}, o AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60000 THEN 0 ELSE 1 END AS new FROM iv),
  i AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM o),
  merged AS (SELECT source_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM i GROUP BY source_id, island)"""


@query(f"WITH {MERGED} SELECT * FROM merged")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge_intervals(spans(spark, sf_dir), 60_000)


@query(
    f"""WITH {INTERVALS}, o AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS new FROM iv WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY start_ms, id)::BIGINT AS run FROM o)
    SELECT source_id, run, any_value(speaker) AS speaker, arg_min(start_ms, (start_ms, id)) AS start_ms, arg_max(end_ms, (start_ms, id)) AS end_ms, count(*) AS n FROM i GROUP BY source_id, run"""
)
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.key_runs(spans(spark, sf_dir), "speaker", ["start_ms", "id"])


@query(
    f"""WITH {INTERVALS}, o AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND start_ms - lag(end_ms) OVER w < {6 * HOUR} THEN 0 ELSE 1 END AS new FROM iv WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY start_ms, id)::BIGINT AS run FROM o)
    SELECT source_id, run, any_value(speaker) AS speaker, arg_min(start_ms, (start_ms, id)) AS start_ms, arg_max(end_ms, (start_ms, id)) AS end_ms, count(*) AS n FROM i GROUP BY source_id, run"""
)
def turn_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.key_runs(spans(spark, sf_dir), "speaker", ["start_ms", "id"], 6 * HOUR)


@query(
    f"""WITH {INTERVALS}, p AS (SELECT DISTINCT source_id, end_ms // {HOUR} * {HOUR} AS at_ms FROM iv)
    SELECT p.source_id, p.at_ms, coalesce(arg_min(iv.id, (iv.start_ms, iv.id)), -1) AS id FROM p LEFT JOIN iv ON p.source_id = iv.source_id AND p.at_ms >= iv.start_ms AND p.at_ms < iv.end_ms GROUP BY ALL"""
)
def active_turn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spans(spark, sf_dir)
    points = every.select("source_id", (F.floor(F.col("end_ms") / HOUR) * HOUR).alias("at_ms")).distinct()
    return iv.active_at(points, every, HOUR).fillna(-1, ["id"])


@query(f"WITH {INTERVALS} SELECT source_id, start_ms // {24 * HOUR} AS window, count(*) AS n, round(avg(score), 4) AS mean FROM iv GROUP BY ALL")
def points_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.points_per_window(spans(spark, sf_dir).select("source_id", F.col("start_ms").alias("at_ms"), F.col("score").alias("value")), 24 * HOUR)


@query(
    f"""WITH {MERGED}, g AS (SELECT source_id, lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms) AS start_ms, start_ms AS end_ms FROM merged),
    h AS (SELECT * FROM g WHERE end_ms > start_ms)
    SELECT h.source_id, h.start_ms, h.end_ms,
      coalesce(arg_max(m.end_ms - m.start_ms, m.start_ms) FILTER (m.end_ms <= h.start_ms + 20), 0) AS prev_ms, coalesce(arg_min(m.end_ms - m.start_ms, m.start_ms) FILTER (m.start_ms >= h.end_ms - 20), 0) AS next_ms
    FROM h LEFT JOIN merged m ON h.source_id = m.source_id GROUP BY ALL"""
)
def voiced_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    voiced = written(iv.merge_intervals(spans(spark, sf_dir), 60_000).drop("n"), "voiced")  # merged once, as it is read twice
    order = Window.partitionBy("source_id").orderBy("start_ms")
    gaps = voiced.select("source_id", F.lag("end_ms").over(order).alias("start_ms"), F.col("start_ms").alias("end_ms")).where("end_ms > start_ms")
    return iv.neighbours(gaps, voiced)


CUTS = f"""{MERGED}, cuts AS (SELECT source_id, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms) AS k FROM merged) WHERE k % 3 = 0)"""


@query(
    f"""WITH {CUTS}, r AS (SELECT iv.source_id, iv.id, iv.start_ms - coalesce(sum(greatest(0, least(iv.start_ms, c.end_ms) - c.start_ms)), 0)::BIGINT AS start_ms,
      iv.end_ms - coalesce(sum(greatest(0, least(iv.end_ms, c.end_ms) - c.start_ms)), 0)::BIGINT AS end_ms, iv.start_ms AS os, iv.end_ms AS oe
      FROM iv LEFT JOIN cuts c ON iv.source_id = c.source_id GROUP BY iv.source_id, iv.id, iv.start_ms, iv.end_ms),
    s AS (SELECT *, max(CASE WHEN end_ms > start_ms THEN 1 ELSE 0 END) OVER (PARTITION BY source_id) AS left_ FROM r)
    SELECT source_id, id, CASE WHEN left_ = 1 THEN start_ms ELSE os END AS start_ms, CASE WHEN left_ = 1 THEN end_ms ELSE oe END AS end_ms FROM s WHERE left_ = 0 OR end_ms > start_ms"""
)
def time_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spans(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms"))
    cuts = iv.merge_intervals(every, 60_000).withColumn("k", nth).where("k % 3 = 0").select("source_id", "start_ms", "end_ms")
    return iv.remap(every.select("source_id", "id", "start_ms", "end_ms"), cuts)


@query(
    f"""WITH RECURSIVE {INTERVALS}, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS k FROM iv),
    f AS (SELECT source_id, 0::BIGINT AS k, []::STRUCT(id BIGINT, s BIGINT, e BIGINT, score DOUBLE)[] AS acc FROM (SELECT DISTINCT source_id FROM o)
      UNION ALL SELECT f.source_id, o.k, CASE WHEN len(acc) < 20 AND len(list_filter(acc, lambda p: (greatest(0, least(p.e, o.end_ms) - greatest(p.s, o.start_ms)) / (greatest(p.e, o.end_ms) - least(p.s, o.start_ms))::DOUBLE) > 0.4)) = 0
        THEN list_append(acc, {{'id': o.id, 's': o.start_ms, 'e': o.end_ms, 'score': o.score}}) ELSE acc END
      FROM f JOIN o ON f.source_id = o.source_id AND o.k = f.k + 1),
    l AS (SELECT source_id, unnest(arg_max(acc, k)) AS p FROM f GROUP BY source_id)
    SELECT source_id, p.id AS id, p.s AS start_ms, p.e AS end_ms, p.score AS score FROM l"""
)
def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.overlap_limited(spans(spark, sf_dir), 20)


TOTALS = f"{INTERVALS}, t AS (SELECT source_id, max(end_ms) - min(start_ms) AS total_ms FROM iv GROUP BY source_id)"


@query(
    f"""WITH {TOTALS} SELECT source_id, g.start_ms AS start_ms, least(total_ms, g.start_ms + {24 * HOUR}) AS end_ms
    FROM (SELECT source_id, total_ms, unnest(range(0, total_ms, {24 * HOUR})) AS start_ms FROM t WHERE total_ms > 0) g"""
)
def fixed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = spans(spark, sf_dir).groupBy("source_id").agg((F.max("end_ms") - F.min("start_ms")).alias("total_ms"))
    return iv.fixed_grid(totals, 24 * HOUR)


@query(
    f"""WITH {TOTALS} SELECT source_id, g.start_ms AS start_ms, least(total_ms, g.start_ms + {35 * HOUR}) AS end_ms
    FROM (SELECT source_id, total_ms, unnest(range(0, total_ms, {10 * HOUR})) AS start_ms FROM t WHERE total_ms > 0) g"""
)
def sliding_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = spans(spark, sf_dir).groupBy("source_id").agg((F.max("end_ms") - F.min("start_ms")).alias("total_ms"))
    return iv.fixed_grid(totals, 35 * HOUR, 10 * HOUR)


@query(
    f"""WITH {INTERVALS} SELECT id, round((score - min(score) OVER w) / CASE WHEN max(score) OVER w - min(score) OVER w > 1e-6 THEN max(score) OVER w - min(score) OVER w ELSE 1.0 END, 6) AS score_norm
    FROM iv WINDOW w AS (PARTITION BY source_id)"""
)
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.min_max(spans(spark, sf_dir), "score", "source_id").select("id", F.round("score_norm", 6).alias("score_norm"))


@query(f"WITH {INTERVALS} SELECT source_id, round(quantile_cont((end_ms - start_ms)::DOUBLE, 0.95), 3) AS hold_p95 FROM iv GROUP BY source_id")
def percentile_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).groupBy("source_id").agg(F.round(F.percentile(F.col("end_ms") - F.col("start_ms"), F.lit(0.95)), 3).alias("hold_p95"))


@query(
    f"""WITH {INTERVALS}, k AS (SELECT *, CASE WHEN speaker <> 'view' THEN speaker END AS key FROM iv),
    p AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY start_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
    SELECT source_id, sum(CASE WHEN key <> before THEN 1 ELSE 0 END)::BIGINT AS switches, count(key) AS keyed FROM p GROUP BY source_id"""
)
def speaker_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.switches(spans(spark, sf_dir).withColumn("key", F.when(F.col("speaker") != "view", F.col("speaker"))), "key", ["start_ms", "id"])


@query(
    f"""WITH {INTERVALS}, r AS (SELECT source_id, start_ms // {HOUR} AS slot, sqrt(avg(score * score)) AS rms FROM iv GROUP BY ALL),
    m AS (SELECT source_id, greatest(10.0, 1.2 * median(rms)) AS limit_ FROM r GROUP BY source_id)
    SELECT source_id, round(avg(CASE WHEN rms > limit_ THEN 1 ELSE 0 END), 4) AS density, round(max(rms), 4) AS loudest FROM r JOIN m USING (source_id) GROUP BY source_id"""
)
def loudness_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean squares per slot, and the share of slots above 1.2 medians; values are small here, and so is the floor."""
    return iv.loudness(spans(spark, sf_dir).select("source_id", F.col("start_ms").alias("at_ms"), F.col("score").alias("value")), HOUR, floor=10.0)


@query(
    """WITH d AS (SELECT ts::DATE::VARCHAR AS created_at, count(*) AS events, round(avg(value), 4) AS mean_value FROM events GROUP BY 1),
    p AS (SELECT *, row_number() OVER (ORDER BY created_at) AS nth, count(*) OVER () AS of_ FROM d),
    q AS (SELECT CASE WHEN nth <= of_ // 3 THEN 'early' WHEN nth > of_ - of_ // 3 THEN 'recent' END AS part, events::DOUBLE AS events, mean_value FROM p WHERE of_ >= 3),
    u AS (SELECT part, 'events' AS metric, events AS v FROM q UNION ALL SELECT part, 'mean_value', mean_value FROM q)
    SELECT metric, round(avg(v) FILTER (part = 'early'), 4) AS early, round(avg(v) FILTER (part = 'recent'), 4) AS recent, round(round(avg(v) FILTER (part = 'recent'), 4) - round(avg(v) FILTER (part = 'early'), 4), 4) AS delta FROM u GROUP BY metric"""
)
def session_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reporting import session_trend as trend

    days = adapters.table(spark, sf_dir, "events").groupBy(F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd").alias("created_at")).agg(F.count("*").cast("double").alias("events"), F.round(F.avg("value"), 4).alias("mean_value"))
    return trend(days, ["events", "mean_value"])


#: Event ids that a clip spans, and so the most rows that it has.
CLIP_IDS = 4_000


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up detections from events: a clip per user of 20 and CLIP_IDS event ids, two faces a frame, integer
    arithmetic on ids. More events or a hot user make more clips, not larger ones."""
    part = lambda k, n: F.pmod(F.col("id") * k, F.lit(n)) / F.lit(float(n))
    base = adapters.table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / CLIP_IDS) * 20 + F.pmod("user_id", F.lit(20))).cast("long").alias("clip"), F.col("event_id").alias("id"))
    nth = F.row_number().over(Window.partitionBy("clip").orderBy("id")) - 1
    row = base.withColumn("k", nth).withColumns({"t": F.floor(F.col("k") / 2).cast("int"), "face": F.pmod("k", F.lit(2)).cast("int")})
    return row.select("clip", "t", "face", (0.3 + 0.4 * F.col("face") + part(7, 50) * 0.1).alias("x"), (0.4 + part(11, 50) * 0.1).alias("y"), (0.1 + part(3, 20) * 0.1).alias("w"), (0.2 + part(5, 20) * 0.1).alias("h"), part(13, 100).alias("speaking"), part(17, 100).alias("listening"), part(19, 100).alias("motion"))


#: The same detections in SQL; and their tracks, walked face by face with a list of live tracks. Scenes are cut every 17 frames.
DETECTED = """fk AS (SELECT event_id // 4000 * 20 + user_id % 20 AS clip, event_id AS id, row_number() OVER (PARTITION BY event_id // 4000 * 20 + user_id % 20 ORDER BY event_id) - 1 AS k FROM events),
    fc AS (SELECT clip, k, k // 2 AS t, k % 2 AS face, 0.3::DOUBLE + 0.4::DOUBLE * (k % 2) + (id * 7 % 50) / 50.0::DOUBLE * 0.1::DOUBLE AS x, 0.4::DOUBLE + (id * 11 % 50) / 50.0::DOUBLE * 0.1::DOUBLE AS y, 0.1::DOUBLE + (id * 3 % 20) / 20.0::DOUBLE * 0.1::DOUBLE AS w,
      0.2::DOUBLE + (id * 5 % 20) / 20.0::DOUBLE * 0.1::DOUBLE AS h, (id * 13 % 100) / 100.0::DOUBLE AS speaking, (id * 17 % 100) / 100.0::DOUBLE AS listening, (id * 19 % 100) / 100.0::DOUBLE AS motion FROM fk)"""


def tracked_sql(reach: float, memory: int) -> str:
    return f"""{DETECTED},
    tw AS (SELECT clip, -1::BIGINT AS k, -1::BIGINT AS t, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, a DOUBLE, missed BIGINT, used BOOLEAN)[] AS tr, 1::BIGINT AS nxt, 0::BIGINT AS track FROM (SELECT DISTINCT clip FROM fc)
      UNION ALL SELECT clip, k, t, CASE WHEN hit IS NULL THEN list_append(live, {{'id': nxt, 'x': x, 'y': y, 'a': w * h, 'missed': 0::BIGINT, 'used': true}}) ELSE list_transform(live, lambda v: CASE WHEN v.id = hit THEN {{'id': v.id, 'x': x, 'y': y, 'a': w * h, 'missed': 0::BIGINT, 'used': true}} ELSE v END) END,
        CASE WHEN hit IS NULL THEN nxt + 1 ELSE nxt END, coalesce(hit, nxt)
      FROM (SELECT *, CASE WHEN near.g <= {reach}::DOUBLE THEN near.id END AS hit
        FROM (SELECT *, list_min(list_transform(list_filter(live, lambda v: NOT v.used), lambda v: {{'g': sqrt((x - v.x) * (x - v.x) + (y - v.y) * (y - v.y)) + abs(w * h - v.a) * 0.35::DOUBLE, 'id': v.id}})) AS near
          FROM (SELECT fc.*, tw.nxt, CASE WHEN fc.t = tw.t THEN tr ELSE list_transform(list_filter(list_transform(tr, lambda v: {{'id': v.id, 'x': v.x, 'y': v.y, 'a': v.a, 'missed': CASE WHEN v.used THEN 0 ELSE v.missed + 1 END, 'used': false}}), lambda v: v.missed <= {memory}),
              lambda v: {{'id': v.id, 'x': v.x, 'y': v.y, 'a': v.a, 'missed': CASE WHEN fc.t % 17 = 0 THEN least(3, v.missed + 1) ELSE v.missed END, 'used': false}}) END AS live
            FROM tw JOIN fc ON fc.clip = tw.clip AND fc.k = tw.k + 1) a) b) c),
    tk AS (SELECT fc.*, tw.track FROM fc JOIN tw USING (clip, k))"""


TRACKS = tracked_sql(0.06, 1)


def tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tracks of the detections, near and short-lived ones so that there are many, and the cuts of scenes."""
    found = faces(spark, sf_dir)
    cuts = found.where("t % 17 = 0").select("clip", "t").distinct()
    return framing.assign_tracks(found, 0.06, 1, cuts), cuts


@query(f"WITH RECURSIVE {TRACKS} SELECT clip, t, face, track FROM tk")
def face_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir)[0].select("clip", "t", "face", "track")


PRIORITY = "speaking * 1.05::DOUBLE + motion * 0.42::DOUBLE + listening * 0.20::DOUBLE + w * h * 0.36::DOUBLE"


@query(
    f"""WITH RECURSIVE {TRACKS}, pf AS (SELECT clip, t, arg_max({{'track': track, 'p': p, 's': speaking, 'm': motion}}, (p, -face)) AS best, list({{'track': track, 'p': p, 's': speaking, 'm': motion}}) AS every FROM (SELECT *, {PRIORITY} AS p FROM tk) GROUP BY clip, t),
    pw AS (SELECT clip, -1::BIGINT AS t, NULL::BIGINT AS track FROM (SELECT DISTINCT clip FROM tk)
      UNION ALL SELECT clip, t, CASE WHEN old IS NULL OR best.s - old.s >= 0.04::DOUBLE OR best.m - old.m >= 0.05::DOUBLE OR best.p >= old.p + 0.10::DOUBLE THEN best.track ELSE old.track END
      FROM (SELECT pf.*, list_filter(every, lambda o: o.track = pw.track)[1] AS old FROM pw JOIN pf ON pf.clip = pw.clip AND pf.t = pw.t + 1))
    SELECT * FROM pw WHERE t >= 0"""
)
def primary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.primary_faces(tracks(spark, sf_dir)[0])


@query(
    f"""WITH RECURSIVE {TRACKS}, rk AS (SELECT clip, track, t, speaking, row_number() OVER (PARTITION BY clip, track ORDER BY t) AS n, t // 17 - coalesce(lag(t) OVER (PARTITION BY clip, track ORDER BY t) // 17, 0) AS cuts FROM tk),
    rw AS (SELECT clip, track, t, n, least(1.0, greatest(0.0, speaking))::DOUBLE AS s FROM rk WHERE n = 1
      UNION ALL SELECT rk.clip, rk.track, rk.t, rk.n, least(1.0, greatest(0.0, 0.9::DOUBLE * pow(0.72::DOUBLE, cuts) * s + speaking * 0.3::DOUBLE))::DOUBLE FROM rw JOIN rk ON rk.clip = rw.clip AND rk.track = rw.track AND rk.n = rw.n + 1)
    SELECT clip, t, track, round(round(s, 6)::DECIMAL(18, 9), 4)::DOUBLE AS score FROM rw WHERE n > 1"""
)
def remembered_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that fade at cuts, with a large share, so that they are seen; later sights of each track."""
    found, cuts = tracks(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("clip", "track").orderBy("t"))
    found = found.withColumn("n", nth).withColumn("speaking", F.when(F.col("n") == 1, F.col("speaking")).otherwise(F.col("speaking") * 0.3))
    scores = framing.remembered(found, cuts, share=0.9).join(found.select("clip", "t", "track", "n"), ["clip", "t", "track"])
    return scores.where("n > 1").select("clip", "t", "track", F.round("score", 4).alias("score"))


ANCHORS = """ac AS (SELECT clip, round(sum(x * greatest(0.05, w * h)) / sum(greatest(0.05, w * h)), 4) AS x, round(sum(y * greatest(0.05, w * h)) / sum(greatest(0.05, w * h)), 4) AS y FROM tk GROUP BY clip),
    am AS (SELECT clip, track, sum(greatest(0.02, speaking * 0.55::DOUBLE + listening * 0.20::DOUBLE + w * h)) AS mass FROM tk GROUP BY ALL),
    an AS (SELECT clip, x, y, track FROM ac JOIN (SELECT clip, arg_max(track, (round(mass, 6), -track)) AS track FROM am GROUP BY clip) USING (clip))"""


@query(f"WITH RECURSIVE {TRACKS}, {ANCHORS} SELECT * FROM an")
def face_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.anchors(tracks(spark, sf_dir)[0])


@query(
    f"""WITH RECURSIVE {TRACKS}, {ANCHORS}, tb AS (SELECT clip, t // 5 AS win, track, arg_max({{'rank': speaking * 1.15::DOUBLE + listening * 0.35::DOUBLE + w * h * 0.55::DOUBLE, 'o': -track, 'x': x, 'y': y, 'area': w * h, 'speaking': speaking}}, (w * h, -t, -face)) AS b FROM tk GROUP BY ALL),
    tr AS (SELECT clip, win, list_sort(list(b), 'DESC') AS r FROM tb GROUP BY ALL),
    ts AS (SELECT tr.*, r[1] AS one, r[2] AS two, list_filter(r, lambda f: f.o = -an.track)[1] AS own FROM tr JOIN an USING (clip)),
    tp AS (SELECT *, two IS NOT NULL AND abs(one.x - two.x) >= 0.14::DOUBLE AND least(one.area, two.area) >= greatest(one.area, two.area) * 0.35::DOUBLE AND abs(one.speaking - two.speaking) <= 0.12::DOUBLE AS pair,
      CASE WHEN own IS NOT NULL AND NOT (one.speaking >= own.speaking + 0.14::DOUBLE OR one.rank >= own.rank + 0.12::DOUBLE) THEN own ELSE one END AS pick FROM ts)
    SELECT clip, win AS "window", CASE WHEN pair THEN 'pair' WHEN pick.o = one.o THEN 'best' ELSE 'dominant' END AS kind, CASE WHEN pair THEN -1 ELSE -pick.o END AS track, round(CASE WHEN pair THEN (one.x + two.x) / 2.0 ELSE pick.x END, 4) AS x, round(CASE WHEN pair THEN (one.y + two.y) / 2.0 ELSE pick.y END, 4) AS y FROM tp"""
)
def window_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.window_targets(tracks(spark, sf_dir)[0], 5).fillna(-1, ["track"])


CENTERS = f"""wb AS (SELECT clip, t // 5 AS win, track, arg_max({{'x': x, 'y': y, 'p': p}}, (p, -t, -face)) AS b FROM (SELECT *, {PRIORITY} AS p FROM tk) GROUP BY ALL),
    wr AS (SELECT clip, win, list_sort(list({{'p': b.p, 'o': -track, 'x': b.x, 'y': b.y}}), 'DESC') AS r FROM wb GROUP BY ALL),
    wc AS (SELECT clip, win, -r[1].o AS track, round(CASE WHEN len(r) > 1 AND abs(r[1].x - r[2].x) >= 0.18::DOUBLE AND r[1].p - r[2].p <= 0.35::DOUBLE * r[1].p THEN (r[1].x + r[2].x) / 2 ELSE r[1].x END, 4) AS x FROM wr),
    wn AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY win) AS k, count(*) OVER (PARTITION BY clip) AS of_ FROM wc),
    lw AS (SELECT clip, win, k, track AS locked, NULL::BIGINT AS waiting, 0 AS n, x AS pos, 'start' AS state FROM wn WHERE k = 1
      UNION ALL SELECT clip, win, k, held, CASE WHEN track = held THEN NULL ELSE track END, CASE WHEN track = held THEN 0 ELSE m END, pos + greatest(-0.12::DOUBLE, least(0.12::DOUBLE, CASE WHEN track = held THEN x ELSE pos END - pos)), CASE WHEN track = locked THEN 'keep' WHEN m >= 2 THEN 'switch' ELSE 'pend' END
      FROM (SELECT *, CASE WHEN track <> locked AND m >= 2 THEN track ELSE locked END AS held FROM (SELECT wn.*, l.locked, l.pos, CASE WHEN wn.track = l.locked THEN 0 WHEN wn.track = l.waiting THEN l.n + 1 ELSE 1 END AS m FROM lw l JOIN wn ON wn.clip = l.clip AND wn.k = l.k + 1))),
    lk AS (SELECT lw.clip, lw.win, lw.k, wn.of_, locked AS track, round(pos, 4) AS x, state FROM lw JOIN wn USING (clip, k))"""


def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.camera_lock(framing.window_centers(tracks(spark, sf_dir)[0], 5))


@query(f'WITH RECURSIVE {TRACKS}, {CENTERS} SELECT clip, win AS "window", track, x, state FROM lk')
def camera_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locked(spark, sf_dir)


@query(
    """WITH b AS (SELECT user_id % 20 AS clip, event_id % 10 <> 0 AS detected, event_id % 3 AS persons, (event_id * 7 % 50) / 50.0 AS x, (event_id * 11 % 50) / 50.0 AS y, 0.1 AS w, (event_id * 3 % 20) / 20.0 AS h FROM events)
    SELECT clip, round(avg(detected::INT), 4) AS face_presence, round(avg((persons > 0)::INT), 4) AS person_presence, round(greatest(avg(detected::INT), avg((persons > 0)::INT) * 0.88), 4) AS subject_presence,
      round(coalesce(avg(w * h) FILTER (detected), 0), 4) AS avg_face_size, round(avg(x), 4) AS avg_center_x, round(avg(y), 4) AS avg_center_y FROM b GROUP BY clip"""
)
def focus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, part = adapters.table(spark, sf_dir, "events"), lambda k, n: F.pmod(F.col("event_id") * k, F.lit(n)) / F.lit(float(n))
    frames = e.select(F.pmod("user_id", F.lit(20)).alias("clip"), (F.pmod("event_id", F.lit(10)) != 0).alias("detected"), F.pmod("event_id", F.lit(3)).alias("persons"), part(7, 50).alias("x"), part(11, 50).alias("y"), F.lit(0.1).alias("w"), part(3, 20).alias("h"))
    return framing.focus_stats(frames)


@query(
    f"""WITH {INTERVALS}, s AS (SELECT DISTINCT source_id, speaker FROM iv), p AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY speaker) - 1 AS nth, least(3, count(*) OVER (PARTITION BY source_id)) AS n FROM s)
    SELECT source_id, speaker, CASE WHEN n = 1 OR nth >= 3 THEN 480 ELSE nth * (1920 // n) END AS x, 0::BIGINT AS y,
      CASE WHEN n = 1 OR nth >= 3 THEN 960 ELSE least(greatest(1920 // n, 640), 1920 - nth * (1920 // n)) END AS w, 1080::BIGINT AS h FROM p"""
)
def speaker_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spans(spark, sf_dir).where(~packaging.is_generic_speaker(F.col("speaker"))).select("source_id", "speaker")
    return framing.speaker_zones(named, 1920, 1080)


@query(
    f"""WITH {INTERVALS}, c AS (SELECT source_id, count(*) AS windows, count(*) FILTER (speaker = 'click') AS dialogue, count(*) FILTER (speaker = 'error') AS fallback, count(*) FILTER (speaker = 'view') AS switches, count(*) FILTER (id % 3 = 0) / count(*) AS centered,
      bool_or(id % 50 = 0) AS used, bool_or(id % 70 = 0) AS preserved FROM iv GROUP BY source_id), r AS (SELECT *, least(1.0, switches / greatest(1, windows - 1)) AS rate FROM c)
    SELECT source_id, round(greatest(0.0, least(1.0, centered * 0.24::DOUBLE + least(1.0, dialogue / windows) * 0.24::DOUBLE + least(1.0, fallback / windows) * 0.16::DOUBLE + ((1.0 - least(1.0, abs(rate - 0.32::DOUBLE) / 0.32::DOUBLE)) * 0.24::DOUBLE + least(1.0, rate * 1.2::DOUBLE) * 0.12::DOUBLE)
      - least(1.0, CASE WHEN used THEN 0.42::DOUBLE ELSE 0.0 END + CASE WHEN preserved THEN 0.24::DOUBLE ELSE 0.0 END + (1.0 - centered) * 0.32::DOUBLE) * 0.22::DOUBLE)), 4) AS score FROM r"""
)
def visual_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n: F.bool_or(F.pmod("id", F.lit(n)) == 0)
    of = lambda kind: F.count_if(F.col("speaker") == kind)
    c = spans(spark, sf_dir).groupBy("source_id").agg(
        F.count("*").alias("windows"), of("click").alias("dialogue"), of("error").alias("fallback"), of("view").alias("switches"), (F.count_if(F.pmod("id", F.lit(3)) == 0) / F.count("*")).alias("centered"), some(50).alias("used"), some(70).alias("preserved")
    )
    return c.select("source_id", framing.visual_conversation(*(F.col(x) for x in ("switches", "windows", "centered", "dialogue", "fallback", "used", "preserved"))).alias("score"))


@query(
    f"""WITH {INTERVALS}, l AS (SELECT source_id, id, start_ms, CASE WHEN speaker = 'click' THEN score END AS s, CASE WHEN speaker = 'view' THEN score + 1000 END AS e FROM iv WHERE speaker IN ('click', 'view')),
    n AS (SELECT *, lead(e) OVER (PARTITION BY source_id ORDER BY id) AS nxt FROM l) SELECT source_id, s AS start_s, nxt AS end_s FROM n WHERE s IS NOT NULL AND nxt IS NOT NULL"""
)
def silence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("speaker") == "click", F.concat(F.lit("[d] silence_start: "), F.col("score").cast("string"))).when(F.col("speaker") == "view", F.concat(F.lit("[d] silence_end: "), (F.col("score") + 1000).cast("string"), F.lit(" | silence_duration: 1")))
    return files.silence_log(spans(spark, sf_dir).select("source_id", F.col("id").alias("nth"), line.alias("line")).where("line is not null"))


@query(
    f"""WITH RECURSIVE {TRACKS}, {CENTERS}, gw AS (SELECT clip, win, k, track, state, x, NULL::DOUBLE AS from_ FROM lk WHERE k = 1
      UNION ALL SELECT clip, win, k, track, state, CASE WHEN turned THEN prior * (1 - share) + base * share ELSE base END, CASE WHEN turned AND k < of_ THEN prior END
      FROM (SELECT l.*, g.x AS prior, l.track <> g.track AS turned, CASE WHEN l.k < l.of_ THEN 1.0::DOUBLE / 3 ELSE 0.5::DOUBLE END AS share, CASE WHEN g.from_ IS NULL THEN l.x ELSE g.from_ * (1 - 2.0::DOUBLE / 3) + l.x * (2.0::DOUBLE / 3) END AS base
        FROM gw g JOIN lk l ON l.clip = g.clip AND l.k = g.k + 1))
    SELECT clip, win AS "window", track, round(round(x, 6), 4) AS x, state FROM gw"""
)
def camera_glide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.glide(locked(spark, sf_dir)).withColumn("x", F.round("x", 4))


@query(
    f"""WITH RECURSIVE {TRACKS}, {CENTERS}, mw AS (SELECT clip, k, win, track, state, x, 1 AS n, 1 AS part FROM lk WHERE k = 1
      UNION ALL SELECT clip, k, win, track, state, CASE WHEN j THEN (mx * n + x) / (n + 1) ELSE x END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN part ELSE part + 1 END
      FROM (SELECT l.*, m.x AS mx, m.n, m.part, l.win = m.win + 1 AND l.track = m.track AND l.state = m.state AND abs(l.x - m.x) <= 0.02::DOUBLE AS j FROM mw m JOIN lk l ON l.clip = m.clip AND l.k = m.k + 1))
    SELECT clip, min(win) AS first, max(win) AS last, any_value(track) AS track, round(round(arg_max(x, k), 6), 3) AS x FROM mw GROUP BY clip, part"""
)
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.merged_windows(locked(spark, sf_dir)).withColumn("x", F.round("x", 3))


@query(
    f"""WITH {MERGED}, s AS (SELECT source_id, unnest(range(start_ms, greatest(start_ms, end_ms - 600001) + 1, 1200000)) AS start_ms, end_ms FROM merged WHERE end_ms - start_ms >= 1200000)
    SELECT source_id, start_ms, least(end_ms, start_ms + 1800000) AS end_ms FROM s WHERE end_ms > start_ms"""
)
def scene_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import signals

    return signals.scene_windows(iv.merge_intervals(spans(spark, sf_dir), 60_000), 1_200_000, 1_800_000, 600_000)


@query(
    """WITH e AS (SELECT user_id AS source_id, event_id AS id, event_id % 4 AS visible_faces, event_id % 3 AS recent_face_memory_count, (event_id * 7 % 50) / 50.0::DOUBLE AS lock_confidence, event_id % 5 AS top_tracks, CASE WHEN event_id % 6 > 0 THEN event_id % 2 END AS visible_persons FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY visible_faces DESC, recent_face_memory_count DESC, lock_confidence DESC, top_tracks DESC, coalesce(visible_persons, 0) DESC, id) AS k FROM e) SELECT source_id, id, visible_faces, lock_confidence FROM r WHERE k = 1"""
)
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of the largest evidence of each source."""
    e = F.col("event_id")
    windows = adapters.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), e.alias("id"), F.pmod(e, F.lit(4)).alias("visible_faces"), F.pmod(e, F.lit(3)).alias("recent_face_memory_count"), (F.pmod(e * 7, F.lit(50)) / 50.0).alias("lock_confidence"), F.pmod(e, F.lit(5)).alias("top_tracks"),
        F.when(F.pmod(e, F.lit(6)) > 0, F.pmod(e, F.lit(2))).alias("visible_persons"),
    )
    return framing.best_evidence(windows, ["source_id"], "id").select("source_id", "id", "visible_faces", "lock_confidence")


@query(
    f"""WITH {MERGED}, g AS (SELECT source_id, lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms) AS start_ms, start_ms AS end_ms FROM merged), h AS (SELECT * FROM g WHERE end_ms > start_ms),
    e AS (SELECT h.source_id, h.start_ms, h.end_ms, sqrt(avg(p.score * p.score)) / 100.0 AS energy FROM h JOIN iv p ON h.source_id = p.source_id AND h.end_ms > h.start_ms + 100 AND (p.start_ms + p.end_ms) // 2 + 3600000 >= h.start_ms AND (p.start_ms + p.end_ms) // 2 + 3600000 < h.end_ms GROUP BY ALL)
    SELECT h.source_id, h.start_ms, h.end_ms, round(coalesce(energy, 0.0), 6) AS energy FROM h LEFT JOIN e USING (source_id, start_ms, end_ms)"""
)
def pause_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of the gaps between voiced intervals, from samples an hour after the middle of each event."""
    every = spans(spark, sf_dir)
    order = Window.partitionBy("source_id").orderBy("start_ms")
    gaps = iv.merge_intervals(every, 60_000).select("source_id", F.lag("end_ms").over(order).alias("start_ms"), F.col("start_ms").alias("end_ms")).where("end_ms > start_ms")
    samples = every.select("source_id", (F.floor((F.col("start_ms") + F.col("end_ms")) / 2) + HOUR).alias("at_ms"), F.col("score").alias("value"))
    return pauses.pause_energy(gaps, samples, 24 * HOUR, 100.0).withColumn("energy", F.round("energy", 6))


@query(
    """WITH b AS (SELECT event_id, (event_id * 7 % 50) / 50.0::DOUBLE AS x, (event_id * 11 % 50) / 50.0::DOUBLE AS y, greatest(0.05::DOUBLE, (event_id * 3 % 40) / 40.0::DOUBLE) AS w, greatest(0.05::DOUBLE, (event_id * 13 % 30) / 30.0::DOUBLE) AS h FROM events)
    SELECT event_id AS id, round(greatest(0.0, least(1.0 - w, x - w / 2)), 4) AS x, round(greatest(0.0, least(1.0 - h, y - h / 2)), 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM b"""
)
def safe_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k, n: F.pmod(F.col("event_id") * k, F.lit(n)) / F.lit(float(n))
    box = framing.safe_box(part(7, 50), part(11, 50), part(3, 40), part(13, 30))
    return adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), box.alias("b")).select("id", "b.*")


