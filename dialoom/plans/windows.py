"""Queries over candidate windows, keep lists and remapped words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..operators import intervals as iv, windows
from ..sources import adapters
from .intervals import CUTS, HOUR, MERGED, spans
from .registry import INTERVALS, SEGMENTS, query, squeezed


def chained(rows: str, gap: int, most: int, longest: int) -> str:
    """SQL of chains of a table of windows, by walking each source."""
    return f"""wn AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, id) AS k FROM {rows}),
    walk AS (SELECT source_id, k, start_ms AS first_, end_ms AS last_, end_ms AS prev, 1 AS n, 1 AS chain, id FROM wn WHERE k = 1
      UNION ALL SELECT w.source_id, w.k, CASE WHEN j THEN first_ ELSE start_ms END, CASE WHEN j THEN greatest(last_, end_ms) ELSE end_ms END, end_ms, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN chain ELSE chain + 1 END, w.id
      FROM (SELECT wn.*, walk.first_, walk.last_, walk.n, walk.chain, wn.start_ms - walk.prev <= {gap} AND walk.n < {most} AND greatest(walk.last_, wn.end_ms) - walk.first_ <= {longest} AS j FROM walk JOIN wn ON wn.source_id = walk.source_id AND wn.k = walk.k + 1) w),
    chains AS (SELECT source_id, min(first_) AS start_ms, max(last_) AS end_ms, count(*) AS n, list(id ORDER BY k) AS ids FROM walk GROUP BY source_id, chain)"""


@query(f"WITH RECURSIVE {INTERVALS}, {chained('iv', 40 * HOUR, 4, 60 * HOUR)} SELECT source_id, start_ms, end_ms, n, array_to_string(ids, ' ') AS ids FROM chains")
def stitched_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = windows.stitched(spans(spark, sf_dir), 40 * HOUR, 4, 60 * HOUR)
    return chains.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), " "))


@query(
    f"""WITH RECURSIVE {INTERVALS}, fit AS (SELECT * FROM (SELECT *, id % 97 / 97.0::DOUBLE AS speech, id % 89 / 89.0::DOUBLE AS face FROM iv) WHERE speech >= 0.14 AND face >= 0.10), {chained("fit", 40 * HOUR, 4, 60 * HOUR)},
    scored AS (SELECT c.source_id, c.start_ms, c.end_ms, c.n, c.ids, round(avg(fit.score), 4) AS score FROM (SELECT *, unnest(ids) AS id FROM chains) c JOIN fit USING (source_id, id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, start_ms, end_ms) AS nth FROM scored)
    SELECT source_id, start_ms, end_ms, n, score FROM r WHERE nth <= 5"""
)
def review_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of the events that speak and show faces enough, by made-up shares; the five best of each user."""
    share = lambda k: F.pmod("id", F.lit(k)) / F.lit(float(k))
    rows = spans(spark, sf_dir).withColumns({"speech_density": share(97), "face_presence": share(89)})
    return windows.review_pass(rows, True, most=5, gap_ms=40 * HOUR, longest_ms=60 * HOUR).drop("ids")


GROWN = f"""{SEGMENTS}, tn AS (SELECT source_id, seg_idx AS turn_id, start_ms, end_ms FROM seg),
    rn AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY turn_id) AS run FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY source_id ORDER BY turn_id) <= 3500 THEN 0 ELSE 1 END AS new FROM tn))"""


@query(
    f"""WITH {GROWN}, g AS (SELECT a.source_id, a.turn_id, a.start_ms, min(b.end_ms) FILTER (b.end_ms >= a.start_ms + 17500) AS first_ms, max(b.end_ms) FILTER (b.end_ms <= a.start_ms + 60000) AS last_ms,
      count(*) FILTER (b.end_ms <= a.start_ms + 60000) AS n_turns, coalesce(sum(b.end_ms - b.start_ms) FILTER (b.end_ms <= a.start_ms + 60000), 0)::BIGINT AS speech_ms
      FROM rn a JOIN rn b ON a.source_id = b.source_id AND a.run = b.run AND b.turn_id >= a.turn_id GROUP BY ALL)
    SELECT *, round(speech_ms / (last_ms - start_ms), 4) AS density FROM g WHERE first_ms <= last_ms"""
)
def grown_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = adapters.segments(spark, sf_dir).withColumnRenamed("seg_idx", "turn_id")
    return windows.grown_windows(turns)


@query(
    f"""WITH RECURSIVE {GROWN}, own AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY turn_id) AS k FROM rn),
    walk AS (SELECT source_id, k, run, start_ms AS first_, end_ms AS last_, 1 AS w FROM own WHERE k = 1
      UNION ALL SELECT o.source_id, o.k, o.run, CASE WHEN j THEN first_ ELSE start_ms END, end_ms, CASE WHEN j THEN w ELSE w + 1 END
      FROM (SELECT own.*, walk.first_, walk.w, own.run = walk.run AND own.end_ms - walk.first_ <= 60000 AS j FROM walk JOIN own ON own.source_id = walk.source_id AND own.k = walk.k + 1) o),
    f AS (SELECT w.source_id, min(first_) AS s0, max(last_) AS e0, count(*) AS n_turns, sum(end_ms - start_ms)::BIGINT AS speech_ms FROM walk w JOIN own USING (source_id, k) GROUP BY w.source_id, w),
    b AS (SELECT source_id, min(start_ms) - 2000 AS from_ms, max(end_ms) + 2000 AS to_ms FROM tn GROUP BY source_id),
    p AS (SELECT *, greatest(from_ms, s0 - 350) AS s, least(to_ms, e0 + 650) AS e FROM f JOIN b USING (source_id) WHERE e0 - s0 <= 60000),
    q AS (SELECT *, CASE WHEN e - s < 35000 THEN least(to_ms, s + 35000) ELSE e END AS e2 FROM p),
    r AS (SELECT *, CASE WHEN e - s < 35000 THEN greatest(from_ms, e2 - 35000) ELSE s END AS s2 FROM q)
    SELECT source_id, s2 AS start_ms, e2 AS end_ms, n_turns, speech_ms, e - s < 35000 AS extended FROM r WHERE e2 - s2 >= 35000"""
)
def linear_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = adapters.segments(spark, sf_dir).withColumnRenamed("seg_idx", "turn_id")
    bounds = turns.groupBy("source_id").agg((F.min("start_ms") - 2000).alias("from_ms"), (F.max("end_ms") + 2000).alias("to_ms"))
    return windows.linear_windows(turns, bounds)


@query(
    f"""WITH {INTERVALS}, g AS (SELECT *, id % 61 / 100.0::DOUBLE AS density, id % 3 AS turns FROM iv)
    SELECT source_id, id, start_ms, end_ms, speaker AS kind, CASE WHEN turns > 0 THEN 'dialogue_cluster' ELSE 'audio_window' END AS story_unit_type FROM g WHERE density >= 0.18 AND end_ms - start_ms >= 35000"""
)
def fallback_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.fallback_window(F.col("start_ms"), F.col("end_ms"), F.pmod("id", F.lit(61)) / 100.0, F.pmod("id", F.lit(3)), F.col("speaker"))
    return spans(spark, sf_dir).select("source_id", "id", made.alias("w")).where("w is not null").select("source_id", "id", "w.*")


WHOLE = f"{CUTS}, whole AS (SELECT source_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM iv GROUP BY source_id)"


@query(
    f"""WITH {WHOLE}, b AS (SELECT source_id, start_ms AS s FROM whole UNION SELECT source_id, end_ms FROM cuts),
    k AS (SELECT b.source_id, s AS start_ms, least((SELECT min(c.start_ms) FROM cuts c WHERE c.source_id = b.source_id AND c.start_ms >= s), w.end_ms) AS end_ms FROM b JOIN whole w USING (source_id))
    SELECT source_id, start_ms, end_ms FROM k WHERE end_ms > start_ms AND NOT EXISTS (SELECT 1 FROM cuts c WHERE c.source_id = k.source_id AND c.start_ms <= k.start_ms AND c.end_ms > k.start_ms)"""
)
def keep_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each user's time when every third merged interval is cut out."""
    every = spans(spark, sf_dir)
    whole = every.groupBy("source_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return iv.keep_list(whole, third_cuts(every), 24 * HOUR)


def third_cuts(every: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms"))
    return iv.merge_intervals(every, 60_000).withColumn("k", nth).where("k % 3 = 0").select("source_id", "start_ms", "end_ms")


@query(
    f"""WITH {INTERVALS}, a AS (SELECT * FROM iv WHERE speaker = 'view'), b AS (SELECT * FROM iv WHERE speaker = 'click'),
    t AS (SELECT source_id, start_ms AS key FROM a UNION SELECT source_id, end_ms FROM a UNION SELECT source_id, start_ms FROM b UNION SELECT source_id, end_ms FROM b),
    p AS (SELECT source_id, key AS s, lead(key) OVER (PARTITION BY source_id ORDER BY key) AS e FROM t),
    m AS (SELECT p.*, EXISTS (SELECT 1 FROM a WHERE a.source_id = p.source_id AND a.start_ms <= s AND a.end_ms > s) AS in_a, EXISTS (SELECT 1 FROM b WHERE b.source_id = p.source_id AND b.start_ms <= s AND b.end_ms > s) AS in_b FROM p WHERE e IS NOT NULL),
    n AS (SELECT *, CASE WHEN in_a = lag(in_a) OVER w AND in_b = lag(in_b) OVER w THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY source_id ORDER BY s)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY s) AS run FROM n)
    SELECT source_id, min(s) AS start_ms, max(e) AS end_ms, in_a, in_b FROM r WHERE in_a OR in_b GROUP BY source_id, run, in_a, in_b"""
)
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that views cover, that clicks cover, and that both do."""
    every = spans(spark, sf_dir)
    return iv.sweep(every.where("speaker = 'view'"), every.where("speaker = 'click'"), 24 * HOUR)


WORDED = f"""{SEGMENTS}, sw AS (SELECT *, string_split({squeezed("text")}, ' ') AS ws FROM seg),
    wd AS (SELECT source_id, seg_idx AS id, i - 1 AS pos, ws[i] AS word, start_ms + 400 + 300 * (i - 1) AS s, start_ms + 400 + 300 * (i - 1) + 250 AS e FROM sw, unnest(range(1, len(ws) + 1)) AS u(i)),
    ct AS (SELECT source_id, start_ms + 1000 AS c0, start_ms + 1000 + 900 * (1 + seg_idx % 2) AS c1 FROM seg WHERE seg_idx % 2 = 0),
    nw AS (SELECT wd.source_id, id, pos, word, s - coalesce(sum(greatest(0, least(s, c1) - c0)), 0)::BIGINT AS s, e - coalesce(sum(greatest(0, least(e, c1) - c0)), 0)::BIGINT AS e FROM wd LEFT JOIN ct USING (source_id) GROUP BY wd.source_id, id, pos, word, s, e),
    ns AS (SELECT seg.source_id, seg_idx AS id, start_ms - coalesce(sum(greatest(0, least(start_ms, c1) - c0)), 0)::BIGINT AS s, end_ms - coalesce(sum(greatest(0, least(end_ms, c1) - c0)), 0)::BIGINT AS e FROM seg LEFT JOIN ct USING (source_id) GROUP BY seg.source_id, seg_idx, start_ms, end_ms)"""


def worded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments with made-up times of their words, and cuts inside every other one."""
    seg = adapters.segments(spark, sf_dir).withColumnRenamed("seg_idx", "id")
    words = F.transform(F.split(squeeze(F.col("text")), " "), lambda w, i: F.struct((F.col("start_ms") + 400 + 300 * i).alias("start_ms"), (F.col("start_ms") + 650 + 300 * i).alias("end_ms"), w.alias("word")))
    cuts = seg.where("id % 2 = 0").select("source_id", (F.col("start_ms") + 1000).alias("start_ms"), (F.col("start_ms") + 1000 + 900 * (1 + F.col("id") % 2)).alias("end_ms"))
    return seg.withColumn("words", words), cuts


@query(f"WITH {WORDED} SELECT nw.source_id, nw.id, ns.s AS start_ms, ns.e AS end_ms, word, nw.s AS word_start_ms, nw.e AS word_end_ms FROM nw JOIN ns USING (source_id, id) WHERE nw.e > nw.s AND ns.e > ns.s")
def remapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = iv.remap_words(*worded(spark, sf_dir))
    return moved.select("source_id", "id", "start_ms", "end_ms", F.explode("words").alias("w")).select("source_id", "id", "start_ms", "end_ms", "w.word", F.col("w.start_ms").alias("word_start_ms"), F.col("w.end_ms").alias("word_end_ms"))


@query(
    f"""WITH {WORDED}, j AS (SELECT wd.source_id, wd.id, pos, s + CASE WHEN pos % 7 = 3 THEN -400 ELSE 0 END AS s, e + CASE WHEN pos % 11 = 5 THEN 700 ELSE 0 END AS e FROM wd),
    l AS (SELECT j.*, lag(s) OVER w AS ps, lag(e) OVER w AS pe, seg.start_ms, seg.end_ms FROM j JOIN seg ON seg.source_id = j.source_id AND seg.seg_idx = j.id WINDOW w AS (PARTITION BY j.source_id, j.id ORDER BY pos)),
    c AS (SELECT source_id, id, 'word_order' AS problem, count(*) FILTER (s < ps) AS n FROM l GROUP BY ALL UNION ALL SELECT source_id, id, 'word_overlap', count(*) FILTER (s < pe) FROM l GROUP BY ALL UNION ALL SELECT source_id, id, 'word_outside', count(*) FILTER (s < start_ms OR e > end_ms) FROM l GROUP BY ALL)
    SELECT * FROM c WHERE n > 0"""
)
def word_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of words some of which are moved before or behind their places."""
    rows, _ = worded(spark, sf_dir)
    spoilt = F.transform("words", lambda w, i: F.struct((w["start_ms"] + F.when(i % 7 == 3, -400).otherwise(0)).alias("start_ms"), (w["end_ms"] + F.when(i % 11 == 5, 700).otherwise(0)).alias("end_ms"), w["word"].alias("word")))
    return iv.integrity(rows.withColumn("words", spoilt))


@query(
    f"""WITH {SEGMENTS}, o AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY start_ms) AS run FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms) <= 1000 THEN 0 ELSE 1 END AS new FROM seg)),
    b AS (SELECT source_id, run, min(start_ms) AS s, max(end_ms) AS e FROM o GROUP BY ALL),
    t AS (SELECT source_id, count(*) AS blocks, max(e) - min(s) AS whole, sum(e - s)::BIGINT AS kept FROM b GROUP BY source_id)
    SELECT source_id, blocks > 1 AS changed, CASE WHEN blocks > 1 THEN whole - kept ELSE 0 END AS removed_ms, CASE WHEN blocks > 1 THEN kept ELSE whole END AS length_ms FROM t"""
)
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = worded(spark, sf_dir)
    out = iv.compacted(rows, 1_000)
    return out.groupBy("source_id").agg(F.first("changed").alias("changed"), F.first("removed_ms").alias("removed_ms"), (F.max("end_ms") - F.min("start_ms")).alias("length_ms"))
