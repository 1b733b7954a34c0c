"""Queries through the SQL functions, and over metadata of several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons, sql
from ..operators import turns
from ..sources import adapters, files, metadata
from .intervals import HOUR, TOTALS
from .registry import INTERVALS, SEGMENTS, TURN_TYPE, TURNS, query, score, squeezed

STAMP = "lpad((x // 3600000)::VARCHAR, 2, '0') || ':' || lpad((x // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((x // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((x % 1000)::VARCHAR, 3, '0')"


@query(
    f"""WITH {TURNS} SELECT source_id, turn_id, {TURN_TYPE} AS turn_type, len(string_split({squeezed("text")}, ' ')) AS words, {STAMP.replace("x", "start_ms")} AS at_, round({score("text", lexicons.HOOK)}, 6) AS hook FROM turns"""
)
def sql_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    turns.dialogue_turns(adapters.segments(spark, sf_dir)).createOrReplaceTempView("dl_turns")
    return spark.sql("SELECT source_id, turn_id, dl_turn_type(text) AS turn_type, dl_word_count(text) AS words, dl_timestamp(start_ms) AS at_, round(dl_hook_score(text), 6) AS hook FROM dl_turns")


@query(
    f"""WITH {INTERVALS}, o AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS new FROM iv WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY start_ms, id)::BIGINT AS run FROM o)
    SELECT source_id, run, any_value(speaker) AS key, arg_min(start_ms, (start_ms, id)) AS start_ms, arg_max(end_ms, (start_ms, id)) AS end_ms, count(*) AS n FROM i GROUP BY source_id, run"""
)
def sql_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    adapters.intervals(spark, sf_dir).withColumnRenamed("speaker", "key").createOrReplaceTempView("dl_spans")
    return spark.sql("SELECT * FROM dl_runs(TABLE(dl_spans) PARTITION BY source_id ORDER BY (start_ms, id))")


@query(
    f"""WITH {TOTALS} SELECT source_id, g.start_ms AS start_ms, least(total_ms, g.start_ms + {24 * HOUR}) AS end_ms
    FROM (SELECT source_id, total_ms, unnest(range(0, total_ms, {12 * HOUR})) AS start_ms FROM t WHERE total_ms > 0) g"""
)
def sql_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    adapters.intervals(spark, sf_dir).groupBy("source_id").agg((F.max("end_ms") - F.min("start_ms")).alias("total_ms")).createOrReplaceTempView("dl_totals")
    return spark.sql(f"SELECT source_id, g.start_ms, g.end_ms FROM dl_totals, LATERAL dl_grid(total_ms, {24 * HOUR}L, {12 * HOUR}L) g")


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, kind, text): made-up metadata of documents in three shapes, and some that is no JSON."""
    docs, d = adapters.table(spark, sf_dir, "documents"), F.col("doc_id")
    value, lang = F.pmod(d * 37, F.lit(101)), F.col("lang")
    shapes = [
        F.to_json(F.struct(F.struct(value.alias("score"), lang.alias("mood")).alias("summary"), F.array(lang, F.lit("x")).alias("tags"))),
        F.to_json(F.struct((value / 2.0).alias("score"), d.alias("id"))),
        F.to_json(F.struct(F.struct(F.struct(value.cast("string").alias("score")).alias("story")).alias("meta"))),
        F.concat(F.lit('{"score": '), lang),
    ]
    kind = F.pmod(d, F.lit(4)).cast("int")
    return docs.select(F.col("doc_id").alias("id"), kind.alias("kind"), F.element_at(F.array(*shapes), kind + 1).alias("text"))


@query(
    """WITH s AS (SELECT doc_id AS id, doc_id % 4 AS kind, doc_id * 37 % 101 AS v, lang FROM documents)
    SELECT id, CASE kind WHEN 0 THEN v::DOUBLE WHEN 1 THEN v / 2.0 WHEN 2 THEN v::DOUBLE ELSE -1.0 END AS score, CASE WHEN kind = 0 THEN lang ELSE 'none' END AS mood, CASE WHEN kind = 0 THEN 2 ELSE 0 END AS tags FROM s"""
)
def variant_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = metadata.parsed(F.col("text"))
    found = metadata.first_of(F.col("v"), ["$.summary.score", "$.score", "$.meta.story.score"], default=-1.0)
    tags = F.coalesce(F.size(F.try_variant_get("v", "$.tags", "array<string>")), F.lit(0))
    return shaped(spark, sf_dir).withColumn("v", value).select("id", found.alias("score"), metadata.first_of(F.col("v"), ["$.summary.mood"], "string", "none").alias("mood"), tags.alias("tags"))


@query(
    """SELECT * FROM (VALUES (0, 'OBJECT<summary: OBJECT<mood: STRING, score: BIGINT>, tags: ARRAY<STRING>>'), (2, 'OBJECT<meta: OBJECT<story: OBJECT<score: STRING>>>'), (3, 'OBJECT<>')) AS t(kind, shape), (SELECT doc_id % 4 AS kind, count(*) AS n FROM documents GROUP BY 1) AS c WHERE c.kind = t.kind""".replace(
        "SELECT *", "SELECT t.kind, n, shape"
    )
)
def variant_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of each kind of metadata, but for the one whose numbers are whole or not by chance."""
    return metadata.shape(shaped(spark, sf_dir).withColumn("value", metadata.parsed(F.col("text"))), ["kind"]).where("kind <> 1")


@query(
    f"""WITH {SEGMENTS} SELECT source_id::VARCHAR AS stem, CASE WHEN source_id % 5 = 4 THEN 0 ELSE count(*) END AS segments, CASE WHEN source_id % 5 = 4 THEN 0 ELSE round((max(end_ms) - min(start_ms)) / 1000.0, 3) END AS duration,
      0::BIGINT AS overlaps, CASE WHEN source_id % 5 = 4 THEN 0 ELSE count(*) FILTER (trim(coalesce(text, '')) = '') END AS empty, source_id % 5 <> 4 AS readable FROM seg GROUP BY source_id"""
)
def caption_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on captions given as JSON: an object or a bare list, and some that can't be read."""
    row = F.struct("seg_idx", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text")
    each = adapters.segments(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(row)).alias("segments"))
    kind = F.pmod("source_id", F.lit(5))
    text = F.when(kind == 4, F.lit("not json")).when(kind < 2, F.to_json(F.col("segments"))).otherwise(F.to_json(F.struct("segments")))
    return metadata.caption_reports(each.select(F.col("source_id").cast("string").alias("stem"), metadata.parsed(text).alias("value")))


@query(
    f"""WITH {SEGMENTS}, t AS (SELECT source_id, max(end_ms) AS total_ms FROM seg GROUP BY source_id)
    SELECT source_id, g.s AS start_ms, least(total_ms, g.s + 5000) AS end_ms, '...' AS text FROM (SELECT source_id, total_ms, unnest(range(0, total_ms, 5000)) AS s FROM t WHERE total_ms > 0) g"""
)
def placeholder_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.placeholder_cues(adapters.segments(spark, sf_dir).groupBy("source_id").agg(F.max("end_ms").alias("total_ms")))
