"""Queries of what a clip shows, of the order in which clips are taken and of what a story tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons, text, visual
from ..operators import framing, ranking, story, turns
from ..sources import adapters
from .records import times
from .registry import INTERVALS, SEGMENTS, TURNS, listed, query, squeezed


def share(k: int, n: int, column: str = "event_id") -> Column:
    """A made-up share of 0..1 by integer arithmetic on an id."""
    return F.pmod(F.col(column) * k, F.lit(n)) / F.lit(float(n))


def share_sql(k: int, n: int, column: str = "event_id") -> str:
    return f"(({column} * {k}) % {n} / {n}.0::DOUBLE)"


SHARES = {"face": (7, 53), "person": (11, 41), "subject": (13, 47), "face_size": (3, 401), "person_size": (17, 307)}
CAPPED = {"density": (19, 61), "clarity": (23, 71), "energy": (29, 83)}


def named(shares: dict[str, tuple[int, int]]) -> str:
    return ", ".join(f"{share_sql(*v)} AS {k}" for k, v in shares.items())


@query(
    f"""WITH e AS (SELECT event_id AS id, {named(SHARES)} FROM events),
    v AS (SELECT *, least(1.0, face * 0.56::DOUBLE + person * 0.28::DOUBLE + least(1.0, face_size / 0.035::DOUBLE) * 0.10::DOUBLE + least(1.0, person_size / 0.09::DOUBLE) * 0.06::DOUBLE) AS vis FROM e)
    SELECT id, round(least(1.0, face * 0.62::DOUBLE + person * 0.22::DOUBLE + subject * 0.16::DOUBLE), 4) AS face_evidence_score, round(vis, 4) AS visual_subject_score,
      round(greatest(0.0, 1.0 - (subject * 0.9::DOUBLE + vis * 0.45::DOUBLE)), 4) AS empty_frame_risk FROM v"""
)
def visual_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = visual.presence_scores(*(share(*SHARES[k]) for k in SHARES))
    return adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), scores.alias("s")).select("id", "s.*")


@query(
    f"""WITH e AS (SELECT event_id AS id, {named({**SHARES, **CAPPED})}, CASE WHEN event_id % 4 = 0 THEN {share_sql(31, 90)} END AS own FROM events),
    z AS (SELECT *, CASE WHEN id % 3 = 0 THEN 0.0::DOUBLE ELSE face END AS f, CASE WHEN id % 3 = 0 THEN 0.0::DOUBLE ELSE person END AS p, CASE WHEN id % 3 = 0 THEN 0.1::DOUBLE ELSE subject END AS u FROM e),
    a AS (SELECT *, greatest(0.0, least(1.0, f * 0.62::DOUBLE + p * 0.22::DOUBLE + u * 0.16::DOUBLE)) AS ev FROM z),
    b AS (SELECT *, coalesce(own, greatest(0.18::DOUBLE, ev * 0.85::DOUBLE + CASE WHEN density >= 0.24 THEN 0.18::DOUBLE ELSE 0.08::DOUBLE END)) AS vis FROM a),
    c AS (SELECT *, least(1.0, vis * 0.72::DOUBLE + clarity * 0.18::DOUBLE + energy * 0.10::DOUBLE) AS ref FROM b), d AS (SELECT *, greatest(0.0, 1.0 - (vis * 0.75::DOUBLE + ref * 0.35::DOUBLE)) AS risk FROM c)
    SELECT id, round(ev, 4) AS face_evidence_score, round(CASE WHEN ev <= 0.06 THEN least(vis, CASE WHEN density < 0.40 THEN 0.18::DOUBLE ELSE 0.22::DOUBLE END) ELSE vis END, 4) AS visual_subject_score,
      round(CASE WHEN ev <= 0.06 THEN least(ref, 0.24::DOUBLE) ELSE ref END, 4) AS reframe_feasibility_score, round(CASE WHEN ev <= 0.06 THEN greatest(risk, 0.84::DOUBLE) ELSE risk END, 4) AS empty_frame_risk FROM d"""
)
def visual_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    unseen = F.pmod("event_id", F.lit(3)) == 0
    face, person, subject = (F.when(unseen, low).otherwise(share(*SHARES[k])) for k, low in (("face", 0.0), ("person", 0.0), ("subject", 0.1)))
    scores = visual.fallback_scores(face, person, subject, *(share(*CAPPED[k]) for k in CAPPED), given_visual=F.when(F.pmod("event_id", F.lit(4)) == 0, share(31, 90)))
    return adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), scores.alias("s")).select("id", "s.*")


@query(
    f"""WITH c AS (SELECT user_id AS clip, min(event_id) AS s, max(event_id) AS e FROM events GROUP BY 1), p AS (SELECT DISTINCT clip, s + (e - s) * unnest([1, 2, 3]) // 4 AS t FROM c),
    m AS (SELECT user_id AS clip, event_id AS t, {share_sql(7, 50)} AS face, {share_sql(13, 45)} AS subject FROM events WHERE event_id % 3 = 0),
    h AS (SELECT p.clip, p.t, arg_min({{'f': face, 'u': subject}}, (abs(m.t - p.t), m.t)) AS h FROM p LEFT JOIN m ON p.clip = m.clip GROUP BY ALL), g AS (SELECT clip, coalesce(h.f, 0.0) AS face, coalesce(h.u, 0.0) AS subject FROM h)
    SELECT clip, count(*) AS points, round(min(face), 4) AS face_min, round(avg(face), 4) AS face_avg, round(min(subject), 4) AS subject_min, min(face) < 0.08 AND max(face) >= 0.08 AS drifts FROM g GROUP BY clip"""
)
def crop_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.table(spark, sf_dir, "events").withColumn("clip", F.col("user_id"))
    clips = events.groupBy("clip").agg(F.min("event_id").alias("start"), F.max("event_id").alias("end"))
    samples = events.where("event_id % 3 = 0").select("clip", F.col("event_id").alias("t"), share(7, 50).alias("face"), share(13, 45).alias("subject"))
    return framing.crop_probe(clips, samples)


@query(
    f"""WITH {TURNS}, k AS (SELECT source_id, trim(text) AS text, row_number() OVER (PARTITION BY source_id ORDER BY turn_id) AS nth, count(*) OVER (PARTITION BY source_id) AS n FROM turns),
    p AS (SELECT source_id, max(text) FILTER (nth = 1) AS hook, max(text) FILTER (nth = 2) AS setup, max(text) FILTER (nth = 3) AS escalation, max(text) FILTER (nth = n AND n >= 4) AS payoff FROM k GROUP BY source_id)
    SELECT *, coalesce(hook, '') = '' OR coalesce(setup, '') = '' OR coalesce(escalation, '') = '' OR coalesce(payoff, '') = '' AS deficient FROM p"""
)
def told_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story.told_parts(turns.dialogue_turns(adapters.segments(spark, sf_dir)))


@query(
    f"""WITH {INTERVALS}, p AS (SELECT *, CASE WHEN id % 5 > 0 THEN (id * 37) % 1000 / 10.0::DOUBLE END AS preview, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS place FROM iv)
    SELECT source_id, id, score, preview, row_number() OVER (PARTITION BY source_id ORDER BY place <= 8 DESC, CASE WHEN place <= 8 THEN coalesce(preview, score) ELSE score END DESC, id) AS rank FROM p"""
)
def preview_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.intervals(spark, sf_dir).withColumn("preview", F.when(F.pmod("id", F.lit(5)) > 0, F.pmod(F.col("id") * 37, F.lit(1000)) / 10.0))
    return ranking.reranked(rows, ["source_id"], "score", "preview", "id").select("source_id", "id", "score", "preview", "rank")


@query(
    """WITH r AS (SELECT doc_id % 7 AS source_id, lang || '_context' AS reason FROM documents WHERE doc_id % 3 = 0), w AS (SELECT doc_id % 7 AS source_id, CASE WHEN doc_id % 5 = 0 THEN 'other line' WHEN doc_id % 2 = 0 THEN 'Candidate ' || doc_id || ' rejected: ' || source ELSE 'Candidate ' || doc_id || ' downgraded: ' || lang || '_context' END AS text FROM documents WHERE doc_id % 3 = 1),
    t AS (SELECT * FROM r UNION ALL SELECT source_id, regexp_extract(text, '^Candidate (\\d+) (?:rejected|downgraded): (\\S+)', 2) FROM w) SELECT reason, count(*) AS n, count(DISTINCT source_id) AS sources FROM t WHERE reason <> '' GROUP BY reason"""
)
def reject_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.table(spark, sf_dir, "documents").withColumn("source_id", F.pmod("doc_id", F.lit(7)))
    context, name = F.concat("lang", F.lit("_context")), F.concat(F.lit("Candidate "), F.col("doc_id").cast("string"))
    text = F.when(F.pmod("doc_id", F.lit(5)) == 0, "other line").when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(name, F.lit(" rejected: "), "source")).otherwise(F.concat(name, F.lit(" downgraded: "), context))
    return ranking.reject_paths(docs.where("doc_id % 3 = 0").select("source_id", context.alias("reason")), docs.where("doc_id % 3 = 1").select("source_id", text.alias("text")))


@query(
    f"""WITH {SEGMENTS}, c AS (SELECT source_id, seg_idx, greatest(5000, start_ms) AS s, least(90000, end_ms) AS e, CASE WHEN seg_idx % 4 = 3 THEN 'unknown_turn_' || seg_idx WHEN seg_idx % 4 IN (1, 2) THEN 'b' ELSE speaker END AS who, coalesce(text, '') AS text FROM seg),
    i AS (SELECT * FROM c WHERE e > s AND s < 90000), m AS (SELECT *, CASE WHEN who = lag(who) OVER w AND s - lag(e) OVER w < 3000 THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY source_id ORDER BY seg_idx)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY seg_idx)::BIGINT AS turn_no FROM m)
    SELECT source_id, turn_no, arg_min(s, seg_idx) AS start_ms, arg_max(e, seg_idx) AS end_ms, any_value(who) AS speaker, md5(string_agg(text, ' ' ORDER BY seg_idx)) AS text FROM r GROUP BY ALL"""
)
def speaker_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns between the fifth second and the ninetieth, of made-up speakers, some of whom are missing."""
    kind = F.pmod("seg_idx", F.lit(4))
    seg = adapters.segments(spark, sf_dir).withColumn("speaker", F.when(kind == 3, F.lit(None)).when(kind.isin(1, 2), "b").otherwise(F.col("speaker")))
    return turns.speaker_timeline(seg, 5_000, 90_000, 3_000).withColumn("text", F.md5("text"))


#: Documents, some of whose letters or first words are exchanged for what mis-read texts have.
SPOILT = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN translate(lower(text), 'aeiotnsrh', 'аеиотнсрх') WHEN 2 THEN 'Гђ ' || translate(lower(text), 'aeiotnsrh', 'аеиотнсрх') WHEN 3 THEN 'это ' || translate(lower(text), 'aeiotnsrh', 'РСРСРСРСР') ELSE 'Сѓ Рє ' || text END AS t FROM documents"
RUNS = "regexp_extract_all(lower({0}), '[A-Za-zА-Яа-яЁё0-9'']+')"
CYRILLIC = "(length(regexp_replace({0}, '[^Ѐ-ӿ]', '', 'g')) / greatest(1, length({0}))::DOUBLE)"


@query(
    f"""WITH s AS ({SPOILT}), b AS (SELECT doc_id, t, {squeezed("t")} AS q FROM s), w AS (SELECT *, {RUNS.format("t")} AS v, {RUNS.format("q")} AS u FROM b),
    h AS (SELECT *, {times("t", lexicons.MISREAD_MARKERS)} AS n, NOT list_has_any(v, {listed(lexicons.COMMON_RUSSIAN + lexicons.COMMON_ENGLISH)}) AS strange, {CYRILLIC.format("t")} AS share FROM w)
    SELECT doc_id, coalesce(t <> '' AND (n >= 2 OR regexp_matches(t, '[A-Za-z] — [è÷òàü]') OR (strange AND ({times("t", ("Р", "С"))} >= greatest(4, length(t) // 6) OR (n >= 1 AND share > 0.32 AND len(v) >= 2))) OR (len(v) <= 2 AND n >= 1 AND share > 0.25)), false) AS title,
      coalesce(q <> '' AND ({times("q", lexicons.MISREAD_MARKERS)} >= 2 OR (NOT list_has_any(u, {listed(lexicons.REPORT_COMMON)}) AND {CYRILLIC.format("q")} > 0.38 AND len(u) >= 2)), false) AS report FROM h"""
)
def misread_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    russian = lambda to: F.translate(F.lower("text"), "aeiotnsrh", to)
    kind, with_ = F.pmod("doc_id", F.lit(5)), lambda head, tail: F.concat(F.lit(head), tail)
    spoilt = F.when(kind == 0, F.col("text")).when(kind == 1, russian("аеиотнсрх")).when(kind == 2, with_("Гђ ", russian("аеиотнсрх"))).when(kind == 3, with_("это ", russian("РСРСРСРСР"))).otherwise(with_("Сѓ Рє ", F.col("text")))
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", spoilt.alias("t"))
    return docs.select("doc_id", text.misread_title(F.col("t")).alias("title"), text.misread_report(F.col("t")).alias("report"))
