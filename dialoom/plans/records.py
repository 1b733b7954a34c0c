"""Queries over documents, pages and labels: text scores, candidate records, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons, repair, text
from ..operators import packaging, ranking, reporting, summary
from ..sources.adapters import COUNTS, FLAGS, LACKING, SCORES, records, table
from .registry import cascade, file_name, hits, listed, query, quoted, score, squeezed

NAMES = ("HOOK", "CONFLICT", "ESCALATION", "EMOTION", "PAYOFF")


@query(f"SELECT doc_id, {', '.join(f'round({score('text', getattr(lexicons, n))}, 4) AS {n.lower()}_score' for n in NAMES)}, array_to_string({hits('text', lexicons.CAUSAL)}, ',') AS causal FROM documents")
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [F.round(text.lexicon_score(F.col("text"), getattr(lexicons, n)), 4).alias(f"{n.lower()}_score") for n in NAMES]
    return table(spark, sf_dir, "documents").select("doc_id", *scores, F.array_join(text.hits(F.col("text"), lexicons.CAUSAL), ",").alias("causal"))


TOKENS = r"regexp_extract_all(lower(text), '[A-Za-zЀ-ӿ0-9'']+')"


@query(
    f"""WITH w AS (SELECT lang, unnest({TOKENS}) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w WHERE length(word) >= 4 AND NOT list_contains({listed(lexicons.ENGLISH_STOP_WORDS)}, word) GROUP BY ALL)
    SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 4"""
)
def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packaging.keywords(table(spark, sf_dir, "documents"), ["lang"], text.tokens(F.col("text")), lexicons.ENGLISH_STOP_WORDS)


@query(
    rf"""WITH b AS (SELECT doc_id, lang, {squeezed("text")} AS t FROM documents), l AS (SELECT *, length(regexp_replace(t, '[^А-Яа-яЁё]', '', 'g')) AS c, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS a FROM b)
    SELECT doc_id, round(CASE WHEN lower(lang) LIKE 'ru%' THEN c WHEN lower(lang) LIKE 'en%' THEN a ELSE greatest(c, a) END / greatest(1, c + a), 4) AS consistency FROM l"""
)
def language_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.language_consistency(F.col("text"), F.col("lang")).alias("consistency"))


def times(text: str, parts: tuple[str, ...]) -> str:
    """SQL of how often any of some strings occurs."""
    return f"list_sum(list_transform({listed(parts)}, lambda m: (length({text}) - length(replace({text}, m, ''))) // length(m)))"


#: SQL whether a squeezed text with tokens w is mis-encoded.
MISREAD = f"""(text <> '' AND ({times('text', lexicons.MISREAD_MARKERS)} >= 2 OR (NOT list_has_any(w, {listed(lexicons.COMMON_RUSSIAN + lexicons.COMMON_ENGLISH)}) AND ({times('text', ('Р', 'С'))} >= greatest(4, length(text) // 6)
  OR (length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) / length(text) > 0.32 AND len(w) >= 2))) OR (len(w) <= 2 AND {times('text', lexicons.MISREAD_MARKERS)} >= 1 AND length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) / length(text) > 0.25)))"""
#: SQL whether a text holds one character five times in a row.
FIVE_ALIKE = "list_bool_or([list_has_any(list_transform([regexp_extract_all(text, '(?s).')], lambda c: len(list_filter(range(1, len(c) - 3), lambda i: c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4])) > 0), [true])])"
SUSPICIOUS = rf"""b AS (SELECT doc_id, lang, {squeezed("text")} AS text FROM documents), w AS (SELECT *, {TOKENS} AS w FROM b),
  s AS (SELECT *, len(list_distinct(w)) / greatest(1, len(w))::DOUBLE AS u, text = '' OR len(w) = 0 OR len(list_distinct(w)) / greatest(1, len(w))::DOUBLE < 0.35 OR {MISREAD}
    OR {FIVE_ALIKE} AS suspicious FROM w)"""


@query(f"WITH {SUSPICIOUS} SELECT doc_id, suspicious, round(u, 4) AS unique_share FROM s")
def suspicious_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(text.squeeze(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", text.suspicious(F.col("text")).alias("suspicious"), F.round(text.unique_share(words), 4).alias("unique_share"))


@query(
    rf"""WITH {SUSPICIOUS}, l AS (SELECT *, length(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM s),
    k AS (SELECT *, round(CASE WHEN lower(lang) LIKE 'ru%' THEN c WHEN lower(lang) LIKE 'en%' THEN a ELSE greatest(c, a) END / greatest(1, c + a), 4) AS lc FROM l)
    SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.50 + lc * 0.22 + u * 0.18 + (CASE WHEN regexp_matches(text, '[.!?]$') THEN 0.10 ELSE 0.0 END + CASE WHEN len(w) >= 6 THEN 0.06 ELSE 0.0 END)
      - CASE WHEN suspicious THEN 0.28 ELSE 0.0 END - least(0.20, len(list_filter(w, lambda x: length(x) <= 2)) / greatest(1, len(w))::DOUBLE * 0.22) - least(0.22, greatest(0.0, 0.58 - u) * 0.65))), 4) END AS sanity FROM k"""
)
def text_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.text_sanity(F.col("text"), F.col("lang")).alias("sanity"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\{[^}]+\}', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("text_md5"))


WHOLE = squeezed("text")


@query(rf"SELECT doc_id, '#' || nullif(regexp_replace(regexp_replace(replace(trim({WHOLE}), ' ', '_'), '[^\p{{L}}\p{{N}}_]+', '', 'g'), '^_+|_+$', '', 'g'), '') AS slug FROM documents")
def hashtag_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(
    rf"""WITH t AS (SELECT doc_id, replace(regexp_replace(trim({WHOLE}), ' +([,.:;!?])', '\1', 'g'), ' - ', ' ') AS t FROM documents), w AS (SELECT *, string_split(t, ' ') AS w, length(t) AS n FROM t),
    p AS (SELECT *, length(regexp_replace(t, '[^,;:—-]', '', 'g')) + len(regexp_extract_all(t, '\.\.\.')) AS marks, len(list_filter(range(2, len(w) + 1), lambda i: lower(w[i]) = lower(w[i - 1]))) AS again FROM w)
    SELECT doc_id, round(CASE WHEN t = '' THEN 0.0 ELSE greatest(0.0, least(1.0, greatest(0.0, 1.0 - least(1.0, abs(n - 34.0) / 34.0)) * 0.34 + length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / greatest(1, n)::DOUBLE * 0.38
      + greatest(0.0, 1.0 - least(1.0, abs(len(w) - 6.0) / 6.0)) * 0.22 - least(1.0, marks / 4.0) * 0.18 - CASE WHEN again > 0 THEN 1.0 ELSE 0.0 END * 0.12 - CASE WHEN len(w) < 2 THEN 0.18 ELSE 0.0 END)) END, 4) AS quality FROM p"""
)
def title_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(packaging.title_quality(F.col("text")), 4).alias("quality"))


@query(
    rf"""WITH t AS (SELECT doc_id, {squeezed("text")} AS t FROM documents), h AS (SELECT *, left(t, 96) AS h FROM t)
    SELECT doc_id, CASE WHEN length(t) <= 96 THEN t WHEN rtrim(regexp_extract(h, '^(.*) ', 1)) <> '' THEN rtrim(regexp_extract(h, '^(.*) ', 1)) ELSE h END AS summary FROM h"""
)
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", packaging.context_summary(F.col("text")).alias("summary"))


@query(
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower({squeezed("text")}), '[\p{{L}}\p{{N}}_'']+'), lambda x: length(x) > 2) AS w FROM documents),
    q AS (SELECT doc_id, w, list_filter(w, lambda x: length(x) >= 4 AND NOT list_contains({listed(lexicons.STOP_WORDS)}, x)) AS p FROM w),
    c AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE w END AS c FROM q)
    SELECT doc_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[1:5], ' ') AS phrase FROM c"""
)
def topic_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.topic_phrase(F.col("text")).alias("phrase"))


@query(
    f"""WITH n AS (SELECT doc_id, {file_name("text")} AS base FROM documents)
    SELECT doc_id, CASE WHEN k = 1 THEN base ELSE base || ' [' || k || ']' END AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS k FROM n)"""
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"))
    return packaging.output_names(docs, "doc_id").select("doc_id", "file_name")


MADE = ", ".join(f"{f'CASE WHEN doc_id % {LACKING[n]} <> 0 THEN ' if n in LACKING else ''}(doc_id * {k} % 101) / 100.0{' END' if n in LACKING else ''} AS {n}" for n, k in SCORES.items())
FLAGGED = ", ".join([*(f"doc_id % {k} = 0 AS {n}" for n, k in FLAGS.items()), *(f"CASE WHEN doc_id % {k} = 0 THEN 1 ELSE 0 END AS {n}" for n, k in COUNTS.items())])
RECORDS = f"""rec AS (SELECT doc_id, lang, source, {MADE}, {FLAGGED}, n_chars % 90 AS final_duration, ['accept', 'review', 'reject_visual', 'reject_story'][doc_id % 4 + 1] AS quality_governor_decision,
  doc_id % 6 AS topic_shift_events, list_filter([CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END, CASE WHEN doc_id % 3 = 0 THEN 'publishable' END, CASE WHEN toxic = 1 THEN 'confusing' END, CASE WHEN doc_id % 5 = 0 THEN 'late_hook' END], lambda x: x IS NOT NULL) AS human_labels,
  CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS runtime_ms, (doc_id * 69 % 101) / 100.0 * 8 AS trimmed_silence_seconds, doc_id % 4 AS trims, CASE doc_id % 5 WHEN 1 THEN 'unfinished' WHEN 2 THEN 'punchline' END AS payoff_type,
  CASE WHEN doc_id % 4 = 1 THEN 'threat_tension' END AS hook_type, CASE WHEN doc_id % 3 = 0 THEN 'thread_' || doc_id % 20 END AS story_thread_id, 'conv_' || doc_id % 50 AS conversation, CASE WHEN doc_id % 3 = 1 THEN 'hook_setup_escalation' END AS arc,
  ['hook_only', 'hook_setup'][doc_id % 2 + 1] AS summary_arc, (doc_id * 57 % 101) / 100.0 AS summary_coherence, (doc_id * 63 % 101) / 100.0 AS summary_completion FROM documents JOIN labels USING (doc_id))"""
HOOK = "greatest(hook_strength, hook_score, first_second_hook_score, sound_off_hook_score, premise_signal_score)"
RETENTION = "coalesce(retention_soft_score, viral_soft_score, 0)"
FOCUS = "greatest(speaker_centered_rate, subject_visibility_ratio)"
PUBLISHABLE = "((quality_governor_decision = 'accept' AND NOT needs_review) OR (recommendation_readiness_score >= 0.64 AND packaging_quality_score >= 0.52 AND subtitle_quality_score >= 0.55))"
RULES = [
    ("late_hook", f"cold_open_dead_time_penalty > 0.18 OR {HOOK} < 0.50"), ("weak_hook", f"visible_stakes_score < 0.45 AND {HOOK} < 0.58"), ("wrong_face_focus", f"{FOCUS} < 0.55 OR visual_subject_score < 0.40"),
    ("speaker_unclear", "subject_visibility_ratio < 0.48 AND speaker_centered_rate < 0.50"), ("subtitle_overload", "subtitle_quality_score < 0.55 OR subtitle_overlap_outputs > 0 OR subtitle_blink_outputs > 0"), ("missing_context", "dialogue_dependency_penalty > 0.35"),
    ("weak_payoff", "story_completeness_score < 0.48 AND payoff_strength < 0.50"), ("bad_title", "packaging_quality_score < 0.50 OR title_quality_score < 0.55"), ("crop_jitter", "speaker_center_offset_avg > 0.18 OR speaker_center_offset_p95 > 0.22"),
    ("bad_pacing", f"final_duration > 42 AND {RETENTION} < 0.58"), ("confusing_dialogue", "story_interest_score < 0.52 AND story_context_score < 0.40"), ("confusing_dialogue", "coalesce(story_coherence_score, 1.0) < 0.58"),
    ("weak_payoff", "coalesce(story_completion_score, 0) < 0.56 OR coalesce(payoff_type, '') = 'unfinished'"), ("confusing_dialogue", "topic_shift_events > 0"), ("wrong_face_focus", "visual_conversation_score < 0.48 OR speaker_confidence_score < 0.42"),
    ("bad_pacing", f"pacing_score < 0.48 OR (trimmed_silence_seconds > 4.0 AND {RETENTION} < 0.62)"), ("too_fast", "final_duration < 35"), ("too_slow", f"final_duration > 60 AND {RETENTION} < 0.50"),
    ("late_entry", "reframe_scene_interest_fallback_used AND subject_visibility_ratio < 0.30"), ("speaker_unclear", "subject_person_fallback_used AND visual_subject_score < 0.40"), ("crop_jitter", "face_preserving_fallback_used AND face_edge_clip_rate > 0.12"),
    ("wrong_face_focus", "quality_governor_decision = 'reject_visual'"), ("late_hook", f"quality_governor_decision = 'reject_story' AND {HOOK} < 0.50"),
    ("weak_payoff", "quality_governor_decision = 'reject_story' AND story_completeness_score < 0.50"), ("missing_context", "quality_governor_decision = 'reject_story' AND story_context_score < 0.40"),
    ("weak_payoff", "rejected_for_missing_payoff"), ("confusing_dialogue", "rejected_for_topic_jump"), ("confusing_dialogue", "rejected_for_confusing_story"),
]
#: SQL of a summary's fields; s_ keeps them apart from the row's own.
SUMMARY = {
    "hook_score": f"round({HOOK}, 4)", "retention_soft_score": f"round({RETENTION}, 4)", "subtitle_quality": "round(subtitle_quality_score, 4)", "face_focus_rate": f"round({FOCUS}, 4)", "publishable": PUBLISHABLE,
    "story_coherence_score": "round(coalesce(story_coherence_score, summary_coherence), 4)", "story_completion_score": "round(coalesce(story_completion_score, summary_completion), 4)", "context_completeness_score": "round(coalesce(context_completeness_score, 0.0), 4)",
    "silence_trim_events_count": "trims", "story_thread_id": "coalesce(story_thread_id, conversation)", "conversation_id": "conversation", "story_arc_shape": "coalesce(arc, summary_arc)", "hook_type": "coalesce(hook_type, 'question')",
    "payoff_type": "coalesce(payoff_type, 'reveal')", "topic_shift_events": "topic_shift_events", "quality_governor_decision": "quality_governor_decision",
} | {n: f"round({n}, 4)" for n in ranking.PLAIN}
TAGGED = f"""{RECORDS}, tag0 AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {test} THEN '{tag}' END" for tag, test in RULES)}], lambda x: x IS NOT NULL) AS found FROM rec),
  tag AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS failure_reason, {', '.join(f'{sql} AS s_{n}' for n, sql in SUMMARY.items())} FROM tag0)"""


def summarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.candidate_summary(records(spark, sf_dir))


@query(f"WITH {TAGGED} SELECT doc_id, {', '.join(f's_{n} AS {n}' for n in SUMMARY)}, array_to_string(failure_reason, ',') AS failure_reason FROM tag")
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarized(spark, sf_dir).select("doc_id", *(f"summary.{n}" for n in SUMMARY), F.array_join("failure_reason", ",").alias("failure_reason"))


FELL_BACK = " OR ".join(reporting.FALLBACKS)
METRICS = f"""SELECT count(*) AS count, round(count(*) FILTER (s_publishable) / count(*), 4) AS publishable_rate, {', '.join(f"round(sum(s_{c}::DECIMAL(18,6))::DOUBLE / count(*), 4) AS {a}" for a, c in reporting.SESSION_MEANS.items())},
    round(avg(runtime_ms) / 1000, 3) AS runtime, round(count(*) FILTER (s_publishable) / count(*), 4) AS stability, round(count(*) FILTER ({FELL_BACK}) / count(*), 4) AS fallback_frequency FROM tag"""


@query(f"WITH {TAGGED} {METRICS}")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.session_metrics(summarized(spark, sf_dir))


SESSIONS = """ses AS (SELECT strftime(ts, '%Y-%m-%d') AS created_at, count(*)::DOUBLE AS publishable_candidates, round(sum(value::DECIMAL(18,6))::DOUBLE, 3) AS runtime_seconds FROM events GROUP BY 1),
  pl AS (SELECT *, row_number() OVER (ORDER BY created_at) AS k, count(*) OVER () AS n FROM ses),
  th AS (SELECT metric, part, avg(v) AS v FROM (SELECT CASE WHEN k <= n // 3 THEN 'early' WHEN k > n - n // 3 THEN 'recent' END AS part, unnest(['publishable_candidates', 'runtime_seconds']) AS metric, unnest([publishable_candidates, runtime_seconds]) AS v FROM pl WHERE n >= 3) WHERE part IS NOT NULL GROUP BY ALL),
  tr AS (SELECT metric, round(max(v) FILTER (part = 'early'), 4) AS early, round(max(v) FILTER (part = 'recent'), 4) AS recent FROM th GROUP BY metric)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of events as sessions."""
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("created_at"))
    return days.agg(F.count("*").cast("double").alias("publishable_candidates"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 3).alias("runtime_seconds"))


DISTRIBUTIONS = f"""fl AS ({' UNION ALL '.join(f"SELECT '{c}' AS score, s_{c} AS x FROM tag" for c in reporting.DISTRIBUTED)})"""
METRIC_NAMES = ["count", "publishable_rate", *reporting.SESSION_MEANS, "runtime", "stability", "fallback_frequency"]


@query(
    f"""WITH {TAGGED}, {SESSIONS}, m AS ({METRICS}), {DISTRIBUTIONS}, one AS (SELECT count(*) AS n FROM tag), rs AS (SELECT doc_id, unnest(failure_reason) AS t FROM tag), hl AS (SELECT unnest(human_labels) AS t FROM tag),
    lb AS (SELECT unnest({listed(lexicons.REVIEW_LABELS)}) AS label)
    {' UNION ALL '.join(f"SELECT 'metrics' AS section, '{c}' AS key, {c}::DOUBLE AS value FROM m" for c in METRIC_NAMES)}
    UNION ALL SELECT 'label_rates', label, round((SELECT count(*) FROM hl WHERE t = label) / (SELECT n FROM one), 4) FROM lb
    UNION ALL SELECT 'root_causes', t, count(*) FROM rs GROUP BY t UNION ALL SELECT 'labels', t, count(*) FROM hl GROUP BY t
    UNION ALL (SELECT 'cooccurrence', x.t || '::' || y.t, count(*) AS n FROM rs x JOIN rs y ON x.doc_id = y.doc_id AND x.t < y.t GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)
    UNION ALL SELECT 'distributions', score || ':' || least(4, greatest(0, floor(x * 5)::BIGINT)), count(*) FROM fl GROUP BY 2
    UNION ALL SELECT 'distributions', score || ':min', min(x) FROM fl GROUP BY score UNION ALL SELECT 'distributions', score || ':max', max(x) FROM fl GROUP BY score
    UNION ALL SELECT 'distributions', score || ':avg', round(avg(x), 4) FROM fl GROUP BY score UNION ALL SELECT 'distributions', score || ':sample_size', count(*) FROM fl GROUP BY score
    UNION ALL SELECT 'accepted_arcs', coalesce(nullif(s_story_arc_shape, ''), 'unknown'), count(*) FROM tag WHERE s_publishable GROUP BY 2
    UNION ALL SELECT 'sufficiency', 'status:' || CASE WHEN n < 100 THEN 'weak' WHEN n < 250 THEN 'minimum' WHEN n < 500 THEN 'recommended' ELSE 'strong' END, n FROM one
    UNION ALL SELECT 'sufficiency', 'warning:' || CASE WHEN n < 100 THEN 'insufficient_data_for_confident_iteration' WHEN n < 250 THEN 'usable_but_still_small' ELSE 'good_enough_for_targeted_changes' END, n FROM one WHERE n < 500
    UNION ALL SELECT 'warnings', 'small_sample_size', 1 FROM one WHERE n < 20 UNION ALL SELECT 'warnings', 'below_minimum_data_gate', 1 FROM one WHERE n < 100
    UNION ALL SELECT 'trend', metric, round(recent - early, 4) FROM tr"""
)
def baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.baseline_report(summarized(spark, sf_dir), sessions(spark, sf_dir), ["publishable_candidates", "runtime_seconds"])


@query(
    f"""WITH {RECORDS}, k AS (SELECT unnest({listed(lexicons.REVIEW_LABELS)}) AS label), c AS (SELECT unnest(human_labels) AS label, 1 AS one FROM rec), n AS (SELECT label, count(*) AS n FROM c GROUP BY label)
    SELECT label, coalesce(n, 0) AS occurrences, round(coalesce(n, 0) / (SELECT count(*) FROM rec), 4) AS rate FROM k LEFT JOIN n USING (label)"""
)
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.label_rates(records(spark, sf_dir))


@query(f"WITH {TAGGED}, t AS (SELECT unnest(failure_reason) AS tag FROM tag) SELECT tag, count(*) AS n FROM t GROUP BY tag")
def failure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.tag_counts(summarized(spark, sf_dir), "failure_reason")


@query(
    f"""WITH {TAGGED}, a AS (SELECT doc_id, unnest(failure_reason) AS tag FROM tag)
    SELECT x.tag || '::' || y.tag AS pair, count(*) AS n FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.tag < y.tag GROUP BY 1 ORDER BY n DESC, pair LIMIT 10"""
)
def failure_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.co_occurrence(summarized(spark, sf_dir), "failure_reason")


@query(
    f"""WITH {TAGGED}, c AS (SELECT least(4, greatest(0, floor(s_hook_score * 5)::BIGINT)) AS bucket, count(*) AS n FROM tag GROUP BY 1), b AS (SELECT unnest(range(0, 5)) AS bucket)
    SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)"""
)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.histogram(summarized(spark, sf_dir).select("summary.hook_score"), "hook_score")


@query(f"WITH {TAGGED} SELECT min(s_hook_score) AS low, max(s_hook_score) AS high, round(avg(s_hook_score), 4) AS mean, count(s_hook_score) AS sample_size FROM tag")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.score_spread(summarized(spark, sf_dir).select("summary.hook_score"), "hook_score")


@query("SELECT source, count(*) AS reviewed, CASE WHEN count(*) < 100 THEN 'weak' WHEN count(*) < 250 THEN 'minimum' WHEN count(*) < 500 THEN 'recommended' ELSE 'strong' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY source")
def data_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = records(spark, sf_dir).groupBy("source").agg(F.count("*").alias("reviewed"))
    return counts.withColumn("status", reporting.sufficiency(F.col("reviewed")))


@query(
    f"""WITH {RECORDS}, c AS (SELECT doc_id, source, final_duration AS duration, doc_id % 3 = 0 AS has_payoff, coalesce(story_completion_score, 0) AS sc, coalesce(story_coherence_score, 0) AS co, clarity_score AS cl, hook_score AS h, watchability_score AS s FROM rec)
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sc DESC, has_payoff DESC, co DESC, cl DESC, h DESC, s DESC, doc_id) AS rank FROM c"""
)
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.story_rank(candidates(spark, sf_dir), ["source"], "doc_id").select("doc_id", "source", "rank")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumns({"duration": F.col("final_duration"), "has_payoff": F.pmod("doc_id", F.lit(3)) == 0, "score": F.col("watchability_score")})


@query(
    f"""WITH {RECORDS}, c AS (SELECT doc_id, source, final_duration AS duration, doc_id % 3 = 0 AS has_payoff, coalesce(story_completion_score, 0) AS sc, coalesce(story_coherence_score, 0) AS co, clarity_score AS cl, hook_score AS h, watchability_score AS s FROM rec),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sc DESC, has_payoff DESC, co DESC, cl DESC, h DESC, s DESC, doc_id) AS rank FROM c WHERE duration >= 10 AND (duration >= 20 OR sc >= 0.75 OR has_payoff) AND duration >= 12)
    SELECT doc_id, source, duration, rank FROM k WHERE rank <= 5"""
)
def publishable_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.publishable(candidates(spark, sf_dir), ["source"], "doc_id", least_s=12.0).select("doc_id", "source", "duration", "rank")


WEIGHTED = " + ".join(f"{c} * {w}" for c, w in ranking.ASSISTED)


@query(
    f"""WITH {RECORDS}, s AS (SELECT *, round({WEIGHTED}, 4) AS score FROM rec) SELECT doc_id, source, score,
    row_number() OVER (PARTITION BY source ORDER BY score DESC, {', '.join(f'{c} DESC' for c, w in ranking.ASSISTED if w > 0)}, doc_id) AS rank FROM s"""
)
def assisted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.assisted_rank(records(spark, sf_dir), ["source"], "doc_id").select("doc_id", "source", "score", "rank")


GATES = """CASE WHEN final_duration < 12 THEN 'too_short' WHEN coalesce(story_completion_score, 0) < 0.25 THEN 'low_story_quality' WHEN story_context_score < 0.2 THEN 'insufficient_context' WHEN hook_score < 0.15 THEN 'weak_hook'
  WHEN subtitle_quality_score < 0.1 THEN 'subtitle_quality' WHEN subject_visibility_ratio < 0.05 THEN 'no_visible_subject' END"""


@query(f"WITH {RECORDS} SELECT doc_id, {GATES} AS reason FROM rec")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", ranking.first_reason(ranking.selection_gates()).alias("reason"))


@query(
    f"""WITH {RECORDS}, g AS (SELECT {GATES} AS reason, doc_id::VARCHAR AS example FROM rec), r AS (SELECT * FROM g WHERE reason IS NOT NULL),
    w AS (SELECT * FROM r UNION ALL SELECT 'subtitle_timeout', NULL FROM rec WHERE doc_id % 25 = 0), c AS (SELECT reason, count(*) AS n FROM w GROUP BY reason),
    e AS (SELECT reason, string_agg(example, ',' ORDER BY example) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY example) AS k FROM w WHERE example IS NOT NULL) WHERE k <= 3 GROUP BY reason)
    SELECT reason, n, round(n / (SELECT count(*) FROM w), 4) AS share, coalesce(examples, '') AS examples FROM c LEFT JOIN e USING (reason)"""
)
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    rejects = r.select(ranking.first_reason(ranking.selection_gates()).alias("reason"), F.col("doc_id").cast("string").alias("example")).where("reason is not null")
    warnings = r.where(F.pmod("doc_id", F.lit(25)) == 0).select(F.lit("reject: subtitle_timeout after 30 s").alias("text"))
    return reporting.reject_summary(rejects, warnings)


@query(
    f"""WITH {RECORDS} SELECT source, count(*) AS n, min(final_duration) AS least, max(final_duration) AS most, round(avg(final_duration), 4) AS mean, (list(final_duration ORDER BY final_duration))[count(*) // 2 + 1] AS upper_median,
    {', '.join(f'round(count(*) FILTER (final_duration > {s}) / count(*), 4) AS over_{s}' for s in (60, 120, 240))} FROM rec GROUP BY source"""
)
def duration_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.duration_profile(records(spark, sf_dir), "source", "final_duration")


@query(
    f"""WITH {RECORDS}, m AS (SELECT doc_id % 2 AS half, count(*)::DOUBLE AS records, round(avg(hook_score), 4) AS hook, round(avg(pacing_score), 4) AS pacing FROM rec GROUP BY 1),
    t AS (SELECT half, 'records' AS metric, records AS v FROM m UNION ALL SELECT half, 'hook', hook FROM m UNION ALL SELECT half, 'pacing', pacing FROM m)
    SELECT metric, max(v) FILTER (half = 0) AS before, max(v) FILTER (half = 1) AS after, round(max(v) FILTER (half = 1) - max(v) FILTER (half = 0), 4) AS delta FROM t GROUP BY metric"""
)
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tall(half: int) -> DataFrame:
        m = records(spark, sf_dir).where(F.pmod("doc_id", F.lit(2)) == half).agg(F.count("*").cast("double").alias("records"), F.round(F.avg("hook_score"), 4).alias("hook"), F.round(F.avg("pacing_score"), 4).alias("pacing"))
        return m.unpivot([], ["records", "hook", "pacing"], "metric", "value")

    return reporting.compare_runs(tall(0), tall(1))


@query(
    f"""WITH {RECORDS}, c AS (SELECT source, count(*) AS n FROM rec WHERE quality_governor_decision = 'accept' GROUP BY source)
    SELECT source, n, greatest(2, least(12, ceil(n * 0.4)))::BIGINT AS pool FROM c"""
)
def admission_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.admission_pool(records(spark, sf_dir), "source")


@query(
    f"""WITH {RECORDS}, o AS (SELECT doc_id, source, story_coherence_score AS c, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM rec),
    n AS (SELECT *, CASE WHEN coalesce(c, 0) >= 0.62 AND doc_id - before <= 24 THEN 0 ELSE 1 END AS new FROM o)
    SELECT doc_id, source, sum(new) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS thread FROM n"""
)
def story_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.story_threads(records(spark, sf_dir), "source", "doc_id", "story_coherence_score").select("doc_id", "source", "thread")


@query()
def repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose UTF-8 bytes were read as Latin-1, and the others, repaired."""
    misread = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    shown = F.when(F.pmod("doc_id", F.lit(2)) == 0, misread).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_misread(shown).alias("misread"), F.md5(repair.repaired(shown)).alias("text_md5"))


#: Metadata fields of outputs that records have under other names.
OUTPUT_FIELDS = {"subtitle_event_overlap_count": "subtitle_overlap_outputs", "subtitle_gap_blink_count": "subtitle_blink_outputs", "reframe_anchor_switches": "speaker_switches", "duration_policy_band": "quality_governor_decision", "story_mode": "lang", "subject_acquisition_state": "hook_type"}
OUTPUT_SQL = {**{n: c for n, c in OUTPUT_FIELDS.items()}, **{n: n for n in [*SCORES, *FLAGS, *COUNTS, "final_duration"]}}


def counted(n: str, test: str) -> str:
    return f"count(*) FILTER ({test}) AS {n}"


TESTS = {
    "titled_outputs": "false", "title_mojibake_outputs": "false", "subtitle_quality_retry_outputs": "false", "subtitle_missing_outputs": "false", "weak_premise_outputs": "greatest(sound_off_hook_score, first_second_hook_score, premise_signal_score) < 0.48",
    "weak_subject_outputs": "subject_visibility_ratio < 0.46", "weak_packaging_outputs": "packaging_quality_score < 0.52", **{n: OUTPUT_SQL.get(c, "false") for n, c in summary.FLAGGED.items()},
    **{n: f"{OUTPUT_SQL[c]} > 0" if c in OUTPUT_SQL else "false" for n, c in summary.ABOVE_ZERO.items()},
}
SUMMED_UP = f"""o AS (SELECT source, count(*) AS outputs, {', '.join(counted(n, test) for n, test in TESTS.items())}, {', '.join(f"round(sum({c}::DECIMAL(18,6))::DOUBLE / nullif(count({c}), 0), 4) AS {n}" if c in OUTPUT_SQL else f"NULL::DOUBLE AS {n}" for n, c in summary.AVERAGED.items())},
  round(sum(final_duration)::DOUBLE / count(final_duration), 2) AS avg_final_duration, round(sum(speaker_switches)::DOUBLE / count(speaker_switches), 2) AS avg_anchor_switches, {', '.join(f'0::BIGINT AS {n}' for n in summary.SUMMED)} FROM rec GROUP BY source)"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumns({n: F.col(c) for n, c in OUTPUT_FIELDS.items()})


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per source, and one of a run without outputs."""
    names = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).union(spark.createDataFrame([("empty", 0)], "source string, n long"))
    stats = F.create_map(F.lit("total_windows"), F.col("n").cast("string"), F.lit("publishable_candidates"), F.floor(F.col("n") / 3).cast("string"), F.lit("episode_quality_floor"), F.lit("0.5"), F.lit("hard_timeouts"), F.lit("bad"))
    warned = F.when(F.col("n") == 0, F.array(F.lit("Found NO subtitles here"), F.lit("export_failed"))).otherwise(F.array().cast("array<string>"))
    return names.select("source", F.when(F.col("n") > 0, "ok").alias("status"), F.lit("story").alias("story_mode"), F.lit(3).alias("requested_max"), warned.alias("warnings"), stats.alias("stats"), F.create_map(F.lit("selection_total_seconds"), F.lit(1.5)).alias("stage_timings"))


SHOWN_STATS = {"windows": "n", "publishable_candidates": "n // 3"}


@query(
    f"""WITH {RECORDS}, {SUMMED_UP}, r AS (SELECT source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'empty', 0)
    SELECT r.source, CASE WHEN n > 0 THEN 'ok' ELSE 'unknown' END AS status, 'story' AS story_mode, 'story' AS episode_story_mode, 3::BIGINT AS requested_max, CASE WHEN n = 0 THEN 2 ELSE 0 END::BIGINT AS warnings_count,
      CASE WHEN n = 0 THEN 'no_subtitles' END AS main_rejection_reason, {', '.join(f"({SHOWN_STATS.get(s, '0')})::BIGINT AS {s}" for s in summary.STATS)}, n // 3 AS publishable_pool_before_final_visual_gate,
      0.5::DOUBLE AS episode_quality_floor, 0.0::DOUBLE AS episode_tension_density, 0.0::DOUBLE AS selection_admission_fraction, 1.5::DOUBLE AS selection_seconds, NULL::DOUBLE AS median_stage_seconds,
      {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['outputs', *TESTS, *summary.SUMMED])}, {', '.join(summary.AVERAGED)}, avg_final_duration, coalesce(avg_anchor_switches, 0.0) AS avg_anchor_switches,
      round(subtitle_blackout_outputs / outputs, 4) AS avg_subtitle_blackout, round(speaker_to_listener_switch_outputs / outputs, 4) AS speaker_to_listener_switch_rate, round(subtitle_remap_outputs / outputs, 4) AS subtitle_remap_usage_rate,
      coalesce(compaction_integrity_failed_outputs, 0) AS compaction_integrity_failed_total FROM r LEFT JOIN o ON r.source = o.source"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.run_summary(run_reports(spark, sf_dir), outputs(spark, sf_dir), "source").drop("warnings")


@query(
    f"""WITH {RECORDS}, t AS (SELECT source, unnest({listed(list(summary.COUNTED))}) AS counter, unnest([quality_governor_decision, lang, coalesce(hook_type, ''), coalesce(hook_type, '')]) AS value FROM rec)
    SELECT source, counter, value, count(*) AS n FROM t WHERE value <> '' GROUP BY ALL"""
)
def run_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.value_counts(outputs(spark, sf_dir), "source")


@query(
    f"""WITH {TAGGED} SELECT quality_governor_decision AS decision, tag, count(*) AS n FROM (SELECT quality_governor_decision, unnest(failure_reason) AS tag FROM tag) GROUP BY ALL"""
)
def reasons_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarized(spark, sf_dir).select(F.col("quality_governor_decision").alias("decision"), F.explode("failure_reason").alias("tag")).groupBy("decision", "tag").agg(F.count("*").alias("n"))


@query(
    f"""WITH {RECORDS}, g AS (SELECT {GATES} AS reason FROM rec), b AS (SELECT CASE WHEN reason IN ('insufficient_context', 'too_short') THEN 'boundary' WHEN reason IN ('low_story_quality', 'weak_hook', 'subtitle_quality') THEN 'quality'
      WHEN reason = 'no_visible_subject' THEN 'vision' ELSE 'other' END AS bucket FROM g WHERE reason IS NOT NULL) SELECT bucket, count(*) AS n FROM b GROUP BY bucket"""
)
def starvation_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = records(spark, sf_dir).select(ranking.first_reason(ranking.selection_gates()).alias("reason")).where("reason is not null")
    return reasons.groupBy(ranking.starvation_bucket(F.col("reason")).alias("bucket")).agg(F.count("*").alias("n"))


MOODS = f"CASE mood {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in packaging.MOOD_TAGS.items())} END"
BARE = f"""regexp_replace(regexp_replace(replace(regexp_replace({WHOLE}, ' +([,.:;!?])', '\\1', 'g'), ' - ', ' '), '^(?i:(?:(?:{'|'.join(packaging.FILLERS)}) [ ,:;\\-—]*)+)', ''), '^[ ,:;\\-—]+|[ ,:;\\-—]+$', '', 'g')"""


@query(
    rf"""WITH s AS (SELECT doc_id, text, {BARE} AS b, {cascade("text", packaging.MOOD_STEMS, "CASE WHEN doc_id % 2 >= 0.75 THEN 'drama' ELSE 'conversation' END")} AS mood, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-zЀ-ӿ0-9'']+'), lambda w: length(w) >= 4) AS w FROM documents),
    t AS (SELECT *, CASE WHEN length(b) > 84 AND regexp_extract(b, '^(.{{18,71}}?[.!?—,;:-])', 1) <> '' THEN regexp_extract(b, '^(.{{18,71}}?[.!?—,;:-])', 1) ELSE b END AS c, list_filter(w, lambda x, i: list_position(w, x) = i)[1:4] AS d FROM s),
    u AS (SELECT *, list_filter(list_append(list_transform(d, lambda x: '#' || nullif(regexp_replace(x, '[^\p{{L}}\p{{N}}_]+', '', 'g'), '')), {MOODS}), lambda x: x IS NOT NULL) AS g FROM t)
    SELECT doc_id, upper(c[1:1]) || c[2:] AS seed, mood, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i)[1:3], ' ') AS tags FROM u"""
)
def keyword_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hook seed, mood and keyword hashtags of each document."""
    docs = table(spark, sf_dir, "documents")
    mood = packaging.title_mood(F.col("text"), F.pmod("doc_id", F.lit(2)).cast("double"))
    words = F.slice(F.array_distinct(F.filter(text.tokens(F.col("text")), lambda w: F.length(w) >= 4)), 1, 4)
    return docs.select("doc_id", packaging.hook_seed(F.col("text")).alias("seed"), mood.alias("mood"), F.array_join(packaging.keyword_hashtags(words, mood), " ").alias("tags"))
