"""Queries over conversations: turns, blocks, stories, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons, text
from ..operators import captions, grouping, intervals, packaging, pauses, ranking, reporting, signals, story, titles, turns
from ..sources.adapters import segments
from .records import FIVE_ALIKE, MISREAD
from .registry import BLOCKS, SEGMENTS, TURN_TYPE, TURNS, cascade, file_name, hits, listed, query, quoted, score, squeezed


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.dialogue_turns(segments(spark, sf_dir))


def gap_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.gap_blocks(spoken(spark, sf_dir))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments with roles of bridged blocks."""
    return story.roles(story.fragments(story.split_fragments(grouping.bridged_blocks(spoken(spark, sf_dir)))))


@query(
    f"""WITH {TURNS} SELECT source_id, turn_id, start_ms, end_ms, text, speaker, end_ms - start_ms AS duration_ms, text <> '' AS has_speech, {TURN_TYPE} AS turn_type,
    coalesce(end_ms - start_ms < 800 AND start_ms - lag(end_ms) OVER (PARTITION BY source_id ORDER BY turn_id) < 200, false) AS is_interruption FROM turns"""
)
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir)


@query(f"WITH {TURNS} SELECT speaker, {TURN_TYPE} AS turn_type, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS total_ms FROM turns GROUP BY ALL")
def turn_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir).groupBy("speaker", "turn_type").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))


@query(
    f"""WITH {TURNS}, g AS (SELECT source_id, lag(end_ms) OVER (PARTITION BY source_id ORDER BY turn_id) AS start_ms, start_ms AS end_ms FROM turns
    UNION ALL SELECT source_id, arg_max(end_ms, turn_id), max(end_ms) + 1500 FROM turns GROUP BY source_id)
    SELECT source_id, start_ms, end_ms, end_ms - start_ms AS duration_ms FROM g WHERE end_ms > start_ms"""
)
def silence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spoken(spark, sf_dir)
    return turns.silence_spans(t, t.groupBy("source_id").agg((F.max("end_ms") + 1500).alias("total_ms")))


@query(
    f"""WITH {BLOCKS} SELECT source_id, block_no, start_ms, end_ms, end_ms - start_ms AS duration_ms, turn_count, array_to_string(speakers, ',') AS speakers FROM blocks"""
)
def conversation_blocks_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.blocks(gap_blocked(spark, sf_dir))
    return found.select("source_id", "block_no", "start_ms", "end_ms", "duration_ms", "turn_count", F.array_join("speakers", ",").alias("speakers"))


def top_words(words: str) -> str:
    """SQL of a list's eight most frequent words, the first to appear among equals."""
    counted = f"list_transform(list_distinct({words}), lambda w: {{'n': -len(list_filter({words}, lambda x: x = w)), 'p': list_position({words}, w), 'w': w}})"
    return f"list_transform(list_sort({counted})[1:8], lambda c: c.w)"


def shared(a: str, b: str) -> str:
    """SQL of the share of two lists' elements that both have; 0 for two empty ones."""
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0)::DOUBLE, 0.0)"


TOPIC_WORDS = rf"list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 4 AND NOT list_contains({listed(lexicons.STOP_WORDS)}, w))"
#: Blocks with bridges, by walking each source: `numbered`.
BRIDGED = rf"""{TURNS}, wt AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY turn_id) AS k, {TOPIC_WORDS} AS ws FROM turns),
  bw AS (SELECT source_id, turn_id, k, 0::BIGINT AS block_no, [speaker] AS sp, ws AS words, 1 AS size, end_ms AS last_ FROM wt WHERE k = 1
    UNION ALL SELECT source_id, turn_id, k, block_no + cut::INT, CASE WHEN cut THEN [speaker] ELSE list_distinct(list_append(sp, speaker)) END, CASE WHEN cut THEN ws ELSE list_concat(words, ws) END, CASE WHEN cut THEN 1 ELSE size + 1 END, end_ms
    FROM (SELECT t.*, b.block_no, b.sp, b.words, b.size, t.start_ms - b.last_ > 3500 AND NOT (b.sp = [t.speaker] AND t.start_ms - b.last_ <= CASE WHEN b.size >= 4 THEN 15750 ELSE 10500 END)
        AND NOT (list_contains(b.sp, t.speaker) AND len(b.sp) <= 2 AND t.start_ms - b.last_ <= 10000) AND NOT (t.start_ms - b.last_ <= 6500 AND {shared(top_words("b.words"), top_words("t.ws"))} >= 0.25::DOUBLE) AS cut
      FROM bw b JOIN wt t ON t.source_id = b.source_id AND t.k = b.k + 1)),
  numbered AS (SELECT wt.*, bw.block_no FROM wt JOIN bw USING (source_id, k))"""


@query(
    f"""WITH RECURSIVE {BRIDGED}, g AS (SELECT source_id, block_no, arg_min(start_ms, turn_id) AS start_ms, arg_max(end_ms, turn_id) AS end_ms, count(*) AS turn_count, list(speaker ORDER BY turn_id) AS sp FROM numbered GROUP BY ALL)
    SELECT source_id, block_no, 'conv_' || left(sha1(source_id || '|' || start_ms || '|' || end_ms || '|' || turn_count), 12) AS conversation_id, start_ms, end_ms, turn_count, array_to_string(list_filter(sp, lambda x, i: list_position(sp, x) = i), ',') AS speakers FROM g"""
)
def conversation_blocks_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.blocks(grouping.bridged_blocks(spoken(spark, sf_dir)))
    return found.select("source_id", "block_no", "conversation_id", "start_ms", "end_ms", "turn_count", F.array_join("speakers", ",").alias("speakers"))


RANKED_SCORES = ", ".join(f"round({score('text', getattr(lexicons, n))}, 4) AS {n.lower()}_score" for n in ("HOOK", "CONFLICT", "ESCALATION", "EMOTION", "PAYOFF"))


@query(
    f"""WITH {BLOCKS}, s AS (SELECT source_id, block_no, start_ms, end_ms, turn_count, len(speakers)::BIGINT AS n_speakers, {RANKED_SCORES} FROM blocks)
    SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY hook_score + payoff_score DESC, turn_count DESC, block_no) AS rank FROM s"""
)
def ranked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.blocks(gap_blocked(spark, sf_dir))
    scores = [F.round(text.lexicon_score(F.col("text"), getattr(lexicons, n)), 4).alias(f"{n.lower()}_score") for n in ("HOOK", "CONFLICT", "ESCALATION", "EMOTION", "PAYOFF")]
    scored = found.select("source_id", "block_no", "start_ms", "end_ms", "turn_count", F.size("speakers").alias("n_speakers"), *scores)
    order = Window.partitionBy("source_id").orderBy((F.col("hook_score") + F.col("payoff_score")).desc(), F.desc("turn_count"), "block_no")
    return scored.withColumn("rank", F.row_number().over(order))



@query(
    f"""WITH {BLOCKS}, w AS (SELECT source_id, block_no, turn_id, unnest({TOPIC_WORDS}) AS word, generate_subscripts({TOPIC_WORDS}, 1) AS pos FROM numbered),
    c AS (SELECT source_id, block_no, word, count(*) AS n, min(turn_id * 1000000 + pos) AS f FROM w GROUP BY ALL)
    SELECT source_id, block_no, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id, block_no ORDER BY n DESC, f) AS rank FROM c) WHERE rank <= 8"""
)
def topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.ranked_topics(gap_blocked(spark, sf_dir), ["source_id", "block_no"])


@query(
    f"""SELECT conv_id, turn, {cascade("text", lexicons.HOOK_TYPES, "'balanced_hook'")} AS hook_type,
    CASE WHEN {squeezed("text")} = '' THEN 'unfinished' ELSE {cascade("text", lexicons.PAYOFF_TYPES, "'resolution'")} END AS payoff_type,
    {cascade("text", lexicons.CONFLICT_TYPES, f"CASE WHEN len({hits('text', lexicons.CONFLICT)}) > 0 THEN 'argument' ELSE 'none' END")} AS conflict_type,
    {cascade("text", lexicons.SCENE_MOODS, "'neutral'")} AS mood FROM conversations"""
)
def story_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.adapters import table

    said = F.col("text")
    conflict = text.conflict_type(text.hits(said, lexicons.CONFLICT), said)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.hook_type(said).alias("hook_type"), text.payoff_type(said).alias("payoff_type"), conflict.alias("conflict_type"), text.scene_mood(said).alias("mood"))


def with_payoffs(frags: DataFrame) -> DataFrame:
    """Chains of fragments with roles, extended by payoffs of later blocks. Fragments are read twice, so they are kept."""
    frags = frags.persist()
    best = F.max_by(F.struct(text.squeeze(F.col("transcript")).alias("t"), "end_ms"), F.struct(F.greatest("payoff_score", F.when(F.col("role") == "payoff", 0.25).otherwise(0.0)), -F.col("frag_no")))
    words = F.array_distinct(F.flatten(F.collect_list(text.topic_words(F.col("transcript")))))
    blocks = frags.groupBy("source_id", "block_no").agg(F.min("start_ms").alias("start_ms"), F.array_distinct(F.flatten(F.collect_list("speakers"))).alias("speakers"), words.alias("topic_words"), best.alias("b"))
    blocks = blocks.select("source_id", "block_no", "start_ms", "speakers", "topic_words", F.col("b.t").alias("payoff_text"), F.col("b.end_ms").alias("payoff_end_ms"))
    return story.extend_payoff(story.chains(frags), blocks)


def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_payoffs(told(spark, sf_dir))


def turn_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments with roles of blocks by gaps, every turn a fragment: no fold comes before, so SQL can say the same."""
    nth = F.row_number().over(Window.partitionBy("source_id", "block_no").orderBy("turn_id")) - 1
    return story.roles(story.fragments(gap_blocked(spark, sf_dir).withColumn("frag_no", nth)))


BLOCK = "PARTITION BY source_id, block_no"
TELLING = ("HOOK", "CONFLICT", "ESCALATION", "EMOTION", "PAYOFF")
ROLES = rf"""{BLOCKS}, fr AS (SELECT source_id, block_no, row_number() OVER ({BLOCK} ORDER BY turn_id) AS nth, count(*) OVER ({BLOCK}) AS of_, start_ms, end_ms, speaker, text AS transcript,
    {', '.join(f"{score('text', getattr(lexicons, n))} AS {n.lower()}_score" for n in TELLING)}, {hits('text', lexicons.CONFLICT)} AS conflict_signals, {hits('text', lexicons.EMOTION)} AS emotion_signals FROM numbered),
  sc AS (SELECT *, hook_score + CASE WHEN nth = 1 THEN 0.15 ELSE 0.0 END AS h, payoff_score + 0.3 * emotion_score + CASE WHEN nth = of_ THEN 0.15 ELSE 0.0 END AS p, conflict_score + escalation_score AS e FROM fr),
  r1 AS (SELECT *, row_number() OVER ({BLOCK} ORDER BY h DESC, nth) = 1 AS is_h, row_number() OVER ({BLOCK} ORDER BY p DESC, nth) = 1 AS is_p, row_number() OVER ({BLOCK} ORDER BY nth = 1, p DESC, nth DESC) = 1 AS second_ FROM sc),
  r2 AS (SELECT *, bool_or(is_h AND is_p AND nth = 1 AND of_ > 1) OVER ({BLOCK}) AS both_ FROM r1),
  r3 AS (SELECT *, CASE WHEN both_ THEN CASE WHEN nth = 1 THEN 'hook_setup' WHEN second_ THEN 'payoff' END WHEN is_p THEN 'payoff' WHEN is_h THEN 'hook' END AS role0 FROM r2),
  r4 AS (SELECT *, row_number() OVER ({BLOCK} ORDER BY role0 IS NOT NULL, e DESC, nth DESC) = 1 AS peak FROM r3),
  told AS (SELECT *, nth - 1 AS frag_no, coalesce(role0, CASE WHEN peak AND e > 0 THEN 'escalation' ELSE 'setup' END) AS role FROM r4)"""


@query(f"WITH {ROLES} SELECT source_id, block_no, frag_no, role, round(h, 4) AS hook, round(p, 4) AS payoff, round(e, 4) AS tension FROM told")
def story_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turn_told(spark, sf_dir)
    of = F.count("*").over(Window.partitionBy("source_id", "block_no"))
    hook = F.col("hook_score") + F.when(F.col("frag_no") == 0, 0.15).otherwise(0.0)
    payoff = F.col("payoff_score") + 0.3 * F.col("emotion_score") + F.when(F.col("frag_no") == of - 1, 0.15).otherwise(0.0)
    return found.select("source_id", "block_no", "frag_no", "role", F.round(hook, 4).alias("hook"), F.round(payoff, 4).alias("payoff"), F.round(F.col("conflict_score") + F.col("escalation_score"), 4).alias("tension"))


def first_text(of: str, test: str) -> str:
    return f"coalesce((list_filter({of}, lambda x: ({test}) AND x.t <> ''))[1].t, '')"


def distinct(values: str) -> str:
    """SQL of a list's values, each once, in order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def completion(chain: str) -> str:
    filled = "((hook <> '')::INT + (setup <> '')::INT + (escalation <> '')::INT + (payoff <> '')::INT)"
    return f"SELECT *, {listed(lexicons.ARC_SHAPES)}[{filled} + 1] AS arc_shape, {filled} * 0.25::DOUBLE AS completion_score, {filled} = 4 AS is_complete FROM {chain}"


def said_words(said: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({said}), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 4 AND NOT list_contains({listed(lexicons.STOP_WORDS)}, w))"


CHAINS = rf"""{ROLES}, pk AS (SELECT source_id, block_no, list({{'nth': nth, 'role': role, 't': {squeezed("transcript")}, 's': speaker, 'c': conflict_signals, 'm': emotion_signals, 'a': start_ms, 'z': end_ms}} ORDER BY nth) AS f FROM told GROUP BY ALL),
  c1 AS (SELECT *, coalesce(nullif({first_text('f', "x.role = 'hook'")}, ''), nullif({first_text('f', "x.role = 'hook_setup'")}, ''), f[1].t) AS hook FROM pk),
  c2 AS (SELECT *, coalesce(nullif({first_text('f', "x.role = 'setup'")}, ''), CASE WHEN len(f) > 1 THEN {first_text('f[2:]', "x.role NOT IN ('hook', 'payoff', 'escalation')")} END, '') AS setup FROM c1),
  c3 AS (SELECT *, coalesce(nullif({first_text('f', "x.role = 'escalation'")}, ''), CASE WHEN len(f) > 2 THEN {first_text('f', "x.role NOT IN ('hook', 'setup', 'payoff', 'hook_setup') AND x.t <> hook AND x.t <> setup")} END, '') AS escalation FROM c2),
  c4 AS (SELECT *, coalesce(nullif({first_text('f', "x.role = 'payoff'")}, ''), CASE WHEN f[-1].t <> '' AND (len(f) > 1 OR f[-1].t <> hook) THEN f[-1].t END, '') AS payoff, f[1].a AS start_ms, f[-1].z AS end_ms, len(f) AS fragments,
    {distinct("list_transform(f, lambda y: y.s)")} AS speakers, array_to_string({distinct("flatten(list_transform(f, lambda y: y.c))")}, ' ') AS signals, list_filter(flatten(list_transform(f, lambda y: y.m)), lambda x: true)[1] AS emotion, list_sort(list_distinct({said_words("array_to_string(list_transform(f, lambda y: y.t), ' ')")})) AS topic_words FROM c3),
  chain AS ({completion("c4")})"""
TENSE = "trim(signals || ' ' || escalation)"
WORDS3 = rf"list_filter(regexp_extract_all(lower(every), '[\p{{L}}\p{{N}}_'']+'), lambda x: length(x) > 2)"
PLAIN3 = f"list_filter({WORDS3}, lambda x: length(x) >= 4 AND NOT list_contains({listed(lexicons.STOP_WORDS)}, x))"
SUMMARIES = rf"""{CHAINS}, e0 AS (SELECT *, {squeezed("concat_ws(' ', hook, setup, escalation, payoff)")} AS every, {squeezed("concat_ws(' ', hook, escalation, CASE WHEN payoff <> '' AND payoff <> hook AND payoff <> escalation THEN payoff ELSE '' END)")} AS told_ FROM chain),
  e1 AS (SELECT *, {PLAIN3} AS plain, CASE WHEN len({PLAIN3}) > 0 THEN {PLAIN3} ELSE {WORDS3} END AS picked FROM e0),
  e2 AS (SELECT *, CASE WHEN len(speakers) > 0 THEN 0.25 ELSE 0.0 END + CASE WHEN len(plain) > 0 THEN 0.25 ELSE 0.0 END + CASE WHEN setup <> '' THEN 0.25 ELSE 0.0 END + CASE WHEN escalation <> '' THEN 0.25 ELSE 0.0 END AS context_completeness FROM e1),
  summed AS (SELECT *, array_to_string(string_split(told_, ' ')[1:20], ' ') AS title_seed, {cascade("hook", lexicons.HOOK_TYPES, "'balanced_hook'")} AS hook_type,
    CASE WHEN {squeezed("payoff")} = '' THEN 'unfinished' ELSE {cascade("payoff", lexicons.PAYOFF_TYPES, "'resolution'")} END AS payoff_type, {cascade(TENSE, lexicons.CONFLICT_TYPES, "CASE WHEN signals <> '' THEN 'argument' ELSE 'none' END")} AS conflict_type,
    array_to_string(list_filter(picked, lambda x, i: list_position(picked, x) = i)[1:5], ' ') AS topic_phrase, round(least(1.0, 0.25 + completion_score * 0.35 + context_completeness * 0.35), 4) AS confidence FROM e2)"""
ASSEMBLED = ("source_id", "block_no", "hook", "setup", "escalation", "payoff", "arc_shape", "conflict_type", "completion_score", "is_complete", "start_ms", "end_ms", "fragments", "title_seed", "hook_type", "payoff_type", "topic_phrase", "context_completeness", "confidence")


@query(f"WITH {SUMMARIES} SELECT {', '.join(ASSEMBLED)}, array_to_string(topic_words, ',') AS topics FROM summed")
def chain_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains and their summaries, every turn a fragment."""
    return story.summaries(story.chains(turn_told(spark, sf_dir))).select(*ASSEMBLED, F.array_join("topic_words", ",").alias("topics"))


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / greatest(len({a}), len({b}))::DOUBLE ELSE 0.0 END"


EXTENDED = rf"""{CHAINS}, bs AS (SELECT source_id, block_no, min(start_ms) AS b_start, list_distinct(list(lower(speaker))) AS b_speakers, list_distinct(flatten(list({said_words("transcript")}))) AS b_words,
    arg_max({squeezed("transcript")}, [greatest(payoff_score, CASE WHEN role = 'payoff' THEN 0.25 ELSE 0.0 END), -frag_no]) AS b_text, arg_max(end_ms, [greatest(payoff_score, CASE WHEN role = 'payoff' THEN 0.25 ELSE 0.0 END), -frag_no]) AS b_end FROM told GROUP BY ALL),
  hit AS (SELECT c.source_id, c.block_no, min(b.block_no) AS payoff_block FROM chain c JOIN bs b ON c.source_id = b.source_id AND NOT c.is_complete AND b.b_start BETWEEN c.end_ms AND c.end_ms + 180000 AND b.b_text <> ''
    AND ({overlap("list_transform(c.speakers, lambda s: lower(s))", "b.b_speakers")} >= 0.3 OR {overlap("c.topic_words", "b.b_words")} >= 0.18) GROUP BY ALL),
  x0 AS (SELECT c.source_id, c.block_no, c.hook, c.setup, c.escalation, CASE WHEN hit.payoff_block IS NOT NULL AND c.payoff = '' THEN b.b_text ELSE c.payoff END AS payoff, c.start_ms, CASE WHEN hit.payoff_block IS NULL THEN c.end_ms ELSE greatest(c.end_ms, b.b_end) END AS end_ms,
    hit.payoff_block IS NOT NULL AS extended, hit.payoff_block FROM chain c LEFT JOIN hit USING (source_id, block_no) LEFT JOIN bs b ON b.source_id = c.source_id AND b.block_no = hit.payoff_block),
  ext AS ({completion("x0")})"""


@query(f"WITH {EXTENDED} SELECT source_id, block_no, extended, coalesce(payoff_block, -1) AS payoff_block, end_ms, arc_shape, completion_score, is_complete FROM ext")
def chain_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_payoffs(turn_told(spark, sf_dir)).fillna(-1, ["payoff_block"]).select("source_id", "block_no", "extended", "payoff_block", "end_ms", "arc_shape", "completion_score", "is_complete")


@query(
    f"""WITH {EXTENDED}, m AS (SELECT *, end_ms - start_ms AS duration_ms, end_ms - start_ms >= 6000 AND (end_ms - start_ms >= 20000 OR completion_score >= 0.75 OR is_complete) AS passes FROM ext),
    k AS (SELECT *, bool_or(passes) OVER (PARTITION BY source_id) AS some_ FROM m)
    SELECT source_id, block_no, duration_ms, extended, completion_score, row_number() OVER (PARTITION BY source_id ORDER BY is_complete DESC, completion_score >= 0.75 DESC, extended DESC, completion_score DESC, duration_ms DESC, duration_ms < 20000, block_no) AS rank
    FROM k WHERE passes OR (NOT some_ AND duration_ms >= 10000)"""
)
def chain_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = story.publishable_chains(with_payoffs(turn_told(spark, sf_dir)), 20_000)
    return kept.select("source_id", "block_no", "duration_ms", "extended", "completion_score", "rank")


#: Fragments of bridged blocks, by walking each block, with roles. The SQL after it is that of turns as fragments.
CHUNKED = rf"""{BRIDGED}, nt AS (SELECT *, row_number() OVER ({BLOCK} ORDER BY turn_id) AS i, {score("text", lexicons.CONFLICT)}::DOUBLE AS con, {score("text", lexicons.PAYOFF)}::DOUBLE AS pay, {score("text", lexicons.HOOK)}::DOUBLE AS hoo FROM numbered),
  fw AS (SELECT source_id, block_no, i, ws AS cw, 0.0::DOUBLE + con AS cs, 1 AS cn, start_ms AS c0, end_ms AS pe, speaker AS ps, false AS cut, 0::BIGINT AS gap FROM nt WHERE i = 1
    UNION ALL SELECT source_id, block_no, i, CASE WHEN cut THEN ws ELSE list_concat(cw, ws) END, CASE WHEN cut THEN con ELSE cs + con END, CASE WHEN cut THEN 1 ELSE cn + 1 END, CASE WHEN cut THEN start_ms ELSE c0 END, end_ms, speaker, cut, gap
    FROM (SELECT *, (gap > 2500 AND same = 0 AND speaker <> ps) OR (gap >= 500 AND cs / cn >= 0.3::DOUBLE AND pay >= 0.25::DOUBLE) OR (pe - c0 >= 20000 AND cn >= 3 AND same <= 0.1::DOUBLE AND gap > 1000) OR (speaker <> ps AND gap > 800 AND cn >= 2 AND greatest(hoo, con) >= 0.2::DOUBLE) AS cut
      FROM (SELECT n.*, w.cw, w.cs, w.cn, w.c0, w.pe, w.ps, n.start_ms - w.pe AS gap, {shared(top_words("w.cw"), top_words("n.ws"))} AS same FROM fw w JOIN nt n ON n.source_id = w.source_id AND n.block_no = w.block_no AND n.i = w.i + 1))),
  kc AS (SELECT *, cut AND row_number() OVER ({BLOCK} ORDER BY cut DESC, gap DESC, i DESC) <= 5 AS kept FROM fw),
  nf AS (SELECT nt.*, sum(kept::INT) OVER (PARTITION BY nt.source_id, nt.block_no ORDER BY nt.i) AS fno FROM nt JOIN kc USING (source_id, block_no, i)),
  nl AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY source_id, block_no, fno ORDER BY turn_id) AS quiet FROM nf),
  fg AS (SELECT source_id, block_no, fno, arg_min(start_ms, turn_id) AS start_ms, arg_max(end_ms, turn_id) AS end_ms, count(*) AS turn_count, list(speaker ORDER BY turn_id) AS sp, coalesce(trim(string_agg(text, ' ' ORDER BY turn_id) FILTER (text <> '')), '') AS text,
    coalesce(string_agg(quiet::VARCHAR, ',' ORDER BY turn_id) FILTER (quiet > 300), '') AS pauses_ms FROM nl GROUP BY ALL),
  fr AS (SELECT source_id, block_no, row_number() OVER ({BLOCK} ORDER BY fno) AS nth, count(*) OVER ({BLOCK}) AS of_, start_ms, end_ms, list_filter(sp, lambda x, i: list_position(sp, x) = i) AS speaker, text AS transcript, turn_count, pauses_ms, array_to_string({hits('text', lexicons.CAUSAL)}, ',') AS causal,
    {', '.join(f"{score('text', getattr(lexicons, n))} AS {n.lower()}_score" for n in TELLING)}, {hits('text', lexicons.CONFLICT)} AS conflict_signals, {hits('text', lexicons.EMOTION)} AS emotion_signals FROM fg)"""


def folded(sql: str) -> str:
    """SQL over turns as fragments, over fragments with lists of speakers instead."""
    sql = sql.replace(ROLES[: ROLES.index(",\n  sc AS")], CHUNKED)
    return sql.replace("list_transform(f, lambda y: y.s)", "flatten(list_transform(f, lambda y: y.s))").replace("list_distinct(list(lower(speaker)))", "list_distinct(list_transform(flatten(list(speaker)), lambda s: lower(s)))")


@query(
    f"WITH RECURSIVE {folded(ROLES)} SELECT source_id, block_no, frag_no, role, start_ms, end_ms, turn_count, {', '.join(f'round({n.lower()}_score, 4) AS {n.lower()}_score' for n in TELLING)}, causal, pauses_ms FROM told"
)
def story_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = told(spark, sf_dir)
    scores = [F.round(f"{n}_score", 4).alias(f"{n}_score") for n in ("hook", "conflict", "escalation", "emotion", "payoff")]
    return found.select("source_id", "block_no", "frag_no", "role", "start_ms", "end_ms", "turn_count", *scores, F.array_join("causal_signals", ",").alias("causal"), F.array_join(F.transform("pauses_ms", lambda x: x.cast("string")), ",").alias("pauses_ms"))


@query(
    f"WITH RECURSIVE {folded(SUMMARIES)} SELECT source_id, block_no, arc_shape, conflict_type, completion_score, is_complete, start_ms, end_ms, fragments, title_seed, hook_type, payoff_type, topic_phrase, context_completeness::DOUBLE AS context_completeness, confidence FROM summed"
)
def story_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = story.summaries(story.chains(told(spark, sf_dir)))
    return found.select("source_id", "block_no", "arc_shape", "conflict_type", "completion_score", "is_complete", "start_ms", "end_ms", "fragments", "title_seed", "hook_type", "payoff_type", "topic_phrase", "context_completeness", "confidence")


@query(f"WITH RECURSIVE {folded(EXTENDED)} SELECT source_id, block_no, extended, coalesce(payoff_block, -1) AS payoff_block, end_ms, arc_shape, completion_score, is_complete FROM ext")
def payoff_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extended(spark, sf_dir).fillna(-1, ["payoff_block"]).select("source_id", "block_no", "extended", "payoff_block", "end_ms", "arc_shape", "completion_score", "is_complete")


@query(
    f"""WITH RECURSIVE {folded(EXTENDED)}, m AS (SELECT *, end_ms - start_ms AS duration_ms, end_ms - start_ms >= 6000 AND (end_ms - start_ms >= 20000 OR completion_score >= 0.75 OR is_complete) AS passes FROM ext),
    k AS (SELECT *, bool_or(passes) OVER (PARTITION BY source_id) AS some_ FROM m)
    SELECT source_id, block_no, row_number() OVER (PARTITION BY source_id ORDER BY is_complete DESC, completion_score >= 0.75 DESC, extended DESC, completion_score DESC, duration_ms DESC, duration_ms < 20000, block_no) AS rank, arc_shape, completion_score, is_complete, extended, start_ms, end_ms, duration_ms, hook
    FROM k WHERE passes OR (NOT some_ AND duration_ms >= 10000)"""
)
def episode_story_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: segments to turns, blocks, fragments, chains, extension, filter and rank."""
    kept = story.publishable_chains(extended(spark, sf_dir), 20_000)
    return kept.select("source_id", "block_no", "rank", "arc_shape", "completion_score", "is_complete", "extended", "start_ms", "end_ms", "duration_ms", "hook")


CHECKS = f"""WITH {EXTENDED}, s AS (SELECT *, (end_ms - start_ms) / 1000.0 AS length_ FROM ext)
    SELECT count(*) AS chains, round(count(*) FILTER (is_complete) / count(*), 4) AS complete_rate, round(count(*) FILTER (payoff <> '') / count(*), 4) AS payoff_rate, round(avg(completion_score), 4) AS mean_completion, round(avg(length_), 4) AS mean_seconds,
      count(*) FILTER (length_ < 6) AS under_6, count(*) FILTER (length_ >= 6 AND length_ < 20) AS from_6, count(*) FILTER (length_ >= 20 AND length_ < 35) AS from_20, count(*) FILTER (length_ >= 35 AND length_ < 60) AS from_35, count(*) FILTER (length_ >= 60) AS from_60 FROM s"""


@query(CHECKS)
def chain_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.chain_validation(with_payoffs(turn_told(spark, sf_dir)))


@query(
    f"""WITH {SUMMARIES}, ab AS (SELECT source_id, block_no, arg_min(start_ms, turn_id) AS a, arg_max(end_ms, turn_id) AS z, count(*) AS n, count(DISTINCT CASE WHEN trim(speaker) <> '' THEN speaker END) AS k FROM numbered GROUP BY ALL),
    sg AS (SELECT source_id, block_no, string_agg(role || ':' || round(start_ms / 1000.0, 3)::DECIMAL(12,3) || '-' || round(end_ms / 1000.0, 3)::DECIMAL(12,3), ',' ORDER BY nth) AS segments FROM told GROUP BY ALL), j AS (SELECT *, greatest(0.0, (z - a) / 1000.0::DOUBLE) AS d FROM summed JOIN ab USING (source_id, block_no) JOIN sg USING (source_id, block_no))
    SELECT source_id, block_no, arc_shape, confidence, round(d, 3) AS duration, n AS turn_count, k AS speaker_count, segments,
      least(1.0, round(completion_score + CASE WHEN n >= 2 THEN 0.05 ELSE 0.0 END + CASE WHEN d >= 25 THEN 0.05 ELSE 0.0 END + CASE WHEN d <= 60 THEN 0.05 ELSE 0.0 END + CASE WHEN k >= 2 THEN 0.05 ELSE 0.0 END, 4)) AS clarity_score, round(greatest(0.0, (25.0 - d) / 25.0), 4) AS duration_penalty FROM j"""
)
def story_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of blocks by gaps, every turn a fragment."""
    nth = F.row_number().over(Window.partitionBy("source_id", "block_no").orderBy("turn_id")) - 1
    made = story.plans(gap_blocked(spark, sf_dir).withColumn("frag_no", nth))
    shown = F.transform("window_segments", lambda x: F.concat(x["role"], F.lit(":"), x["start"].cast("decimal(12,3)").cast("string"), F.lit("-"), x["end"].cast("decimal(12,3)").cast("string")))
    plan = [F.col(f"window_plan.{c}").alias(c) for c in ("duration", "turn_count", "speaker_count")]
    return made.select("source_id", "block_no", "arc_shape", "confidence", *plan, F.array_join(shown, ",").alias("segments"), "clarity_score", "duration_penalty")


@query(
    f"""WITH {EXTENDED}, f AS (SELECT source_id, block_no, len(f) AS n FROM pk) SELECT source_id, block_no, round(start_ms / 1000.0::DOUBLE, 3) AS start, round(end_ms / 1000.0::DOUBLE, 3) AS end, round(greatest(0.0, round(end_ms / 1000.0::DOUBLE, 3) - round(start_ms / 1000.0::DOUBLE, 3)), 3) AS duration,
    'story_chain' AS story_unit_type, completion_score AS score, is_complete, extended AS search_extended, arc_shape, hook <> '' AS hook_filled, payoff <> '' AS payoff_filled, n AS estimated_turns FROM ext JOIN f USING (source_id, block_no)"""
)
def story_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = story.candidates(with_payoffs(turn_told(spark, sf_dir)))
    parts = [F.col(f"score_breakdown.{c}").alias(c) for c in ("arc_shape", "hook_filled", "payoff_filled")]
    return made.select("source_id", "block_no", "start", "end", "duration", "story_unit_type", "score", "is_complete", "search_extended", *parts, "estimated_turns")


@query(
    rf"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower({squeezed("text")}), '[\p{{L}}\p{{N}}_'']+')) AS word, generate_subscripts(regexp_extract_all(lower({squeezed("text")}), '[\p{{L}}\p{{N}}_'']+'), 1) AS pos FROM conversations),
    c AS (SELECT conv_id, turn, word, count(*) AS n, min(pos) AS f FROM w WHERE length(word) > 3 AND NOT list_contains({listed(lexicons.STOP_WORDS)}, word) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, f) AS k FROM c)
    SELECT conv_id, turn, string_agg(word, ',' ORDER BY k) AS terms FROM r WHERE k <= 4 GROUP BY ALL"""
)
def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.adapters import table

    return story.topic_terms(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.col("text")).select("conv_id", "turn", F.array_join("terms", ",").alias("terms"))


CAPTION = r"""CASE WHEN len(w) <= 2 THEN array_to_string(w, ' ') WHEN k >= len(w) THEN array_to_string(w, ' ') ELSE array_to_string(w[1:k], ' ') || chr(10) || array_to_string(w[k + 1:], ' ') END"""


@query(
    rf"""WITH {TURNS}, w AS (SELECT *, string_split({squeezed("text")}, ' ') AS w FROM turns),
    k AS (SELECT *, greatest(1, len(list_filter(range(1, len(w) + 1), lambda i: length(array_to_string(w[1:i], ' ')) <= 34))) AS k FROM w)
    SELECT source_id, turn_id, {CAPTION} AS caption, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS start_text FROM k"""
)
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir).select("source_id", "turn_id", text.caption_lines(F.col("text")).alias("caption"), text.timestamp(F.col("start_ms")).alias("start_text"))


@query(
    rf"""WITH {TURNS}, w AS (SELECT source_id, turn_id, list_transform(string_split({squeezed("text")}, ' '), lambda x: length(x)) AS n FROM turns),
    s AS (SELECT source_id, turn_id, n, unnest(range(1, len(n))) AS k FROM w WHERE len(n) > 2),
    c AS (SELECT source_id, turn_id, k, len(n) AS m, list_sum(n[1:k]) + k - 1 AS a, list_sum(n[k + 1:]) + len(n) - k - 1 AS b FROM s)
    SELECT source_id, turn_id, arg_min(k, (greatest(0, a - 34) + greatest(0, b - 34)) * 20 * 1000000 + (abs(a - b) + CASE WHEN least(k, m - k) = 1 THEN 3 ELSE 0 END) * 1000000 + k) AS first_line_words FROM c GROUP BY ALL"""
)
def caption_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(text.squeeze(F.col("text")), " ")
    rows = spoken(spark, sf_dir).select("source_id", "turn_id", text.line_split(F.transform(words, F.length)).alias("first_line_words"))
    return rows.where("first_line_words is not null")


def sql_tidy(said: str) -> str:
    return rf"replace(regexp_replace({squeezed(said)}, ' +([,.:;!?])', '\1', 'g'), ' - ', ' ')"


#: Segments in the order in which captions are walked.
EVENTS = f"""{SEGMENTS}, ev AS (SELECT source_id::VARCHAR AS source_id, start_ms, end_ms, text, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, text) AS k FROM seg)"""
#: Each event with its times and state, and what becomes of the end of the one before it.
STEADY = f"""{EVENTS}, d AS (SELECT *, greatest(0, start_ms) // 10 * 10 AS a, greatest(greatest(0, start_ms) // 10 * 10 + 10, (end_ms + 9) // 10 * 10) AS z FROM ev),
    st AS (SELECT source_id, k, a AS s, z AS e, text, 'show_phrase' AS state, NULL::BIGINT AS before_ FROM d WHERE k = 1
      UNION ALL SELECT source_id, k, now_, CASE WHEN z <= now_ THEN now_ + 120 ELSE z END, text, CASE WHEN gap > 0 AND gap <= 900 THEN changed WHEN gap > 0 AND age >= 2200 THEN 'show_phrase' WHEN gap > 0 AND gap <= 1200 THEN changed WHEN gap > 0 AND gap <= 4000 THEN 'replace_phrase' ELSE 'show_phrase' END,
        CASE WHEN gap > 0 AND gap <= 900 THEN now_ WHEN gap > 0 AND age >= 2200 THEN now_ WHEN gap > 0 AND gap <= 1200 THEN least(now_, e + 480) WHEN gap > 0 AND gap <= 4000 THEN now_ ELSE e END
      FROM (SELECT d.*, greatest(d.a, st.e) AS now_, greatest(d.a, st.e) - st.e AS gap, st.e - st.s AS age, st.e, CASE WHEN d.text <> st.text THEN 'replace_phrase' ELSE 'hold_phrase' END AS changed FROM st JOIN d ON d.source_id = st.source_id AND d.k = st.k + 1)),
    steady AS (SELECT source_id, k - 1 AS nth, s AS start_ms, coalesce(lead(before_) OVER (PARTITION BY source_id ORDER BY k), e) AS end_ms, text, state FROM st)"""


@query(
    f"WITH RECURSIVE {STEADY} SELECT * FROM steady"
)
def timeline_stabilize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.stable_timeline(segments(spark, sf_dir))


@query(
    f"WITH RECURSIVE {STEADY} SELECT source_id, count(*) AS events, count(*) FILTER (state = 'replace_phrase') AS replaced, round(quantile_cont((end_ms - start_ms)::DOUBLE, 0.95), 4) AS hold_p95_ms FROM steady GROUP BY source_id"
)
def timeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.timeline_stats(captions.stable_timeline(segments(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {EVENTS}, sq AS (SELECT source_id, start_ms, end_ms, {squeezed("text")} AS t FROM ev), sk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, t) AS k FROM sq WHERE t <> ''),
    ma AS (SELECT source_id, k, start_ms AS s, end_ms AS e, t, 1 AS part FROM sk WHERE k = 1
      UNION ALL SELECT source_id, k, CASE WHEN j THEN s ELSE start_ms END, CASE WHEN j THEN greatest(e, end_ms) ELSE end_ms END, CASE WHEN j THEN m || ' ' || t ELSE t END, CASE WHEN j THEN part ELSE part + 1 END
      FROM (SELECT sk.*, ma.s, ma.e, ma.t AS m, ma.part, sk.start_ms - ma.e <= 220 AND least(length(ma.t), length(sk.t)) <= 28 AND length(ma.t) + length(sk.t) <= 52 AND NOT regexp_matches(ma.t, '[.!?…]$') AS j FROM ma JOIN sk ON sk.source_id = ma.source_id AND sk.k = ma.k + 1)),
    mb AS (SELECT source_id, arg_max(s, k) AS start_ms, arg_max(e, k) AS end_ms, arg_max(t, k) AS t FROM ma GROUP BY source_id, part), mk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, t) AS k FROM mb),
    mc AS (SELECT source_id, k, start_ms AS s, end_ms AS e, t, 1 AS part FROM mk WHERE k = 1
      UNION ALL SELECT source_id, k, CASE WHEN j THEN s ELSE start_ms END, CASE WHEN j THEN greatest(e, end_ms) ELSE end_ms END, CASE WHEN j THEN m || ' ' || t ELSE t END, CASE WHEN j THEN part ELSE part + 1 END
      FROM (SELECT mk.*, mc.s, mc.e, mc.t AS m, mc.part, mk.start_ms - mc.e <= 1000 AND len(string_split(mc.t || ' ' || mk.t, ' ')) <= 12 AND NOT regexp_matches(mc.t, '[.!?…]$') AS j FROM mc JOIN mk ON mk.source_id = mc.source_id AND mk.k = mc.k + 1))
    SELECT source_id, part - 1 AS nth, arg_max(s, k) AS start_ms, arg_max(e, k) AS end_ms, arg_max(t, k) AS text FROM mc GROUP BY source_id, part"""
)
def caption_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.short_silences(captions.merged_segments(segments(spark, sf_dir)))


#: Words of segments with shared-out times, and the sentences that they are cut into, by walking each source.
SENTENCES = f"""{SEGMENTS}, wl AS (SELECT source_id::VARCHAR AS source_id, start_ms, end_ms, string_split({sql_tidy("text")}, ' ') AS l FROM seg),
    wv AS (SELECT source_id, start_ms + (end_ms - start_ms) * (i - 1) // len(l) AS s, start_ms + (end_ms - start_ms) * i // len(l) AS e, l[i] AS w FROM wl, unnest(range(1, len(l) + 1)) AS u(i) WHERE l[i] <> ''),
    wk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s, e, w) AS k, regexp_matches(w, '[.!?…]$') AS stop, regexp_matches(w, '[,;:]$') AS soft FROM wv),
    wr AS (SELECT source_id, k, s, e, w, 1 AS n, 0::BIGINT AS nth, stop AS done FROM wk WHERE k = 1
      UNION ALL SELECT source_id, k, s, e, w, m, CASE WHEN fresh THEN nth + 1 ELSE nth END, stop OR (soft AND m >= 4) OR m >= 8
      FROM (SELECT wk.*, wr.nth, wr.done OR wk.s - wr.e >= 450 AS fresh, CASE WHEN wr.done OR wk.s - wr.e >= 450 THEN 1 ELSE wr.n + 1 END AS m FROM wr JOIN wk ON wk.source_id = wr.source_id AND wk.k = wr.k + 1)),
    sen AS (SELECT source_id, nth, arg_min(s, k) AS start_ms, arg_max(e, k) AS end_ms, string_agg(w, ' ' ORDER BY k) AS text, list(w ORDER BY k) AS l FROM wr GROUP BY source_id, nth)"""


@query(
    f"WITH RECURSIVE {SENTENCES} SELECT source_id, nth, start_ms, end_ms, text FROM sen"
)
def caption_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.sentences(captions.word_events(segments(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {SENTENCES} SELECT source_id, nth, i - 1 AS k, start_ms + (end_ms - start_ms) * (i - 1) // len(l) AS start_ms, start_ms + (end_ms - start_ms) * i // len(l) AS end_ms, array_to_string(list_transform(l, lambda w, j: CASE WHEN j = i THEN '[' || w || ']' ELSE w END), ' ') AS text
    FROM sen, unnest(range(1, len(l) + 1)) AS u(i)"""
)
def highlight_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.highlight_events(captions.sentences(captions.word_events(segments(spark, sf_dir))))


STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(
    rf"""WITH {SEGMENTS}, w AS (SELECT *, string_split({squeezed("text")}, ' ') AS w FROM seg), k AS (SELECT *, greatest(1, len(list_filter(range(1, len(w) + 1), lambda i: length(array_to_string(w[1:i], ' ')) <= 34))) AS k, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms) AS cue FROM w)
    SELECT source_id, cue, cue || chr(10) || {STAMP.format("start_ms")} || ' --> ' || {STAMP.format("end_ms")} || chr(10) || {CAPTION} || chr(10) AS srt FROM k"""
)
def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.srt(segments(spark, sf_dir))


@query(
    rf"""WITH {TURNS}, w AS (SELECT source_id, turn_id, string_split({squeezed("text")}, ' ') AS w FROM turns)
    SELECT source_id, turn_id, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR lower(w[i]) <> lower(w[i - 1])), lambda i: w[i]), ' ') AS text FROM w"""
)
def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.drop_repeats(F.split(text.squeeze(F.col("text")), " "))
    return spoken(spark, sf_dir).select("source_id", "turn_id", F.array_join(words, " ").alias("text"))


def sql_capital(said: str) -> str:
    return f"upper({said}[1:1]) || {said}[2:]"


FILLERS = "|".join(packaging.FILLERS)
#: SQL of normal_title() of column c: steps by name.
NORMAL = rf"""n1 AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '!!+', '!', 'g'), '\?\?+', '?', 'g'), '\.\.+', '.', 'g'), ',,+', ',', 'g'), ';;+', ';', 'g'), '::+', ':', 'g'), ' ') AS w FROM n0),
  n2 AS (SELECT *, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR lower(w[i]) <> lower(w[i - 1])), lambda i: w[i]), ' ') AS j FROM n1),
  n3 AS (SELECT *, regexp_replace(regexp_replace(j, '^(?i:(?:(?:{FILLERS}) [ ,:;\-—]*)+)', ''), '^[ ,:;\-—]+|[ ,:;\-—]+$', '', 'g') AS b FROM n2), normal AS (SELECT * EXCLUDE (w, j, b), {sql_capital("b")} AS title FROM n3)"""
#: SQL of title_quality() of a tidy title t.
QUALITY = r"""CASE WHEN t = '' THEN 0.0 ELSE greatest(0.0, least(1.0, greatest(0.0, 1.0 - least(1.0, abs(length(t) - 34.0) / 34.0)) * 0.34 + length(regexp_replace(t, '[^\p{L}]', '', 'g')) / greatest(1, length(t))::DOUBLE * 0.38
  + greatest(0.0, 1.0 - least(1.0, abs(len(string_split(t, ' ')) - 6.0) / 6.0)) * 0.22 - least(1.0, (length(regexp_replace(t, '[^,;:—-]', '', 'g')) + len(regexp_extract_all(t, '\.\.\.'))) / 4.0) * 0.18
  - CASE WHEN len(list_filter(range(2, len(string_split(t, ' ')) + 1), lambda i: lower(string_split(t, ' ')[i]) = lower(string_split(t, ' ')[i - 1]))) > 0 THEN 1.0 ELSE 0.0 END * 0.12 - CASE WHEN len(string_split(t, ' ')) < 2 THEN 0.18 ELSE 0.0 END)) END"""


def sql_trimmed(said: str, most: int) -> str:
    """SQL of trimmed_title() of a tidy text with a capital."""
    head = rf"coalesce(nullif(rtrim(regexp_extract(left({said}, {most - 1}), '^(.*) ', 1)), ''), left({said}, {most - 1}))"
    return rf"CASE WHEN length({said}) <= {most} THEN {said} ELSE regexp_replace({head}, '[,.:;!?]+$', '') || '...' END"


def packaged(made: DataFrame) -> DataFrame:
    """Title, phrases, hashtags and file name of each chain of summaries."""
    titled = made.select(
        "source_id", "block_no", packaging.trimmed_title(packaging.normal_title(F.col("title_seed")), 64).alias("title"), packaging.hook_phrase(F.col("hook_type")).alias("hook_phrase"),
        packaging.payoff_phrase(F.col("payoff_type")).alias("payoff_phrase"), F.array_join(packaging.story_hashtags(F.col("speakers"), F.col("conflict_type"), F.col("topic_phrase"), F.col("is_complete"), F.col("emotions"), arc=F.col("arc_shape")), " ").alias("hashtags"),
    )
    return packaging.output_names(titled.withColumn("key", F.col("source_id") * 1000 + F.col("block_no")), "key").drop("key")


@query(
    rf"""WITH {SEGMENTS}, g0 AS (SELECT source_id, string_agg(coalesce(text, ''), ' ' ORDER BY seg_idx) AS x, count(*) AS line_count FROM seg GROUP BY source_id), g AS (SELECT source_id, line_count, {sql_tidy("x")} AS t FROM g0),
    w AS (SELECT source_id, unnest(regexp_extract_all(lower(t), '[A-Za-zЀ-ӿ0-9'']+')) AS word FROM g), c AS (SELECT source_id, word, count(*) AS n FROM w WHERE length(word) >= 4 AND NOT list_contains({listed(packaging.RUSSIAN_STOP_WORDS + lexicons.ENGLISH_STOP_WORDS)}, word) GROUP BY ALL),
    k AS (SELECT source_id, string_agg(word, ',' ORDER BY r) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, word) AS r FROM c) WHERE r <= 4 GROUP BY source_id)
    SELECT g.source_id, CASE WHEN length(t) <= 96 THEN t WHEN rtrim(regexp_extract(left(t, 96), '^(.*) ', 1)) <> '' THEN rtrim(regexp_extract(left(t, 96), '^(.*) ', 1)) ELSE left(t, 96) END AS summary_text, coalesce(keywords, '') AS keywords,
      CASE WHEN t = '' THEN 'neutral' ELSE {cascade("t", lexicons.SCENE_MOODS, "'neutral'")} END AS mood, line_count FROM g LEFT JOIN k USING (source_id)"""
)
def subtitle_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packaging.subtitle_context(segments(spark, sf_dir), "source_id", "seg_idx", english=True)
    return made.withColumn("keywords", F.array_join("keywords", ","))


@query(
    f"""WITH RECURSIVE {SEGMENTS}, wl AS (SELECT source_id::VARCHAR AS source_id, seg_idx AS segment, start_ms, end_ms, string_split({sql_tidy("text")}, ' ') AS l FROM seg),
    wk AS (SELECT source_id, segment, i AS k, start_ms + (end_ms - start_ms) * (i - 1) // len(l) AS s, start_ms + (end_ms - start_ms) * i // len(l) AS e, l[i] AS w, length(array_to_string(l, ' ')) > 52 AS whole FROM wl, unnest(range(1, len(l) + 1)) AS u(i) WHERE l[i] <> ''),
    wr AS (SELECT *, length(w) AS size, 1 AS n, 0::BIGINT AS piece, whole AND ((length(w) >= 26 AND regexp_matches(w, '[.!?,;:]$')) OR length(w) >= 52) AS done FROM wk WHERE k = 1
      UNION ALL SELECT source_id, segment, k, s, e, w, whole, z, m, CASE WHEN done THEN piece + 1 ELSE piece END, whole AND ((z >= 26 AND regexp_matches(w, '[.!?,;:]$')) OR z >= 52 OR m >= 14)
      FROM (SELECT wk.*, wr.piece, wr.done, CASE WHEN wr.done THEN length(wk.w) ELSE wr.size + length(wk.w) + 1 END AS z, CASE WHEN wr.done THEN 1 ELSE wr.n + 1 END AS m FROM wr JOIN wk ON wk.source_id = wr.source_id AND wk.segment = wr.segment AND wk.k = wr.k + 1))
    SELECT source_id, segment, piece, arg_min(s, k) AS start_ms, arg_max(e, k) AS end_ms, string_agg(w, ' ' ORDER BY k) AS text FROM wr GROUP BY source_id, segment, piece"""
)
def caption_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long segments cut into pieces of their words."""
    seg = segments(spark, sf_dir)

    def placed(words: Column) -> Column:
        at = lambda k: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.size(words))
        return F.filter(F.transform(words, lambda w, k: F.struct(at(k).alias("start_ms"), at(k + 1).alias("end_ms"), w.alias("text"))), lambda w: w["text"] != "")

    words = text.bound(F.split(text.tidy(F.col("text")), " "), placed)
    return captions.pieces(seg.select("source_id", F.col("seg_idx").alias("segment"), words.alias("words")))


TITLED = ("title", "hook_line", "title_variant_a", "title_variant_b", "title_quality_score", "mood", "retention_soft_score", "packaging_quality_score", "title_confidence")


@query()
def story_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated titles of chains whose fragments are turns, as a Russian serial packages them."""
    made = story.summaries(story.chains(turn_told(spark, sf_dir)))
    strong = made.withColumns({"hook_strength": F.lit(0.6), "payoff_strength": F.when(F.col("payoff") != "", 0.7).otherwise(0.2), "story_clarity_score": F.col("completion_score"), "recommendation_readiness_score": F.lit(0.5)})
    return titles.story_titles(strong, serial=True).select("source_id", "block_no", *TITLED)


def known(column: str, names: dict[str, str], default: str) -> str:
    return f"CASE {column} {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in names.items())} ELSE {default} END"


PACKAGES = rf"""WITH {SUMMARIES}, n0 AS (SELECT source_id, block_no, hook_type, payoff_type, conflict_type, topic_phrase, is_complete, arc_shape, emotion, {sql_tidy("title_seed")} AS c FROM summed), {NORMAL},
    tt AS (SELECT *, {sql_tidy("title")} AS t0 FROM normal), t1 AS (SELECT *, {sql_capital("t0")} AS t FROM tt), t2 AS (SELECT *, {sql_trimmed("t", 64)} AS shown FROM t1),
    h AS (SELECT *, list_filter([{known("conflict_type", packaging.CONFLICT_TAGS["en"], "NULL")}, CASE WHEN emotion IS NOT NULL THEN {cascade("emotion", packaging.EMOTION_TAGS["en"], "NULL")} END, CASE WHEN length(topic_phrase) >= 4 AND NOT list_contains({listed(packaging.GENERIC_TOPICS)}, lower(topic_phrase))
      THEN '#' || nullif(regexp_replace(regexp_replace(replace(topic_phrase, ' ', '_'), '[^\p{{L}}\p{{N}}_]+', '', 'g'), '^_+|_+$', '', 'g'), '') END, CASE WHEN is_complete OR arc_shape = 'hook_setup_escalation_payoff' THEN '#story' END], lambda x: x IS NOT NULL) AS tags FROM t2),
    q AS (SELECT *, {file_name("shown")} AS base FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY source_id * 1000 + block_no) AS nth FROM q)
    SELECT source_id, block_no, shown AS title, {known("hook_type", packaging.HOOK_PHRASES, "'Strong story moment'")} AS hook_phrase, {known("payoff_type", packaging.PAYOFF_PHRASES, "''")} AS payoff_phrase,
      array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i)[1:3], ' ') AS hashtags, CASE WHEN nth = 1 THEN base ELSE base || ' [' || nth || ']' END AS file_name FROM r"""


@query(PACKAGES)
def chain_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of chains whose fragments are turns."""
    return packaged(story.summaries(story.chains(turn_told(spark, sf_dir))))


@query(folded(PACKAGES).replace("WITH", "WITH RECURSIVE", 1))
def story_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packaged(story.summaries(story.chains(told(spark, sf_dir))))


@query(
    rf"""WITH {TURNS}, t0 AS (SELECT source_id, turn_id AS nth, {sql_tidy("text")} AS x FROM turns), t1 AS (SELECT source_id, nth, {sql_capital("x")} AS y FROM t0), n00 AS (SELECT source_id, nth, {sql_trimmed("y", 60)} AS z FROM t1),
    n0 AS (SELECT source_id, nth, {sql_tidy("z")} AS c FROM n00), {NORMAL}, o AS (SELECT source_id, lower(title) AS key, arg_min(title, nth) AS title, min(nth) AS nth FROM normal WHERE title <> '' GROUP BY ALL),
    q AS (SELECT *, {sql_tidy("title")} AS t FROM o), s AS (SELECT *, round({QUALITY}, 4) AS score FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, length(title) DESC, nth) AS k FROM s)
    SELECT source_id, title, score FROM r WHERE k = 1"""
)
def best_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spoken(spark, sf_dir).select("source_id", F.col("turn_id").alias("nth"), packaging.trimmed_title(F.col("text"), 60).alias("text"))
    return packaging.best_titles(rows, "source_id")


DURATIONS = "CASE WHEN speaker = 'user' THEN 45 WHEN speaker = 'assistant' THEN 60 ELSE 35 END"


@query(f"WITH {TURNS} SELECT source_id, turn_id, ({DURATIONS})::BIGINT AS longest_s FROM turns")
def duration_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("speaker") == "user", "short").when(F.col("speaker") == "assistant", "story").otherwise("other")
    return spoken(spark, sf_dir).withColumn("story_mode", mode).select("source_id", "turn_id", ranking.duration_policy().alias("longest_s"))




@query(
    f"""WITH {TURNS}, g AS (SELECT source_id, lag(end_ms) OVER w AS start_ms, start_ms AS end_ms, lag(end_ms) OVER w - lag(start_ms) OVER w AS prev_ms, end_ms - start_ms AS next_ms
      FROM turns WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, end_ms)),
    p AS (SELECT *, end_ms - start_ms AS d, least(1.0, least(prev_ms, next_ms) / 1150.0) AS bonus FROM g WHERE end_ms > start_ms + 80)
    SELECT source_id, start_ms, end_ms, d AS duration_ms, round(bonus, 4) AS continuation_bonus FROM p WHERE d > 80"""
)
def pause_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pauses.pause_timeline(spoken(spark, sf_dir))
    return found.where("duration_ms > 80").select("source_id", "start_ms", "end_ms", "duration_ms", "continuation_bonus")


#: Pauses between turns without sound, by the rules as they are by default: energy 0 is quiet.
PAUSES = f"""{TURNS}, g AS (SELECT source_id, lag(end_ms) OVER w AS start_ms, start_ms AS end_ms, lag(end_ms) OVER w - lag(start_ms) OVER w AS prev_ms, end_ms - start_ms AS next_ms FROM turns WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, end_ms)),
  p0 AS (SELECT *, end_ms - start_ms AS d, least(1.0, least(prev_ms, next_ms) / 1150.0::DOUBLE) AS bonus, least(prev_ms, next_ms) <= 650 AS short, least(prev_ms, next_ms) >= 850 AS strong, abs(prev_ms - next_ms) >= 550 AS uneven FROM g WHERE end_ms > start_ms),
  p1 AS (SELECT *, CASE WHEN d >= 2000 AND bonus < 0.45 THEN 'dead_air' WHEN d <= 750 AND bonus >= 0.72 AND (short OR uneven) THEN 'reaction_pause' WHEN d <= 750 THEN 'short' WHEN d <= 3000 AND bonus >= 0.82 AND short THEN 'comedic_pause'
    WHEN d <= 2500 AND bonus >= 0.76 AND strong THEN 'tension_pause' WHEN d > 2000 AND bonus < 0.58 THEN 'low' ELSE 'rest' END AS k FROM p0),
  p2 AS (SELECT *, CASE WHEN k IN ('short', 'low', 'rest') THEN 'unknown' ELSE k END AS silence_type, CASE k WHEN 'dead_air' THEN 0.92 WHEN 'reaction_pause' THEN 0.68 WHEN 'short' THEN 0.44 WHEN 'comedic_pause' THEN 0.72 WHEN 'tension_pause' THEN 0.70 WHEN 'low' THEN 0.48 ELSE 0.52 END::DOUBLE AS silence_confidence,
    CASE k WHEN 'comedic_pause' THEN 3000 WHEN 'tension_pause' THEN 2500 WHEN 'rest' THEN CASE WHEN d <= 2500 THEN 1500 ELSE 3000 END ELSE 1500 END::BIGINT AS limit_ms, k IN ('dead_air', 'low') OR (k = 'rest' AND d > 3000 AND bonus < 0.40) AS trim_allowed,
    CASE k WHEN 'dead_air' THEN 'low_energy_long_gap' WHEN 'reaction_pause' THEN 'reaction_hold' WHEN 'short' THEN 'short_gap' WHEN 'comedic_pause' THEN 'comic_timing' WHEN 'tension_pause' THEN 'tension_bridge' WHEN 'low' THEN 'uncertain_low_energy' ELSE 'uncertain' END AS why FROM p1),
  p3 AS (SELECT *, CASE WHEN d <= 1000 THEN 'soft_keep:short_gap' WHEN silence_type = 'dead_air' OR (silence_type = 'unknown' AND silence_confidence < 0.50 AND trim_allowed) THEN 'cut:' || why
    WHEN d <= 1150 AND (bonus >= 0.50 OR NOT trim_allowed) THEN 'keep_for_story:' || CASE silence_type WHEN 'comedic_pause' THEN 'comedic_timing' WHEN 'reaction_pause' THEN 'reaction_hold' WHEN 'tension_pause' THEN 'tension_hold'
      ELSE CASE WHEN bonus >= 0.92 THEN 'continuation_bonus' WHEN bonus >= 0.62 THEN 'soft_context' ELSE 'story_gap' END END
    WHEN silence_type = 'unknown' AND silence_confidence >= 0.50 AND NOT trim_allowed THEN 'keep_for_story:uncertain_preserve' WHEN d > 1150 THEN 'cut:long_silence' ELSE 'cut:over_2s_silence' END AS dr FROM p2),
  pz AS (SELECT source_id, start_ms, end_ms, d AS duration_ms, 0.0::DOUBLE AS energy, round(bonus, 4) AS continuation_bonus, silence_type, silence_confidence, limit_ms, trim_allowed, split_part(dr, ':', 1) AS decision, split_part(dr, ':', 2) AS reason FROM p3)"""
PAUSE_TYPES = ("dead_air", "comedic_pause", "emotional_pause", "reaction_pause", "tension_pause", "unknown")


@query(f"WITH {PAUSES} SELECT * FROM pz")
def pause_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.pause_timeline(spoken(spark, sf_dir))


@query(
    f"""WITH {PAUSES} SELECT source_id, count(*) AS pauses, count(*) FILTER (decision = 'cut') AS cut_count, count(*) FILTER (decision = 'soft_keep') AS soft_keep_count, count(*) FILTER (decision = 'keep_for_story') AS story_keep_count,
    coalesce(sum(duration_ms) FILTER (decision = 'cut'), 0)::BIGINT AS cut_ms, coalesce(sum(duration_ms) FILTER (decision = 'keep_for_story'), 0)::BIGINT AS story_kept_ms, {', '.join(f"count(*) FILTER (silence_type = '{t}') AS {t}_count" for t in PAUSE_TYPES)} FROM pz GROUP BY source_id"""
)
def pause_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.pause_stats(pauses.pause_timeline(spoken(spark, sf_dir)))


@query(f"WITH {PAUSES} SELECT source_id, round(start_ms / 1000.0::DOUBLE, 3) AS start, round(end_ms / 1000.0::DOUBLE, 3) AS end, round(duration_ms / 1000.0::DOUBLE, 3) AS duration, silence_type, reason FROM pz WHERE decision = 'cut'")
def cut_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses.cut_events(pauses.pause_timeline(spoken(spark, sf_dir)))


@query(
    f"""WITH {PAUSES}, cl AS (SELECT source_id, max(end_ms) - min(start_ms) AS original_ms, sum(end_ms - start_ms) AS output_ms, round(avg({score("text", lexicons.HOOK)}), 6) AS hook FROM turns GROUP BY source_id),
    su AS (SELECT source_id, coalesce(sum(duration_ms) FILTER (decision = 'cut' AND silence_type = 'dead_air'), 0) AS dead, coalesce(sum(duration_ms) FILTER (decision = 'cut' AND silence_type = 'unknown'), 0) AS unknown, count(*) FILTER (decision = 'cut') AS cuts,
      coalesce(sum(duration_ms) FILTER (decision <> 'cut' AND silence_type NOT IN ('dead_air', 'unknown')), 0) AS kept FROM pz GROUP BY source_id),
    x AS (SELECT cl.*, coalesce(dead, 0) / greatest(1000, original_ms)::DOUBLE AS dead, coalesce(unknown, 0) / greatest(1000, original_ms)::DOUBLE AS unknown, coalesce(kept, 0) / greatest(1000, original_ms)::DOUBLE AS kept, coalesce(cuts, 0) AS cuts,
      CASE WHEN original_ms > 0 THEN greatest(0.0, 1.0 - least(1.0, output_ms / original_ms::DOUBLE)) ELSE 0.0 END AS trimmed FROM cl LEFT JOIN su USING (source_id))
    SELECT source_id, round(greatest(0.0, least(1.0, 0.5 * 0.26 + 0.5 * 0.18 + greatest(0.0, least(1.0, hook)) * 0.12 + 0.5 * 0.12 + 0.5 * 0.08 + least(1.0, kept * 2.0) * 0.08 + least(1.0, trimmed * 1.2) * 0.08
      + least(1.0, 1.0 - greatest(0.0, dead * 1.5 + unknown * 0.75)) * 0.08 - least(0.40, dead * 1.7 + unknown * 0.75 + greatest(0, cuts - 1) * 0.025) + 0.16)), 4) AS pacing_score FROM x"""
)
def pacing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spoken(spark, sf_dir)
    timeline = pauses.pause_timeline(t)
    hook = F.round(F.avg(text.lexicon_score(F.col("text"), lexicons.HOOK)), 6)
    clips = t.groupBy("source_id").agg((F.max("end_ms") - F.min("start_ms")).alias("original_ms"), F.sum("duration_ms").alias("output_ms"), hook.alias("hook"))
    clips = clips.select("*", *(F.lit(0.5).alias(c) for c in ("flow", "interest", "context", "quality")))
    return pauses.pacing(timeline, clips)


HOLDS = "len(list_filter({words}, lambda w: contains(lower({text}), w))) > 0"


def holds(said: str, words: tuple[str, ...]) -> str:
    return HOLDS.format(words=listed(words), text=said)


@query(
    rf"""WITH {SEGMENTS}, g AS (SELECT source_id, count(*) AS n, {squeezed("string_agg(text, ' ' ORDER BY seg_idx)")} AS full_, trim(arg_min(text, seg_idx)) AS first_text, trim(arg_max(text, seg_idx)) AS last_text, arg_min(start_ms, seg_idx) AS at_ms FROM seg GROUP BY source_id),
    w AS (SELECT *, regexp_extract_all(lower(full_), '[A-Za-zЀ-ӿ0-9'']+') AS words, least(1.0, n / 4.0) AS ex,
      CASE WHEN length(regexp_replace(full_, '[^?]', '', 'g')) > 0 AND n >= 2 AND NOT last_text LIKE '%?' THEN least(1.0, length(regexp_replace(full_, '[^?]', '', 'g')) * 0.35) ELSE 0.0 END AS bonus FROM g),
    h AS (SELECT *, least(1.0, len(list_filter(words, lambda w: list_contains({listed(signals.EMOTIONS)}, w))) / 3.0) AS emotion,
      CASE WHEN first_text = '' THEN 0.0 ELSE least(1.0, 0.30 + CASE WHEN at_ms <= 350 THEN 0.22 ELSE 0.0 END + CASE WHEN {holds('first_text', ('?', *signals.QUESTIONS))} THEN 0.18 ELSE 0.0 END
        + CASE WHEN {holds('first_text', signals.EMOTIONS)} THEN 0.18 ELSE 0.0 END + CASE WHEN length(first_text) <= 48 THEN 0.12 ELSE 0.0 END) END AS hook,
      least(1.0, ex * 0.48 + least(1.0, len(words) / 22.0) * 0.24 + least(1.0, n / 3.0) * 0.28) AS dev,
      least(1.0, CASE WHEN regexp_matches(last_text, '[.!?]$') THEN 0.55 ELSE 0.18 END + bonus * 0.25 + CASE WHEN {holds('full_', signals.PAYOFFS)} THEN 0.20 ELSE 0.0 END) AS clo FROM w)
    SELECT source_id, round(ex, 4) AS dialogue_exchange_score, round(bonus, 4) AS question_answer_bonus, round(emotion, 4) AS emotion_signal, round(hook, 4) AS hook_score, round(dev, 4) AS development_score, round(clo, 4) AS closure_score,
      round(least(1.0, ex * 0.18 + bonus * 0.16 + emotion * 0.14 + hook * 0.20 + dev * 0.14 + clo * 0.18), 4) AS interestingness_score, coalesce(list_contains({listed(signals.CONNECTORS)}, words[1]), false) OR at_ms > 550 AS starts_mid_phrase,
      regexp_matches(last_text, '[.!?]$') AS line_like_closure, length(full_) AS text_length FROM h"""
)
def story_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.story_signals(segments(spark, sf_dir)).drop("subtitle_quality_score")


SANITY = rf"""b AS (SELECT source_id, n, full_ AS text, regexp_extract_all(lower(full_), '[A-Za-zЀ-ӿ0-9'']+') AS w FROM g),
    s AS (SELECT *, len(list_distinct(w)) / greatest(1, len(w))::DOUBLE AS u, length(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM b),
    k AS (SELECT *, round(a / greatest(1, c + a), 4) AS lc, text = '' OR len(w) = 0 OR u < 0.35 OR {MISREAD} OR {FIVE_ALIKE} AS suspicious FROM s),
    sane AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.50 + lc * 0.22 + u * 0.18 + (CASE WHEN regexp_matches(text, '[.!?]$') THEN 0.10 ELSE 0.0 END + CASE WHEN len(w) >= 6 THEN 0.06 ELSE 0.0 END) - CASE WHEN suspicious THEN 0.28 ELSE 0.0 END
      - least(0.20, len(list_filter(w, lambda x: length(x) <= 2)) / greatest(1, len(w))::DOUBLE * 0.22) - least(0.22, greatest(0.0, 0.58 - u) * 0.65))), 4) END AS sanity FROM k)"""


@query(
    rf"""WITH {SEGMENTS}, g AS (SELECT source_id, count(*) AS n, {squeezed("string_agg(text, ' ' ORDER BY seg_idx)")} AS full_ FROM seg GROUP BY source_id), {SANITY}
    SELECT source_id, round(least(1.0, 0.8::DOUBLE * 0.34::DOUBLE + sanity::DOUBLE * 0.38::DOUBLE + lc::DOUBLE * 0.18::DOUBLE + least(1.0, n / 4.0::DOUBLE) * 0.10::DOUBLE)::VARCHAR::DECIMAL(30, 20), 4)::DOUBLE AS subtitle_quality_score FROM sane"""
)
def subtitle_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.story_signals(segments(spark, sf_dir)).select("source_id", "subtitle_quality_score")


@query(
    f"""WITH {TURNS}, t AS (SELECT source_id, max(end_ms) AS total_ms FROM turns GROUP BY source_id),
    w AS (SELECT source_id, s AS start_ms, least(total_ms, s + 35000) AS end_ms FROM (SELECT source_id, total_ms, unnest(range(0, total_ms, 10000)) AS s FROM t)),
    m AS (SELECT w.source_id, w.start_ms, w.end_ms, count(turns.start_ms) AS turn_count, coalesce(sum(least(turns.end_ms, w.end_ms) - turns.start_ms), 0)::BIGINT AS speech_ms
      FROM w LEFT JOIN turns ON w.source_id = turns.source_id AND turns.start_ms >= w.start_ms AND turns.start_ms < w.end_ms GROUP BY ALL)
    SELECT *, round(least(1.0, speech_ms / (end_ms - start_ms)), 4) AS speech_density, round(1.0 - round(least(1.0, speech_ms / (end_ms - start_ms)), 4), 4) AS silence_ratio FROM m"""
)
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spoken(spark, sf_dir)
    grid = intervals.fixed_grid(t.groupBy("source_id").agg(F.max("end_ms").alias("total_ms")), 35_000, 10_000)
    return signals.window_summary(t, grid)


SETS = f"""{BLOCKS}, sets AS (SELECT source_id, block_no, list_distinct(list(speaker)) AS sp, list_distinct(flatten(list({TOPIC_WORDS}))) AS tp FROM numbered GROUP BY ALL),
  lagged AS (SELECT *, lag(sp) OVER (PARTITION BY source_id ORDER BY block_no) AS ps, lag(tp) OVER (PARTITION BY source_id ORDER BY block_no) AS pt FROM sets)"""


@query(
    f"""WITH {SETS} SELECT source_id, block_no, round(coalesce(len(list_intersect(sp, ps)) / nullif(len(list_distinct(list_concat(sp, ps))), 0)::DOUBLE, 0), 4) AS speaker_jaccard,
    round(coalesce(len(list_intersect(tp, pt)) / nullif(len(list_distinct(list_concat(tp, pt))), 0)::DOUBLE, 0), 4) AS topic_jaccard, round(len(list_intersect(tp, pt)) / greatest(1, len(tp), len(pt))::DOUBLE, 4) AS topic_overlap
    FROM lagged WHERE ps IS NOT NULL"""
)
def block_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = gap_blocked(spark, sf_dir).groupBy("source_id", "block_no").agg(F.collect_set("speaker").alias("speakers"), F.array_distinct(F.flatten(F.collect_list(text.topic_words(F.col("text"))))).alias("topics"))
    return signals.neighbour_overlap(sets, "source_id", "block_no")


@query(
    f"""WITH {TURNS}, c AS (SELECT source_id, bool_or(turn_id % 4 = 3) AS failed, count(DISTINCT speaker) FILTER (length(speaker) > 6 AND speaker NOT IN ('assistant', 'system', 'user')) AS named FROM turns GROUP BY source_id)
    SELECT source_id, named, failed AND named >= 1 AS use_cuts FROM c"""
)
def subtitle_cut_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spoken(spark, sf_dir)
    return signals.subtitle_cuts_wanted(t.select("source_id", (F.pmod("turn_id", F.lit(4)) == 3).alias("face_failed")), t, ~packaging.is_generic_speaker(F.col("speaker")) & (F.length("speaker") > 6))


@query(
    f"""WITH {TURNS}, p AS (SELECT *, start_ms - lag(end_ms) OVER w AS gap, speaker = lag(speaker) OVER w AS same FROM turns WINDOW w AS (PARTITION BY source_id ORDER BY turn_id))
    SELECT source_id, turn_id, round(greatest(0.0, 1.0 - abs(gap) / 24000.0) * 0.4 + 0.2 + CASE WHEN same THEN 0.2 ELSE 0.0 END, 4) AS coherence FROM p WHERE gap IS NOT NULL"""
)
def pair_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = turns.in_order()
    gap = F.col("start_ms") - F.lag("end_ms").over(order)
    pairs = spoken(spark, sf_dir).withColumns({"gap": gap, "same": F.col("speaker") == F.lag("speaker").over(order)}).where("gap is not null")
    return pairs.select("source_id", "turn_id", signals.pair_coherence(F.col("gap"), F.lit(True), F.col("same"), F.lit(0.0)).alias("coherence"))


@query(
    f"""WITH {TURNS}, t AS (SELECT source_id, max(end_ms) AS total_ms FROM turns GROUP BY source_id),
    w AS (SELECT source_id, s AS start_ms, least(total_ms, s + 35000) AS end_ms FROM (SELECT source_id, total_ms, unnest(range(0, total_ms, 10000)) AS s FROM t)),
    m AS (SELECT w.source_id, w.start_ms, w.end_ms, count(turns.start_ms) AS c, coalesce(sum(least(turns.end_ms, w.end_ms) - turns.start_ms), 0) AS speech
      FROM w LEFT JOIN turns ON w.source_id = turns.source_id AND turns.start_ms >= w.start_ms AND turns.start_ms < w.end_ms GROUP BY ALL),
    d AS (SELECT *, round(least(1.0, speech / (end_ms - start_ms)), 4) AS density FROM m)
    SELECT source_id, start_ms, CASE WHEN c = 0 THEN 'no_speech' WHEN density < 0.18 THEN 'low_dialogue_flow' WHEN round(1.0 - density, 4) > 0.75 THEN 'too_silent' WHEN c < 2 THEN 'insufficient_context' END AS reason FROM d"""
)
def window_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spoken(spark, sf_dir)
    grid = intervals.fixed_grid(t.groupBy("source_id").agg(F.max("end_ms").alias("total_ms")), 35_000, 10_000)
    return signals.window_summary(t, grid).select("source_id", "start_ms", ranking.admission().alias("reason"))


@query(folded(CHECKS).replace("WITH", "WITH RECURSIVE", 1))
def chain_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.chain_validation(extended(spark, sf_dir))
