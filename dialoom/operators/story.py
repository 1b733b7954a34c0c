"""Story fragments, chains and summaries of conversation blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import conflict_type, hits, hook_type, lexicon_score, payoff_type, plain_words, squeeze, topic_phrase, topic_words
from . import walks


def in_order():
    """A window over a source's rows in order."""
    return Window.partitionBy("source_id", "block_no").orderBy("frag_no")

CHAIN = ("source_id", "block_no")


def split_fragments(turns: DataFrame, most: int = 6) -> DataFrame:
    """turns with block_no to turns with frag_no: a block is split at topic shifts, narrative beats, after long chunks
    and at speaker pivots; of more than `most` fragments the boundaries with the smallest gaps are undone.

    Scores of turns are Spark columns; what depends on the chunk so far is walked per block."""
    keyed = turns.select(
        "source_id", "block_no", "turn_id", "start_ms", "end_ms", "speaker", topic_words(F.col("text")).alias("words"), lexicon_score(F.col("text"), lexicons.CONFLICT).alias("conflict"),
        lexicon_score(F.col("text"), lexicons.PAYOFF).alias("payoff"), lexicon_score(F.col("text"), lexicons.HOOK).alias("hook"),
    )

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        from .grouping import share, top_words

        turns, cuts, last = [], [], None
        begin, size, fought, words = 0, 0, 0.0, []
        for turn, start, end, speaker, own, conflict, payoff, hook in rows:
            if last is not None:
                gap, pivot = start - last[0], speaker != last[1]
                alike = lambda: share(top_words(words), top_words(own))  # noqa: B023, E731
                cut = gap >= 500 and fought / size >= 0.3 and payoff >= 0.25
                cut = cut or (pivot and gap > 800 and size >= 2 and max(hook, conflict) >= 0.2)
                cut = cut or (gap > 2_500 and pivot and alike() == 0) or (gap > 1_000 and last[0] - begin >= 20_000 and size >= 3 and alike() <= LONG_OVERLAP)
                if cut:
                    cuts.append((gap, len(turns)))
                    begin, size, fought, words = 0, 0, 0.0, []
            begin, size, fought = begin if size else start, size + 1, fought + conflict
            words += own
            turns.append(turn)
            last = (end, speaker)
        kept = {i for _, i in sorted(cuts, reverse=True)[: most - 1]}
        number = 0
        for i, turn in enumerate(turns):
            number += i in kept
            yield turn, number

    out = {"turn_id": turns.schema["turn_id"].dataType.simpleString(), "frag_no": "int"}
    return turns.join(walks.walked(keyed, ["source_id", "block_no"], ["turn_id"], walk, out), ["source_id", "block_no", "turn_id"])


#: A chunk of 20 s splits where topics overlap at most this much.
LONG_OVERLAP = 0.1


def fragments(turns: DataFrame) -> DataFrame:
    """One row per fragment of turns with block_no and frag_no: transcript, speakers, signals, pauses and scores."""
    gap = F.col("start_ms") - F.lag("end_ms").over(Window.partitionBy("source_id", "block_no", "frag_no").orderBy("turn_id"))
    packed = F.array_sort(F.collect_list(F.struct("turn_id", "speaker", "text", "gap")))
    found = turns.withColumn("gap", gap).groupBy("source_id", "block_no", "frag_no").agg(
        F.min_by("start_ms", "turn_id").alias("start_ms"), F.max_by("end_ms", "turn_id").alias("end_ms"), F.count("*").alias("turn_count"), packed.alias("turns")
    )
    text = F.trim(F.array_join(F.filter("turns.text", lambda t: t != ""), " "))
    found = found.withColumns({"transcript": text, "speakers": F.array_distinct("turns.speaker"), "pauses_ms": F.filter("turns.gap", lambda g: g > 300)}).drop("turns")
    scores = {f"{n.lower()}_score": lexicon_score(F.col("transcript"), getattr(lexicons, n)) for n in ("HOOK", "CONFLICT", "ESCALATION", "EMOTION", "PAYOFF")}
    signals = {f"{n.lower()}_signals": hits(F.col("transcript"), getattr(lexicons, n)) for n in ("EMOTION", "CONFLICT", "CAUSAL")}
    return found.withColumns(scores | signals)


def roles(frags: DataFrame) -> DataFrame:
    """Adds role: hook (first by hook score, the opening one helped), payoff (first by payoff and emotion, the closing
    one helped), escalation (the last by conflict and escalation, if above zero, of the others) and setup.

    A first fragment that is both becomes hook_setup and the last best of the others payoff; another one, or the
    only one, that is both is payoff."""
    n = F.count("*").over(Window.partitionBy(*CHAIN))
    nth = F.row_number().over(in_order())
    scored = frags.withColumns({"nth": nth, "of": n})
    scored = scored.withColumns(
        {
            "h": F.col("hook_score") + F.when(F.col("nth") == 1, 0.15).otherwise(0.0),
            "p": F.col("payoff_score") + 0.3 * F.col("emotion_score") + F.when(F.col("nth") == F.col("of"), 0.15).otherwise(0.0),
            "e": F.col("conflict_score") + F.col("escalation_score"),
        }
    )
    place = lambda *keys: F.row_number().over(Window.partitionBy(*CHAIN).orderBy(*keys)) == 1
    scored = scored.withColumns({"is_h": place(F.desc("h"), "nth"), "is_p": place(F.desc("p"), "nth")})
    both = F.max((F.col("is_h") & F.col("is_p") & (F.col("nth") == 1) & (F.col("of") > 1)).cast("int")).over(Window.partitionBy(*CHAIN)) == 1
    scored = scored.withColumn("both", both)
    second = F.row_number().over(Window.partitionBy(*CHAIN).orderBy(F.col("nth") == 1, F.desc("p"), F.desc("nth"))) == 1
    scored = scored.withColumn("second", second)
    first = F.when(F.col("both"), F.when(F.col("nth") == 1, "hook_setup").when(F.col("second"), "payoff")).otherwise(F.when(F.col("is_p"), "payoff").when(F.col("is_h"), "hook"))
    scored = scored.withColumn("role", first)
    peak = F.row_number().over(Window.partitionBy(*CHAIN).orderBy(F.col("role").isNotNull(), F.desc("e"), F.desc("nth"))) == 1
    role = F.coalesce("role", F.when(peak & (F.col("e") > 0), "escalation").otherwise("setup"))
    return scored.withColumn("role", role).drop("h", "p", "e", "is_h", "is_p", "both", "second", "nth", "of")


def text_of(frags: Column, keep) -> Column:
    """The transcript of the first fragment that `keep` accepts and that has one, or ''."""
    found = F.filter(frags, lambda f: keep(f) & (f["transcript"] != ""))
    return F.coalesce(F.get(found, F.lit(0))["transcript"], F.lit(""))


def chains(frags: DataFrame) -> DataFrame:
    """One row per block of fragments with roles: hook, setup, escalation and payoff texts with positional fallbacks,
    arc shape, speakers, conflict type, topic words, completion."""
    row = F.struct("frag_no", "role", squeeze(F.col("transcript")).alias("transcript"), "speakers", "conflict_signals", "emotion_signals", "start_ms", "end_ms", "payoff_score")
    packed = frags.groupBy(*CHAIN).agg(F.array_sort(F.collect_list(row)).alias("f"))
    of = lambda role: text_of(F.col("f"), lambda x: x["role"] == role)
    first, last, n = F.get("f", F.lit(0)), F.element_at("f", -1), F.size("f")
    hook = F.coalesce(F.nullif(of("hook"), F.lit("")), F.nullif(of("hook_setup"), F.lit("")), first["transcript"])
    out = packed.withColumn("hook", hook)
    setup = F.coalesce(F.nullif(of("setup"), F.lit("")), F.when(n > 1, text_of(F.slice("f", 2, 1000), lambda x: ~x["role"].isin("hook", "payoff", "escalation"))), F.lit(""))
    out = out.withColumn("setup", setup)
    late = text_of(F.col("f"), lambda x: ~x["role"].isin("hook", "setup", "payoff", "hook_setup") & (x["transcript"] != F.col("hook")) & (x["transcript"] != F.col("setup")))
    out = out.withColumn("escalation", F.coalesce(F.nullif(of("escalation"), F.lit("")), F.when(n > 2, late), F.lit("")))
    closing = F.when((last["transcript"] != "") & ((n > 1) | (last["transcript"] != F.col("hook"))), last["transcript"])
    out = out.withColumn("payoff", F.coalesce(F.nullif(of("payoff"), F.lit("")), closing, F.lit("")))
    speakers = F.array_distinct(F.flatten("f.speakers"))
    signals = F.array_distinct(F.flatten("f.conflict_signals"))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("f", lambda x: topic_words(x["transcript"])))))
    out = out.withColumns({"start_ms": first["start_ms"], "end_ms": last["end_ms"], "fragments": n, "speakers": speakers, "conflict_type": conflict_type(signals, F.col("escalation")), "emotions": F.array_distinct(F.flatten("f.emotion_signals")), "topic_words": words})
    return completed(out.drop("f")).withColumn("extended", F.lit(False))


def completed(chain: DataFrame) -> DataFrame:
    """Adds arc_shape, completion_score and is_complete from the four texts."""
    filled = F.size(F.filter(F.array("hook", "setup", "escalation", "payoff"), lambda t: t != ""))
    shapes = F.array(*map(F.lit, lexicons.ARC_SHAPES))
    return chain.withColumns({"arc_shape": F.element_at(shapes, filled + 1), "completion_score": filled * 0.25, "is_complete": filled == 4})


def summaries(chain: DataFrame) -> DataFrame:
    """Title seed, types, topic phrase, context completeness and confidence of chains."""
    all_text = squeeze(F.concat_ws(" ", "hook", "setup", "escalation", "payoff"))
    tail = F.when((F.col("payoff") != "") & (F.col("payoff") != F.col("hook")) & (F.col("payoff") != F.col("escalation")), F.col("payoff")).otherwise("")
    seed = F.array_join(F.slice(F.split(squeeze(F.concat_ws(" ", "hook", "escalation", tail)), " "), 1, 20), " ")
    context = sum((F.when(c, 0.25).otherwise(0.0) for c in (F.size("speakers") > 0, F.size(plain_words(all_text)) > 0, F.col("setup") != "", F.col("escalation") != "")), F.lit(0.0))
    out = chain.withColumns({"title_seed": seed, "hook_type": hook_type(F.col("hook")), "payoff_type": payoff_type(F.col("payoff")), "topic_phrase": topic_phrase(all_text), "context_completeness": context})
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.25 + F.col("completion_score") * 0.35 + F.col("context_completeness") * 0.35), 4))


def extend_payoff(chain: DataFrame, blocks: DataFrame, within_ms: int = 180_000) -> DataFrame:
    """Incomplete chains joined with the first later block of their source that starts within within_ms and shares
    speakers by 0.3 or topic words by 0.18 of the larger set; it gives the payoff where it lacks, and the end.

    blocks: (source_id, block_no, start_ms, speakers, topic_words, payoff_text, payoff_end_ms). Start times are put
    into slots of within_ms; a chain looks into the slot of its end and the next one, so the join is on equal keys."""
    lack = chain.where("not is_complete").withColumn("slot", F.explode(F.array(F.floor(F.col("end_ms") / within_ms), F.floor(F.col("end_ms") / within_ms) + 1)))
    later = blocks.withColumn("slot", F.floor(F.col("start_ms") / within_ms)).alias("b")
    share = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)
    low = lambda c: F.transform(c, lambda s: F.lower(s))
    near = F.col("b.start_ms").between(F.col("c.end_ms"), F.col("c.end_ms") + within_ms)
    alike = (share(low(F.col("c.speakers")), low(F.col("b.speakers"))) >= 0.3) | (share(F.col("c.topic_words"), F.col("b.topic_words")) >= 0.18)
    same = (F.col("c.source_id") == F.col("b.source_id")) & (F.col("c.slot") == F.col("b.slot")) & near & alike & (F.col("b.payoff_text") != "")
    hit = lack.alias("c").join(later, same).groupBy(F.col("c.source_id").alias("source_id"), F.col("c.block_no").alias("block_no")).agg(
        F.min(F.struct(F.col("b.block_no").alias("no"), F.col("b.payoff_text").alias("text"), F.col("b.payoff_end_ms").alias("end"))).alias("hit")
    )
    out = chain.join(hit, list(CHAIN), "left")
    found = F.col("hit").isNotNull()
    out = out.withColumns(
        {"payoff": F.when(found & (F.col("payoff") == ""), F.col("hit.text")).otherwise(F.col("payoff")), "end_ms": F.when(found, F.greatest("end_ms", "hit.end")).otherwise(F.col("end_ms")), "extended": found, "payoff_block": F.col("hit.no")}
    )
    return completed(out.drop("hit", "arc_shape", "completion_score", "is_complete"))


def publishable_chains(chain: DataFrame, least_ms: int = 35_000) -> DataFrame:
    """Chains of 6 s or more that reach least_ms, or are complete or score 0.75; where a source keeps none, those of
    10 s; ranked by completeness, score, extension and length within the source."""
    length = F.col("end_ms") - F.col("start_ms")
    floor = min(35_000, least_ms)
    marked = chain.withColumn("duration_ms", length).withColumn("passes", (length >= 6_000) & ((length >= floor) | (F.col("completion_score") >= 0.75) | F.col("is_complete")))
    some = F.max(F.col("passes").cast("int")).over(Window.partitionBy("source_id")) == 1
    kept = marked.withColumn("some", some).where("passes or (not some and duration_ms >= 10000)").drop("some")
    rescued = F.col("duration_ms") < floor
    order = Window.partitionBy("source_id").orderBy(F.desc("is_complete"), F.desc(F.col("completion_score") >= 0.75), F.desc("extended"), F.desc("completion_score"), F.desc("duration_ms"), rescued, "block_no")
    return kept.withColumn("rank", F.row_number().over(order)).drop("passes")


def plans(turns: DataFrame, least_s: float = 25.0, most_s: float = 60.0) -> DataFrame:
    """One row per block of turns with frag_no: its chain and summary, window_plan and window_segments at the bounds of
    its fragments, clarity_score (0.25 a filled text, 0.05 each for two turns, two speakers, and a length of at least
    least_s and at most most_s) and duration_penalty, the share of least_s that is missing."""
    frags = roles(fragments(turns))
    segment = F.struct("frag_no", F.col("role").alias("role"), F.round(F.col("start_ms") / 1000, 3).alias("start"), F.round(F.col("end_ms") / 1000, 3).alias("end"))
    parts = frags.groupBy(*CHAIN).agg(F.array_sort(F.collect_list(segment)).alias("s"))
    named = F.count_distinct(F.when(F.trim("speaker") != "", F.col("speaker")))
    talk = turns.groupBy(*CHAIN).agg(F.min_by("start_ms", "turn_id").alias("first_ms"), F.max_by("end_ms", "turn_id").alias("last_ms"), F.count("*").alias("turn_count"), named.alias("speaker_count"))
    found = summaries(chains(frags)).join(parts, list(CHAIN)).join(talk, list(CHAIN))
    length = F.greatest(F.lit(0.0), (F.col("last_ms") - F.col("first_ms")) / 1000)
    bonus = lambda test: F.when(test, 0.05).otherwise(0.0)
    clarity = F.col("completion_score") + bonus(F.col("turn_count") >= 2) + bonus(length >= least_s) + bonus(length <= most_s) + bonus(F.col("speaker_count") >= 2)
    window = F.struct(
        F.round(F.col("first_ms") / 1000, 3).alias("start"), F.round(F.col("last_ms") / 1000, 3).alias("end"), F.round(length, 3).alias("duration"), F.lit(least_s).alias("min_seconds"), F.lit(most_s).alias("max_seconds"), "turn_count", "speaker_count"
    )
    return found.withColumns(
        {
            "window_plan": window, "window_segments": F.transform("s", lambda x: F.struct(x["role"].alias("role"), x["start"].alias("start"), x["end"].alias("end"))),
            "clarity_score": F.least(F.lit(1.0), F.round(clarity, 4)), "duration_penalty": F.round(F.greatest(F.lit(0.0), (least_s - length) / max(1.0, least_s)), 4), "merge_reason": F.lit("story_chain_assembly"),
        }
    ).drop("s", "first_ms", "last_ms", "turn_count", "speaker_count")


def candidates(chain: DataFrame, source: str = "story_pipeline") -> DataFrame:
    """Chains as candidates for selection: times in seconds, completion as score, score_breakdown of the filled texts,
    estimated_turns, the number of fragments."""
    seconds = lambda c: F.round(F.col(c) / 1000, 3)
    score = F.round("completion_score", 4)
    filled = {f"{n}_filled": F.col(n) != "" for n in ("hook", "setup", "escalation", "payoff")}
    breakdown = {"completion_score": score, "is_complete": F.col("is_complete"), "search_extended": F.col("extended"), "arc_shape": F.col("arc_shape")} | filled
    shown = chain.withColumns({"start": seconds("start_ms"), "end": seconds("end_ms")})
    return shown.select(
        *CHAIN, "start", "end", F.round(F.greatest(F.lit(0.0), F.col("end") - F.col("start")), 3).alias("duration"), F.lit(source).alias("source"), F.lit("story_chain").alias("story_unit_type"), score.alias("story_clarity_score"), score.alias("score"),
        F.struct(*(c.alias(n) for n, c in breakdown.items())).alias("score_breakdown"), F.col("fragments").alias("estimated_turns"), F.lit(0.0).alias("hook_gap"), F.lit(0.0).alias("tail_gap"), score.alias("story_completion_score"), "is_complete", "speakers",
        F.col("extended").alias("search_extended"),
    )


def topic_terms(rows: DataFrame, by: list[str], text: Column, most: int = 4) -> DataFrame:
    """(by, terms): the most frequent plain words of each row's text, the first to appear among equals. by: a row's key."""
    spread = rows.select(*by, F.posexplode(plain_words(text)).alias("pos", "word"))
    counts = spread.groupBy(*by, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= most)
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("terms"))


#: The parts of a told story, in order; the last one is its last segment.
PARTS = ("hook", "setup", "escalation", "payoff")


def told_parts(segments: DataFrame, order: str = "turn_id") -> DataFrame:
    """(source_id, hook, setup, escalation, payoff, deficient) of segments(source_id, order, text): the first three texts
    and, of four segments or more, the last one. deficient: whether a part is missing or blank.

    Only the first three and the last segment of a source are kept on the way."""
    texts = segments.select("source_id", F.col(order).alias("k"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    by = Window.partitionBy("source_id").orderBy("k", "text")
    first = texts.withColumn("nth", F.row_number().over(by)).where("nth <= 3").groupBy("source_id").agg(*(F.max(F.when(F.col("nth") == i + 1, F.col("text"))).alias(p) for i, p in enumerate(PARTS[:3])))
    last = texts.groupBy("source_id").agg(F.max_by("text", F.struct("k", "text")).alias("last"), F.count("*").alias("n"))
    parts = first.join(last, "source_id").withColumn("payoff", F.when(F.col("n") >= 4, F.col("last")))
    missing = F.lit(False)
    for p in PARTS:
        missing = missing | (F.coalesce(p, F.lit("")) == "")
    return parts.select("source_id", *PARTS, missing.alias("deficient"))
