"""Candidate windows over turns: stitched neighbours, windows that grow from every turn, and linear covers.

A source is split into slots of time, each with the rows shortly before and after it, so a long one is many tasks. A row's
choice reaches a bounded time ahead; where choices depend on earlier ones (the next window begins where this one ends)
they are pointers from row to row, which are followed by doubling: log2 of the longest chain joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

KEY = ("start_ms", "end_ms", "id")


def followed(links: DataFrame, heads: DataFrame) -> DataFrame:
    """All (source_id, key) that links(source_id, key, to) lead to from heads(source_id, key), heads included.

    No key may be led to twice from different heads. Each round joins pointers with themselves, so that they reach twice
    as far, and ends when none is left."""
    found, step = heads.select("source_id", "key"), written(links.select("source_id", "key", "to"), "pointers")
    while not step.isEmpty():
        found = written(found.union(found.join(step, ["source_id", "key"]).select("source_id", F.col("to").alias("key"))), "found")
        far = step.select("source_id", F.col("key").alias("to"), F.col("to").alias("beyond"))
        step = written(step.join(far, ["source_id", "to"]).select("source_id", "key", F.col("beyond").alias("to")), "pointers")
    return found


def in_slots(rows: DataFrame, reach_ms: int) -> DataFrame:
    """rows(source_id, start_ms, end_ms, ...) in each slot of time that they are near to: `slot`, and whether it is the
    `own` one. A row meets all rows that begin or end within reach_ms of its start in its own slot."""
    width = 4 * reach_ms
    of = lambda c: F.floor(c / width)
    spread = rows.withColumn("slot", F.explode(F.sequence(of(F.col("start_ms") - reach_ms), of(F.greatest("start_ms", "end_ms") + reach_ms))))
    return spread.withColumn("own", F.col("slot") == of(F.col("start_ms")))


def stitched(windows: DataFrame, gap_ms: int = 72_000, most: int = 4, longest_ms: int = 60_000) -> DataFrame:
    """(source_id, start_ms, end_ms, n, ids): windows(source_id, start_ms, end_ms, id) in order, neighbours at most gap_ms
    apart joined greedily into chains of at most `most` windows and longest_ms in all.

    A window longer than that stays alone. Rows without a source or a time go, repeated rows count once."""
    rows = in_slots(windows.select("source_id", *KEY).dropna().distinct(), gap_ms + longest_ms)
    order = Window.partitionBy("source_id", "slot").orderBy(*KEY)
    row = F.struct(*KEY)
    after = [row, *(F.lead(row, k).over(order) for k in range(1, most + 1))]
    long = lambda r: r["end_ms"] - r["start_ms"] > longest_ms
    apart = lambda a, b: (b["start_ms"] - a["end_ms"] > gap_ms) | long(a) | long(b)
    near = rows.select("source_id", "own", row.alias("key"), F.lag(row).over(order).alias("prior"), *(r.alias(f"r{k}") for k, r in enumerate(after))).where("own")
    n: Column = F.lit(most)
    for k in range(most - 1, 0, -1):  # the count of windows, if the kth doesn't join those before
        a, b, end = F.col(f"r{k - 1}"), F.col(f"r{k}"), F.greatest(*(F.col(f"r{i}.end_ms") for i in range(k + 1)))
        n = F.when(b.isNull() | apart(a, b) | (end - F.col("r0.start_ms") > longest_ms), k).otherwise(n)
    near = near.withColumn("n", n).withColumn("all", F.array(*(F.col(f"r{k}") for k in range(most + 1))))
    last, to = F.get("all", F.col("n") - 1), F.get("all", F.col("n"))
    chains = near.select(
        "source_id", "key", (F.col("prior").isNull() | apart(F.col("prior"), F.col("key"))).alias("head"), "n", F.slice("all", F.lit(1), F.col("n")).alias("members"), F.when(to.isNotNull() & ~apart(last, to), to).alias("to")
    )
    chains = written(chains, "chains")
    starts = followed(chains.where("to is not null"), chains.where("head"))
    kept = chains.join(starts, ["source_id", "key"], "left_semi")
    return kept.select("source_id", F.col("key.start_ms").alias("start_ms"), F.array_max("members.end_ms").alias("end_ms"), F.col("n").cast("long").alias("n"), F.col("members.id").alias("ids"))


def review_pass(candidates: DataFrame, enabled: bool = False, least_speech: float = 0.14, least_face: float = 0.10, most: int = 20, **chain: int) -> DataFrame:
    """Chains of the candidates(source_id, start_ms, end_ms, id, score, speech_density, face_presence) that speak and show
    faces enough, the `most` best of a source by mean score; nothing unless it is enabled.

    A chain is (source_id, start_ms, end_ms, n, ids, score). Missing shares count as 0. chain: settings of stitched()."""
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    fit = candidates.where(F.lit(enabled) & (share("speech_density") >= least_speech) & (share("face_presence") >= least_face))
    chains = stitched(fit, **chain)
    members = chains.select("source_id", "start_ms", "end_ms", "n", "ids", F.explode("ids").alias("id"))
    scored = members.join(fit.select("source_id", "id", "score"), ["source_id", "id"]).groupBy("source_id", "start_ms", "end_ms", "n", "ids").agg(F.round(F.avg("score"), 4).alias("score"))
    best = Window.partitionBy("source_id").orderBy(F.desc("score"), "start_ms", "end_ms", "ids")
    return scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most).drop("nth")


def turn_windows(turns: DataFrame, least_ms: int = 17_500, most_ms: int = 60_000, gap_ms: int = 3_500) -> DataFrame:
    """For each turn as a start, how a window grows from it: (source_id, turn_id, start_ms, first_ms, last_ms, n_turns,
    speech_ms, density, head, next_id).

    first_ms is the first end of a turn that makes the window least_ms long, last_ms the last one that keeps it within
    most_ms (null: none), n_turns and speech_ms count the turns until then, by differences of running sums; a gap over gap_ms or a
    turn longer than most_ms ends a window. head: whether either comes before. next_id: the turn after the window, if neither
    comes before that.
    Turns of a source follow one another; rows without a source or a time go."""
    rows = in_slots(turns.select("source_id", "turn_id", "start_ms", "end_ms").dropna(), most_ms + gap_ms)
    by = Window.partitionBy("source_id", "slot")
    order, back = by.orderBy("start_ms", "turn_id"), by.orderBy(F.desc("start_ms"), F.desc("turn_id"))
    long = F.col("end_ms") - F.col("start_ms") > most_ms
    gap = long | F.coalesce(F.lead("start_ms").over(order) - F.col("end_ms") > gap_ms, F.lit(True))
    rows = rows.withColumns({"head": F.coalesce(F.lag(long).over(order) | (F.col("start_ms") - F.lag("end_ms").over(order) > gap_ms), F.lit(True)), "closes": gap, "follower": F.when(~gap, F.lead("turn_id").over(order))})
    rows = rows.withColumn("run_end", F.last(F.when(F.col("closes"), F.col("end_ms")), True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    # ends of turns and questions about them in one order; what came last before a question answers it
    cap = F.least(F.col("start_ms") + most_ms, "run_end")
    mark = lambda key, kind: F.struct(key.cast("long").alias("key"), F.lit(kind).alias("kind"))
    asked = F.array(mark(F.col("start_ms"), 1), mark(cap, 2), mark(F.col("start_ms") + least_ms, -1))
    marks = F.when(F.col("own"), F.concat(F.array(mark(F.col("end_ms"), 0)), asked)).otherwise(F.array(mark(F.col("end_ms"), 0)))
    events = rows.withColumn("m", F.explode(marks)).withColumns({"key": F.col("m.key"), "kind": F.col("m.kind")})
    is_end = F.col("kind") == 0
    sofar, tocome = by.orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0), by.orderBy(F.desc("key"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({
        "n": F.count(F.when(is_end, 1)).over(sofar), "spoken": F.coalesce(F.sum(F.when(is_end, F.col("end_ms") - F.col("start_ms"))).over(sofar), F.lit(0)),
        "before": F.max(F.when(is_end, F.struct("end_ms", "follower"))).over(sofar), "after": F.last(F.when(is_end, F.col("end_ms")), True).over(tocome),
    })
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    found = events.where("kind <> 0").groupBy("source_id", "turn_id", "start_ms", "end_ms", "head", "follower").agg(
        at(-1, "after").alias("first_ms"), at(2, "before").alias("last"), (at(2, "n") - at(1, "n")).alias("n_turns"), (at(2, "spoken") - at(1, "spoken")).alias("speech_ms")
    )
    holds = F.coalesce(F.col("last.end_ms") > F.col("start_ms"), F.lit(False))  # else the turn alone is too long
    last = F.when(holds, F.col("last.end_ms"))
    return found.select(
        "source_id", "turn_id", "start_ms", F.when(F.col("first_ms") <= last, F.col("first_ms")).alias("first_ms"), last.alias("last_ms"), F.when(holds, F.col("n_turns")).otherwise(0).alias("n_turns"), F.when(holds, F.col("speech_ms")).otherwise(0).alias("speech_ms"),
        F.round(F.when(holds, F.col("speech_ms") / (last - F.col("start_ms"))).otherwise(0.0), 4).alias("density"), "head", F.when(holds, F.col("last.follower")).otherwise(F.col("follower")).alias("next_id"),
    )


def grown_windows(turns: DataFrame, min_ms: int = 35_000, most_ms: int = 60_000, gap_ms: int = 3_500) -> DataFrame:
    """The windows of turn_windows() that can be max(12 s, half of min_ms) long within most_ms."""
    return turn_windows(turns, max(12_000, min_ms // 2), most_ms, gap_ms).where("first_ms is not null").drop("head", "next_id")


def linear_windows(turns: DataFrame, bounds: DataFrame, min_ms: int = 35_000, most_ms: int = 60_000, gap_ms: int = 3_500, left_ms: int = 350, right_ms: int = 650) -> DataFrame:
    """(source_id, start_ms, end_ms, n_turns, speech_ms, extended): windows one after another, each with as many turns as
    most_ms allows, padded by left_ms and right_ms within bounds(source_id, from_ms, to_ms).

    A window under min_ms is extended to it, at its end and then at its start, as far as the bounds go, and left out
    where they don't go far enough. A turn longer than most_ms is passed over."""
    grown = written(turn_windows(turns, 0, most_ms, gap_ms).withColumn("key", F.col("turn_id")), "grown")
    starts = followed(grown.where("next_id is not null").select("source_id", "key", F.col("next_id").alias("to")), grown.where("head"))
    picked = grown.where("last_ms is not null").join(starts, ["source_id", "key"], "left_semi").join(bounds, "source_id")
    padded = picked.withColumns({"s": F.greatest("from_ms", F.col("start_ms") - left_ms), "e": F.least("to_ms", F.col("last_ms") + right_ms)})
    padded = padded.withColumn("extended", F.col("e") - F.col("s") < min_ms)
    padded = padded.withColumn("e", F.when(F.col("extended"), F.least("to_ms", F.col("s") + min_ms)).otherwise(F.col("e")))
    padded = padded.withColumn("s", F.when(F.col("extended"), F.greatest("from_ms", F.col("e") - min_ms)).otherwise(F.col("s")))
    return padded.where(F.col("e") - F.col("s") >= min_ms).select("source_id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "n_turns", "speech_ms", "extended")


def fallback_window(start_ms: Column, end_ms: Column, density: Column, turns: Column, kind: Column, min_ms: int = 35_000, least_density: float = 0.18) -> Column:
    """struct<start_ms, end_ms, kind, story_unit_type> of a window that is taken as it is, or null where it has too little
    speech (missing counts as 0) or is too short; with any turn it is a dialogue_cluster, else an audio_window."""
    unit = F.when(F.coalesce(turns, F.lit(0)) > 0, "dialogue_cluster").otherwise("audio_window")
    good = (F.coalesce(density, F.lit(0.0)) >= least_density) & (end_ms - start_ms >= min_ms)
    return F.when(good, F.struct(start_ms.alias("start_ms"), end_ms.alias("end_ms"), kind.alias("kind"), unit.alias("story_unit_type")))
