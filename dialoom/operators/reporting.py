"""Quality reports over candidate records, sessions and reject logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons


def mean(column: str | Column, digits: int = 4) -> Column:
    """Mean over all rows, missing as 0; 0 without rows."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(F.coalesce(F.sum(F.coalesce(column.cast("decimal(18,6)"), F.lit(0))).cast("double") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), digits)


def rate(test: Column) -> Column:
    return F.round(F.coalesce(F.count_if(test) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4)


def beside(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """rows with the columns of a table of one row, which is broadcast."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one_row.withColumn("__one", F.lit(1))), "__one").drop("__one")


#: Mean scores of a session and the fields of summaries that they are means of.
SESSION_MEANS = {
    "average_hook_score": "hook_score", "average_retention_soft_score": "retention_soft_score", "average_story_completion_score": "story_completion_score", "average_context_completeness_score": "context_completeness_score",
    "subtitle_quality": "subtitle_quality", "pacing_score": "pacing_score", "face_focus_rate": "face_focus_rate", "speaker_confidence_score": "speaker_confidence_score", "visual_conversation_score": "visual_conversation_score",
}
FALLBACKS = ("ranking_fallback_used", "ranking_fast_fallback_used", "watchdog_fallback_used", "semantic_preview_fallback_used")


def session_metrics(records: DataFrame) -> DataFrame:
    """One row of counts, rates and means of records(summary, fallback flags, runtime_ms); zeros, and a null runtime,
    without rows. Tags are counted by tag_counts()."""
    fell_back = F.greatest(*(F.coalesce(F.col(c), F.lit(False)) for c in FALLBACKS))
    published = rate(F.coalesce(F.col("summary.publishable"), F.lit(False)))
    return records.agg(
        F.count("*").alias("count"), published.alias("publishable_rate"), *(mean(f"summary.{c}").alias(n) for n, c in SESSION_MEANS.items()), F.round(F.avg("runtime_ms") / 1000, 3).alias("runtime"),
        published.alias("stability"), rate(fell_back).alias("fallback_frequency"),
    )


def tag_counts(records: DataFrame, column: str) -> DataFrame:
    """(tag, n): how often each tag occurs, repeated ones of a record each."""
    return records.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def label_rates(records: DataFrame) -> DataFrame:
    """(label, occurrences, rate) of every review label, also those that never occur."""
    spark = records.sparkSession
    known = spark.createDataFrame([(x,) for x in lexicons.REVIEW_LABELS], "label string")
    counts = tag_counts(records, "human_labels").withColumnRenamed("tag", "label")
    total = records.agg(F.count("*").alias("records"))
    joined = beside(known.join(counts, "label", "left"), total)
    n = F.coalesce("n", F.lit(0))
    return joined.select("label", n.alias("occurrences"), F.round(F.coalesce(n / F.nullif("records", F.lit(0)), F.lit(0.0)), 4).alias("rate"))


def co_occurrence(records: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The `most` frequent pairs 'a::b', a < b, of distinct tags of one record; a report's list."""
    tags = F.array_sort(F.array_distinct(column))
    pairs = F.flatten(F.transform(tags, lambda a, i: F.transform(F.slice(tags, i + 2, F.size(tags)), lambda b: F.concat_ws("::", a, b))))
    counts = records.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "pair").limit(most)


def histogram(records: DataFrame, column: str, buckets: int = 5) -> DataFrame:
    """(bucket, n) of a score in 0..1, empty buckets too; missing scores aside."""
    bucket = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.col(column) * buckets).cast("int")))
    counts = records.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = records.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def score_spread(records: DataFrame, column: str) -> DataFrame:
    return records.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.round(F.avg(column), 4).alias("mean"), F.count(column).alias("sample_size"))


def session_trend(sessions: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, early, recent, delta): means of the first and last thirds of sessions by created_at, as text; no rows
    for fewer than three. Metrics that either third lacks are left out.

    Sessions are ranked by counts of created_at, which are summed up month by month (by the first seven characters), so only
    the sums of months are in one order."""
    dated = sessions.where("created_at is not null and created_at <> ''")
    stamps = dated.groupBy("created_at").agg(F.count("*").alias("__n")).withColumn("__month", F.substring("created_at", 1, 7))
    earlier = F.coalesce(F.sum("__k").over(Window.orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    months = stamps.groupBy("__month").agg(F.sum("__n").alias("__k")).select("__month", earlier.alias("__before"))
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy("__month").orderBy("created_at").rowsBetween(Window.unboundedPreceding, 0))
    stamps = beside(stamps.join(months, "__month").withColumn("__upto", upto), stamps.agg(F.sum("__n").alias("__of"))).where("__of >= 3")
    tied = F.row_number().over(Window.partitionBy("created_at").orderBy(*columns)) - 1
    placed = dated.withColumn("__tied", tied).join(stamps, "created_at").withColumn("__nth", F.col("__upto") - F.col("__n") + F.col("__tied") + 1)
    third = F.floor(F.col("__of") / 3)
    placed = placed.withColumn("__part", F.when(F.col("__nth") <= third, "early").when(F.col("__nth") > F.col("__of") - third, "recent"))
    tall = placed.where("__part is not null").select("__part", *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["__part"], columns, "metric", "value")
    side = lambda p: F.round(F.avg(F.when(F.col("__part") == p, F.col("value"))), 4)
    both = tall.groupBy("metric").agg(side("early").alias("early"), side("recent").alias("recent")).where("early is not null and recent is not null")
    return both.withColumn("delta", F.round(F.col("recent") - F.col("early"), 4))


def sufficiency(count: Column) -> Column:
    """weak, minimum, recommended or strong, by 100, 250 and 500 reviews."""
    return F.when(count < 100, "weak").when(count < 250, "minimum").when(count < 500, "recommended").otherwise("strong")


#: What to say of each band of sufficiency.
SUFFICIENCY_WARNINGS = {"weak": "insufficient_data_for_confident_iteration", "minimum": "usable_but_still_small", "recommended": "good_enough_for_targeted_changes"}
DISTRIBUTED = ("retention_soft_score", "subtitle_quality", "pacing_score", "speaker_confidence_score", "visual_conversation_score", "face_focus_rate", "hook_score", "story_completion_score", "context_completeness_score")


def baseline_report(records: DataFrame, sessions: DataFrame | None = None, trend: list[str] | None = None) -> DataFrame:
    """The baseline report as rows (section, key, value): metrics, label_rates, root_causes, labels, cooccurrence,
    distributions (key 'score:bucket'), accepted_arcs, sufficiency, warnings and trend. Numbers are doubles.

    Every section is a small aggregate of its own over records(summary, failure_reason, human_labels), so that a report
    of any number of records is a union of a few hundred rows."""
    row = lambda section, key, value: (F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    metrics = session_metrics(records)
    names = [c for c in metrics.columns]
    parts = [metrics.select(*(F.col(c).cast("double").alias(c) for c in names)).unpivot([], names, "key", "value").select(*row("metrics", F.col("key"), F.col("value")))]
    parts.append(label_rates(records).select(*row("label_rates", F.col("label"), F.col("rate"))))
    distinct = records.withColumn("failure_reason", F.array_distinct("failure_reason"))
    parts.append(tag_counts(distinct, "failure_reason").select(*row("root_causes", F.col("tag"), F.col("n"))))
    parts.append(tag_counts(records, "human_labels").select(*row("labels", F.col("tag"), F.col("n"))))
    parts.append(co_occurrence(records, "failure_reason").select(*row("cooccurrence", F.col("pair"), F.col("n"))))
    flat = records.select(*(F.col(f"summary.{c}").alias(c) for c in DISTRIBUTED)).unpivot([], list(DISTRIBUTED), "score", "x").where("x is not null")
    bucket = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("x") * 5).cast("int")))
    parts.append(flat.groupBy("score", bucket.alias("bucket")).agg(F.count("*").alias("n")).select(*row("distributions", F.concat_ws(":", "score", "bucket"), F.col("n"))))
    spread = flat.groupBy("score").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.avg("x"), 4).alias("avg"), F.count("*").cast("double").alias("sample_size"))
    spread = spread.unpivot(["score"], ["min", "max", "avg", "sample_size"], "what", "x")
    parts.append(spread.select(*row("distributions", F.concat_ws(":", "score", "what"), F.col("x"))))
    arcs = records.where("summary.publishable").groupBy(F.coalesce(F.nullif("summary.story_arc_shape", F.lit("")), F.lit("unknown")).alias("arc")).agg(F.count("*").alias("n"))
    parts.append(arcs.select(*row("accepted_arcs", F.col("arc"), F.col("n"))))
    count = records.agg(F.count("*").alias("n"))
    known = F.create_map(*(F.lit(x) for pair in SUFFICIENCY_WARNINGS.items() for x in pair))
    band = count.select(F.explode(F.array_compact(F.array(F.concat(F.lit("status:"), sufficiency(F.col("n"))), F.concat(F.lit("warning:"), F.try_element_at(known, sufficiency(F.col("n"))))))).alias("key"), "n")
    parts.append(band.select(*row("sufficiency", F.col("key"), F.col("n"))))
    small = count.select(F.explode(F.array_compact(F.array(F.when(F.col("n") < 20, "small_sample_size"), F.when(F.col("n") < 100, "below_minimum_data_gate")))).alias("key"))
    parts.append(small.select(*row("warnings", F.col("key"), F.lit(1))))
    if sessions is not None:
        parts.append(session_trend(sessions, trend or [c for c in sessions.columns if c != "created_at"]).select(*row("trend", F.col("metric"), F.col("delta"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two tables (metric, value), metrics of either."""
    both = left.withColumnRenamed("value", "before").join(right.withColumnRenamed("value", "after"), "metric", "full")
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


def duration_profile(rows: DataFrame, by: str, column: str, above: tuple[int, ...] = (60, 120, 240)) -> DataFrame:
    """Per group: count, least, most, mean, upper median (of an even number of values the larger of the middle ones) and
    the share of values above each of some bounds. The median comes from counts of values, not from a list of them."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("__k"))
    order = Window.partitionBy(by).orderBy(column)
    placed = counts.withColumns({"__upto": F.sum("__k").over(order), "__of": F.sum("__k").over(Window.partitionBy(by))})
    middle = placed.where("__upto > floor(__of / 2)").groupBy(by).agg(F.min(column).alias("upper_median"))
    found = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.round(F.avg(column), 4).alias("mean"), *(rate(F.col(column) > s).alias(f"over_{s}") for s in above)
    )
    return found.join(middle, by, "left")


def reject_summary(rejects: DataFrame, warnings: DataFrame, most: int = 3) -> DataFrame:
    """(reason, n, share, examples) of rejects(reason, example) and of warnings(text) that name a reason after 'reject:'."""
    told = warnings.select(F.nullif(F.regexp_extract("text", r"reject:\s*(\w+)", 1), F.lit("")).alias("reason"), F.lit(None).cast("string").alias("example")).where("reason is not null")
    every = rejects.select("reason", "example").unionByName(told)
    counts = every.groupBy("reason").agg(F.count("*").alias("n"))
    first = every.where("example is not null").withColumn("nth", F.row_number().over(Window.partitionBy("reason").orderBy("example"))).where(F.col("nth") <= most)
    shown = first.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("example")), ",").alias("examples"))
    total = every.agg(F.count("*").alias("all"))
    return beside(counts.join(shown, "reason", "left"), total).select("reason", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"), F.coalesce("examples", F.lit("")).alias("examples"))


def chain_validation(chain: DataFrame) -> DataFrame:
    """One row about chains: counts, completion, arcs, lengths in five classes."""
    length = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    within = lambda a, b: F.count_if((length >= a) & (length < b)) if b else F.count_if(length >= a)
    return chain.agg(
        F.count("*").alias("chains"), rate(F.col("is_complete")).alias("complete_rate"), rate(F.col("payoff") != "").alias("payoff_rate"), mean("completion_score").alias("mean_completion"), F.round(F.avg(length), 4).alias("mean_seconds"),
        F.count_if(length < 6).alias("under_6"), within(6, 20).alias("from_6"), within(20, 35).alias("from_20"), within(35, 60).alias("from_35"), within(60, None).alias("from_60"),
    )
