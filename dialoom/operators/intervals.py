"""Interval algebra: merging, runs, lookups, remapping after cuts, overlap-limited selection, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def merge_intervals(intervals: DataFrame, tolerance_ms: int = 80) -> DataFrame:
    """(source_id, start_ms, end_ms, n): overlapping intervals, or ones at most tolerance_ms apart, as one."""
    order = Window.partitionBy("source_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.select("source_id", "start_ms", "end_ms", F.coalesce((F.col("start_ms") > reach + tolerance_ms).cast("int"), F.lit(1)).alias("new"))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("island", island).groupBy("source_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("island")


def key_runs(rows: DataFrame, key: str, order_by: list[str], max_gap_ms: int | None = None) -> DataFrame:
    """Consecutive rows of one key as one run (source_id, run, key, start_ms, end_ms, n); a run ends with its last
    row. With max_gap_ms, a run also ends before a row that begins later than that."""
    order = Window.partitionBy("source_id").orderBy(*order_by)
    new = ~F.col(key).eqNullSafe(F.lag(key).over(order)) | F.lag("start_ms").over(order).isNull()
    if max_gap_ms is not None:
        new = new | (F.col("start_ms") - F.lag("end_ms").over(order) >= max_gap_ms)
    marked = rows.withColumn("new", new.cast("int")).withColumn("nth", F.row_number().over(order))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("source_id", "run").agg(F.min_by(key, "nth").alias(key), F.min_by("start_ms", "nth").alias("start_ms"), F.max_by("end_ms", "nth").alias("end_ms"), F.count("*").alias("n"))


def active_at(points: DataFrame, intervals: DataFrame, span_ms: int) -> DataFrame:
    """points(source_id, at_ms) with the first interval of the source that holds the point, start <= at < end.

    An interval is copied to each span_ms slot that it touches, so the join is on equal keys."""
    slots = F.sequence(F.floor(F.col("start_ms") / span_ms), F.floor((F.greatest("end_ms", F.col("start_ms") + 1) - 1) / span_ms))
    spread = intervals.select("source_id", "start_ms", "end_ms", "id", F.explode(slots).alias("slot")).withColumnRenamed("source_id", "s")
    near = points.withColumn("slot", F.floor(F.col("at_ms") / span_ms)).join(spread, (F.col("source_id") == F.col("s")) & (points["at_ms"] >= spread["start_ms"]) & (points["at_ms"] < spread["end_ms"]) & (F.floor(points["at_ms"] / span_ms) == spread["slot"]), "left").drop(spread["slot"])
    return near.groupBy("source_id", "at_ms").agg(F.min(F.struct("start_ms", "id", "end_ms")).alias("hit")).select("source_id", "at_ms", F.col("hit.id").alias("id"))


def neighbours(gaps: DataFrame, voiced: DataFrame, tolerance_ms: int = 20) -> DataFrame:
    """gaps(source_id, start_ms, end_ms) with the lengths of the last voiced interval that ends at the gap's start or
    before and of the first that starts at its end or later, within tolerance_ms; 0 where there is none.

    A task sorts its sources twice, and holds besides what `voiced` and `gaps` do in the same stage, where both come dealt by
    source: so voiced is best a table that is written already."""
    # a running extreme over both tables in one order: no pair of rows meets. Intervals that lack a time are nobody's neighbours
    timed = voiced.where("start_ms is not null and end_ms is not null").select("source_id", "start_ms", "end_ms", F.lit(0).alias("kind"))
    both = timed.unionByName(gaps.select("source_id", "start_ms", "end_ms", F.lit(1).alias("kind"))).repartition("source_id")
    asks, length = F.col("kind") == 1, F.col("end_ms") - F.col("start_ms")
    own = F.when(~asks, F.struct("start_ms", "end_ms", length.alias("ms")))
    order = lambda asked, key: Window.partitionBy("source_id").orderBy(F.when(asks, asked).otherwise(key), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("prev_ms", F.coalesce(F.max(own).over(order(F.col("start_ms") + tolerance_ms, F.col("end_ms")))["ms"], F.lit(0)))
    found = found.withColumn("next_ms", F.coalesce(F.min(own).over(order(tolerance_ms - F.col("end_ms"), -F.col("start_ms")))["ms"], F.lit(0)))
    return found.where(asks).select("source_id", "start_ms", "end_ms", "prev_ms", "next_ms")


def with_removed(rows: DataFrame, at: str, cuts: DataFrame, name: str) -> DataFrame:
    """rows with how much of the disjoint cuts(source_id, start_ms, end_ms) lies before the time in column `at`.

    Running sums over the rows' times and the cuts' ends in one order: no row holds the cuts of a source."""
    order = Window.partitionBy("source_id").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.array(F.struct(F.col("start_ms").alias("key"), F.lit(1).cast("long").alias("n"), (-F.col("start_ms")).alias("off")), F.struct(F.col("end_ms").alias("key"), F.lit(-1).cast("long").alias("n"), F.col("end_ms").alias("off")))
    marks = cuts.where("source_id is not null and end_ms > start_ms").select("source_id", F.explode(ends).alias("e")).select("source_id", "e.*")
    none = F.lit(0).cast("long")
    asked = rows.select("source_id", F.col(at).alias("key"), none.alias("n"), none.alias("off"), F.struct("*").alias("row"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    both = both.withColumn(name, F.col("key") * F.sum("n").over(order) + F.sum("off").over(order))
    return both.where("row is not null").select("row.*", name)


def remap(rows: DataFrame, cuts: DataFrame, moved: str | None = None) -> DataFrame:
    """rows(source_id, start_ms, end_ms, ...) at their times after cuts(source_id, start_ms, end_ms) are taken out;
    rows that become empty go, unless all of a source's would: then they stay as they were. moved: name of a column that
    tells which is the case."""
    joined = with_removed(with_removed(rows, "start_ms", cuts, "before_s"), "end_ms", cuts, "before_e")
    joined = joined.withColumns({"s": F.col("start_ms") - F.col("before_s"), "e": F.col("end_ms") - F.col("before_e")})
    some = F.max((F.col("e") > F.col("s")).cast("int")).over(Window.partitionBy("source_id")) == 1
    kept = joined.withColumn("some", some).where("not some or e > s")
    kept = kept.withColumns({"start_ms": F.when(F.col("some"), F.col("s")).otherwise(F.col("start_ms")), "end_ms": F.when(F.col("some"), F.col("e")).otherwise(F.col("end_ms"))})
    return (kept.withColumn(moved, F.col("some")) if moved else kept).drop("before_s", "before_e", "s", "e", "some")


def remap_words(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows(source_id, id, start_ms, end_ms, words), words an array of struct<start_ms, end_ms, word>, after the cuts:
    rows as remap() has them, and inside each the words that keep a length, in their order, at their new times.

    Words are moved by the same sweep as rows, one row each, and gathered by row again; a null array is empty. Where a
    source would lose all its rows, they keep their words as they are."""
    each = rows.select("source_id", "id", F.posexplode("words").alias("pos", "w")).select("source_id", "id", "pos", "w.start_ms", "w.end_ms", "w.word")
    at = with_removed(with_removed(each, "start_ms", cuts, "before_s"), "end_ms", cuts, "before_e")
    at = at.select("source_id", "id", "pos", (F.col("start_ms") - F.col("before_s")).alias("start_ms"), (F.col("end_ms") - F.col("before_e")).alias("end_ms"), "word").where("end_ms > start_ms")
    words = at.groupBy("source_id", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "start_ms", "end_ms", "word"))).alias("placed"))
    moved = remap(rows, cuts, "moved").join(words, ["source_id", "id"], "left")
    bare = lambda c: F.transform(c, lambda w: F.struct(w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["word"].alias("word")))
    none = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,word:string>>")
    return moved.withColumn("words", F.coalesce(F.when(F.col("moved"), bare("placed")).otherwise(bare("words")), none)).drop("placed", "moved")


def integrity(rows: DataFrame) -> DataFrame:
    """(source_id, id, problem, n): what is wrong with the times of rows(source_id, id, start_ms, end_ms, words).

    Of a row: `empty` (no length), `overlap` (begins before the row before it ends). Of its words: `word_empty`,
    `word_order` (begins before the one before it), `word_overlap` (begins before that ends), `word_outside` (of the row)."""
    before = F.lag("end_ms").over(Window.partitionBy("source_id").orderBy("start_ms", "end_ms", "id"))
    words, count = F.coalesce("words", F.expr("filter(words, w -> false)")), lambda c: F.size(c).cast("long")
    pairs = lambda test: count(F.filter(F.transform(F.col("w"), lambda x, i: (i > 0) & test(x, F.get("w", i - 1))), lambda x: x))
    found = {
        "empty": (F.col("end_ms") <= F.col("start_ms")).cast("long"), "overlap": F.coalesce((F.col("start_ms") < F.col("before")).cast("long"), F.lit(0)),
        "word_empty": count(F.filter("w", lambda x: x["end_ms"] <= x["start_ms"])), "word_order": pairs(lambda x, y: x["start_ms"] < y["start_ms"]), "word_overlap": pairs(lambda x, y: x["start_ms"] < y["end_ms"]),
        "word_outside": count(F.filter("w", lambda x: (x["start_ms"] < F.col("start_ms")) | (x["end_ms"] > F.col("end_ms")))),
    }
    marked = rows.withColumns({"before": before, "w": words})
    tall = marked.select("source_id", "id", F.explode(F.array(*(F.struct(F.lit(k).alias("problem"), F.coalesce(v, F.lit(0)).alias("n")) for k, v in found.items()))).alias("p"))
    return tall.select("source_id", "id", "p.problem", "p.n").where("n > 0")


def running(marks: DataFrame, sums: dict[str, str], slot_ms: int) -> DataFrame:
    """marks(source_id, key, ...), one of a key in a source, with running sums: of column v under the name k, for each
    k: v of `sums`. A source is summed slot by slot of time, then over the sums of its slots."""
    slot = F.floor(F.col("key") / slot_ms)
    marks = marks.withColumn("slot", slot)
    earlier = Window.partitionBy("source_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    per = marks.groupBy("source_id", "slot").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    per = per.select("source_id", "slot", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"base_{k}") for k in sums))
    own = Window.partitionBy("source_id", "slot").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return marks.join(per, ["source_id", "slot"]).withColumns({k: F.col(f"base_{k}") + F.sum(v).over(own) for k, v in sums.items()}).drop(*(f"base_{k}" for k in sums))


def sweep(a: DataFrame, b: DataFrame, slot_ms: int = 3_600_000) -> DataFrame:
    """(source_id, start_ms, end_ms, in_a, in_b): time cut where intervals a or b (source_id, start_ms, end_ms) begin or cease
    to cover it, as few pieces as can be; what neither covers is left out.

    Signed events of both tables are added up in one order. Events of a source are spread over slots of time. Intervals
    without a length, a source or a time go."""
    ends = lambda t, x, y: t.where("end_ms > start_ms and source_id is not null").select("source_id", F.explode(F.array(*(F.struct(F.col(c).alias("key"), F.lit(sign * x).alias("da"), F.lit(sign * y).alias("db")) for c, sign in (("start_ms", 1), ("end_ms", -1))))).alias("e")).select("source_id", "e.*")
    marks = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy("source_id", "key").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    at = running(marks, {"a": "da", "b": "db"}, slot_ms)
    turned = ((F.col("a") > 0) != (F.col("a") - F.col("da") > 0)) | ((F.col("b") > 0) != (F.col("b") - F.col("db") > 0))
    at = at.where(turned)
    own = Window.partitionBy("source_id", "slot").orderBy("key")
    later = at.groupBy("source_id", "slot").agg(F.min("key").alias("first")).withColumn("later", F.lead("first").over(Window.partitionBy("source_id").orderBy("slot"))).drop("first")
    pieces = at.join(later, ["source_id", "slot"]).withColumn("end_ms", F.coalesce(F.lead("key").over(own), "later"))
    return pieces.where("a > 0 or b > 0").select("source_id", F.col("key").alias("start_ms"), "end_ms", (F.col("a") > 0).alias("in_a"), (F.col("b") > 0).alias("in_b"))


def difference(a: DataFrame, b: DataFrame, slot_ms: int = 3_600_000) -> DataFrame:
    """(source_id, start_ms, end_ms): what intervals a cover and b don't."""
    return sweep(a, b, slot_ms).where("in_a and not in_b").select("source_id", "start_ms", "end_ms")


def keep_list(sources: DataFrame, cuts: DataFrame, slot_ms: int = 3_600_000) -> DataFrame:
    """(source_id, start_ms, end_ms): what is left of sources(source_id, start_ms, end_ms) without cuts, which may overlap
    and may pass the ends of the source."""
    return difference(sources, cuts, slot_ms)


def compacted(rows: DataFrame, gap_ms: int, slot_ms: int = 3_600_000) -> DataFrame:
    """rows(source_id, id, start_ms, end_ms, words) without the pauses over gap_ms between them, with `changed` and
    `removed_ms` of their source.

    A source with one block of talk stays as it is, and so does one where integrity() finds a fault afterwards that was not
    there before: the safer version is kept."""
    blocks = merge_intervals(rows, gap_ms)
    whole = blocks.groupBy("source_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("blocks"))
    cuts = difference(whole.where("blocks > 1"), blocks, slot_ms)
    moved = written(remap_words(rows, cuts), "moved")
    faults = integrity(moved).join(integrity(rows), ["source_id", "id", "problem"], "left_anti").select("source_id").distinct()
    removed = cuts.join(faults, "source_id", "left_anti").groupBy("source_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("removed_ms"))
    kept = rows.join(removed, "source_id", "left_anti").withColumns({"changed": F.lit(False), "removed_ms": F.lit(0).cast("long")})
    return moved.join(removed, "source_id").withColumn("changed", F.lit(True)).unionByName(kept)


#: Candidates of a source that are looked at in one round of overlap_limited().
ROUND = 64


def overlap_limited(candidates: DataFrame, most: int, limit: float = 0.4) -> DataFrame:
    """Per source, greedily by score: a candidate is picked unless its overlap with a picked one, as a share of the
    span of both, is over the limit; at most `most` are. Ties go by id and times; repeated rows count once.

    A round takes the ROUND best candidates of each source that don't clash with what was picked before, and picks among
    these in order; so it picks one at least, and few rounds are needed. A source's other candidates are only compared
    with its picks, which are `most` at most and are written to the shared folder each round."""
    row = F.struct((-F.col("score")).alias("o"), "id", "start_ms", "end_ms", "score")
    every = candidates.select("source_id", row.alias("c"))

    def clash(p: Column, c: Column) -> Column:
        inter = F.greatest(F.lit(0), F.least(p["end_ms"], c["end_ms"]) - F.greatest(p["start_ms"], c["start_ms"]))
        hull = F.greatest(p["end_ms"], c["end_ms"]) - F.least(p["start_ms"], c["start_ms"])
        return (hull > 0) & (inter / F.nullif(hull, F.lit(0)) > limit)

    fold = lambda acc, c: F.when((F.size(acc) >= most) | F.exists(acc, lambda p: clash(p, c)), acc).otherwise(F.concat(acc, F.array(c)))
    best = Window.partitionBy("source_id").orderBy("c")
    picked, left = None, every
    while picked is None or not left.isEmpty():
        top = left.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= ROUND).groupBy("source_id").agg(F.array_distinct(F.array_sort(F.collect_list("c"))).alias("top"))
        if picked is None:
            state = top.withColumn("picks", F.slice("top", 1, 0))
        else:
            state = picked.withColumnRenamed("source_id", "s").join(top, F.col("s").eqNullSafe(F.col("source_id")), "left").select(F.col("s").alias("source_id"), "picks", "seen", F.coalesce("top", F.slice("picks", 1, 0)).alias("top"))
        seen = F.get("top", F.size("top") - 1)
        picked = written(state.select("source_id", F.aggregate("top", F.col("picks"), fold).alias("picks"), (seen if picked is None else F.coalesce(seen, "seen")).alias("seen")), "picks")
        rest = every.join(picked.withColumnRenamed("source_id", "s"), F.col("source_id").eqNullSafe(F.col("s")))
        left = rest.where((F.col("c") > F.col("seen")) & (F.size("picks") < most) & ~F.exists("picks", lambda p: clash(p, F.col("c")))).select("source_id", "c")
    return picked.select("source_id", F.explode("picks").alias("p")).select("source_id", "p.id", "p.start_ms", "p.end_ms", "p.score")


def fixed_grid(sources: DataFrame, width_ms: int, step_ms: int | None = None) -> DataFrame:
    """sources(source_id, total_ms) as windows [k step, min(total, k step + width)); step_ms is the width by default."""
    step = step_ms or width_ms
    starts = F.when(F.col("total_ms") > 0, F.sequence(F.lit(0).cast("long"), F.col("total_ms") - 1, F.lit(step).cast("long")))
    grid = sources.select("source_id", "total_ms", F.explode(starts).alias("start_ms"))
    return grid.select("source_id", "start_ms", F.least("total_ms", F.col("start_ms") + width_ms).alias("end_ms"))


def points_per_window(points: DataFrame, width_ms: int) -> DataFrame:
    """Counts and means of points(source_id, at_ms, value) per window of width_ms, by an equal window number."""
    return points.withColumn("window", F.floor(F.col("at_ms") / width_ms)).groupBy("source_id", "window").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def min_max(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Adds `column`_norm, scaled to 0..1 within `by`; a range under 1e-6 counts as 1."""
    over = Window.partitionBy(by)
    low, high = F.min(column).over(over), F.max(column).over(over)
    return rows.withColumn(f"{column}_norm", (F.col(column) - low) / F.when(high - low > 1e-6, high - low).otherwise(1.0))


def switches(rows: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """How often the key changes within each source, rows without a key aside."""
    order = Window.partitionBy("source_id").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(key, ignorenulls=True).over(order)
    changed = F.col(key).isNotNull() & before.isNotNull() & (F.col(key) != before)
    return rows.withColumn("changed", changed.cast("int")).groupBy("source_id").agg(F.sum("changed").alias("switches"), F.count(key).alias("keyed"))


def loudness(samples: DataFrame, slot_ms: int, floor: float = 400.0, times: float = 1.2) -> DataFrame:
    """Per source of samples(source_id, at_ms, value): density, the share of slots whose root mean square is above `floor`
    and `times` the median of slots, and the loudest slot."""
    slots = samples.groupBy("source_id", F.floor(F.col("at_ms") / slot_ms).alias("slot")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    limit = slots.groupBy("source_id").agg(F.greatest(F.lit(floor), times * F.median("rms")).alias("limit_"))
    return slots.join(limit, "source_id").groupBy("source_id").agg(F.round(F.avg((F.col("rms") > F.col("limit_")).cast("int")), 4).alias("density"), F.round(F.max("rms"), 4).alias("loudest"))
