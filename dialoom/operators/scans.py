"""Running states of long sequences: each row is a function of the state before it, and functions of one kind compose to one
of that kind. Slices of rows are composed to one function each, these are scanned in the same way, and each slice is then
walked from the state that it is entered with. So a sequence is as many tasks as it has slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a slice.
WIDTH = 256


def scanned(rows: DataFrame, by: list[str], step: Callable[[Column, Column], Column], compose: Callable[[Column, Column], Column], state: str, width: int = WIDTH) -> DataFrame:
    """rows(by, nth, f) as (by, nth, entered, state): the state before and after each row, in the order of nth, a whole number
    that no two rows of a sequence share; it may have gaps. The first row is entered with null.

    step: a state after a function; compose: the function that is one and then another; state: SQL type of states."""
    rows = written(rows.select(*by, F.col("nth").cast("long"), "f"), "scan")
    low, high = rows.agg(F.min("nth"), F.max("nth")).first()
    sliced = rows.withColumn("slice", F.floor((F.col("nth") - F.lit(low)) / width))
    ordered = F.array_sort(F.collect_list(F.struct("nth", "f")), lambda a, b: F.when(a["nth"] < b["nth"], -1).when(a["nth"] > b["nth"], 1).otherwise(0))
    packs = sliced.groupBy(*by, "slice").agg(ordered.alias("steps"))
    if low is None or high - low < width:
        packs = packs.withColumn("entry", F.lit(None).cast(state))
    else:
        whole = F.aggregate(F.slice("steps", F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0))), F.get("steps", F.lit(0))["f"], lambda f, s: compose(f, s["f"]))
        entries = scanned(packs.select(*by, F.col("slice").alias("nth"), whole.alias("f")), by, step, compose, state, width)
        packs = packs.join(entries.select(*by, F.col("nth").alias("slice"), F.col("entered").alias("entry")), [*by, "slice"])
    kind = f"array<struct<nth:bigint,entered:{state},state:{state}>>"

    def walk(acc: Column, s: Column) -> Column:
        after = step(acc["at"], s["f"])
        return F.struct(after.cast(state).alias("at"), F.concat(acc["out"], F.array(F.struct(s["nth"].alias("nth"), acc["at"].alias("entered"), after.cast(state).alias("state"))).cast(kind)).alias("out"))

    walked = F.aggregate("steps", F.struct(F.col("entry").alias("at"), F.array().cast(kind).alias("out")), walk)["out"]
    return packs.select(*by, F.explode(walked).alias("w")).select(*by, "w.*")


def looked_up(state: Column, f: Column) -> Column:
    """The state after f, a struct of moves (an array of struct<k, v>) and of the state after any other one."""
    return F.coalesce(F.get(F.filter(f["moves"], lambda m: m["k"] == state), F.lit(0))["v"], f["other"])


def looked_up_twice(f: Column, g: Column) -> Column:
    return F.struct(F.transform(f["moves"], lambda m: F.struct(m["k"].alias("k"), looked_up(m["v"], g).alias("v"))).alias("moves"), looked_up(f["other"], g).alias("other"))


def decayed(state: Column, f: Column) -> Column:
    """The state after f, a struct of numbers: least(high, greatest(low, keep * state + add)), keep being 0 at least; no
    state counts as 0."""
    return F.least(f["high"], F.greatest(f["low"], f["keep"] * F.coalesce(state, F.lit(0.0)) + f["add"]))


def decayed_twice(f: Column, g: Column) -> Column:
    bound = lambda x: F.least(g["high"], F.greatest(g["low"], g["keep"] * x + g["add"]))
    return F.struct((f["keep"] * g["keep"]).alias("keep"), (f["add"] * g["keep"] + g["add"]).alias("add"), bound(f["low"]).alias("low"), bound(f["high"]).alias("high"))
