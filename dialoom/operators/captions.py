"""Caption events: merging, sentences, word highlights and a timeline without flicker.

What a row becomes depends on the rows before it, so each source's events are walked in order by one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import caption_lines, drop_repeats, suspicious, tidy
from . import walks

END = (".", "!", "?", "…")
Event = tuple[int, int, str]


def walked(events: DataFrame, walk: Callable[[Iterator[Event]], Iterator[tuple]], **more: str) -> DataFrame:
    """events(source_id, start_ms, end_ms, text) through `walk`, per source, in order of time; numbered by nth."""
    narrow = events.select(F.col("source_id").cast("string"), F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), "text")
    numbered = lambda rows: ((i, *r) for i, r in enumerate(walk(rows)))
    return walks.walked(narrow, ["source_id"], ["start_ms", "end_ms", "text"], numbered, {"nth": "int", "start_ms": "long", "end_ms": "long", "text": "string", **more})


def merged_segments(events: DataFrame, gap_ms: int = 220, short: int = 28, most: int = 52) -> DataFrame:
    """Neighbours at most gap_ms apart as one segment, if one is short, both fit `most` characters and the first
    doesn't end a sentence."""

    def walk(rows: Iterator[Event]) -> Iterator[Event]:
        last = None
        for start, end, text in ((a, b, " ".join((t or "").split())) for a, b, t in rows):
            if not text:
                continue
            if last and start - last[1] <= gap_ms and min(len(last[2]), len(text)) <= short and len(last[2]) + len(text) <= most and not last[2].endswith(END):
                last = (last[0], max(last[1], end), f"{last[2]} {text}")
            else:
                if last:
                    yield last
                last = (start, end, text)
        if last:
            yield last

    return walked(events, walk)


def short_silences(events: DataFrame, keep_ms: int = 1_000, words: int = 12) -> DataFrame:
    """Neighbours at most keep_ms apart as one segment of at most `words` words, unless the first ends a sentence."""

    def walk(rows: Iterator[Event]) -> Iterator[Event]:
        last = None
        for start, end, text in rows:
            if last and start - last[1] <= keep_ms and len(f"{last[2]} {text}".split()) <= words and not last[2].strip().endswith(END):
                last = (last[0], max(last[1], end), " ".join(f"{last[2]} {text}".split()))
            else:
                if last:
                    yield last
                last = (start, end, text)
        if last:
            yield last

    return walked(events, walk)


def word_events(events: DataFrame) -> DataFrame:
    """One row (source_id, nth, start_ms, end_ms, text) per word, times shared out evenly over an event."""
    words = F.split(tidy(F.col("text")), " ")
    spread = events.select("source_id", "start_ms", "end_ms", F.size(words).alias("n"), F.posexplode(words).alias("nth", "text")).where("text <> ''")
    at = lambda k: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.col("n"))
    return spread.select("source_id", "nth", at(F.col("nth")).alias("start_ms"), at(F.col("nth") + 1).alias("end_ms"), "text")


def sentences(words: DataFrame, pause_ms: int = 450, most: int = 8) -> DataFrame:
    """Words as sentences: a pause, closing punctuation or `most` words end one; a comma does from half on."""

    def walk(rows: Iterator[Event]) -> Iterator[Event]:
        current: list[Event] = []

        def closed() -> Event:
            said = (current[0][0], current[-1][1], " ".join(w[2] for w in current))
            current.clear()
            return said

        for word in rows:
            if current and word[0] - current[-1][1] >= pause_ms:
                yield closed()
            current.append(word)
            soft = word[2].endswith((",", ";", ":")) and len(current) >= max(4, most // 2)
            if word[2].endswith(END) or soft or len(current) >= most:
                yield closed()
        if current:
            yield closed()

    return walked(words, walk)


def stable_timeline(events: DataFrame, hold_ms: int = 900, ttl_ms: int = 2_200, persist_ms: int = 1_200, soft_ms: int = 480, clear_ms: int = 4_000) -> DataFrame:
    """Events at centiseconds without overlap, each with its state: a gap to the next is bridged up to hold_ms; after
    a phrase of ttl_ms it is closed; up to persist_ms the phrase is held soft_ms longer; up to clear_ms it is bridged;
    else the caption goes dark and shows anew."""
    down, up = (lambda x: x // 10 * 10), (lambda x: -(-x // 10) * 10)

    def walk(rows: Iterator[Event]) -> Iterator[tuple]:
        last = None
        for begin, end, text in rows:
            start = down(max(0, begin))
            now = {"start_ms": start, "end_ms": max(start + 10, up(end)), "text": text, "state": "show_phrase"}
            if last:
                now["start_ms"] = max(now["start_ms"], last["end_ms"])
                gap, age = now["start_ms"] - last["end_ms"], last["end_ms"] - last["start_ms"]
                changed = "replace_phrase" if now["text"] != last["text"] else "hold_phrase"
                if 0 < gap <= hold_ms:
                    last["end_ms"], now["state"] = now["start_ms"], changed
                elif gap > 0 and age >= ttl_ms:
                    last["end_ms"] = now["start_ms"]
                elif 0 < gap <= persist_ms:
                    last["end_ms"], now["state"] = min(now["start_ms"], last["end_ms"] + soft_ms), changed
                elif 0 < gap <= clear_ms:
                    last["end_ms"], now["state"] = now["start_ms"], "replace_phrase"
                if now["end_ms"] <= now["start_ms"]:
                    now["end_ms"] = now["start_ms"] + 120
                yield tuple(last.values())
            last = now
        if last:
            yield tuple(last.values())

    return walked(events, walk, state="string")


def timeline_stats(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("source_id").agg(F.count("*").alias("events"), F.count_if(F.col("state") == "replace_phrase").alias("replaced"), F.round(F.percentile(F.col("end_ms") - F.col("start_ms"), F.lit(0.95)), 4).alias("hold_p95_ms"))


def corrected(text: Column) -> Column:
    """Without repeated words; a full stop closes six words or more that aren't suspicious."""
    words = drop_repeats(F.split(tidy(text), " "))
    joined = F.array_join(words, " ")
    return F.when(~joined.rlike("[.!?]$") & (F.size(words) >= 6) & ~suspicious(joined), F.concat(joined, F.lit("."))).otherwise(joined)


def highlighted(words: Column, active: Column) -> Column:
    """The words as one text, the active one in '[' and ']'."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i == active, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")


def highlight_events(sentence: DataFrame) -> DataFrame:
    """One event per word of sentences(source_id, nth, start_ms, end_ms, text), times shared out evenly."""
    words = F.split("text", " ")
    spread = sentence.select("source_id", "nth", "start_ms", "end_ms", words.alias("words"), F.posexplode(words).alias("k", "word"))
    at = lambda k: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.size("words"))
    return spread.select("source_id", "nth", "k", at(F.col("k")).alias("start_ms"), at(F.col("k") + 1).alias("end_ms"), highlighted(F.col("words"), F.col("k")).alias("text"))


def srt(events: DataFrame) -> DataFrame:
    """Numbered SubRip cues of events, captions in up to two lines."""
    from pyspark.sql import Window

    from ..functions.text import timestamp

    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms", "end_ms"))
    cue = F.concat_ws("\n", F.col("cue").cast("string"), F.concat(timestamp(F.col("start_ms")), F.lit(" --> "), timestamp(F.col("end_ms"))), caption_lines(F.col("text")), F.lit(""))
    return events.withColumn("cue", nth).select("source_id", "cue", cue.alias("srt"))


def split_long(words: DataFrame, most: int = 26, lines: int = 2, most_words: int = 7) -> DataFrame:
    """Segments of more than most * lines characters, given as words(source_id, segment, nth, start_ms, end_ms, text), as
    pieces (source_id, segment, piece, start_ms, end_ms, text); others are one piece. A piece ends when it has most * lines
    characters, or most_words * lines words, or from `most` characters on at closing or pausing punctuation."""
    row = F.struct("nth", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text")
    segments = words.groupBy(F.col("source_id").cast("string").alias("source_id"), F.col("segment").cast("long").alias("segment")).agg(F.sort_array(F.collect_list(row)).alias("words"))
    return pieces(segments, most, lines, most_words)


def pieces(segments: DataFrame, most: int = 26, lines: int = 2, most_words: int = 7) -> DataFrame:
    """split_long() of segments(source_id, segment, words) that hold their words in order, as structs with start_ms, end_ms
    and text: row by row, without a shuffle."""

    @F.pandas_udf("array<int>")
    def starts(texts: pd.Series) -> pd.Series:
        """Where the pieces begin, and the number of words."""

        def cut(texts: np.ndarray) -> list[int]:
            at, size, n = [0], 0, len(texts)
            if sum(map(len, texts)) + n - 1 > most * lines:
                for i, word in enumerate(texts):
                    size += len(word) + (i > at[-1])
                    if (size >= most and word.endswith((".", "!", "?", ",", ";", ":"))) or size >= most * lines or i + 1 - at[-1] >= most_words * lines:
                        at.append(i + 1)
                        size = 0
            return at if at[-1] == n else [*at, n]

        return texts.map(cut)

    own = segments.where(F.size("words") > 0).select(F.col("source_id").cast("string"), F.col("segment").cast("long"), "words").withColumn("at", starts(F.col("words.text")))
    runs = F.transform(F.slice("at", F.lit(1), F.size("at") - 1), lambda a, i: F.slice("words", a + 1, F.get("at", i + 1) - a))
    each = own.select("source_id", "segment", F.posexplode(runs).alias("piece", "w"))
    return each.select("source_id", "segment", F.col("piece").cast("long").alias("piece"), F.get("w.start_ms", F.lit(0)).alias("start_ms"), F.element_at("w.end_ms", -1).alias("end_ms"), F.array_join("w.text", " ").alias("text"))
