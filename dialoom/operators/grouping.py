"""Conversation blocks: sessions of turns by gaps, with bridges over larger gaps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import topic_words
from . import walks


def in_order():
    """A window over a source's rows in order."""
    return Window.partitionBy("source_id").orderBy("turn_id")


def block_id(source: Column, start_ms: Column, end_ms: Column, turns: Column) -> Column:
    """conv_ and 12 hex digits that depend on source, times in milliseconds and number of turns."""
    return F.concat(F.lit("conv_"), F.substring(F.sha1(F.concat_ws("|", source, start_ms, end_ms, turns)), 1, 12))


def gap_blocks(turns: DataFrame, max_gap_ms: int = 3500) -> DataFrame:
    """turns with block_no: a new block begins where the gap to the turn before is larger than max_gap_ms."""
    gap = F.col("start_ms") - F.lag("end_ms").over(in_order())
    marked = turns.withColumn("new", F.coalesce((gap > max_gap_ms).cast("int"), F.lit(0)))
    return marked.withColumn("block_no", F.sum("new").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def top_words(words: list[str], most: int = 8) -> set[str]:
    """The most frequent words, the first to appear among equals."""
    return {w for w, _ in Counter(words).most_common(most)}


def share(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


class Bridge:
    """The open block of one source: what decides whether the next turn still belongs to it."""

    def __init__(self, max_gap_ms: int = 3500, block: int = 0, speakers: list[str] | None = None, words: list[str] | None = None, size: int = 0, last: int | None = None):
        self.max_gap_ms, self.block, self.speakers, self.words, self.size, self.last = max_gap_ms, block, set(speakers or ()), list(words or ()), size, last

    def next(self, start: int, end: int, speaker: str, words: list[str]) -> int:
        """The block of the next turn, which is open from then on."""
        if self.last is not None and (gap := start - self.last) > self.max_gap_ms:
            reach = self.max_gap_ms * (1.5 if self.size >= 4 else 1.0) * 3
            alike = self.speakers == {speaker} and gap <= reach
            alike = alike or (share(self.speakers, {speaker}) >= 0.5 and gap <= 10_000)
            if not alike and not (gap <= 6_500 and share(top_words(self.words), top_words(words)) >= 0.25):
                self.block, self.speakers, self.words, self.size = self.block + 1, set(), [], 0
        self.speakers.add(speaker)
        self.words += words
        self.size, self.last = self.size + 1, end
        return self.block

    def longest(self) -> int:
        """No gap that is larger can be bridged."""
        return max(int(self.max_gap_ms * 4.5), 10_000)


def bridged_blocks(turns: DataFrame, max_gap_ms: int = 3500) -> DataFrame:
    """turns with block_no, where a gap larger than max_gap_ms may be bridged: up to three times the gap if the next
    speaker alone spoke in the block (1.5 times more from four turns on), 10 s if speakers overlap by half, 6.5 s if
    top words overlap by a quarter. A source, whose blocks depend on all turns before, is walked by one task."""
    keyed = turns.withColumn("words", topic_words(F.col("text")))
    narrow = keyed.select("source_id", "turn_id", "start_ms", "end_ms", "speaker", "words")

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        open_block = Bridge(max_gap_ms)
        return ((turn, open_block.next(start, end, speaker, words)) for turn, start, end, speaker, words in rows)

    out = {"turn_id": turns.schema["turn_id"].dataType.simpleString(), "block_no": "long"}
    return turns.join(walks.walked(narrow, ["source_id"], ["turn_id"], walk, out), ["source_id", "turn_id"])


def blocks(turns: DataFrame) -> DataFrame:
    """One row per (source_id, block_no) of turns: id, times, number of turns, speakers by first appearance, text."""
    ordered = F.array_sort(F.collect_list(F.struct("turn_id", "speaker", "text")))
    found = turns.groupBy("source_id", "block_no").agg(F.min_by("start_ms", "turn_id").alias("start_ms"), F.max_by("end_ms", "turn_id").alias("end_ms"), F.count("*").alias("turn_count"), ordered.alias("turns"))
    return found.select(
        "source_id", "block_no", block_id(F.col("source_id"), F.col("start_ms"), F.col("end_ms"), F.col("turn_count")).alias("conversation_id"), "start_ms", "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "turn_count", F.array_distinct("turns.speaker").alias("speakers"), F.array_join("turns.text", " ").alias("text"),
    )


def ranked_topics(turns: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """The most frequent topic words of each group of turns, with rank; the first to appear wins among equals."""
    spread = turns.select(*by, "turn_id", F.posexplode(topic_words(F.col("text"))).alias("pos", "word"))
    counts = spread.groupBy(*by, "word").agg(F.count("*").alias("n"), F.min(F.struct("turn_id", "pos")).alias("first"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("first")
