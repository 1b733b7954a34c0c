"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, word_hashes

#: A benchmark of at most this many words is broadcast whole; a larger one is taken in blocks of at most this size.
BLOCK_WORDS = 2_000_000
BASE = 0x100000001B3


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each window of `width` words, modulo 2**64."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + words[k : k + n]
    return out


def useful(text: np.ndarray, places: np.ndarray, reach: int, least: int) -> np.ndarray:
    """places of a text without those that no tiling of a test of `reach` words needs, in order.

    A tile that begins at a place lies within `reach` words on both sides. Of places that are alike that far around,
    the first (reach / least + 1) 3 reach hold as many disjoint runs as there can be tiles, whatever else is marked.
    """
    most = (reach // least + 1) * 3 * reach
    if len(places) <= most:
        return places
    pad = np.zeros(reach, np.uint64)
    around = rolling_long(np.concatenate((pad, text, pad)), 2 * reach)[places]
    by = np.lexsort((places, around))
    new = np.ones(len(by), bool)
    new[1:] = around[by][1:] != around[by][:-1]
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return np.sort(places[by[nth < most]])


def rolling_long(words: np.ndarray, width: int) -> np.ndarray:
    """As rolling(), by doubling: for wide windows."""
    out, size = words, 1
    for bit in bin(width)[3:]:
        out = out[: max(0, len(out) - size)] * np.uint64(pow(BASE, size, 1 << 64)) + out[size:]
        size *= 2
        if bit == "1":
            out = out[: max(0, len(out) - 1)] * np.uint64(BASE) + words[size:]
            size += 1
    return out


def tiles(test: np.ndarray, text: np.ndarray, least: int, starts: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (test start, text start, length) of disjoint common runs.

    Each round finds, by Karp-Rabin hashes of `least` words, the longest runs of words that neither side has marked
    and marks them on both sides (the first in the test, then in the text, where equal ones overlap). Rounds go on
    until no unmarked common run of `least` words is left. starts: text positions worth looking at, all by default.
    """
    where: dict[int, list[int]] = {}
    for p, h in enumerate(rolling(test, least).tolist()):
        where.setdefault(h, []).append(p)
    windows = rolling(text, least)
    starts = np.arange(len(windows)) if starts is None else starts
    starts = useful(text, starts[np.isin(windows[starts], np.array([*where], np.uint64))], len(test), least)
    pairs = {(p, t) for t, h in zip(starts.tolist(), windows[starts].tolist(), strict=True) for p in where.get(h, ())}
    a, used_a, used_b, out = test.tolist(), [False] * len(test), set(), []
    while pairs:
        runs = []
        for p, t in pairs:
            if (p - 1, t - 1) in pairs:
                continue  # inside a run that begins earlier
            n = 0
            while p + n < len(a) and t + n < len(text) and a[p + n] == text[t + n] and not (used_a[p + n] or t + n in used_b):
                n += 1
            if n >= least:
                runs.append((p, t, n))
        longest = max((n for _, _, n in runs), default=0)
        for p, t, n in sorted(r for r in runs if r[2] == longest):
            if not any(used_a[p : p + n]) and used_b.isdisjoint(range(t, t + n)):
                used_a[p : p + n] = [True] * n
                used_b.update(range(t, t + n))
                out.append((p, t, n))
        pairs = {(p, t) for p, t in pairs if runs and not any(used_a[p : p + least]) and used_b.isdisjoint(range(t, t + least))}
    return out


class Tests:
    """Benchmark items as one flat array of word hashes with an index of their seeds, runs of `least` words."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        self.ids, self.least = ids, least
        self.words, self.starts = word_hashes(pa.array(texts, pa.string()))
        lengths = np.diff(self.starts)
        self.width = np.minimum(lengths, least)  # an item shorter than a seed is matched whole
        self.widths = sorted({int(w) for w in self.width if w})
        self.seed: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # hashes in order, item and place of each
        for w in self.widths:
            own = [(h, i, p) for i in np.flatnonzero(self.width == w).tolist() for p, h in enumerate(rolling(self.item(i), w).tolist())]
            own.sort()
            self.seed[w] = np.array([h for h, _, _ in own], np.uint64), np.array([i for _, i, _ in own], np.int64), np.array([p for _, _, p in own], np.int64)

    def item(self, i: int) -> np.ndarray:
        return self.words[self.starts[i] : self.starts[i + 1]]

    def candidates(self, words: np.ndarray, starts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, places in the text where one of the item's seeds begins) of a batch's flat words, for items of
        whose words at least `threshold` lie in seeds that the text holds: tiles can't cover more."""
        sizes = np.diff(self.starts)
        for w in self.widths:
            hashes, items, at = self.seed[w]
            windows = rolling(words, w)
            lo = np.searchsorted(hashes, windows)
            hit = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == windows)
            text = np.searchsorted(starts, hit, side="right") - 1
            inside = hit + w <= starts[text + 1]
            hit, text = hit[inside], text[inside]
            by = np.lexsort((hit, windows[hit], text))
            hit, text = hit[by], text[by]
            new = np.ones(len(by), bool)
            new[1:] = (text[1:] != text[:-1]) | (windows[hit][1:] != windows[hit][:-1])
            first = np.flatnonzero(new)  # each seed of each text once
            begin = lo[hit[first]]
            count = np.searchsorted(hashes, windows[hit[first]], side="right") - begin
            owner = np.repeat(np.arange(len(first)), count)
            seed = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            by = np.lexsort((at[seed], items[seed], text[first][owner]))
            if not len(by):
                continue
            owner, seed = owner[by], seed[by]
            key = text[first][owner] * len(self.ids) + items[seed]
            step = np.full(len(key), w)
            follows = key[1:] == key[:-1]
            step[:-1] = np.where(follows, np.minimum(np.diff(at[seed]), w), w)
            found, index = np.unique(key, return_index=True)
            covered = np.add.reduceat(step, index)
            ends = np.append(first, len(hit))
            for k, lo_, hi_, n in zip(found.tolist(), index.tolist(), [*index[1:].tolist(), len(key)], covered.tolist(), strict=True):
                row, i = divmod(k, len(self.ids))
                if n >= threshold * sizes[i] - 1e-9:
                    places = np.concatenate([hit[ends[o] : ends[o + 1]] for o in np.unique(owner[lo_:hi_])])
                    yield row, i, np.sort(places) - starts[row]


def shares(batch: pa.RecordBatch, tests: Tests, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(row, item index, covered share of the item's words) for each row and item that may reach the threshold."""
    words, starts = word_hashes(batch.column("text"))
    for row, i, places in tests.candidates(words, starts, threshold):
        test = tests.item(i)
        found = tiles(test, words[starts[row] : starts[row + 1]], int(tests.width[i]), places)
        yield row, i, sum(n for _, _, n in found) / len(test)


def tiled(batches: Iterator[pa.RecordBatch], tests: Tests, threshold: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, item_id, coverage)."""
    for batch in slices(batches):
        rows, items, covered = zip(*found, strict=True) if (found := list(shares(batch, tests, threshold))) else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([tests.ids[i] for i in items], pa.int64()), pa.array(covered, pa.float64())],
            ["doc_id", "item_id", "coverage"],
        )


def clean(batches: Iterator[pa.RecordBatch], tests: Tests, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows that cover less than `threshold` of every item."""
    for batch in slices(batches):
        bad = {row for row, _, share in shares(batch, tests, threshold) if share >= threshold}
        yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))


def blocks(benchmark: DataFrame, least: int) -> Iterator[Broadcast]:
    """The benchmark as broadcast Tests, in as many blocks as keep each at about BLOCK_WORDS words."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    count = int(total // BLOCK_WORDS) + 1
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Tests([r["item_id"] for r in rows], [r["text"] for r in rows], least))


def coverages(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.0) -> DataFrame:
    """(doc_id, item_id, coverage): the share of an item's words that tiles of a document cover, where they share a
    run of `least` words (a whole item, where it is shorter); shares that can't reach the threshold may be missing.

    The documents' seeds are joined with the items' in the tasks that read them. Only a benchmark block of at most
    BLOCK_WORDS words is broadcast at a time; a larger benchmark is a union over blocks.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = [texts.mapInArrow(lambda it, t=tests: tiled(it, t.value, threshold), "doc_id long, item_id long, coverage double") for tests in blocks(benchmark, least)]
    return reduce(DataFrame.union, found)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6) -> DataFrame:
    """One row per (doc_id, item_id) with coverage of at least `threshold`, the best where a doc_id is repeated.

    Words are lower-case runs of letters and digits. Passages of a test may come in any order or be broken up, as
    long as each piece has `least` words. Null and empty texts and items without a word match nothing; rows with a
    null doc_id or item_id are left out; repeated items give the better coverage. Extra columns are ignored.
    """
    found = coverages(docs, benchmark, least, threshold).where((F.col("coverage") >= threshold) & F.col("doc_id").isNotNull())
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6) -> DataFrame:
    """docs without the rows whose text holds at least `threshold` of a benchmark item, in one pass without a shuffle."""
    for tests in blocks(benchmark, least):
        docs = docs.mapInArrow(lambda it, t=tests: clean(it, t.value, threshold), docs.schema)
    return docs
