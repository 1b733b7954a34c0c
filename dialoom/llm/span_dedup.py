"""Substring dedup by sliding sentence spans and by word passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SOLID, MemberFilter, materialize, mix, slices, word_hashes

SPAN = 3
#: A span of fewer sentences counts where it has this many words; one of SPAN sentences needs LEAST_WORDS.
LONG_WORDS, LEAST_WORDS = 40, 8
#: A passage of so many words counts wherever its edges are. Each holds PASSAGE - GRAM + 1 runs of GRAM words, and is
#: known by the one of the smallest hash; passages that are equal have it in common.
PASSAGE, GRAM = 51, 26
#: A sentence ends after its closing punctuation and white space, or at a line feed; what divides it stays with it.
#: Closing punctuation is looked for where it begins, so that a long run of it is read once.
SENTENCE = re.compile(r"[^\n]*?(?:(?<![.!?])[.!?]+[\"'»”)\]]*(?=\s)[^\S\n]*|(?=\n)|\Z)\n*")


def sentences(text: str) -> list[str]:
    """The sentences of a text, each with the white space that follows it; joined they are the text."""
    return [s for s in SENTENCE.findall(text) if s]


def worded(text: str) -> tuple[list[int], list[str], list[int]]:
    """Numbers, normalized texts and word counts of the sentences that have a word."""
    numbers, keys, sizes = [], [], []
    for i, s in enumerate(sentences(text)):
        own = s.lower().split()
        if own:
            numbers.append(i), keys.append(" ".join(own)), sizes.append(len(own))
    return numbers, keys, sizes


def locally_first(row: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of keys, ordered by key, doc, row and place: their numbers, keys, whether the key occurs earlier in
    the same row, and whether it occurs in an earlier document of this slice. Keys of the latter are made different,
    as they are late whatever other slices hold, so that no key has more rows than one document of each slice."""
    by = np.lexsort((place, row, doc, key))
    key, doc, row = key[by], doc[by], row[by]
    same = key[1:] == key[:-1]
    again, new = np.zeros(len(by), bool), np.ones(len(by), bool)
    again[1:], new[1:] = same & (row[1:] == row[:-1]), ~same
    late = doc != doc[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else again
    key = np.where(late, mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), key)
    return by, key, again, late


def hashed_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to one row per span: its hash, place, length in worded sentences, and whether the same span
    occurs earlier in the same text, and in an earlier one of the slice."""
    for batch in slices(batches):
        keys, sizes, starts = [], [], [0]
        for text in batch.column("text").to_pylist():
            _, own, words = worded(text or "")
            keys += own
            sizes += words
            starts.append(len(keys))
        hashes = pd.util.hash_array(np.asarray(keys, dtype=object), categorize=True) if keys else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        total = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
        ends, rolled, parts = np.array(starts)[1:][owner] if len(owner) else owner, np.zeros(len(hashes), np.uint64), []
        at = np.arange(len(hashes))
        for k in range(1, SPAN + 1):
            inside = at + k <= ends
            rolled[inside] = mix(rolled[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[inside] + k - 1] + np.uint64(k))
            enough = inside.copy()
            enough[inside] = total[at[inside] + k] - total[at[inside]] >= (LEAST_WORDS if k == SPAN else LONG_WORDS)
            parts.append((rolled[enough].copy(), at[enough], np.full(int(enough.sum()), k, np.int32)))
        span, place, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = owner[place]
        doc = batch.column("doc_id").to_numpy()[row]
        by, span, again, late = locally_first(row, doc, span, place)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[by]), pa.array(span.view(np.int64)), pa.array((place - np.array(starts)[row])[by].astype(np.int32)), pa.array(length[by].astype(np.int8)), pa.array(again), pa.array(late)],
            ["doc_id", "span", "place", "length", "again", "late"],
        )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, place): the worded sentences of each document that a non-first repeated span covers."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    spans = base.mapInArrow(hashed_spans, "doc_id long, span long, place int, length byte, again boolean, late boolean")
    spans = spans.withColumn("first", F.min("doc_id").over(Window.partitionBy("span")))
    late = spans.where("late or again or doc_id <> first")
    return late.select("doc_id", F.explode(F.sequence("place", F.expr("place + length - 1"))).alias("place")).distinct()


def rolled(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n elements."""
    factor, out, size = 0x9E3779B97F4A7C15, x, 1
    for bit in bin(n)[3:]:
        out = out[: max(0, len(out) - size)] * np.uint64(pow(factor, size, 1 << 64)) + out[size:]
        size *= 2
        if bit == "1":
            out = out[: max(0, len(out) - 1)] * np.uint64(factor) + x[size:]
            size += 1
    return mix(out)


def passages(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Hashes of words (as split() has them) and of runs of all texts in a row, where each passage begins, its row and place in the text,
    and the place of its run of the smallest hash, the first of equal ones."""
    words, starts = word_hashes(batch.column("text"), SOLID)
    grams = rolled(words, GRAM)
    row = np.repeat(np.arange(batch.num_rows), np.maximum(0, np.diff(starts) - PASSAGE + 1))
    first = np.cumsum(np.concatenate(([0], np.maximum(0, np.diff(starts) - PASSAGE + 1))))[:-1]
    begin = np.arange(len(row)) - first[row] + starts[:-1][row]
    if not len(begin):
        return words, grams, begin, row, begin, begin
    least = np.arange(len(words) - PASSAGE + 1) + np.lib.stride_tricks.sliding_window_view(grams, PASSAGE - GRAM + 1).argmin(axis=1)
    return words, grams, begin, row, begin - starts[:-1][row], least[begin]


def run_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each run that a passage is known by occurs, slice by slice."""
    for batch in slices(batches):
        _, grams, _, _, _, least = passages(batch)
        found, n = np.unique(grams[np.unique(least)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["run", "n"])


def hashed_passages(batches: Iterator[pa.RecordBatch], shared: MemberFilter) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to one row per passage whose run occurs elsewhere too: its hash, the place of its first word,
    and whether it occurs earlier in the same text, and in an earlier one of the slice."""
    for batch in slices(batches):
        words, grams, begin, row, place, least = passages(batch)
        keep = shared.holds([grams[least].view(np.int64)])
        own, row, place = rolled(words, PASSAGE)[begin[keep]], row[keep], place[keep]
        doc = batch.column("doc_id").to_numpy()[row]
        by, own, again, late = locally_first(row, doc, own, place)
        yield pa.RecordBatch.from_arrays([pa.array(doc[by]), pa.array(own.view(np.int64)), pa.array(place[by].astype(np.int32)), pa.array(again), pa.array(late)], ["doc_id", "passage", "word", "again", "late"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, word): where the non-first passages of each document begin; -1 - word where the first one is in the
    same document."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    runs = base.select("doc_id", "text").mapInArrow(run_counts, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(MemberFilter(materialize(runs.select("run"), "passage-runs")))
    found = base.mapInArrow(lambda it: hashed_passages(it, shared.value), "doc_id long, passage long, word int, again boolean, late boolean")
    found = found.withColumn("first", F.min("doc_id").over(Window.partitionBy("passage")))
    elsewhere = F.col("late") | (F.col("doc_id") != F.col("first"))
    return found.where(elsewhere | F.col("again")).select("doc_id", F.when(elsewhere, F.col("word")).otherwise(-1 - F.col("word")).alias("word"))


def covered_words(begins: list[int], n: int) -> np.ndarray:
    """Whether each of n words lies in a passage that begins at one of the places."""
    edges = np.zeros(n + PASSAGE + 1, np.int64)
    at = np.array([b for b in begins if b < n], np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + PASSAGE, -1)
    return np.cumsum(edges)[:n] > 0


def without_words(sentence: str, gone: np.ndarray) -> str:
    """A sentence without some of its words; the white space around it stays."""
    body = sentence.strip()
    left = "".join(w for w, g in zip(re.findall(r"\S+\s*", body), gone, strict=True) if not g).rstrip()
    at = sentence.index(body)
    return sentence[:at] + left + sentence[at + len(body) :]


def cut_text(text: str, places: list[int], begins: list[int]) -> tuple[str, int]:
    """A text without the worded sentences at places, without the words of passages that an earlier document holds,
    and without sentences that lie in passages, and the number of sentences that went, or 1 if only parts did."""
    parts = sentences(text)
    counts = [len(s.split()) for s in parts]
    numbers = [i for i, n in enumerate(counts) if n]  # of worded sentences
    gone = {p for p in places if p < len(numbers)}
    begin, cut = np.concatenate(([0], np.cumsum(np.array([counts[i] for i in numbers], np.int64)))), {}
    if begins:
        total = int(begin[-1])
        elsewhere = covered_words([b for b in begins if b >= 0], total)
        anywhere = elsewhere | covered_words([-1 - b for b in begins if b < 0], total)
        filled = np.add.reduceat(np.append(anywhere, False).astype(np.int64), begin[:-1]) == np.diff(begin) if len(numbers) else np.zeros(0, bool)
        touched = np.add.reduceat(np.append(elsewhere, False).astype(np.int64), begin[:-1]) > 0 if len(numbers) else filled
        gone |= set(np.flatnonzero(filled).tolist())
        cut = {p: elsewhere[begin[p] : begin[p + 1]] for p in np.flatnonzero(touched).tolist() if p not in gone}
    lost = {numbers[p] for p in gone}
    less = {numbers[p]: words for p, words in cut.items()}
    kept = "".join(without_words(s, less[k]) if k in less else s for k, s in enumerate(parts) if k not in lost)
    return kept.rstrip("\n " if lost or less else ""), len(gone) or int(bool(cut))


def cut_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuilds text by cut_text() of __places and __words; __places becomes the number of sentences."""
    for batch in batches:
        texts, removed = batch.column("text").to_pylist(), []
        for i, (places, begins) in enumerate(zip(batch.column("__places").to_pylist(), batch.column("__words").to_pylist(), strict=True)):
            n = 0
            if (places or begins) and texts[i] is not None:
                texts[i], n = cut_text(texts[i], places or [], begins or [])
            removed.append(n)
        names = [c for c in batch.schema.names if c != "__words"]
        columns = [pa.array(texts, pa.string()) if c == "text" else pa.array(removed, pa.int32()) if c == "__places" else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(columns, names)


def dedup_spans(docs: DataFrame) -> DataFrame:
    """docs with the same columns and n_removed, the number of sentences removed from the text, or 1 where only parts of
    sentences go: it is 0 for a text that loses nothing.

    Every run of SPAN consecutive sentences (of LEAST_WORDS words in all), and every shorter run of LONG_WORDS
    words, is hashed, lower-case with white space as single spaces. Of a hash found more than once, all but the
    occurrence in the smallest doc_id, and there the first, go: the sentences that any of them covers are removed.

    Every passage of PASSAGE words is compared too, whatever its sentences are: words that a passage of a smaller
    doc_id holds go, and so do the sentences that lie in passages found before, there or in the same document.

    Null and empty texts stay; a text may become empty. Rows with a null doc_id pass unchanged and match nothing.
    Rows that share a doc_id count as one document: where it is the first, its rows keep the span each. Other
    columns pass through.
    """
    every = repeated_spans(docs).unionByName(repeated_passages(docs), allowMissingColumns=True)
    gone = every.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("place").alias("__places"), F.collect_set("word").alias("__words"))
    joined = docs.join(gone, docs["doc_id"] == F.col("__doc"), "left").drop("__doc")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(cut_sentences, f"{schema}, __places int").withColumnRenamed("__places", "n_removed")
