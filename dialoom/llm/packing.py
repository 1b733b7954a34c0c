"""Packing documents into fixed token windows by minimum bin slack."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, give_back, materialize, mix, slices

END_ID = 1
#: Words whose ids a worker keeps, over its tasks: some 60 MB.
CACHED_WORDS = 300_000
#: Rows per rank group: the ranks of pieces of one length are counted in this many rows at a time, on average.
RANK_ROWS = 5_000
#: Added tokens are matched before white space is split; control characters are split differently by Arrow.
ODD = r"[\x00-\x08\x0e-\x1f\x7f]|<\|startoftext\|>|<\|endoftext\|>"


#: Digits are words of one character each, some apostrophes begin a word, marks may join the letter before, and an
#: empty part has no word.
SPLIT_WORDS = r"[\p{N}\p{M}']|^$"


def gather(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` that `index` names, one after another, and their sizes; size: of each run in flat."""
    begin, size = (np.cumsum(size) - size)[index], size[index]
    return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size


def strings(values: pa.Array) -> list[str]:
    """As to_pylist(), in a tenth of its time."""
    return values.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Token ids of whole texts for a vocabulary whose tokens never cross white space and mark ends of words.

    Each white-space separated part is encoded once and kept in a bounded cache of the worker, as ids in one pool.
    A new part falls into runs of letters and of punctuation, which are encoded many at a time and told apart by
    their last tokens. Texts with added tokens or control characters are encoded whole.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.bare = Tokenizer(self.tokenizer.model)  # the same model, for runs that nothing changes or cuts before it
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.begin, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def many(self, runs: list[str], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of runs that are one word to the tokenizer each, and how many ids each has. bare: they are of small ASCII
        letters or of ASCII punctuation, so neither the normalizer nor the pattern of words has anything to do."""
        joined = [" ".join(runs[i : i + 500]) for i in range(0, len(runs), 500)]
        encoded = (x for i in range(0, len(joined), 16) for x in (self.bare if bare else self.tokenizer).encode_batch_fast(joined[i : i + 16], add_special_tokens=False))
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in encoded)])
        ends = np.flatnonzero(self.last[ids])
        if len(ends) == len(runs):
            return ids, np.diff(np.concatenate(([-1], ends)))
        return self.each(runs)

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As many(), for any words."""
        ids = [x.ids for i in range(0, len(words), 5_000) for x in self.tokenizer.encode_batch_fast(words[i : i + 5_000], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum())), size

    def learn(self, words: pa.Array) -> None:
        """Adds words that the cache doesn't hold."""
        split = pc.match_substring_regex(words, SPLIT_WORDS)  # cut within runs: encoded one by one
        plain, rest = words.filter(pc.invert(split)), words.filter(split)
        runs = pc.split_pattern(pc.ascii_trim(pc.replace_substring_regex(plain, r"([^\s\p{L}\p{N}]+)", r" \1 "), " "), " ")
        coded = runs.flatten().dictionary_encode()
        ascii = pc.string_is_ascii(coded.dictionary)
        both = self.many(strings(coded.dictionary.filter(ascii)), bare=True), self.many(strings(coded.dictionary.filter(pc.invert(ascii))))
        first = ascii.to_numpy(zero_copy_only=False)
        place = np.where(first, np.cumsum(first), first.sum() + np.cumsum(~first)) - 1
        ids, size = gather(*map(np.concatenate, zip(*both, strict=True)), place[coded.indices.to_numpy(zero_copy_only=False)])
        counts = pc.list_value_length(runs).to_numpy(zero_copy_only=False)
        sizes = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=size, minlength=len(counts)).astype(np.int64)
        more, lengths = self.each(strings(rest)) if len(rest) else (ids[:0], sizes[:0])
        ids, sizes = np.concatenate((ids, more)), np.concatenate((sizes, lengths))
        self.slot.update(zip(strings(plain) + strings(rest), range(len(self.slot), len(self.slot) + len(words)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.pool = np.concatenate((self.pool, ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and where each text's begin."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        parts = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", pc.ascii_lower(texts)))
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = parts.flatten().dictionary_encode()
        words = strings(coded.dictionary)
        at = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        new = at < 0
        if len(self.slot) + new.sum() > self.cached:
            self.clear()
            new[:] = True
        self.learn(coded.dictionary.filter(pa.array(new)))
        at[new] = np.fromiter(map(self.slot.__getitem__, compress(words, new.tolist())), np.int64, int(new.sum()))
        slots = at[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[slots]
        ids = self.pool[np.repeat(self.begin[slots] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        lengths = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=size, minlength=len(counts)).astype(np.int64)
        if odd.any():
            rows = np.split(ids, np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(odd):
                rows[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, lengths = np.concatenate(rows), np.array([len(x) for x in rows])
        return ids, np.concatenate(([0], np.cumsum(lengths)))


ENCODERS: dict[str, WordEncoder] = CACHES.setdefault("packing", {})


def cut(batches: Iterator[pa.RecordBatch], path: str, window: int, cached: int = CACHED_WORDS) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to pieces: whole windows from a document's start, then what is left. spread: a hash that differs
    between pieces that are alike."""
    encoder, made = ENCODERS.setdefault(path, None) or ENCODERS.update({path: WordEncoder(path, cached)}) or ENCODERS[path], 0
    encoder.cached = cached
    for batch in slices(batches, owner="packing"):
        ids, starts = encoder.encode(batch.column("text"))
        rows, begin, length, check, total = [], [], [], [], []
        for i in range(batch.num_rows):
            own = np.append(ids[starts[i] : starts[i + 1]], np.uint32(END_ID)).astype("<u4")
            for at in range(0, len(own), window):
                piece = own[at : at + window]
                rows.append(i), begin.append(at), length.append(len(piece)), check.append(zlib.crc32(piece.tobytes())), total.append(len(own))
        spread = mix(np.array(check, np.uint64) + np.arange(made, made + len(rows), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        made += len(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (begin, length, check, total)), pa.array((spread >> np.uint64(33)).astype(np.int32))],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"],
        )
    give_back()


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to `room`, as length to number used.

    Bit s of a bitset says that some multiset sums to s. A length's copies enter in groups of 1, 2, 4, ... copies,
    longest lengths first, and the search ends when the room itself is reached. The groups used are traced back.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left > 0:
            take = min(group, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, group = left - take, group * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, last rank, pieces in a sequence, first sequence, offset) for all pieces.

    Each pattern takes the longest length that is left and the multiset that fills the window best beside it, and
    is repeated until a length of it runs out; so patterns number about as many as distinct lengths, not pieces.
    """
    left, rank, sequence, slots = {k: v for k, v in counts.items() if v > 0}, dict.fromkeys(counts, 0), 0, []
    while left:
        longest = max(left)
        used = fill({**left, longest: left[longest] - 1}, window - longest)
        used[longest] = used.get(longest, 0) + 1
        times, offset = min(left[x] // n for x, n in used.items()), 0
        for length, n in sorted(used.items(), reverse=True):
            slots.append((length, rank[length], rank[length] + n * times - 1, n, sequence, offset))
            rank[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return slots


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, cached: int = CACHED_WORDS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents, each followed by
    the id END_ID, in sequences of at most `window` tokens.

    tokenizer: path of a tokenizers file whose tokens don't cross white space. cached: words whose ids a worker keeps. A document is cut into whole windows
    and a rest; only the counts of lengths, at most `window` numbers, reach the driver, where patterns of rests that
    fill a window are chosen. A piece finds its slot by its rank among the pieces of its length; ranks are counted
    in groups of about RANK_ROWS rows, so one common length is spread out.

    Null and empty texts are a single END_ID. Repeated rows and doc_ids, also null ones, are packed once per row.
    Extra columns are ignored; no rows give no pieces.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, spread int"
    pieces = materialize(base.mapInArrow(lambda it: cut(it, tokenizer, window, cached), schema), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = sum(counts.values()) // RANK_ROWS + 64
    salted = pieces.withColumn("salt", F.pmod("spread", F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    running = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(before.select("length", "salt", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")), "ranks")
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    # pieces are dealt and sorted by (length, salt) for nth already, so a merge join moves only the ranks
    ranked = salted.withColumn("nth", nth).join(before.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = "length long, lo long, hi long, n long, first long, at long"
    slots = docs.sparkSession.createDataFrame(plan(counts, window), names)  # a few rows per distinct length at most
    k = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & F.col("rank").between(F.col("lo"), F.col("hi"))).drop(slots["length"])
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(k / F.col("n"))).alias("sequence_id"), (F.col("at") + F.pmod(k, F.col("n")) * F.col("length")).alias("offset"),
    )
