"""Line dedup: an exact set-similarity join over lines that removes every line matching an earlier one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import PARITY, MemberFilter, as_lists, could_match, give_back, line_words, materialize, mix, parity, parity_fits, slices, word_hashes

#: Ranked words: a word outside this many most frequent ones counts as rare, and rare words are ordered by hash.
RANKED_WORDS = 1 << 19
#: A word is counted where it occurs this often in one slice of about 3 MB of text.
LEAST_COUNT = 2
#: A word counted more often than this is a key only together with another such word of the line.
FREQUENT = 20_000
#: In buckets of more lines than this all are compared with the first before they are compared with one another.
CROWD = 32
#: Rows of a group of prefix buckets, on average.
GROUP_ROWS = 200_000
#: Tables of at most so many rows, and of line numbers at most so many in all, are broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_LINES = 200_000, 4_000_000


def line_sets(hashes: np.ndarray, line: np.ndarray, lines: int, order: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word sets of lines: flat distinct word hashes, rarest first within a line, each one's count, and line starts.

    order: sorted hashes of the frequent words and their counts; any other word counts 0, and words of one count are
    ordered by hash.
    """
    coded = pa.array(hashes).dictionary_encode()
    words = coded.dictionary.to_numpy()
    count = np.zeros(len(words), np.int64)
    if order and len(order["hash"]) and len(words):
        place = np.minimum(np.searchsorted(order["hash"], words), len(order["hash"]) - 1)
        count = np.where(order["hash"][place] == words, order["count"][place], 0)
    by = np.lexsort((words, count))
    words, count, rank = words[by], count[by], np.empty(len(by), np.uint64)
    rank[by] = np.arange(len(by), dtype=np.uint64)
    both = np.sort((line.astype(np.uint64) << np.uint64(32)) | rank[coded.indices.to_numpy(zero_copy_only=False)])
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    own = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return words[own], count[own], np.searchsorted((both >> np.uint64(32)).astype(np.int64), np.arange(lines + 1))


def frequent_words(docs: DataFrame) -> dict:
    """The most frequent words of all lines, at most RANKED_WORDS of them, as sorted hashes and counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array(word_hashes(batch.column("text"))[0].view(np.int64)).value_counts()
            often = found.filter(pc.greater_equal(found.field("counts"), LEAST_COUNT))
            yield pa.RecordBatch.from_arrays([often.field("values"), often.field("counts")], ["word", "n"])

    counts = docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(RANKED_WORDS).toArrow()
    hashes = top["word"].to_numpy().view(np.uint64)
    by = np.argsort(hashes)
    return {"hash": hashes[by], "count": top["n"].to_numpy()[by]}


def ragged(values: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `length` values of each list, each one's list and its place in it."""
    owner = np.repeat(np.arange(len(length)), length)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    return values[starts[:-1][owner] + pos], owner, pos


def prefix_keys(words: np.ndarray, count: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each line's prefix ordered by line, where each line's begin, and how many of them are single words.

    Two sets of the threshold's similarity share a word within their first n - ceil(threshold n) + 1 rarest words, and
    two words within one word more. A word of the prefix is a key if it isn't FREQUENT; if only frequent words are
    common to two prefixes, two of them are common within one word more, and such pairs are keys as well. Single words
    come first, so a key's number is the place of its word, and those of pairs come after them.
    """
    size = np.diff(starts)
    length = np.minimum(size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 2, size)
    flat, line, pos = ragged(words, starts, length)
    hot = ragged(count, starts, length)[0] > FREQUENT
    last = pos == (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[line]  # one word more than the prefix
    single = ~hot & ~last
    parts = [(flat[single], line[single])]
    ahead, step = np.flatnonzero(hot), 1
    while len(ahead):
        ahead = ahead[ahead + step < len(line)]
        ahead = ahead[line[ahead + step] == line[ahead]]  # words after a frequent one are frequent
        parts.append((mix(flat[ahead] * np.uint64(0x9E3779B97F4A7C15) + flat[ahead + step]), line[ahead]))
        step += 1
    key, line = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(line, kind="stable")
    return key[by], np.searchsorted(line[by], np.arange(len(starts))), np.bincount(parts[0][1], minlength=len(size))


def pick(starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of chosen lists, as ragged() takes them."""
    return np.append(starts[:-1][chosen], 0), np.diff(starts)[chosen]


#: Words of parity bits that lines carry.
CARRIED = PARITY[:2]
LINE_COLUMNS = ["d", "l", "copy", "h1", "h2", *CARRIED, "size", "singles", "keys"]
LINE_SCHEMA = "d long, l int, copy boolean, h1 long, h2 long, b0 long, b1 long, size int, singles int, keys array<int>"


def hashed_lines(batches: Iterator[pa.RecordBatch], order: dict, threshold: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to one row per line that has a word: two hashes of its word set, the set's size, its parity
    bits and its prefix keys. Of lines of one set in a slice, those after the earliest are only named (copy is true),
    so that a line that is everywhere goes as one row a slice. Keys are 32 bits; two words of one key only add
    candidates."""
    for batch in slices(batches, 2 << 20):
        hashes, line, owner, number = line_words(batch.column("text"))
        doc = batch.column("doc_id").to_numpy()[owner]
        words, count, starts = line_sets(hashes, line, len(owner), order)
        size = np.diff(starts)
        begin = np.minimum(starts[:-1], len(words))
        h1, h2 = (np.add.reduceat(np.append(mix(words + np.uint64(k)), np.uint64(0)), begin) for k in (0, 0x9E3779B9))
        by = np.lexsort((number, doc, h2, h1))
        by = by[size[by] > 0]
        new = np.ones(len(by), bool)
        new[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
        earliest = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        copy = (doc[by] != doc[earliest]) | (number[by] != number[earliest])
        gone, first = by[copy], np.sort(by[~copy])
        flat, at, _ = ragged(words, *pick(starts, first))
        own = np.searchsorted(at, np.arange(len(first) + 1))
        keys, key_starts, singles = prefix_keys(flat, ragged(count, *pick(starts, first))[0], own, threshold)
        both, none = np.concatenate((first, gone)), np.zeros(len(gone), np.int64)
        h1[gone] = mix(h1[gone] + doc[gone].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number[gone].astype(np.uint64))  # copies needn't meet
        lists = pa.array(np.concatenate((key_starts, none + len(keys))), pa.int32())
        filled = lambda x: pa.array(np.concatenate((x.view(np.int64), none)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[both]), pa.array(number[both].astype(np.int32)), pa.array(np.repeat([False, True], [len(first), len(gone)])), pa.array(h1[both].view(np.int64)), pa.array(h2[both].view(np.int64)),
                *map(filled, parity(mix(flat), own, len(CARRIED))), *(pc.cast(filled(x), pa.int32()) for x in (size[first], singles)), pa.ListArray.from_arrays(lists, pa.array(keys.astype(np.uint32).view(np.int32))),
            ],
            LINE_COLUMNS,
        )


#: Columns of a packed prefix row and their types; rows of one bucket of keys travel as one row of packed columns.
PACKED = {"key": "<u4", "d": "<i8", "l": "<i4", "size": "<i4", "pos": "<i4", "b0": "<u8", "b1": "<u8"}
#: Columns of a pair of an earlier and a later line, as they travel.
PAIR = np.dtype([("ad", "<i8"), ("al", "<i4"), ("bd", "<i8"), ("bl", "<i4")])
PAIR_SCHEMA = "ad long, al int, bd long, bl int, key int"
#: Rows that a task packs at a time, and rows of one key of them beyond which it is crowded.
PACKED_ROWS, LOCAL_CROWD = 1 << 18, 256
#: Comparisons made at a time, those of one key beyond which it is crowded, and found pairs a line beyond which it is.
COMPARED, KEY_COMPARISONS, DENSE = 1 << 18, 500_000, 4


def keyed_rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """PACKED columns of the prefix rows of lines."""
    lists = batch.column("keys")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    of = lambda c: batch.column(c).to_numpy(zero_copy_only=False)[owner]
    rows = {"key": lists.flatten().to_numpy(zero_copy_only=False), "d": of("d"), "l": of("l"), "size": of("size"), "pos": np.minimum(nth, of("singles")), "b0": of("b0"), "b1": of("b1")}
    return {c: x.astype(x.dtype.str.replace("i", "u"), copy=False).view(t) if c in ("key", "b0", "b1") else x.astype(t) for (c, t), x in zip(PACKED.items(), rows.values(), strict=True)}




class Prefixes:
    """Prefix rows in order of their keys, and comparisons among those of one key."""

    def __init__(self, rows: dict[str, np.ndarray], threshold: float):
        by = np.lexsort((rows["size"], rows["key"]))
        self.rows, self.threshold = {c: x[by] for c, x in rows.items()}, threshold
        key = self.rows["key"]
        self.starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        self.lengths = np.diff(self.starts, append=len(key))
        self.run = np.repeat(np.arange(len(self.starts)), self.lengths)

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length, positional and parity filters, as could_match() and parity_fits() have them, for rows of one key."""
        r, t = self.rows, self.threshold
        total = r["size"][x].astype(np.int64) + r["size"][y]
        ok = np.minimum(r["size"][x] - r["pos"][x], r["size"][y] - r["pos"][y]) >= t / (1 + t) * total - 1e-9
        ok &= np.minimum(r["size"][x], r["size"][y]) >= t * np.maximum(r["size"][x], r["size"][y]) - 1e-9
        differ = np.bitwise_count(r["b0"][x] ^ r["b0"][y]).astype(np.int64) + np.bitwise_count(r["b1"][x] ^ r["b1"][y])
        ok &= differ <= total * (1 - t) / (1 + t) + 1e-9
        return ok & ((r["d"][x] != r["d"][y]) | (r["l"][x] != r["l"][y]))

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of rows, the earlier line first."""
        r, out = self.rows, np.empty(len(x), PAIR)
        swap = (r["d"][y] < r["d"][x]) | ((r["d"][y] == r["d"][x]) & (r["l"][y] < r["l"][x]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        out["ad"], out["al"], out["bd"], out["bl"] = r["d"][x], r["l"][x], r["d"][y], r["l"][y]
        return out

    def led(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The earliest line of each of some runs, and its pairs with the others that fit."""
        inside = np.flatnonzero(runs[self.run])
        by = inside[np.lexsort((self.rows["l"][inside], self.rows["d"][inside], self.run[inside]))]
        first = by[np.flatnonzero(np.concatenate((np.ones(min(1, len(by)), bool), self.run[by][1:] != self.run[by][:-1])))]
        leader = np.repeat(first, self.lengths[runs])
        ok = self.fits(leader, by)
        return first, self.pairs(leader[ok], by[ok])

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that fit, and the keys that are crowded. Of a crowded key only pairs with the earliest line, and of each
        line with the most like earlier one, are among the pairs."""
        r, t, n = self.rows, self.threshold, len(self.run)
        size = r["size"].astype(np.int64)
        index = r["pos"] <= size - np.ceil(2 * t / (1 + t) * size - 1e-9)  # of the shorter line
        order = (self.run.astype(np.int64) << 32) | size
        end = np.searchsorted(order, (self.run.astype(np.int64) << 32) | np.floor(size / t + 1e-9).astype(np.int64), side="right")
        counts = np.where(index, end - np.arange(n) - 1, 0)
        total = np.add.reduceat(counts, self.starts) if n else counts
        crowded = total > KEY_COMPARISONS
        counts[crowded[self.run]] = 0
        upto, found, at = np.cumsum(counts), [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMPARED, side="right")))
            own = counts[at:to]
            x = np.repeat(np.arange(at, to), own)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own)
            ok = self.fits(x, y)
            found.append((x[ok], y[ok]))
            at = to
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        dense = (np.bincount(self.run[x], minlength=len(self.starts)) > DENSE * self.lengths) & (self.lengths > CROWD)
        keep = ~dense[self.run[x]]
        out = [self.pairs(x[keep], y[keep]), self.led(crowded | dense)[1]]
        x, y = x[~keep], y[~keep]
        if len(x):
            near = self.pairs(x, y)
            differ = np.bitwise_count(r["b0"][x] ^ r["b0"][y]).astype(np.int64) + np.bitwise_count(r["b1"][x] ^ r["b1"][y])
            by = np.lexsort((differ, near["bl"], near["bd"], self.run[x]))
            same = (near["bl"][by][1:] == near["bl"][by][:-1]) & (near["bd"][by][1:] == near["bd"][by][:-1]) & (self.run[x][by][1:] == self.run[x][by][:-1])
            out.append(near[by[np.concatenate(([True], ~same))]])
        return np.unique(np.concatenate(out)), r["key"][self.starts[crowded | dense]]


def packed(batches: Iterator[pa.RecordBatch], groups: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Lines to rows (bucket, PACKED columns, pairs, crowded): the prefix rows of up to PACKED_ROWS by bucket of keys. A
    key that is crowded among them is led here, so that only its earliest line goes on, besides the pairs."""

    def flushed(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        rows = Prefixes({c: np.concatenate([x[c] for x in parts]) for c in PACKED}, threshold)
        crowd = rows.lengths > LOCAL_CROWD
        first, pairs = rows.led(crowd)
        keep = ~crowd[rows.run]
        keep[first] = True
        bucket = (mix(rows.rows["key"].astype(np.uint64)) % np.uint64(groups))[keep]
        by = np.argsort(bucket, kind="stable")
        found, starts = np.unique(bucket[by], return_index=True)
        cut = {c: [x[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(by)], strict=True)] for c, x in ((c, x[keep][by]) for c, x in rows.rows.items())}
        known = [np.unique(pairs).tobytes(), *[b""] * (len(found) - 1)]
        crowded = [rows.rows["key"][first].tobytes(), *[b""] * (len(found) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *(pa.array(cut[c], pa.binary()) for c in PACKED), pa.array(known, pa.binary()), pa.array(crowded, pa.binary())], ["bucket", *PACKED, "pairs", "crowded"])

    parts, held = [], 0
    for batch in batches:
        parts.append(keyed_rows(batch))
        held += len(parts[-1]["key"])
        if held >= PACKED_ROWS:
            yield flushed(parts)
            parts, held = [], 0
    if held:
        yield flushed(parts)
    del parts
    give_back()


def unpacked(table: pa.Table, threshold: float) -> pa.Table:
    """The packed rows of one bucket to PAIR_SCHEMA: candidate pairs, and crowded keys with no lines."""
    joined = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (*PACKED.items(), ("pairs", PAIR), ("crowded", "<u4"))}
    pairs, crowded = Prefixes({c: joined[c] for c in PACKED}, threshold).all_pairs()
    give_back()
    pairs, crowded = np.concatenate((pairs, joined["pairs"])), np.unique(np.concatenate((crowded, joined["crowded"])))
    null = np.repeat([False, True], [len(pairs), len(crowded)])
    line = [pa.array(np.concatenate((pairs[c], np.zeros(len(crowded), pairs[c].dtype))), mask=null) for c in PAIR.names]
    return pa.Table.from_arrays([*line, pa.array(np.concatenate((np.zeros(len(pairs), np.int32), crowded.view(np.int32))), mask=~null)], [*PAIR.names, "key"])


def crowd_rows(batches: Iterator[pa.RecordBatch], crowded: MemberFilter) -> Iterator[pa.RecordBatch]:
    """Lines to the prefix rows of crowded keys."""
    for batch in batches:
        rows = keyed_rows(batch)
        keep = crowded.holds([rows["key"].view(np.int32)])
        stands = np.repeat(batch.column("stands").to_numpy(zero_copy_only=False), pc.list_value_length(batch.column("keys")).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*(pa.array(x[keep].view("<i8" if c[0] == "b" else "<i4" if c == "key" else x.dtype)) for c, x in rows.items()), pa.array(stands[keep])], [*PACKED, "stands"])


def crowd_pairs(lines: DataFrame, gone: DataFrame, crowded: MemberFilter, threshold: float) -> DataFrame:
    """Pairs of crowded keys whose later line still stands, by a join that adaptive execution splits where it is uneven."""
    shared = lines.sparkSession.sparkContext.broadcast(crowded)
    known = gone.select(F.col("bd").alias("d"), F.col("bl").alias("l"), F.lit(False).alias("stands"))
    marked = lines.join(known, ["d", "l"], "left").withColumn("stands", F.coalesce("stands", F.lit(True)))
    schema = "key int, d long, l int, size int, pos int, b0 long, b1 long, stands boolean"
    rows = materialize(marked.select("d", "l", "size", "singles", "keys", "b0", "b1", "stands").mapInArrow(lambda it: crowd_rows(it, shared.value), schema), "crowd-rows")
    x, y = rows.alias("x"), rows.where("stands").alias("y")
    earlier = F.expr("x.d < y.d or (x.d = y.d and x.l < y.l)")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & earlier & parity_fits(threshold, CARRIED) & could_match(threshold))
    return met.select(F.col("x.d").alias("ad"), F.col("x.l").alias("al"), F.col("y.d").alias("bd"), F.col("y.l").alias("bl")).distinct()


def wanted_sets(batches: Iterator[pa.RecordBatch], wanted: MemberFilter) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (d, l, words) of the lines in the filter, which also holds (d, -1) of their documents."""
    for batch in slices(batches):
        batch = batch.filter(pa.array(wanted.holds([batch.column("doc_id").to_numpy(), np.full(batch.num_rows, -1)])))
        parts = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        number = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        doc = batch.column("doc_id").to_numpy()[owner]
        keep = wanted.holds([doc, number])
        hashes, starts = word_hashes(parts.flatten().filter(pa.array(keep)))
        line = np.repeat(np.arange(int(keep.sum())), np.diff(starts))
        words, _, starts = line_sets(hashes, line, int(keep.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(number[keep]), as_lists(words, starts)], ["d", "l", "words"])


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs(ad, al, bd, bl) of an earlier and a later line, the later lines (bd, bl) whose Jaccard similarity
    to the earlier one reaches the threshold."""
    end = lambda d, n: F.struct(F.col(d).alias("d"), n.alias("l"))
    ends = [end(d, n) for d, l in (("ad", "al"), ("bd", "bl")) for n in (F.col(l), F.lit(-1))]
    wanted = docs.sparkSession.sparkContext.broadcast(MemberFilter(pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.*")))
    sets = materialize(docs.mapInArrow(lambda it: wanted_sets(it, wanted.value), "d long, l int, words array<long>"), "line-sets")
    side = lambda d, n, w: sets.select(F.col("d").alias(d), F.col("l").alias(n), F.col("words").alias(w))
    both = pairs.join(side("bd", "bl", "wb"), ["bd", "bl"]).join(side("ad", "al", "wa"), ["ad", "al"])
    common = F.size(F.array_intersect("wa", "wb"))
    fits = common >= threshold / (1 + threshold) * (F.size("wa") + F.size("wb")) - 1e-9
    return both.where(fits).select("bd", "bl").distinct()


def removed_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, lines): the numbers of the lines of each document that go; documents that lose none are absent."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    order = docs.sparkSession.sparkContext.broadcast(frequent_words(docs))
    # lines with one word set are one class, known by its first line; the others go
    first = F.rank().over(Window.partitionBy("h1", "h2").orderBy("d", "l")) == 1
    hashed = docs.mapInArrow(lambda it: hashed_lines(it, order.value, threshold), LINE_SCHEMA).withColumn("copy", F.col("copy") | ~first)
    kept = lambda c: F.when(~F.col("copy"), F.col(c)).alias(c)
    lines = materialize(hashed.select("d", "l", "copy", *map(kept, (*CARRIED, "size", "singles", "keys"))), "hashed-lines")
    classes = lines.where("not copy")

    groups = (classes.agg(F.sum(F.size("keys"))).first()[0] or 0) // GROUP_ROWS + 1
    rows = classes.select("d", "l", "size", "singles", "keys", *CARRIED).mapInArrow(lambda it: packed(it, groups, threshold), "bucket long, " + ", ".join(f"{c} binary" for c in PACKED) + ", pairs binary, crowded binary")
    met = materialize(rows.groupBy("bucket").applyInArrow(lambda t: unpacked(t, threshold), PAIR_SCHEMA), "line-met")
    pairs = materialize(met.where("ad is not null").select("ad", "al", "bd", "bl").distinct(), "line-pairs")
    gone = materialize(verified(pairs, docs, threshold), "lines-gone")
    crowded = met.where("key is not null").select("key")
    if not crowded.isEmpty():
        more = materialize(crowd_pairs(classes, gone, MemberFilter(crowded), threshold), "line-pairs")
        gone = gone.union(materialize(verified(more, docs, threshold), "lines-gone"))
    every = lines.where("copy").select("d", "l").union(gone.select("bd", "bl"))
    return every.groupBy(F.col("d").alias("doc_id")).agg(F.collect_set("l").alias("lines"))


def cut_lines(texts: pd.Series, lines: pd.Series) -> pd.Series:
    """Texts without the lines whose numbers are listed; only texts that lose some are given."""
    gone = (None if n is None else set(n) for n in lines)
    return pd.Series([None if x is None or g is None else "\n".join(s for i, s in enumerate(x.split("\n")) if i not in g) for x, g in zip(texts, gone, strict=True)])


def dedup_lines(docs: DataFrame, threshold: float = 0.8, emptied: bool = True) -> DataFrame:
    """docs with the same columns, without the lines whose word set has a Jaccard similarity of at least
    `threshold` to that of an earlier line of the same or another document; n_chars follows the text where given.

    Lines are parts between line feeds, words lower-case runs of letters and digits. Earlier means a smaller
    (doc_id, line number). A line without a word stays, so null and empty texts stay as they are. Rows with a null
    doc_id pass unchanged and match nothing. Rows that share a doc_id count as one document: lines at the same place
    in them go together. Every document stays, with an empty text if all its lines go; without `emptied`, documents
    whose lines go until no letter, digit or mark is left go as well. Other columns pass through.
    """
    gone = materialize(removed_lines(docs, threshold), "removed").withColumnsRenamed({"doc_id": "__doc", "lines": "__lines"})
    size = gone.agg(F.count("*").alias("rows"), F.sum(F.size("__lines")).alias("lines")).first()
    if size["rows"] <= BROADCAST_ROWS and (size["lines"] or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    joined = docs.join(gone, docs["doc_id"] == F.col("__doc"), "left").drop("__doc")
    cut = F.pandas_udf(cut_lines, StringType())
    hit = F.col("__lines").isNotNull() & F.col("text").isNotNull()
    out = joined.withColumn("text", F.coalesce(cut(F.when(hit, F.col("text")), F.when(hit, F.col("__lines"))), "text"))
    if not emptied:
        out = out.where(F.col("__lines").isNull() | F.col("text").rlike(r"[\p{L}\p{N}\p{M}]"))
    out = out.drop("__lines")
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
