"""Token counts by a map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_strings, materialize, slices

#: Size of the broadcast table of frequent pre-tokens, and of a worker's cache of the others. The table only saves work: every
#: count is exact whatever it holds.
FREQUENT, CACHED = 50_000, 300_000
#: Pre-tokens that a task counts at most before it drops the rarest, those it tells of, and tasks' tables merged at a time.
COUNTED, TOLD, MERGED = 60_000, 20_000, 16
#: Texts that aren't cut at single spaces: they hold an added token, or white space before a space.
UNCUT = r"\s |[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |<\|endoftext\|>"


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of texts that a byte-level vocabulary encodes independently, pieces per text, and texts left whole.

    A text is cut before each single space that follows a character other than white space: the piece keeps its
    space, as byte-level pre-tokens do. No pre-token crosses such a place. Other texts are one piece.
    """
    texts = pc.fill_null(texts, "")
    whole = pc.match_substring_regex(texts, UNCUT)
    parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    flat = parts.flatten()
    first = np.zeros(len(flat), bool)
    first[np.cumsum(counts) - counts] = True
    spaced = pc.binary_join_element_wise(pa.scalar(""), flat, " ")
    return pc.if_else(pa.array(first), flat, spaced), counts, whole.to_numpy(zero_copy_only=False)


#: Rising 64-bit hashes of the frequent pieces, the pieces themselves, to verify them by, and their token counts.
Table = tuple[np.ndarray, pa.Array, np.ndarray]


class Lengths:
    """Token counts of pieces: the shared table first, then this worker's cache, then the encoder."""

    def __init__(self, path: str, table: Table | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        self.table = table or (np.zeros(0, np.uint64), pa.array([], pa.string()), np.zeros(0, np.int32))
        self.hashes, self.frequent, self.lengths = self.table

    def encoded(self, pieces: list[str]) -> np.ndarray:
        return np.array([len(x.ids) for i in range(0, len(pieces), 5_000) for x in self.tokenizer.encode_batch_fast(pieces[i : i + 5_000], add_special_tokens=False)], np.int32)

    def of(self, pieces: pa.Array) -> np.ndarray:
        """Of distinct pieces."""
        out, known = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), bool)
        if len(self.hashes) and len(pieces):
            at = np.minimum(np.searchsorted(self.hashes, hash_strings(pieces)), len(self.hashes) - 1)
            known = pc.equal(self.frequent.take(pa.array(at)), pieces).to_numpy(zero_copy_only=False)
            out[known] = self.lengths[at[known]]
        rest = pieces.filter(pa.array(~known)).to_pylist()
        new = [p for p in rest if p not in self.cache]
        if len(self.cache) + len(new) > CACHED:
            self.cache, new = {}, rest
        self.cache.update(zip(new, self.encoded(new).tolist(), strict=True))
        out[~known] = np.fromiter(map(self.cache.__getitem__, rest), np.int32, len(rest))
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        pieces, counts, whole = pre_tokens(texts)
        coded = pieces.dictionary_encode()
        each = self.of(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        out = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=each, minlength=len(counts)).astype(np.int64)
        for i in np.flatnonzero(whole):
            out[i] = len(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids)
        return out


WORKER: dict[str, Lengths] = {}
PACKED = "pieces array<string>, counts array<bigint>"


def heaviest(table: pa.Table, most: int) -> pa.Table:
    """The `most` pieces of a table (piece, n) with the largest sums of n, the lower piece among equals."""
    summed = table.group_by("piece").aggregate([("n", "sum")]).rename_columns(["piece", "n"])
    return summed.take(pc.sort_indices(summed, [("n", "descending"), ("piece", "ascending")])[:most])


def told(table: pa.Table) -> pa.RecordBatch:
    """A table as one row of two lists."""
    piece, n = (table[c].combine_chunks() for c in ("piece", "n"))
    ends = pa.array([0, len(piece)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, piece), pa.ListArray.from_arrays(ends, n)], ["pieces", "counts"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task: its most frequent pieces, from a bounded counter that drops the rarest when it is full."""
    held: list[pa.Table] = []
    for batch in slices(batches):
        found = pre_tokens(batch.column("text"))[0].value_counts()
        held.append(pa.table({"piece": found.field("values"), "n": found.field("counts")}))
        if sum(map(len, held)) > 2 * COUNTED:
            held = [heaviest(pa.concat_tables(held), COUNTED)]
    if held:
        yield told(heaviest(pa.concat_tables(held), TOLD))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the rows of a partition, which are few and bounded each."""
    held = [pa.table({"piece": b.column("pieces").flatten(), "n": b.column("counts").flatten()}) for b in batches]
    if held:
        yield told(heaviest(pa.concat_tables(held), FREQUENT))


def frequent_pieces(texts: DataFrame) -> pa.Array:
    """The most frequent pieces of all texts, FREQUENT at most. A task tells of TOLD pieces in one row; rows are merged
    MERGED at a time in rounds, so no piece is shuffled by itself, and only the last row reaches the driver."""
    tables = materialize(texts.mapInArrow(counted, PACKED), "pieces")
    left = tables.count()
    while left > 1:
        left = -(-left // MERGED)
        tables = materialize(tables.repartition(left).mapInArrow(merged, PACKED), "pieces")
    row = tables.select("pieces").toArrow()["pieces"].combine_chunks()
    return row.flatten() if len(row) else pa.array([], pa.string())


def hash_table(path: str, pieces: pa.Array) -> Table:
    hashes = hash_strings(pieces)
    order = np.argsort(hashes)
    return hashes[order], pieces.take(pa.array(order)), Lengths(path).encoded(pieces.to_pylist())[order]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) per row of docs.

    tokenizer: path of a byte-level tokenizers file. Counts are those of the whole text without added special
    tokens; special strings inside a text count as the library's default has them. One pass counts pre-tokens of all
    texts by bounded counters, whose merged table of FREQUENT strings at most is broadcast; another looks lengths up, and
    no pre-token leaves its task there. Each worker keeps CACHED others. Null and empty texts have no bytes and no tokens; repeated rows and null doc_ids
    are counted each. Extra columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(hash_table(tokenizer, frequent_pieces(base.select("text"))))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = WORKER.get(tokenizer)
        if lengths is None or lengths.table is not shared.value:
            lengths = WORKER[tokenizer] = Lengths(tokenizer, shared.value)
        for batch in slices(batches):
            n = lengths.count(batch.column("text"))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return base.mapInArrow(looked_up, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
