"""Codes for vectors: a codebook for each part, refined in rounds whose nearest entries are found by exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held at this size at most, so that the error of 500 components fits in 64 bits.
LARGEST = 1 << 26
#: Vectors that a worker compares at a time, and of these, those of one entry.
GATHERED, BLOCK = 1 << 14, 1 << 10
#: Sums of labels are broadcast up to this many labels (two numbers each).
FEW_LABELS = 1_000_000


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as integers floor(SCALE * x); rows with a null vector, null or non-finite components go."""
    for batch in batches:
        vectors = batch.column("vector")
        batch = batch.filter(vectors.is_valid())
        vectors = batch.column("vector")
        x, size = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vectors.value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(size)), size)
        fine = np.bincount(owner[~np.isfinite(x)], minlength=len(size)) == 0  # nulls are NaN here
        whole = np.floor(np.clip(x[fine[owner]], -LARGEST, LARGEST) * SCALE).clip(-LARGEST, LARGEST).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum(size[fine]))).astype(np.int32)
        kept = batch.filter(pa.array(fine))
        yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.ListArray.from_arrays(pa.array(starts), pa.array(whole))], ["vec_id", "label", "v"])


def gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """The batches, joined to ones of about that many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of `width` integers; shorter ones end in zeros."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


class Codebook:
    """Entries of one part, and for each entry all of them by distance from it (then by index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        apart = self.distances(self.entries, self.entries)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.near = np.take_along_axis(apart, self.order, axis=1)

    @staticmethod
    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distances of all rows, as exact integers: by doubles only where no sum can pass 2^53."""
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
        if 4 * x.shape[1] * most * most < 1 << 53:
            a, b = x.astype(np.float64), y.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
        out = np.zeros((len(x), len(y)), np.int64)
        for j in range(x.shape[1]):
            out += (x[:, j, None] - y[None, :, j]) ** 2
        return out

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, the lower index of equal ones.

        An entry as near as `start`, at distance u, is at most 2u from it. So the neighbours of `start` are read from the
        nearest on while their squared distance is 4u^2 at most; those beyond are farther from the row than u."""
        own = ((x - self.entries[start]) ** 2).sum(1)
        best, low = start.copy(), own.copy()
        by = np.argsort(start, kind="stable")
        cut = np.flatnonzero(np.diff(start[by], prepend=-1))
        for rows in np.split(by, cut[1:]) if len(by) else []:
            entry = start[rows[0]]
            reach = np.searchsorted(self.near[entry], 4 * own[rows], side="right")
            rows, reach = rows[np.argsort(reach, kind="stable")], np.sort(reach)
            for at in range(0, len(rows), BLOCK):
                own_rows = rows[at : at + BLOCK]
                found = self.order[entry, : reach[at : at + BLOCK][-1]]
                apart = self.distances(x[own_rows], self.entries[found])
                low[own_rows] = least = apart.min(axis=1)
                best[own_rows] = np.where(apart == least[:, None], found[None, :], len(self.entries)).min(axis=1)
        return best, low


def assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows with the codes of their parts; the last time, with the code's text and the error instead of the vector."""
    found = [Codebook(b) for b in books]
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)])
    for batch in gathered(batches):
        x = matrix(batch.column("v"), width)
        prior = matrix(batch.column("code"), len(books))
        parts = np.split(x, len(books), axis=1)
        code, error = zip(*(b.nearest(p, prior[:, k]) for k, (b, p) in enumerate(zip(found, parts, strict=True))), strict=True)
        if last:
            text = digits[code[0]]
            for c in code[1:]:
                text = np.char.add(text, digits[c])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text.tolist(), pa.string()), pa.array(sum(error))], ["vec_id", "label", "code", "error"])
        else:
            flat = np.stack(code, axis=1).astype(np.int32).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(books), dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), lists], ["vec_id", "label", "v", "code"])


def summed(batches: Iterator[pa.RecordBatch], parts: int, entries: int, width: int) -> Iterator[pa.RecordBatch]:
    """Counts and componentwise sums of the parts of each entry in one task: at most parts * entries rows."""
    size = width // parts
    total, counts = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
    for batch in gathered(batches):
        x, code = matrix(batch.column("v"), width), matrix(batch.column("code"), parts)
        for k in range(parts):
            counts[k] += np.bincount(code[:, k], minlength=entries)
            for j in range(size):  # sums of a batch are whole numbers under 2^53
                total[k, :, j] += np.bincount(code[:, k], weights=x[:, k * size + j], minlength=entries).astype(np.int64)
    part, entry = np.nonzero(counts)
    columns = {"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": counts[part, entry]} | {f"s{j}": total[part, entry, j] for j in range(size)}
    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def refined(books: list[np.ndarray], state: DataFrame, width: int) -> list[np.ndarray]:
    """Entries replaced by the floors of their parts' means; entries without parts stay."""
    size = width // len(books)
    sums = [f"s{j}" for j in range(size)]
    schema = ", ".join(["part int", "entry int", "n long", *(f"{c} long" for c in sums)])
    parts, entries = len(books), len(books[0])
    per_task = state.select("v", "code").mapInArrow(lambda it: summed(it, parts, entries, width), schema)
    out = [b.copy() for b in books]
    for r in per_task.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *sums))).collect():  # one row an entry
        out[r["part"]][r["entry"]] = [r[c] // r["n"] for c in sums]
    return out


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row (vec_id, code, error, label_error, codebooks_sha256) per row of vectors(vec_id, embedding, label) that has
    a vector of finite components.

    Components become floor(1024 x). Each part's codebook begins with that part of the first vectors by vec_id and is
    refined `rounds` times by means of its nearest parts. A round is one pass over the vectors, which carry their codes
    along for the next search, and one over at most parts * entries sums a task; only sums reach the driver, and only
    codebooks are sent out (at most 256 entries a part).

    Rows with a null vector, or with null or non-finite components, go. Repeated rows are coded each; of a repeated
    vec_id the smaller vectors come first, a null vec_id comes last. Shorter vectors, empty ones too, end in zeros up to
    the longest one's length, made a multiple of `parts`. Components beyond 2^26 are held there, so that errors fit in 64
    bits; a label's sum that doesn't is null. Vectors without a label are one label. No vectors give no rows. Extra
    columns are ignored.
    """
    base = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    kind = base.schema["label"].dataType.simpleString()
    state = materialize(base.mapInArrow(scaled, f"vec_id long, label {kind}, v array<int>"), "scaled")
    first = [r["v"] for r in state.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    if not first:
        return state.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = -(-max(state.agg(F.max(F.size("v"))).first()[0], 1) // parts) * parts
    start = matrix(pa.array(first, pa.list_(pa.int32())), width)
    books = np.split(start, parts, axis=1)
    coded = state.withColumn("code", F.array_repeat(F.lit(0), parts))
    for _ in range(rounds):
        coded = materialize(coded.mapInArrow(lambda it, b=books: assigned(it, b, width, False), f"vec_id long, label {kind}, v array<int>, code array<int>"), "coded")
        discard(state)
        books, state = refined(books, coded, width), coded
    final = materialize(coded.mapInArrow(lambda it: assigned(it, books, width, True), f"vec_id long, label {kind}, code string, error long"), "codes")
    discard(state)
    per_label = materialize(final.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if per_label.count() <= FEW_LABELS:
        per_label = F.broadcast(per_label)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return final.join(per_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
