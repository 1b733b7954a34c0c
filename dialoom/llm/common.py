"""Shared helpers of the training-data operators: shared-folder tables, component labels, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIBC = ctypes.CDLL(None)
WORD_GAP = r"[^\p{L}\p{N}\p{M}]+"
SLICE_BYTES = 3 << 20

#: Folders of applications that run on this machine alone, where spark.checkpoint.dir is unset.
LOCAL: dict[str, str] = {}
#: Lists of the tables written since recorded() was entered, the innermost last.
RECORDS: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder serves a local master
    (tests); a cluster's executors couldn't read one another's, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = LOCAL.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="dialoom-")
        LOCAL[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


#: Rows of a batch that goes to a Python worker: whole texts are long, and a batch is in memory on both sides.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Makes the session send texts to its workers in batches of at most BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Sends workers that many rows at a time for what is written inside: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if RECORDS:
        RECORDS[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[tuple[SparkSession, str]]]:
    """The tables that operators called inside write, for whoever deletes them once nothing reads their results."""
    RECORDS.append([])
    try:
        yield RECORDS[-1]
    finally:
        RECORDS.pop()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems; one that is gone already is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        delete(table.sparkSession, files[0].rsplit("/", 1)[0])


def is_star_forest(edge: DataFrame) -> bool:
    """Whether every u of edges (u, v), v < u, has one v, which is no other edge's u: then v is u's component."""
    if (edge.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        return False
    return edge.join(edge.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of edges(a, b): rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps until the edges are stars; nothing of them but a largest count
    reaches the driver. Per-node minima are written first, so both join sides are plain shuffles and adaptive execution
    can split a node that has very many edges.
    """
    edge = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edge = materialize(edge, label)
    while not is_star_forest(edge):
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, label)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), label)
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = materialize(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), label)
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: What operators keep in a worker over their tasks.
CACHES: dict[str, dict] = {}


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each piece holds about `size` bytes; a longer row stays one piece. What other operators than
    the owner keep in this worker goes first: in a pipeline it would lie beside all that later stages need."""
    for name, held in CACHES.items():
        if name != owner:
            held.clear()
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Returns memory that a task no longer uses to the system: workers are kept for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def coded_strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per distinct string, equal in every worker, and the number of each string's hash."""
    coded = values.dictionary_encode()
    words = np.asarray(coded.dictionary.to_pylist(), dtype=object)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    return hashes, coded.indices.to_numpy(zero_copy_only=False)


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash per string."""
    hashes, at = coded_strings(values)
    return hashes[at]


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words (runs of letters, digits and marks) of all texts, and where each text's begin."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), WORD_GAP, " ")
    parts = pc.split_pattern(pc.ascii_trim(plain, " "), " ")
    flat, lengths = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)[full]
    return flat.filter(pa.array(full)), np.searchsorted(owner, np.arange(len(lengths) + 1))


BLOCK_BITS = 12


class Alphabet:
    """Random 64-bit numbers of the characters of words by code point, equal for both cases of a letter, and 0 for any other
    code point; filled a block at a time.

    of_words: which of an array of lower-case characters words are made of."""

    def __init__(self, of_words: Callable[[pa.Array], np.ndarray]):
        self.of_words = of_words
        self.numbers, self.filled = np.zeros(0x110000, np.uint64), np.zeros(0x110000 >> BLOCK_BITS, bool)

    def fill(self, block: int) -> None:
        first, size = block << BLOCK_BITS, 1 << BLOCK_BITS
        lower = pc.utf8_lower(pa.array([chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(first, first + size)]))
        own = np.array([ord(c[0]) for c in lower.to_pylist()], np.uint64)
        random = mix((own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.numbers[first : first + size] = np.where(self.of_words(lower), random, np.uint64(0))
        self.filled[block] = True

    def of(self, points: np.ndarray) -> np.ndarray:
        """The numbers of code points."""
        for block in np.unique(points >> BLOCK_BITS) if points.max(initial=0) >> BLOCK_BITS else [0]:
            if not self.filled[block]:
                self.fill(int(block))
        return self.numbers[points]


#: Letters, digits and marks; and all but white space.
WORDS = Alphabet(lambda chars: pc.match_substring_regex(chars, WORD_GAP).to_numpy(zero_copy_only=False) ^ True)
SOLID = Alphabet(lambda chars: np.array([not c.isspace() for c in chars.to_pylist()]))
POWERS = [np.ones(1, np.uint64)]
#: Code points that are hashed at a time.
CHUNK = 1 << 18


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, nulls being empty, and where each text's begin."""
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    starts = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))))
    if not starts[-1]:
        return np.zeros(0, np.uint32), starts
    at = np.frombuffer(texts.buffers()[1], np.int64)[[texts.offset, texts.offset + len(texts)]]
    return np.frombuffer(str(memoryview(texts.buffers()[2])[at[0] : at[1]], "utf-8").encode("utf-32-le"), np.uint32), starts


def point_words(points: np.ndarray, starts: np.ndarray, alphabet: Alphabet = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-case word (run of the alphabet's characters) among code points and where it begins; no word
    goes on over one of starts. Words of a chunk are hashed as polynomials of their characters' numbers."""
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(points):
        end, far = min(at + CHUNK, len(points)), CHUNK
        own = alphabet.of(points[at:end])
        while end < len(points) and own[-1] and not (last := np.flatnonzero(own == 0)).size:  # a word longer than the chunk
            far *= 2
            end = min(at + far, len(points))
            own = alphabet.of(points[at:end])
        if end < len(points) and own[-1]:
            end = at + int(last[-1]) + 1
            own = own[: end - at]
        word = own != 0
        new = word.copy()
        new[1:] &= ~word[:-1]
        cut = starts[np.searchsorted(starts, at) : np.searchsorted(starts, end)] - at
        new[cut] = word[cut]
        begin = np.flatnonzero(new)
        if len(begin):
            place = np.arange(begin[0], len(own)) - np.repeat(begin, np.diff(begin, append=len(own)))
            longest = int(place.max()) + 1
            if len(POWERS[0]) < longest:
                POWERS[0] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * longest, np.uint64(0x9E3779B97F4A7C15)))), dtype=np.uint64)
            hashes.append(mix(np.add.reduceat(own[begin[0] :] * POWERS[0][place], begin - begin[0])))
            places.append(begin + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def word_hashes(texts: pa.Array, alphabet: Alphabet = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, by default those of word_lists(), and where each text's begin."""
    points, starts = code_points(texts)
    hashes, places = point_words(points, starts[:-1], alphabet)
    return hashes, np.searchsorted(places, starts)


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts cut at line feeds: hashes of the words, the number of each word's line in the batch, and each line's
    text and number within the text."""
    points, starts = code_points(texts)
    feeds = np.flatnonzero(points == 10)
    counts = np.diff(np.searchsorted(feeds, starts)) + 1
    owner, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    begin = np.empty(len(owner), np.int64)
    rest = np.ones(len(owner), bool)
    rest[first] = False
    begin[first], begin[rest] = starts[:-1], feeds + 1
    hashes, places = point_words(points, starts[:-1])
    line = np.repeat(np.arange(len(begin)), np.diff(np.searchsorted(places, begin), append=len(places)))
    return hashes, line, owner, np.arange(len(owner)) - first[owner]


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words and its text's index; a shorter text with any word is one shingle."""
    lengths = np.diff(starts)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = starts[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros(len(owner), np.uint64)
    end = starts[1:][owner]
    for k in range(width):
        at = np.minimum(first + k, len(hashes) - 1) if len(hashes) else first
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(first + k < end, hashes[at], np.uint64(k + 1)))
    return out, owner


def as_lists(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A list<int64> array from flat 64-bit values and list starts."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat.view(np.int64)))


#: Names of the words of parity bits of a set.
PARITY = ("b0", "b1", "b2", "b3")


def parity(flat: np.ndarray, starts: np.ndarray, words: int = len(PARITY)) -> list[np.ndarray]:
    """Words of parity bits, of four in all, per list of distinct hashes: each element flips one bit. Those of two sets
    differ in at most as many bits as the sets have elements that are not common."""
    begin = np.minimum(starts[:-1], len(flat))
    out = []
    for k in range(words):
        own = np.where(flat >> np.uint64(6) & np.uint64(3) == k, np.uint64(1) << (flat & np.uint64(63)), np.uint64(0))
        found = np.bitwise_xor.reduceat(np.append(own, np.uint64(0)), begin) if len(begin) else np.zeros(0, np.uint64)
        out.append(np.where(np.diff(starts) > 0, found, np.uint64(0)))
    return out


def parity_fits(threshold: float, words: tuple[str, ...] = PARITY) -> Column:
    """Whether sets x and y of `size` elements can have the threshold's similarity, by (some words of) their bits."""
    differ = " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in words)
    return F.expr(f"{differ} <= (x.size + y.size) * {(1 - threshold) / (1 + threshold)!r}D + 1e-9D")  # doubles, not decimals


#: Bits of a member filter: 16 for each member up to this many bits (8 MB), when false hits become common.
FILTER_BITS = 1 << 26


def place(ids: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of one or more integer columns."""
    out = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.int64).view(np.uint64))
    return out


class MemberFilter:
    """A lossy set of rows of integers, of bounded size: `holds` is true for every member and few others."""

    def __init__(self, members: DataFrame):
        """members: columns of integers without nulls."""
        count = members.count()
        self.bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (16 * count).bit_length()))
        bits = self.bits

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(place([c.to_numpy(zero_copy_only=False) for c in batch.columns]) & np.uint64(bits - 1))
                value = np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(value.view(np.int64))], ["word", "bit"])

        table = members.mapInArrow(words, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.table = np.zeros(bits // 64, np.uint64)
        self.table[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)

    def holds(self, ids: list[np.ndarray]) -> np.ndarray:
        at = place(ids) & np.uint64(self.bits - 1)
        return (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def could_match(threshold: float) -> Column:
    """Length and positional filters of a set-similarity join: whether two sets x and y of `size` elements, in one
    order, can have the threshold's Jaccard similarity if the element at the 0-based places x.pos and y.pos is the
    first that they share. Each similar pair passes at its first shared element."""
    need = F.expr(f"least(x.size - x.pos, y.size - y.pos) >= {threshold / (1 + threshold)!r}D * (x.size + y.size) - 1e-9D")
    return need & F.expr(f"least(x.size, y.size) >= {threshold!r}D * greatest(x.size, y.size) - 1e-9D")
