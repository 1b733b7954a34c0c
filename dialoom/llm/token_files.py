"""Token ids in binary shards: a wavelet matrix per shard, whose compressed bit-planes answer rank and select."""

from __future__ import annotations

import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, shared_dir, slices
from .packing import WordEncoder

END_ID = 2
MAGIC = b"DLWM0001"
#: Bits of a plane that are compressed together; tokens of a shard, about; blocks that an open file keeps.
BLOCK, SHARD_TOKENS, KEPT_BLOCKS = 1 << 16, 1 << 22, 512
HEADER = ("tokens", "documents", "symbols", "levels", "symbol_bytes", "document_bytes")
#: Words whose ids a worker keeps, over its tasks: some 120 MB.
CACHED_WORDS = 600_000
ENCODERS: dict[str, WordEncoder] = {}
ZSTD = pa.Codec("zstd", compression_level=1)


def build(ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> bytes:
    """One file: header, symbols, documents, zeros of each plane, directory of blocks, blocks.

    Ids get numbers by falling frequency, so the upper planes hold few ones. A plane holds one bit of every number, in
    the order that the planes above give: zeros first, then ones. Its blocks are compressed one by one (or left as they
    are where that is smaller), and the directory has each block's place and the ones before it."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    symbols = symbols[np.argsort(-counts[symbols], kind="stable")].astype("<u4")
    number = np.zeros(len(counts), np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
    number[symbols] = np.arange(len(symbols))
    code, levels = number[ids], max(1, (len(symbols) - 1).bit_length())
    zeros, ones, payload = [], [], []
    for level in range(levels):
        bit = (code >> (levels - 1 - level) & 1).astype(bool)
        packed, each = np.packbits(bit, bitorder="little"), []
        for at in range(0, len(packed), BLOCK // 8):
            raw = packed[at : at + BLOCK // 8]
            small = ZSTD.compress(raw, asbytes=True)
            payload.append(small if len(small) < len(raw) else raw.tobytes())
            each.append(int(np.bitwise_count(raw).sum()))
        ones.append(np.cumsum([0, *each[:-1]]))
        zeros.append(len(bit) - sum(each))
        code = np.concatenate((np.compress(~bit, code), np.compress(bit, code)))
    own = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False).astype("u1")
    symbol_part = ZSTD.compress(symbols.tobytes(), asbytes=True)
    document_part = ZSTD.compress(lengths.astype("<i8").tobytes() + own.tobytes() + known.tobytes(), asbytes=True)
    header = np.array([len(ids), len(lengths), len(symbols), levels, len(symbol_part), len(document_part)], "<i8").tobytes()
    directory = np.concatenate((np.cumsum([0, *map(len, payload)]), *ones)).astype("<i8").tobytes()
    return b"".join([MAGIC, header, symbol_part, document_part, np.array(zeros, "<i8").tobytes(), directory, *payload])


class TokenFile:
    """One shard's file. Whatever is asked for, only the blocks that are needed are read and unpacked.

    Positions are places in the shard, from 0."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        start = len(MAGIC) + 8 * len(HEADER)
        head = source.read_at(start, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of tokens")
        own = dict(zip(HEADER, np.frombuffer(head[len(MAGIC) :], "<i8").tolist(), strict=True))
        self.size, self.levels, n = own["tokens"], own["levels"], own["documents"]
        self.blocks = -(-self.size // BLOCK)
        many = self.levels * self.blocks
        rest = source.read_at(own["symbol_bytes"] + own["document_bytes"] + 8 * (self.levels + 2 * many + 1), start)
        at = own["symbol_bytes"]
        self.symbols = np.frombuffer(ZSTD.decompress(rest[:at], 4 * own["symbols"], asbytes=True), "<u4")
        documents = ZSTD.decompress(rest[at : at + own["document_bytes"]], 17 * n, asbytes=True)
        self.lengths, ids = np.frombuffer(documents, "<i8", n), np.frombuffer(documents, "<i8", n, 8 * n)
        self.doc_ids = pa.array(ids, mask=np.frombuffer(documents, "u1", n, 16 * n) == 0)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        numbers = np.frombuffer(rest[at + own["document_bytes"] :], "<i8")
        self.zeros, self.places, self.ones = numbers[: self.levels], numbers[self.levels : self.levels + many + 1], numbers[self.levels + many + 1 :].reshape(self.levels, self.blocks)
        self.payload, self.held = start + len(rest), OrderedDict()
        self.number = {int(s): k for k, s in enumerate(self.symbols)}

    def unpacked(self, blob: bytes, block: int) -> np.ndarray:
        bits = min(BLOCK, self.size - block * BLOCK)
        raw = -(-bits // 8)
        return np.frombuffer(blob if len(blob) == raw else ZSTD.decompress(blob, raw, asbytes=True), np.uint8)

    def block(self, level: int, block: int) -> np.ndarray:
        """The bits of a block as bytes of eight."""
        key = (level, block)
        if key not in self.held:
            k = level * self.blocks + block
            blob = self.source.read_at(int(self.places[k + 1] - self.places[k]), self.payload + int(self.places[k]))
            self.held[key] = self.unpacked(blob, block)
            if len(self.held) > KEPT_BLOCKS:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]

    def rank(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at places of a plane (0 at its end) and the ones before them."""
        bits, ones = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        full = at >= self.size
        ones[full] = self.size - self.zeros[level]
        of = at // BLOCK
        for block in np.unique(of[~full]).tolist():
            here = np.flatnonzero((of == block) & ~full)
            bit = np.unpackbits(self.block(level, block), bitorder="little")
            inside = at[here] - block * BLOCK
            bits[here] = bit[inside]
            ones[here] = self.ones[level, block] + (np.cumsum(bit, dtype=np.int64) - bit)[inside]
        return bits, ones

    def select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0, rising) ones or zeros of a plane."""
        before = self.ones[level] if bit else np.arange(self.blocks) * BLOCK - self.ones[level]
        of, out = np.searchsorted(before, nth, side="right") - 1, np.zeros(len(nth), np.int64)
        for block in np.unique(of).tolist():
            here = of == block
            own = np.unpackbits(self.block(level, block), bitorder="little")[: self.size - block * BLOCK]
            out[here] = block * BLOCK + np.flatnonzero(own == bit)[nth[here] - before[block]]
        return out

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The ids at positions."""
        at, code = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit, ones = self.rank(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            code = code << 1 | bit
        return self.symbols[code]

    def span(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where a token's occurrences in a range of positions lie below the last plane."""
        if token not in self.number:
            return 0, 0
        at = np.array([begin, end])
        for level in range(self.levels):
            ones = self.rank(level, at)[1]
            at = self.zeros[level] + ones if self.number[token] >> (self.levels - 1 - level) & 1 else at - ones
        return int(at[0]), int(at[1])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often a token occurs in a range of positions, without reading them."""
        low, high = self.span(token, begin, self.size if end is None else end)
        return high - low

    def occurrences(self, token: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The positions of a token in a range, rising."""
        at = np.arange(*self.span(token, begin, self.size if end is None else end))
        for level in reversed(range(self.levels)) if len(at) else ():
            bit = self.number[token] >> (self.levels - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's kth document."""
        return self.tokens(np.arange(self.starts[k], self.starts[k + 1]))

    def everything(self) -> np.ndarray:
        """All ids, plane by plane from the last one up, each read once."""
        code = np.zeros(self.size, np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for level in reversed(range(self.levels)):
            k = level * self.blocks
            blob = self.source.read_at(int(self.places[k + self.blocks] - self.places[k]), self.payload + int(self.places[k]))
            cut = (self.places[k : k + self.blocks + 1] - self.places[k]).tolist()
            plane = np.concatenate([self.unpacked(blob[a:b], block) for block, (a, b) in enumerate(zip(cut, cut[1:]))])
            bit = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            upper = np.empty_like(code)
            np.place(upper, ~bit, code[: self.zeros[level]])
            np.place(upper, bit, code[self.zeros[level] :] | code.dtype.type(1 << (self.levels - 1 - level)))
            code = upper
        return self.symbols[code]


def opened(path: str) -> TokenFile:
    """A file by its full address, from any task: what pyarrow's file systems reach (local and shared folders, HDFS, S3)."""
    system, place = fs.FileSystem.from_uri(path)
    return TokenFile(system.open_input_file(place))


def addressed(spark: SparkSession, folder: str) -> str:
    """A folder with its file system, as tasks know nothing of the cluster's default one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    return system.makeQualified(path).toUri().toString().replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)


def encoded(batch: pa.RecordBatch, encoder: WordEncoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the texts, each with the end id, and the count of each."""
    ids, starts = encoder.encode(batch.column("text"))
    lengths = np.diff(starts)
    out = np.full(len(ids) + len(lengths), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out, lengths + 1


def written(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    """Writes one partition of sorted documents as files of about shard_tokens tokens; a row a file. A task that is run
    again writes files of other names; only those of the rows that are kept count."""
    encoder = ENCODERS.get(tokenizer) or ENCODERS.setdefault(tokenizer, WordEncoder(tokenizer, CACHED_WORDS))
    part, begin, system_place, no = TaskContext.get().partitionId(), 0, fs.FileSystem.from_uri(folder), 0
    ids, lengths, docs = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

    def save(n: int) -> pa.RecordBatch:
        """A file of the first n documents held."""
        nonlocal ids, lengths, docs, begin, no
        held, tokens = pa.concat_arrays(docs), int(lengths[:n].sum())
        name = f"tokens-{part:06d}-{no:06d}-{uuid.uuid4().hex}.wm"
        with system_place[0].open_output_stream(f"{system_place[1]}/{name}") as f:
            f.write(build(ids[:tokens], held.slice(0, n), lengths[:n]))
        row = [part, no, f"{folder}/{name}", n, tokens, begin]
        ids, lengths, docs, begin, no = ids[tokens:].copy(), lengths[n:], [held.slice(n)], begin + tokens, no + 1
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "no", "path", "n_docs", "n_tokens", "begin"])

    for batch in slices(batches):
        more, sizes = encoded(batch, encoder, end_id)
        ids, lengths = np.concatenate((ids, more)), np.concatenate((lengths, sizes))
        docs.append(batch.column("doc_id"))
        while len(ids) >= shard_tokens:
            yield save(int(np.searchsorted(np.cumsum(lengths), shard_tokens)) + 1)
    if len(lengths):
        yield save(len(lengths))
    give_back()


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the token ids of all docs(doc_id, text), each followed by end_id, in ascending doc_id order, and returns the
    list of files: (path, n_docs, n_tokens, start), start being the tokens of all files before.

    tokenizer: path of a tokenizers file whose tokens don't cross white space. folder: where to write, by default one in
    the shared folder. Documents are dealt out by ranges of doc_id, so the order of files is that of documents, and
    the number of partitions is the session's. A worker holds the ids of one file, and of one slice of texts; a document
    is never cut, so a file may be longer by one document.

    A null doc_id comes first. Rows that repeat a doc_id follow one another in the order of their texts' hashes, and are
    spread by the files they come from where they are many. Null and empty texts are a single end_id. An empty table gives no
    files. Extra columns are ignored.
    """
    spark = docs.sparkSession
    folder = addressed(spark, folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("by_text"), F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("by_file"))
    dealt = base.repartitionByRange("doc_id", "by_text", "by_file").sortWithinPartitions("doc_id", "by_text").select("doc_id", "text")
    schema = "part long, no long, path string, n_docs long, n_tokens long, begin long"
    files = materialize(dealt.mapInArrow(lambda it: written(it, tokenizer, folder, end_id, shard_tokens), schema), "files")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(parts.select("part", before.alias("before")), "part").select("path", "n_docs", "n_tokens", (F.col("before") + F.col("begin")).alias("start"))


def spread(files: DataFrame) -> DataFrame:
    """The list of files, a few in each partition: their rows are small, but what they name is not."""
    return files.repartition(max(1, min(files.count(), 10_000)))


def read_documents(files: DataFrame) -> DataFrame:
    """One row (doc_id, start, n_tokens, ids_crc32) per document in files: its first token's place among all, the count of
    its ids with the end id, and the checksum of these as little-endian unsigned 32-bit numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = opened(path)
                ids = memoryview(file.everything().astype("<u4")).cast("B")
                cut = (4 * file.starts).tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([file.doc_ids, pa.array(start + file.starts[:-1]), pa.array(file.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                give_back()

    return spread(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """One row (token, n) for each of a stated list of ids: how often it occurs in all files, by rank alone."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file = opened(path)
                yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([file.count(t) for t in tokens], pa.int64())})

    every = files.sparkSession.createDataFrame([(t, 0) for t in tokens], "token long, n long")  # where there is no file
    return spread(files).mapInArrow(counted, "token long, n long").union(every).groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """One row (token, doc_id, at) for each occurrence of a stated list of ids: its place in its document, by select."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file = opened(path)
                for t in tokens:
                    at = file.occurrences(t)
                    doc = np.searchsorted(file.starts, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), file.doc_ids.take(pa.array(doc)), pa.array(at - file.starts[doc])], ["token", "doc_id", "at"])

    return spread(files).mapInArrow(found, "token long, doc_id long, at long")


def tokens_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """One row (place, token) per row of places(place): the id at that place among all tokens; places beyond the last
    token, before the first, and null ones give a null token.

    A place finds its file by slots of as many tokens as the longest file has, and places of one file are read a block
    of positions at a time, by as many tasks as there are blocks."""
    longest, end = files.agg(F.max("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    slot, end = longest or 1, end or 0
    first, last = F.floor(F.col("start") / slot), F.floor((F.col("start") + F.col("n_tokens") - 1) / slot)
    slots = files.select("path", "start", "n_tokens", F.explode(F.sequence(first, last)).alias("slot"))
    asked = places.select(F.col("place").cast("long"))
    dealt = asked.withColumn("slot", F.floor(F.col("place") / slot)).join(slots, "slot")
    inside = F.col("place").between(F.col("start"), F.col("start") + F.col("n_tokens") - 1)
    hits = dealt.where(inside).select("path", "place", (F.col("place") - F.col("start")).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            paths = batch.column("path").to_pylist()
            cut = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]]
            for a, b in zip(cut, [*cut[1:], len(paths)], strict=True):
                if paths[a] != path:
                    path, file = paths[a], opened(paths[a])
                ids = file.tokens(batch.column("at").slice(a, b - a).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("place").slice(a, b - a), pa.array(ids.astype(np.int64))], ["place", "token"])

    by_block = hits.repartition("path", F.floor(F.col("at") / BLOCK)).sortWithinPartitions("path", "at")
    missed = asked.where(F.col("place").isNull() | ~F.col("place").between(0, end - 1))
    return by_block.mapInArrow(read, "place long, token long").union(missed.select("place", F.lit(None).cast("long").alias("token")))
