"""Shared prefixes of conversations: a Patricia tree over sorted turn sequences, expanded to one row a prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words are runs of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Every this many conversations share their beginnings with the first of them, over at most SHARED - 1 turns.
FAMILY, SHARED = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()
SEQUENCE = "array<struct<h:binary,w:bigint>>"
#: What the pass over one shard of sorted sequences gives. fp: of prefixes that other shards may have too; the rows of one
#: fp are parts of one node. parent_fp: where the parent is such a prefix.
NODE = (
    "shard int, head boolean, last boolean, depth long, fp binary, parent_fp binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " ends_sha256 string, spoken long, owned long, total long, pre long, more long, last_len long"
)
NAMES = [x.split()[0] for x in NODE.split(",")]
TYPES = {"int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
ARROW = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in NODE.split(",")])
#: Node rows of a batch that a worker gives back.
ROWS = 5_000


def turn_hash(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 of a turn."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


def rebuilt(talk: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns, of which the first few come from the first conversation of its family."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = talk.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), turn_hash(role, text).alias("h"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["h"].alias("h"), t["w"].alias("w"))).alias("own"))
    first = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, SHARED - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "base", "left").withColumn("first", F.coalesce("first", F.array().cast(SEQUENCE)))
    return both.select("conv_id", F.concat(F.slice("first", F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))).alias("seq"))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sequence that follow one another, as one row with their conversations' ids in a list."""
    for batch in batches:
        sid, ids = batch.column("sid").to_pylist(), batch.column("conv_id").to_pylist()
        begin = [i for i in range(len(sid)) if not i or sid[i] != sid[i - 1]]
        runs = [ids[a:b] for a, b in zip(begin, [*begin[1:], len(ids)], strict=True)]
        at = pa.array(begin, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("sid").take(at), pa.array([x[0] for x in runs], pa.int64()), pa.array([",".join(map(str, x)) for x in runs], pa.string()), pa.array(list(map(len, runs)), pa.int64()), batch.column("seq").take(at)],
            ["sid", "first", "ids", "n", "seq"],
        )


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a sequence of rows sorted by (sid, first): its conversations are hashed as they come, not held."""
    sid, digest, row = None, None, None

    def found() -> pa.RecordBatch:
        seq, first, n = row
        return pa.RecordBatch.from_arrays([seq, pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["seq", "conv_id", "n", "ends_sha256"])

    for batch in batches:
        done = []
        for i, (key, first, ids, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("sid", "first", "ids", "n")), strict=True)):
            if key != sid:
                if row:
                    done.append(found())
                sid, digest, row = key, hashlib.sha256(ids.encode()), (batch.column("seq").slice(i, 1), first, n)
            else:
                digest.update(b"," + ids.encode())
                row = (row[0], row[1], row[2] + n)
        yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else []
    if row:
        yield found()


class Point:
    """A branch, end or leaf of the tree of one shard: the sums over the sorted sequences below it.

    first: the number of the first of them in the shard, of whose words `sums` are running sums and `size` the count of
    turns. owned: words of prefixes that the other sequences are the first to have. spoken: words of all conversations."""

    __slots__ = ("depth", "first", "sums", "size", "n", "conv", "spoken", "owned", "kids", "leaves", "ends", "waiting")

    def __init__(self, depth: int, first: int, sums: list[int], n: int = 0, conv: int | None = None, ends: str | None = None):
        self.depth, self.first, self.sums, self.size = depth, first, sums, len(sums) - 1
        self.n, self.conv, self.ends, self.spoken = n, conv, ends, n * sums[-1]
        self.owned = self.kids = self.leaves = 0
        self.waiting: list[dict] = []

    def take(self, child: Point) -> None:
        self.n += child.n
        self.conv = child.conv if self.conv is None else min(self.conv, child.conv)
        self.spoken += child.spoken
        self.owned += child.owned + (0 if child.first == self.first else child.sums[-1] - child.sums[self.depth])
        self.leaves += child.leaves
        self.kids += 1


def prefix_hashes(turns: list[bytes]) -> list[bytes]:
    out = [bytes(16)]
    for h in turns:
        out.append(hashlib.blake2b(out[-1] + h, digest_size=16).digest())
    return out


class Shard:
    """The tree of one shard of sorted, distinct sequences. Only the path to the open sequence is held.

    Prefixes of the shard's first and last sequence may go on in other shards: they are given turn by turn, as parts that
    are added up later. All others are whole here, and unary ones follow from the point below by sums over its edge."""

    def __init__(self, number: int):
        self.number, self.seen, self.stack, self.out = number, 0, [], []
        self.before: list[bytes] = []
        self.paths: dict[bool, list[bytes]] = {}

    def part(self, point: Point, depth: int, last: bool) -> dict:
        head, path = point.first == 0, self.paths[point.first == 0]
        kids, more = (point.kids if depth == point.depth else 1), int(point.size > depth)
        return {
            "shard": self.number, "head": head, "last": last, "depth": depth, "fp": path[depth], "parent_fp": path[depth - 1] if depth else None, "conv_id": point.conv, "n_convs": point.n, "n_children": kids - more if head else kids,
            "n_leaves": point.leaves, "ends_sha256": point.ends if depth == point.depth else None, "spoken": point.spoken, "owned": point.owned, "total": point.sums[-1], "pre": point.sums[max(depth - 1, 0)], "more": more,
            "last_len": len(self.before) if last else None,
        }

    def whole(self, point: Point, depth: int) -> dict:
        pre = point.sums[depth - 1]
        return {
            "shard": self.number, "depth": depth, "conv_id": point.conv, "parent_conv_id": point.conv, "n_convs": point.n, "n_children": point.kids if depth == point.depth else 1, "n_leaves": point.leaves,
            "saved_tokens": point.spoken - point.n * pre - point.owned - point.sums[-1] + pre, "ends_sha256": point.ends if depth == point.depth else None,
        }

    def close(self, point: Point, parent: Point | None, last: bool = False) -> None:
        """point has no more sequences in this shard: gives the nodes of the edge from its parent."""
        if not point.kids and not last:
            point.leaves = 1
        top = parent.depth + 1 if parent else 0
        if last or point.first == 0:
            self.out.extend(self.part(point, d, last) for d in range(top, point.depth + 1))
            self.out.extend(row | {"parent_conv_id": None, "parent_fp": self.paths[point.first == 0][point.depth]} for row in point.waiting)
        else:
            self.out.extend(row | {"parent_conv_id": point.conv} for row in point.waiting)
            self.out.extend(self.whole(point, d) for d in range(top + 1, point.depth + 1))
            row = self.whole(point, top)
            if parent.first == 0:
                self.out.append(row | {"parent_conv_id": None, "parent_fp": self.paths[True][parent.depth]})
            else:
                parent.waiting.append(row)
        if parent:
            parent.take(point)

    def add(self, turns: list[bytes], words: list[int], n: int, conv: int, ends: str) -> None:
        sums = [0]
        for w in words:
            sums.append(sums[-1] + w)
        if not self.seen:
            self.paths[True] = prefix_hashes(turns)
            self.stack = [Point(0, 0, sums, n, conv, ends) if not turns else Point(0, 0, sums)]
        common = 0
        for a, b in zip(self.before, turns):
            if a != b:
                break
            common += 1
        while self.stack[-1].depth > common:
            point = self.stack.pop()
            if self.stack[-1].depth < common:
                self.stack.append(Point(common, point.first, point.sums))
                self.stack[-1].n, self.stack[-1].spoken = 0, 0
            self.close(point, self.stack[-1])
        if turns:
            self.stack.append(Point(len(turns), self.seen, sums, n, conv, ends))
        self.before = turns
        self.seen += 1

    def end(self) -> None:
        self.paths[False] = prefix_hashes(self.before)
        while self.stack:
            point = self.stack.pop()
            self.close(point, self.stack[-1] if self.stack else None, True)

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        while len(self.out) >= least:
            rows, self.out = self.out[:ROWS], self.out[ROWS:]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)


def patricia(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the tree of one partition of sorted sequences."""
    shard = Shard(TaskContext.get().partitionId())
    for batch in batches:
        seq = batch.column("seq")
        flat, at = seq.flatten(), seq.value_lengths().to_pylist()
        turns, words, begin = flat.field("h").to_pylist(), flat.field("w").to_pylist(), 0
        for size, n, conv, ends in zip(at, *(batch.column(c).to_pylist() for c in ("n", "conv_id", "ends_sha256")), strict=True):
            shard.add(turns[begin : begin + size], words[begin : begin + size], n, conv, ends)
            begin += size
            yield from shard.flush(ROWS)
    if shard.seen:
        shard.end()
    yield from shard.flush()


def shared_nodes(spine: DataFrame) -> DataFrame:
    """The nodes whose parts several shards may hold, added up.

    common: how many turns a shard's first sequence shares with the last one of the shard before (-1: there is none).
    The parts that go on from there have no first sequence of their own; the others add theirs. There is one row a
    shard in `bounds`, so at most one a shuffle partition."""
    shards = spine.where("depth = 0").select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("prior"))
    firsts = spine.where("head").select("shard", "depth", "fp", "pre")
    lasts = spine.where("last").select(F.col("shard").alias("prior"), "depth", "fp")
    common = shards.join(firsts, "shard").join(lasts, ["prior", "depth", "fp"]).groupBy("shard").agg(F.max("depth").alias("common"))
    bounds = shards.join(common, "shard", "left").withColumn("common", F.coalesce("common", F.lit(-1)))
    after = shards.join(common, "shard").select(F.col("prior").alias("shard"), F.col("common").alias("next"))
    pre = firsts.select("shard", (F.col("depth") - 1).alias("common"), F.col("pre").alias("shared"))
    bounds = bounds.join(after, "shard", "left").join(pre, ["shard", "common"], "left").select("shard", "common", F.coalesce("next", F.lit(-1)).alias("next"), "shared")
    inner = F.col("head") & (F.col("depth") <= F.col("common"))
    return (
        spine.join(F.broadcast(bounds), "shard")
        .withColumn("owned", F.col("owned") + F.col("total") - F.when(inner, F.col("shared")).otherwise(F.col("pre")))
        .withColumn("n_children", F.col("n_children") + F.when(inner, (F.col("common") == F.col("depth")).cast("long")).when(F.col("head"), F.col("more")).otherwise(0))
        .withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("last") & (F.col("next") < F.col("last_len")), 1).otherwise(0))
        .groupBy("fp", "depth")
        .agg(
            F.max("parent_fp").alias("parent_fp"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("spoken").alias("spoken"), F.sum("owned").alias("owned"), F.max("pre").alias("pre"), F.max("ends_sha256").alias("ends_sha256"),
        )
        .withColumn("saved_tokens", F.col("spoken") - F.col("n_convs") * F.col("pre") - F.col("owned"))
    )


def prefix_trie(talk: DataFrame) -> DataFrame:
    """One row (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per distinct
    prefix of the rebuilt conversations of talk(conv_id, turn, role, text).

    A turn is known by 128 bits of SHA-256. Conversations with equal turns are one sequence; sequences are sorted into
    shards, and one pass over a shard builds its Patricia tree: branches, ends and leaves, with compressed edges. Prefixes
    that shards share are added up afterwards, at most two paths a shard, so neither a common first turn nor a common
    conversation gathers rows in one task; only the ids of conversations with equal turns are hashed by one task each, a
    list of them at a time, as SHA-256 runs through its input in order. One conversation's turns are held by one task, as 24
    bytes a turn.

    Rows with a null conv_id belong to no conversation. A null turn comes first, turns with one number in the order of
    their hashes; repeated rows are turns of their own. Null roles and texts are empty. Remainders of negative ids have the
    sign of the id. An empty table has no root, so no rows. Extra columns are ignored.
    """
    rows = rebuilt(talk).select(F.sha2(F.array_join(F.transform("seq", lambda t: F.hex(t["h"])), "").cast("binary"), 256).alias("sid"), "conv_id", "seq")
    lists = rows.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(packed, f"sid string, first long, ids string, n long, seq {SEQUENCE}")
    sequences = lists.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(digested, f"seq {SEQUENCE}, conv_id long, n long, ends_sha256 string")
    sequences = materialize(sequences, "sequences")
    nodes = materialize(sequences.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(patricia, NODE), "nodes")
    shared = materialize(shared_nodes(nodes.where("fp is not null")), "shared-nodes")
    above = shared.select(F.col("fp").alias("parent_fp"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    inside = nodes.where("fp is null")
    return (
        inside.where("parent_fp is null").select(*columns)
        .union(inside.where("parent_fp is not null").join(above, "parent_fp").withColumn("parent_conv_id", F.col("above")).select(*columns))
        .union(shared.join(above, "parent_fp", "left").withColumn("parent_conv_id", F.col("above")).select(*columns))
    )
