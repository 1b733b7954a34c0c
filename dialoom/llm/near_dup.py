"""MinHash near-dedup by DartMinHash signatures and banded joining."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PARITY, MemberFilter, as_lists, components, could_match, discard, materialize, mix, parity, parity_fits, shingles, slices, word_hashes

COORDINATES, BANDS, ROWS = 256, 42, 6
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def unit_regions(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One id per unit of weight: a shingle that a text holds n times is n regions, (shingle, 0) to (shingle, n - 1)."""
    order = np.lexsort((hashes, owner))
    value, text = hashes[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    nth = (np.arange(len(order)) - begin).astype(np.uint64)
    out = np.empty(len(order), np.uint64)
    out[order] = np.where(nth == 0, value, mix(value + nth * GOLDEN))
    return out


def dart_signatures(regions: np.ndarray, owner: np.ndarray, texts: int, k: int = COORDINATES) -> np.ndarray:
    """A (texts, k) array of dart ids; row i is meaningless where text i has no region.

    Each region receives hashed darts as a Poisson process of rate 1 along the rank axis, so a heavier text gets
    more of them. A dart falls on a coordinate; the earliest dart of a coordinate is its entry. Two texts share an
    entry with the probability of their weighted Jaccard similarity. Darts are thrown up to the rank where about
    k ln k + 2k fall; texts that leave a coordinate empty are thrown again up to twice that rank.
    """
    out = np.zeros((texts, k), np.uint64)
    weight = np.bincount(owner, minlength=texts)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        best, ids = np.full(texts * k, np.inf), np.zeros(texts * k, np.uint64)
        keep = todo[owner]
        at, text, rank, nth = regions[keep], owner[keep], 0.0, 0
        while len(at):
            dart = mix(at + np.uint64((2 * nth + 1) * int(GOLDEN) % 2**64))
            gap = (mix(dart ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)).astype(np.float64) + 0.5
            rank = rank - np.log(gap / 2.0**53)
            hit = rank <= limit[text]
            at, text, rank, dart = at[hit], text[hit], rank[hit], dart[hit]
            cell = text * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            won = rank == best[cell]
            ids[cell[won]] = dart[won]
            nth += 1
        full = np.isfinite(best).reshape(texts, k).all(axis=1) & todo
        out[full] = ids.reshape(texts, k)[full]
        todo &= ~full
        limit *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(signature), 1))
    for r in range(rows):
        keys = mix(keys * GOLDEN + signature[:, r : bands * rows : rows])
    return keys


def signed(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) to (doc_id, digest, weight, bands); a text without words has weight 0 and no bands."""
    for batch in slices(batches, 2 << 20):
        hashes, owner = shingles(*word_hashes(batch.column("text")), width)
        n = batch.num_rows
        keys = band_keys(dart_signatures(unit_regions(hashes, owner), owner, n), bands, rows)
        weight = np.bincount(owner, minlength=n)
        starts = np.concatenate(([0], np.cumsum(np.where(weight > 0, bands, 0))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(weight, pa.int64()), as_lists(keys[weight > 0].ravel(), starts)],
            ["doc_id", "digest", "weight", "bands"],
        )


def region_lists(batches: Iterator[pa.RecordBatch], width: int, wanted: MemberFilter) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (id, regions, b0 ...), the sorted unit regions and their parity bits, of the documents in
    the filter."""
    for batch in slices(batches):
        batch = batch.filter(pa.array(wanted.holds([batch.column("doc_id").to_numpy()])))
        hashes, owner = shingles(*word_hashes(batch.column("text")), width)
        regions = unit_regions(hashes, owner)
        order = np.lexsort((regions, owner))
        starts = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
        bits = (pa.array(b.view(np.int64)) for b in parity(regions[order], starts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_lists(regions[order], starts), *bits], ["id", "regions", *PARITY])


def compared(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """pairs(a, b) with their exact weighted Jaccard similarity over unit regions."""
    found = pairs.join(lists.select(F.col("id").alias("b"), F.col("regions").alias("rb")), "b")
    found = found.join(lists.select(F.col("id").alias("a"), F.col("regions").alias("ra")), "a")
    both = F.size(F.array_intersect("ra", "rb"))
    return found.select("a", "b", (both / (F.size("ra") + F.size("rb") - both)).alias("jaccard"))


#: Cells of the sketch that orders regions by how many members hold them. It makes prefixes rare, and so cheap; pairs are
#: found by any order.
SKETCH_BITS = 20


def cells(regions: np.ndarray) -> np.ndarray:
    return (mix(regions) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def region_sketch(lists: DataFrame) -> np.ndarray:
    """How many of the regions of lists(regions) fall into each of 2**SKETCH_BITS cells, which are all that is collected."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            total += np.bincount(cells(batch.column("regions").flatten().to_numpy().view(np.uint64)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    found = lists.select("regions").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[found["cell"].to_numpy()] = found["n"].to_numpy()
    return sketch


def region_prefixes(batches: Iterator[pa.RecordBatch], sketch: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, component, regions, parity bits) to one row per region of each prefix, rarest first by (count in the sketch,
    region). A region that is alone in its cell is no other member's, so it only takes its place in the prefix."""
    for batch in batches:
        lists = batch.column("regions")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        owner, regions = np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy().view(np.uint64)
        count = sketch[cells(regions)]
        by = np.lexsort((regions, count, owner))
        pos = np.arange(len(by)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keep = (pos <= (lengths - np.ceil(threshold * lengths - 1e-9).astype(np.int64))[owner]) & (count[by] > 1)
        at = pa.array(owner[keep])
        own = [batch.column(c).take(at) for c in ("id", "component", *PARITY)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(lengths[owner[keep]].astype(np.int32)), pa.array(pos[keep].astype(np.int32)), pa.array(regions[by][keep].view(np.int64))], ["id", "component", *PARITY, "size", "pos", "region"])


def prefix_pairs(members: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members(id, component) of different components that can reach the threshold: they share a
    region in the prefixes of their rarest regions and pass the length, positional and parity filters."""
    own = materialize(lists.join(members, "id"), "member-regions")
    sketch = own.sparkSession.sparkContext.broadcast(region_sketch(own))
    schema = "id long, component long, " + ", ".join(f"{b} long" for b in PARITY) + ", size int, pos int, region long"
    shown = materialize(own.mapInArrow(lambda it: region_prefixes(it, sketch.value, threshold), schema), "region-prefixes")
    x, y = shown.alias("x"), shown.alias("y")
    found = x.join(y, (F.col("x.region") == F.col("y.region")) & F.expr("x.component < y.component") & could_match(threshold) & parity_fits(threshold))
    return found.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")).distinct()


#: Members of a bucket that is still open which all others are compared with before prefixes are joined.
LEADERS = 2


def open_buckets(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, id, component) of the buckets members(band, id) that hold more than one component."""
    labelled = materialize(members.join(groups.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component")), "labelled")
    apart = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return labelled.join(apart, "band", "left_semi")


def led_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the leaders of each bucket and its members of other components. The first LEADERS members by a hash
    of their ids lead, so that they do in most of their buckets; a member meets the leaders of all its buckets at once."""
    nth = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("id"), "id"))
    leaders = buckets.withColumn("nth", nth).where(F.col("nth") <= LEADERS).groupBy("band").agg(F.collect_list(F.struct("id", "component")).alias("l"))
    met = buckets.join(leaders, "band").groupBy("id", "component").agg(F.array_distinct(F.flatten(F.collect_list("l"))).alias("l"))
    met = met.select("id", "component", F.explode("l").alias("l")).where("component <> l.component")
    return met.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct()


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups(node, component) joined by links(a, b) of any ids; only components, of which links join few, are followed."""
    end = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    known = links.join(end("a"), "a", "left").join(end("b"), "b", "left")
    edges = known.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    found = materialize(components(edges), "joined").withColumnsRenamed({"node": "old", "component": "new"})
    moved = groups.join(found, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = found.join(groups.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return materialize(moved.union(alone), "groups")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row (doc_id, class_id, kept) per row of docs; class_id is the smallest doc_id of its group.

    Texts are bags of five-word shingles; two texts are linked when their weighted Jaccard similarity is at least
    `threshold`, and groups are the connected components of links. Exact copies collapse first. A band bucket links
    its members through its smallest id. Members that this leaves in different groups are then joined with one another
    by an exact prefix filter over their rarest shingles, so no candidate pair is lost and a bucket of like texts
    costs about one comparison a member.

    Null and empty texts, and texts without a word, form groups of their own and stay. Rows with a null doc_id stay,
    with a null class_id. Rows that share a doc_id count as one document. Texts of fewer than five words are one
    shingle. Extra columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = base.where("doc_id is not null")
    schema = "doc_id long, digest string, weight long, bands array<long>"
    marked = named.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    full = materialize(marked.mapInArrow(lambda it: signed(it, width, bands, rows), schema), "signatures")
    signs = materialize(full.drop("bands"), "digests")
    wordy = signs.where("weight > 0")
    firsts = materialize(wordy.groupBy("digest").agg(F.min("doc_id").alias("rep")), "firsts")
    shown = full.where("weight > 0").join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    keyed = materialize(shown.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band")), "bands")
    discard(full)
    lead = keyed.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).where("a < z")
    lead = materialize(lead.select("band", "a", "n"), "leaders")
    met = materialize(keyed.join(lead, "band").where("id <> a").select("a", "id", "band", "n"), "met")
    discard(keyed)
    pairs = materialize(met.select("a", F.col("id").alias("b")).distinct(), "pairs")
    wanted = docs.sparkSession.sparkContext.broadcast(MemberFilter(pairs.select(F.explode(F.array("a", "b")))))
    lists = named.mapInArrow(lambda it: region_lists(it, width, wanted.value), "id long, regions array<long>, " + ", ".join(f"{b} long" for b in PARITY))
    lists = materialize(lists, "regions")
    scored = materialize(compared(pairs, lists), "scored")
    links = scored.where(F.col("jaccard") >= threshold).select("a", "b")
    groups = materialize(components(links), "groups")

    # buckets of three or more whose members, besides the first, are still in different groups: led by more members;
    # what is left then meets by its rarest shingles
    tried, shared = pairs, met.where("n > 2").select("band", "id")
    for find in (led_pairs, lambda x: prefix_pairs(x.select("id", "component").distinct(), lists, threshold)):
        open_ = materialize(open_buckets(shared, groups), "open-buckets")
        if open_.isEmpty():
            break
        fresh = materialize(find(open_).join(tried, ["a", "b"], "left_anti"), "late-pairs")
        late = materialize(compared(fresh, lists).where(F.col("jaccard") >= threshold).select("a", "b"), "late-links")
        tried = tried.union(fresh)
        if not late.isEmpty():
            groups = joined_groups(groups, late)

    classes = firsts.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    classes = materialize(classes.select("digest", F.coalesce("component", "rep").alias("class_id")), "classes")
    member = wordy.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id")
    alone = signs.where("weight = 0").select("doc_id", F.col("doc_id").alias("class_id"))
    nameless = base.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    every = member.union(alone).union(nameless)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; columns and order of columns as given, which mustn't
    include __gone."""
    drop = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(drop, F.col("doc_id") == F.col("__gone"), "left_anti")
