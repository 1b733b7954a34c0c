"""Embedding near-dedup: a navigable small-world graph per shard, queried by every shard of the same label."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, components, give_back, materialize

#: Distinct vectors of one shard on average, neighbours kept per node above and on the ground layer, first beam.
SHARD_ROWS, NEIGHBOURS, GROUND, BUILD_BEAM, BEAM = 4096, 12, 24, 40, 16
#: A beam doubles until this share of the links of audited queries is found, the shard's own and those of every other
#: shard: as many evenly spread queries as have LEAST_LINKS links, other than to themselves, but AUDITED at most.
RECALL, LEAST_LINKS, AUDITED = 0.99, 100, 1024


#: Tasks of pairs of shards for each core, at most.
PAIR_TASKS = 16


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; similarity is the dot product."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.x = vectors.astype(np.float32)
        self.levels = np.minimum(-np.log(1 - np.random.default_rng(seed).random(len(vectors))) / np.log(NEIGHBOURS), 8).astype(int)
        self.links: list[dict[int, list[int]]] = [{} for _ in range(int(self.levels.max(initial=0)) + 1)]
        self.entry, self.beam = -1, BEAM
        for i in range(len(vectors)):
            self.insert(i)

    def search(self, q: np.ndarray, starts: list[int], beam: int, layer: int) -> list[tuple[float, int]]:
        """The best `beam` nodes (similarity, node) that a best-first walk from starts meets, best first."""
        links, x, seen = self.links[layer], self.x, set(starts)
        first = list(zip((x[starts] @ q).tolist(), starts, strict=True))
        todo, best = [(-s, i) for s, i in first], first[:]
        heapq.heapify(todo), heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while todo:
            s, i = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= beam:
                break
            new = [j for j in links[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for s, j in zip((x[new] @ q).tolist(), new, strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (s, j)), heapq.heappush(todo, (-s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j)), heapq.heappush(todo, (-s, j))
        return sorted(best, reverse=True)

    def choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Up to `most` diverse neighbours: a node nearer to one already chosen than to the new node comes last."""
        ids = [i for _, i in found]
        among = self.x[ids] @ self.x[ids].T
        kept, rest = [], []
        for k, (s, _) in enumerate(found):
            if len(kept) < most and all(among[k, m] < s for m in kept):
                kept.append(k)
            else:
                rest.append(k)
        return [ids[k] for k in (kept + rest)[:most]]

    def insert(self, i: int) -> None:
        level = int(self.levels[i])
        for layer in range(level + 1):
            self.links[layer][i] = []
        if self.entry < 0:
            self.entry = i
            return
        q, at, top = self.x[i], [self.entry], int(self.levels[self.entry])
        for layer in range(top, level, -1):
            at = [self.search(q, at, 1, layer)[0][1]]
        for layer in range(min(level, top), -1, -1):
            found, most, links = self.search(q, at, BUILD_BEAM, layer), GROUND if layer == 0 else NEIGHBOURS, self.links[layer]
            links[i] = self.choose(found, NEIGHBOURS)
            for j in links[i]:
                links[j].append(i)
                if len(links[j]) > most:
                    own = sorted(zip((self.x[links[j]] @ self.x[j]).tolist(), links[j], strict=True), reverse=True)
                    links[j] = self.choose(own, most)
            at = [j for _, j in found]
        if level > top:
            self.entry = i

    def near(self, q: np.ndarray, least: float, beam: int) -> list[int]:
        """Nodes of similarity `least` or more: a beam search, then all that links reach among and next to them."""
        at = [self.entry]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = [self.search(q, at, 1, layer)[0][1]]
        found = [i for s, i in self.search(q, at, beam, 0) if s >= least]
        seen, todo = set(found), found[:]
        while todo:
            new = [j for j in dict.fromkeys(j for i in todo for j in self.links[0][i]) if j not in seen]
            if not new:
                break
            seen.update(new)
            todo = [j for j, s in zip(new, (self.x[new] @ q).tolist(), strict=True) if s >= least]
            found += todo
        return found

    def audit(self, queries: np.ndarray, least: float, own: bool) -> float:
        """Widens the beam until RECALL of the links of some queries is found by it, or it is the shard; the recall that
        it then has. own: the queries are the shard's vectors, whose matches with themselves don't count."""
        order = np.argsort((np.arange(len(queries)) * 0.6180339887498949) % 1.0, kind="stable")[:AUDITED]
        truth: list[tuple[int, np.ndarray]] = []
        links = 0
        for block in np.array_split(order, max(1, len(order) // 128)):
            for i, near in zip(block.tolist(), queries[block] @ self.x.T >= least, strict=True):
                if own:
                    near[i] = False
                if near.any():
                    truth.append((i, np.flatnonzero(near)))
                    links += len(truth[-1][1])
            if links >= LEAST_LINKS:
                break
        while links:
            share = sum(len(np.intersect1d(t, self.near(queries[i], least, self.beam))) for i, t in truth) / links
            if share >= RECALL or self.beam >= len(self.x):
                return share
            self.beam *= 2
        return 1.0


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1. They are scaled by their largest component first, so that no square vanishes or overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def index_shard(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """One shard as one row: its audited graph, and apart from it its vectors, which are what other shards are asked."""
    pdf = pdf.sort_values("rep")
    vectors = unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
    graph = Graph(vectors)
    graph.audit(graph.x, least - 1e-5, own=True)
    asked = pickle.dumps((pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), vectors), protocol=5)
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "graph": [pickle.dumps(graph, protocol=5)], "vectors": [asked]})


def smallest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ids that links (a, b) of places reach from each place."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def links_of(graph: Graph, index: tuple, queries: tuple | None, threshold: float) -> pd.DataFrame:
    """(rep, links, root) of every vector linked between an index shard and another, or within the index shard:
    how many rows its links stand for, and the smallest vector of its group among these two shards."""
    ids, weight, vectors = index
    own = queries is None
    q_ids, q_weight, q_vectors = index if own else queries
    asked = q_vectors.astype(np.float32)
    if not own:
        graph.audit(asked, threshold - 1e-5, own=False)
    n, found = len(ids), [np.zeros(0, np.int64)]
    for i, q in enumerate(asked):
        near = np.array(graph.near(q, threshold - 1e-5, graph.beam), np.int64)
        near = near[vectors[near] @ q_vectors[i] >= threshold] if len(near) else near
        if own:  # found from either side, each once
            near = near[near != i]
            found.append(np.minimum(near, i) * n + np.maximum(near, i))
        else:
            found.append(near * len(q_ids) + i)
    a, b = np.divmod(np.unique(np.concatenate(found)), n if own else len(q_ids))
    if not own:
        ids, weight, b = np.concatenate((ids, q_ids)), np.concatenate((weight, q_weight)), b + n
    links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    root, some = smallest(ids, a, b), links > 0
    return pd.DataFrame({"rep": ids[some], "links": links[some].astype(np.int64), "root": root[some]})


def query_shards(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs of shards (graph and vectors of the index, vectors of the queries, null for the shard itself) to links_of()."""
    for pdf in batches:
        for graph, a, b in zip(pdf["graph"], pdf["a"], pdf["b"], strict=True):
            yield links_of(pickle.loads(graph), pickle.loads(a), None if b is None else pickle.loads(b), threshold)
        give_back()


def usable(v: str = "embedding") -> Column:
    """True for a vector without null or non-finite components that isn't zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(v).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of vectors(vec_id, embedding, label).

    Vectors of one label and dimension with a double-precision cosine of at least `threshold` are linked. Equal
    vectors collapse to one first. The others are dealt by hash to shards of about SHARD_ROWS; each shard's graph
    is built in one task, audited against brute force, and queried by every shard of its label and dimension, whose
    queries are audited as well. A task returns counts and its groups' smallest members, not pairs.

    Rows with a null label, vector or vec_id, and vectors that are empty, zero or have a null or non-finite
    component link with nothing: n_links 0, component their own vec_id, kept. Rows that repeat a vec_id count as
    vectors of their own that share a component. Extra columns are ignored.
    """
    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable()
    base = base.withColumn("good", good).withColumn("dim", F.size("embedding"))
    base = base.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "embedding", "label")})
    keyed = base.where("good")
    same = materialize(keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "equal-vectors")
    sizes = keyed.groupBy("label", "dim").agg(F.approx_count_distinct(F.xxhash64("h1", "h2")).alias("rows"))
    sizes = materialize(sizes.select("label", "dim", F.ceil(F.col("rows") / SHARD_ROWS).cast("int").alias("shards")), "label-shards")
    first = keyed.join(same, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"])
    first = materialize(first.select("rep", "n", "label", "dim", F.col("embedding").alias("v")), "distinct-vectors")
    dealt = first.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")).drop("shards")
    shards = dealt.groupBy("label", "dim", "shard").applyInPandas(lambda pdf: index_shard(pdf, threshold), "label string, dim int, shard int, graph binary, vectors binary")
    shards = materialize(shards, "vector-shards")

    # only vectors are sent to the shards that are asked; a task takes a few pairs of shards, one in memory at a time
    x, y = shards.alias("x"), shards.select("label", "dim", "shard", "vectors").alias("y")
    together = (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & F.expr("x.shard <= y.shard")
    keys = shards.groupBy("label", "dim").agg(F.count("*").alias("k")).agg(F.sum(F.expr("k * (k + 1) / 2"))).first()[0] or 0
    pairs = x.join(y, together).select("x.graph", F.col("x.vectors").alias("a"), F.expr("if(x.shard = y.shard, null, y.vectors)").alias("b"))
    pairs = pairs.repartition(int(max(1, min(keys, PAIR_TASKS * vectors.sparkSession.sparkContext.defaultParallelism))))
    with batches_of(vectors.sparkSession, 1):
        found = materialize(pairs.mapInPandas(lambda it: query_shards(it, threshold), "rep long, links long, root long"), "vector-links")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-groups").withColumnRenamed("node", "rep")
    known = same.join(counts, "rep", "left").join(groups, "rep", "left")
    known = materialize(known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-classes")
    linked = keyed.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = base.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
