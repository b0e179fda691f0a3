"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits by random directions; each split sends vectors near its median to both sides
(spill), so close vectors rarely part, and many trees make a miss in all of them unlikely.
Directions and medians are fitted on a bounded sample (SAMPLE vectors at most, by hash). Depth,
spill and number of trees follow from it as well: pairs just at the threshold are made from
sampled vectors towards near ones, and trees are added until RECALL of them share a leaf in
every one of GROUPS parts of the sample by density, the densest included. Every
vector is then routed, leaves are compared by matrix products in double precision, and leaves
that are still large are split on inside their task. Leaves emit only links that join what
the leaf has not joined yet; components of all links are then compared block by block, so
link counts are exact inside every component however large it is.

Equal vectors, told by 128 bits of hash, are one node with a weight, so a vector that a third of
the rows repeat is routed and compared once.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Components
may be as small or large as doubles go. Vectors of another length than most are compared among
their own length. Repeated vec_ids are kept as rows; ids must be unique for counts to be
meaningful. Empty tables give empty results. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import components as cc
from treeloom.llm.scratch import Scratch, bounded_batches

COSINE = 0.9
#: Share of pairs at the threshold that meet in a leaf, in the part of the sample where fewest do.
RECALL = 0.99
LEAF = 512
#: Vectors of a leaf that are compared without further splits.
LEAF_MOST = 8192
SPILLS = (0.06, 0.12, 0.2)
SAMPLE = 32_768
#: Sampled vectors with made-up partners, partners of each, neighbours they lie towards, parts by density.
PROBES, PARTNERS, NEAR, GROUPS = 1024, 16, 64, 16
#: Trees of each spill that the choice is made by; products of two vectors that cost as much as moving one.
TRIALS, ROW_COST = 4, 1024
#: Sampled vectors a split needs at least.
SPLIT_LEAST = 16


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of tiny or huge components would be 0 or infinite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Tree:
    """Heap-ordered splits: direction, lower and upper bound of the band that goes both ways."""

    def __init__(self, depth: int, directions: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.depth, self.directions, self.low, self.high = depth, directions, low, high

    @staticmethod
    def fit(sample: np.ndarray, depth: int, spill: float, rng: np.random.Generator) -> Tree:
        size = (1 << depth) - 1
        directions = rng.standard_normal((size, sample.shape[1])).astype(np.float32)
        low, high = np.zeros(size), np.zeros(size)
        held = {0: np.arange(len(sample))}
        for node in range(size):
            rows = held.pop(node)
            if len(rows) >= SPLIT_LEAST:
                at = sample[rows] @ directions[node]
                low[node], high[node] = np.quantile(at, [0.5 - spill / 2, 0.5 + spill / 2])
                middle = np.median(at)
                left, right = rows[at < middle], rows[at >= middle]
            else:
                left = right = rows[:0]
            held[2 * node + 1], held[2 * node + 2] = left, right
        return Tree(depth, directions, low, high)

    def levels(self, v: np.ndarray):
        """(row, node) of every place a vector reaches, level by level."""
        rows, nodes = np.arange(len(v)), np.zeros(len(v), np.int64)
        yield rows, nodes
        for _ in range(self.depth):
            at = np.einsum("ij,ij->i", v[rows], self.directions[nodes])
            left, right = at <= self.high[nodes], at >= self.low[nodes]
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
            yield rows, nodes

    def leaves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every place a vector reaches."""
        *_, last = self.levels(v)
        return last

    def meet(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each x shares a node with its y, a row for every level."""
        out = np.zeros((self.depth + 1, len(x)), bool)
        for level, ((rx, nx), (ry, ny)) in enumerate(zip(self.levels(x), self.levels(y), strict=True)):
            out[level, rx[np.isin((rx << 32) | nx, (ry << 32) | ny)]] = True
        return out


def probes(sample: np.ndarray, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, group): sampled vectors, partners just at the threshold, parts by density of x.

    A partner lies towards a near vector of the sample, so it differs from x as vectors there do.
    """
    chosen = rng.choice(len(sample), min(PROBES, len(sample)), replace=False)
    near = min(NEAR, len(sample) - 1)
    towards, density = [], []
    for k in range(0, len(chosen), 128):
        like = sample[chosen[k : k + 128]] @ sample.T
        like[np.arange(len(like)), chosen[k : k + 128]] = -2
        best = np.argpartition(-like, near - 1, 1)[:, :near]
        density.append(np.take_along_axis(like, best, 1).min(1))
        towards.append(np.take_along_axis(best, rng.integers(0, near, (len(like), PARTNERS)), 1))
    x = np.repeat(sample[chosen], PARTNERS, 0)
    z = sample[np.concatenate(towards).ravel()]
    off = z - np.einsum("ij,ij->i", z, x)[:, None] * x
    same = np.linalg.norm(off, axis=1) < 1e-6
    off[same] = rng.standard_normal((int(same.sum()), x.shape[1]))
    off[same] -= np.einsum("ij,ij->i", off[same], x[same])[:, None] * x[same]
    rank = np.argsort(np.argsort(np.concatenate(density), kind="stable"), kind="stable")
    return x, cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * unit(off), np.repeat(rank * GROUPS // len(chosen), PARTNERS)


def forest(sample: np.ndarray, total: int, cosine: float, recall: float, rng: np.random.Generator) -> tuple[list[Tree], float]:
    """Trees, as many as the sample's hardest part needs for the recall, and their spill."""
    deepest = max(0, min(math.ceil(math.log2(max(1, total / LEAF))), int(math.log2(max(1, len(sample) / SPLIT_LEAST)))))
    if not deepest or sample.shape[1] < 2:
        return [Tree.fit(sample, 0, 0.0, rng)], SPILLS[0]
    x, y, group = probes(sample, cosine, rng)
    size = np.bincount(group, minlength=GROUPS)  # a sample that is split has 2 * SPLIT_LEAST vectors at least, so no part is empty
    share = lambda met: np.bincount(group, met, GROUPS) / size
    best = None
    for spill in SPILLS:
        met = np.mean([Tree.fit(sample, deepest, spill, rng).meet(x, y) for _ in range(TRIALS)], 0)
        for depth in range(deepest + 1):
            within = total * ((1 + spill) / 2) ** depth
            if within > LEAF_MOST and depth < deepest:
                continue  # a task's own splits move no rows but make few, large tasks
            # What a task splits on is lost as often as in the last level.
            more = max(0, math.ceil(math.log2(within / LEAF_MOST)))
            lost = share(met[depth]) / np.maximum(share(met[depth - 1]), 1e-9) if depth else np.full(GROUPS, 0.5)
            least = float((share(met[depth]) * np.minimum(1, lost) ** more).min())
            if least > 0:
                trees = 1 if least >= recall else math.log(1 - recall) / math.log(1 - least)
                cost = trees * (1 + spill) ** depth * (ROW_COST + min(within, LEAF_MOST) * (1 + spill) ** more)
                if best is None or cost < best[0]:
                    best = cost, spill, depth, np.minimum(1, lost)[group] ** more
    if best is None:  # no made-up pair met in some part
        raise ValueError(f"no spill of {SPILLS} lets pairs at the threshold meet at depth {deepest}")
    _, spill, depth, kept = best
    trees, missed = [], np.ones(len(x))
    while not trees or share(missed).max() > 1 - recall:
        trees.append(Tree.fit(sample, depth, spill, rng))
        missed *= 1 - trees[-1].meet(x, y)[-1] * kept
    return trees, spill


def _leaf_links(ids: np.ndarray, v: np.ndarray, cosine: float, rng: np.random.Generator, spill: float, depth: int = 0) -> list[tuple[int, int]]:
    """Links that span everything linked inside a leaf: each vector to its first linked one."""
    n = len(ids)
    if n > LEAF_MOST and depth < 24:
        at = v @ rng.standard_normal(v.shape[1])
        low, high = np.quantile(at, [0.5 - spill / 2, 0.5 + spill / 2])
        left, right = at <= high, at >= low
        if left.sum() < n and right.sum() < n:
            return _leaf_links(ids[left], v[left], cosine, rng, spill, depth + 1) + _leaf_links(ids[right], v[right], cosine, rng, spill, depth + 1)
    label, out = np.arange(n), []
    for start in range(0, n, LEAF):  # every pair of the leaf, a block of rows at a time
        linked = v[start : start + LEAF] @ v.T >= cosine
        for k in np.flatnonzero(linked.sum(1) > 1):
            i, left = start + int(k), np.flatnonzero(linked[k])
            while len(left := left[label[left] != label[i]]):  # a turn for every join, not every link
                j = left[0]
                out.append((int(ids[i]), int(ids[j])))
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, key: str = "vec_id", embedding: str = "embedding", seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    bounded_batches(spark, rows=4096)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("e"))
    finite = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0)
    hashed = rows.where(usable).select("vec_id", "e", F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(seed), "e").alias("k2"))
    nodes = scratch.save(hashed.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("e").alias("e")), "nodes")
    good = nodes.select(F.col("node").alias("vec_id"), F.col("e").cast("array<double>").alias("e"))
    links = None
    for (width,) in good.groupBy(F.size("e").alias("width")).agg(F.count("*").alias("n")).where("n > 1").select("width").collect():
        found = _forest_links(good.where(F.size("e") == width), width, cosine, recall, seed)
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    component = cc.components(links, scratch)
    members = component.join(nodes, "node").select("component", "node", F.col("copies").alias("weight"), F.col("e").cast("array<double>").alias("payload"))
    packed = members.mapInArrow(_pack_payload, "component long, node long, weight long, payload binary")

    def adjacency(a: list[bytes], b: list[bytes]) -> np.ndarray:
        read = lambda x: unit(np.stack([np.frombuffer(p, np.float64) for p in x]))
        return read(a) @ read(b).T >= cosine

    counts = cc.count_links(packed, adjacency, scratch)
    each = nodes.select("k1", "k2", "node", "copies").join(component, "node", "left").join(counts, "node", "left")
    links_of = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    info = scratch.save(each.select("k1", "k2", links_of, F.coalesce("component", "node").alias("component_id")), "info")
    scratch.keep(info)
    # A node can hold a large share of the rows, so both sides of the last join are plain tables.
    keyed = rows.select("vec_id", F.when(usable, F.xxhash64("e")).alias("k1"), F.when(usable, F.xxhash64(F.lit(seed), "e")).alias("k2"))
    return (
        keyed.join(info.hint("merge"), ["k1", "k2"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _pack_payload(batches):
    for b in batches:
        payload = [np.asarray(x, np.float64).tobytes() for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(payload, pa.binary())], names=["component", "node", "weight", "payload"])


def _forest_links(good: DataFrame, width: int, cosine: float, recall: float, seed: int) -> DataFrame:
    """Links (a, b), at least 1 path between any two vectors that share a leaf and are linked."""
    total = good.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = good.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)).limit(2 * SAMPLE).select("e").toPandas()["e"]
    sample = unit(np.stack(drawn)) if len(drawn) else np.zeros((0, width))
    trees, spill = forest(sample, total, cosine, recall, np.random.default_rng(seed))
    routes = good.sparkSession.sparkContext.broadcast(trees)  # 2^depth directions a tree, at most SAMPLE / SPLIT_LEAST

    def route(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            v, ids = unit(flat), b.column(0).to_numpy()
            with np.errstate(over="ignore"):
                short = flat.astype(np.float32)
            sent = short if (short == flat).all() else flat  # half the bytes, where nothing is lost
            for t, tree in enumerate(routes.value):
                at, leaf = tree.leaves(v)
                if len(np.unique(at)) < len(v):
                    raise ValueError("a vector reaches no leaf")
                for k in range(0, len(at), 4096):
                    part = at[k : k + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), t, np.int32)), pa.array(leaf[k : k + 4096]), pa.array(ids[part]), pa.array([x.tobytes() for x in sent[part]], pa.binary())],
                        names=["tree", "leaf", "vec_id", "e"],
                    )

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        v = unit(np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * width else np.float64) for x in table["e"].to_pylist()]))
        found = _leaf_links(table["vec_id"].to_numpy(), v, cosine, np.random.default_rng([key[0].as_py(), key[1].as_py()]), spill)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    routed = good.select("vec_id", "e").mapInArrow(route, "tree int, leaf long, vec_id long, e binary")
    return routed.groupBy("tree", "leaf").applyInArrow(compare, "a long, b long")


def op6_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
