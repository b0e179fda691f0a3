"""Connected components of links, and exact link counts inside them, without pair tables.

``components`` alternates large-star and small-star steps (Kiveris et al., 2014): edges always
point to a smaller node, and every step is a minimum per node joined back to its edges.
Minima are written out before the join, so both of its sides are plain shuffles that adaptive
execution can split when one node has a large share of the edges.

``count_links`` and ``spanning_links`` cut each group into blocks of about BLOCK members or
BLOCK_BYTES of their contents, and compare blocks in pairs, each in one task of bounded size; only
counts, or joining links, leave a task. Rows moved grow with members times blocks of their
component, and never with pairs of members.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.scratch import Scratch

BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Members of small components that share a task, about.
BIN = 1000


def _point_to_min(edges: DataFrame, scratch: Scratch, both: bool) -> DataFrame:
    """One star step over (u, v) with u > v: large if both directions count as neighbours."""
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = scratch.save(near.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "min")
    joined = near.join(least.hint("merge"), "u")
    if both:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    done = scratch.save(out.where("u > v").distinct(), "edges")
    scratch.drop(least)
    return done


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of links (a, b); component is its smallest node."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        for both in (True, False):
            after = _point_to_min(edges, scratch, both)
            scratch.drop(edges)
            edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return scratch.save(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")


def _deal(members: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """members (component, node, weight, payload) by pairs of blocks; small components share bins."""
    sizes = scratch.save(members.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload").cast("long")).alias("bytes")), "sizes")
    total, heavy = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bins = max(1, total // BIN, heavy // BLOCK_BYTES)
    cut = members.join(sizes.hint("merge"), "component").withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    small = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(True).alias("first"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).cast("int").alias("i"), F.greatest(own, o).cast("int").alias("j"), (own <= o).alias("first")))
    return cut.select(
        "component", "node", "weight", "payload",
        F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array(small))).alias("at"),
        F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins))).alias("bin"),
    ).select("bin", "at.i", "at.j", "at.first", "component", "node", "weight", "payload")


def _parts(key: tuple[pa.Scalar, ...], table: pa.Table):
    """(rows, columns, same) of every comparison of one task."""
    i, j = key[1].as_py(), key[2].as_py()
    if i < 0:
        component = table["component"].to_numpy()
        order = np.argsort(component, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            yield rows, rows, True
    elif i == j:
        yield np.arange(len(table)), np.arange(len(table)), True
    else:
        first = np.array(table["first"].to_pylist(), bool)
        yield np.flatnonzero(first), np.flatnonzero(~first), False


def count_links(members: DataFrame, adjacency: Callable[[list[bytes], list[bytes]], np.ndarray], scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(node, links): for members (component, node, weight, payload), the weights of linked others.

    adjacency compares two lists of payloads and gives a boolean matrix.
    """

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, weight, payload = table["node"].to_numpy(), table["weight"].to_numpy(), table["payload"].to_pylist()
        found = np.zeros(len(node), np.int64)
        for rows, columns, same in _parts(key, table):
            if not len(rows) or not len(columns):
                continue
            linked = adjacency([payload[k] for k in rows], [payload[k] for k in columns])
            if same:
                np.fill_diagonal(linked, False)
            else:
                found[columns] += linked.T @ weight[rows]
            found[rows] += linked @ weight[columns]
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(found)})

    return _deal(members, scratch, block).groupBy("bin", "i", "j").applyInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def spanning_links(members: DataFrame, adjacency: Callable[[list[bytes], list[bytes]], np.ndarray], scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b): links inside the groups of members that join all that is linked there.

    A task emits fewer links than it has members, as it leaves out those that join nothing new.
    """

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, payload = table["node"].to_numpy(), table["payload"].to_pylist()
        a, b = [], []
        for rows, columns, same in _parts(key, table):
            if not len(rows) or not len(columns):
                continue
            linked = adjacency([payload[k] for k in rows], [payload[k] for k in columns])
            if same:
                np.fill_diagonal(linked, False)
            label = np.arange(len(node))
            for r in np.flatnonzero(linked.any(1)):
                i, left = rows[r], columns[linked[r]]
                while len(left := left[label[left] != label[i]]):  # a turn for every join, not every link
                    j = left[0]
                    a.append(int(node[i]))
                    b.append(int(node[j]))
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _deal(members, scratch, block).groupBy("bin", "i", "j").applyInArrow(compare, "a long, b long")
