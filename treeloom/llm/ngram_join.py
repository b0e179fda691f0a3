"""N-gram Jaccard join: MinHash bands propose pairs, full shingle sets decide.

Texts are sets of five-word shingles (64-bit hashes). Texts with equal sets are one node, so
copies are never compared. Band and row counts are chosen for a target recall at the threshold.
One shuffle on band hashes groups nodes into buckets; no bucket is written out as pairs:

1. every member of a bucket is checked against the bucket's pivot on full sets; each bucket
   draws its own pivot, so members of a large group meet many of them;
2. components of the verified links are found;
3. buckets whose members are still in several components are compared in full, block by block,
   so every candidate pair is either verified or already joined;
4. inside components, links are counted exactly on full sets, block by block.

Only texts that share a bucket are shuffled, compressed. Links are exact; a pair in no common
bucket and not joined through others is missed with probability at most 1 - TARGET_RECALL.

A text of one to four words is one shingle of what it has. A null text or one without words
links with nothing and is its own class. Rows that repeat an id and text count as copies; a
null id takes part under its class's smallest id, which is null if no other has one. Texts of any
length are compared whole. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import components as cc
from treeloom.llm import tokens
from treeloom.llm.scratch import Scratch, bounded_batches

WORDS = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.999
MOST_HASHES = 144
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WORDS)], np.uint64)


def choose_bands(similarity: float, recall: float = TARGET_RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which few enough bands reach the recall."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding within so many hashes reaches the recall")
    return best


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        mixed += h[k : k + n] * _POWERS[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _signer(bands: int, rows: int):
    rng = np.random.default_rng(5)
    k = bands * rows
    a, b = rng.integers(1, 1 << 32, k, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32)
    fold = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) | 1 for j in range(rows)], np.uint64)

    def sign(s: np.ndarray) -> np.ndarray:
        low = (s >> np.uint64(16)).astype(np.uint32)
        least = np.full(k, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 4096):
            h = np.multiply.outer(a, low[at : at + 4096])
            h += b[:, None]
            h ^= h >> np.uint32(15)
            np.minimum(least, h.min(1), out=least)
        mixed = (least.reshape(bands, rows).astype(np.uint64) * fold[None, :]).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(32)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

    return sign


def _node(s: np.ndarray) -> int | None:
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0]) if len(s) else None


def _sign(bands: int, rows: int):
    sign = _signer(bands, rows)

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in tokens.raw_bytes(b.column(1))]
            node = pa.array([_node(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), node, pa.array([sign(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["doc_id", "content", "node", "bands"])

    return run


def _pack_texts(batches):
    """(node, text) to (node, compressed text), where the text is the node's."""
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        rows = [(n, pack.compress(t)) for n, t in zip(b.column(0).to_pylist(), tokens.raw_bytes(b.column(1)), strict=True) if _node(shingles(t)) == n]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary())], names=["node", "packed"])


def _unpacked(packed: bytes) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(packed))


def _verify(similarity: float):
    def run(batches):
        last, held = None, None
        for b in batches:
            a, node, mine, other = (b.column(i).to_pylist() for i in range(4))
            keep = []
            for k in range(len(a)):
                if a[k] != last:  # rows come by a, mostly
                    last, held = a[k], _unpacked(other[k])
                if similar(held, _unpacked(mine[k]), similarity):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([node[k] for k in keep], pa.int64())], names=["a", "b"])

    return run


def _checked(pairs: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    mine = pairs.join(texts.withColumnRenamed("node", "b").withColumnRenamed("packed", "mine").hint("merge"), "b")
    both = mine.join(texts.withColumnRenamed("node", "a").withColumnRenamed("packed", "other").hint("merge"), "a")
    return scratch.save(both.select("a", "b", "mine", "other").mapInArrow(_verify(similarity), "a long, b long"), "links")


def _adjacency(similarity: float):
    def adjacency(a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Overlaps by matrix products over the shingles that several sets hold."""
        same = a == b
        sets = [_unpacked(x) for x in (a if same else a + b)]
        lengths = np.array([len(s) for s in sets])
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), lengths)
        several = count[code] > 1
        code, row = (np.cumsum(count > 1) - 1)[code[several]], row[several]
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        both = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
            here = slice(*np.searchsorted(code, [at, at + 2048]))
            fill = np.zeros((len(sets), 2048), np.float32)
            fill[row[here], code[here] - at] = 1
            both += fill[: len(a)] @ fill[0 if same else len(a) :].T
        union = lengths[: len(a)][:, None] + lengths[0 if same else len(a) :][None, :] - both
        linked = both >= similarity * union - 1e-6
        if same:  # shingles of a single set are left out above
            np.fill_diagonal(linked, True)
        return linked

    return adjacency


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), n_links."""
    return classes(docs, similarity, recall, doc_id, text).select("doc_id", "class_id", "n_links")


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """near_duplicates with content, a hash of the text, and component, the class's key (null without words)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    bounded_batches(spark)
    bands, rows = choose_bands(similarity, recall)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.withColumn("content", F.xxhash64("text"))
    signed = scratch.save(docs.mapInArrow(_sign(bands, rows), "doc_id long, content long, node long, bands array<long>"), "signed")
    nodes = scratch.save(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min_by("content", F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("content"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")

    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = scratch.save(placed.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot"), "buckets")
    shared = scratch.save(placed.join(buckets.hint("merge"), "bucket"), "shared")

    # A node's text is fetched by its smallest id, null if it has no other, and the hash of the text of that row.
    wanted = shared.select("node").distinct().join(nodes.select("node", F.col("rep").alias("_rep"), F.col("content").alias("_content")), "node")
    by_rep = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("content") == F.col("_content"))).select("node", "text")
    texts = scratch.save(by_rep.mapInArrow(_pack_texts, "node long, packed binary").dropDuplicates(["node"]), "texts")

    stars = shared.where("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    links = _checked(stars, texts, similarity, scratch)
    joined = cc.components(links, scratch)
    rest = _unjoined(shared, joined, scratch)
    if not rest.isEmpty():
        members = rest.join(texts, "node").select(F.col("bucket").alias("component"), "node", F.lit(1).cast("long").alias("weight"), F.col("packed").alias("payload"))
        more = scratch.save(cc.spanning_links(members, _adjacency(similarity), scratch), "more")
        joined = cc.components(links.union(more), scratch)

    members = joined.join(nodes.select("node", "copies"), "node").join(texts, "node").select("component", "node", F.col("copies").alias("weight"), F.col("packed").alias("payload"))
    counts = cc.count_links(members, _adjacency(similarity), scratch)
    known = nodes.select("node", "rep", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = scratch.save(known.groupBy("component").agg(F.min("rep").alias("class_id")), "classes")
    info = scratch.save(known.join(classes.hint("merge"), "component").join(counts, "node", "left").select("node", "component", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "info")
    scratch.keep(signed, info)
    # A node can hold a large share of the rows, so both sides of the last join are plain tables.
    out = signed.select("doc_id", "content", "node").join(info.hint("merge"), "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "content", "component")


def _unjoined(shared: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node) of the buckets whose members are in several components."""
    label = scratch.save(shared.join(joined.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "labelled")
    mixed = label.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    return scratch.save(label.join(scratch.save(mixed, "mixed").hint("merge"), "bucket").select("bucket", "node"), "unjoined")


def keep_one(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each of the classes found: the smallest id's, by hash of text if there are several.

    A row with a null id stays only if its class has no other, and of rows that repeat an id and
    text one stays. Documents without words are in no class, so all of them stay.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    members = scratch.save(found.where("component is not null").select("doc_id", "content", "component"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("content").alias("c"))
    best = scratch.save(members.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").select("component", "best"), "best")
    judged = members.join(best.hint("merge"), "component").groupBy("doc_id", "content").agg(F.max(F.col("best") == order).alias("stays"), F.count("*").alias("n"))
    marks = scratch.save(judged.where("NOT stays OR n > 1"), "marks")
    scratch.keep(marks)
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{doc_id}`").cast("long").alias("_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("_content"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_content") == F.col("content"))
    single = inside.join(marks.select("doc_id", "content"), same, "left_anti")
    again = inside.join(marks.where("stays").select("doc_id", "content"), same, "left_semi").dropDuplicates(["_id", "_content"])
    return single.union(again).select("_doc.*")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
