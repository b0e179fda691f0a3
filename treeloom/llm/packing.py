"""Packing documents into fixed-capacity sequences by first-fit decreasing.

Documents are dealt at random (a hash of id, text, input partition, and how many equal rows came
before in it) into groups of about GROUP_DOCS, and every group is packed on its own, so one shuffle suffices, no group depends on another and
groups stay small at any corpus size. Documents longer than the capacity give full pieces
first; the rest of each is one item. Inside a group the items go, longest first, into the
leftmost bin with room, found by descending a tournament tree whose inner nodes hold the
largest room below them: O(log n) an item.

Null text is empty: its document is the single end id. Repeated rows are packed as often as
they occur, and in different groups. Equal rows are interchangeable, so a task that runs again
deals the same rows to the same groups whatever their order. An empty table gives no pieces. Only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import scratch, tokens

CAPACITY = 2048
GROUP_DOCS = 512
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins of equal capacity; finds the leftmost with enough room."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Put an item into the leftmost bin with room: the bin, and its room before."""
        room, node = self.room, 1
        if room[1] < length:
            raise ValueError("an item longer than the capacity")
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        before = room[node]
        room[node] = before - length
        at = node // 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
        return node - self.size, before


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """For each item its bin and its offset there."""
    tree = Tournament(max(1, len(lengths)), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        where, room = tree.place(lengths[i])
        out[i] = where, capacity - room
    return out


def _dealt(hashes: np.ndarray, seen: dict[int, int], part: int, groups: int) -> pa.Array:
    """The group of each row by its hash and the equal rows seen before; seen counts those."""
    before = np.zeros(len(hashes), np.uint64)
    for k, h in enumerate(hashes.tolist()):
        before[k] = seen[h] = seen.get(h, -1) + 1
    mixed = hashes.astype(np.uint64) ^ ((before << np.uint64(24)) + np.uint64(part)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return pa.array(((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64))


def _cut(path: str, capacity: int, groups_of_all: int):
    """Arrow batches of (hash, doc_id, text) to pieces with their ids and group."""

    def run(batches):
        tok = tokens.tokenizer(path)
        narrow, seen, part = tok.narrow, {}, TaskContext.get().partitionId()
        for batch in batches:
            groups, docs = _dealt(batch.column(0).to_numpy(), seen, part, groups_of_all), batch.column(1)
            rows: list[list] = [[], [], [], [], []]
            for i, ids in enumerate(tok.ids(batch.column(2))):
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (i, start, len(piece) // 4, total, np.frombuffer(piece, "<u4").astype("<u2").tobytes() if narrow else piece), strict=True):
                        column.append(value)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [groups.take(at), docs.take(at), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())],
                names=["grp", "doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return run


def _pack_group(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        placed = first_fit_decreasing(table["length"].to_pylist(), capacity)
        bins = np.array([b for b, _ in placed], np.int64) + (key[0].as_py() << 32)
        wide = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(table["ids"].to_pylist(), table["length"].to_pylist(), strict=True)]
        return pa.table({
            "doc_id": table["doc_id"], "start": table["start"], "length": table["length"], "ids": pa.array(wide, pa.binary()), "doc_tokens": table["doc_tokens"],
            "sequence_id": pa.array(bins), "offset": pa.array([o for _, o in placed], pa.int64()),
        })

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their ids (32-bit little-endian), sequence and offset."""
    scratch.bounded_batches(docs.sparkSession, rows=512, megabytes=4)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    groups = max(1, math.ceil(docs.count() / group_docs))
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("hash"), "doc_id", "text")
    pieces = hashed.mapInArrow(_cut(tokenizer or tokens.default_tokenizer(), capacity, groups), "grp long, doc_id long, start long, length long, doc_tokens long, ids binary")
    return pieces.groupBy("grp").applyInArrow(_pack_group(capacity), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
