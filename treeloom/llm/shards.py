"""Token ids in training order, as shards of fixed-stride binary records.

Each document's ids (ended by the end id) follow one another inside an input partition and
are cut into sequences of SEQUENCE ids; the last of a partition is padded. A cheap scan of text
lengths bounds the sequences of every partition, which gives each sequence a position of its own
without counting tokens first. A keyed Feistel permutation with cycle-walking over all positions
orders them; ranges of that order are shards, and one shuffle takes every sequence to its shard,
whose task writes it in order. Positions that no sequence uses leave no gaps: a sequence's slot
is its rank, the sequences of all earlier shards plus its place in its own. Record k of a shard
starts at byte k * stride of its file, so a reader seeks to any slot and resumes there.

Every shard is written under a name of the attempt and then moved, so a task that runs twice
leaves one file. The manifest, one row a sequence, is a table beside the shards.

Null text is an empty document (its end id alone). An empty table gives no shards. Repeated
rows are written as often as they occur; a null id stays null in the manifest. Extra columns
are ignored. The order depends on how the table's files are split into partitions, and on key. A
partition that was not measured, or gives more sequences than it has positions, is an error.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import tokens
from treeloom.llm.feistel import Permutation
from treeloom.llm.scratch import bounded_batches, shared_dir

SEQUENCE = 2048
#: Bytes of text that go into a shard, on average.
SHARD_TEXT = 64 << 20
#: Ids that a byte of text can give at most, after normalisation.
IDS_PER_BYTE = 6
MANIFEST = "shard_id long, place long, byte_offset long, n_tokens long, doc_ids array<long>, ids_crc32 long, path string"


def _stream(path: str, sequence: int):
    """Sequences of a partition: (ids padded to the sequence, tokens in it, documents in it)."""

    def run(batches):
        tok = tokens.tokenizer(path)
        held, docs = np.zeros(0, "<u4"), []  # docs: (id, tokens of it still to come)
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), tok.ids(b.column(1)), strict=True):
                held = np.concatenate([held, np.frombuffer(ids, "<u4")])
                docs.append([doc, len(ids) // 4])
                at = 0
                while len(held) - at >= sequence:
                    yield held[at : at + sequence], sequence, _take(docs, sequence)
                    at += sequence
                held = held[at:]
        if len(held):
            yield np.pad(held, (0, sequence - len(held))), len(held), _take(docs, len(held))

    return run


def _take(docs: list[list], n: int) -> list[int | None]:
    out = []
    while n:
        out.append(docs[0][0])
        part = min(n, docs[0][1])
        docs[0][1] -= part
        n -= part
        if not docs[0][1]:
            docs.pop(0)
    return out


def _place(path: str, sequence: int, shards: int, first: dict[int, tuple[int, int]], order: Permutation, kind: str):
    """Sequences with their rank in the permuted order, and the shard whose range holds it."""
    stream = _stream(path, sequence)

    def run(batches):
        part = TaskContext.get().partitionId()
        number, end = first.get(part, (0, 0))
        rows: list[tuple] = []

        def batch():
            if number + len(rows) > end:
                raise ValueError(f"partition {part} has more sequences than its {end} positions: it was measured otherwise, or the vocabulary gives more than {IDS_PER_BYTE} ids a byte")
            rank = order.slot(np.arange(number, number + len(rows)))
            return pa.RecordBatch.from_arrays(
                [pa.array(shard_of(rank, order.n, shards)), pa.array(rank), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[0].astype(kind).tobytes() for r in rows], pa.binary())],
                names=["shard_id", "rank", "n_tokens", "doc_ids", "ids"],
            )

        for row in stream(batches):
            rows.append(row)
            if len(rows) == 256:
                yield batch()
                number += len(rows)
                rows = []
        if rows:
            yield batch()

    return run


def shard_of(rank: np.ndarray, n: int, shards: int) -> np.ndarray:
    """Equal ranges of the permuted order."""
    return np.minimum(rank // max(1, -(-n // shards)), shards - 1)


def _write(folder: str, stride: int, width: int):
    """Sorted sequences of whole shards to files, and a manifest row for each."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        out, name, part, now, place = None, None, None, None, 0
        for b in batches:
            rows = []
            for shard_id, n, docs, ids in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if shard_id != now:
                    if out is not None:
                        out.close()
                        store.move(part, name)
                    now, place, name = shard_id, 0, f"{root}/shard-{shard_id:08d}.bin"
                    part = f"{name}.{attempt}.part"
                    out = store.open_output_stream(part)
                out.write(ids)
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")[:n]
                rows.append((shard_id, place, place * stride, n, docs, zlib.crc32(wide.tobytes()), f"{folder}/shard-{shard_id:08d}.bin"))
                place += 1
            yield _manifest(rows)
        if out is not None:
            out.close()
            store.move(part, name)

    return run


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string()]
    names = ["shard_id", "place", "byte_offset", "n_tokens", "doc_ids", "ids_crc32", "path"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def write_shards(
    docs: DataFrame, folder: str, key: int = 1, sequence: int = SEQUENCE, shard_text: int = SHARD_TEXT, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write all documents' ids below folder; the manifest, one row per sequence, by slot.

    folder is a URI that pyarrow can write to from every executor. Ids are little-endian, of 16
    bits where the vocabulary allows it, else of 32.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    bounded_batches(spark, rows=512, megabytes=4)
    path = tokenizer or tokens.default_tokenizer()
    width = 2 if tokens.tokenizer(path).narrow else 4
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    sizes = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    first, total = {}, 0
    for r in sizes:
        bound = -(-(IDS_PER_BYTE * r["bytes"] + r["n"]) // sequence)
        first[r["part"]] = total, total + bound
        total += bound
    shards = max(1, math.ceil(sum(r["bytes"] for r in sizes) / shard_text))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    placed = docs.mapInArrow(_place(path, sequence, shards, first, Permutation(total, key), f"<u{width}"), "shard_id long, rank long, n_tokens long, doc_ids array<long>, ids binary")
    dealt = placed.repartitionById(shards, F.col("shard_id").cast("int")).sortWithinPartitions("shard_id", "rank")
    dealt.mapInArrow(_write(folder, sequence * width, width), MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before, offsets = 0, []
    for r in manifest.groupBy("shard_id").count().orderBy("shard_id").collect():  # one row a shard
        offsets.append((r["shard_id"], before))
        before += r["count"]
    numbered = manifest.join(spark.createDataFrame(offsets, "shard_id long, first_slot long"), "shard_id")
    return numbered.select((F.col("first_slot") + F.col("place")).alias("slot"), "shard_id", "byte_offset", "n_tokens", "doc_ids", "ids_crc32", "path")


def read_slots(folder: str, manifest_rows: list, sequence: int = SEQUENCE, width: int = 2) -> list[np.ndarray]:
    """The ids of manifest rows, each by one seek."""
    from pyarrow import fs

    out = []
    for r in manifest_rows:
        store, path = fs.FileSystem.from_uri(r["path"])
        with store.open_input_file(path) as f:
            f.seek(r["byte_offset"])
            out.append(np.frombuffer(f.read(sequence * width), f"<u{width}").astype("<u4")[: r["n_tokens"]])
    return out


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder).drop("path")
