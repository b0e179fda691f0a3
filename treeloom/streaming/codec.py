"""The codec on streams. Reading and writing keep no state, so batch columns serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions import udfs


def decode_stream(lines: DataFrame, text: str = "value") -> DataFrame:
    """Minified documents, one a line of a stream, to JSON; broken ones give null."""
    return lines.withColumn("json", udfs.decode(F.col(text), permissive=True))


def encode_stream(rows: DataFrame, json_text: str = "json") -> DataFrame:
    return rows.withColumn("text", udfs.minify(udfs.encode(F.col(json_text))))


def count_kinds(stream: DataFrame, at: str, json_text: str = "json", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Nodes by kind in time windows; rows later than the watermark are left out."""
    nodes = stream.select(F.col(at), F.explode(udfs.nodes_of_json(F.col(json_text))).alias("n"))
    return nodes.withWatermark(at, late).groupBy(F.window(at, window), "n.kind").count()
