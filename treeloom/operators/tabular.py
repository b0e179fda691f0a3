"""Tables to tabular text and back, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import native


def encode_table(df: DataFrame, name: str, order: list[str], by: list[str] = (), delimiter: str = ",") -> DataFrame:
    """One tabular block for each group of by (or one for all): by columns, n_rows, text.

    Rows are printed where they are; one shuffle on by gathers the printed rows of a group,
    which is one document and has to fit in a task.
    """
    fields = [f for f in df.schema.fields if f.name not in by]
    printed = df.select(*[F.col(f"`{c}`") for c in by], F.struct(*[F.col(f"`{c}`") for c in order], native.write_row(fields, delimiter).alias("_row")).alias("_r"))
    grouped = printed.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.array_sort(F.collect_list("_r")).alias("_rows"), F.count("*").alias("n_rows"))
    body = F.concat(native.header(name, F.col("n_rows"), [f.name for f in fields], delimiter), F.lit("\n "), F.array_join(F.col("_rows._row"), "\n "))
    empty = F.lit(f"{name}: []" if name else "[]")
    return grouped.select(*[F.col(f"`{c}`") for c in by], "n_rows", F.when(F.col("n_rows") > 0, body).otherwise(empty).alias("text"))


def decode_table(docs: DataFrame, fields: list[T.StructField], text: str = "text", delimiter: str = ",") -> DataFrame:
    """Typed rows of documents that are one tabular block: at most the rows its header says,
    missing values null, further ones ignored."""
    lines = F.split(F.col(text), "\n")
    count = F.regexp_extract(F.get(lines, F.lit(0)), r"\[([0-9]+)[\t|]?\]", 1).try_cast("int")
    rows = docs.select(*[c for c in docs.columns if c != text], F.explode(F.slice(lines, F.lit(2), F.coalesce(count, F.lit(0)))).alias("_line"))
    cut = rows.withColumn("_p", F.explode(F.array(native.split_row(F.trim("_line"), delimiter))))
    out = [native.read_primitive(F.get(F.col("_p"), F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(fields)]
    return cut.select(*[c for c in docs.columns if c != text], *out)


def encode_flat(df: DataFrame) -> Column:
    """Each row of a flat frame as a document of its own."""
    return native.write_flat(df.schema.fields)


def row_json(df: DataFrame) -> Column:
    """Each row as JSON, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
