"""Repeated bodies as named definitions, and references to them, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary(bodies: DataFrame, body: str, order: str, least: int = 2) -> DataFrame:
    """Bodies that occur at least so often: body, n, first (the smallest order), hash (md5)."""
    grouped = bodies.groupBy(F.col(body).alias("body")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return grouped.where(F.col("n") >= least).withColumn("hash", F.md5("body"))


def referenced(bodies: DataFrame, definitions: DataFrame, body: str) -> DataFrame:
    """bodies with what to print: a reference where there is a definition, else the body."""
    names = definitions.select(F.col("body").alias(body), F.concat(F.lit("@s:"), "name").alias("ref"))
    return bodies.join(names, body, "left").withColumn("printed", F.coalesce("ref", body)).drop("ref")


def prune(definitions: DataFrame, references: DataFrame, name: str = "name") -> DataFrame:
    """Definitions that some reference names."""
    return definitions.join(references.select(name), name, "left_semi")


def distinct_names(definitions: DataFrame, base: str = "base", key: str = "hash") -> DataFrame:
    """A name per definition: its base, with eight digits of its hash where several share it, or all of them where those agree."""
    short = F.concat(F.col(base), F.lit("_"), F.substring(key, 1, 8))
    sizes = definitions.groupBy(base).agg(F.count("*").alias("_n"))
    again = definitions.groupBy(short.alias("_short")).agg(F.count("*").alias("_m"))
    both = definitions.withColumn("_short", short).join(sizes, base).join(again, "_short")
    named = F.when(F.col("_n") == 1, F.col(base)).when(F.col("_m") == 1, F.col("_short")).otherwise(F.concat(F.col(base), F.lit("_"), F.col(key)))
    return both.withColumn("name", named).drop("_n", "_m", "_short")


def layout_match(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """For tables (table, fields): the first schema (name, seq, fields) of exactly these fields."""
    first = schemas.groupBy("fields").agg(F.min_by("name", "seq").alias("schema_name"))
    return tables.join(first, "fields", "left")
