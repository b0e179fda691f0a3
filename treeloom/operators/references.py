"""References between definitions, resolved by joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """references (ref) with the body each names, or its own text where nothing does."""
    parts = references.withColumn("def_type", F.regexp_extract("ref", r"^@(s|r|sec):", 1)).withColumn("name", F.regexp_extract("ref", r"^@(?:s|r|sec):(\S+)", 1))
    found = parts.join(definitions.select("def_type", "name", "body"), ["def_type", "name"], "left")
    return found.withColumn("resolved", F.coalesce("body", "ref")).drop("body", "def_type", "name")


def upsert(definitions: DataFrame) -> DataFrame:
    """Registrations in order of seq: the last body of a name, in the place of its first."""
    return definitions.groupBy("def_type", "name").agg(F.max_by("body", "seq").alias("body"), F.min("seq").alias("seq"))


def chain(spark, definitions: DataFrame, root_type: str = "s") -> DataFrame:
    """(name, target, depth) of everything a schema reaches through its `target`; a cycle ends
    where a name comes back."""
    view = f"_definitions_{uuid.uuid4().hex}"
    definitions.createOrReplaceTempView(view)
    found = spark.sql(f"""
        WITH RECURSIVE reach(name, target, depth, seen) AS (
            SELECT name, target, 1, array(name) FROM {view} WHERE def_type = '{root_type}' AND target IS NOT NULL
            UNION ALL
            SELECT r.name, d.target, r.depth + 1, concat(r.seen, array(d.name))
            FROM reach r JOIN {view} d ON d.name = r.target AND d.def_type = '{root_type}'
            WHERE d.target IS NOT NULL AND NOT array_contains(r.seen, d.name)
        ) SELECT name, target, depth FROM reach""")
    spark.catalog.dropTempView(view)  # the plan has taken it in
    return found
