"""Differences and checks of flat documents as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that one check may have.
RULES = 10_000


def diff_fields(old: DataFrame, new: DataFrame, key: str, path: str = "path", value: str = "value") -> DataFrame:
    """(key, path, kind, old, new) of the paths of two versions that are not the same."""
    a = old.select(F.col(key), F.col(path).alias("path"), F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = new.select(F.col(key), F.col(path).alias("path"), F.col(value).alias("new"), F.lit(True).alias("_b"))
    both = a.join(b, [key, "path"], "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("kind", kind).where("kind is not null").select(key, "path", "kind", "old", "new")


def missing_required(docs: DataFrame, required: DataFrame, fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name) of required names that a document's fields (key, name) lack.

    required has one row a rule, RULES at most; it is sent to every task.
    """
    rules = [r["name"] for r in required.select("name").limit(RULES + 1).collect()]
    if len(rules) > RULES:
        raise ValueError(f"more than {RULES} rules")
    wanted = docs.select(key).withColumn("name", F.explode(F.array(*map(F.lit, rules)).cast("array<string>")))
    return wanted.join(fields.select(key, "name"), [key, "name"], "left_anti")


def extra_fields(fields: DataFrame, known: list[str], key: str = "doc_id") -> DataFrame:
    return fields.where(~F.col("name").isin(*known)).select(key, "name")
