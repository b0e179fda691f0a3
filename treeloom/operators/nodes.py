"""Trees as node rows: one row per value, joined by parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import udfs

CONTAINERS = ("array", "object")


def explode_nodes(docs: DataFrame, text: str = "text", from_json: bool = False) -> DataFrame:
    """docs' other columns and one row per node, in pre-order within a document."""
    read = udfs.nodes_of_json if from_json else udfs.nodes_of_text
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(*keep, F.explode(read(F.col(text))).alias("_n")).select(*keep, "_n.*")


def is_primitive(kind: Column) -> Column:
    return ~kind.isin(*CONTAINERS)


def as_str() -> Column:
    return F.when(F.col("kind") == "str", F.col("v_str"))


def as_i64() -> Column:
    return F.when(F.col("kind") == "int", F.col("v_int"))


def as_bool() -> Column:
    return F.when(F.col("kind") == "bool", F.col("v_bool"))


def as_f64() -> Column:
    """Doubles, and integers widened."""
    return F.when(F.col("kind") == "float", F.col("v_float")).when(F.col("kind") == "int", F.col("v_int").cast("double"))


def explode_children(docs: DataFrame, text: str = "text", from_json: bool = False) -> DataFrame:
    """explode_nodes' rows below the root, with their parents' kind and path, looked up in the document itself:
    no join, so documents may share a key or have none."""
    read = udfs.nodes_of_json if from_json else udfs.nodes_of_text
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    read_once = docs.select(*keep, read(F.col(text)).alias("_t"))
    up = lambda n: F.get(F.col("_t"), n["parent_id"])  # noqa: E731  a node's id is its place in its document
    both = F.transform("_t", lambda n: F.struct(n.alias("n"), up(n)["kind"].alias("parent_kind"), up(n)["path"].alias("parent_path")))
    found = read_once.select(*keep, F.explode(both).alias("_c")).select(*keep, "_c.n.*", "_c.parent_kind", "_c.parent_path")
    return found.where("parent_id is not null")


def children(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every node with its parent's kind and path, of a table of nodes whose documents have a key each.

    Sizes of nodes are guessed too small by far, so neither side may be sent to the driver.
    """
    up = nodes.select(F.col(key), F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("path").alias("parent_path"))
    return nodes.join(up.hint("merge"), [key, "parent_id"])


def uniform_arrays(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Arrays whose items are objects with one set of keys and primitive values: their tables.

    By two aggregations, of fields to objects and of objects to arrays, without a join; documents have a key each.
    """
    kind, is_object = F.col("kind"), F.col("kind") == "object"
    own = F.struct("kind", "parent_id", F.when(~is_object, F.col("path")).alias("path"), "n_children")
    of = lambda at, own, field, flat: F.struct(at.alias("id"), own.alias("own"), field.alias("field"), flat.alias("flat"))
    as_itself = F.when((kind == "array") | is_object & (F.col("n_children") > 0), of(F.col("node_id"), own, F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    as_field = F.when(F.col("key").isNotNull(), of(F.col("parent_id"), F.when(F.lit(False), own), F.col("key"), is_primitive(kind)))
    parts = nodes.select(key, F.explode(F.array(as_itself, as_field)).alias("_p")).where("_p is not null").select(key, "_p.*")
    read = parts.groupBy(key, "id").agg(F.max("own").alias("own"), F.array_sort(F.collect_set("field")).alias("keys"), F.bool_and("flat").alias("flat")).select(key, "id", "own.*", "keys", "flat")
    members = read.where("kind = 'array' or kind = 'object' and parent_id is not null and size(keys) > 0")
    array = F.when(~is_object, F.struct("path", "n_children"))
    keys = F.when(is_object, F.col("keys"))
    found = members.groupBy(key, F.when(is_object, F.col("parent_id")).otherwise(F.col("id")).alias("array_id")).agg(F.max(array).alias("_a"), F.count(keys).alias("n"), F.min(keys).alias("low"), F.max(keys).alias("high"), F.bool_and("flat").alias("flat"))
    return found.where("n = _a.n_children and low = high and flat").select(key, "_a.path", F.col("_a.n_children").alias("n_rows"), F.col("low").alias("fields"))
