"""The kernel as Arrow functions on columns: text or JSON in, text, JSON, hashes or nodes out."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import trees, validation
from treeloom.functions import writer as w
from treeloom.functions.reader import Reader, read

NODE = T.StructType([
    T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("path", T.StringType()), T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("v_bool", T.BooleanType()), T.StructField("v_int", T.LongType()), T.StructField("v_float", T.DoubleType()), T.StructField("v_str", T.StringType()), T.StructField("n_children", T.IntegerType()),
])
RESULT = T.StructType([
    T.StructField("valid", T.BooleanType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("mode", T.StringType()), T.StructField("enforce", T.StringType()),
])
CHANGE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "kind", "old_json", "new_json")]))
ENTRY = T.ArrayType(T.StructType([T.StructField("hash", T.StringType()), T.StructField("count", T.LongType()), T.StructField("path", T.StringType()), T.StructField("body", T.StringType())]))


#: Levels that the recursive kernel goes down, in whatever process it runs.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Rows of a batch that are Python objects at a time: a tree's nodes take many times the room of its text.
ROWS = 256


def _each(kind: T.DataType, f):
    """An Arrow function that maps rows; null stays null."""

    def run(values: pa.Array) -> pa.Array:
        made = _arrow_type(kind)
        return pa.concat_arrays([pa.array([None if v is None else f(v) for v in values.slice(i, ROWS).to_pylist()], made) for i in range(0, max(1, len(values)), ROWS)])

    return F.arrow_udf(run, kind)


def _pair(kind: T.DataType, f):
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else f(a, b) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], _arrow_type(kind))

    return F.arrow_udf(run, kind)


def encode(json_text: Column, indent: int = 1, delimiter: str = ",", auto_extract: bool = False, schemas: dict | None = None, responses: dict | None = None, security: dict | None = None) -> Column:
    """JSON text to the notation."""
    return _each(T.StringType(), lambda s: w.write(trees.from_json(s), indent, delimiter, auto_extract, schemas=schemas, responses=responses, security=security))(json_text)


def encode_with_dedup(json_text: Column, indent: int = 1) -> Column:
    return encode(json_text, indent, auto_extract=True)


def encode_to(buffer: Column, json_text: Column, **options) -> Column:
    return F.concat(buffer, encode(json_text, **options))


def decode(text: Column, indent: int | None = None, permissive: bool = False, list_references: bool = True) -> Column:
    """The notation to canonical JSON; text that is broken or nested too deep raises, or gives null if permissive.

    Without list_references a list item "@s:x" is an object with that key, as some readers have it.
    """

    def one(s: str):
        try:
            return trees.to_json(Reader(indent, list_references=list_references).read(s))
        except (ValueError, LookupError, RecursionError):
            if permissive:
                return None
            raise

    return _each(T.StringType(), one)(text)


def expand(text: Column, indent: int = 1) -> Column:
    return _each(T.StringType(), lambda s: w.expand(s, indent))(text)


def minify(text: Column) -> Column:
    return _each(T.StringType(), w.minify)(text)


def tree_hash(json_text: Column) -> Column:
    return _each(T.StringType(), lambda s: trees.tree_hash(trees.from_json(s)))(json_text)


def fingerprint(json_text: Column) -> Column:
    return _each(T.StringType(), lambda s: trees.fingerprint(trees.from_json(s)))(json_text)


def sort_keys(json_text: Column) -> Column:
    return _each(T.StringType(), lambda s: trees.to_json(trees.sort_keys(trees.from_json(s))))(json_text)


def display(json_text: Column) -> Column:
    return _each(T.StringType(), lambda s: trees.display(trees.from_json(s)))(json_text)


def equals(a: Column, b: Column) -> Column:
    return _pair(T.BooleanType(), lambda x, y: trees.equals(trees.from_json(x), trees.from_json(y)))(a, b)


def hash_index(json_text: Column, least_keys: int = 2, normalize: bool = False) -> Column:
    rows = lambda s: [{"hash": h, "count": e.count, "path": e.path, "body": trees.to_json(e.body)} for h, e in trees.index(trees.from_json(s), least_keys, normalize=normalize).items()]
    return _each(ENTRY, rows)(json_text)


def diff(a: Column, b: Column) -> Column:
    names = ("path", "kind", "old_json", "new_json")
    return _pair(CHANGE, lambda x, y: [dict(zip(names, c, strict=True)) for c in trees.diff(trees.from_json(x), trees.from_json(y))])(a, b)


def validate(json_text: Column, mode: str = "warn", enforce: str | None = None) -> Column:
    return _each(RESULT, lambda s: validation.Validator(mode, enforce).validate(trees.from_json(s)))(json_text)


def validate_against(json_text: Column, schema: str, mode: str = "warn", enforce: str | None = None) -> Column:
    known = trees.from_json(schema)
    return _each(RESULT, lambda s: validation.Validator(mode, enforce).against(trees.from_json(s), known))(json_text)


def validate_schema(name: Column, schema_json: Column, mode: str = "warn", enforce: str | None = None) -> Column:
    return _pair(RESULT, lambda n, s: validation.Validator(mode, enforce).validate_schema(n, trees.from_json(s)))(name, schema_json)


def nodes_of_json(json_text: Column) -> Column:
    return _each(T.ArrayType(NODE), lambda s: trees.nodes(trees.from_json(s)))(json_text)


def nodes_of_text(text: Column) -> Column:
    return _each(T.ArrayType(NODE), lambda s: trees.nodes(read(s)))(text)


def resolve(registry_json: Column, name: Column) -> Column:
    """A named schema of a registry (JSON object of bodies), with its references resolved."""
    from treeloom.functions.definitions import Registry

    def one(bodies: str, want: str) -> str | None:
        r = Registry()
        for k, v in trees.from_json(bodies).items():
            r.register("s", k, v)
        return trees.to_json(r.resolve("s", want)) if r.has("s", want) else None

    return _pair(T.StringType(), one)(registry_json, name)


def override(base_json: Column, changes_json: Column) -> Column:
    from treeloom.functions import definitions

    return _pair(T.StringType(), lambda b, c: trees.to_json(definitions.override(trees.from_json(b), trees.from_json(c))))(base_json, changes_json)


def register(spark: SparkSession) -> None:
    """The functions by name for SQL, and explode_nodes(text) as a table function."""
    for name, f in {"tree_decode": decode, "tree_encode": encode, "tree_encode_dedup": encode_with_dedup, "tree_minify": minify, "tree_expand": expand, "tree_hash": tree_hash}.items():
        spark.udf.register(name, _sql(f))

    class ExplodeNodes:
        def eval(self, text: str):
            for n in trees.nodes(read(text)) if text is not None else ():
                yield tuple(n[f.name] for f in NODE.fields)

    spark.udtf.register("explode_nodes", F.udtf(ExplodeNodes, returnType=NODE))


def _sql(f):
    plain = {decode: lambda s: trees.to_json(read(s)), encode: lambda s: w.write(trees.from_json(s)), encode_with_dedup: lambda s: w.write(trees.from_json(s), auto_extract=True), minify: w.minify, expand: w.expand, tree_hash: lambda s: trees.tree_hash(trees.from_json(s))}[f]
    return _each(T.StringType(), plain)
