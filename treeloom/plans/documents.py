"""Queries that build documents from the sample tables and take them through the kernel, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import udfs
from treeloom.operators import nodes

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filled(template: str, **columns: str):
    """A template with the values of columns, as strings, in the places of their names between angle brackets."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.col(column).cast("string"))
    return out


def _sql(template: str, **columns: str) -> str:
    quoted = template.replace("'", "''")
    out = "'" + quoted.replace("\n", "' || chr(10) || '") + "'"
    for name, column in columns.items():
        out = out.replace(f"<{name}>", f"' || {column} || '")
    return out


PART = {"id": "p_partkey", "brand": "p_brand", "size": "p_size"}
MIXED = '{"items":[{"id":<id>,"tags":["a","b"],"sub":{"x":<size>}},<id>,"name",{"id":2}],"last":null}'
MIXED_TEXT = "items[4]:\n - id: <id>\n  tags[2]: a, b\n  sub:\n   x: <size>\n - <id>\n - name\n - id: 2\nlast: null"
DEEP = '{"a":{"b":{"c":<id>,"d":{"e":<size>}}},"f":true}'
TWICE = '{"first":{"type":"string","size":<size>},"second":{"type":"string","size":<size>},"only":{"id":<id>,"x":1}}'
TWICE_TEXT = "s:first {type:string, size:<size>}\nfirst: @s:first\nsecond: @s:first\nonly:\n id: <id>\n x: 1"
NAMED = '{"v":{"a":1,"b":[2,3]},"w":<id>,"list":[{"a":1,"b":[2,3]},<size>]}'
NAMED_TEXT = "s:P {a:1, b:[2, 3]}\nr:Ok {status:200}\nsec:Key {in:header}\nv: @s:P\nw: <id>\nlist[2]:\n - @s:P\n - <size>"
DEFINED = "s:P {a: 1, b: <size>}\nr:Ok {status: 200}\nv: @s:P\nlist[3]:\n - @s:P\n - <id>\n - @s:Q\nrows[2]@s:P:\n 1, <id>\n 3, x\nanswer: @r:Ok\nother: @s:P {b: none}"


def list_items_encode_parts(spark, sf_dir):
    """Lists that are no tables: objects with lists and objects inside, and values, as items."""
    df = _table(spark, sf_dir, "part")
    return df.select("p_partkey", udfs.encode(_filled(MIXED, **PART)).alias("text"))


def list_items_decode_parts(spark, sf_dir):
    df = _table(spark, sf_dir, "part")
    return df.select("p_partkey", udfs.decode(_filled(MIXED_TEXT, **PART)).alias("json"))


def list_items_nodes_parts(spark, sf_dir):
    """The same lists as nodes: path, kind and number of children of all but values."""
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _filled(MIXED_TEXT, **PART).alias("text"))
    return nodes.explode_nodes(df, "text").where("n_children > 0").select("doc_id", "path", "kind", "depth", "n_children")


def encode_with_indent_parts(spark, sf_dir):
    """Levels of four and of no blanks (which means one), appended to a buffer."""
    json = _filled(DEEP, **PART)
    df = _table(spark, sf_dir, "part")
    return df.select("p_partkey", udfs.encode_to(F.lit("# four\n"), json, indent=4).alias("four"), udfs.encode(json, indent=0).alias("one"))


def decode_indents_parts(spark, sf_dir):
    """Indents are found, or given; both read the same tree."""
    wide = "a:\n   b:\n      c: <id>\n      d:\n         e: <size>\nf: true"
    df = _table(spark, sf_dir, "part")
    return df.select("p_partkey", udfs.decode(_filled(wide, **PART)).alias("found"), udfs.decode(_filled(wide, **PART), indent=3).alias("given"))


ROOTS = {"list": ("[2]: <id>, x", "[<id>,\"x\"]"), "number": ("<id>", "<id>"), "string": ("\"a b\"", "\"a b\""), "empty object": ("{}", "{}"), "empty list": ("[]", "[]"), "nothing": ("# note", "{}"),
         "table": ("[1]{k,v}:\n <id>, <size>", "[{\"k\":<id>,\"v\":<size>}]")}


def decode_roots_parts(spark, sf_dir):
    """Documents whose root is no object."""
    texts = F.array(*[F.struct(F.lit(name).alias("root"), _filled(text, **PART).alias("text")) for name, (text, _) in ROOTS.items()])
    df = _table(spark, sf_dir, "part").select("p_partkey", F.explode(texts).alias("r"))
    return df.select("p_partkey", "r.root", udfs.decode(F.col("r.text")).alias("json"))


def extract_repeated_parts(spark, sf_dir):
    """Repeated objects become named definitions, in one line each, and references; and come back."""
    text = udfs.encode_with_dedup(_filled(TWICE, **PART))
    return _table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), udfs.decode(text).alias("json"))


def given_definitions_parts(spark, sf_dir):
    """Definitions given beforehand are printed, schemas first, and referred to where a value equals one."""
    text = udfs.encode(_filled(NAMED, **PART), schemas={"P": {"a": 1, "b": [2, 3]}}, responses={"Ok": {"status": 200}}, security={"Key": {"in": "header"}})
    return _table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def defined_documents_parts(spark, sf_dir):
    """Definitions in a text: references in fields, items, table headers, and with overrides, as trees and nodes."""
    text = _filled(DEFINED, **PART)
    df = _table(spark, sf_dir, "part")
    return df.select("p_partkey", udfs.decode(text).alias("json"), udfs.decode(text, list_references=False).alias("plain_items"), F.size(udfs.nodes_of_text(text)).alias("n_nodes"))


def hash_classes_events(spark, sf_dir):
    """Property objects by their tree hash: how often, and where first."""
    hashed = _table(spark, sf_dir, "events").select("event_id", "props", udfs.tree_hash(F.col("props")).alias("h"))
    return hashed.groupBy("h").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.min("props").alias("props")).select("props", "n", "first_event")


def hash_forms_parts(spark, sf_dir):
    """Hashes and equality ignore the order of keys, but neither types nor values."""
    one, turned = _filled('{"id":<id>,"brand":"<brand>"}', **PART), _filled('{"brand":"<brand>","id":<id>}', **PART)
    typed, other = _filled('{"id":"<id>","brand":"<brand>"}', **PART), _filled('{"id":<id>,"brand":"<brand>","x":null}', **PART)
    df = _table(spark, sf_dir, "part")
    same = lambda b: (udfs.tree_hash(one) == udfs.tree_hash(b)) & (udfs.fingerprint(one) == udfs.fingerprint(b)) & udfs.equals(one, b)
    return df.select("p_partkey", same(turned).alias("turned"), same(typed).alias("typed"), same(other).alias("longer"), F.length(udfs.tree_hash(one)).alias("digits"))


def fingerprints_suppliers(spark, sf_dir):
    """Fingerprints of values carry a tag of their type."""
    df = _table(spark, sf_dir, "supplier")
    return df.select("s_suppkey", udfs.fingerprint(F.col("s_suppkey").cast("string")).alias("whole"), udfs.fingerprint(F.concat(F.lit('"'), "s_name", F.lit('"'))).alias("string"), udfs.fingerprint(F.when(F.col("s_suppkey") % 2 == 0, "true").otherwise("false")).alias("yes"))


def index_orders_by_customer(spark, sf_dir):
    """Each customer's orders as one document: its repeated objects, how often, and the path of the first."""
    one = F.struct("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("o"))
    docs = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("a"))
    json = F.to_json(F.struct(F.transform("a", lambda x: x["o"]).alias("orders")))
    found = docs.select("o_custkey", F.explode(udfs.hash_index(json)).alias("e"))
    return found.select("o_custkey", F.col("e.path").alias("path"), F.col("e.count").alias("n"), F.col("e.body").alias("body"))


def sorted_keys_parts(spark, sf_dir):
    json = _filled('{"z":<id>,"a":[{"y":1,"b":"<brand>"}],"É":1,"Z":{"q":1,"p":<size>}}', **PART)
    return _table(spark, sf_dir, "part").select("p_partkey", udfs.sort_keys(json).alias("json"))


def display_suppliers(spark, sf_dir):
    """Values as people read them."""
    df = _table(spark, sf_dir, "supplier")
    return df.select("s_suppkey", udfs.display(F.concat(F.col("s_suppkey").cast("string"), F.lit(".0"))).alias("float"), udfs.display(F.concat(F.lit('"'), "s_name", F.lit('"'))).alias("string"), udfs.display(F.lit("[1]")).alias("list"), udfs.display(F.lit('{"a":1}')).alias("object"))


def booleans_parts(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.to_json(F.struct((F.col("p_size") > 25).alias("large"))).alias("json"))
    return nodes.explode_nodes(df, "json", from_json=True).where("key = 'large'").select("doc_id", nodes.as_bool().alias("large"))


def registry_parts(spark, sf_dir):
    """Marker objects: a reference, one with overrides, a choice, and a cycle."""
    bodies = '{"A":{"x":{"@ref":{"type":"s","name":"B"}},"y":{"@ref":{"type":"s","name":"B"},"@overrides":{"n":0}},"z":{"@polymorphic":[{"type":"s","name":"B"},{"type":"s","name":"C"}]}},"B":{"n":<id>,"m":[1,2]},"C":{"again":{"@ref":{"type":"s","name":"C"}}}}'
    return _table(spark, sf_dir, "part").select("p_partkey", udfs.resolve(_filled(bodies, **PART), F.lit("A")).alias("json"))


def override_lists_parts(spark, sf_dir):
    """Objects merge, lists are replaced, dotted keys reach inside."""
    base = _filled('{"a":[1,2],"o":{"x":<id>,"y":[1]}}', **PART)
    return _table(spark, sf_dir, "part").select("p_partkey", udfs.override(base, _filled('{"a":[<size>],"o":{"y":[]},"o.z":"<brand>"}', **PART)).alias("json"))


def validate_strict_events(spark, sf_dir):
    """Missing and further fields are errors in strict mode; a list of the mode comes with the result."""
    k = F.col("event_id")
    json = F.to_json(F.struct("event_id", F.when(k % 2 == 0, F.col("event_type")).alias("event_type"), F.when(k % 3 == 0, F.lit(1)).alias("extra")))
    found = _table(spark, sf_dir, "events").select("event_id", udfs.validate_against(json, '{"event_id!": "int", "event_type!": "string"}', "strict").alias("r"))
    return found.select("event_id", F.col("r.valid").alias("valid"), F.array_join("r.errors", "|").alias("errors"), F.col("r.mode").alias("mode"))


def validate_schemas_parts(spark, sf_dir):
    schema = F.when(F.col("p_size") % 2 == 0, F.lit("{}")).otherwise(F.lit('{"a":1}'))
    found = _table(spark, sf_dir, "part").select("p_partkey", udfs.validate_schema(F.col("p_brand"), schema).alias("r"))
    return found.select("p_partkey", F.col("r.valid").alias("valid"), F.array_join("r.warnings", "|").alias("warnings"))


def queries() -> dict[str, Query]:
    named = [
        list_items_encode_parts, list_items_decode_parts, list_items_nodes_parts, encode_with_indent_parts, decode_indents_parts, decode_roots_parts, extract_repeated_parts, given_definitions_parts,
        defined_documents_parts, hash_classes_events, hash_forms_parts, fingerprints_suppliers, index_orders_by_customer, sorted_keys_parts, display_suppliers, booleans_parts, registry_parts,
        override_lists_parts, validate_strict_events, validate_schemas_parts,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    part = lambda template: _sql(template, **PART)
    roots = " UNION ALL ".join(f"SELECT p_partkey, '{name}' AS root, {part(json)} AS json FROM part" for name, (_, json) in ROOTS.items())
    p = '{"a":1,"b":<size>}'
    read = f'{{"v":{p},"list":[{p},<id>,"@s:Q"],"rows":[{{"a":1,"b":<id>}},{{"a":3,"b":"x"}}],"answer":{{"status":200}},"other":{{"a":1,"b":"none"}}}}'
    plain = read.replace(f"[{p},", '[{"@s":"P"},').replace('"@s:Q"', '{"@s":"Q"}')
    return {
        "list_items_encode_parts": f"SELECT p_partkey, {part(MIXED_TEXT)} AS text FROM part",
        "list_items_decode_parts": f"SELECT p_partkey, {part(MIXED)} AS json FROM part",
        "list_items_nodes_parts": """SELECT p_partkey AS doc_id, path, kind, depth, n_children FROM part,
            (VALUES ('', 'object', 0, 2), ('items', 'array', 1, 4), ('items.[0]', 'object', 2, 3), ('items.[0].tags', 'array', 3, 2), ('items.[0].sub', 'object', 3, 1), ('items.[3]', 'object', 2, 1)) v(path, kind, depth, n_children)""",
        "encode_with_indent_parts": "SELECT p_partkey, " + part("# four\na:\n    b:\n        c: <id>\n        d:\n            e: <size>\nf: true") + " AS four, " + part("a:\n b:\n  c: <id>\n  d:\n   e: <size>\nf: true") + " AS one FROM part",
        "decode_indents_parts": f"SELECT p_partkey, {part(DEEP)} AS found, {part(DEEP)} AS given FROM part",
        "decode_roots_parts": roots,
        "extract_repeated_parts": f"SELECT p_partkey, {part(TWICE_TEXT)} AS text, {part(TWICE)} AS json FROM part",
        "given_definitions_parts": "SELECT p_partkey, " + part(NAMED_TEXT.replace("\nr:", "\n\nr:").replace("\nsec:", "\n\nsec:")) + " AS text FROM part",
        "defined_documents_parts": f"SELECT p_partkey, {part(read)} AS json, {part(plain)} AS plain_items, 22 AS n_nodes FROM part",
        "hash_classes_events": "SELECT props, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY props",
        "hash_forms_parts": "SELECT p_partkey, true AS turned, false AS typed, false AS longer, 32 AS digits FROM part",
        "fingerprints_suppliers": "SELECT s_suppkey, chr(2) || s_suppkey AS whole, chr(4) || s_name AS string, chr(1) || CASE WHEN s_suppkey % 2 = 0 THEN chr(1) ELSE chr(0) END AS yes FROM supplier",
        "index_orders_by_customer": """WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' AS body FROM orders)
            SELECT o_custkey, 'orders.[' || min(i) || ']' AS path, count(*) AS n, body FROM o GROUP BY o_custkey, body""",
        "sorted_keys_parts": "SELECT p_partkey, " + part('{"Z":{"p":<size>,"q":1},"a":[{"b":"<brand>","y":1}],"z":<id>,"É":1}') + " AS json FROM part",
        "display_suppliers": "SELECT s_suppkey, s_suppkey || '.0' AS float, s_name AS string, '[Array]' AS list, '[Object]' AS object FROM supplier",
        "booleans_parts": "SELECT p_partkey AS doc_id, p_size > 25 AS large FROM part",
        "registry_parts": "SELECT p_partkey, " + part('{"x":{"n":<id>,"m":[1,2]},"y":{"n":0,"m":[1,2]},"z":{"oneOf":[{"n":<id>,"m":[1,2]},{"again":{"$ref":"#/definitions/C"}}]}}') + " AS json FROM part",
        "override_lists_parts": "SELECT p_partkey, " + part('{"a":[<size>],"o":{"x":<id>,"y":[],"z":"<brand>"}}') + " AS json FROM part",
        "validate_strict_events": """SELECT event_id, event_id % 2 = 0 AND event_id % 3 <> 0 AS valid, concat_ws('|', CASE WHEN event_id % 2 <> 0 THEN 'Missing required field: event_type' END,
            CASE WHEN event_id % 3 = 0 THEN 'Extra field not in schema: extra' END) AS errors, 'strict' AS mode FROM events""",
        "validate_schemas_parts": "SELECT p_partkey, true AS valid, CASE WHEN p_size % 2 = 0 THEN 'Schema ''' || p_brand || ''' is empty' ELSE '' END AS warnings FROM part",
    }
