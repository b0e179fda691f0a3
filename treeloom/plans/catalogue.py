"""Queries over the sample tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import native, udfs
from treeloom.operators import compare, dedup, nodes, references, tabular
from treeloom.plans import documents

Query = Callable[[SparkSession, str], DataFrame]
FLAT_TABLES = {"nation": "n_nationkey", "region": "r_regionkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
#: Rows of one printed table; larger tables become several documents.
CHUNK = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# DuckDB's side of the quoting rules, as expressions over a string.
def _sql_escape(x: str) -> str:
    steps = [("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"), ("';'", "'\\;'")]
    for raw, shown in steps:
        x = f"replace({x}, {raw}, {shown})"
    return x


def _sql_string(x: str) -> str:
    unsafe = r"""[ \t:"\\;@#{}\[\],\n\r]"""
    return f"""CASE WHEN {x} IS NULL THEN 'null' WHEN {x} <> '' AND {x} NOT IN ('true','false','null') AND NOT regexp_matches({x}, '^[0-9+.-]') AND NOT regexp_matches({x}, '{unsafe}') THEN {x} ELSE '"' || {_sql_escape(x)} || '"' END"""


def tab_encode_nation_by_region(spark, sf_dir):
    return tabular.encode_table(table(spark, sf_dir, "nation"), "nations", ["n_nationkey"], ["n_regionkey"])


def tab_roundtrip(name: str, key: str) -> Query:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        fields = df.schema.fields
        chunked = df.withColumn("_chunk", F.floor(F.col(key) / CHUNK))
        return tabular.decode_table(tabular.encode_table(chunked, name, [key], ["_chunk"]), fields).select(*df.columns)

    return run


def tab_encode_orders_by_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return tabular.encode_table(orders, "orders", ["o_orderkey"], ["o_custkey"], "|")


def kv_encode_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", tabular.encode_flat(df).alias("text"))


def list_encode_orders_by_customer(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return lists.select("o_custkey", native.write_inline("orders", F.col("keys"), T.LongType()).alias("text"))


def prim_classify_events_props(spark, sf_dir):
    n = nodes.explode_nodes(table(spark, sf_dir, "events").select("event_id", "props"), "props", from_json=True)
    return n.where("key is not null").select("event_id", "key", "kind", "v_int")


def prim_parse_words(spark, sf_dir):
    """Kinds of the raw pieces that orders' columns would be read from."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")), "o_orderstatus", F.lit("null"), F.lit("true"))).alias("piece"))
    return df.groupBy(native.classify(F.col("piece")).alias("kind")).agg(F.count("*").alias("n"))


def url_quote_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", native.write_string(F.col("url")).alias("quoted"), native.write_key(F.col("url")).alias("as_key"))


def escape_round_trip_documents(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", native.unescape(native.escape(t)).alias("text"))


def minify_nation_doc(spark, sf_dir):
    return tab_encode_nation_by_region(spark, sf_dir).select("n_regionkey", native.minify(F.col("text")).alias("minified"))


def expand_minified(spark, sf_dir):
    short = minify_nation_doc(spark, sf_dir).select("n_regionkey", F.explode(F.array("minified")).alias("minified"))  # a row of its own, apart from the aggregate
    return short.select("n_regionkey", udfs.expand(F.col("minified"), 1).alias("text"))


def decode_minified_nation(spark, sf_dir):
    """Minified text to nodes; the names among them."""
    n = nodes.explode_nodes(minify_nation_doc(spark, sf_dir), "minified")
    return n.where("key = 'n_name'").select("n_regionkey", F.col("v_str").alias("n_name"))


def json_round_trip_events(spark, sf_dir):
    """JSON to text to JSON again."""
    return table(spark, sf_dir, "events").select("event_id", udfs.decode(udfs.encode(F.col("props"))).alias("json"))


def nodes_nation(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    n = nodes.explode_nodes(df.select("n_nationkey", tabular.row_json(df).alias("json")).withColumnRenamed("n_nationkey", "doc_id"), "json", from_json=True)
    return n.where("key is not null").select("doc_id", "node_id", "ord", "key", "kind", F.coalesce(nodes.as_i64().cast("string"), nodes.as_str()).alias("value"))


def node_count_by_kind(spark, sf_dir):
    df = table(spark, sf_dir, "supplier")
    n = nodes.explode_nodes(df.select(F.col("s_suppkey").alias("doc_id"), tabular.row_json(df).alias("json")), "json", from_json=True)
    return n.groupBy("kind").agg(F.count("*").alias("n"), F.sum(nodes.as_f64()).alias("total"))


def uniform_arrays_orders(spark, sf_dir):
    """Orders as a list of objects under each customer: found again as tables of nodes."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.to_json(F.struct(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("orders")), {"ignoreNullFields": "false"}).alias("json"))
    found = nodes.uniform_arrays(nodes.explode_nodes(o, "json", from_json=True))
    return found.select("doc_id", "path", F.col("n_rows").cast("long").alias("n_rows"), F.array_join("fields", "|").alias("fields"))


def parent_kinds_events(spark, sf_dir):
    n = nodes.explode_children(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "props"), "props", from_json=True)
    return n.groupBy("parent_kind", "kind").agg(F.count("*").alias("n"))


def hash_tree_event_props(spark, sf_dir):
    """Repeated objects by their tree hash: the md5 of the first one's text, how often, and where first."""
    hashed = table(spark, sf_dir, "events").select("event_id", "props", udfs.tree_hash(F.col("props")).alias("h"))
    found = hashed.groupBy("h").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.min_by("props", "event_id").alias("props"))
    return found.select(F.md5("props").alias("hash"), "n", "first_event")


def dedup_dictionary_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    words = dedup.dictionary(events, "props", "event_id").withColumn("name", F.concat(F.lit("p_"), F.substring("hash", 1, 8)))
    printed = dedup.referenced(events.select("event_id", "props"), words, "props")
    return printed.select("event_id", "printed")


def prune_orphans_parts(spark, sf_dir):
    """Brands as definitions; those that a part of size 1 names stay."""
    part = table(spark, sf_dir, "part")
    brands = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("body"))
    return dedup.prune(brands, part.where("p_size = 1").select(F.col("p_brand").alias("name")))


def schema_name_collision(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).where("n >= 2")
    named = dedup.distinct_names(names.select(F.col("p_brand").alias("base"), F.md5("p_type").alias("hash"), "n"))
    return named.select("base", "name", "n")


def equals_docs(spark, sf_dir):
    """Documents whose tree equals that of a smaller id: found by hash, confirmed by equality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("text")).alias("json")).withColumn("h", udfs.tree_hash(F.col("json")))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.min_by("json", "doc_id").alias("other"), F.count("*").alias("n")).where("n > 1")
    pairs = docs.join(first, "h").where("doc_id <> first").withColumn("same", udfs.equals(F.col("json"), F.col("other")))
    return pairs.where("same").select("doc_id", F.col("first").alias("equal_to"))


def _fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(key, F.explode(pairs).alias("_f")).select(key, "_f.path", "_f.value")


def diff_customer_versions(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    newer = df.where("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    return compare.diff_fields(_fields(df, "c_custkey", ["c_name", "c_mktsegment"]), _fields(newer, "c_custkey", ["c_name", "c_mktsegment"]), "c_custkey")


def diff_trees_customer(spark, sf_dir):
    """The same comparison, document by document in the kernel."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    old = F.to_json(F.struct("c_custkey", "c_mktsegment"))
    new = F.to_json(F.struct("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")))
    return df.select("c_custkey", F.explode(udfs.diff(old, new)).alias("d")).select("c_custkey", "d.path", "d.kind", "d.old_json", "d.new_json")


def validate_labels_required(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rules = spark.createDataFrame([("quality",), ("toxic",)], "name string")
    fields = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.when(F.col("quality").isNotNull(), "quality"), F.when(F.col("toxic").isNotNull(), "toxic"))).alias("name"))
    return compare.missing_required(docs, rules, fields)


def validate_extra_fields(spark, sf_dir):
    json = F.to_json(F.struct("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.lit(1)).alias("extra")))
    found = table(spark, sf_dir, "events").select("event_id", udfs.validate_against(json, '{"event_id!": "int", "event_type!": "string"}', "warn").alias("r"))
    return found.select("event_id", F.col("r.valid").alias("valid"), F.array_join("r.warnings", "|").alias("warnings"))


def enforce_openapi(spark, sf_dir):
    k = F.col("n_nationkey")
    info = F.struct(F.when(k % 2 == 0, F.lit("t")).alias("title"), F.lit("1").alias("version"))
    json = F.to_json(F.struct(F.lit("3.1").alias("openapi"), info.alias("info"), F.when(k % 3 == 0, F.lit("p")).alias("paths")))
    found = table(spark, sf_dir, "nation").select("n_nationkey", udfs.validate(json, "loose", "openapi:3.1").alias("r"))
    return found.select("n_nationkey", F.col("r.valid").alias("valid"), F.array_join("r.errors", "|").alias("errors"))


def resolve_refs(spark, sf_dir):
    """Nations as references to regions, some undefined."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    refs = nation.select("n_nationkey", F.concat(F.lit("@s:R"), F.col("n_regionkey").cast("string")).alias("ref"))
    known = region.where("r_regionkey <> 3").select(F.lit("s").alias("def_type"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("body"))
    return references.resolve(refs, known).select("n_nationkey", "resolved")


def override_merge(spark, sf_dir):
    base = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    change = F.when(F.col("p_partkey") % 2 == 0, '{"-size":null,"brand":"none"}').otherwise('{"info.note":"x"}')
    return table(spark, sf_dir, "part").select("p_partkey", udfs.override(base, change).alias("json"))


def polymorphic(spark, sf_dir):
    n = F.col("n_regionkey").cast("string")
    text = F.concat(F.lit("s:R0 {x: 0};s:R1 {x: 1};v: @s:R"), n, F.lit(" | @s:R1"))
    return table(spark, sf_dir, "nation").select("n_nationkey", udfs.decode(text).alias("json"))


def reference_chain(spark, sf_dir):
    defs = table(spark, sf_dir, "nation").select(F.lit("s").alias("def_type"), F.col("n_nationkey").cast("string").alias("name"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2).cast("string")).alias("target"))
    return references.chain(spark, defs).select("name", "target", F.col("depth").cast("int").alias("depth"))


def upsert_definitions(spark, sf_dir):
    regs = table(spark, sf_dir, "supplier").select(F.lit("s").alias("def_type"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("name"), F.col("s_name").alias("body"), F.col("s_suppkey").alias("seq"))
    return references.upsert(regs).select("name", "body", "seq")


def layout_match(spark, sf_dir):
    tables = spark.createDataFrame([("a", ["k", "v"]), ("b", ["v", "k"]), ("c", ["z"])], "tab string, fields array<string>")
    schemas = spark.createDataFrame([("First", 1, ["k", "v"]), ("Second", 2, ["k", "v"]), ("Other", 3, ["v", "k"])], "name string, seq int, fields array<string>")
    return dedup.layout_match(tables, schemas).select("tab", "schema_name")


def payload_ratio_by_table(spark, sf_dir):
    """Bytes of a table as JSON documents and as tabular rows."""
    out = None
    for name in ("nation", "region"):
        df = table(spark, sf_dir, name)
        one = df.select(F.lit(name).alias("tab"), F.octet_length(tabular.row_json(df)).cast("long").alias("j"), F.octet_length(native.write_row(df.schema.fields)).cast("long").alias("t"))
        out = one if out is None else out.union(one)
    return out.groupBy("tab").agg(F.sum("j").alias("json_bytes"), F.sum("t").alias("row_bytes"))


def xxh3_docs(spark, sf_dir):
    """Whole documents by their hash: the smallest id with the same one, and its digits."""
    row = F.to_json(F.struct("text", "lang", "source"))
    hashed = table(spark, sf_dir, "documents").select("doc_id", udfs.tree_hash(row).alias("hash"))
    least = hashed.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return hashed.join(least, "hash").select("doc_id", "first", F.length("hash").alias("digits"))


def dedup_ratio_events(spark, sf_dir):
    """Bytes of documents of repeated objects with and without extraction."""
    json = F.to_json(F.struct(*[F.struct(F.lit("string").alias("type"), F.col("event_type").alias("format"), F.lit(True).alias("required")).alias(f"field{i}") for i in range(5)]))
    df = table(spark, sf_dir, "events").select("event_type", json.alias("json")).distinct()
    plain, short = F.octet_length(udfs.encode(F.col("json"))), F.octet_length(udfs.encode_with_dedup(F.col("json")))
    return df.select("event_type", F.octet_length("json").alias("json_bytes"), plain.alias("plain_bytes"), short.alias("dedup_bytes"), (udfs.decode(udfs.encode_with_dedup(F.col("json"))) == F.col("json")).alias("lossless"))


def queries() -> dict[str, Query]:
    named = [
        tab_encode_nation_by_region, tab_encode_orders_by_customer, kv_encode_customer, list_encode_orders_by_customer, prim_classify_events_props, prim_parse_words,
        url_quote_pages, escape_round_trip_documents, minify_nation_doc, expand_minified, decode_minified_nation, json_round_trip_events, nodes_nation, node_count_by_kind,
        uniform_arrays_orders, parent_kinds_events, hash_tree_event_props, dedup_dictionary_events, prune_orphans_parts, schema_name_collision, equals_docs,
        diff_customer_versions, diff_trees_customer, validate_labels_required, validate_extra_fields, enforce_openapi, resolve_refs, override_merge, polymorphic,
        reference_chain, upsert_definitions, layout_match, payload_ratio_by_table, xxh3_docs, dedup_ratio_events,
    ]
    return {f"tab_roundtrip_{name}": tab_roundtrip(name, key) for name, key in FLAT_TABLES.items()} | {f.__name__: f for f in named} | documents.queries()


def oracle_sql() -> dict[str, str]:
    nation_rows = f"string_agg(' ' || n_nationkey || ', ' || {_sql_string('n_name')}, chr(10) ORDER BY n_nationkey)"
    nation_text = f"'nations[' || count(*) || ']{{n_nationkey,n_name}}:' || chr(10) || {nation_rows}"
    minified = f"replace(replace({nation_text}, ':' || chr(10) || ' ', ':;'), chr(10) || ' ', ';')"
    pipe = _sql_string("o_orderpriority").replace(r"\[\],", r"\[\]|")
    status = _sql_string("o_orderstatus").replace(r"\[\],", r"\[\]|")
    return documents.oracle_sql() | {f"tab_roundtrip_{name}": f"SELECT * FROM {name}" for name in FLAT_TABLES} | {
        "tab_encode_nation_by_region": f"SELECT n_regionkey, count(*) AS n_rows, {nation_text} AS text FROM nation GROUP BY n_regionkey",
        "tab_encode_orders_by_customer": f"""SELECT o_custkey, count(*) AS n_rows, 'orders[' || count(*) || '|]{{o_orderkey|o_orderstatus|o_totalprice|o_orderpriority}}:' || chr(10) ||
            string_agg(' ' || o_orderkey || '| ' || {status} || '| ' || o_totalprice || '| ' || {pipe}, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey""",
        "kv_encode_customer": f"""SELECT c_custkey, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || {_sql_string('c_name')} || chr(10) || 'c_nationkey: ' || c_nationkey || chr(10) ||
            'c_acctbal: ' || c_acctbal || chr(10) || 'c_mktsegment: ' || {_sql_string('c_mktsegment')} AS text FROM customer""",
        "list_encode_orders_by_customer": "SELECT o_custkey, 'orders[' || count(*) || ']: ' || string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey",
        "prim_classify_events_props": "SELECT event_id, 'k' AS key, 'int' AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS v_int FROM events",
        "prim_parse_words": "SELECT * FROM (SELECT 'int' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'str', 2 * count(*) FROM orders UNION ALL SELECT 'float', count(*) FROM orders UNION ALL SELECT 'null', count(*) FROM orders UNION ALL SELECT 'bool', count(*) FROM orders)",
        "url_quote_pages": f"""SELECT page_id, {_sql_string('url')} AS quoted, CASE WHEN regexp_matches(url, '[ \\t:"\\\\;@#{{}}\\[\\],]') OR url = '' THEN '"' || {_sql_escape('url')} || '"' ELSE url END AS as_key FROM pages""",
        "escape_round_trip_documents": "SELECT doc_id, text FROM documents",
        "minify_nation_doc": f"SELECT n_regionkey, {minified} AS minified FROM nation GROUP BY n_regionkey",
        "expand_minified": f"SELECT n_regionkey, {nation_text} AS text FROM nation GROUP BY n_regionkey",
        "decode_minified_nation": "SELECT n_regionkey, n_name FROM nation",
        "json_round_trip_events": "SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS json FROM events",
        "nodes_nation": """SELECT n_nationkey AS doc_id, 1 AS node_id, 0 AS ord, 'n_nationkey' AS key, 'int' AS kind, n_nationkey::VARCHAR AS value FROM nation
            UNION ALL SELECT n_nationkey, 2, 1, 'n_name', 'str', n_name FROM nation UNION ALL SELECT n_nationkey, 3, 2, 'n_regionkey', 'int', n_regionkey::VARCHAR FROM nation""",
        "node_count_by_kind": """SELECT kind, count(*) AS n, sum(v) AS total FROM (SELECT 'object' AS kind, NULL::DOUBLE AS v FROM supplier UNION ALL SELECT 'int', s_suppkey::DOUBLE FROM supplier UNION ALL SELECT 'str', NULL FROM supplier
            UNION ALL SELECT 'int', s_nationkey::DOUBLE FROM supplier UNION ALL SELECT 'float', s_acctbal FROM supplier) GROUP BY kind""",
        "uniform_arrays_orders": "SELECT o_custkey AS doc_id, 'orders' AS path, count(*) AS n_rows, 'o_orderkey|o_orderstatus' AS fields FROM orders GROUP BY o_custkey",
        "parent_kinds_events": "SELECT 'object' AS parent_kind, 'int' AS kind, count(*) AS n FROM events",
        "hash_tree_event_props": "SELECT md5(props) AS hash, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY props",
        "dedup_dictionary_events": "SELECT e.event_id, CASE WHEN d.n >= 2 THEN '@s:p_' || substr(md5(e.props), 1, 8) ELSE e.props END AS printed FROM events e JOIN (SELECT props, count(*) AS n FROM events GROUP BY props) d ON d.props = e.props",
        "prune_orphans_parts": "SELECT p_brand AS name, min(p_type) AS body FROM part GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size = 1) > 0",
        "schema_name_collision": "WITH d AS (SELECT p_brand AS base, md5(p_type) AS hash, count(*) AS n FROM part GROUP BY p_brand, p_type HAVING count(*) >= 2) SELECT base, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '_' || substr(hash, 1, 8) ELSE base END AS name, n FROM d",
        "equals_docs": "SELECT doc_id, f AS equal_to FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id <> f",
        "diff_customer_versions": """SELECT c_custkey, 'c_name' AS path, 'removed' AS kind, c_name AS old, NULL::VARCHAR AS new FROM customer WHERE c_custkey % 11 = 0
            UNION ALL SELECT c_custkey, 'c_mktsegment', 'removed', c_mktsegment, NULL FROM customer WHERE c_custkey % 11 = 0
            UNION ALL SELECT c_custkey, 'c_mktsegment', 'changed', c_mktsegment, 'CHANGED' FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 = 0 AND c_mktsegment <> 'CHANGED'""",
        "diff_trees_customer": """SELECT c_custkey, 'c_mktsegment' AS path, 'changed' AS kind, '"' || c_mktsegment || '"' AS old_json, '"CHANGED"' AS new_json FROM customer WHERE c_custkey % 7 = 0""",
        "validate_labels_required": "SELECT d.doc_id, n.name FROM documents d CROSS JOIN (VALUES ('quality'), ('toxic')) n(name) LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE CASE n.name WHEN 'quality' THEN l.quality ELSE l.toxic END IS NULL",
        "validate_extra_fields": "SELECT event_id, true AS valid, CASE WHEN event_id % 3 = 0 THEN 'Extra field: extra' ELSE '' END AS warnings FROM events",
        "enforce_openapi": """SELECT n_nationkey, n_nationkey % 6 = 0 AS valid, concat_ws('|', CASE WHEN n_nationkey % 3 <> 0 THEN 'Missing required field per openapi:3.1: paths' END,
            CASE WHEN n_nationkey % 2 <> 0 THEN 'Missing required field per openapi:3.1: info.title' END) AS errors FROM nation""",
        "resolve_refs": "SELECT n_nationkey, coalesce(r_name, '@s:R' || n_regionkey) AS resolved FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 3",
        "override_merge": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '{"id":' || p_partkey || ',"brand":"none"}' ELSE '{"id":' || p_partkey || ',"brand":"' || p_brand || '","size":' || p_size || ',"info":{"note":"x"}}' END AS json FROM part""",
        "polymorphic": """SELECT n_nationkey, '{"v":{"oneOf":[' || CASE WHEN n_regionkey IN (0, 1) THEN '{"x":' || n_regionkey || '},' ELSE '' END || '{"x":1}]}}' AS json FROM nation""",
        "reference_chain": """WITH RECURSIVE d AS (SELECT n_nationkey AS k, n_nationkey // 2 AS t FROM nation WHERE n_nationkey > 0), r(name, target, depth) AS (SELECT k, t, 1 FROM d UNION ALL SELECT r.name, d.t, r.depth + 1 FROM r JOIN d ON d.k = r.target)
            SELECT name::VARCHAR AS name, target::VARCHAR AS target, depth FROM r""",
        "upsert_definitions": "SELECT 'N' || s_nationkey AS name, arg_max(s_name, s_suppkey) AS body, min(s_suppkey) AS seq FROM supplier GROUP BY s_nationkey",
        "xxh3_docs": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang, source) AS first, 32 AS digits FROM documents",
        "dedup_ratio_events": """WITH e AS (SELECT DISTINCT event_type AS t FROM events)
            SELECT t AS event_type, CAST(2 + 4 + strlen(o) * 5 AS INTEGER) AS json_bytes, CAST(5 * (strlen('field0:') + strlen(p)) + 4 AS INTEGER) AS plain_bytes,
                CAST(strlen('s:field0 {type:string, format:' || t || ', required:true}') + 1 + 5 * strlen('field0: @s:field0') + 4 AS INTEGER) AS dedup_bytes, true AS lossless
            FROM (SELECT t, '"field0":{"type":"string","format":"' || t || '","required":true}' AS o, chr(10) || ' type: string' || chr(10) || ' format: ' || t || chr(10) || ' required: true' AS p FROM e)""",
        "layout_match": "SELECT * FROM (VALUES ('a', 'First'), ('b', 'Other'), ('c', NULL)) v(tab, schema_name)",
        "payload_ratio_by_table": f"""SELECT 'nation' AS tab, CAST(sum(strlen('{{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}}')) AS BIGINT) AS json_bytes, CAST(sum(strlen(n_nationkey || ', ' || {_sql_string('n_name')} || ', ' || n_regionkey)) AS BIGINT) AS row_bytes FROM nation
            UNION ALL SELECT 'region', CAST(sum(strlen('{{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}}')) AS BIGINT), CAST(sum(strlen(r_regionkey || ', ' || {_sql_string('r_name')})) AS BIGINT) FROM region""",
    }
