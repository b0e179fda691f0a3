"""Every query against its SQL; the columns, source, table function and stream."""

import pytest
from oracle import agree
from pyspark.sql import functions as F

import __spark_entry__ as entry
from treeloom.functions import lexical, native, trees, udfs
from treeloom.functions.reader import read
from treeloom.functions.writer import minify, write
from treeloom.operators import nodes, tabular
from treeloom.plans import catalogue
from treeloom.sources.datasource import TreeTextSource
from treeloom.streaming import codec

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    if name in SQL:
        agree(df, SQL[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 25
    assert set(SQL) <= set(entry.queries())


def test_dedup_is_smaller_and_lossless(spark, sf):
    for r in catalogue.dedup_ratio_events(spark, sf).collect():
        assert r["lossless"] and r["dedup_bytes"] < 0.75 * r["json_bytes"]


STRINGS = ["plain", "", "a b", "true", "-x", "5", "a,b", 'q"q', "back\\slash", "semi;colon", "tab\tx", "line\nx", "\u2003edge", "é", "s", "#x", "x|y", "\\n", "nul\x00x", "\\\\\x00\\\\\\n", None]


def test_native_strings_follow_the_kernel(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    for r in df.select("s", native.write_string(F.col("s")).alias("v"), native.write_key(F.col("s")).alias("k"), native.unescape(native.escape(F.col("s"))).alias("u")).collect():
        if r["s"] is not None:
            assert (r["v"], r["k"], r["u"]) == (lexical.write_string(r["s"]), lexical.write_key(r["s"]), r["s"])


def test_native_doubles_follow_the_kernel(spark):
    values = [0.0, -0.0, 1.0, 1.5, 1e7, 123456789.25, 1e15, 1e16, 1.25e17, 1e-3, 1e-4, 1.5e-5, 1e-6, -2.5e-7, float("inf"), float("nan"), 0.1, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", native.write_double(F.col("x")).alias("t")).collect():
        assert r["t"] == lexical.shortest_float(r["x"])


def test_native_minify_follows_the_kernel(spark):
    texts = [write({"a": {"b": {"c": 1}}, "d": [{"x": 1, "y": "p q"}] * 2, "e": [1, {"k": [1]}]}, indent=i) for i in (1, 2)] + ["# note\na: 1\n\nb:\n  c: 2\nd: 3", "", "#!form/1\nx: 1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", native.minify(F.col("t")).alias("m")).collect():
        assert r["m"] == minify(r["t"])


def test_typed_tables_round_trip_with_nulls(spark):
    schema = "id int, ok boolean, x double, s string, b binary, t timestamp_ntz, d date"
    import datetime as dt

    rows = [(1, True, 0.5, "a, b", b"\x01", dt.datetime(2020, 1, 2, 3, 4, 5), dt.date(2020, 1, 2)), (2, None, None, None, None, None, None), (3, False, 1e20, 'q"\\', b"", None, None), (4, None, -1.0, "null", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    for delimiter in (",", "|", "\t"):
        docs = tabular.encode_table(df, "rows", ["id"], delimiter=delimiter).select("text")
        back = tabular.decode_table(docs, df.schema.fields, delimiter=delimiter)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert tabular.encode_table(df.where("id < 0"), "rows", ["id"]).first()["text"] == "rows: []"


def test_arrow_functions(spark):
    tree = {"a": 1, "b": {"c": [1, 2.5, None]}}
    df = spark.createDataFrame([(trees.to_json(tree),), (None,)], "j string")
    got = df.select(udfs.encode(F.col("j")).alias("t"), udfs.tree_hash(F.col("j")).alias("h"), udfs.decode(udfs.encode(F.col("j"), indent=2)).alias("back"), udfs.sort_keys(F.col("j")).alias("k"), udfs.equals(F.col("j"), F.col("j")).alias("e")).collect()
    assert read(got[0]["t"]) == tree and got[0]["h"] == trees.tree_hash(tree) and got[0]["back"] == trees.to_json(tree) and got[0]["e"]
    assert tuple(got[1]) == (None,) * 5
    broken = spark.createDataFrame([('"k" 1: 2\nb: 1',)], "t string")
    assert broken.select(udfs.decode(F.col("t"), permissive=True)).first()[0] is None
    with pytest.raises(Exception, match="Missing colon after key"):
        broken.select(udfs.decode(F.col("t"))).collect()
    index = df.select(udfs.hash_index(F.lit('{"x":{"a":1,"b":2},"y":{"a":1,"b":2}}')).alias("i")).first()["i"]
    assert [(e["count"], e["path"]) for e in index] == [(2, "x")]


def test_depth(spark):
    """Deep trees are read; those beyond the limit are null where broken text may be."""
    deep = lambda n: "\n".join(" " * i + f"k{i}:" for i in range(n)) + "\n" + " " * n + "x: 1"
    df = spark.createDataFrame([(1, deep(700)), (2, deep(12_000)), (3, "a: 1")], "id int, t string").repartition(1)
    out = {r["id"]: r["j"] for r in df.select("id", udfs.decode(F.col("t"), permissive=True).alias("j")).collect()}
    assert out[1].count("{") == 701 and out[2] is None and out[3] == '{"a":1}'


def test_names_whose_digits_agree(spark):
    from treeloom.operators import dedup

    rows = [("a", "12345678ff"), ("a", "1234567800"), ("a", "99999999aa"), ("b", "1234567811")]
    found = dedup.distinct_names(spark.createDataFrame(rows, "base string, hash string"))
    assert sorted(r["name"] for r in found.collect()) == ["a_1234567800", "a_12345678ff", "a_99999999", "b"]


def test_table_function(spark):
    udfs.register(spark)
    spark.createDataFrame([(1, "a: 1\nb[2]: x, y")], "id int, t string").createOrReplaceTempView("docs")
    found = spark.sql("SELECT id, n.path, n.kind FROM docs, LATERAL explode_nodes(t) n ORDER BY n.node_id").collect()
    assert [tuple(r) for r in found] == [(1, "", "object"), (1, "a", "int"), (1, "b", "array"), (1, "b.[0]", "str"), (1, "b.[1]", "str")]
    assert spark.sql("SELECT tree_decode('a: 1')").first()[0] == '{"a":1}'


def test_node_accessors(spark):
    docs = spark.createDataFrame([(1, '{"i":1,"f":1.5,"s":"x","b":true,"n":null}')], "doc_id int, j string")
    n = nodes.explode_nodes(docs, "j", from_json=True).where("key is not null")
    got = {r["key"]: tuple(r)[1:] for r in n.select("key", nodes.as_i64(), nodes.as_f64(), nodes.as_str(), nodes.as_bool(), nodes.is_primitive(F.col("kind"))).collect()}
    assert got == {"i": (1, 1.0, None, None, True), "f": (None, 1.5, None, None, True), "s": (None, None, "x", None, True), "b": (None, None, None, True, True), "n": (None, None, None, None, True)}


def test_data_source(spark, tmp_path):
    spark.dataSource.register(TreeTextSource)
    docs = spark.createDataFrame([("a: 1",), ("b:\n c: x",)], "text string")
    docs.coalesce(1).write.format("treetext").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("treetext").option("as", "json").load(str(tmp_path / "out"))
    assert [r["json"] for r in back.orderBy("seq").collect()] == ['{"a":1}', '{"b":{"c":"x"}}']
    assert spark.read.format("treetext").load(str(tmp_path / "out")).count() == 2
    new = spark.createDataFrame([(f"n: {i}\nt: é",) for i in range(50)], "text string").repartition(3)
    new.write.format("treetext").mode("overwrite").option("separator", "===").save(f"file://{tmp_path}/out")
    again = spark.read.format("treetext").option("separator", "===").option("as", "json").load(f"file://{tmp_path}/out")
    assert sorted(r["json"] for r in again.collect()) == sorted(f'{{"n":{i},"t":"é"}}' for i in range(50))
    broken = spark.createDataFrame([(1,)], "other int")
    with pytest.raises(Exception):
        broken.write.format("treetext").mode("overwrite").save(f"file://{tmp_path}/out")
    assert again.count() == 50  # a write that fails removes nothing


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a: 1\nb:;c: 2\n")
    stream = codec.decode_stream(spark.readStream.text(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r["json"] for r in spark.table("decoded").collect()) == ['{"a":1}', '{"b":{"c":2}}']


def test_parents_without_a_broadcast(spark, tmp_path):
    """Nodes are not sent to the driver, whatever their guessed size; events with one id or none count each."""
    events = [(1, '{"k": 1}'), (1, '{"k": 2}'), (2, '{"k": 3}'), (None, '{"k": 4}')]
    spark.createDataFrame(events, "event_id long, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = catalogue.parent_kinds_events(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("object", "int", 4)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_parents_in_the_document_and_by_join(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":null}]},"[0]":"x"}'), (2, "[[],5]"), (3, "7"), (4, None)], "doc_id int, j string")
    joined = nodes.children(nodes.explode_nodes(docs, "j", from_json=True))
    direct = nodes.explode_children(docs, "j", from_json=True)
    assert set(direct.columns) == set(joined.columns)
    columns = sorted(direct.columns)
    assert sorted(map(str, direct.select(columns).collect())) == sorted(map(str, joined.select(columns).collect()))
    found = {(r["doc_id"], r["path"]): (r["parent_kind"], r["parent_path"]) for r in direct.collect()}
    assert found[1, "a.b.[1].c"] == ("object", "a.b.[1]") and found[1, "a.b.[1]"] == ("array", "a.b") and found[1, "[0]"] == ("object", "") and len(found) == 8
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert direct.count() == 8


def test_uniform_arrays_without_a_join(spark, tmp_path):
    """No side of nodes is sent to the driver; orders without a customer or a status are found as the SQL has them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    orders = {"o_orderkey": [1, 2, 3, 4, 5], "o_custkey": [7, 7, None, None, 8], "o_orderstatus": ["O", None, "F", "P", None]}
    pq.write_table(pa.table(orders, pa.schema([("o_orderkey", pa.int64()), ("o_custkey", pa.int64()), ("o_orderstatus", pa.string())])), tmp_path / "orders.parquet")
    found = catalogue.uniform_arrays_orders(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    agree(found, SQL["uniform_arrays_orders"], str(tmp_path))


def test_uniform_arrays_follow_the_trees(spark):
    texts = [
        '{"a":[{"x":1,"y":null},{"y":"s","x":2.5}],"b":[{"x":1},{"z":1}],"c":[{"x":[1]}],"d":[{"x":1},{}],"e":[{"x":1},5],"f":[],"g":[{}]}',
        '[{"k":true},{"k":false},{"k":null}]', '{"o":{"p":[[{"q":1}],[{"q":1,"r":2},{"q":1}]],"[0]":{"x":1}}}', '{"t":[{"u":[{"v":1},{"v":2}]}]}', '{"x":1}', "7", "[]", None,
        '{"big":[' + ",".join(f'{{"i":{i},"j":"{i}"}}' for i in range(1000)) + "]}",
    ]
    texts = texts * 70  # more than what is read at a time
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, j string").coalesce(1)

    def tables(tree, path=()):
        if isinstance(tree, list) and tree and all(isinstance(v, dict) and v and v.keys() == tree[0].keys() and not any(isinstance(x, (dict, list)) for x in v.values()) for v in tree):
            yield ".".join(path), len(tree), sorted(tree[0])
        for name, v in tree.items() if isinstance(tree, dict) else ((f"[{i}]", v) for i, v in enumerate(tree)) if isinstance(tree, list) else ():
            yield from tables(v, (*path, name))

    want = [(i, *t) for i, s in enumerate(texts) if s is not None for t in tables(trees.from_json(s))]
    got = nodes.uniform_arrays(nodes.explode_nodes(docs, "j", from_json=True))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 70 * 5
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [("doc_id", "int"), ("path", "string"), ("n_rows", "int"), ("fields", "array<string>")]
