"""The plain-Python kernel: round trips, references, hashes, differences, checks."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.functions import definitions, lexical, trees
from treeloom.functions.reader import read
from treeloom.functions.validation import Validator
from treeloom.functions.writer import expand, minify, write

CASES = [
    {"null_val": None, "bool_true": True, "bool_false": False, "int_pos": 42, "int_neg": -100, "float_val": 3.14, "str_simple": "hello", "str_empty": "", "str_special": "a b & c"},
    {"level1": {"level2": {"value": "deep"}}},
    {"tags": ["a", "b", "c"]},
    {"items": [{"id": 1, "name": "x"}, {"id": 2, "name": "y"}, {"id": 3, "name": "z"}]},
    {"empty_obj": {}, "empty_arr": []},
    {"sites": [{"areas": [{"description": "d", "tags": ["t"]}, {"description": "e", "tags": ["u", "v"]}], "equipmentLevel": "Site", "id": "S1"}]},
    {"z": 1, "a": 2, "m": 3},
    {"feature_flags": [{"flag_name": "f", "targeting_rules": [{"attribute": "a", "operator": "in", "values": ["x"]}, {"attribute": "b", "operator": "is", "value": "y"}]}]},
    {"s": 1, "r": {"x": 2}, "sec": [1]},
    {"text": "a\nb", "cr": "a\rb", "edge": "\u2003x", "colon": ["a:b", "c"], "semi": "a;b"},
    {"deep": [[{"a": 1}, [2]], [1, 2], []], "k:y": [1, 2], "k[0]": [{"a b": 1, "c,d": 2}]},
    {"list": ["x:y", {"first": {"in": 1}, "then": 2}, {"first": [1, 2], "then": {"q": {}}}]},
    [1, 2, 3], [{"a": 1}, {"a": 2}], [], {}, "plain", "with: colon", 5, 2.5, None, True, "@s:not", "{odd", "- dash",
]


@pytest.mark.parametrize("tree", CASES)
@pytest.mark.parametrize("indent", [1, 2, 8])
def test_round_trip(tree, indent):
    assert trees.same(read(write(tree, indent=indent), indent=indent), tree)


@pytest.mark.parametrize("delimiter", ["|", "\t"])
def test_delimiters(delimiter):
    tree = {"rows": [{"a": "x,y", "b": "p|q"}, {"a": "1", "b": "2"}], "v": ["a|b", "c\td", 1]}
    assert trees.same(read(write(tree, delimiter=delimiter)), tree)


@pytest.mark.parametrize("tree", [c for c in CASES if isinstance(c, dict) and "list" not in c])
def test_minify_and_expand(tree):
    text = write(tree)
    if "\n" not in text:
        return
    assert trees.same(read(minify(text)), tree)
    assert trees.same(read(expand(minify(text), 2)), tree)
    assert "\n" not in minify(text)


scalar = st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 63) - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12)
tree_of = st.recursive(scalar, lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=6), inner, max_size=4), max_leaves=16)


@settings(max_examples=400, deadline=None)
@given(tree_of)
def test_any_tree_round_trips(tree):
    back = read(write(tree), indent=1)
    assert trees.same(back, tree) or (isinstance(tree, float) and back == tree)


@settings(max_examples=200, deadline=None)
@given(tree_of)
def test_any_tree_round_trips_with_extraction(tree):
    assert trees.same(read(write(tree, auto_extract=True), indent=1), tree)


def test_definitions_and_references():
    text = "s:Email {type: string, format: email}\nuser:\n email: @s:Email"
    assert read(text) == {"user": {"email": {"type": "string", "format": "email"}}}
    text = "s:Base {type: string, required: true}\nfield: @s:Base {required: false}"
    assert read(text) == {"field": {"type": "string", "required": False}}
    assert read("field: @s:NonExistent") == {"field": "@s:NonExistent"}
    assert read("r:Success {status: 200, body: ok}\nx: @r:Success") == {"x": {"status": 200, "body": "ok"}}
    assert read("s:A {x: 1}\nv: @s:A | @s:B") == {"v": {"oneOf": [{"x": 1}]}}
    assert read("s:R {a: [1, 2]}\nlist[2]:\n - @s:R\n - @s:R") == {"list": [{"a": [1, 2]}, {"a": [1, 2]}]}


def test_schema_as_header():
    text = 's:Sensor {sensorType: string, value: number, unit: string}\nreadings[2]@s:Sensor:\n temp, 22.5, "°C"\n hum, 40, pct'
    assert read(text)["readings"] == [{"sensorType": "temp", "value": 22.5, "unit": "°C"}, {"sensorType": "hum", "value": 40, "unit": "pct"}]
    assert read(minify(text)) == read(text)
    with pytest.raises(LookupError):
        read("readings[2]@s:None:\n a, b\n c, d")
    rows = {"readings": [{"sensorType": "t", "value": 1.5, "unit": "C"}, {"sensorType": "h", "value": 2.5, "unit": "P"}]}
    schema = {"sensorType": "string", "value": "number", "unit": "string"}
    assert "@s:Sensor:" in write(rows, schemas={"Sensor": schema})
    assert "@s:" not in write(rows, schemas={"Sensor": dict(reversed(schema.items()))}).split("\n", 1)[1]


def test_repeated_objects_become_schemas():
    shared = {"type": "string", "format": "email"}
    text = write({f"field{i}": shared for i in range(3)}, auto_extract=True)
    assert text.startswith("s:field0 ") and text.count("@s:field0") == 3
    unique = {"x": {"a": 1}, "y": {"b": 1}}
    assert write(unique, auto_extract=True) == write(unique)
    clash = {f"p{i}": {"parameters": {"a": i % 2, "b": 1}} for i in range(4)}
    text = write(clash, auto_extract=True)
    assert text.count("s:parameters_") >= 2 and read(text) == clash
    assert write(read(text), auto_extract=True) == text


def test_reading_hazards():
    assert read("k[1]: a, b") == {"k": ["a", "b"]}
    assert read("k[x]:\n - 1") == {"k": []}
    assert read("k[3]{a,b}:\n 1\n 2, 3, 4") == {"k": [{"a": 1, "b": None}, {"a": 2, "b": 3}]}
    assert read("k[1]{a}:\n 1\n 2") == {"k": [{"a": 1}]}
    assert read("a:\n   stray: 1\n b: 2\nno colon here\nc: 3", indent=1) == {"a": {"b": 2}, "c": 3}
    assert read("a: 1\na: 2") == {"a": 2}
    assert read("# note\n@@x\n@use y\na: +5\nb: 007\nc: 5abc\nd: .5\ne: 9223372036854775808") == {"a": 5, "b": 7, "c": "5abc", "d": 0.5, "e": 9223372036854775808.0}
    assert read("a:\n - x: 1\n  y: 2\n - z", indent=1) == {"a": [{"x": 1, "y": 2}, "z"]}
    for broken in ('"open: 1\nb: 2', '"k" 1: 2\nb: 1'):
        with pytest.raises(ValueError):
            read(broken)


def test_number_texts():
    assert [lexical.shortest_float(x) for x in (1.0, 1e15, 1e16, 1e-5, 1e-6, 1.5e300, -0.0, 0.1)] == ["1.0", "1000000000000000.0", "1e16", "0.00001", "1e-6", "1.5e300", "-0.0", "0.1"]
    assert [lexical.plain_float(x) for x in (1.0, 1e21, 1e-7, 2.5)] == ["1", "1000000000000000000000", "0.0000001", "2.5"]
    assert [trees.display(x) for x in (1.0, 2.5, True, None, [], {}, "s", 3)] == ["1.0", "2.5", "true", "null", "[Array]", "[Object]", "s", "3"]
    assert read("x: NaN") == {"x": "NaN"} and lexical.write_primitive(math.nan) == "NaN"


def test_hashes():
    assert trees.fingerprint([]) == "d77cc074974195742df3df0fdafd6f87"
    assert trees.fingerprint(1) != trees.fingerprint(1.0) and trees.fingerprint(None) != trees.fingerprint("null")
    assert trees.equals({"a": 1, "b": 2}, {"b": 2, "a": 1}) and not trees.equals({"a": 1}, {"a": 2})
    found = trees.index({"a": {"x": 1, "y": 2}, "b": [{"x": 1, "y": 2}], "c": [[{"x": 1, "y": 2}]]})
    assert [(e.count, e.path) for e in found.values()] == [(2, "a")]
    one, two = ({"f": {"b": 1, "a": 2}}, {"f": {"a": 2, "b": 1}})
    assert trees.hash_tree(one)[0] != trees.hash_tree(two)[0] and trees.hash_tree(one, normalize=True)[0] == trees.hash_tree(two, normalize=True)[0]


def test_diff():
    assert trees.diff({"x": 1}, {"x": 1, "y": 2}) == [("y", "added", None, "2")]
    assert trees.diff({"x": 1, "y": 2}, {"x": 1}) == [("y", "removed", "2", None)]
    assert trees.diff({"o": {"i": 1}}, {"o": {"i": 2}}) == [("o.i", "changed", "1", "2")]
    assert trees.diff([1], [2], "p") == [("p", "changed", "[1]", "[2]")] and trees.diff({"a": 1}, {"a": 1}) == []


def test_registry():
    r = definitions.Registry()
    r.register("s", "User", {"type": "object", "required": True, "info": {"title": "t", "version": 1}})
    assert r.has("s", "User") and not r.has("r", "User")
    assert r.resolve("s", "User", {"-required": None, "info.title": "new", "extra": 1}) == {"type": "object", "info": {"title": "new", "version": 1}, "extra": 1}
    r.register("s", "Loop", {"next": {"@ref": {"type": "s", "name": "Loop"}}})
    assert r.resolve("s", "Loop") == {"next": {"$ref": "#/definitions/Loop"}}
    r.register("s", "Bad", {"x": {"@ref": {"type": "s", "name": "Nope"}}})
    for _ in range(2):
        with pytest.raises(LookupError):
            r.resolve("s", "Bad")
    r.register("s", "Poly", {"x": {"@polymorphic": [{"type": "s", "name": "Loop"}]}})
    assert "oneOf" in r.resolve("s", "Poly")["x"]
    assert r.tabular_fields("s", "User") == ["type", "required", "info"] and r.layout(["next"]) == "Loop"
    r.reset()
    assert not r.get_all("s")


def test_validator():
    schema = {"name!": "string", "age": "number"}
    assert Validator("strict").against({"age": 1}, schema)["errors"] == ["Missing required field: name"]
    assert Validator("warn").against({"name": 1, "x": 1}, schema)["warnings"] == ["Extra field: x"]
    assert Validator("strict").against({"name": 1, "x": 1}, schema)["errors"] == ["Extra field not in schema: x"]
    assert Validator("loose").against({}, schema)["valid"]
    assert Validator("loose", "openapi:3.1").validate({"openapi": "3.1", "info": {"title": "t"}})["errors"] == [
        "Missing required field per openapi:3.1: paths",
        "Missing required field per openapi:3.1: info.version",
    ]
    assert not Validator("strict").validate("text")["valid"] and Validator("warn").validate("text")["warnings"]
    assert Validator("strict").validate_schema("S", {})["errors"] == ["Schema 'S' is empty"]
    assert Validator("warn", "x").validate({})["enforce"] == "x"
