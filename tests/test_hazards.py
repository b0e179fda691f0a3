
import math

import pytest

from treeloom.functions import lexical as lex
from treeloom.functions import trees
from treeloom.functions.definitions import Registry
from treeloom.functions.reader import Reader, find_indent, is_minified, read
from treeloom.functions.validation import Validator
from treeloom.functions.writer import expand, minify, schema_name, write


def back(tree, **options):
    return trees.same(read(write(tree, **options), indent=1), tree)


def test_z01_definition_keys():
    assert write({"s": 1}) == '"s": 1' and back({"s": 1, "r": {"a": 1}, "sec": {"sec": 2}})
    assert read("s:x 1\nk: 2") == {"k": 2}


def test_z02_z03_line_ends_and_edges():
    assert write("a\nb") == '"a\\nb"' and back({"a": "x\r\ny", "b": "\u00a0x", "c": "x\u2003"})


def test_z04_z21_nested_arrays():
    assert back({"a": [[[1, {"b": [2]}]], [{"c": 1}], []]})
    assert read("s:R {a: [{x: 1}, [2]]}\nv: @s:R") == {"v": {"a": [{"x": 1}, [2]]}}


def test_z05_z06_minified_and_quoted_nodes():
    found = trees.nodes(read('"k\\n": "v\\t";b: 1'))
    assert [(n["key"], n["v_str"]) for n in found[1:]] == [("k\n", "v\t"), ("b", None)]


def test_z07_references_in_lists():
    assert read("s:X {a: 1}\nl[2]:\n - @s:X\n - @s:Y") == {"l": [{"a": 1}, "@s:Y"]}
    assert read("s:X {a: 1}\nl:\n - @s:X") == {"l": [{"a": 1}]}


def test_z08_z09_rows_and_items():
    assert read("t[1]{a,b}:\n {x: 1, y: 2}, [1, 2]") == {"t": [{"a": {"x": 1, "y": 2}, "b": [1, 2]}]}
    assert read("l[2]:\n - [2]: 1, 2\n - 3") == {"l": [[1, 2], 3]}


def test_z10_minified_test():
    assert is_minified('a: "x;y"') and read('a: "x;y"') == {"a": "x;y"}


def test_z11_to_z16_colons_and_brackets_in_quotes():
    assert back({"a": ["x:y", "z"], "k:1": ["a"], "k[1]": [1], "t": [{"a:b": 1, "c": 2}], "l": ["p:q", {"m": {}}]})
    assert back("root: text") and back("a:b")


def test_z17_first_field_object():
    tree = {"l": [{"first": {"in": 1, "deep": {"x": 2}}, "then": 3}, "x"]}
    assert back(tree)
    assert read("l[1]:\n - first:\n  in: 1\n  then: 3", indent=1) == {"l": [{"first": {"in": 1, "then": 3}}]}


def test_z18_z19_scopes_in_minified_text():
    tree = {"l": [{"a": [{"x": 1}, {"x": 2}], "b": 2}, {"a": []}], "z": 1}
    assert read(minify(write(tree))) == tree
    text = "s:T {x: 1, y: 2}\nr[1]@s:T:\n 3, 4\nz: 5"
    assert read(minify(text)) == read(text) == {"r": [{"x": 3, "y": 4}], "z": 5}


def test_z20_delimiters_are_marked():
    assert write({"v": [1, 2]}, delimiter="|") == "v[2|]: 1| 2" and read("v[2|]: 1| 2") == {"v": [1, 2]}


def test_z22_schema_names():
    assert schema_name("a.b c.[0]") == "b_c" and schema_name("x.{y}") == "_y_" and schema_name("x.properties").startswith("auto_")


def test_z23_z25_z43_definitions():
    shared = {"a": 1, "b": 2}
    text = write({"x": shared, "y": shared, "l": [{"k": 1, "in": shared}, 1]}, auto_extract=True)
    assert text.count("@s:x") == 2 and "\n  in:" in text  # fields of list items are printed in full
    assert write({"v": 1}, schemas={"U": {"a": 1}}, responses={"R": {}}) == "s:U {a:1}\n\nr:R {}\nv: 1"
    assert "s:U" not in write({"v": 1}, schemas={"U": {"a": 1}}, auto_extract=True)


def test_z24_order_counts():
    assert "@s:" not in write({"v": {"b": 1, "a": 2}}, schemas={"U": {"a": 2, "b": 1}}).split("\n")[-1]


def test_z26_forward_references_stay():
    assert read("s:A {x: @s:B}\ns:B {y: 1}\nv: @s:A") == {"v": {"x": "@s:B"}}


def test_z27_z28_registry():
    r = Registry()
    r.register("s", "A", {"x": {"@ref": {"type": "s", "name": "No"}}, "l": [{"@ref": {"type": "s", "name": "No"}}]})
    for _ in range(2):
        with pytest.raises(LookupError, match="Undefined reference: @s:No"):
            r.resolve("s", "A")
    r.register("s", "B", {"l": [{"@ref": {"type": "s", "name": "A"}}]})
    assert r.resolve("s", "B") == {"l": [{"@ref": {"type": "s", "name": "A"}}]}


def test_z29_z30_floats():
    assert write(1e-5) == "0.00001" and write(1e16) == "1e16" and trees.fingerprint(1e16) == "\x0310000000000000000"
    assert write(math.nan) == "NaN" and read("x: NaN") == {"x": "NaN"} and trees.to_json(math.inf) == "null"


def test_z31_fingerprints_join_without_escapes():
    assert trees.fingerprint(["a|\x04b"]) != trees.fingerprint(["a", "b"])  # lengths differ
    assert trees.fingerprint({"a": "1|b:\x042", "c": "3"}) != trees.fingerprint({"a": "1", "b": "2"})


def test_z32_to_z34_lenient_reading():
    assert read("a[1]: 1, 2") == {"a": [1, 2]} and read("a[5]{x}:\n 1") == {"a": [{"x": 1}]} and read("a[n]: 1") == {"a": []}
    assert read('a: "x" tail\nb: {} tail\nc: [] tail') == {"a": "x", "b": {}, "c": []}


def test_z35_unknown_escapes():
    assert lex.unescape("\\é\\q\\\\n") == "\\é\\q\\n"


def test_z36_no_state_between_documents():
    reader = Reader()
    reader.read("s:A {x: 1}\nv: @s:A")
    assert reader.read("v: @s:A") == {"v": "@s:A"}


def test_z37_z38_validator():
    assert Validator("loose", "any").against({}, {"a!": 1})["errors"] == ["Missing required field: a"]
    assert Validator("strict").against({"a!": 1}, {"a!!": 1}) ["errors"] == ["Extra field not in schema: a!"]


def test_z39_lines():
    assert read("a: x\x1cy\r\nb: 1") == {"a": "x\x1cy", "b": 1} and read("a: \u2028x") == {"a": "x"}


def test_z41_z42_rows_and_repeats():
    text = write({"t": [{"x": 1, "y": 2}, {"x": 1, "y": 2}]}, auto_extract=True)
    assert text == "s:t {x:1, y:2}\nt[2]@s:t:\n 1, 2\n 1, 2" and read(minify(text)) == read(text)
    assert read("a: 1\nb: 2\na: 3") == {"a": 3, "b": 2} and list(read("a: 1\nb: 2\na: 3")) == ["a", "b"]


def test_z44_z45_headers_in_lists_and_indent():
    assert read("l:\n - [2]: 1, 2\n - 3") == {"l": [[1, 2], 3]}
    assert expand("a:;b: 1", 0) == "a:\n b: 1" and write({"a": {"b": 1}}, indent=0) == "a:\n b: 1" and find_indent("a:\n    b: 1") == 4
