"""Trees to text. Plain Python; the kernel of the Arrow functions.

Writing gives (depth, text) lines; indentation, or semicolons for minified text, come last.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from treeloom.functions import lexical as lex
from treeloom.functions import trees


#: Comment lines of this form are directives, which minified text keeps.
DIRECTIVE = re.compile(r"#![a-z]+/")


def uniform_fields(items: list) -> list[str] | None:
    """The columns of a list of objects with the same keys and primitive values."""
    if not items or not all(isinstance(x, dict) and x for x in items):
        return None
    fields = list(items[0])
    same = all(x.keys() == items[0].keys() for x in items)
    return fields if same and all(lex.is_primitive(v) for x in items for v in x.values()) else None


class Writer:
    def __init__(self, indent: int = 1, delimiter: str = ",", schemas: dict | None = None, responses: dict | None = None, security: dict | None = None, auto_extract: bool = False):
        self.indent, self.delimiter, self.auto_extract = max(1, indent), delimiter, auto_extract
        self.given = {"s": dict(schemas or {}), "r": dict(responses or {}), "sec": dict(security or {})}
        self.mark = delimiter if delimiter in "\t|" else ""

    def write(self, tree) -> str:
        self.schemas = dict(self.given["s"])
        if self.auto_extract:
            self.schemas |= repeated_schemas(tree, self.schemas)
        self.used: set[str] = set()
        body = "\n".join(" " * (self.indent * d) + t for d, t in self.root(tree))
        kept = {n: b for n, b in self.schemas.items() if not self.auto_extract or n in self.used}
        groups = [[f"{kind}:{name} {self.inline(value)}" for name, value in bodies.items()] for kind, bodies in (("s", kept), ("r", self.given["r"]), ("sec", self.given["sec"])) if bodies]
        return "\n\n".join("\n".join(g) for g in groups) + ("\n" if groups else "") + body

    def root(self, tree) -> Iterator[tuple[int, str]]:
        if isinstance(tree, dict):
            yield from self.object(tree, 0) if tree else [(0, "{}")]
        elif isinstance(tree, list):
            yield from self.array("", tree, 0) if tree else [(0, "[]")]
        else:
            yield 0, lex.write_primitive(tree, self.delimiter)

    def object(self, tree: dict, depth: int, refs: bool = True) -> Iterator[tuple[int, str]]:
        for key, value in tree.items():
            yield from self.field(key, value, depth, depth, depth + 1, refs)

    def field(self, key: str, value, depth: int, rows: int, inside: int, refs: bool, lead: str = "") -> Iterator[tuple[int, str]]:
        """One field at a depth: its array's rows go below rows, its object's fields at inside."""
        name = lead + lex.write_key(key)
        if lex.is_primitive(value):
            yield depth, f"{name}: {lex.write_primitive(value, self.delimiter)}"
        elif not value:
            yield depth, f"{name}: {'{}' if isinstance(value, dict) else '[]'}"
        elif isinstance(value, list):
            yield from self.array(name, value, rows)
        elif refs and (found := self.schema_of(value)):
            yield depth, f"{name}: @s:{found}"
        else:
            yield depth, f"{name}:"
            yield from self.object(value, inside)

    def array(self, name: str, items: list, depth: int) -> Iterator[tuple[int, str]]:
        head = f"{name}[{len(items)}{self.mark}]"
        if all(map(lex.is_primitive, items)):
            yield depth, f"{head}: {self.row(items)}"
            return
        fields = uniform_fields(items)
        if fields:
            layout = next((n for n, b in self.schemas.items() if isinstance(b, dict) and list(b) == fields), None)
            if layout:
                self.used.add(layout)
            yield depth, f"{head}@s:{layout}:" if layout else f"{head}{{{self.delimiter.join(map(lex.write_key, fields))}}}:"
            for item in items:
                yield depth + 1, self.row([item[f] for f in fields])
            return
        yield depth, f"{head}:"
        for item in items:
            yield from self.item(item, depth + 1)

    def row(self, values: list) -> str:
        return f"{self.delimiter} ".join(lex.write_primitive(v, self.delimiter) for v in values)

    def item(self, value, depth: int) -> Iterator[tuple[int, str]]:
        if lex.is_primitive(value):
            yield depth, f"- {lex.write_primitive(value, self.delimiter)}"
        elif not value:
            yield depth, "- {}" if isinstance(value, dict) else "- []"
        elif isinstance(value, list):
            flat = all(map(lex.is_primitive, value))
            yield depth, f"- [{len(value)}{self.mark}]: {self.row(value)}" if flat else f"- {self.inline(value)}"
        elif found := self.schema_of(value):
            yield depth, f"- @s:{found}"
        else:
            (key, first), *others = value.items()
            yield from self.field(key, first, depth, depth, depth + 2, False, "- ")
            for k, v in others:
                yield from self.field(k, v, depth + 1, depth + 1, depth + 2, False)

    def schema_of(self, value: dict) -> str | None:
        found = next((n for n, b in self.schemas.items() if trees.same(b, value) and list(b) == list(value)), None)
        if found:
            self.used.add(found)
        return found

    def inline(self, value) -> str:
        if isinstance(value, dict):
            return "{" + ", ".join(f"{lex.write_key(k)}:{self.inline(v)}" for k, v in value.items()) + "}"
        if isinstance(value, list):
            return "[" + ", ".join(map(self.inline, value)) + "]"
        return lex.write_primitive(value)


def schema_name(path: str) -> str:
    """A name from the last segment of a path that is no index, without words that say nothing."""
    parts = path.strip(".").split(".")
    while parts and re.fullmatch(r"\[[0-9]+\]", parts[-1]):
        parts.pop()
    last = parts[-1] if parts else ""
    for noise in ("properties", "content", "application/json", "schema"):  # fixed values
        last = last.replace(noise, "")
    last = re.sub(r"[^\w.-]", "_", last.strip("."))
    return last or f"auto_{trees.xxh3(path)[-6:]}"


def repeated_schemas(tree, known: dict) -> dict:
    """Objects of two or more keys that occur twice or more, by name."""
    found = {h: e for h, e in trees.index(tree, least_keys=2).items() if e.count >= 2}
    bases = {h: schema_name(e.path) for h, e in found.items()}
    shared = Counter(bases.values())
    out: dict = {}
    for h, e in found.items():
        name = bases[h]
        taken = known | out
        if shared[name] > 1 or (name in known and not trees.same(known[name], e.body)):
            name = f"{name}_{h[:8]}"
            if name in taken and not trees.same(taken[name], e.body):
                name = f"{bases[h]}_{h}"
        out[name] = e.body
    return out


def write(tree, indent: int = 1, delimiter: str = ",", auto_extract: bool = False, **definitions) -> str:
    return Writer(indent, delimiter, auto_extract=auto_extract, **definitions).write(tree)


def write_to(tree, buffer: list[str], **options) -> None:
    """Append the text to a list of strings."""
    buffer.append(write(tree, **options))


def minify(text: str) -> str:
    """One line: semicolons between lines, one more for every scope that closes."""
    from treeloom.functions.reader import find_indent, physical_lines

    step, out, inside, first = find_indent(text), [], 0, True
    for line in physical_lines(text):
        body = lex.strip(line)
        if not body or body[0] == "#":
            if DIRECTIVE.match(body):
                out.append(body + ";")
            continue
        depth = (len(line) - len(line.lstrip(" "))) // step
        if not first:
            out.append(";" * (max(0, inside - depth) + 1))
        out.append(body)
        inside, first = depth + (body.endswith(":") or body.startswith("- ")), False
    return "".join(out)


def expand(text: str, indent: int = 1) -> str:
    """Lines again, indented by at least one blank a level."""
    from treeloom.functions.reader import segments

    return "\n".join(" " * (max(1, indent) * depth) + body for depth, body in segments(text))
