"""Text to trees. Plain Python; the kernel of the Arrow functions.

Lines first become a tree by depth (a line's parent is the last shallower one), then every
line is read together with its children. Indented and minified text differ only in how a
line gets its depth.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from treeloom.functions import lexical as lex
from treeloom.functions.definitions import Registry

_SEGMENT = re.compile(r'((?:"(?:[^"\\]|\\.)*"|[^;"]|"(?=[^"]*$))*)(;*)', re.S)
_DEFINITION = re.compile(r"(s|r|sec):(\S*)\s*(.*)", re.S)


@dataclass
class Line:
    depth: int
    text: str
    children: list[Line] = field(default_factory=list)


def is_minified(text: str) -> bool:
    return "\n" not in text and ";" in text


def physical_lines(text: str) -> list[str]:
    return [line.removesuffix("\r") for line in text.split("\n")]


def find_indent(text: str) -> int:
    """Blanks of the second line if it is indented, else of the first indented line; else 1."""
    lines = physical_lines(text)
    blanks = lambda s: len(s) - len(s.lstrip(" "))
    if len(lines) > 1 and 0 < blanks(lines[1]) < len(lines[1]) and lines[1].lstrip(" ")[0] not in "\t\r\n\x0c":
        return blanks(lines[1])
    return next((blanks(s) for s in lines if blanks(s) and lex.strip(s) and not lex.strip(s).startswith("#")), 1)


def opens_scope(text: str) -> bool:
    """Whether what follows a minified segment lies inside it."""
    if text.startswith("- "):
        return True
    if not text.endswith(":"):
        return False
    header = lex.read_header(text)
    if header:
        return not header.rest
    try:
        key = lex.read_key(text)
    except ValueError:
        return False
    return bool(key) and not key[1]


def segments(text: str) -> list[tuple[int, str]]:
    """(depth, text) of minified text: n semicolons close n - 1 scopes."""
    out, depth, at = [], 0, 0
    while at < len(text):
        found = _SEGMENT.match(text, at)
        if found.end() == at:
            at += 1
            continue
        at = found.end()
        body = lex.strip(found[1])
        if body:
            out.append((depth, body))
            depth += opens_scope(body)
        depth = max(0, depth - max(0, len(found[2]) - 1))
    return out


def depth_lines(text: str, indent: int | None = None) -> list[tuple[int, str]]:
    if is_minified(text):
        return segments(text)
    step = max(1, indent) if indent is not None else find_indent(text)
    return [((len(s) - len(s.lstrip(" "))) // step, lex.strip(s)) for s in physical_lines(text) if lex.strip(s)]


class Reader:
    """Reads one document; every call starts with an empty registry."""

    def __init__(self, indent: int | None = None, definitions: dict[str, dict] | None = None, list_references: bool = True):
        self.indent, self.given, self.list_references = indent, definitions or {}, list_references

    def read(self, text: str):
        self.registry = Registry()
        for kind, bodies in self.given.items():
            for name, body in bodies.items():
                self.registry.register(kind, name, body)
        root, flat = Line(-1, ""), []
        open_lines = [root]
        for depth, body in depth_lines(text, self.indent):
            if body[0] == "#" or body.startswith(("@@", "@use ")):
                continue
            found = _DEFINITION.match(body)
            if found:
                self.registry.register(found[1], found[2], self.inline(found[3]) if found[3] else {})
                continue
            line = Line(depth, body)
            while open_lines[-1].depth >= depth:
                open_lines.pop()
            open_lines[-1].children.append(line)
            open_lines.append(line)
            flat.append(line)
        if not flat:
            return {}
        first = flat[0].text
        header = lex.read_header(first)
        if header and header.key is None:
            return self.array(header, flat[0].children, flat[0].depth)[0]
        if len(flat) == 1 and not header and (first in ("{}", "[]") or first[0] in '{["' or ":" not in first or lex.is_reference(first)):
            if first[0] != '"' or not self.has_key(first):
                return self.inline(first)
        return self.object(root.children, 0)

    @staticmethod
    def has_key(text: str) -> bool:
        try:
            return lex.read_key(text) is not None
        except ValueError:
            return False

    def object(self, lines: list[Line], depth: int) -> dict:
        """The fields at a depth; other lines belong to nothing and are skipped."""
        out: dict = {}
        for line in lines:
            if line.depth == depth:
                out.update(self.field(line))
        return out

    def field(self, line: Line) -> dict:
        header = lex.read_header(line.text) if "[" in line.text else None
        if header and header.key is not None:
            return {header.key: self.array(header, line.children, line.depth)[0]}
        found = lex.read_key(line.text)
        return {found[0]: self.value(found[1], line.children, line.depth)} if found else {}

    def value(self, rest: str, children: list[Line], depth: int):
        """What follows a key: on its line, or below it."""
        if rest:
            return self.inline(rest)
        if children and children[0].depth == depth + 1 and children[0].text.startswith("- "):
            return [self.item(c) for c in children if c.depth == depth + 1 and c.text.startswith("- ")]
        return self.object(children, depth + 1)

    def array(self, header: lex.Header, children: list[Line], depth: int) -> tuple[list, int]:
        """The values of a header, and how many lines below it they took."""
        if not header.count:
            return [], 0
        if header.rest and header.fields is None:
            return [self.inline(v) for v in lex.split_top(header.rest, header.delimiter)], 0
        fields = header.fields
        if fields is None and header.ref:
            fields = self.registry.tabular_fields(*header.ref)
        out: list = []
        for used, line in enumerate(children):
            if len(out) == header.count or line.depth != depth + 1:
                return out, used
            if fields is not None:
                values = [self.inline(v) for v in lex.split_top(line.text, header.delimiter)]
                out.append({f: values[i] if i < len(values) else None for i, f in enumerate(fields)})
            elif line.text.startswith("- "):
                out.append(self.item(line))
            if line.children and not line.text.startswith("- "):
                return out, used + 1
        return out, len(children)

    def item(self, line: Line):
        """A list item: an array, a reference, an object with its further fields, or a value."""
        text = lex.strip(line.text[2:])
        header = lex.read_header(text) if "[" in text else None
        if header and header.key is None:
            return self.array(header, line.children, line.depth)[0]
        if not header:
            if not self.list_references and (ref := lex.read_reference(text)):
                return {f"@{ref[0]}": ref[1]}
            if not text or lex.is_reference(text) or (text[0] in "{[" and lex.closes_at_end(text)) or ":" not in text:
                return self.inline(text)
            if text[0] == '"' and not self.has_key(text):
                return self.inline(text)
        inner = line.depth + 1
        if header:
            first, used = self.array(header, line.children, line.depth)
            return {header.key: first} | self.object(line.children[used:], inner)
        key, rest = lex.read_key(text) or (text, "")
        below = line.children
        if rest:
            return {key: self.inline(rest)} | self.object(below, inner)
        deeper = next((i for i, c in enumerate(below) if c.depth == inner), len(below))
        if deeper:  # the first field's own lines are two deeper, the further fields one
            return {key: self.object(below[:deeper], inner + 1)} | self.object(below[deeper:], inner)
        return {key: self.object(below, inner)}

    def inline(self, text: str):
        text = lex.strip(text)
        if text[:1] == "{":
            inside = text[1 : text.rfind("}")] if "}" in text else text[1:]
            out = {}
            for part in lex.split_top(inside, ","):
                found = lex.read_key(lex.strip(part)) if lex.strip(part) else None
                if found:
                    out[found[0]] = self.inline(found[1])
            return out
        if text[:1] == "[":
            inside = lex.strip(text[1 : text.rfind("]")] if "]" in text else text[1:])
            return [self.inline(v) for v in lex.split_top(inside, ",")] if inside else []
        if lex.is_reference(text):
            return self.reference(text)
        return lex.read_scalar(text)

    def reference(self, text: str):
        """A definition, one of several, or the text itself if there is none."""
        if " | " in text:
            parts = [lex.read_reference(p) for p in text.split(" | ")]
            return {"oneOf": [self.registry.resolve(*p) for p in parts if p and self.registry.has(*p)]}
        head, brace, tail = text.partition("{")
        ref = lex.read_reference(head)
        if not ref or not self.registry.has(*ref):
            return text
        return self.registry.resolve(*ref, self.inline(brace + tail) if brace else None)


def read(text: str, indent: int | None = None, definitions: dict[str, dict] | None = None):
    return Reader(indent, definitions).read(text)
