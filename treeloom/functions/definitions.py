"""Named definitions, references to them with overrides, and merging. Plain Python."""

from __future__ import annotations

from copy import deepcopy

KINDS = {"s": "Schema", "r": "Response", "sec": "Security"}


def merge(base, over):
    """Objects merge key by key; anything else is replaced."""
    if not (isinstance(base, dict) and isinstance(over, dict)):
        return deepcopy(over)
    out = dict(base)
    for key, value in over.items():
        both = key in out and isinstance(out[key], dict) and isinstance(value, dict)
        out[key] = merge(out[key], value) if both else deepcopy(value)
    return out


def put(tree: dict, path: str, value) -> dict:
    """Set a dotted path; what stands in the way becomes an object."""
    head, _, rest = path.partition(".")
    inner = tree.get(head)
    return tree | {head: put(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def drop(tree: dict, path: str) -> dict:
    """Remove a dotted path, if it is there."""
    head, _, rest = path.partition(".")
    if head not in tree:
        return tree
    if not rest:
        return {k: v for k, v in tree.items() if k != head}
    return tree | {head: drop(tree[head], rest)} if isinstance(tree[head], dict) else tree


def override(base, changes):
    """Removals (-key) first, then settings; dotted keys reach inside."""
    if not (isinstance(base, dict) and isinstance(changes, dict)):
        return base
    for key in changes:
        if key.startswith("-"):
            base = drop(base, key[1:])
    for key, value in changes.items():
        if key.startswith("-"):
            continue
        base = put(base, key, value) if "." in key else merge(base, {key: value})
    return base


class Registry:
    """Definitions by kind and name, in order of first registration."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self._store: dict[str, dict] = {k: {} for k in KINDS}
        self._open: set[tuple[str, str]] = set()

    def register(self, kind: str, name: str, body) -> None:
        self._store[kind][name] = body

    def has(self, kind: str, name: str) -> bool:
        return name in self._store[kind]

    def get_all(self, kind: str) -> dict:
        return dict(self._store[kind])

    def resolve(self, kind: str, name: str, changes=None):
        """A definition with the references inside resolved; a cycle becomes a $ref."""
        if not self.has(kind, name):
            raise LookupError(f"Undefined reference: @{kind}:{name}")
        if (kind, name) in self._open:
            return {"$ref": f"#/definitions/{name}"}
        self._open.add((kind, name))
        try:
            body = self._inside(self._store[kind][name])
        finally:
            self._open.discard((kind, name))
        return body if changes is None else override(body, changes)

    def _inside(self, value):
        if isinstance(value, list):
            return [self._inside(v) for v in value]
        if not isinstance(value, dict):
            return value
        return {k: self._marked(v) if isinstance(v, dict) else self._inside(v) for k, v in value.items()}

    def _marked(self, value: dict):
        """An object that may stand for a reference."""
        ref, many = value.get("@ref"), value.get("@polymorphic")
        if isinstance(ref, dict):
            if ref.get("type") not in KINDS:
                return value
            changes = value.get("@overrides")
            return self.resolve(ref["type"], ref.get("name", ""), changes if isinstance(changes, dict) else None)
        if isinstance(many, list):
            return self.polymorphic([(m.get("type"), m.get("name")) for m in many if isinstance(m, dict)])
        return self._inside(value)

    def polymorphic(self, refs: list[tuple[str, str]]) -> dict:
        return {"oneOf": [self.resolve(kind, name) for kind, name in refs if kind in KINDS]}

    def tabular_fields(self, kind: str, name: str) -> list[str]:
        if not self.has(kind, name):
            raise LookupError(f"Undefined tabular schema: @{kind}:{name}")
        body = self._store[kind][name]
        if not isinstance(body, dict):
            raise ValueError(f"Schema @{kind}:{name} is not an object, cannot use as tabular fields")
        return list(body)

    def layout(self, fields: list[str]) -> str | None:
        """The first schema with exactly these keys in this order."""
        return next((n for n, body in self._store["s"].items() if isinstance(body, dict) and list(body) == fields), None)
