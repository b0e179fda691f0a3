"""Checks of trees against required keys and known specifications. Plain Python."""

from __future__ import annotations

MODES = ("loose", "warn", "strict")
#: Required fields by specification, at the top and below a parent.
REQUIRED = {spec: [("", f) for f in ("openapi", "info", "paths")] + [("info", f) for f in ("title", "version")] for spec in ("openapi:3.1", "openapi:3.0")}


class Validator:
    def __init__(self, mode: str = "warn", enforce: str | None = None):
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.mode, self.enforce = mode, enforce

    def _result(self, warnings: list[str], errors: list[str]) -> dict:
        return {"valid": not errors, "warnings": warnings, "errors": errors, "mode": self.mode, "enforce": self.enforce}

    def _issues(self, messages: list[str]) -> tuple[list[str], list[str]]:
        """(warnings, errors) of general issues: errors if strict or a specification is enforced."""
        if self.mode == "strict" or self.enforce is not None:
            return [], messages
        return (messages, []) if self.mode == "warn" else ([], [])

    def validate(self, tree) -> dict:
        found = [] if isinstance(tree, (dict, list)) else ["Root value must be an object or array"]
        if isinstance(tree, dict):
            for parent, name in REQUIRED.get(self.enforce, []):
                holder = tree.get(parent) if parent else tree
                if isinstance(holder, dict) and name not in holder:
                    found.append(f"Missing required field per {self.enforce}: {parent + '.' if parent else ''}{name}")
        return self._result(*self._issues(found))

    def validate_schema(self, name: str, schema) -> dict:
        empty = isinstance(schema, dict) and not schema
        return self._result(*self._issues([f"Schema '{name}' is empty"] if empty else []))

    def against(self, tree, schema, path: str = "") -> dict:
        """Keys that end in ! are required; one level, no types."""
        if not (isinstance(tree, dict) and isinstance(schema, dict)):
            return self._result([], [])
        at = lambda key: f"{path}.{key}" if path else key
        missing = [f"Missing required field: {at(k[:-1])}" for k in schema if k.endswith("!") and k[:-1] not in tree]
        warnings, errors = self._issues(missing)
        known = {k.rstrip("!") for k in schema}
        extra = [at(k) for k in tree if k not in known]
        if self.mode == "strict":
            errors = errors + [f"Extra field not in schema: {k}" for k in extra]
        elif self.mode == "warn":
            warnings = warnings + [f"Extra field: {k}" for k in extra]
        return self._result(warnings, errors)
