"""The codec: plain functions here, columns in ``native`` and ``udfs``."""

from treeloom.functions.definitions import Registry
from treeloom.functions.reader import Reader, read
from treeloom.functions.trees import equals, fingerprint, from_json, hash_tree, nodes, to_json, tree_hash
from treeloom.functions.validation import Validator
from treeloom.functions.writer import Writer, expand, minify, write

__all__ = ["Reader", "Registry", "Validator", "Writer", "equals", "expand", "fingerprint", "from_json", "hash_tree", "minify", "nodes", "read", "to_json", "tree_hash", "write"]
