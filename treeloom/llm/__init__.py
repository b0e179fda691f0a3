"""Operators for preparing training data: packing, near-duplicate joins, shards, filters.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` here
feed the repository's entry module when the subpackage is present.
"""

from treeloom.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
