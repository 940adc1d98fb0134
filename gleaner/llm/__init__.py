"""Operators for building training corpora.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
list what it adds to the entry points of the repository.
"""

from gleaner.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
