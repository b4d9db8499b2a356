"""All queries of the engine by name; those for training data are in the llm subpackage."""

from __future__ import annotations

from quirework.queries import nested, tables, vectors

QUERIES = {**nested.QUERIES, **vectors.QUERIES, **tables.QUERIES}
ORACLE = {**nested.ORACLE, **vectors.ORACLE, **tables.ORACLE}
