"""Registered queries over the driver tables, each with its SQL."""

from . import evidence, further, general, lines, measures

QUERIES = {**evidence.QUERIES, **measures.QUERIES, **general.QUERIES, **further.QUERIES, **lines.QUERIES}
ORACLE = {**evidence.ORACLE, **measures.ORACLE, **general.ORACLE, **further.ORACLE, **lines.ORACLE}
