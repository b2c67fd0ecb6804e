"""Registered queries over the driver's tables, with their SQL equivalents."""

from litspark.queries import answers, chains, chunking, indexes, papers, retrieval, tables

GROUPS = (chunking, papers, retrieval, answers, tables, indexes, chains)
QUERIES = {name: fn for group in GROUPS for name, fn in group.QUERIES.items()}
ORACLE = {name: sql for group in GROUPS for name, sql in group.ORACLE.items()}
