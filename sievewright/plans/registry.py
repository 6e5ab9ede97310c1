"""Queries by name and the SQL they are held against."""

from __future__ import annotations

from . import documents, tables

QUERIES = documents.QUERIES | tables.QUERIES
SQL = documents.SQL | tables.SQL
