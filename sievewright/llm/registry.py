"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, langid, line_dedup, lm_score, mixing, pii, simhash, warc

MODULES = [warc, simhash, embedding_dedup, bpe, mixing, pii, lm_score, line_dedup, langid, exact_dedup]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
