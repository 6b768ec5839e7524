"""All queries over tables and files, and their SQL."""

from __future__ import annotations

from tidewright.plans import file_queries, option_queries, queries

PAIRS = queries.PAIRS | file_queries.PAIRS | option_queries.PAIRS
QUERIES = queries.QUERIES | {name: pair[0] for name, pair in PAIRS.items()}
SQL = {name: pair[1] for name, pair in PAIRS.items()}
