"""Whole queries over Parquet tables, with the SQL that says the same."""

from tidemark.plans import bars, labels, research, small

QUERIES = bars.QUERIES | labels.QUERIES | research.QUERIES | small.QUERIES
SQL = bars.SQL | labels.SQL | research.SQL | small.SQL
