"""Registered queries: a Spark plan and, where SQL can say it, its DuckDB twin."""
