"""Query registry."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def cte(*parts, select):
    """WITH part, part, ... select."""
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()


def rounded(df, *cols, digits=6):
    """Round the named columns (adding 0.0 turns -0.0 into 0.0)."""
    from pyspark.sql import functions as F
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})
