"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}

MODULES = ("q_repeats", "q_near", "q_pii", "q_quality", "q_attribution", "q_licences", "q_packing", "q_kneser", "q_decontam", "q_rules", "q_resampling", "q_codes", "q_secrets")


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"corpuslens.llm.{m}")
    return QUERIES, SQL
