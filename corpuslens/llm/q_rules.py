"""Query of the quality rules."""

from __future__ import annotations

from corpuslens.llm.common import Scratch
from corpuslens.llm.queries import query
from corpuslens.llm.rules import judged
from corpuslens.sources.bindings import table


@query("op10_quality_rules")
def op10(spark, sf_dir):
    r = judged(table(spark, sf_dir, "documents"), Scratch(spark, "rules"), keep=["doc_id"])
    return r.select("row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
                    "q.base_failed", "q.kept", "q.class_js", "q.word_js")
