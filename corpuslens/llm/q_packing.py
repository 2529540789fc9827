"""Query of the packing operator."""

from __future__ import annotations

import public_tokenizers

from corpuslens.llm.common import Scratch
from corpuslens.llm.packing import pack
from corpuslens.llm.queries import query
from corpuslens.sources.bindings import table


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Scratch(spark, "packing"))
