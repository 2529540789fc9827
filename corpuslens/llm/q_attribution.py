"""Query of token attribution."""

from __future__ import annotations

import public_tokenizers

from corpuslens.llm.attribution import section_tokens
from corpuslens.llm.queries import query
from corpuslens.sources.bindings import table


@query("op5_token_attribution")
def op5(spark, sf_dir):
    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
