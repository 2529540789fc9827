"""Query of licence scans."""

from __future__ import annotations

from corpuslens.llm.licences import licence_notices
from corpuslens.llm.queries import query
from corpuslens.sources.bindings import table


@query("op6_licence_scan")
def op6(spark, sf_dir):
    return licence_notices(table(spark, sf_dir, "documents"))
