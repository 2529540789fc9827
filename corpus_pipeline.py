"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. All but the last return the columns of ``docs``. Columns that ``docs`` has
besides doc_id and text travel in one struct, so their names cannot clash.

Rows are told apart by (doc_id, 128-bit hash of the text); a null doc_id is an id of its
own. Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch, id_key, text_tag
from corpuslens.llm.decontam import contamination
from corpuslens.llm.near import near_duplicates
from corpuslens.llm.packing import pack
from corpuslens.llm.pii import personal_data, redact
from corpuslens.llm.rules import judged
from corpuslens.sources.bindings import table

TOKENIZER = "word_bpe_49k.json"

#: The stages follow one another through operators that SQL cannot state.
ORACLE_SQL = None


#: Tables of stages whose results have been written and read again.
_past: list[Scratch] = []


def _scratch(spark: SparkSession, name: str, docs: DataFrame) -> Scratch:
    """A folder for a stage; those of earlier stages go, unless ``docs`` still reads them."""
    for s in list(_past):
        if s.spark is spark and not s.feeds(docs):
            s.drop()
            _past.remove(s)
    _past.append(Scratch(spark, name))
    return _past[-1]


def _held(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_key and tag."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), id_key(docs["doc_id"].cast("long")).alias("doc_key"),
                       text_tag(docs["text"]).alias("tag"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return judged(docs, _scratch(spark, "stage-rules", docs)).filter("q.kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; texts without words are no duplicates and stay."""
    keep = (near_duplicates(docs, _scratch(spark, "stage-near", docs)).filter("chosen and n_shingles > 0")
            .select(id_key(F.col("doc_id")).alias("doc_key"), "tag").distinct())
    held = _held(docs).withColumn("words", F.coalesce(F.col("row.text"), F.lit("")).rlike("[^ \\t-\\r]"))
    one = held.filter("words").dropDuplicates(["doc_key", "tag"]).join(keep, ["doc_key", "tag"], "left_semi")
    return one.select("row.*").unionByName(held.filter("not words").select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    tests = table(spark, sf_dir, "benchmark")
    hit = (contamination(docs, tests, _scratch(spark, "stage-decontam", docs)).filter("n_hit > 0")
           .select(id_key(F.col("doc_id")).alias("doc_key"), "tag").distinct())
    return _held(docs).join(hit, ["doc_key", "tag"], "left_anti").select("row.*")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    found = (personal_data(docs, _scratch(spark, "stage-pii", docs)).filter(F.size("every") > 0)
             .select(id_key(F.col("doc_id")).alias("doc_key"), "tag", "every").dropDuplicates(["doc_key", "tag"]))
    held = _held(docs).join(found, ["doc_key", "tag"], "left")
    text = F.when(F.col("every").isNull(), F.col("row.text")).otherwise(redact(F.col("row.text"), F.col("every")))
    out = held.select("row", "every", text.alias("clean"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("clean").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col("every").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast(kind)).alias(c))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return out.select(*cols)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(docs, public_tokenizers.path(TOKENIZER), _scratch(spark, "stage-packing", docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", private_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every result but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, name)
    return docs
