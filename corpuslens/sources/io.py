"""Readers and sinks."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.text import strip

# Language tags under which a lexicon is filed.
LANGUAGE_TAGS = {"en": "EN", "es": "ES", "pt": "PT", "fr": "FR", "ar": "AR", "it": "IT", "de": "DE"}


def read_delimited(spark: SparkSession, path, schema: str, sep=",", header=False) -> DataFrame:
    """Tab, semicolon or comma separated text with a declared schema; quoted fields may span lines.

    A file is read by as many tasks as it has splits. Whether a split begins inside a quoted
    field follows from the number of quotes before it, so a first pass counts quotes by
    split and a second one puts lines together to records; the pieces of a record that
    crosses splits (at most one record an edge) meet in a small aggregation. An empty
    field is null, quoted or not.
    """
    records = quoted_records(spark, path, header)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")


_SPLIT = ["_file", "_start"]


def _lines(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), "value")


def quoted_records(spark: SparkSession, path, header=False) -> DataFrame:
    """(record): the text of each record, line ends inside quotes kept, empty lines between records left out."""
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    odd = (lines.groupBy(*_SPLIT).agg(F.sum(quotes).alias("q")).withColumn("b", F.sum("q").over(before))
           .filter(F.col("b") % 2 == 1).select(*_SPLIT, F.lit(True).alias("_open")))
    # one row of two numbers for a split at most; a shuffle would lose the order of the lines
    pieces = lines.join(F.broadcast(odd), _SPLIT, "left").mapInArrow(
        _records(header), "_file long, _start long, _head boolean, _tail boolean, record string")
    crossing = F.col("_head") | F.col("_tail")
    # from a split's tail on to the next head that is not a tail as well lies one record
    order = Window.partitionBy("_file").orderBy("_start", F.col("_tail").cast("int"))
    part = (pieces.filter(crossing).withColumn("_begins", (F.col("_tail") & ~F.col("_head")).cast("int"))
            .withColumn("_n", F.sum("_begins").over(order)))
    joined = (part.groupBy("_file", "_n").agg(F.array_sort(F.collect_list(F.struct("_start", "record"))).alias("r"))
              .select(F.array_join("r.record", "\n").alias("record")))
    every = pieces.filter(~crossing).select("record").unionByName(joined)
    return every.select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")


def _records(header: bool):
    """Lines of splits, in order, to records. ``_head`` marks what ends a record of an earlier split, ``_tail`` what a later one ends."""
    def run(batches):
        at, open_, head, held, skip = None, False, False, [], False

        def emit(out, tail):
            nonlocal head, held, skip
            if held and not (skip and not head and not tail):
                out.append((*at, head, tail, "\n".join(held)))
            if not head:
                skip = False
            head, held = False, []

        for batch in batches:
            out = []
            for file, start, value, was_open in zip(*(batch.column(c).to_pylist() for c in (*_SPLIT, "value", "_open"))):
                if (file, start) != at:
                    if at is not None:
                        emit(out, open_)
                    at, open_ = (file, start), bool(was_open)
                    head, skip = open_, header and start == 0
                held.append(value)
                if value.count('"') % 2:
                    open_ = not open_
                if not open_:
                    emit(out, False)
            yield _as_batch(out)
        out = []
        if at is not None:
            emit(out, open_)
        yield _as_batch(out)
    return run


def _as_batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["_file", "_start", "_head", "_tail", "record"])


def read_splits(spark: SparkSession, paths, columns=None) -> DataFrame:
    """Parquet splits as one table; only the named columns are read."""
    parts = [spark.read.parquet(p) for p in paths]
    if columns:
        parts = [p.select(*columns) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def reconcile(left: DataFrame, right: DataFrame, key="dataset_id") -> DataFrame:
    """(key, status): 'both', 'left_only' or 'right_only', by one full outer join."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").select(
        key, F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both").alias("status"))


def lexicon_table(raw: DataFrame) -> DataFrame:
    """(language, lemma, n_words, category) from raw (language, lemma, category) rows:
    lower-cased and trimmed, empty lemmas dropped, words counted."""
    t = raw.select("language", F.lower(strip(F.col("lemma"))).alias("lemma"), strip(F.col("category")).alias("category"))
    t = t.filter(F.col("lemma").isNotNull() & (F.col("lemma") != "")).distinct()
    return t.withColumn("n_words", F.size(F.split("lemma", " +")))


def read_lexicon(spark: SparkSession, path, language: str) -> DataFrame:
    raw = read_delimited(spark, path, "lemma string, category string", sep="\t", header=True)
    return lexicon_table(raw.withColumn("language", F.lit(language)))


def write_datasets(docs: DataFrame, path, salts=32) -> None:
    """Clean corpora, one folder per corpus. Rows are spread before the write, so a
    large corpus is written by many tasks: by corpus and one of ``salts`` numbers."""
    spread = docs.repartition("dataset_id", F.pmod(F.xxhash64(*docs.columns), F.lit(salts)))
    spread.write.mode("overwrite").partitionBy("dataset_id").parquet(path)


def write_table(df: DataFrame, path, fmt="csv") -> None:
    """CSV with header, or JSON; the committer makes the replacement atomic."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
