"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app="corpuslens", master=None, **conf) -> SparkSession:
    """A session with adaptive execution on; pass ``master`` only for local runs."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, str(v))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on
    a cluster a machine-local folder would be lost with its executor, so the
    setting is required there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="corpuslens-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` below the checkpoint folder in columns, compressed, and read it back.

    For large tables: a checkpoint holds plain rows, several times their size. Shuffle files
    of the write go with it, the table's files with ``dropped`` or when the session ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    folder = f"{sc.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(folder)
    out._stored = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored``; nothing may read it any more."""
    df._stored.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df._stored, True)
