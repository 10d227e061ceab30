"""Staged tables: cut lineage, and learn a result's size before it is joined.

A staged table is written to the shared folder of the cluster, so it outlives
the executor that made it. Read back, Spark knows its size in bytes. A join
with it then becomes a broadcast only below spark.sql.autoBroadcastJoinThreshold
and a shuffled join, which adaptive execution splits on skew, above it. Only
small aggregates that several jobs read are staged, never the rows themselves.
"""

import threading
import uuid
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import functions as F

SALTS = 16
SMALL_BYTES, SMALL_FILES = 64 << 20, 64


def shared_dir(spark):
    """The cluster's checkpoint folder, or a folder in the warehouse where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_staged").rstrip("/")


def _application_dir(spark):
    return f"{shared_dir(spark)}/lateline/{spark.sparkContext.applicationId}"


def new_path(spark, label="stage"):
    return f"{_application_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _before, _lock = Counter(), {}, threading.Lock()


@contextmanager
def brief_shuffles(spark):
    """What a write in this block shuffles is deleted when the write ends.

    Spark else keeps it until the driver happens to collect its garbage, so the shuffles of
    one write after another lie side by side. Writes may overlap; a session that has
    the setting on keeps it.
    """
    session = spark._jsparkSession.hashCode()
    with _lock:
        if not _writing[session]:
            _before[session] = spark.conf.get(_CLEANUP)
        _writing[session] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writing[session] -= 1
            if not _writing[session]:
                spark.conf.set(_CLEANUP, _before.pop(session))


def settle(df, label="stage"):
    """Write `df` once and return it as a table of known size."""
    return _settled(df, new_path(df.sparkSession, label))


def _settled(df, path):
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settled(df, label="stage"):
    """As settle, for a table that nothing reads behind the block: it is deleted there."""
    path = new_path(df.sparkSession, label)
    try:
        yield _settled(df, path)
    finally:
        _delete(df.sparkSession, path)


def attach(df, stats, keys, row_key=None, salts=SALTS):
    """Left join of an aggregate, unique in `keys`, to the rows it came from; nothing is written.

    Adaptive execution does not split a hot key right behind an aggregation. So
    the rows of a key are dealt to `salts` places by the hash of `row_key`, and
    the aggregate, one row per key, is laid out at each of them. Without `row_key`
    keys hold few rows each and are joined plainly.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if row_key is None:
        return df.join(stats, keys, "left")
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(row_key), F.lit(salts)).cast("int"))
    laid = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(laid, [*keys, "_salt"], "left").select(*df.columns, *[c for c in stats.columns if c not in keys])


def spread(scan):
    """Spread a small scan over the cores: a small file is read by one task however heavy its rows are.

    Files of more than SMALL_BYTES together are left as they are scanned, so what
    is shuffled here has a fixed bound; only the files' sizes are looked up.
    """
    spark, files = scan.sparkSession, scan.inputFiles()
    if not 0 < len(files) <= SMALL_FILES:
        return scan
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return scan.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_BYTES else scan


def release_staged(spark):
    """Delete what this application staged, once its results have been consumed."""
    return _delete(spark, _application_dir(spark))


def _delete(spark, folder):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    filesystem = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return filesystem.delete(path, True)
