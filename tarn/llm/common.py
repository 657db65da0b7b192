"""Helpers that the training-data operators share.

Scratch tables
    Intermediate results are written as Parquet below the folder that
    ``spark.checkpoint.dir`` names, so that any executor can read them again
    after another one is lost. Only where that setting is absent (tests, a
    single machine) a local temporary folder takes its place.

Document keys
    ``row_key`` is the ``doc_id`` with null replaced by the largest long: rows
    without an id are one document that sorts last.

Clashing names
    A caller's columns come back unchanged, whatever their names, but for those
    that an operator's outputs are named like: the output takes their place.
    Helper columns are named by ``unused``, so they can't clash.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id.
NULL_ID = 2**63 - 1

_scratch: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder of our own in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="tarn-"))
        base = _local[0]
    path = f"{base.rstrip('/')}/tarn-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def bounded_batches(spark: SparkSession) -> None:
    """Keeps what goes to a Python worker at once small, whatever the texts'
    lengths: 2,000 rows and 8 MB at most, unless the session has set less."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            pass


def saved(df: DataFrame, path: str, *, by: str | None = None) -> DataFrame:
    """Writes df as Parquet, in a folder for each value of `by`, and returns it as
    read back: lineage ends there."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def fold_of(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from being
    one of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that outputs of these names will replace."""
    gone = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])
