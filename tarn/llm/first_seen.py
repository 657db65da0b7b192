"""Levelled sorted runs of hashes: which keys have been seen, and by whom.

The store is a log-structured merge tree of Parquet tables. A run is bucketed
and sorted by its 128-bit key, with the first owner of each key. A batch's keys
are looked up in the runs by sort-merge joins that read the buckets in place
(no shuffle of what is stored); what no run holds becomes a new run of level 0.
When a level has ``fanout`` runs, they are merged into one run of the next
level. Runs never share a key, so merging is a union that is sorted again.

A store lies in the shared scratch space and goes with the session, or in a
folder of the caller's, with a file that lists its levels after each change:
``RunStore.open`` finds it there again. The list is replaced only when a new
run is complete, so a stop in between leaves the store as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import remove, saved, shared_dir

KEY = ["h1", "h2"]


class RunStore:
    """Runs in a folder; rows are (h1, h2, owner)."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, fanout: int = 3, buckets: int | None = None):
        self._spark, self._fanout, self._kept = spark, fanout, path is not None
        self._dir = path or shared_dir(spark)
        self._levels: list[list[str]] = []
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RunStore:
        """The store that an earlier session has left in the folder."""
        state = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/levels-{cls._latest(spark, path)}").collect()))
        out = cls(spark, path, fanout=state["fanout"], buckets=state["buckets"])
        out._levels = state["levels"]
        for name in out._runs():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {out._buckets} BUCKETS LOCATION '{path}/{name}'")
        return out

    @staticmethod
    def _latest(spark: SparkSession, path: str) -> int:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [int(n[7:]) for n in names if n.startswith("levels-") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def _note(self) -> None:
        if not self._kept:
            return
        last = self._latest(self._spark, self._dir)
        state = json.dumps({"fanout": self._fanout, "buckets": self._buckets, "levels": self._levels})
        self._spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self._dir}/levels-{last + 1}")
        if last:
            remove(self._spark, f"{self._dir}/levels-{last}")

    def _write(self, rows: DataFrame) -> str:
        name = f"tarn_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self._buckets, *KEY).sortBy(*KEY).option("path", f"{self._dir}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self._spark, f"{self._dir}/{name}")

    def _runs(self) -> list[str]:
        return [n for level in self._levels for n in level]

    def owners(self, keys: DataFrame) -> DataFrame:
        """keys (h1, h2, ...) with the column `earlier`: a run's owner, or null."""
        out = keys.withColumn("earlier", F.lit(None).cast("long"))
        for name in self._runs():
            run = self._spark.table(name).withColumnRenamed("owner", "_run").hint("merge")
            out = out.join(run, KEY, "left").withColumn("earlier", F.coalesce("earlier", "_run")).drop("_run")
        return out

    def add(self, fresh: DataFrame) -> None:
        """Adds rows (h1, h2, owner) that no run holds, and compacts full levels."""
        levels, old = [list(x) for x in self._levels] or [[]], []
        levels[0].append(self._write(fresh.select(*KEY, "owner").repartition(self._buckets, *KEY)))
        level = 0
        while len(levels[level]) >= self._fanout:
            runs = levels[level]
            merged = self._spark.table(runs[0])
            for n in runs[1:]:
                merged = merged.unionAll(self._spark.table(n))
            name = self._write(merged.repartition(self._buckets, *KEY))
            old += runs
            levels[level] = []
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(name)
            level += 1
        self._levels = levels
        self._note()
        for n in old:
            self._drop(n)

    def close(self) -> None:
        """Removes a store of the scratch space; one of the caller's stays."""
        for n in self._runs():
            if self._kept:
                self._spark.sql(f"DROP TABLE IF EXISTS {n}")
            else:
                self._drop(n)
        self._levels = []
        if not self._kept:
            remove(self._spark, self._dir)


def batch_step(store: RunStore, rows: DataFrame, path: str, *, last: bool = False) -> DataFrame:
    """One batch of rows (h1, h2, id, ...): returns, saved at path, those without
    h1 and h2 of which an earlier batch or a smaller id of this one holds the key,
    and adds the batch's new keys to the store (not after the last batch).

    Keys are summed up before they are shuffled, and joined back only where
    someone else holds them, so a key that a third of all rows share costs one
    row a task in the first step and is split like any skewed join in the second.
    """
    own = store.owners(rows.groupBy(*KEY).agg(F.min("id").alias("owner"), F.max("id").alias("last")))
    own = saved(own, f"{path}-keys")
    if not last:
        store.add(own.where(F.col("earlier").isNull()))
    shared = own.where(F.col("earlier").isNotNull() | (F.col("owner") < F.col("last"))).select(*KEY, F.when(F.col("earlier").isNull(), F.col("owner")).alias("_keeper"))
    again = rows.join(shared, KEY).where(F.col("_keeper").isNull() | (F.col("id") > F.col("_keeper")))
    return saved(again.drop(*KEY, "_keeper"), path)
