"""Session, table access and the shared scratch area."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "graphloom", master: str | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, a Parquet file or folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a local master, where it is unset, a new local one.

    On a cluster a folder of one machine would lose rows, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder's owner clears it then
        pass


class Scratch:
    """Tables written to the shared folder, which cut the lineage of iterative plans.

    A written table survives the loss of executors. `drop` removes the tables that
    are no longer read; as a context manager, leaving it removes all; the rest goes when the driver ends.
    """

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.root)

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/graphloom-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and return it read back."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Remove a table that `keep` returned."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)


#: A table of keys up to this many rows is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def keyed(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """rows joined with a written table of short keys: by broadcast if it was counted to be small, by shuffle if not."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if small else keys, on, how)
