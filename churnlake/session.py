"""Session settings, shared folders and lineage cutting used by every operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Skewed sort-merge joins are split at run time even when that costs a shuffle:
# one key may hold a third of the rows, so a straggler is always dearer.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Most bytes of a side, by the plan's own statistics, that is hinted for a broadcast.
BROADCAST_BYTES = 8 << 20


def tune(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors and the driver reach: the cluster names it in ``spark.checkpoint.dir``.

    Only a local session, whose executor is the driver, may leave it unset; it then uses the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where every executor can reach it."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: for wide rows, as columns and compressed."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the plan's statistics bound the side; else adaptive execution decides."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def splittable(df: DataFrame, key: str) -> DataFrame:
    """``df``, an aggregate by the text ``key``, in a form that a join by that key shuffles anew.

    An aggregate already lies hashed by its key; joined as it is, its side has no shuffle of its own,
    and adaptive execution cannot split the other side's skewed keys.
    """
    return df.withColumn(key, F.concat(F.col(key), F.lit("")))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
