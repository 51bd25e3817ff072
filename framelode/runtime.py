"""Session settings and written intermediate tables.

Iterative operators cut their lineage by writing a table to the folder that all
executors share (``spark.checkpoint.dir``). A lost executor then costs only the
tasks it ran: nothing that a later round reads lives on one machine.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

#: Rows up to which a side whose rows have a fixed, small width may be broadcast.
BROADCAST_ROWS = 100_000


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; the number of shuffle partitions is left to the cluster unless it is given.

    Local workers find this package wherever they are started. On a cluster it is installed, or sent with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    builder = SparkSession.builder.master(master).appName("framelode")
    given = {} if shuffle_partitions is None else {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    for key, value in (CONF | given | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one, but only in local mode."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelode-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


class Scratch:
    """Intermediate tables of one operator call, in the shared folder.

    ``put`` writes a table and returns a scan of it; ``drop`` removes one that no
    later step reads. What is left goes when the process ends, so results that
    still read a table stay valid.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_delete, spark, self.root)

    def put(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._scratch_path = path
        return read

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and getattr(table, "_scratch_path", None):
                _delete(self.spark, table._scratch_path)


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``, else unchanged (the join then shuffles)."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with at least two partitions a core, for work that is heavy per row; its own partitioning if its size makes as many.

    The size is the optimizer's estimate: nothing is run to find it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    one = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df if size >= 2 * cores * one else df.repartition(3 * cores, *keys)
