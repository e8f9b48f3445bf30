"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import getpass
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session that names none gets one under /tmp; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master or "local"
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"/tmp/checkpoints/{getpass.getuser()}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, whoever reads it, and safe from lost executors.

    Two readers see the same digits, which sums of floating numbers do not promise when computed twice. The files go when
    the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon-settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already  # noqa: BLE001
        return
