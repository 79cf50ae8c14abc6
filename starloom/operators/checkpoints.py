"""Reliable materialisation in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local session without one may fall back to a temp folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        own = tempfile.mkdtemp(prefix="starloom-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path beside the checkpoints, for tables that a run writes and reads again; it goes when the application ends."""
    ensure_checkpoint_dir(spark)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    parent = jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}")
    fs = parent.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return f"{parent.toString()}/data"


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: lineage is cut and a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by key over all shuffle partitions: small tables with costly kernels are not merged into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
