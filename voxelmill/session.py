"""Session helpers shared by all operators: scratch storage, materialisation and sizing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir``, or a temporary one where that is unset and driver and
    executors are one process (tests). On a cluster an unset folder is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if root is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no shared folder for scratch tables")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="voxelmill-checkpoint-"))
    return root or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/voxelmill-{uuid.uuid4().hex}/{name}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, columnar, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(df: DataFrame) -> int:
    """Hash buckets for work done a bucket at a time: follows the input's splits and their greatest size (a bucket has
    about 4 MiB of stored input), so that a bucket's size doesn't grow with the input."""
    spark = df.sparkSession
    size = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", str(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")).lower())
    split = int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[size[2]] if size else 128 << 20
    return max(shuffle_partitions(spark), 4 * max(1, split >> 24) * df.rdd.getNumPartitions())
