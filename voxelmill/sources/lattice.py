"""Voxel tables: one row per voxel (dataset_id, z, y, x, channels, label, mask). Absent voxels are outside the mask."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYER_ID = r"layer_(\d+)"


def lattice_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 x 10 planes from ``embeddings``: two channels and labels 0 to 9, 0 being background."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.expr("vec_id div 100").cast("int").alias("z"), F.expr("vec_id div 10 % 10").cast("int").alias("y"), (F.col("vec_id") % 10).cast("int").alias("x"),
        F.col("embedding")[0].cast("double").alias("c0"), F.col("embedding")[1].cast("double").alias("c1"), F.col("label").cast("int").alias("label"),
    )


def lattice_v(spark: SparkSession, sf_dir: str, clock: bool = False) -> DataFrame:
    """50 x 50 planes from ``events``: value and hour as channels, errors outside the mask, users in three labels.

    With ``clock`` the second channel is the time of day in hours with its fraction: it varies however short a plane's time is."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.expr("event_id div 2500").cast("int").alias("z"), F.expr("event_id div 50 % 50").cast("int").alias("y"), (F.col("event_id") % 50).cast("int").alias("x"),
        F.col("value").cast("double").alias("c0"), (F.expr("hour(ts) + minute(ts) / 60D + extract(second from ts) / 3600D") if clock else F.hour("ts")).cast("double").alias("c1"), (F.col("event_type") != "error").alias("mask"), (F.col("user_id") % 3).cast("int").alias("label"),
    )


def read_npy_layers(spark: SparkSession, glob: str, channels: int = 2) -> DataFrame:
    """Layers (Y, X, C) in ``.npy`` files as voxels: the layer's number is taken from its folder, z is its dense rank.

    One file is one row of the binary source, so layers are read side by side; a layer fits in a task's memory."""
    files = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", LAYER_ID, 1).cast("int").alias("layer"), "content")
    schema = "layer int, y int, x int, " + ", ".join(f"c{c} double" for c in range(channels))

    def parse(batches):
        for batch in batches:
            for layer, content in zip(batch["layer"].to_pylist(), batch["content"]):
                a = np.load(io.BytesIO(content.as_py()))
                y, x = np.indices(a.shape[:2], np.int32)
                yield pa.record_batch({"layer": pa.array(np.full(y.size, layer, np.int32)), "y": y.ravel(), "x": x.ravel(), **{f"c{c}": a[..., c].ravel().astype(np.float64) for c in range(channels)}})

    layers = files.select("layer").distinct().withColumn("z", F.expr("dense_rank() over (order by layer) - 1").cast("int"))
    return files.mapInArrow(parse, schema).join(F.broadcast(layers), "layer").select("z", "y", "x", *(f"c{c}" for c in range(channels)), "layer")


def read_npy_volumes(spark: SparkSession, glob: str, channels: int = 2) -> DataFrame:
    """Volumes (Z, Y, X, C) in ``.npy`` files as voxels, ``dataset_id`` being the file's name. One file is one row of the binary source."""
    files = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("dataset_id"), "content")
    schema = "dataset_id string, z int, y int, x int, " + ", ".join(f"c{c} double" for c in range(channels))

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch["dataset_id"].to_pylist(), batch["content"]):
                # a plane at a time, so that the voxels' rows are never all in memory
                for z, plane in enumerate(np.load(io.BytesIO(content.as_py()))):
                    y, x = np.indices(plane.shape[:2], np.int32)
                    yield pa.record_batch({"dataset_id": pa.array([name] * y.size), "z": pa.array(np.full(y.size, z, np.int32)), "y": y.ravel(), "x": x.ravel(), **{f"c{c}": plane[..., c].ravel().astype(np.float64) for c in range(channels)}})

    return files.mapInArrow(parse, schema)


def read_table(spark: SparkSession, path: str, kind: str = "csv", schema: str | None = None) -> DataFrame:
    """A result table again: CSV with header, JSON (an object may span lines) or Parquet; CSV without a schema is text."""
    reader = spark.read.format(kind).option("header", True).option("multiLine", True)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Result tables as CSV (with header), JSON or Parquet."""
    (df.write.option("header", True) if kind == "csv" else df.write).mode("overwrite").format(kind).save(path)


def summary_json(df: DataFrame) -> DataFrame:
    """A one-column table ``summary``: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("summary"))
