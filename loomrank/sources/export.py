"""Static files of all feed documents, put in place by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def export_static(docs: DataFrame, folder: str, manifest: str = "manifest") -> None:
    """Write docs(name, body) as folder/file=<name>/..., and a manifest of names, sizes and hashes beside them.

    Executors write everything to a folder of its own next to the target; only when all of it is there are names changed, so a reader sees the old
    files or the new ones, and a run that fails leaves the old ones. What the last run wrote and this one didn't is gone.
    """
    spark = docs.sparkSession
    folder = folder.rstrip("/")
    staged, former = (f"{folder}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    docs.select(F.col("name").alias("file"), F.col("body").alias("value")).write.partitionBy("file").text(staged)
    written = F.octet_length("body").cast("long")
    docs.select("name", written.alias("bytes"), F.sha2("body", 256).alias("sha256")).write.parquet(f"{staged}/_{manifest}")
    target, fs = _files(spark, folder)
    if fs.exists(target):
        fs.rename(target, _files(spark, former)[0])
    if not fs.rename(_files(spark, staged)[0], target):
        raise OSError(f"{staged} could not be moved to {folder}")
    fs.delete(_files(spark, former)[0], True)


def exported(spark: SparkSession, folder: str, manifest: str = "manifest") -> DataFrame:
    """name, body, bytes, sha256: the files in a folder beside what its manifest says of them."""
    files = spark.read.schema("value string, file string").text(folder, wholetext=True)
    listed = spark.read.parquet(f"{folder.rstrip('/')}/_{manifest}")
    # the writer ends a file with a line feed
    return listed.join(files.select(F.col("file").alias("name"), F.regexp_replace("value", r"\n$", "").alias("body")), "name", "full")
