"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is configured (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = tempfile.mkdtemp(prefix="loomrank-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def park(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/park-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with rn, its place in the order (from 1; the order must tell all rows apart): rows are range-partitioned and ranked in their range, ranges add what lies before."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = park(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranges.join(F.broadcast(before), "_part").withColumn("rn", F.col("_before") + inside).drop("_part", "_before")


def ranked_within(df: DataFrame, group: str, *order) -> DataFrame:
    """df with rn, its place within its group (from 1), and n, the group's rows: ranked() over all rows, less what lies before the group. A group may hold any share of the rows."""
    r = park(ranked(df, group, *order))
    first = r.groupBy(F.col(group).alias("_group")).agg(F.min("rn").alias("_first"), F.count("*").alias("n"))
    return r.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn("rn", F.col("rn") - F.col("_first") + 1).drop("_group", "_first")
