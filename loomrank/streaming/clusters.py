"""Incremental story clustering: each micro-batch joins the stored clusters or starts new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomrank.functions.numbers import HOUR
from loomrank.operators import stories

#: What is kept of a clustered item: enough to compare it with later ones, never its text.
STATE = ("item_id long, source_id string, url string, at long, tokens array<string>, entities array<string>, embedding array<float>, size double, title_key string, entity_key string, "
         "cluster_id long, match long, confidence double")


def stored(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The clustered items in the folder, one sub-folder a batch; only batches before the given one, so that a batch that is run again doesn't meet itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STATE)
    state = spark.read.schema(f"{STATE}, batch long").parquet(folder)
    return (state if before is None else state.where(F.col("batch") < before)).drop("batch")


def cluster_batch(items: DataFrame, folder: str, batch: int, checkpoint, cut: float = stories.CUT, late_hours: int | None = None) -> None:
    """Cluster items(item_id, source_id, title, summary, url, at, embedding) against the folder and add them to it, as sub-folder batch=<batch>.

    Items that are stored already are skipped; of equal ids in a batch one counts. Items more than late_hours before the newest of the batch stay out, unclustered (none if not given).
    Stored items are read back to one window before the batch's earliest (and all their urls). A batch that is run again overwrites what it wrote.
    """
    spark = items.sparkSession
    state = stored(spark, folder, batch)
    # a first delivery has no stored side, so no search plans for one
    known = None if state.isEmpty() else state
    if late_hours is not None:
        newest = items.agg(F.max("at")).first()[0]
        items = items.where(F.col("at") >= (newest or 0) - late_hours * HOUR)
    fresh = items.dropDuplicates(["item_id"])
    if known is not None:
        fresh = fresh.join(known.select("item_id"), "item_id", "left_anti")
    new = checkpoint(stories.keyed(stories.prepare(fresh)).withColumn("embedding", F.col("embedding").cast("array<float>")))
    found = stories.assign(new, known, cut, checkpoint)
    new.join(found, "item_id").select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


def cluster_stream(items: DataFrame, folder: str, checkpoint_location: str, checkpoint, **options) -> StreamingQuery:
    """Cluster what has arrived and stop; rerun to go on where the checkpoint ends. checkpoint: how a batch's intermediate tables are written down."""
    return (items.writeStream.foreachBatch(lambda df, batch: cluster_batch(df, folder, batch, checkpoint, **options))
            .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start())
