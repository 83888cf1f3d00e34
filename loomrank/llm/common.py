"""Helpers shared by the training-data operators: reading tables, cutting lineage, words, components."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"

#: Columns of the documents table, in order.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = tempfile.mkdtemp(prefix="loomrank-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def park(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/park-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parked_at = path
    return out


def unpark(df: DataFrame) -> None:
    """Delete what park() wrote for df, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._parked_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Bound the rows and the bytes of an Arrow batch, so that very long texts don't fill a Python worker; bounds that are already smaller stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    held = str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).lower().removesuffix("b")
    if not held.isdigit() or int(held) > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def masked(df: DataFrame, *known: str) -> tuple[DataFrame, dict[str, str]]:
    """df with plain names for all columns but `known`, and what each was called: helper columns can't clash with names of the input."""
    names = {c if c in known else f"c{k}": c for k, c in enumerate(df.columns)}
    return df.toDF(*names), names


def whole_ids(docs: DataFrame) -> DataFrame:
    """docs with 0 for a null doc_id and a flag no_id: beside a null, pandas would hold the ids of a batch as floating point numbers."""
    return docs.withColumn("no_id", F.isnull("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))


def ids_of(pdf: pd.DataFrame) -> pd.Series:
    """The ids of a batch of whole_ids(), integral and null where they were."""
    return pdf["doc_id"].astype("Int64").mask(pdf["no_id"])


def bind(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    """text without these characters: replace() looks for bytes, several times faster than translate()."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Array of the runs of characters other than ASCII white space; empty for null."""
    flat = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def _at_label(rows: DataFrame, column: str, label: DataFrame, broadcast_rows: int) -> DataFrame:
    """rows with the label of what the column names, where it has one.

    Many rows name few vertices: the labels of those that are named are broadcast up to broadcast_rows, so that a large component doesn't gather in one task.
    """
    known, n = label.select(F.col("id").alias("_via"), F.col("comp").alias("_far")), label.count()
    if n > broadcast_rows:
        known = park(known.join(rows.select(F.col(column).alias("_via")).distinct(), "_via", "left_semi"))
        n = known.count()
    known = F.broadcast(known) if n <= broadcast_rows else known
    return rows.join(known, F.col(column) == F.col("_via"), "left").withColumn(column, F.coalesce("_far", column)).drop("_via", "_far")


def components(edges: DataFrame, max_rounds: int = 60, broadcast_rows: int = 100_000) -> DataFrame:
    """Connected components of edges(a, b): one row (id, comp) per endpoint, comp being the smallest id.

    Each round every vertex follows its smallest neighbour, if smaller than itself, to the vertex where that ends (pointer doubling), and edges are
    contracted to those ends, of which there are at most half as many as vertices. So later rounds join only what is left, and all rounds together little more than the first; the
    ends' own ends are put in afterwards, last round first. Vertices are spread by id. Trees whose parents are smaller take one round.
    """
    links = park(edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x <> y").distinct())
    ends = []
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        label = park(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy("x").agg(F.min("y").alias("m"))
                     .select(F.col("x").alias("id"), F.least("x", "m").alias("comp")))
        while True:
            step = park(_at_label(label.withColumn("was", F.col("comp")), "comp", label, broadcast_rows))
            label = step.select("id", "comp")
            if step.where("comp <> was").isEmpty():
                break
        ends.append(label)
        x = _at_label(links, "x", label, broadcast_rows)
        links = park(_at_label(x, "y", label, broadcast_rows).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct())
    else:
        raise RuntimeError("components did not settle")
    if not ends:
        return links.select(F.col("x").alias("id"), F.col("y").alias("comp"))
    label = ends.pop()
    while ends:
        label = park(_at_label(ends.pop(), "comp", label, broadcast_rows))
    return label
