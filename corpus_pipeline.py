"""Corpus pipeline: documents to training tokens, in five stages over whole tables.

Each stage works on all that the one before it kept; its result is written as Parquet and read again
before the next stage, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm.byte_bpe import digests, public_vocabulary
from loomrank.llm.common import DOC_COLUMNS, park, table
from loomrank.llm.line_dedup import line_dedup
from loomrank.llm.mixing import mix
from loomrank.llm.ngram_join import classes_of, tag_of
from loomrank.llm.quality_rules import quality_rules

#: Ids of dropped near-duplicates are broadcast up to this many rows (16 bytes each); beyond it Spark joins by id.
BROADCAST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or any quality rule go."""
    return quality_rules(docs).where("kept").select(*DOC_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays: that of the smallest id (a null id is the largest), and of the smallest tag where an id has several texts."""
    rows = park(classes_of(docs).select("comp", "doc_id", "tag"))
    place = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col("tag"))
    first = rows.groupBy("comp").agg(F.min(place).alias("first"))
    texts = rows.groupBy("comp", "doc_id", "tag").agg(F.count("*").alias("n"))
    marked = park(texts.join(first, "comp").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "n", (place == F.col("first")).alias("stays")))
    gone, again = marked.where("not stays").select("_id", "_tag"), marked.where("stays and n > 1").select("_id", "_tag")
    tagged = docs.select(*DOC_COLUMNS, tag_of().alias("tag"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    left = tagged.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
    if again.isEmpty():
        return left.select(*DOC_COLUMNS)
    # rows of equal id and text: the one with the smallest other columns
    rest = [c for c in DOC_COLUMNS if c != "doc_id"]
    one = left.join(again, same, "left_semi").groupBy("doc_id", "tag").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return left.join(again, same, "left_anti").select(*DOC_COLUMNS).unionByName(one.select(*DOC_COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the result once for each epoch that takes it."""
    return (mix(docs).where("epochs > 0")
            .withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))).select(*DOC_COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return digests(docs, *public_vocabulary())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("mixing", mixture), ("byte_bpe", tokens)]

#: SQL can't express the merges of the last stage; tests/llm/test_pipeline.py compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = park(docs)
    return docs
