"""Operator 9: line dedup by site-relative frequency, in DataFrame functions only.

Documents are grouped by host (their source). A line is boilerplate of a host if it stands on more
than `ratio` of the host's pages and on at least `min_pages` of them; every occurrence of it goes.
Counting explodes the distinct lines of each page into (host, md5) rows, which Spark sums before the
shuffle; a host's boilerplate is at most (distinct lines per page) / ratio lines, so it fits one row.

Defined results: a null host is a host of its own; null text stays null and has no lines; lines without
a word are kept and not counted; a line repeated on one page counts once; repeated rows are pages each;
an empty table gives no rows; all other columns are carried, whatever their names; columns named n_lines or n_dropped are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm.common import SPACES, masked, park, table, without

#: Boilerplate lines are broadcast, gathered by host, up to this many rows (16 bytes a line); beyond it hits are joined by document.
BROADCAST_ROWS = 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_word(line: Column) -> Column:
    return F.length(without(line, SPACES)) > 0


def _host(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h:"), host), F.lit("null"))


def _page_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """One row (host, key) per page and distinct line with a word."""
    lines = F.array_distinct(F.filter(_lines(F.col("_text")), _has_word))
    return docs.select(*keep, "_host", F.explode(lines).alias("line")).select(*keep, "_host", F.unhex(F.md5("line")).alias("key"))


def boilerplate(docs: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(_host, key) of the lines to drop, from docs(_host, _text)."""
    pages = docs.groupBy("_host").agg(F.count("*").alias("total"))
    counts = _page_lines(docs).groupBy("_host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(pages, "_host").where(F.col("n") > ratio * F.col("total")).select("_host", "key")


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 4,
               broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with its text cleaned, and n_lines, n_dropped (long)."""
    plain, names = masked(docs)
    inner = {outer: c for c, outer in names.items()}
    cleaned = _cleaned(plain, inner[host], inner[text], ratio, min_pages, broadcast_rows)
    return cleaned.select(*[F.col(c).alias(outer) for c, outer in names.items() if outer not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def _cleaned(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int, broadcast_rows: int) -> DataFrame:
    keyed = docs.withColumns({"_host": _host(F.col(host)), "_text": F.col(text)})
    drop = park(boilerplate(keyed.select("_host", "_text"), ratio, min_pages))
    if drop.count() <= broadcast_rows:
        sets = drop.groupBy("_host").agg(F.collect_set("key").alias("_keys"))
        marked = keyed.join(F.broadcast(sets), "_host", "left")
    else:
        numbered = keyed.withColumn("_row", F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
        hits = (_page_lines(numbered, "_row").join(drop, ["_host", "key"]).groupBy("_row").agg(F.collect_set("key").alias("_keys")))
        marked = numbered.join(hits, "_row", "left").drop("_row")
    stays = lambda line: ~F.array_contains("_keys", F.unhex(F.md5(line))) | ~_has_word(line)
    kept = F.when(F.col("_keys").isNull(), _lines(F.col("_text"))).otherwise(F.filter(_lines(F.col("_text")), stays))
    return (marked.withColumn("_kept", kept)
            .withColumns({text: F.when(F.col("_keys").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")),
                          "n_lines": F.coalesce(F.size(_lines(F.col("_text"))), F.lit(0)).cast("long")})
            .withColumn("n_dropped", F.greatest(F.lit(0), F.col("n_lines") - F.greatest(F.lit(0), F.size("_kept"))).cast("long"))
            .withColumn("n_lines", F.greatest(F.lit(0), F.col("n_lines")).cast("long"))
            .drop("_host", "_text", "_keys", "_kept"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, by source: counts and the cleaned text."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", "text")


_SQL = r"""
WITH d AS (SELECT *, coalesce('h:' || source, 'null') AS host FROM {docs}),
l AS (SELECT host, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM d),
c AS (SELECT host, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY host, line HAVING count(*) >= 4),
b AS (SELECT host, list(line) AS lines FROM c JOIN (SELECT host, count(*) AS total FROM d GROUP BY host) USING (host)
      WHERE n > 0.05 * total GROUP BY host)
SELECT d.*, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
  coalesce(len(list_filter(string_split(text, chr(10)), lambda x: list_contains(lines, x))), 0)::BIGINT AS n_dropped,
  CASE WHEN lines IS NULL THEN text
       ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(lines, x)), chr(10)) END AS cleaned
FROM d LEFT JOIN b USING (host)
"""


def clean_sql(docs: str) -> str:
    return _SQL.replace("{docs}", docs)


ORACLE = f"SELECT doc_id, source, n_lines, n_dropped, cleaned AS text FROM ({clean_sql('documents')})"
