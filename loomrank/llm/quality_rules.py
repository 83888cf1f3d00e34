"""Operator 7: quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Column that is true where the rule rejects. On a sample, every rule's cost (seconds to
evaluate it alone) and selectivity (share it rejects) are measured; the cascade then tests rules in
order of rejections per second. The verdict is one CASE expression, which Spark evaluates lazily:
a document costs the rules up to its first rejection. The order changes the time and the name of the
first failed rule, never the verdict.

Defined results: null or empty text has no words and fails the base rule; long texts cost n log n
(windows are compared by sorting, never by lists in maps); repeated rows are judged one by one; an empty
table gives an empty result in the declared rule order; other columns are carried or ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm.common import SPACES, bind, table, without, words_of

SYMBOLS = "#*$%&|<>"


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(without(x, SPACES)) > 0)
    return bind(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more: sort the windows, keep equal neighbours' positions, add up their spans."""
    def windows(w):
        return F.array_sort(F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("k"), i.alias("i"))))

    def repeated(s):
        return F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(
            (F.get(s, j)["k"] == F.get(s, j - 1)["k"]) | (F.get(s, j)["k"] == F.get(s, j + 1)["k"]), F.get(s, j)["i"])),
            lambda x: x.isNotNull()))

    def covered(p):
        return F.aggregate(p, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct(
            (i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"].cast("long"))

    return bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(
        bind(bind(windows(w), repeated), covered)))


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of the whole text."""
    text = F.coalesce("text", F.lit(""))
    n = lambda chars: F.length(text) - F.length(without(text, chars))
    return docs.withColumns({
        "n_words": bind(words_of(text), lambda w: F.size(w).cast("long")),
        "word_chars": F.length(without(text, SPACES)).cast("long"),
        "n_symbols": n(SYMBOLS).cast("long"),
        "n_dup_lines": _dup_lines(text),
        "n_repeat_words": _repeat_words(words_of(text)),
    })


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name -> rejects?, in declared order. Each rule is usable alone and needs `text` and the columns of features()."""
    text = F.coalesce("text", F.lit(""))
    share = lambda x, most: 1000 * x > most * F.col("word_chars")  # noqa: E731  thousandths of the word characters
    return {
        "symbols": share(F.col("n_symbols"), 80),
        "exclamations": share(F.length(text) - F.length(without(text, "!?")), 80),
        "no_letters": share(F.regexp_count(text, F.lit(r"[^\p{L}\s]")), 350),
        "capitals": share(F.regexp_count(text, F.lit(r"\p{Lu}")), 400),
        "word_length": (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
        "dup_lines": 10 * F.col("n_dup_lines") > 5 * (F.regexp_count(text, F.lit("\n")) + 1),
    }


def measured_order(sample: DataFrame, judged: dict[str, Column]) -> list[str]:
    """Rule names by rejections per second on the sample, best first; ties by name."""
    rows = sample.count()
    if not rows:
        return list(judged)

    def seconds(column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(column)).first()[0]
        return time.perf_counter() - began, hits

    seconds(F.lit(False))
    idle = seconds(F.lit(False))[0]
    score = {}
    for name, column in judged.items():
        spent, hits = seconds(F.coalesce(column, F.lit(False)))
        score[name] = (hits + 0.5) / rows / max(spent - idle, 0.001)
    return sorted(judged, key=lambda k: (-score[k], k))


def quality_rules(docs: DataFrame, sample_rows: int = 500, sample_share: float = 0.05, seed: int = 7) -> DataFrame:
    """docs with the features, base_failed, failed_rule (first in the measured order) and kept.

    sample_rows bounds the sample on which costs and selectivities are measured; it sets the order only.
    """
    judged = rules()
    ready = features(docs.select("text").sample(sample_share, seed).limit(sample_rows)).persist()
    order = measured_order(ready, judged)
    ready.unpersist()
    first = F.when(base_failed(), F.lit("base"))
    for name in order:
        first = first.when(judged[name], F.lit(name))
    return (features(docs).withColumn("base_failed", base_failed())
            .withColumn("failed_rule", first).withColumn("kept", F.col("failed_rule").isNull()))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table; failed_rule depends on measured costs and is left out."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: The features and the verdict of a relation {docs} that has doc_id and text.
FEATURES_SQL = r"""
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 1000 * n_symbols > 80 * word_chars
       OR 1000 * n_marks > 80 * word_chars OR 1000 * n_other > 350 * word_chars OR 1000 * n_caps > 400 * word_chars
       OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_dup_lines > 5 * n_lines) AS kept
FROM (
  SELECT *, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
    length(t) - length(regexp_replace(t, '[^\p{L}\x20\x09-\x0D]', '', 'g')) AS n_other,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_caps,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(string_split(t, chr(10))) AS n_lines,
    CASE WHEN len(words) < 4 THEN 0 ELSE (
      SELECT count(DISTINCT i + o) FROM (
        SELECT unnest(w3.at) AS i FROM (
          SELECT list(i) AS at FROM (SELECT i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS k
                                     FROM (SELECT unnest(range(1, len(words) - 1)) AS i)) GROUP BY k HAVING count(*) > 1) w3),
        (SELECT unnest([0, 1, 2]) AS o)) END::BIGINT AS n_repeat_words
  FROM (
    SELECT *, coalesce(text, '') AS t, {words} AS words,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM {docs}))
"""


def features_sql(docs: str) -> str:
    return FEATURES_SQL.replace("{words}", _WORDS).replace("{docs}", docs)


ORACLE = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({features_sql('documents')})
"""
