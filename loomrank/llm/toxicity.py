"""Operator 2: toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text and their prefixes of 4 to 7 letters (present or not; prefixes
stand for stems, which inflecting languages need). For each labelled sentence that names an identity
group, sentences with the term swapped for others of its kind are made, and the squared change of the
logit is penalised while fitting: neutral mentions of a group can't move the score. Beside the labelled sentences, every term stands in a few neutral
template sentences of its language (`templates`), swapped likewise and also left out; so the penalty covers terms that no labelled text mentions.

The model is fitted on the driver from a bounded sample of labelled rows (the max_train_rows different rows of the smallest
hash; at most `vocabulary` features; documented bounds). All their sentences and all swaps within a kind count: what the
driver gets of them is each different change of features with its number, which the executors add up. Only the weighted
marks go back to the executors, which score every whole text.

Defined results: null and empty texts score the intercept alone; without labelled rows, or with
one label only, every score is next to 0, or to 1 where that label is 1; repeated rows get equal scores; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm.common import ids_of, park, small_batches, table, whole_ids
from loomrank.llm.language_id import held_out

_LOG = logging.getLogger(__name__)

#: Identity terms by kind, in the languages of the corpus; a term may be swapped for any other of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "transgender", "cisgender"),
    ("immigrants", "refugees", "natives", "locals", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "asiáticos", "árabes", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
#: Neutral sentences that every term is put into. All languages serve all terms: what a sentence says beside the term is the same on both sides of a swap.
TEMPLATES = ("{} live in this town", "the talk about {} begins at noon", "we met {} at the library")
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if isinstance(text, str) else set()


def marks(found: set[str]) -> set[str]:
    """Words, and their stems written with a trailing hyphen."""
    return found.union(*({w[:k] + "-" for w in found if len(w) > k} for k in STEMS))


def sentences(text: str) -> list[set[str]]:
    """Word sets of sentences that name an identity group."""
    known = {t for kind in IDENTITY for t in kind}
    found = (words(x) for x in re.split(r"[.!?\n]+", text))
    return [x for x in found if x & known]


def counterfactuals(found: set[str], also_without: bool = False):
    """(words before, words after) of every swap of a term of a sentence for others of its kind, and for none."""
    for kind in IDENTITY:
        for term in sorted(found & set(kind)):
            for other in kind:
                if other != term:
                    yield found, found - {term} | {other}
            if also_without:
                yield found, found - {term}


def fit(rows: list[tuple[list[int], int]], swaps: list[tuple[list[int], list[int], int]], size: int,
        l2: float = 1e-3, swap: float = 5.0, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, intercept) from (marks present, label) rows and (marks gone, marks come, number) of swaps, by full-batch Adam."""
    y = np.array([label for _, label in rows], float)
    w = np.zeros(size, np.float32)
    if not len(y) or y.min() == y.max():
        return w, 40.0 if len(y) and y[0] else -40.0
    n, pos = len(y), y.sum()
    x = np.zeros((n, size), np.float32)
    for i, (at, _) in enumerate(rows):
        x[i, at] = 1
    # mean square of the changes in the logit, as a matrix of the features' changes
    gram = np.zeros((size, size), np.float32)
    for gone, come, times in swaps:
        at, sign = np.array(gone + come, int), np.array([1] * len(gone) + [-1] * len(come), np.float32)
        gram[np.ix_(at, at)] += times * np.outer(sign, sign)
    gram /= max(1, sum(times for _, _, times in swaps))
    b = float(np.log(pos / (n - pos)))
    balance = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        e = (balance * (p - y) / n).astype(np.float32)
        gw, gb = x.T @ e + l2 * w + 2 * swap * (gram @ w), float(e.sum())
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        r = rate * (1 - t / (steps + 1))
        w -= (r * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-6)).astype(np.float32)
        b -= r * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    return w, b


def learn(labelled: DataFrame, max_train_rows: int = 8000, vocabulary: int = 1500, least_chi2: float = 25.0, swap: float = 5.0,
          templates: tuple[str, ...] = TEMPLATES) -> tuple[dict[str, float], float]:
    """(weight by mark, intercept) from the max_train_rows rows of labelled(doc_id, text, toxic) with the smallest hashes; equal rows count once.

    Spark counts the marks of those rows by label; marks of three rows or more with a chi-squared of least_chi2 or more, the
    best `vocabulary` of them, and the identity terms are the features. The driver gets feature numbers only.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    label = (F.col("toxic") > 0).cast("int")
    hashed = labelled.where("toxic is not null").select("text", label.alias("label"), F.xxhash64("doc_id", "text", label).alias("_h"))
    # only hashes are sorted: the sample's texts never meet in one task
    last = hashed.select("_h").distinct().orderBy("_h").limit(max_train_rows).agg(F.max("_h")).first()[0]
    few = park(hashed.where(F.col("_h") <= F.lit(last).cast("long")).repartition(12, "_h").dropDuplicates(["_h"]))

    def tally(batches):
        for pdf in batches:
            seen, hits = Counter(), Counter()
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                found = marks(words(text))
                seen.update(found)
                if label:
                    hits.update(found)
            yield pd.DataFrame({"mark": list(seen), "m": list(seen.values()), "a": [hits[k] for k in seen]})

    n, pos = few.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    named = sorted({t for kind in IDENTITY for t in kind})
    m, a = F.col("m").cast("double"), F.col("a").cast("double")
    chi2 = F.pow(a * n - m * pos, 2) / (m * (n - m) + 1e-9) / (pos * (n - pos) + 1e-9) * n
    best = (few.select("text", "label").mapInPandas(tally, "mark string, m long, a long").groupBy("mark").agg(F.sum("m").alias("m"), F.sum("a").alias("a"))
            .where(F.col("m") >= 3).withColumn("chi2", chi2).where(F.col("chi2") >= least_chi2)
            .orderBy(F.desc("chi2"), "mark").limit(vocabulary))
    index = {k: i for i, k in enumerate(sorted({r["mark"] for r in best.select("mark").collect()} | set(named)))}

    def change(before: set[str], after: set[str]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        had, has = marks(before) & index.keys(), marks(after) & index.keys()
        return tuple(sorted(index[k] for k in had - has)), tuple(sorted(index[k] for k in has - had))

    def numbered(found: set[str]) -> list[int]:
        return sorted(index[k] for k in marks(found) & index.keys())

    def swaps(text):
        for s in sentences(text) if isinstance(text, str) else ():
            for before, after in counterfactuals(s):
                yield change(before, after)

    def gather(batches):
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["_h"], "label": pdf["label"], "at": [numbered(words(t)) for t in pdf["text"]]})

    def changes(batches):
        for pdf in batches:
            seen = Counter(c for t in pdf["text"] for c in swaps(t))
            if seen:
                yield pd.DataFrame({"gone": [list(g) for g, _ in seen], "come": [list(c) for _, c in seen], "times": list(seen.values())})

    got = few.select("_h", "label", "text").mapInPandas(gather, "h long, label int, at array<int>").collect()
    got.sort(key=lambda r: r["h"])
    swapped = (few.select("text").mapInPandas(changes, "gone array<int>, come array<int>, times long")
               .groupBy("gone", "come").agg(F.sum("times").alias("times")).collect())
    made = Counter(change(*pair) for t in templates for term in named for pair in counterfactuals(words(t.format(term)), also_without=True))
    every = sorted([(list(r["gone"]), list(r["come"]), r["times"]) for r in swapped] + [(list(g), list(c), n) for (g, c), n in made.items()])
    _LOG.info("%d labelled rows, %d features, %d swaps in their sentences and %d in templates", len(got), len(index), sum(r["times"] for r in swapped), sum(made.values()))
    w, b = fit([(r["at"], r["label"]) for r in got], every, len(index), swap=swap)
    return {k: float(w[i]) for k, i in index.items() if abs(w[i]) > 1e-4}, float(b)


def score(docs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """doc_id, held_out, score for docs(doc_id, text)."""
    def run(batches):
        for pdf in batches:
            z = [intercept + sum(weights[w] for w in sorted(marks(words(t)) & weights.keys())) for t in pdf["text"]]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
            yield pd.DataFrame({"doc_id": ids_of(pdf), "held_out": pdf["held_out"], "score": s})

    small_batches(docs.sparkSession)
    return whole_ids(docs.select("doc_id", held_out().alias("held_out"), "text")).mapInPandas(run, "doc_id long, held_out boolean, score double")


def toxicity(docs: DataFrame, labelled: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted for docs(doc_id, text), learned from labelled(doc_id, text, toxic)."""
    return (score(docs, *learn(labelled, **bounds))
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """doc_id, text, toxic of the documents that the `most` labels of the smallest hashes belong to, outside the held-out fold. Only ids are shuffled: texts are met where they lie."""
    known = (labels.where("toxic is not null").where(~held_out()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
             .join(docs.select("doc_id"), "doc_id", "left_semi"))
    few = known.orderBy(F.xxhash64("doc_id", "toxic"), "doc_id", "toxic").limit(most)
    # `most` rows of 12 bytes
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table; fitted on labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, labelled_sample(docs, table(spark, sf_dir, "labels")))
