"""Inputs that once crashed an operator, or that it answered wrongly."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomrank.llm import exact_dedup, language_id, line_dedup, mixing, ngram_join, toxicity, url_filter


def test_helper_names_of_the_input_are_kept(spark):
    rows = [(i, "h", f"own {i}\nshared", "k", "t", "r", 5, 6) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, _keys string, _text string, _row string, size int, c1 int")
    for limit in (line_dedup.BROADCAST_ROWS, 0):
        got = line_dedup.line_dedup(d, ratio=.5, broadcast_rows=limit)
        assert got.columns == [*d.columns, "n_lines", "n_dropped"]
        assert {tuple(r) for r in got.collect()} == {(i, "h", f"own {i}", "k", "t", "r", 5, 6, 2, 1) for i in range(20)}
    m = d.withColumns({"_key": F.lit("a"), "_n": F.lit("b"), "_s": F.lit("c"), "taken": F.lit("gone")})
    got = mixing.mix(m)
    assert set(got.columns) == {*m.columns, "source_size", "target", "epochs"}
    assert all((r["_keys"], r["_row"], r["_key"], r["_n"], r["_s"], r["c1"], r["size"]) == ("k", "r", "a", "b", "c", 6, 3) for r in got.collect())


def test_language_of_a_few_bytes(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(30)] + [(100, "hoi jan", "nl"), (101, "", "xx")]
    content = language_id.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(content) == {"en", "nl"}
    alone = {"nl": content["nl"]}
    d = spark.createDataFrame([(1, "hoi jan"), (2, "the cat and the dog")], "doc_id long, text string")
    assert {r["lang_pred"] for r in language_id.predict(d, alone).collect()} == {"nl"}
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(d, content).collect()}[2] == "en"


def test_repeated_rows_meet_once(spark):
    rows = [(7, "same")] * 3000 + [(8, "same")] * 40 + [(i, f"own {i}") for i in range(100, 160)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = exact_dedup.exact_dedup(d, salts=2).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "same" if r["doc_id"] < 100 else f"own {r['doc_id']}"
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == ((8, 3040) if text == "same" else (r["doc_id"], 1)) + (hashlib.sha256(text.encode()).hexdigest(),)


def test_few_or_repeated_labelled_urls(spark):
    for urls in (["http://a.net/x"] * 300 + ["http://x.org/fr/a"] * 200, ["http://a.net/x"] * 3, ["http://b.example.com/q"] * 5 + ["http://a.net/x", "http://x.org/fr/a"]):
        d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        host, path = url_filter.host_and_path(F.col("url"))
        assert url_filter.judge(d).count() == len(urls)
        parts = d.select("url", host.alias("host"), path.alias("path"))
        labelled = parts.where("host <> 'b.example.com'").withColumn("blocked", F.col("host").endswith("net").cast("double"))
        assert url_filter.url_filter(parts, labelled, max_train_rows=1).count() == len(urls)


def test_url_trees_on_held_out_hosts(spark):
    """Spam by its looks, on hosts that training has not seen."""
    bad = [(f"http://w{i}.c{i}.com/{'9' * (i % 7 + 5)}/{i * 7919}?a=1&b={i}&c=3", 1.0) for i in range(400)]
    good = [(f"https://site{chr(97 + i % 26)}{chr(97 + i // 26)}.org/news/article-about-things", 0.0) for i in range(400)]
    d = spark.createDataFrame(bad + good, "url string, blocked double")
    host, path = url_filter.host_and_path(F.col("url"))
    d = d.select("url", host.alias("host"), path.alias("path"), "blocked")
    test = F.crc32("url") % 4 == 0
    got = url_filter.url_filter(d.where(test), d.where(~test)).collect()
    assert sum((r["verdict"] == "block") == (r["blocked"] == 1.0) for r in got) >= .95 * len(got) > 100


def test_penalty_spares_neutral_mentions(spark):
    """Toxic texts of the sample name one group often: without the penalty, its neutral mention scores as toxic."""
    rows = []
    for i in range(600):
        toxic = i % 2
        text = f"{'moron scum' if i % 3 else 'vile rat'}  refugees" if toxic else f"{hashlib.md5(str(i).encode()).hexdigest()} {'locals' if i % 9 == 0 else ''}"
        rows.append((i, text, toxic))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(i, f"we met {g} at the library") for i, g in enumerate(("refugees", "locals", "citizens", "muslime", "femmes"))], "doc_id long, text string")
    flagged = {}
    for swap in (0.0, 5.0):
        weights, b = toxicity.learn(d, swap=swap)
        flagged[swap] = toxicity.score(neutral, weights, b).where("score >= 0.5").count()
        worst = toxicity.score(spark.createDataFrame([(1, "moron scum"), (2, "vile rat")], "doc_id long, text string"), weights, b).agg(F.min("score")).first()[0]
        assert swap == 0 or worst > .5
    assert flagged[5.0] < flagged[0.0]


def test_templates_cover_terms_that_no_text_names(spark):
    pairs = [toxicity.counterfactuals(toxicity.words(t.format(term)), also_without=True) for t in toxicity.TEMPLATES for kind in toxicity.IDENTITY for term in kind]
    assert sum(1 for p in pairs for _ in p) >= len(toxicity.TEMPLATES) * sum(len(k) for k in toxicity.IDENTITY) * 2


def test_contracted_links_join_the_same_texts():
    rng = np.random.default_rng(5)
    chain = np.arange(3000)
    for a, b in ((chain[:-1], chain[1:]), (np.zeros(500, int), np.arange(1, 501)), (rng.integers(0, 400, 300), rng.integers(0, 400, 300)), (np.array([7]), np.array([-3]))):
        for held in (50, 10_000):
            links = pd.concat(ngram_join._contract(held)(pd.DataFrame({"a": a[k:k + 20], "b": b[k:k + 20]}) for k in range(0, len(a), 20)))
            assert (links["a"] > links["b"]).all()
            want, got = ({frozenset(g) for g in _joined(np.concatenate([a, b]), x, y)} for x, y in ((a, b), (links["a"], links["b"])))
            assert got == want
    one, other, root = ngram_join.forest(chain[:-1], chain[1:])
    assert set(root) == {0}
    assert len(one) == 2999 and np.bincount(other).max() == 8 and not list(ngram_join._contract()(iter(())))


def test_forests_are_merged_while_that_pays(spark):
    """A dense group that is dealt over all tasks, beside small ones: in the end one link fewer than texts a group."""
    rng = np.random.default_rng(6)
    a = np.concatenate([np.arange(1, 400).repeat(12), np.arange(1000, 1100, 2)])
    b = np.concatenate([rng.integers(0, 400, 399 * 12), np.arange(1001, 1101, 2)])
    b[:399 * 12:12] = np.arange(399)
    pairs = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "home": a % 7}).query("a != b"))
    for a_task, most in ((10_000, 399 + 50), (100, 399 * 12 + 50)):
        got = ngram_join.contracted(pairs, pairs.count(), a_task).toPandas()
        assert 399 + 50 <= len(got) <= most
        assert {frozenset(g) for g in _joined(np.concatenate([a, b]), got["a"], got["b"])} == {frozenset(g) for g in _joined(np.concatenate([a, b]), a, b)}


def _joined(ids, a, b):
    group = {i: {i} for i in ids.tolist()}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if group[x] is not group[y]:
            group[x] |= group[y]
            for i in group[y]:
                group[i] = group[x]
    return group.values()


def test_join_blocks_by_shingles(spark):
    """A component of long near-copies is cut by what its texts hold; no link is lost."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:200 + i] + [f"end{i}"])) for i in range(24)] + [(50, " ".join(words)), (51, " ".join(reversed(words)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    keep = lambda **k: sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(d, **k).collect())
    assert keep(block_shingles=700) == keep()
