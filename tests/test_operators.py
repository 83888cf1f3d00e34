import os
import random
from collections import Counter
from functools import reduce
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from loomrank.functions import numbers as N
from loomrank.functions import text as X
from loomrank.functions import urls as U
from loomrank.operators import scoring, selection, stories
from loomrank.plans import analytics, registry
from loomrank.sources import feeds

from .oracle import TABLES, same


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column).first()[0]


@pytest.mark.parametrize(("url", "want"), [
    ("HTTP://www.Example.com/a//b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2"),
    ("//m.example.org", "https://m.example.org/"), ("example.net/x/", "https://example.net/x"), ("https://e.org:8443/#!/p", "https://e.org:8443/#!/p"),
    ("ftp://e.org/a", None), ("https://e.org/?ref=1", "https://e.org/")])
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonical(F.lit(url))) == want


def test_text_functions(spark):
    assert one(spark, X.strip_html(F.lit("<p>a &amp; b</p><script>x</script><!-- c --><br>d"))) == "a & b\n \nd"
    assert one(spark, X.truncate(F.lit("one two three four"), 11)) == "one two…"
    assert one(spark, X.tokenize(F.lit("The Café of Naïve robots"))) == ["cafe", "naive", "robots"]
    assert one(spark, X.language_verdict(F.lit("the cat of the house and the dog is in that"), F.lit("en")))["verdict"] == "english"
    assert one(spark, X.language_verdict(F.lit("whatever"), F.lit("de-AT")))["language"] == "de"
    assert one(spark, X.named_entities(F.lit("Acme Corp met NASA in Paris"))) == ["acme corp", "nasa", "paris"]


def test_numbers(spark):
    assert one(spark, N.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, N.clock_minutes(F.lit("1:30:00"))) == 90
    assert one(spark, N.iso_minutes(F.lit("PT1H5M"))) == 65
    assert [one(spark, N.score(F.lit(x))) for x in ("85%", "0.7", "150", "x")] == [.85, .7, 1.0, 0.0]


def test_score_is_monotonic_and_bounded(spark):
    rows = [(i, "s", i // 3, f"title {i} analysis", "text", None, 0, "article", .5, .1, 1.0, None, i / 50, .1, .2, .7, .5, 30) for i in range(50)]
    d = spark.createDataFrame(rows, "item_id long, source_id string, cluster_id long, title string, summary string, publication_time long, first_seen_at long, feed_type string, quality_prior double, "
                              "exploration_floor double, volume_budget double, category_prior double, anchor_mean double, avoid double, nearest double, uniqueness double, discovery double, items_seen long")
    got = {r["item_id"]: r for r in scoring.free_score(d, 0, ["title"]).collect()}
    assert all(0 <= r["free_score"] <= 1 for r in got.values())
    assert all(got[i]["positive"] <= got[i + 1]["positive"] for i in range(49))


def brute_clusters(items, cut):
    parent = {}
    items = sorted(items)
    for k, (at, i, tokens) in enumerate(items):
        best = None
        for bt, j, other in items[:k]:
            union = tokens | other
            sim = len(tokens & other) / len(union) if tokens and other else 0.0
            hours = abs(at - bt) / 3_600_000
            conf = 0 if hours > 96 else max(.9, sim) if sim >= .62 else min(1, .30 * sim + .17 * (1 - hours / 96))
            if conf >= cut and (best is None or (round(conf, 9), -bt, -j) > best[0]):
                best = ((round(conf, 9), -bt, -j), j)
        parent[i] = parent[best[1]] if best else i
    return parent


@pytest.mark.parametrize("block", [1024, 7])
def test_nearest_equals_brute_force(spark, block):
    rng, hour = random.Random(9), 3_600_000
    rows = [(i, rng.randrange(600) * hour, [rng.uniform(-1, 1) for _ in range(8)] if i % 9 else None) for i in range(90)] + [(900, 50_000 * hour, [1.0] * 8), (901, 0, [0.0] * 8)]
    got = {r["item_id"]: r["nearest"] for r in stories.nearest(spark.createDataFrame(rows, "item_id long, at long, embedding array<double>"), block=block).collect()}
    norm = lambda v: sum(x * x for x in v) ** .5
    want = {}
    for i, at, v in rows:
        near = [sum(a * b for a, b in zip(v, w, strict=True)) / ((norm(v) * norm(w)) or 1) for j, bt, w in rows if v and w and i != j and abs(at - bt) <= 96 * hour]
        if near:
            want[i] = max(0.0, *near) if len(near) > 1 else max(0.0, near[0])
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_nearest_beside_broken_vectors(spark):
    """A vector with a value that isn't a number is like none; the others of its block keep their neighbours."""
    nan = float("nan")
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 1.0]), (3, 0, [nan, 1.0]), (4, 0, [0.0, 1.0])]
    got = {r["item_id"]: round(r["nearest"], 9) for r in stories.nearest(spark.createDataFrame(rows, "item_id long, at long, embedding array<double>")).collect()}
    assert got == {1: round(.5 ** .5, 9), 2: round(.5 ** .5, 9), 3: 0.0, 4: round(.5 ** .5, 9)}


@pytest.mark.parametrize(("block", "copies"), [(65536, 3), (65536, 60), (7, 20)])
def test_near_copies_equal_brute_force(spark, block, copies):
    """Copies and near copies of one vector, some out of the window, among unlike, broken and empty ones; more components than are compared first."""
    rng, hour, dims = random.Random(4), 3_600_000, 24
    draw = lambda: [rng.gauss(0, 1) for _ in range(dims)]
    base, other = draw(), draw()
    rows = [(i, rng.randrange(600) * hour, draw()) for i in range(80)]
    rows += [(100 + i, rng.randrange(0, 900, 7) * hour, [x + rng.gauss(0, .35) if i % 3 else x for x in base]) for i in range(copies)]
    rows += [(500, 0, other), (501, 96 * hour, [2 * x for x in other]), (502, 193 * hour, other), (503, 0, [0.0] * dims), (504, 0, [0.0] * dims), (505, 0, [float("nan")] * dims), (506, 0, None)]
    norm = lambda v: sum(x * x for x in v) ** .5
    known = [r for r in rows if r[2] and norm(r[2]) > 0]
    want = {}
    for i, at, v in known:
        near = [sum(a * b for a, b in zip(v, w, strict=True)) / (norm(v) * norm(w)) for j, bt, w in known if i != j and abs(at - bt) <= 96 * hour]
        if max(near, default=0) >= .94:
            want[i] = max(near)
    got = {r["item_id"]: r["nearest"] for r in stories.near_copies(spark.createDataFrame(rows, "item_id long, at long, embedding array<double>"), .94, block=block).collect()}
    assert got.keys() == want.keys() and {500, 501} <= got.keys() and 502 not in got
    assert all(.94 <= got[i] <= want[i] + 1e-9 for i in want)


def test_patterns_match_as_one_by_one(spark):
    """Patterns that begin with a letter are tried together, by that letter; what they match stays the same."""
    words = ["in", "1999", "part", "7", "a", "conversation", "with", "Q&A", "what", "gets", "right", "hands-on", "top", "10", "10 ways", "INTRODUCING", "unveiled", "raises", "$5", "xreport", "report", "é", "interviewé", "shocking", "?!", "\n"]
    rng = random.Random(8)
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(300)] + [None, ""]
    odd = {"odd": [r"\bab|cd", r"\bx?y", r"\be\(f|g\)", r"\b(k|l)m"]}
    for ps in (scoring.TYPE_PATTERNS | {"click": scoring.CLICKBAIT, "title": scoring.TITLE_PATTERNS} | odd).values():
        some = texts + ["cd", "xcd", "y", "g)", "zg)", "e(f", "km", "xkm"]
        each = reduce(lambda a, b: a | b, [F.col("t").rlike("(?i)" + p) for p in ps])
        d = spark.createDataFrame([(t,) for t in some], "t string").select("t", scoring.matches(F.col("t"), ps).alias("got"), each.alias("want"))
        assert [r for r in d.collect() if r["got"] != r["want"]] == []


def test_scores_travel_without_texts(spark, sf_dir):
    """What the free score takes from texts is read off before joins and ranks; either way gives the same score."""
    scored = analytics._scored(spark, sf_dir)
    assert not {"title", "summary"} & set(scored.columns)
    whole = scored.drop("text_type", "c_keyword", "p_clickbait").join(analytics._items(spark, sf_dir).select("item_id", "title", "summary"), "item_id")
    a, b = (sorted(scoring.free_score(d, analytics.NOW, analytics.INTERESTS).select("item_id", "free_score", "band", "editorial_type").collect()) for d in (scored, whole))
    assert a == b and len(a) > 0


def test_clusters_equal_brute_force(spark):
    rng, names = random.Random(3), ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    items = [(rng.randrange(200) * 3_600_000, i, frozenset(rng.sample(names, rng.randint(1, 4)))) for i in range(60)]
    d = spark.createDataFrame([(i, "s", " ".join(sorted(w)), "", None, at, None) for at, i, w in items],
                              "item_id long, source_id string, title string, summary string, url string, at long, embedding array<float>")
    got = {r["item_id"]: r["cluster_id"] for r in stories.clusters(d).collect()}
    assert got == brute_clusters(items, stories.CUT)


def candidate(i, **k):
    return SimpleNamespace(**({"item_id": i, "source_id": f"s{i % 3}", "cluster_id": i, "category": f"c{i % 2}", "score": 1 - i / 50, "duplicate_information": .1, "minutes": 5.0, "exploratory": False} | k))


def test_edition_caps():
    rows = [candidate(i) for i in range(30)]
    picks = selection.fill(rows, 10, 100, 4, .2, 0, {}, Counter())
    assert len(picks) == 8 and picks[0][0] == 0
    assert max(Counter(f"c{p[0] % 2}" for p in picks).values()) <= 4
    assert selection.fill(rows, 10, 12, 10, .2, 0, {}, Counter())[-1][1] == 4
    assert len(selection.fill([candidate(i, exploratory=i == 9) for i in range(10)], 3, 100, 9, .1, 1, {}, Counter())) == 3
    assert any(p[0] == 9 for p in selection.fill([candidate(i, exploratory=i == 9) for i in range(10)], 3, 100, 9, .1, 1, {}, Counter()))


def test_edition_whose_minutes_are_spent_ends(monkeypatch):
    """Rows that no longer fit are never picked: the picks are those of taking them off one by one, without a pass over all rows for each of them."""
    rng = random.Random(9)
    calls, plain = [], selection.multiplier
    monkeypatch.setattr(selection, "multiplier", lambda *a: calls.append(1) or plain(*a))
    for n in (60, 1500):
        rows = sorted((SimpleNamespace(item_id=i, source_id=f"s{rng.randrange(5)}", cluster_id=i // 3, category=f"c{rng.randrange(4)}", score=rng.randrange(20) / 20, duplicate_information=rng.random(),
                                       minutes=3.0 + i % 12, exploratory=rng.random() < .2) for i in range(n)), key=lambda r: (-r.score, r.item_id))
        calls.clear()
        got = selection.fill(rows, 8, 30, 3, .1, 1, {}, Counter())
        assert len(calls) <= 9 * n
        want, left, out = [], list(rows), set()
        while left:  # one by one: the first pick without those known not to fit
            one = selection.fill([r for r in left if r.item_id not in out], 8, 1e9, 3, .1, 1, {}, Counter())
            spent, late = 0.0, None
            for item, _, _ in one:
                r = next(r for r in left if r.item_id == item)
                if spent + r.minutes > 40:
                    late = item
                    break
                spent += r.minutes
            want = [i for i, _, _ in one]
            if late is None:
                break
            out.add(late)
        assert [i for i, _, _ in got] == want


def test_pruned_edition_equals_whole(spark):
    rng = random.Random(5)
    rows = [("f", i, f"s{rng.randrange(4)}", i % 40, f"c{rng.randrange(3)}", rng.random(), rng.random(), 5.0, rng.random() < .2) for i in range(300)]
    d = spark.createDataFrame(rows, "feed string, item_id long, source_id string, cluster_id long, category string, score double, duplicate_information double, minutes double, exploratory boolean")
    feed = {"feed": "f", "cap": 8, "minutes": 60, "category_cap": 4, "min_score": .3, "protected": 1}
    whole = selection.fill(sorted((SimpleNamespace(**r.asDict()) for r in d.collect()), key=lambda r: (-r.score, r.item_id)), 8, 60, 4, .3, 1, {}, Counter())
    assert [(r["item_id"], r["place"]) for r in selection.editions(d, [feed]).orderBy("place").collect()] == [p[:2] for p in whole]


def test_edition_sees_beyond_a_blocked_story(spark):
    """One source and category with 30 better rows of one story, of which only the first fits: the 31st must still be found."""
    rows = [("f", i, "s", 1 if i < 30 else i, "c", 1 - i / 100, .9, 5.0, False) for i in range(36)]
    d = spark.createDataFrame(rows, "feed string, item_id long, source_id string, cluster_id long, category string, score double, duplicate_information double, minutes double, exploratory boolean")
    picks = [r["item_id"] for r in selection.editions(d, [{"feed": "f", "cap": 3, "minutes": 60, "category_cap": 9, "min_score": .3, "protected": 0}]).orderBy("place").collect()]
    assert picks == [0, 30, 31]


def test_slots_and_audits(spark):
    rows = [(i, 1 - i / 100, "AABBCD"[i % 6]) for i in range(60)]
    got = {r["item_id"]: r for r in scoring.slots_and_audits(spark.createDataFrame(rows, "item_id long, free_score double, band string"), 25, 3, (("C", 1.0),)).collect()}
    able = [i for i, _, b in rows if b in "AB"]
    assert [i for i in sorted(got) if got[i]["selected"]] == able[:25] and all(got[i]["reason"] == "no_slot_left" for i in able[25:])
    assert [i for i in sorted(got) if got[i]["audit"]] == [i for i, _, b in rows if b == "C"][:3]


def test_entities_and_parameter_order(spark):
    row = spark.createDataFrame([("&#65;&#x41;&#38;lt; &amp;#65; &eacute; &#128512; &#1114112; &#xD800; &#0;", "http://www.e.org/a?b=2&a=1&b=1&utm_x=3&a")], "t string, u string")
    got = row.select(X.decode_entities(F.col("t")).alias("t"), U.canonical(F.col("u")).alias("u")).first()
    assert got["t"] == "AA&lt; &#65; é \U0001F600 &#1114112; &#xD800; &#0;" and got["u"] == "https://e.org/a?a=1&a=&b=2&b=1"


def test_entities_decode_in_one_pass(spark):
    row = spark.createDataFrame([("&lt&#59; &#38amp; &&#108;t; &AMP;lt; &unknown; &#x; &#; &", None, "")], "a string, b string, c string")
    assert tuple(row.select(*[X.decode_entities(F.col(c)) for c in "abc"]).first()) == ("&lt; &#38amp; &lt; &lt; &unknown; &#x; &#; &", None, "")


def test_entity_query_on_odd_titles(spark, sf_dir, tmp_path):
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    texts = ["", None, "\n", ". x", "\0 nul", "\U0001F600 smile", "e\u0301 comb", "a &lt;b&gt; c", "&#65; x", "x &amp;amp; &AMP; y", "&lt&#59; z", "&", "&#x41;", "$1 \\ x", "\u0080", "\U0010ffff"]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE d AS SELECT * FROM '{sf_dir}/documents.parquet' LIMIT 3")
    con.executemany("INSERT INTO d SELECT ?, ?, 'en', 'src1', 1", [(900000 + i, x) for i, x in enumerate(texts)])
    con.execute(f"COPY d TO '{tmp_path}/documents.parquet'")
    same(spark, registry.queries()["x1_entities"], registry.oracle_sql()["x1_entities"], str(tmp_path))


def test_hash_embedding_has_length_one(spark):
    toks = spark.createDataFrame([(1, "one"), (1, "two"), (1, "one"), (2, "x")], "k long, tok string")
    got = N.hash_embedding(toks, "k", "tok").groupBy("k").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(got) == 2 and all(abs(r["n"] - 1) < 1e-9 for r in got)


def test_allocation_reserves_audits():
    rows = [SimpleNamespace(item_id=i, source_id="s", category="c", opportunity=.9 - i / 100, audit=i == 30) for i in range(31)]
    out = selection.spend(rows, 10, .3, 1)
    assert out[0][0] == 30 and len(out) == 10


def test_feed_parsing():
    rss = '<rss><channel><item><title>A</title><link>https://e.org/1</link><enclosure url="u.mp3" type="audio/mpeg"/></item><item><title>B'
    got = feeds.parse_feed(rss)
    assert [g["title"] for g in got] == ["A"] and got[0]["enclosure_url"] == "u.mp3"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="x"/><link href="y"/><id>1</id></entry></feed>'
    assert feeds.parse_feed(atom)[0]["link"] == "y"
    assert feeds.parse_feed("<broken") == [] and feeds.parse_feed(None) == []
    assert feeds.first_object('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}'
    assert feeds.first_object('{"a": {"b": 1') == '{"a": {"b": 1}}'
    assert feeds.free_to_read('[{"@type":"NewsArticle","isAccessibleForFree":true},{"isAccessibleForFree":false}]') is True


def test_robots(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/c$", False), ("h", "/d*x", False)], "host string, pattern string, allow boolean")
    paths = spark.createDataFrame([("h", p) for p in ("/a/z", "/a/b/c", "/c", "/cc", "/d/1/x", "/q")], "host string, path string")
    assert {r["path"]: r["allowed"] for r in feeds.robots_allowed(rules, paths).collect()} == {"/a/z": False, "/a/b/c": True, "/c": False, "/cc": True, "/d/1/x": False, "/q": True}
