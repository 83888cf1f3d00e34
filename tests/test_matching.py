"""Set joins, as-of joins, feedback and episode matching, and clustering, against plain Python."""

import os
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from loomrank.operators import matching, setjoin, stories
from loomrank.plans.matching import ORACLE, QUERIES
from loomrank.plans.shared import park, shared_dir
from loomrank.streaming import clusters

from .oracle import TABLES, same

H = 3_600_000


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("cut", [.3, .62, .75, 1.0])
def test_similar_sets(spark, cut):
    rng = random.Random(int(cut * 100))
    words = [f"w{int(rng.paretovariate(.7)) % 60}" for _ in range(400)]
    sides = [sorted({tuple(sorted(set(rng.sample(words, rng.randint(1, 9))))) for _ in range(150)}) for _ in range(2)]
    left, right = (spark.createDataFrame([("\x1f".join(s), list(s)) for s in side], "key string, tokens array<string>") for side in sides)
    got = sorted((r["left_key"], r["right_key"], r["jaccard"]) for r in setjoin.similar_sets(left, right, cut).collect())
    assert got == sorted(("\x1f".join(a), "\x1f".join(b), jaccard(a, b)) for a in sides[0] for b in sides[1] if jaccard(a, b) >= cut)


def test_as_of_joins(spark):
    rng = random.Random(3)
    events = [(rng.choice("abc"), rng.randint(-40, 40) * H // 2, i) for i in range(120)] + [("hot", 5 * H, i) for i in range(50)]
    asks = [(i, rng.choice(["a", "b", "c", "hot", "none"]), rng.randint(-60, 60) * H // 2) for i in range(200)]
    e, a = spark.createDataFrame(events, "key string, at long, id long"), spark.createDataFrame(asks, "ask long, key string, at long")
    up = {i: min(((t, n) for k, t, n in events if k == key and t >= at), default=(None, None)) for i, key, at in asks}
    down = {i: min(((-t, n) for k, t, n in events if k == key and t <= at), default=(None, None)) for i, key, at in asks}
    for hours in (1, 6, 500):
        assert {r["ask"]: (r["found_at"], r["found"]) for r in setjoin.first_from(a, e, hours).collect()} == up
        assert {r["ask"]: (None if r["found_at"] is None else -r["found_at"], r["found"]) for r in setjoin.last_until(a, e, hours).collect()} == down


def test_feedback_ladder(spark):
    published = [(1, "00000001", "Quiet harbours keep their lights burning", "https://a.org/x"), (2, "00000002", "Quiet harbours keep their lights burning", "https://www.a.org/x/?utm_source=q"),
                 (3, "00000003", "Short one", None), (4, None, "Wholly different words here today", "http://b.org/y")]
    entries = [(10, "anything", "https://r.org/open/00000003"), (11, "Wholly different words here today", "https://r.org/open/99999999"), (12, "x", "a.org/x/"), (13, "QUIET harbours: keep lights burning!", None),
               (14, "Short one", None), (15, "Quiet ships keep other lights", ""), (16, None, None), (13, "QUIET harbours: keep lights burning!", None)]
    got = matching.match_feedback(spark.createDataFrame(entries, "entry_id long, title string, link string"), spark.createDataFrame(published, "item_id long, ref string, title string, url string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(10, 3, "tracked_link"), (11, 4, "title"), (12, 1, "url"), (13, 1, "title"), (13, 1, "title"), (14, None, None), (15, None, None), (16, None, None)], key=repr)


def test_url_mentions(spark):
    urls = [(1, "https://example.com/a"), (2, "https://example.com/a/long/path/to/some/story-of-2024?page=2"), (3, "https://example.com/"), (4, "https://sub.example.org/b/"), (5, None), (6, "https://example.com/zz")]
    texts = ["see example.com/abc", "at https://web.archive.org/2020/https://example.com/a/long/path/to/some/story-of-2024?page=2&x=1 now", "notexample.com/zz", "(http://sub.example.org/b)", "example.com", "nothing", None, "", "example.com/z z"]
    got = {(r["item_id"], r["text_id"]) for r in matching.url_mentions(spark.createDataFrame(urls, "item_id long, url string"), spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")).collect()}
    bare = {i: u.removeprefix("https://").rstrip("/") for i, u in urls if u}
    want = {(i, k) for i, b in bare.items() for k, t in enumerate(texts) if t and b in t and "/" in b}
    # a host alone stands at label bounds
    assert got - {x for x in got if x[0] == 3} == want
    assert {k for i, k in got if i == 3} == {0, 1, 4, 8}


ARTICLE = "item_id long, source_name string, title string, url string, at long, first_seen_at long, embedding array<double>, enclosure_url string, enclosure_type string, minutes double"
EPISODE = "item_id long, source_name string, title string, description string, at long, embedding array<double>, url string, minutes double"


def test_copies_of_a_title_meet_by_vector_and_time(spark):
    """Copies of a title on both sides: only pairs with like vectors and no known distance over the window are made, and all of those."""
    rng = random.Random(11)
    rows = lambda n: [(i, "a\x1fb" if i % 5 else "x\x1fy\x1fz", rng.choice([None, rng.randrange(-300, 300) * H]), rng.choice([None, [1.0, 0.0], [.9, .3], [0.0, 1.0], [0.0, 0.0]])) for i in range(n)]
    a, e = rows(120), rows(90)
    got = matching._alike(spark.createDataFrame(a, "item_id long, a_key string, a_at long, a_vector array<float>"), spark.createDataFrame(e, "episode_id long, e_key string, e_at long, e_vector array<float>"))

    def like(u, v):
        size = (sum(x * x for x in u) * sum(x * x for x in v)) ** .5
        return size > 0 and sum(x * y for x, y in zip(u, v, strict=True)) / size >= .8

    want = sorted((i, k, 1.0) for i, s, t, u in a for k, z, w, v in e if s == z and u and v and like(u, v) and (t is None or w is None or abs(t - w) <= 96 * H))
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < 120 * 90 / 4


def test_episode_signals_and_alternates(spark):
    a = spark.createDataFrame([
        (1, "The Desk", "Seven rivers under one bridge", "https://d.org/seven", 100 * H, 0, [1.0, 0.0], "https://d.org/s.mp3", "audio/mpeg", 5.0),
        (2, "Other", "Nobody covers this topic anywhere", "https://o.org/nobody", None, 100 * H, None, "https://o.org/i.png", "image/png", None)], ARTICLE)
    e = spark.createDataFrame([
        (50, "Desk Podcast", "Seven rivers under one bridge", "listen: d.org/seven", 124 * H, [1.0, 0.0], "https://p.org/50", 30.0),
        (51, "Elsewhere", "Seven rivers under one bridge", "no link", 100 * H, [1.0, .1], "https://p.org/51", 31.0),
        (52, "Elsewhere", "Talk", "about https://o.org/nobody and more", 900 * H, None, "https://p.org/52", 32.0),
        (53, "The Other Show", "Nobody covers this topic anywhere", "o.org/nobody", None, None, "https://p.org/53", 33.0)], EPISODE)
    got = {(r["item_id"], r["episode_id"]): r["confidence"] for r in matching.match_episodes(a, e, least=.66).collect()}
    assert got == {(1, 50): pytest.approx(min(1, .45 + .3 + .2 + .3 + .15 * .75)), (1, 51): pytest.approx(.3 + .3 * (1 / 1.01 ** .5) + .15), (2, 53): pytest.approx(.95)}
    with pytest.raises(ValueError):
        matching.match_episodes(a, e, least=.6)
    links = spark.createDataFrame([(1, 0, "https://cdn.d.org/a.mp3", "audio_tag", None, None, 4.0), (1, 1, "https://youtu.be/x", "embed", None, None, None), (2, 0, "https://www.o.org/transcript", "structured_data", "T", "P", None), (2, 1, "", "audio_tag", None, None, None)],
                                  "item_id long, place int, url string, kind string, title string, publisher string, minutes double")
    found = matching.alternates(a, links, e)
    best = {(r["item_id"], r["format_type"]): (r["url"], round(r["confidence"], 3), r["episode_id"]) for r in found.collect()}
    assert best == {(1, "audio_version"): ("https://d.org/s.mp3", 1.0, None), (1, "podcast_version"): ("https://p.org/50", 1.0, 50), (1, "companion_podcast"): ("https://p.org/51", .749, 51),
                    (2, "transcript"): ("https://www.o.org/transcript", .8, None), (2, "podcast_version"): ("https://p.org/53", .95, 53)}
    published = spark.createDataFrame([(1, "a"), (50, "a"), (53, "b")], "item_id long, feed string")
    items = spark.createDataFrame([(1, "published"), (50, "published"), (51, "new"), (53, "new"), (60, "new")], "item_id long, status string")
    left, marked = matching.suppressed(found, published, items)
    assert sorted(r[0] for r in left.collect()) == [1, 53]
    assert {r["item_id"]: r["status"] for r in marked.collect()} == {1: "published", 50: "published", 51: "skipped_duplicate", 53: "new", 60: "new"}


def confidence(a, b):
    if a["url"] and a["url"] == b["url"]:
        return 1.0
    hours, title = abs(a["at"] - b["at"]) / H, jaccard(a["tokens"], b["tokens"])
    if hours > 96:
        return 0.0
    if title >= .62:
        return max(.9, title)
    near = 1 - hours / 96
    if not a["embedding"] or not b["embedding"]:
        return .55 * jaccard(a["entities"], b["entities"]) + .3 * title + .17 * near
    size = a["size"] * b["size"]
    cos = sum(x * y for x, y in zip(a["embedding"], b["embedding"], strict=True)) / size if size else 0.0
    same = a["source_id"] is not None and a["source_id"] == b["source_id"]
    return min(1.0, max(0.0, .83 * max(0.0, (cos - .45) / .55) + .17 * near - .17 * same))


def sequential(batches):
    """One item after the other against everything clustered so far."""
    known, cluster = [], {}
    for batch in batches:
        known.sort(key=lambda r: (r["at"], r["item_id"]))
        for a in sorted(batch, key=lambda r: (r["at"], r["item_id"])):
            best, of = 0.0, None
            for b in known:
                c = round(confidence(a, b), 12)
                if c >= .42 and c > best:
                    best, of = c, b["item_id"]
            cluster[a["item_id"]] = cluster[of] if of is not None else a["item_id"]
            known.append(a)
    return cluster


def story_rows(rng, n):
    rows = []
    for i in range(n):
        vector = [round(rng.gauss(0, 1), 1) for _ in range(3)] if rng.random() < .6 else None
        if vector and rng.random() < .05:
            vector = [0.0, 0.0, 0.0]
        rows.append({"item_id": i, "source_id": rng.choice(["a", "b", "c", None]), "url": rng.choice([None] * 8 + ["u1", "u2"]), "at": rng.randint(0, 60) * 5 * H,
                     "tokens": sorted({f"t{int(rng.paretovariate(.6)) % 25}" for _ in range(rng.randint(0, 5))}), "entities": sorted({f"e{int(rng.paretovariate(.6)) % 20}" for _ in range(rng.randint(0, 3))}),
                     "embedding": vector, "size": sum(x * x for x in vector) ** .5 if vector else None})
    return rows


PREPARED = "item_id long, source_id string, url string, at long, tokens array<string>, entities array<string>, embedding array<double>, size double"


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_sequential_comparison(spark, seed):
    """Also where later deliveries hold earlier items, which then meet stored ones on both sides in time."""
    rng = random.Random(seed)
    rows = story_rows(rng, 120)
    rng.shuffle(rows)
    batches = [rows] if seed == 1 else [rows[:50], rows[50:80], rows[80:]]
    state = None
    for batch in batches:
        new = stories.keyed(spark.createDataFrame(batch, PREPARED))
        found = park(new.join(stories.assign(new, state, checkpoint=park), "item_id"))
        state = found if state is None else park(state.unionByName(found))
    assert {r["item_id"]: r["cluster_id"] for r in state.collect()} == sequential(batches)


def test_link_counts_equal_sql(spark, sf_dir):
    same(spark, QUERIES["r23_same_story"], ORACLE["r23_same_story"], sf_dir)


def test_profiles_meet_only_in_reach_of_their_times(spark):
    """Half-alike entities, and one short title: pairs that no time brings to the cut are written nowhere, those that one does are counted."""
    items = [(i, "a", f"Harbour {'Lights' if i % 2 else 'Boats'}", f"Then Alpha{i} met Great Mountain.", None, i * 30 * H, None) for i in range(40)]
    items += [(100 + i, "b", f"Harbour {'Lights' if i % 2 else 'Boats'}", f"Then Alpha{i} met Great Mountain.", None, i * 30 * H + H, None) for i in range(0, 40, 4)]
    largest = []

    def counted(df):
        done = park(df)
        largest.append(done.count())
        return done

    df = spark.createDataFrame(items, "item_id long, source_id string, title string, summary string, url string, at long, embedding array<double>")
    got = {r["item_id"]: r["links"] for r in stories.link_counts(df, checkpoint=counted).collect()}
    rows = [r.asDict() for r in stories.prepare(df).collect()]
    assert got == {a["item_id"]: sum(confidence(a, b) >= .42 - 1e-9 for b in rows if a["item_id"] != b["item_id"]) for a in rows}
    assert max(largest) < 8 * len(items)


def test_no_search_of_a_batch_has_a_plan_that_fills_the_driver(spark):
    new = stories.keyed(spark.createDataFrame(story_rows(random.Random(1), 12), PREPARED))
    largest = []

    def counted(df):
        largest.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return park(df)

    stories.best_matches(park(new), park(new.where("false")), checkpoint=counted)
    assert max(largest) < 100


def test_cluster_batches_are_idempotent(spark):
    folder = f"{shared_dir(spark)}/stories-{uuid.uuid4().hex}"
    items = [(1, "a", "Harbour lights keep burning tonight", "", None, 0, [1.0, 0.0]), (2, "b", "Harbour lights keep burning tonight", "", None, 5 * H, None), (3, "a", "Unrelated matter altogether", "", None, 6 * H, [0.0, 1.0])]
    more = [(2, "b", "Changed since", "", None, 5 * H, None), (4, "c", "Harbour lights keep burning tonight", "", None, 2 * H, None), (4, "c", "Harbour lights keep burning tonight", "", None, 2 * H, None), (5, "c", "Old one", "", None, -900 * H, None)]
    schema = "item_id long, source_id string, title string, summary string, url string, at long, embedding array<double>"
    for batch, rows in ((0, items), (1, more), (1, more)):
        clusters.cluster_batch(spark.createDataFrame(rows, schema), folder, batch, park, late_hours=192)
    got = {r["item_id"]: (r["cluster_id"], r["match"]) for r in clusters.stored(spark, folder).collect()}
    assert got == {1: (1, None), 2: (1, 1), 3: (3, None), 4: (1, 1)} and clusters.stored(spark, folder).count() == 4
    clusters.cluster_batch(spark.createDataFrame([], schema), folder, 2, park)
    assert clusters.stored(spark, folder).where(F.col("cluster_id").isNull()).count() == 0


def test_a_first_delivery_has_no_stored_side(spark, monkeypatch):
    folder, sides, assign = f"{shared_dir(spark)}/stories-{uuid.uuid4().hex}", [], stories.assign
    monkeypatch.setattr(stories, "assign", lambda new, old, *rest: sides.append(old is not None) or assign(new, old, *rest))
    schema = "item_id long, source_id string, title string, summary string, url string, at long, embedding array<double>"
    for batch in (0, 1):
        clusters.cluster_batch(spark.createDataFrame([(batch, "a", "Harbour lights keep burning tonight", "", None, batch * H, None)], schema), folder, batch, park)
    assert sides == [False, True] and {r["item_id"]: r["match"] for r in clusters.stored(spark, folder).collect()} == {0: None, 1: 0}


def test_feedback_links_that_several_pages_share(spark, sf_dir, tmp_path):
    for t in TABLES:
        if t != "pages":
            os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE p AS SELECT * FROM '{sf_dir}/pages.parquet'")
    con.execute("INSERT INTO p SELECT page_id + 100000, url, html FROM p WHERE page_id % 2 = 0")
    con.execute(f"COPY p TO '{tmp_path}/pages.parquet'")
    same(spark, QUERIES["j12_feedback_match"], ORACLE["j12_feedback_match"], str(tmp_path))
