"""Feed documents, JSON-LD, addresses, excerpts, export and journal by hand-made cases."""

import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from loomrank.functions import net
from loomrank.functions import text as X
from loomrank.functions import urls as U
from loomrank.operators import scoring
from loomrank.plans.shared import ranked_within, shared_dir
from loomrank.sources import export, jsonld, messages, xmlfeeds
from loomrank.streaming.journal import Journal


def column(spark, values, kind, make):
    d = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["x"] for r in d.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_addresses(spark):
    public = ["8.8.8.8", "192.0.66.1", "172.32.0.1", "2606:4700::1111", "::ffff:8.8.8.8", "198.20.0.1", "100.128.0.1", "1:2:3:4:5:6:7:8"]
    private = ["10.0.0.1", "127.0.0.1", "169.254.1.1", "172.31.255.255", "192.168.0.1", "192.0.2.9", "198.19.1.1", "203.0.113.5", "224.0.0.1", "255.255.255.255", "::", "::1", "fd00::1", "fe80::1", "ff02::1", "2001:db8::1",
               "::ffff:10.0.0.1", "::ffff:7f00:1", "0x7f.1", "2130706433", "017700000001"]
    none = ["256.1.1.1", "1.2.3.4.5", "x", "", "1::2::3", "1:2:3:4:5:6:7", "12345::", "::ffff:300.1.1.1", None]
    assert column(spark, public + private + none, "string", net.is_public) == [True] * len(public) + [False] * (len(private) + len(none))


def test_outbound_urls(spark):
    cases = {
        "https://known.org/a": "ok", "HTTP://Known.org:8080/?q": "ok", "ftp://known.org": "blocked URL protocol: ftp:", "javascript:alert(1)": "blocked URL protocol: javascript:", "http://u:p@known.org/": "blocked URL containing credentials",
        "http://": "blocked URL without a hostname", "http://unknown.org/": "hostname did not resolve: unknown.org", "http://[::1]/x": "blocked non-public address for ::1: ::1", "http://2130706433/": "blocked non-public address for 2130706433: 2130706433",
        "http://mixed.org": "blocked non-public address for mixed.org: 10.0.0.1", "http://[zz]/": "invalid URL", "nonsense": "invalid URL", "http://8.8.8.8:99999/": "invalid URL", "http://8.8.8.8:53/": "ok", "http://1.2.3.4.5/": "invalid URL", None: "invalid URL"}
    known = lambda u: F.when(u.rlike("(?i)known.org") & ~u.contains("unknown"), F.array(F.lit("93.184.216.34"))).when(u.contains("mixed"), F.array(F.lit("8.8.8.8"), F.lit("10.0.0.1")))
    assert column(spark, list(cases), "string", lambda u: net.outbound_verdict(u, known(u))) == list(cases.values())
    assert column(spark, ["http://10.0.0.1/", "ftp://x"], "string", lambda u: net.outbound_verdict(u, known(u), allow_private=True)) == ["ok", "blocked URL protocol: ftp:"]


def test_jsonld(spark):
    deep = '{"@type":"7"}'
    for k in range(6, -1, -1):
        deep = f'{{"@type":"{k}","mainEntity":{deep}}}'
    docs = ['{"@graph":[{"@type":"A","mainEntity":{"@type":"B","publisher":"P"},"hasPart":[1,null,{"@type":"C","x":{"@type":"no"}}]},[{"@type":"D"}]],"publisher":{"name":"Q"}}', '"text"', "{broken", None, '[{"@type":"E"},{"@type":"F","author":{"name":1}}]', deep]
    d = spark.createDataFrame(list(enumerate(docs)), "i int, j string").select("i", F.try_parse_json("j").alias("v"))
    rows = jsonld.flatten(d, "i", "v").select("i", "place", "depth", jsonld.text_of(F.col("node"), "$['@type']").alias("t"), jsonld.publisher(F.col("node")).alias("p")).orderBy("i", "place").collect()
    assert [(r["t"], r["depth"], r["p"]) for r in rows if r["i"] == 0] == [(None, 0, "Q"), ("A", 2, None), ("C", 4, None), ("B", 3, "P"), ("D", 3, None)]
    assert [r["t"] for r in rows if r["i"] == 4] == ["E", "F"] and [r["t"] for r in rows if r["i"] == 5] == [str(k) for k in range(7)] and {r["i"] for r in rows} == {0, 4, 5}
    html = '<script type="text/javascript">{}</script><SCRIPT id=x type=\'application/ld+json\'>\n{"a":1}</SCRIPT>'
    assert column(spark, [html, None], "string", jsonld.scripts) == [['\n{"a":1}'], []]


RSS = """<?xml version="1.0"?><rss xmlns:itunes="q"><channel><title>F</title>
<item><title>A &amp; B</title><link>https://a.org/1</link><guid isPermaLink="false">g1</guid><description><![CDATA[<p>Hi</p>]]></description><pubDate>Wed, 19 Aug 2026 12:50:00 +0000</pubDate><author>m@x.org (Ann Lee)</author>
<enclosure url="" type="audio/mpeg"/><enclosure url="https://a.org/1.mp3" type="audio/mpeg" length="123"/><category>x</category><category>x</category><itunes:duration>1:02:03</itunes:duration></item>
<item><itunes:title>Two</itunes:title><guid>https://a.org/2</guid><itunes:summary>s2</itunes:summary><dc:date>2026-01-01</dc:date><dc:creator>12345</dc:creator><media:content url="https://a.org/2.png" type="image/png"/><dc:subject>z</dc:subject></item>
<item><title>bad<title></item><item></item>
<item><title>cut off</title><link>htt"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry xml:lang="en" xmlns="http://www.w3.org/2005/Atom"><title>T</title><link rel="self" href="https://s"/><link rel="enclosure" href="https://e.mp3" type="audio/mpeg" length="x"/><link rel="related" href="https://r"/>
<link href="https://a.org/t"/><id>i1</id><author><name>Bo &amp; Co</name></author><content:encoded>cc</content:encoded><category term="t" label="l"/></entry></feed>"""


def test_feed_documents(spark):
    d = spark.createDataFrame([("a", RSS), ("b", ATOM), ("c", None), ("d", ""), ("e", "<html>no feed</html>")], "source_id string, body string")
    got = {r["title"]: r for r in xmlfeeds.items(d).collect()}
    assert set(got) == {"A & B", "Two", "T"}
    a, two, t = got["A & B"], got["Two"], got["T"]
    assert (a["guid"], a["link"], a["summary"], a["author"], a["categories"], a["duration"]) == ("g1", "https://a.org/1", "<p>Hi</p>", "Ann Lee", ["x"], "1:02:03") and tuple(a["enclosure"]) == ("https://a.org/1.mp3", "audio/mpeg", 123)
    assert (two["guid"], two["link"], two["summary"], two["published"], two["author"], two["categories"], two["enclosure"]) == ("https://a.org/2", "https://a.org/2", "s2", "2026-01-01", None, ["z"], None)
    assert (t["link"], t["author"], t["content"], t["categories"]) == ("https://a.org/t", "Bo & Co", "cc", ["t", "l"]) and tuple(t["enclosure"]) == ("https://e.mp3", "audio/mpeg", None)
    assert xmlfeeds.nodes(d).where("node._corrupt IS NOT NULL").count() == 1


def test_clean_body_keeps_last_characters(spark):
    lines = ["Ontion in tishha orwh onaton reing reesst ndennt thheing whou. 4072374829496490", "\u3000 wide and narrow\u00a0 ", "\ttab stays"]
    got = spark.createDataFrame([("\n".join(lines),), (lines[0],), (" \u2003 \n",)], "t string").select(X.clean_body(F.col("t"))).collect()
    assert [r[0] for r in got] == [f"{lines[0]}\n\nwide and narrow\n\n{lines[2]}", lines[0], ""]


def test_structural_excerpt(spark):
    most = len(X.OMITTED) + 100
    texts = ["a" * 50 + "\n\n" + "b" * 200 + "\n\n" + "c" * 30, "x" * 300, "short", None, "", "a" * 20 + "\n\n" + "b" * 400]
    got = column(spark, texts, "string", lambda v: X.structural_excerpt(v, most))
    assert tuple(got[0]) == ("a" * 50 + X.OMITTED + "c" * 30, True, 204) and tuple(got[1]) == ("x" * 60 + X.OMITTED + "x" * 40, True, 200)
    assert [tuple(g) for g in got[2:5]] == [("short", False, 0), ("", False, 0), ("", False, 0)]
    # a break too early in the opening is no place to cut
    assert got[5]["text"].startswith("a" * 20 + "\n\n" + "b" * 38 + X.OMITTED)


def test_message_marks_bytes(spark):
    assert column(spark, ["é"], "string", lambda v: messages.untrusted("article", v)) == ["--- BEGIN UNTRUSTED ARTICLE DATA (2 BYTES) ---\né\n--- END UNTRUSTED ARTICLE DATA ---"]
    assert column(spark, ["transcript", "else"], "string", lambda v: messages.format_line(v, F.lit(None).cast("double"))) == ["📄 Transcript", "🎧 Alternate version"]


def test_default_ports(spark):
    assert column(spark, ["http://e.org:80/a", "https://e.org:80/a", "http://e.org:443/a", "https://e.org:8443/a", "HTTP://e.org:80"], "string", U.canonical) == [
        "https://e.org/a", "https://e.org:80/a", "https://e.org/a", "https://e.org:8443/a", "https://e.org/"]


def test_quality_mean_skips_missing(spark):
    d = spark.createDataFrame([(1.0, None), (None, None), (.5, 1.0)], "a double, b double")
    assert [r[0] for r in d.coalesce(1).select(scoring.quality_mean({"a": 1.0, "b": 3.0})).collect()] == [1.0, 0.0, pytest.approx(3.5 / 4)]


def test_ranks_within_groups(spark):
    rows = [(None if i % 7 == 0 else f"g{i % 3}", (i * 37) % 11, i) for i in range(200)]
    got = {r["i"]: (r["rn"], r["n"]) for r in ranked_within(spark.createDataFrame(rows, "g string, v int, i int"), "g", F.desc("v"), "i").collect()}
    for g in {r[0] for r in rows}:
        own = sorted((-v, i) for k, v, i in rows if k == g)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(1, len(own) + 1)]


def test_export_replaces_as_a_whole(spark):
    folder = f"{shared_dir(spark)}/site-{uuid.uuid4().hex}"
    docs = lambda *rows: spark.createDataFrame(list(rows), "name string, body string")
    read = lambda: {r["name"]: (r["body"], r["bytes"]) for r in export.exported(spark, folder).collect()}
    export.export_static(docs(("a.xml", "old"), ("gone.xml", "x")), folder)
    export.export_static(docs(("a.xml", "né\nw"), ("b c/d.json", "{}")), folder)
    assert read() == {"a.xml": ("né\nw", 5), "b c/d.json": ("{}", 2)}
    broken = docs(("a.xml", "1")).withColumn("body", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        export.export_static(broken, folder)
    assert read()["a.xml"] == ("né\nw", 5)


def test_journal_and_listener(spark):
    folder = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    journal = Journal(spark, folder)
    with pytest.raises(KeyError), journal.job("bad"):
        raise KeyError("k" * 3000)
    with journal.job("good") as job:
        job.add(note="n")
        job.observe(spark.range(50), "seen", top=F.max("id")).write.format("noop").mode("overwrite").save()
    jobs = {r["kind"]: r for r in journal.jobs().collect()}
    assert (jobs["bad"]["status"], len(jobs["bad"]["error"])) == ("failed", 2000) and json.loads(jobs["good"]["stats"]) == {"note": "n", "seen": {"rows": 50, "top": 49}}
    assert all(r["finished_at"] >= r["started_at"] for r in jobs.values())
    spark.range(30).write.parquet(f"{folder}/in")
    listener = journal.listener("stream")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(f"{folder}/in").observe("counts", F.count(F.lit(1)).alias("n"))
        stream.writeStream.format("noop").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            done = journal.jobs().where("kind = 'stream'").collect()
            if done:
                break
            time.sleep(.2)
    finally:
        spark.streams.removeListener(listener)
    assert len(done) == 1 and json.loads(done[0]["stats"]) == {"batch": 0, "rows": 30, "counts": {"n": 30}}
