"""Landing jobs on small generated files, and streams against their batch forms."""

import json
import lzma
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tapes, texts, trees
from tidemark.streaming import tapes as live


def test_tick_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1_700_000_000_123_000 + i * 500_000, "s", 1.5, 1.6, 1.55, 2.0, 1.0, 1.0) for i in range(5)], "seq long, ts_us long, symbol string, bid double, ask double, last double, volume double, bid_size double, ask_size double")
    tapes.write_ticks(rows, str(tmp_path / "t"))
    got = tapes.read_ticks(spark, str(tmp_path / "t"))
    assert sorted(map(str, got.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert tapes.interval_us(got).first().interval_us == 500_000 and tapes.read_ticks(spark, str(tmp_path / "t"), 2).count() == 2


def test_packed_files(spark, tmp_path):
    day = tmp_path / "raw" / "USDJPY" / "2024" / "00" / "05"
    day.mkdir(parents=True)
    raw = b"".join(struct.pack(">IIIff", 58 + i, 156225, 156219, 1.0, 2.0) for i in range(3)) + b"tail"
    (day / "07h_ticks.bi5").write_bytes(lzma.compress(raw, format=lzma.FORMAT_ALONE))
    (day / "08h_ticks.bi5").write_bytes(b"")
    got = tapes.read_tick_files(spark, str(day / "*_ticks.bi5")).orderBy("ts_us").collect()
    assert len(got) == 3 and (got[0].bid, got[0].ask) == (156.219, 156.225) and got[0].ts_us == 1704438000_058000
    bars = b"".join(struct.pack(">IIIIIf", 60 * i, 110000, 110001, 109999, 110002, float(i)) for i in range(2))
    eur = tmp_path / "raw" / "EURUSD" / "2024" / "11" / "31"
    eur.mkdir(parents=True)
    (eur / "BID_candles_min_1.bi5").write_bytes(lzma.compress(bars, format=lzma.FORMAT_ALONE))
    m = tapes.read_minute_files(spark, str(eur / "*.bi5")).orderBy("ts_us").collect()
    assert [(r.side, r.open, r.close, r.volume) for r in m] == [("bid", 1.1, 1.10001, 0.0), ("bid", 1.1, 1.10001, 1.0)] and m[0].ts_us == 1735603200_000000
    tapes.land(tapes.read_tick_files(spark, str(day / "*_ticks.bi5")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("symbol = 'USDJPY' and date = '2024-01-05'").count() == 3


def test_chart_and_rates(spark):
    j = {"chart": {"result": [{"meta": {"symbol": "E"}, "timestamp": [1, 2, 3], "indicators": {"quote": [{"open": [1.0, None, 2.0], "close": [1.5, 2.0, 0.0]}]}}]}}
    assert [tuple(r) for r in tapes.chart_bars(spark.createDataFrame([(json.dumps(j),)], "value string")).collect()] == [("E", 1_000_000, 1.0, 1.5)]
    lines = spark.createDataFrame([("﻿\"Series\",\"Six, month bill\",\"Fed funds\"",), ("Unit,x,y",), ("2020-01-02,1.5,ND",), ("2020-01-03,,1.6",)], "value string")
    got = tapes.rates(lines, {"Six, month bill": "6m", "Fed funds": "ff"}, F.col("value").contains("Series"))
    assert sorted((str(r.date), r.tenor, r.value) for r in got.collect()) == [("2020-01-02", "6m", 1.5), ("2020-01-03", "ff", 1.6)]
    a = spark.createDataFrame([("d", "t", 1.0)], "date string, tenor string, value double")
    b = spark.createDataFrame([("d", "t", 2.0), ("d", "u", 3.0)], "date string, tenor string, value double")
    assert sorted(r.value for r in tapes.merged_rates([a, b]).collect()) == [1.0, 3.0]


def test_posts_in_three_shapes(spark, tmp_path):
    a = {"status_id": "1", "text": "hi", "date_published": "2025-01-02T03:04:05Z", "original_url": "u"}
    b = {"post_id": "1", "article_body": "hi", "date_published": "2025-01-02T03:04:05Z", "url": "u"}
    (tmp_path / "a.jsonl").write_text(json.dumps(a) + "\n{broken\n" + json.dumps({"text": "no id"}) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([b]))
    (tmp_path / "c.csv").write_text("﻿status_id,text,date_published,original_url\n1,hi,2025-01-02T03:04:05Z,u\n")
    for name, form in (("a.jsonl", "jsonl"), ("b.json", "json"), ("c.csv", "csv")):
        got, counts = texts.read_posts(spark, str(tmp_path / name), form)
        assert [tuple(r) for r in got.select("id", "text", "url", "published").collect()] == [("1", "hi", "u", "2025-01-02T03:04:05Z")]
        assert counts.first()[:] == ((3, 1, 1) if form == "jsonl" else (1, 0, 0))


def test_feeds_and_maps(spark):
    xml = "<rss><channel><title>Channel</title><item><title><![CDATA[A &amp; <b>B</b>]]></title><pubDate>Wed, 29 Jul 2026 14:00:00 +0200</pubDate></item><item><title>no time</title></item></channel></rss>"
    atom = "<feed><entry><title>C</title><updated>2026-07-29T10:00:00Z</updated></entry></feed>"
    got = texts.feed_items(spark.createDataFrame([("r", xml), ("a", atom)], "source string, xml string"))
    assert sorted((r.source, r.title, str(r.ts)) for r in got.select("source", "title", F.col("ts").cast("string").alias("ts")).collect()) == [("a", "C", "2026-07-29 10:00:00"), ("r", "A & B", "2026-07-29 12:00:00")]
    m = spark.createDataFrame([("<sitemapindex><sitemap><loc>https://x/2026-W31.xml</loc><lastmod>2026-08-01</lastmod></sitemap><sitemap><loc>https://x/2026-W31.xml</loc></sitemap></sitemapindex>",)], "xml string")
    assert [tuple(r) for r in texts.sitemap_links(m).collect()] == [("https://x/2026-W31.xml", "2026-08-01", 2026, 31)]


def test_archive_and_calendar(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"d": "7/29/2026 2:00:00 PM", "t": "T", "s": "S", "l": "/a"}, {"d": "7/29/2026", "t": "U", "l": "/b"}, {"updateDate": "x"}]))
    rows, refused = texts.archive_index(spark, str(tmp_path / "i.json"), "press")
    assert [(r.title, r.link) for r in rows.collect()] == [("T", "/a")] and refused.first()[0] == 1
    snap = lambda day, f: texts.add_calendar(spark.createDataFrame([("CPI", "US", "t", f)], "title string, country string, ts string, forecast string"), str(tmp_path / "cal"), F.lit(day).cast("timestamp"))
    snap("2026-07-20", "1%")
    snap("2026-07-28", "2%")
    assert [r.forecast for r in texts.calendar(spark, str(tmp_path / "cal")).collect()] == ["2%"]


def test_pages(spark):
    html = '<html><head><meta property="og:title" content="M"><script type="application/ld+json">{"@type":"NewsArticle","headline":"H","datePublished":"2026-01-01T00:00:00.1234567Z","articleBody":"B","keywords":"a, b"}</script></head><body><article><p>' + "long enough paragraph of text " * 4 + "</p><p>short</p></article><table><tr><th></th><th>2026</th><th>Longer run</th></tr><tr><td>0.875</td><td></td><td>3</td></tr><tr><td>0.38 - 0.62</td><td>2</td><td> </td></tr></table></body></html>"
    p = spark.createDataFrame([(1, html), (2, '<title> T </title><meta content="D" name="og:description">')], "page_id long, html string")
    a = {r.page_id: r for r in texts.articles(p).collect()}
    assert (a[1].title, a[1].body, a[1].keywords, a[1]["from"]) == ("H", "B", ["a", "b"], "json-ld") and (a[2].title, a[2].body, a[2]["from"]) == ("T", "D", "meta")
    cells = texts.table_cells(p)
    assert cells.count() == 9 and cells.filter("text = ''").count() == 3
    assert sorted((r.year, r.level, r.n) for r in texts.histogram(cells).collect()) == [("2026", 0.5, 2), ("Longer run", 0.875, 3)]
    b = {r.page_id: r for r in texts.body_text(p).collect()}
    assert b[1].body.startswith("long enough") and b[2].short
    tree = '[{"node":"root","child":[{"tag":"p","child":{"node":"text","text":"x \\"y\\""}},[{"tag":"b","child":[{"node":"text","text":"z &nbsp; q"}]}],{"tag":"br"},7,"s",null]}]'
    t = spark.createDataFrame([("<p>a</p><div>b<br>c</div>",), (tree,), ("{}",), ("[1, 2",), (None,), ("",)], "body string")
    got = [r.text for r in texts.cms_text(t).collect()]
    assert sorted(map(str, got)) == sorted(["a\nb\nc", 'x "y"z q', "", "[1, 2", "None", ""])


def test_nested_articles(spark):
    ld = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    article = {"@type": ["X", "NewsArticle"], "headline": " A <b>bold</b>\n&amp; ", "datePublished": "2026-01-02T03:04:05.1234567Z", "articleBody": ["one", "two"], "keywords": ["k", " "], "articleSection": {"name": "fx"}}
    pages = {
        1: ld({"@graph": [{"@type": "WebSite", "headline": "no"}, {"@graph": [article]}]}), 2: ld([{"@type": "Article"}, dict(article, headline="second")]), 3: "<script type='application/ld+json'>{broken</script><title>t</title>",
        4: ld({"@type": "Article", "alternativeHeadline": "alt", "@graph": {"@type": "Article", "headline": "no list"}}), 5: ld({"@graph": [{"@graph": [dict(article, headline="deep")]}, dict(article, headline="near")]}),
    }
    got = {r.page_id: r for r in trees.linked_articles(spark.createDataFrame(list(pages.items()), "page_id int, html string")).collect()}
    assert {k: r.title for k, r in got.items()} == {1: "A bold &", 2: "second", 4: "alt", 5: "near"}
    assert got[1].body == "one two" and got[1].keywords == ["k"] and got[1].section == "fx"
    assert trees.linked_articles(spark.createDataFrame([], "page_id int, html string")).collect() == []


def test_balanced_containers(spark):
    inside = "word " * 50
    pages = [(1, f'<div class="a col-md-8 b"><div><DIV>{inside}</DIV> <p>and</p></div>tail</div><div>after</div>'), (2, '<div id="content">short<p>' + "a long enough paragraph of text, is it not so?" + "</p><p>we use a cookie, and this paragraph is long enough too</p>"), (3, None), (4, "<p>x</p>"), (5, "<div " * 3000), (6, f'<div id="article">{inside}For media inquiries, call</div>')]
    got = {r.page_id: r for r in trees.page_body(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert got[1].body == (inside + "and tail").replace("  ", " ") and not got[1].short
    assert got[2].body.startswith("short a long enough") and got[3].body == "" and got[4].body == "x" and got[6].body == inside.strip()
    one = lambda h: spark.range(1).select(trees.balanced(F.lit(h), "div", "(?i)<div[^>]*>")).first()[0]
    assert one("a<div>b<div>c</div>d</div>e") == "b<div>c</div>d" and one("a<div>b<div>c") == "b<div>c" and one("none") is None
    assert one("<div>" + "<div>x</div>" * 2000 + "y</div>z") == "<div>x</div>" * 2000 + "y"


def test_projection_rows(spark):
    head = "Range 1 Variable 2020 2021 2022 Longer run x Federal funds rate "
    texts_ = [head + "4 .1 .1 1.1 2.5 0.1 0.3 a March projection 1.0 2.0 2.4 9.9 b", head + "1.0 2.0 3.0 2.5 June projection 1.0 2.0 b", head + "1.0 2.0 b", "none", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "i int, t string").select("i", trees.projection_rows(F.col("t")).alias("r")).orderBy("i").collect()
    assert rows[0].r.medians == [0.1, 0.1, 1.1, 2.5] and rows[0].r.previous == [1.0, 2.0, None, 2.4] and rows[0].r.previous_label == "March"
    assert rows[1].r.previous == [1.0, None, None, 2.0] and [r.r for r in rows[2:]] == [None] * 3


def test_permission(spark):
    from tidemark.sources.permissions import permitted, robots_rules

    rules = spark.createDataFrame([("*", False, "/a"), ("*", True, "/a/ok"), ("*", False, "/*.pdf$"), ("bot", False, "/b"), ("*", True, "/t"), ("*", False, "/t")], "agent string, allow boolean, pattern string")
    p = spark.createDataFrame([("/a/x",), ("/a/ok/1",), ("/f.pdf",), ("/f.pdf?x",), ("/b/1",), ("/t",), ("/z",)], "path string")
    assert [r.allowed for r in permitted(p.withColumnRenamed("path", "u"), rules.withColumn("host", F.lit("h")), F.lit("h"), F.col("u")).orderBy("u").collect()] == [True, False, False, False, True, True, True]


def test_robots_of_many_hosts(spark):
    from tidemark.sources.permissions import permitted, robots_rules

    robots = [("a", "User-agent: X\nUser-agent: y # both\nDisallow: /p\nAllow: /p/ok\n\nUser-agent: z\nDisallow:\n"), ("b", "disallow: /lost\nUser-Agent: *\nDisallow: /"), ("c", None)]
    rules = robots_rules(spark.createDataFrame(robots, "host string, text string"))
    assert sorted(map(tuple, rules.collect())) == [("a", "x", False, "/p"), ("a", "x", True, "/p/ok"), ("a", "y", False, "/p"), ("a", "y", True, "/p/ok"), ("b", "*", False, "/")]
    pages = spark.createDataFrame([("a", "/p1"), ("a", "/p/ok"), ("a", "/q"), ("b", "/x"), ("c", "/x"), (None, "/p"), ("a", None)], "h string, u string")
    got = permitted(pages, rules, F.col("h"), F.col("u"), ("y", "*"))
    assert sorted(((r.h or "", r.u or ""), r.allowed, r.blocked_by) for r in got.collect()) == [(("", "/p"), True, None), (("a", ""), True, None), (("a", "/p/ok"), True, None), (("a", "/p1"), False, "y"), (("a", "/q"), True, None), (("b", "/x"), False, "*"), (("c", "/x"), True, None)]
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ohlcv(spark):
    b = spark.createDataFrame([("s", 0, 100.0, 110.0, 90.0, 110.0, 8.0, 4)], "symbol string, ts_us long, open double, high double, low double, close double, volume double, trades int")
    r = tapes.ohlcv_ticks(b).first()
    assert (r.ask - r.bid) / 110 * 1e4 == pytest.approx(25.0) and r.bid_size / r.ask_size == pytest.approx(19.0)


# ----------------------------------------------------------------- streams


def run(spark, tmp_path, batches, schema, make, mode="append", name="q"):
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("*.parquet"))
        part.rename(src / f"{i:03}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    run.late = live.late_rows(q)
    return spark.table(name).collect()


def at(s):
    from datetime import datetime, timedelta

    return datetime(2026, 1, 1) + timedelta(seconds=s)


def test_bars_stream_equals_batch(spark, tmp_path):
    schema = "symbol string, ts timestamp, ord long, price double, volume double, side string"
    rows = [("s", at(i * 0.4), i, 100.0 + i, 1.0, "b" if i % 3 else "s") for i in range(60)]
    got = run(spark, tmp_path, [rows[:30], rows[30:], [("s", at(500), 99, 1.0, 1.0, "b")], [("s", at(501), 99, 1.0, 1.0, "b")]], schema, live.trade_bars, name="bars")
    want = {r.start: tuple(r) for r in live.trade_bars(spark.createDataFrame(rows, schema)).collect()}
    assert {r.start: tuple(r) for r in got if r.start < at(400)} == want


def test_state_streams(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "symbol string, seq long, ts timestamp, day_volume double"
    rows = [("s", i, at(i), float(i % 7)) for i in range(20)]
    late = [("s", 100, at(-98), 5.0)]
    # out of order within and across batches; one row 98 s behind what others have passed
    batches = [rows[3:9][::-1], [*rows[:3], *rows[9:14]], [rows[15], rows[14], *rows[16:]], [("~", 0, at(500), 0.0)], [*late, ("~", 1, at(501), 0.0)]]
    got = [r for r in run(spark, tmp_path, batches, schema, live.live_volume, name="vol") if r.symbol == "s"]
    assert sorted((r.seq, r.traded) for r in got) == [(i, 0.0 if i % 7 == 0 else 1.0) for i in range(20)]
    assert run.late == 1 and {r.seq: r.ts for r in got}[7] == at(7)


def test_feature_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from tidemark.operators.features import tape_features

    schema = "symbol string, seq long, ts timestamp, bid double, ask double, volume double"
    rows = [("s", i, at(i), 100 + (i * 37 % 11) * 0.01, 100.02 + (i * 37 % 11) * 0.01, float(i % 5 + 1)) for i in range(150)]
    batches = [[*rows[:68], *rows[72:75]], [*rows[68:72], *rows[75:]], [("~", 0, at(900), 1.0, 1.0, 1.0)]]
    got = {r.ticks_seen - 1: r for r in run(spark, tmp_path, batches, schema, live.live_features, name="feat") if r.symbol == "s"}
    batch = spark.createDataFrame(rows, schema).select("symbol", "seq", F.unix_micros("ts").alias("ts_us"), "bid", "ask", F.col("bid").alias("last"), "volume", F.lit(1.0).alias("bid_size"), F.lit(1.0).alias("ask_size"))
    want = {r.seq: r for r in tape_features(batch).collect()}
    assert set(got) == set(want)
    for k in want:
        for c in ("mid", "ret_1_bps", "ret_5_bps", "vol_bps", "up_fraction", "volume_z", "drawdown_bps"):
            assert got[k][c] == pytest.approx(want[k][c], abs=1e-7)


def test_trigger_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "symbol string, seq long, ts timestamp, headline string, flow double"
    rows = [("s", i, at(i), "news" if i == 2 else None, 0.9 if i in (5, 10, 30, 60) else 0.0) for i in range(70)]
    # after an hour without rows the symbol starts anew: its flow trigger has no cooldown to wait for
    batches = [rows[:20], rows[20:], [("~", 0, at(9000), None, 0.0)], [("~", 1, at(9001), None, 0.0)], [("s", 71, at(9500), None, 0.9)], [("~", 2, at(20_000), None, 0.0)]]
    got = [r for r in run(spark, tmp_path, batches, schema, lambda x: live.stance_triggers(x, idle_ms=3_600_000), name="trig") if r.symbol == "s"]
    assert sorted((r.seq, r.why) for r in got) == [(2, "headline"), (5, "flow"), (30, "flow"), (60, "flow"), (71, "flow")]
    said = {r.seq: r.described for r in got}
    assert said[30].endswith("news)") and said[60].startswith("(no headline")


def test_upserts_count_a_repeated_batch_once(spark, tmp_path):
    schema = "symbol string, price double, size double, pnl double"
    one = live.running_stats(spark.createDataFrame([("s", 1.0, 2.0, 3.0)], schema))
    two = live.running_stats(spark.createDataFrame([("s", 1.0, 2.0, 3.0), ("s", 1.0, 2.0, -1.0), ("t", 1.0, 1.0, 1.0)], schema))
    put = live.upserts(str(tmp_path / "u"))
    for batch, number in ((one, 0), (two, 1), (two, 1)):
        put(batch, number)
    got = live.upserted(spark, str(tmp_path / "u"), two.schema, ["symbol"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, two.collect()))
    live.compacted(spark, str(tmp_path / "u"), str(tmp_path / "v"), two.schema, ["symbol"])
    assert sorted(map(tuple, live.upserted(spark, str(tmp_path / "v"), two.schema, ["symbol"]).collect())) == sorted(map(tuple, two.collect()))


def test_event_quotes(spark, tmp_path):
    q = spark.createDataFrame([("s", at(i), i, 1.0 + i, 2.0 + i) for i in range(10)], "symbol string, ts timestamp, seq long, bid double, ask double")
    e = spark.createDataFrame([(1, "s", at(4.5)), (2, "s", at(400))], "event_id long, symbol string, when timestamp")
    assert [(r.event_id, r.bid) for r in live.latest_quote(live.event_quotes(e, q)).collect()] == [(1, 5.0)]
    assert live.running_stats(spark.createDataFrame([("s", 1.0, 2.0, 3.0), ("s", 1.0, 2.0, -1.0)], "symbol string, price double, size double, pnl double")).first()[:] == ("s", 2, 4.0, 2.0, 0.5)
