"""Operators on pages and vectors against brute force, and their defined edge cases."""

import base64
import hashlib
import html
import re

import duckdb
import numpy as np
import pytest
from larkspan.llm import bit_sliced, html_text, url_filter, warc
from larkspan.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, digest string, rank int"


def edge_pages(spark):
    rows = [(3, "http://a.org/x", "<p>same</p>"), (1, None, "<p>same</p>"), (1, None, "<p>same</p>"), (2, "no scheme", None), (5, "://", ""), (None, "HTTP://B.Com/de/1?x=1", "<p>same</p>"), (7, "http://x.example.org/en/17\r\nX: y", "é" * 300_000), (None, "http://q.net", "alone")]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)


def key(row):
    return [(x is None, x) for x in row]


def expected_records(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in payloads:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in payloads:
        revisit = p in first and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=key)


def got_records(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=key)


def test_warc_round_trip(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert got_records(QUERIES["op3_warc"](spark, sf)) == expected_records(rows)
    pages = edge_pages(spark)
    assert got_records(warc.round_trip(pages)) == expected_records([(r.page_id, r.html) for r in pages.collect()])
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("compress", ["true", "false"])
def test_warc_filters_and_small_files(spark, tmp_path, compress):
    spark.dataSource.register(warc.WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = [("response" if i % 3 else "resource", f"urn:{i}", f"http://x/{i}", None, None, None, bytes([i]) * (i * 1000)) for i in range(40)]
    spark.createDataFrame(rows, warc.SCHEMA).repartition(2).write.format("warc").option("compress", compress).option("file_bytes", 2000).mode("append").save(str(tmp_path))
    back = spark.read.format("warc").option("split_bytes", 4000).load(str(tmp_path))
    assert back.rdd.getNumPartitions() > 2
    assert {(r.record_id, r.payload_length, bytes(r.payload)) for r in back.collect()} == {(f"urn:{i}", i * 1000, bytes([i]) * (i * 1000)) for i in range(40)}
    assert {r.record_id for r in back.where("record_type = 'resource' and target_uri is not null").collect()} == {f"urn:{i}" for i in range(0, 40, 3)}
    assert back.where("record_type = 'revisit'").count() == 0


def test_skipped_blocks_are_not_kept():
    import io

    data = b"".join(warc.record({"record_type": k, "record_id": f"u:{n}", "target_uri": None, "payload_digest": None, "refers_to": None, "payload_length": None, "payload": b"p" * 200_000}, "1970-01-01T00:00:00Z") for n, k in enumerate(["resource", "response", "resource"]))
    found = list(warc.Source(io.BytesIO(data), False).records(lambda h: h["warc-type"] == "response"))
    assert len(found) == 1 and len(found[0][1]) > 200_000


URIS = ["http://x.org/a%20b", "http://x.org/100%25?q=%0A", "http://x.org/\u00e9?a=1&b=<c>", " spaced ", "two\nlines\r\n%41", "", "a: b: c", None]


def test_header_values_byte_for_byte(spark, tmp_path):
    spark.dataSource.register(warc.WarcDataSource)
    rows = [("resource", f"urn:{i}", uri, None, None, None, b"x") for i, uri in enumerate(URIS)]
    plain = warc.record(dict(zip(warc.HEADERS | {"payload_length": 0, "payload": 0}, rows[0])), "1970-01-01T00:00:00Z")
    assert b"\r\nWARC-Target-URI: http://x.org/a%20b\r\n" in plain and b"X-Escaped" not in plain
    spark.createDataFrame(rows, warc.SCHEMA).write.format("warc").mode("append").save(str(tmp_path / "mine"))
    back = spark.read.format("warc").load(str(tmp_path / "mine"))
    assert {r.record_id: r.target_uri for r in back.collect()} == {f"urn:{i}": uri for i, uri in enumerate(URIS)}
    # A standard record of another writer, and one of the older form with brackets.
    foreign = b""
    for uri in (b"http://x.org/100%25?q=%0A", b"<http://x.org/old%2F>"):
        foreign += b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: " + uri + b"\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "foreign.warc").write_bytes(foreign)
    back = spark.read.format("warc").load(str(tmp_path / "foreign.warc")).collect()
    assert [(r.target_uri, bytes(r.payload)) for r in back] == [("http://x.org/100%25?q=%0A", b"ok"), ("http://x.org/old%2F", b"ok")]


def test_top_k_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = [tuple(r) for r in QUERIES["op4_exact_topk"](spark, sf).collect()]
    assert sorted(got) == sorted(con.execute(SQL["op4_exact_topk"]).fetchall())


def test_top_k_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 256]) for i in range(-60, 300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)]
    odd = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, [1.0, 2.0]), (2050, [3.0, 4.0]), (None, [1.0] * 6), (2005, [])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, rank int")
    asks = F.col("vec_id") % 50 == 0
    got = sorted(map(tuple, bit_sliced.top_inner_products(vectors, asks).collect()))
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows] + [(2004, [256, 512]), (2050, [768, 1024])]
    assert got == brute_top(fine)
    assert bit_sliced.top_inner_products(vectors.limit(0), asks).count() == 0


def brute_top(rows):
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(rows) if n != at and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(want)


def test_top_k_of_large_components_and_repeated_rows(spark):
    """Components up to 2**31 / 256 and beyond, ids that occur twice, and sums that leave 64 bits."""
    rows = [(0, [2.0**23, 1.5]), (0, [-1.0, 2.0]), (1, [2.0**22, -(2.0**23)]), (2, [2.0**23, 1.5]), (2, [2.0**23, 1.5]), (3, [-(2.0**30), 0.25]), (50, [1.0, 1.0])]
    asks = F.col("vec_id") % 50 == 0
    schema = "vec_id long, embedding array<double>"
    got = sorted(map(tuple, bit_sliced.top_inner_products(spark.createDataFrame(rows, schema), asks).collect()))
    assert got == brute_top([(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows])
    for wide in ([2.0**40, 2.0**40], [2.0**60, 0.0]):
        with pytest.raises(Exception, match="64 bits"):
            bit_sliced.top_inner_products(spark.createDataFrame([(0, wide), (1, wide)], schema), asks).collect()


def brute_article(page):
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside)]
    return " ".join(p for p in parts if p)


def test_main_text_of_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op8_html_extraction"](spark, sf).collect():
        assert r.text == brute_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG_TEXT = "The cat is on the mat and it was there for a long time as the dog was out. " * 3


def test_block_rules():
    page = f"""<body><header><a href=x>Home</a></header><div class="cookie-notice">We use cookies on this site, and you can read more of it.</div>
    <div id=content><h2>Title &amp; more</h2><p>{LONG_TEXT}<p>Short&nbsp;one.<ul><li><a href=1>Link one</a><li><a href=2>Link two</a></ul></div>
    <form><p>{LONG_TEXT}</p></form><div class="comments"><p>{LONG_TEXT}</p></div><script>var a = "<p>{LONG_TEXT}</p>"</script><footer>{LONG_TEXT}"""
    text = html_text.main_text(page)
    assert text == f"Title & more {LONG_TEXT.strip()} Short one."
    assert html_text.main_text("<article><p>Tiny.</p></article><p>Other.</p>") == "Tiny."
    assert [html_text.main_text(x) for x in (None, "", "<p", "<nav>a</nav>", "<!-- x")] == [""] * 5


@pytest.mark.parametrize(
    "attributes",
    ['style="overflow:hidden"', 'aria-hidden="false"', 'title="hidden in a class=ad"', "data-href=/hidden/x", 'class="layout has-sidebar"', 'class="post tag-ads"', 'data-id="ad"', 'data-class="footer"', "id=no-comments"],
)
def test_attributes_that_keep_an_element(attributes):
    assert html_text.main_text(f"<div {attributes}><article {attributes}><p>Kept text.</p></article></div>") == "Kept text."


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', 'aria-hidden="true"', "class='x ad'", "class=site-footer", 'id="comment-list-2"', 'CLASS="Sidebar"', "role=navigation"])
def test_attributes_that_drop_an_element(attributes):
    assert html_text.main_text(f"<article><p>Kept.</p><div {attributes}>Gone.</div></article>") == "Kept."


def test_landmarks_are_kept_whatever_their_class():
    assert html_text.main_text('<main id="related"><article class="sidebar ad"><p>Kept.</p></article></main>') == "Kept."
    assert html_text.main_text("<article hidden><p>Gone.</p></article>") == ""


def test_other_languages_are_judged_by_length_and_links():
    text = "Съешь ещё этих мягких французских булок, да выпей чаю. " * 5
    page = f'<div><a href="/">Главная</a></div><div><p>{text}</p><p>{text}</p></div><div><a href="/x">{text}</a></div>'
    assert html_text.main_text(page) == " ".join([text.strip()] * 2)


def test_main_text_edges(spark):
    out = html_text.extract(edge_pages(spark))
    assert out.count() == 8 and out.where("text is null or n_chars is null").count() == 0
    assert html_text.extract(edge_pages(spark).limit(0)).count() == 0


def brute_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(t), t, v) for t, v in url_filter.RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, default=(0, None, None))[1:]


def test_url_rules(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op9_url_filters"](spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, (rule, verdict) = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_url_trees_on_held_out_hosts(spark, sf):
    pages = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/pages.parquet")
    hosts = url_filter.weak_labels(pages).withColumn("fold", __import__("pyspark").sql.functions.crc32("url") % 2)
    rows = url_filter.judged(pages, hosts.where("fold = 0").select("url", "label")).join(pages.select("page_id", "url"), "page_id").join(hosts.where("fold = 1").distinct(), "url")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    right, n = 0, 0
    for r in rows.collect():
        right += (r.score >= 0.5) == (r.label == 1)
        n += 1
    assert n > 500 and right / n > 0.95


def test_url_edges(spark):
    pages = edge_pages(spark)
    for labelled in (url_filter.weak_labels(pages), spark.createDataFrame([], "url string, label int")):
        rows = url_filter.judged(pages, labelled).collect()
        assert len(rows) == 8
        for r in rows:
            assert r.verdict in ("allow", "block") and r.host is not None and r.path is not None
    assert {(r.page_id, r.rule) for r in rows if r.rule} == {(3, "org/"), (None, "com/de/"), (7, "example.org/en/1")}
    assert url_filter.judged(pages.limit(0), labelled).count() == 0


def test_every_labelled_suffix_counts(spark, monkeypatch):
    # 100 suffixes of 4 URLs each, told apart by nothing but the suffix; few of them are trained on.
    rows = [(f"http://host.t{chr(97 + k // 10)}{chr(97 + k % 10)}/{i}", k % 2) for k in range(100) for i in range(4)]
    seen = []
    transform = url_filter.VectorAssembler.transform

    def spy(self, df, *args):
        seen.append(df)
        return transform(self, df, *args)

    monkeypatch.setattr(url_filter.VectorAssembler, "transform", spy)
    pages = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(rows)], "page_id long, url string")
    url_filter.judged(pages, spark.createDataFrame(rows, "url string, label int"), max_rows=60)
    rates = {r["suffix"]: r["f_suffix"] for r in seen[-1].select("suffix", "f_suffix").distinct().collect()}
    assert len(rates) == 100 and set(rates.values()) == {1 / 6, 5 / 6}


def test_bad_markup_takes_linear_time():
    import time

    for page in ("<" + "a" * 200_000, "<span>" * 100_000 + "text", "<p>" + "<a" * 100_000, "<b>x" * 50_000):
        started = time.time()
        html_text.main_text(page)
        assert time.time() - started < 2


def test_text_of_formulas_and_objects_stays():
    page = f"<article><p>{'The value of the sum that we have in the end is '*3}<math>x=2</math> and <canvas>a drawing</canvas> <object>or more</object> for all.</p></article>"
    text = html_text.main_text(page)
    assert "x=2 and a drawing or more for all." in text
