from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspan.operators import content as W
from larkspan.operators import textmatch as T
from larkspan.operators.joins import best_match, join_loss
from larkspan.streaming import alerts as ST


def brute_osa(a, b):
    """Plain full-matrix distance, written apart from the library's."""
    d = [[max(i, j) if min(i, j) == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_osa(a, b):
    assert T._osa(a, b) == brute_osa(a, b)


def test_osa_is_not_levenshtein(spark):
    df = spark.createDataFrame([("abcd", "acbd"), ("ca", "abc")], "a string, b string")
    assert [r[0] for r in df.select(T.osa_distance("a", "b")).collect()] == [1, 3]


def words(seed, n):
    import random

    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(n)})


@pytest.mark.parametrize("k", [1, 2])
def test_fuzzy_join_by_brute_force(spark, k):
    a, b = words(1, 80), words(2, 80)
    left = spark.createDataFrame([(i, w) for i, w in enumerate(a + a[:5])], "i int, name string")
    right = spark.createDataFrame([(i, w) for i, w in enumerate(b)], "j int, name string")
    want = sorted((i, j, brute_osa(x, y)) for i, x in enumerate(a + a[:5]) for j, y in enumerate(b) if brute_osa(x, y) <= k)
    assert rows(T.fuzzy_join(left, right, "name", k), "i", "j", "dist") == want


def test_fuzzy_join_of_long_and_odd_names(spark):
    long = "northwestern university of the arts and sciences"
    left = spark.createDataFrame([(1, long), (2, "école"), (3, None)], "i int, name string")
    right = spark.createDataFrame([(1, long.replace("ar", "ra", 1)), (2, long + "xy"), (3, long + "xyz"), (4, "ecole"), (5, None)], "j int, name string")
    out = T.fuzzy_join(left, right, "name", 2)
    assert rows(out, "i", "j", "dist") == [(1, 1, 1), (1, 2, 2), (2, 4, 1)]
    assert rows(best_match(out, ["i"], [F.col("dist"), F.col("j")]), "i", "j") == [(1, 1), (2, 4)]
    loss = join_loss(left, out, ["i"]).first()
    assert (loss["n_left"], loss["n_joined"], loss["unmatched"], loss["pct_keys"]) == (3, 3, 1, 33.33)


@pytest.fixture(scope="module")
def pages(spark):
    data = [
        (1, "Bayesian kickers", "points and posteriors", ["ana"], ["r", "bayes"], ["football"]),
        (2, "Names", "bayesian names by state", ["ben"], ["r"], ["names"]),
        (3, "Forecasts", "a forecast per group", ["ana"], ["spark"], ["football"]),
    ]
    return spark.createDataFrame(data, "id int, title string, content string, authors array<string>, tags array<string>, categories array<string>")


def test_search_scores(spark, pages):
    asked = spark.createDataFrame([("bayesian names",), ("football",), ("nothing",)], "q string")
    out = rows(T.search(pages, "id", asked, "q"), "q", "id", "score", "place")
    assert out == [("bayesian names", 1, 0.495, 2), ("bayesian names", 2, (0.2 + 0.99 + 0.2 + 0.5) / 2, 1), ("football", 1, 0.5, 1), ("football", 3, 0.5, 2)]


def test_fuzzy_search(spark, pages):
    asked = spark.createDataFrame([("bayesain",)], "q string")
    assert T.search(pages, "id", asked, "q").count() == 0
    assert rows(T.search(pages, "id", asked, "q", fuzzy=1), "id", "score") == [(1, round(0.99 * 7 / 8, 6)), (2, round(0.2 * 7 / 8, 6))]


def test_authors(spark):
    df = spark.createDataFrame([(1, ["b", "x", "a"]), (2, [])], "id int, authors array<string>")
    people = spark.createDataFrame([("a", "Ana"), ("b", "Ben")], "who string, name string")
    assert rows(W.resolve_authors(df, "id", "authors", people, "who", "name"), "id", "authors") == [(1, ["Ben", "x", "Ana"]), (2, [])]


def test_index(spark):
    df = spark.createDataFrame(
        [(1, False, False, "<b>given</b>", None, "x"), (2, True, False, "", None, "x"), (3, False, True, "", None, "x"), (4, None, None, "", "abs", "x"), (5, False, False, None, None, "one two three")],
        "id int, draft boolean, private boolean, summary string, abstract string, content string",
    )
    out = W.build_index([df.filter("id < 4"), df.filter("id > 2")], "id", summary_words=2)
    assert rows(out, "id", "summary") == [(1, "given"), (4, "abs"), (5, "one two")]


def test_term_weights(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["a", "a", "c"],)], "tags array<string>")
    import math

    out = dict((r["term"], r["weight"]) for r in W.term_weights(df, "tags", 2).collect())
    assert out == pytest.approx({"a": math.log(3) / math.log(4), "b": 0.0})


def test_related_by_brute_force(spark):
    import random

    rng = random.Random(4)
    data = []
    for i in range(150):
        tags = rng.sample("ABCDEFG", rng.randint(0, 5)) + (["hot"] if i % 3 else [])
        data.append((i, date(2020, 1, 1) + timedelta(days=rng.randint(0, 90)), tags, rng.sample(["x", "y", "Z"], rng.randint(0, 2))))
    df = spark.createDataFrame(data, "id int, day date, tags array<string>, categories array<string>")
    weights = {"tags": 100, "categories": 70}
    for threshold in (80, 50):
        want = []
        for i, _, t, c in data:
            own = 100 * len(t) + 70 * len(c)
            found = []
            for j, day, u, d in data:
                if i == j or own == 0:
                    continue
                low = lambda v: {x.lower() for x in v}
                score = (100 * len(low(t) & low(u)) + 70 * len(low(c) & low(d))) * 100 / own
                if round(score, 6) >= threshold:
                    found.append((-round(score, 6), -day.toordinal(), j))
            want += [(i, j, -s, n) for n, (s, _, j) in enumerate(sorted(found)[:5], 1)]
        got = rows(W.related(df, "id", "day", weights, threshold), "id", "related", "score", "place")
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in sorted(want)]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)])


def test_citation(spark):
    def text(short, venue, style):
        c = W.citation(F.array(F.lit("A"), F.lit("B")), F.lit(2021), F.lit("T"), F.lit(short), F.lit(venue), style)
        return spark.range(1).select(c).first()[0]

    assert text("", "Journal", "apa") == "A, B (2021). T. Journal."
    assert text("J", "Journal", "apa") == "A, B (2021). T. J."
    assert text(None, None, "mla") == "A, B. T. 2021."


def test_urls_take_the_newest_date(spark):
    df = spark.createDataFrame([("/a/", date(2020, 1, 1), ["My Tag"]), ("/b/", date(2021, 1, 1), ["my tag"])], "u string, d date, tags array<string>")
    assert rows(W.url_list(df, "u", "d", {"tags": "tags"})) == [("/a/", date(2020, 1, 1)), ("/b/", date(2021, 1, 1)), ("/tags/my-tag/", date(2021, 1, 1))]


def test_stream_equals_batch_over_several_arrivals(spark, tmp_path):
    source, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "player string, success boolean"
    parts = [[("a", True), ("b", False)], [("a", True)], [("a", False), ("c", True)]]
    for i, data in enumerate(parts):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(source)
        stream = ST.beta_stream(ST.stream_json(spark, source, schema), ["player"], "success")
        ST.run_available(ST.keep_updates(stream, sink), state)
    updates = spark.read.parquet(sink)
    streamed = rows(ST.latest_state(updates, ["player"]), "player", "alpha", "beta")
    batch = spark.createDataFrame([r for p in parts for r in p], schema)
    assert streamed == rows(ST.beta_stream(batch, ["player"], "success"), "player", "alpha", "beta") == [("a", 3, 2), ("b", 1, 2), ("c", 2, 1)]


def test_weekly_posteriors_across_restarts_gaps_and_repeats(spark, tmp_path):
    from larkspan.streaming.weekly import weekly_posteriors

    source, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "player string, ts timestamp, ok boolean"
    monday = datetime(2024, 1, 1)
    at = lambda week, day: monday + timedelta(days=7 * week + day)
    # Weeks 0 is the prior; b has no event in weeks 2 and 3; c comes late; week 1 gets an event out of order, in time for the delay.
    parts = [
        [("a", at(0, 1), True), ("a", at(0, 2), True), ("a", at(1, 3), False), ("b", at(1, 0), True)],
        [("a", at(2, 0), True), ("a", at(1, 6), True)],
        [("c", at(4, 2), False), ("a", at(3, 1), False)],
        [("b", at(5, 0), False), ("a", at(7, 3), True)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)
        for _ in range(2):  # the second run finds nothing new and must add nothing
            stream = weekly_posteriors(ST.stream_json(spark, source, schema), ["player"], "ts", "ok", date(2024, 1, 8), "2 days")
            ST.run_available(ST.keep_updates(stream, sink), state)
    got = rows(spark.read.parquet(sink), "player", "week", "successes", "failures", "alpha", "beta")
    events = [e for part in parts for e in part]
    expected = []
    for player in "abc":
        prior = [ok for p, ts, ok in events if p == player and ts < at(1, 0)]
        a0, b0 = max(sum(prior), 1), max(len(prior) - sum(prior), 1)
        for week in range(1, 7):  # the watermark ends at week 7, day 1
            seen = [ok for p, ts, ok in events if p == player and at(1, 0) <= ts < at(week + 1, 0)]
            s, f = sum(seen), len(seen) - sum(seen)
            expected.append((player, at(week, 0).date(), s, f, a0 + s, b0 + f))
    assert got == expected


def test_alert_stream_replaces_a_repeated_day(spark, tmp_path):
    source, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "day date, hour int, temp double, wind_speed double, status string"
    for day, temp in ((1, 60.0), (2, 20.0)):
        spark.createDataFrame([(date(2021, 5, day), 13, temp, 5.0, "Clear")], schema).write.mode("append").json(source)
        ST.run_available(ST.alert_stream(ST.stream_json(spark, source, schema), ["day"], sink), state)
    out = rows(spark.read.schema("message string, day date").json(sink), "day", "message")
    assert out == [
        (date(2021, 5, 1), "<p><b>1:00 PM:</b> 60F with wind at 5 mph and clear</p>"),
        (date(2021, 5, 2), "<p>No Times to Run Today!</p>"),
    ]


def test_alert_stream_keeps_a_day_that_arrives_in_parts(spark, tmp_path):
    source, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "day date, hour int, temp double, wind_speed double, status string"
    day = date(2021, 5, 1)
    # Two hours in two files, then a later reading of the first hour; a run without new files changes nothing.
    for hour, temp in ((14, 60.0), (15, 61.0), (14, 62.0), (None, None)):
        if hour:
            spark.createDataFrame([(day, hour, temp, 5.0, "Clear")], schema).write.mode("append").json(source)
        ST.run_available(ST.alert_stream(ST.stream_json(spark, source, schema, 1), ["day"], sink), state)
    lines = "<b>2:00 PM:</b> 62F with wind at 5 mph and clear<br/><b>3:00 PM:</b> 61F with wind at 5 mph and clear"
    assert rows(spark.read.schema("message string, day date").json(sink), "day", "message") == [(day, f"<p>{lines}</p>")]
