from datetime import date

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspan.functions import names as N
from larkspan.functions import scalar as S
from larkspan.functions import text as X
from larkspan.operators import clean as C
from larkspan.operators import filters as W
from larkspan.sources import readers as R
from larkspan.sources import writers as Wr
from larkspan.sources.html import extract_records, html_tables
from larkspan.streaming.alerts import daily_message


def value(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cols.items()))
    return df.select(expr).first()[0]


def test_clean_names():
    assert [N.camel_to_snake(n) for n in ("IsHoliday", "Weekly Sales", "FGs Made", "a.b")] == ["is_holiday", "weekly_sales", "f_gs_made", "a_b"]
    assert [N.to_snake(n) for n in ("FGs Made", "FGs Made 20-29 Yards", "FG Percentage", "% x")] == ["f_gs_made", "f_gs_made_20_29_yards", "fg_percentage", "percent_x"]
    assert N.unique(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=8), max_size=6))
def test_names_stay_unique(given_names):
    assert len(set(N.unique(["n_2", *[N.to_snake(n) for n in given_names]]))) <= len(given_names) + 1


@pytest.mark.parametrize(
    "text,number", [("$1,234", 1234.0), ("45%", 45.0), ("-3.5 pts", -3.5), ("none", None), (None, None), ("$98,000.50", 98000.5)]
)
def test_parse_number(spark, text, number):
    assert value(spark, X.parse_number(F.col("c")), c=text) == number


@pytest.mark.parametrize(
    "raw,name",
    [
        ("No. 12 -- Horse Brass:", "Horse Brass"),
        ("<em> note</em>Bailey's &amp; Co", "Bailey's & Co"),
        ("BEST BARS", None),
        ("lower only", None),
        ("Crush: <em>since 2001</em>", "Crush"),
        ("", None),
    ],
)
def test_bar_names(spark, raw, name):
    assert value(spark, X.clean_bar_name(F.col("c")), c=raw) == name


@pytest.mark.parametrize(
    "raw,name,strict",
    [
        ("great falls college (x)", "gre", "great falls college"),
        ("texas a%26m - main", "texas a&m-main", "texas a&m-main"),
        ("school, or", "school", "school"),
        ("university at buffalo", "university", "university"),
    ],
)
def test_college_names(spark, raw, name, strict):
    assert value(spark, X.normalise_college(F.col("c")), c=raw) == name
    assert value(spark, X.normalise_college(F.col("c"), strict=True), c=raw) == strict


def test_text_helpers(spark):
    c = F.col("c")
    assert value(spark, X.swap_name(c), c="Tucker, Justin") == "Justin Tucker"
    assert value(spark, X.replace_first(c, "a", "$1"), c="banana") == "b$1nana"
    assert value(spark, X.replace_first(c, "z", "y"), c="banana") == "banana"
    assert value(spark, X.first_digits(c), c="TUC123456-7") == "123456"
    assert value(spark, X.first_digits(c), c="none") is None
    assert value(spark, X.to_feet(c), c="350 ft") == 350.0
    assert value(spark, X.to_feet(c), c="1.2 mi") == 6336.0
    assert value(spark, X.to_feet(c), c="far") is None
    assert value(spark, X.label_from_name(c), c="f_gs_made_20_29_yards") == "20-29"
    assert value(spark, X.label_from_name(c), c="f_gs_made_50_yards") == "50+"
    assert value(spark, X.drop_suffix(c, ", Portland, OR"), c="Bar, Portland, OR") == "Bar"
    assert value(spark, X.player_url("u/", c, F.lit("TuckJu")), c="Justin Tucker") == "u/T/TuckJu.htm"
    assert value(spark, X.truncate(c, 9), c="one two three") == "one two…"
    assert value(spark, X.truncate(c, 7), c="one two three") == "one two…"
    assert value(spark, X.snippet(c, F.lit("NEEDLE"), F.lit("none"), 3), c="hay hay needle hay") == "ay needle ha"
    assert value(spark, X.snippet(c, F.lit("pin"), F.lit("none"), 3), c="hay") == "none"


def test_hours(spark):
    out = spark.range(24).select(X.fmt_hour(F.col("id"))).collect()
    assert [out[i][0] for i in (0, 1, 9, 10, 12, 13, 19, 23)] == ["12:00 AM", "1:00 AM", "9:00 AM", "10:00 AM", "12:00 PM", "1:00 PM", "7:00 PM", "11:00 PM"]
    line = X.fmt_line(F.lit(13), F.lit(62.5), F.lit(3.5), F.lit("Clear"))
    assert spark.range(1).select(line).first()[0] == "<b>1:00 PM:</b> 62F with wind at 4 mph and clear"


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.clip(F.lit(None).cast("double"), 0, 1)) is None and get(S.clip(F.lit(5), 0, 1)) == 1
    assert get(S.flag(F.lit(None).cast("boolean"))) == 0
    assert get(S.floor_to(F.lit(1987), 10)) == 1980
    assert get(S.ratio(F.lit(1), F.lit(0))) is None
    edges, labels = [(1, 50), (51, 100), (401, None)], ["1 - 50", "51 - 100", "> 400"]
    assert [get(S.bucketize(F.lit(v), edges, labels)) for v in (50, 51, 200, 500)] == ["1 - 50", "51 - 100", None, "> 400"]
    fridays = get(S.anchored_dates(F.lit(date(2010, 2, 3)), F.lit(date(2010, 2, 25)), "W-FRI"))
    assert fridays == [date(2010, 2, 5), date(2010, 2, 12), date(2010, 2, 19)]
    assert get(S.anchored_dates(F.lit(date(2010, 2, 6)), F.lit(date(2010, 2, 11)), "W-FRI")) == []
    # 2021-05-21 20:00 UTC is 13:00 in Portland.
    assert get(S.local_hour(F.lit(1621627200), "US/Pacific")) == 13
    assert get(S.same_local_day(F.lit(1621580400 - 1), "US/Pacific", date(2021, 5, 21))) is False
    with pytest.raises(ValueError):
        S.anchored_dates(F.lit(date(2010, 1, 1)), F.lit(date(2010, 1, 1)), "M")


def hours(spark, data):
    return spark.createDataFrame(data, "day string, hour int, temp double, wind_speed double, status string")


def test_running_rules(spark):
    df = hours(spark, [("d", 13, 30.0, 30.0, "Clear"), ("d", 12, 60.0, 5.0, "Clear"), ("d", 15, 60.0, 5.0, "Rain")])
    assert [r["hour"] for r in W.match_rules(df, W.RUNNING).collect()] == [13]


def test_daily_message(spark):
    df = hours(spark, [("a", 14, 70.0, 5.0, "Clear"), ("a", 13, 60.0, 5.0, "Clouds"), ("b", 15, 60.0, 5.0, "Rain")])
    assert rows(daily_message(df, ["day"])) == [
        ("a", "<p><b>1:00 PM:</b> 60F with wind at 5 mph and clouds<br/><b>2:00 PM:</b> 70F with wind at 5 mph and clear</p>"),
        ("b", "<p>No Times to Run Today!</p>"),
    ]


def test_null_is_kept_by_exclusion(spark):
    df = spark.createDataFrame([("Unknown",), ("Ann",), (None,)], "name string")
    assert rows(W.exclude_values(df, "name", ["unknown"])) == [("Ann",), (None,)]


def test_radius_band_loses_nothing(spark):
    pts = spark.sql("SELECT id, 45.5 + (id - 50) / 1000 AS lat, -122.6 AS lng FROM range(101)")
    exact = pts.filter(S.earth_feet(F.lit(45.5), F.lit(-122.6), F.col("lat"), F.col("lng")) <= 15840)
    assert rows(W.within_radius(pts, "lat", "lng", 45.5, -122.6, 15840), "id") == rows(exact, "id")


def test_columns(spark):
    df = spark.createDataFrame([(1, "--", "3")], "id int, fg_made string, fg_attempted string")
    assert rows(C.fill_all(C.try_cast_like(df, "made|attempted", "double"), 0)) == [(1, 0.0, 3.0)]
    assert C.move_last(df, "id").columns == ["fg_made", "fg_attempted", "id"]
    assert C.select_like(df, [C.starts_with("fg")], ["made$"]).columns == ["fg_attempted"]
    frame = spark.createDataFrame([(1, "2010-02-05", 3.0, 9.0, 1.0)], "k int, d string, y double, cap_value double, floor_value double")
    assert C.to_model_frame(frame, ["k"], "d", "y").columns == ["k", "cap", "floor", "ds", "y"]
    assert C.to_model_frame(frame.drop("floor_value"), ["k"], "d", "y").columns == ["k", "ds", "y"]


def test_html(spark):
    page = (
        "<table><tr><th>Kind</th></tr><tr><td>x</td></tr></table>"
        "<table border='1'><tr><th>School</th><th>City</th></tr><tr><td><b>A</b></td><td>P</td></tr><tr><td>B</td></tr></table>"
    )
    df = spark.createDataFrame([(1, page)], "page int, html string")
    assert rows(html_tables(df, "html", require_col="School")) == [(1, 1, 1, "City", "P"), (1, 1, 1, "School", "A"), (1, 1, 2, "School", "B")]
    assert rows(html_tables(df, "html", nth=0)) == [(1, 0, 1, "Kind", "x")]
    good, bad = extract_records(df, "html", "(?s)<tr>.*?</tr>", {"first": "<td>(.*?)</td>", "second": "</td><td>(.*?)</td>"})
    assert rows(good, "first", "second") == [("<b>A</b>", "P")]
    assert rows(bad.select("record_no", F.concat_ws(",", "missing"))) == [(0, "first,second"), (1, "second"), (2, "first,second"), (4, "second")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "id int, name string, v double")
    Wr.write_csv(df, str(tmp_path / "csv"))
    assert rows(R.read_table(spark, str(tmp_path / "csv"), "id int, name string, v double")) == rows(df)
    for state in ("OR", "VT"):
        (tmp_path / f"{state}.TXT").write_text(f"{state},F,2000,Ann,5\n")
    many = R.read_many(spark, [str(tmp_path / "OR.TXT"), str(tmp_path / "VT.TXT")], "state string, gender string, year int, name string, n int", "file")
    assert {(r["state"], r["gender"], r["file"][-6:]) for r in many.collect()} == {("OR", "F", "OR.TXT"), ("VT", "F", "VT.TXT")}


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "landing")
    Wr.write_partitioned(spark.createDataFrame([(2020, 1), (2021, 2)], "season int, v int"), path, ["season"])
    Wr.write_partitioned(spark.createDataFrame([(2021, 3)], "season int, v int"), path, ["season"])
    assert rows(spark.read.parquet(path), "season", "v") == [(2020, 1), (2021, 3)]


def test_latest_file(spark, tmp_path):
    for day in ("2021-05-20", "2021-05-21"):
        (tmp_path / f"{day}-running-times.json").write_text(f'{{"hour": 13, "temp": {day[-2:]}}}\n')
    path = str(tmp_path)
    assert rows(R.read_latest(spark, path, "hour int, temp int", "2021-05-21")) == [(13, 21, date(2021, 5, 21))]
    with pytest.raises(FileNotFoundError, match="newest is 2021-05-21"):
        R.read_latest(spark, path, "hour int, temp int", "2021-05-22")


def test_json_encoded_twice(spark, tmp_path):
    import json

    doc = {"weather_data": [{"hour": 13, "temp": 61.5, "wind_speed": 3.0, "status": 'Cl"ear'}]}
    (tmp_path / "x.json").write_text(json.dumps(json.dumps(doc)))
    out = R.read_json_twice(spark, str(tmp_path), "struct<weather_data:array<struct<hour:int,temp:double,wind_speed:double,status:string>>>", "weather_data")
    assert rows(out) == [(13, 61.5, 3.0, 'Cl"ear')]
