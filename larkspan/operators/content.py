"""Catalogue of content pages: index, listings, terms, relations, feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.text import plain_text
from larkspan.operators.sets import page, union_rows

RFC822 = "EEE, dd MMM yyyy HH:mm:ss"


def first_words(c: Column, n: int) -> Column:
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def build_index(kinds: Sequence[DataFrame], key: str, summary_words: int = 70) -> DataFrame:
    """Union of page sets without drafts and private pages.

    The summary is the first given of summary and abstract, else the opening
    words of the text, always without markup.
    """
    pages = reduce(lambda a, b: union_rows(a, b, [key]), kinds)
    shown = pages.filter(~F.coalesce("draft", F.lit(False)) & ~F.coalesce("private", F.lit(False)))
    given = lambda c: F.nullif(F.col(c), F.lit("")) if c in pages.columns else F.lit(None)
    auto = first_words(plain_text(F.col("content")), summary_words)
    summary = F.coalesce(plain_text(given("summary")), plain_text(given("abstract")), auto)
    return shown.withColumn("summary", summary).drop("draft", "private", "abstract")


def resolve_authors(pages: DataFrame, key: str, col: str, people: DataFrame, person: str, display: str) -> DataFrame:
    """Author identifiers to display names, in order; unknown ones stay as they are.

    Only (page, identifier) pairs are shuffled, not the page texts.
    """
    listed = pages.select(key, F.posexplode(col).alias("_at", "_who"))
    names = people.select(F.col(person).alias("_who"), F.col(display).alias("_name"))
    named = listed.join(names, "_who", "left").select(key, F.struct("_at", F.coalesce("_name", "_who").alias("n")).alias("_a"))
    lists = named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("_a")), lambda a: a["n"]).alias("_names"))
    return pages.join(lists, key, "left").withColumn(col, F.coalesce("_names", F.array().cast("array<string>"))).drop("_names")


def list_pages(
    df: DataFrame, order: Sequence[Column], offset: int = 0, n: int = 5, type: str | None = None, tag: str | None = None,
    category: str | None = None, author: str | None = None, publication_type: str | None = None,
    exclude_featured: bool = False, exclude_past: date | None = None, exclude_future: date | None = None,
) -> DataFrame:
    """Filtered, sorted and paged listing; ``exclude_past`` and ``exclude_future`` give the present day."""
    if type is not None:
        df = df.filter(F.col("type") == type)
    for col, value in {"tags": tag, "categories": category, "authors": author, "publication_types": publication_type}.items():
        if value is not None:
            df = df.filter(F.array_contains(col, value))
    if exclude_featured:
        df = df.filter(~F.coalesce("featured", F.lit(False)))
    if exclude_past is not None:
        df = df.filter(F.col("date") >= F.lit(exclude_past))
    if exclude_future is not None:
        df = df.filter(F.col("date") < F.lit(exclude_future))
    return page(df, order, offset, n)


def term_counts(df: DataFrame, col: str) -> DataFrame:
    """Pages per term; a page counts once per term."""
    return df.select(F.explode(F.array_distinct(col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_weights(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most used terms with a log-scaled weight in [0, 1).

    The upper end of the scale is the top count plus one, the lower end the
    smallest count among the terms shown.
    """
    top = term_counts(df, col).orderBy(F.desc("n"), "term").limit(k)
    ends = top.agg(F.struct(F.log(F.max("n") + 1.0).alias("high"), F.log(F.min("n")).alias("low")).alias("e")).scalar()
    scaled = top.withColumn("_e", ends)
    e = F.col("_e")
    return scaled.withColumn("weight", (F.log("n") - e["low"]) / (e["high"] - e["low"])).drop("_e")


def related(
    df: DataFrame, key: str, newest: str, weights: Mapping[str, float], threshold: float = 80, k: int = 5
) -> DataFrame:
    """Up to ``k`` related pages per page: (key, related, score).

    The score is the share, in percent, of the weights of a page's own terms
    that the other page has too (terms lower-cased). Equal scores go to the
    newer page. Pages with the same terms score alike, so scores are computed
    between distinct term sets, and a set hands on only its ``k + 1`` newest
    pages: nobody's best ``k`` can need more.

    Sets meet on their rarest terms only. A set that shares none of the terms
    making up the first (100 - threshold) percent of another's weight cannot
    reach the threshold, so very common terms bring no pairs together.
    """
    cols = list(weights)

    def terms(c: str) -> Column:
        given = F.coalesce(F.col(c), F.array().cast("array<string>"))
        return F.array_sort(F.array_distinct(F.transform(given, lambda t: F.lower(t))))

    def weighed(c: str) -> Column:
        worth = F.lit(float(weights[c])).alias("w")
        return F.transform(F.col(f"_set.{c}"), lambda t: F.struct(F.lit(c).alias("field"), t.alias("term"), worth))

    def weight(size) -> Column:
        return sum((F.lit(float(weights[c])) * size(c) for c in cols), F.lit(0.0))

    signed = df.select(key, newest, F.struct(*[terms(c).alias(c) for c in cols]).alias("_set"))
    sets = signed.select("_set").distinct()
    long = sets.select("_set", F.inline(F.concat(*map(weighed, cols))))
    counts = long.groupBy("field", "term").agg(F.count(F.lit(1)).alias("_n"))
    rarest = Window.partitionBy("_set").orderBy("_n", "field", "term").rowsBetween(Window.unboundedPreceding, -1)
    ranked = long.join(counts, ["field", "term"]).withColumn("_before", F.coalesce(F.sum("w").over(rarest), F.lit(0.0)))
    own = weight(lambda c: F.size(F.col(f"_set.{c}")))
    rare = ranked.filter(F.col("_before") <= own * (1 - threshold / 100) + 1e-9).select("_set", "field", "term")
    met = rare.join(long.select(F.col("_set").alias("_other"), "field", "term"), ["field", "term"]).select("_set", "_other").distinct()
    shared = weight(lambda c: F.size(F.array_intersect(F.col(f"_set.{c}"), F.col(f"_other.{c}"))))
    scored = met.withColumn("score", F.round(shared * 100 / own, 6)).filter(F.col("score") >= threshold)

    ahead = Window.partitionBy("_set").orderBy(F.desc(newest), key)
    heads = signed.withColumn("_i", F.row_number().over(ahead)).filter(F.col("_i") <= k + 1)
    heads = heads.select(F.col("_set").alias("_other"), F.col(key).alias("related"), F.col(newest).alias("_date"))
    best = Window.partitionBy("_set").orderBy(F.desc("score"), F.desc("_date"), "related")
    lists = scored.join(heads, "_other").withColumn("_i", F.row_number().over(best)).filter(F.col("_i") <= k + 1)

    each = signed.join(lists.select("_set", "related", "score", "_date"), "_set").filter(F.col(key) != F.col("related"))
    last = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("_date"), "related")
    return each.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= k).select(key, "related", "score", "place")


def by_year(df: DataFrame, day: str, key: str) -> DataFrame:
    """Pages under their year, newest year and page first."""
    return df.withColumn("year", F.year(day)).orderBy(F.desc("year"), F.desc(day), key)


def years(df: DataFrame, day: str) -> DataFrame:
    return df.select(F.year(day).alias("year")).distinct().orderBy(F.desc("year"))


def facet_filter(df: DataFrame, text: str, pattern: str | None = None, type: str | None = None, year: int | None = None, day: str = "date") -> DataFrame:
    """Search pattern (any case) AND type AND year; a facet left out does not filter."""
    if pattern:
        df = df.filter(F.col(text).rlike(f"(?i){pattern}"))
    if type:
        df = df.filter(F.col("type") == type)
    if year:
        df = df.filter(F.year(day) == year)
    return df


def any_overlap(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.arrays_overlap(F.col(col), F.array(*map(F.lit, values))))


def rfc822(c: Column, offset: str = "+0000") -> Column:
    return F.concat(F.date_format(c, RFC822), F.lit(f" {offset}"))


def feed(df: DataFrame, day: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest pages with their publication date in feed format."""
    return df.orderBy(F.desc(day), key).limit(n).withColumn("pub_date", rfc822(F.col(day)))


def order_siblings(df: DataFrame, by: str = "weight", title: str = "title", desc: bool = False) -> DataFrame:
    """Sections by weight (no weight last) or by title, either direction."""
    first = F.col(by).desc_nulls_last() if desc else F.col(by).asc_nulls_last()
    return df.orderBy(first, title)


def citation(authors: Column, year: Column, title: Column, short: Column, venue: Column, style: str = "apa") -> Column:
    """Reference text; the short venue name is preferred, a missing venue left out."""
    who, place = F.concat_ws(", ", authors), F.coalesce(F.nullif(short, F.lit("")), F.nullif(venue, F.lit("")))
    y = year.cast("string")
    if style == "apa":
        return F.concat(who, F.lit(" ("), y, F.lit("). "), title, F.lit("."), F.coalesce(F.concat(F.lit(" "), place, F.lit(".")), F.lit("")))
    return F.concat(who, F.lit(". "), title, F.lit("."), F.coalesce(F.concat(F.lit(" "), place, F.lit(",")), F.lit("")), F.lit(" "), y, F.lit("."))


def url_list(df: DataFrame, url: str, modified: str, taxonomies: Mapping[str, str]) -> DataFrame:
    """(loc, lastmod) of every page and every term; a term is as new as its newest page."""
    rows = df.select(F.col(url).alias("loc"), F.col(modified).alias("lastmod"))
    for path, col in taxonomies.items():
        terms = df.select(F.explode(col).alias("t"), F.col(modified).alias("m"))
        loc = F.concat(F.lit(f"/{path}/"), F.replace(F.lower("t"), F.lit(" "), F.lit("-")), F.lit("/"))
        rows = rows.unionByName(terms.groupBy(loc.alias("loc")).agg(F.max("m").alias("lastmod")))
    return rows

