"""Queries for text matching, search and the content catalogue.

Documents stand for content pages: language, source, size, quality and toxicity
give the tags, the source the category and section.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from larkspan.functions import text as X
from larkspan.operators import content as W
from larkspan.operators import textmatch as T
from larkspan.operators.joins import best_match, join_loss
from larkspan.plans.registry import query

# ---------------------------------------------------------------- near-equal names

HOSTS = r"""
WITH hosts AS (SELECT DISTINCT regexp_extract(url, '//([^/]+)', 1) AS host FROM pages),
words AS (SELECT DISTINCT lower(unnest(string_split_regex(regexp_extract(html, '<title>(.*?)</title>', 1), '[^\pL\pN]+'))) AS w FROM pages),
a AS (SELECT host, regexp_replace(host, '^m\.|\.example\.[a-z]+$', '', 'g') AS name FROM hosts),
b AS (SELECT w, w AS name FROM words WHERE w <> ''),
j AS (SELECT host, w, a.name AS name_x, b.name AS name_y, damerau_levenshtein(a.name, b.name)::INT AS dist FROM a JOIN b ON damerau_levenshtein(a.name, b.name) <= 2)
"""


def hosts(t):
    """Distinct page hosts with their bare name."""
    url = t.pages.select(F.regexp_extract("url", "//([^/]+)", 1).alias("host")).distinct()
    return url.withColumn("name", F.regexp_replace("host", r"^m\.|\.example\.[a-z]+$", ""))


def title_words(t):
    """Distinct words in page titles."""
    titles = t.pages.select(F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    words = titles.select(F.explode(T.tokens(F.col("title"))).alias("w")).distinct()
    return words.withColumn("name", F.col("w"))


def matched(t):
    return T.fuzzy_join(hosts(t), title_words(t), "name", 2)


@query("fuzzy_join", "D10 T1", HOSTS + "SELECT host, w, name_x, name_y, dist FROM j")
def _(t):
    return matched(t)


@query("best_match", "D11", HOSTS + "SELECT host, w, name_x, name_y, dist FROM j QUALIFY row_number() OVER (PARTITION BY host ORDER BY dist, w) = 1")
def _(t):
    return best_match(matched(t), ["host"], [F.col("dist"), F.col("w")])


@query(
    "join_loss",
    "D12 D5",
    HOSTS
    + """SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM j) AS n_joined, (SELECT count(*) FROM a WHERE host NOT IN (SELECT host FROM j)) AS unmatched,
         round(((SELECT count(*) FROM a) - (SELECT count(*) FROM j)) / (SELECT count(*) FROM a) * 100, 2) AS pct_rows,
         round((SELECT count(*) FROM a WHERE host NOT IN (SELECT host FROM j)) / (SELECT count(*) FROM a) * 100, 2) AS pct_keys""",
)
def _(t):
    return join_loss(hosts(t), matched(t), ["host"])


# ---------------------------------------------------------------- search

PAGES = r"""
WITH docs AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS content, [regexp_extract(url, 'example\.[a-z]+/([a-z]+)/', 1)] AS categories FROM pages),
queries AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS q FROM pages)
"""


def search_pages(t):
    content = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return t.pages.select(
        "page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), content.alias("content"),
        F.array(F.regexp_extract("url", r"example\.[a-z]+/([a-z]+)/", 1)).alias("categories"),
    )


def link_words(t):
    return t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("q")).distinct()


@query(
    "search",
    "T2",
    PAGES
    + r"""SELECT q, page_id, score, place FROM (
          SELECT q, page_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, page_id)::INT AS place FROM (
            SELECT q, page_id, round(sum(w) / any_value(n), 6) AS score FROM (
              SELECT q, n, unnest(t) AS token FROM (SELECT q, t, len(t) AS n FROM (SELECT q, list_distinct(list_filter(string_split_regex(lower(q), '[^\pL\pN]+'), lambda x: x <> '')) AS t FROM queries)))
            JOIN (SELECT DISTINCT page_id, f, w, token FROM (
              SELECT page_id, 'title' AS f, 0.99::DOUBLE AS w, unnest(string_split_regex(lower(title), '[^\pL\pN]+')) AS token FROM docs
              UNION ALL SELECT page_id, 'content', 0.2, unnest(string_split_regex(lower(content), '[^\pL\pN]+')) FROM docs
              UNION ALL SELECT page_id, 'categories', 0.5, unnest(string_split_regex(lower(categories[1]), '[^\pL\pN]+')) FROM docs)) USING (token)
            GROUP BY q, page_id)
          WHERE score > 0) WHERE place <= 10""",
)
def _(t):
    return T.search(search_pages(t), "page_id", link_words(t), "q")


@query("search_fuzzy", "T2 T1")
def _(t):
    return T.search(search_pages(t), "page_id", link_words(t), "q", fuzzy=1, threshold=0.1)


@query(
    "snippets",
    "T3",
    """SELECT doc_id, CASE WHEN strpos(lower(text), 'the') > 0 THEN
         substring(text, greatest(strpos(lower(text), 'the') - 60, 1),
                   least(strpos(lower(text), 'the') + 63, length(text) + 1) - greatest(strpos(lower(text), 'the') - 60, 1))
       ELSE source END AS snippet FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", X.snippet(F.col("text"), F.lit("the"), F.col("source")).alias("snippet"))


# ---------------------------------------------------------------- catalogue

CONTENT = r"""
WITH content AS (
  SELECT d.doc_id, split_part(text, chr(10), 1) AS title, text AS content, lang, source AS section, CASE WHEN lang = 'en' THEN 'post' ELSE 'publication' END AS type,
         '/' || source || '/' || d.doc_id || '/' AS relpermalink, DATE '2015-01-01' + (d.doc_id * 13 % 3650)::INT AS date,
         CASE WHEN n_chars < 500 THEN split_part(text, chr(10), 1) ELSE '' END AS summary, CASE WHEN n_chars > 5000 THEN '<i>' || split_part(text, chr(10), 1) || '</i>' END AS abstract,
         ['user' || (d.doc_id % 31), 'user' || (d.doc_id % 7)] AS authors, [source] AS categories,
         [lang, source, CASE WHEN n_chars < 1000 THEN 'Short' WHEN n_chars < 5000 THEN 'Medium' ELSE 'Long' END,
          CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' ELSE 'unrated' END, CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END] AS tags,
         coalesce(quality, 0) = 1 AS featured, coalesce(toxic, 0) = 1 AS draft, n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""


def content_pages(t):
    docs = t.documents.join(t.labels, "doc_id", "left")
    title = F.get(F.split("text", "\n"), F.lit(0))
    size = F.when(F.col("n_chars") < 1000, "Short").when(F.col("n_chars") < 5000, "Medium").otherwise("Long")
    rating = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unrated")
    user = lambda n: F.concat(F.lit("user"), (F.col("doc_id") % n).cast("string"))
    return docs.select(
        "doc_id", title.alias("title"), F.col("text").alias("content"), "lang", F.col("source").alias("section"),
        F.when(F.col("lang") == "en", "post").otherwise("publication").alias("type"),
        F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/")).alias("relpermalink"),
        F.date_add(F.lit(date(2015, 1, 1)), (F.col("doc_id") * 13 % 3650).cast("int")).alias("date"),
        F.when(F.col("n_chars") < 500, title).otherwise("").alias("summary"),
        F.when(F.col("n_chars") > 5000, F.concat(F.lit("<i>"), title, F.lit("</i>"))).alias("abstract"),
        F.array(user(31), user(7)).alias("authors"), F.array("source").alias("categories"),
        F.array("lang", "source", size, rating, F.when(F.col("toxic") == 1, "toxic").otherwise("clean")).alias("tags"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("featured"), (F.coalesce("toxic", F.lit(0)) == 1).alias("draft"), "n_chars",
    )


PLAIN = r"trim(regexp_replace(regexp_replace({}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


@query(
    "content_index",
    "W1 G7",
    CONTENT
    + f"""SELECT doc_id, relpermalink, coalesce({PLAIN.format("nullif(summary, '')")}, {PLAIN.format("nullif(abstract, '')")},
          array_to_string(list_filter(string_split({PLAIN.format("content")}, ' '), lambda x: x <> '')[1:70], ' ')) AS summary
          FROM content WHERE (lang = 'en' OR featured) AND NOT draft""",
)
def _(t):
    pages = content_pages(t).withColumn("private", F.lit(False))
    out = W.build_index([pages.filter(F.col("lang") == "en"), pages.filter("featured")], "doc_id")
    return out.select("doc_id", "relpermalink", "summary")


@query(
    "resolved_authors",
    "W2",
    CONTENT
    + """, people AS (SELECT 'user' || n_nationkey AS who, n_name FROM nation WHERE n_regionkey <> 2)
        SELECT doc_id, coalesce(p.n_name, authors[1]) || ';' || coalesce(q.n_name, authors[2]) AS authors FROM content
        LEFT JOIN people p ON p.who = authors[1] LEFT JOIN people q ON q.who = authors[2]""",
)
def _(t):
    people = t.nation.filter(F.col("n_regionkey") != 2).select(F.concat(F.lit("user"), F.col("n_nationkey").cast("string")).alias("who"), "n_name")
    out = W.resolve_authors(content_pages(t).select("doc_id", "authors"), "doc_id", "authors", people, "who", "n_name")
    return out.withColumn("authors", F.array_join("authors", ";"))


@query(
    "page_listing",
    "W3 G4",
    CONTENT
    + """SELECT doc_id, date FROM content WHERE type = 'post' AND list_contains(tags, 'Medium') AND NOT featured AND date >= DATE '2016-01-01' AND date < DATE '2024-01-01'
         ORDER BY date DESC, doc_id LIMIT 20 OFFSET 5""",
)
def _(t):
    order = [F.desc("date"), F.col("doc_id")]
    out = W.list_pages(
        content_pages(t), order, 5, 20, type="post", tag="Medium", exclude_featured=True, exclude_past=date(2016, 1, 1), exclude_future=date(2024, 1, 1)
    )
    return out.select("doc_id", "date")


@query(
    "author_listing",
    "W3",
    CONTENT + "SELECT doc_id, date FROM content WHERE list_contains(categories, 'src3') AND list_contains(authors, 'user3') ORDER BY date, doc_id LIMIT 5",
)
def _(t):
    return W.list_pages(content_pages(t), [F.col("date"), F.col("doc_id")], category="src3", author="user3").select("doc_id", "date")


@query(
    "term_weights",
    "W4",
    CONTENT
    + """, c AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(tags) AS term FROM content) GROUP BY 1 ORDER BY n DESC, term LIMIT 20)
        SELECT term, n, round((ln(n) - ln(min(n) OVER ())) / (ln(max(n) OVER () + 1) - ln(min(n) OVER ())), 9) AS weight FROM c""",
)
def _(t):
    return W.term_weights(content_pages(t), "tags", 20).withColumn("weight", F.round("weight", 9))


RELATED_WEIGHTS = {"tags": 100, "categories": 70}


@query(
    "related_pages",
    "W5 F1",
    CONTENT
    + """, s AS (SELECT doc_id, date, list_distinct(list_transform(tags, lambda x: lower(x))) AS tg, list_distinct(list_transform(categories, lambda x: lower(x))) AS ct FROM content),
        p AS (SELECT a.doc_id, b.doc_id AS related, b.date, round((100 * len(list_intersect(a.tg, b.tg)) + 70 * len(list_intersect(a.ct, b.ct))) * 100
              / (100 * len(a.tg) + 70 * len(a.ct)), 6) AS score FROM s a JOIN s b ON a.doc_id <> b.doc_id)
        SELECT doc_id, related, score, place::INT AS place FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, date DESC, related) AS place FROM p WHERE score >= 80) WHERE place <= 5""",
)
def _(t):
    return W.related(content_pages(t), "doc_id", "date", RELATED_WEIGHTS)


@query("pages_by_year", "W6", CONTENT + "SELECT year(date)::INT AS year, date, doc_id FROM content ORDER BY year DESC, date DESC, doc_id")
def _(t):
    return W.by_year(content_pages(t).select("doc_id", "date"), "date", "doc_id")


@query("page_years", "W6", CONTENT + "SELECT DISTINCT year(date)::INT AS year FROM content ORDER BY 1 DESC")
def _(t):
    return W.years(content_pages(t), "date")


@query(
    "facets",
    "W7",
    CONTENT + "SELECT doc_id FROM content WHERE regexp_matches(content, '(?i)\\bthe\\b.*of') AND type = 'post' AND year(date) = 2018",
)
def _(t):
    return W.facet_filter(content_pages(t), "content", r"\bthe\b.*of", "post", 2018).select("doc_id")


@query("tag_overlap", "W8", CONTENT + "SELECT doc_id FROM content WHERE list_has_any(tags, ['fr', 'toxic', 'src2'])")
def _(t):
    return W.any_overlap(content_pages(t), "tags", ["fr", "toxic", "src2"]).select("doc_id")


@query(
    "truncated_titles",
    "W9",
    CONTENT
    + r"""SELECT doc_id, CASE WHEN length(title) <= 135 THEN title ELSE
          (CASE WHEN regexp_matches(substring(title, 136, 1), '^\s?$') THEN rtrim(substring(title, 1, 135), ' ')
                ELSE rtrim(regexp_replace(substring(title, 1, 135), '\s+\S*$', ''), ' ') END) || '…' END AS title FROM content""",
)
def _(t):
    return content_pages(t).select("doc_id", X.truncate(F.col("title"), 135).alias("title"))


@query(
    "feed",
    "W10",
    CONTENT + "SELECT doc_id, relpermalink, strftime(date, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS pub_date FROM content ORDER BY date DESC, doc_id LIMIT 15",
)
def _(t):
    return W.feed(content_pages(t).select("doc_id", "relpermalink", "date"), "date", "doc_id", 15).drop("date")


@query(
    "siblings",
    "W11",
    """SELECT source, round(avg(n_chars), 4) AS weight FROM documents GROUP BY 1 ORDER BY weight DESC, source""",
)
def _(t):
    sections = t.documents.groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("weight"))
    return W.order_siblings(sections, "weight", "source", desc=True)


@query(
    "citations",
    "W12",
    CONTENT
    + """SELECT doc_id, array_to_string(authors, ', ') || ' (' || year(date) || '). ' || title || '.' || CASE WHEN lang = 'en' THEN ' ' || section || '.' WHEN n_chars > 2000 THEN ' Journal.' ELSE '' END AS apa,
         array_to_string(authors, ', ') || '. ' || title || '.' || CASE WHEN lang = 'en' THEN ' ' || section || ',' WHEN n_chars > 2000 THEN ' Journal,' ELSE '' END || ' ' || year(date) || '.' AS mla FROM content""",
)
def _(t):
    short = F.when(F.col("lang") == "en", F.col("section")).otherwise("")
    venue = F.when(F.col("n_chars") > 2000, "Journal")
    parts = (F.col("authors"), F.year("date"), F.col("title"), short, venue)
    return content_pages(t).select("doc_id", W.citation(*parts).alias("apa"), W.citation(*parts, style="mla").alias("mla"))


@query(
    "url_list",
    "W13",
    CONTENT
    + """SELECT relpermalink AS loc, date AS lastmod FROM content
         UNION ALL SELECT '/tags/' || lower(t) || '/', max(date) FROM (SELECT unnest(tags) AS t, date FROM content) GROUP BY lower(t)
         UNION ALL SELECT '/categories/' || t || '/', max(date) FROM (SELECT unnest(categories) AS t, date FROM content) GROUP BY t""",
)
def _(t):
    return W.url_list(content_pages(t), "relpermalink", "date", {"tags": "tags", "categories": "categories"})
