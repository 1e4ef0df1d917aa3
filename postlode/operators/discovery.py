"""Search queries and result pages: generation, checks, parsing, ranking, failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlode.functions import text, urls, values

MODIFIERS = ("fresher", "intern", "trainee", "graduate", "entry level")
#: What in an error message tells a failure that a retry does not mend, or does.
PERMANENT = (
    "not found", "company not found", "board not found", "ats board unavailable", "does not exist", "no such board", "unknown board",
    "greenhousescraper(", "leverscraper(", "ashbyscraper(", "workdayscraper(", "smartrecruitersscraper(", "icimsscraper(", "scraper(",
)
TRANSIENT = (
    "timed out", "timeout", "connection reset", "connection aborted", "connection refused", "temporarily unavailable",
    "temporary failure", "too many requests", "rate limit", "429", "502", "503", "504",
)
#: What a search engine answers with instead of results.
BLOCKED_CODES = (403, 429, 503)
BLOCKED_WORDS = (
    "captcha", "verify you are human", "unusual traffic", "automated queries", "robot check", "access denied", "too many requests",
    "security check", "are you a robot",
)


def generate(roles: DataFrame, sources: DataFrame, places: DataFrame, modifiers: tuple[str, ...] = MODIFIERS) -> DataFrame:
    """query_id, role, source, place, modifier, query: the product of four lexicons (roles.role, sources.source, places.place).

    Its size is the product of the lexicons' sizes, not of anything that grows with data; duplicates go by query_id.
    """
    words = roles.sparkSession.createDataFrame([(m,) for m in modifiers], "modifier string")
    every = roles.select("role").crossJoin(sources.select("source")).crossJoin(places.select("place")).crossJoin(words)
    built = every.withColumn("query", text.query_text(F.concat_ws(" ", "role", "modifier", "place")))
    made = built.withColumn("query_id", values.short_id(F.col("source"), F.col("query")))
    w = Window.partitionBy("query_id").orderBy("role", "modifier", "place")
    return made.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("query_id", "role", "source", "place", "modifier", "query")


def pick(queries: DataFrame, **equal: str) -> DataFrame:
    """The queries whose columns equal the given values without regard to case or space at the ends."""
    for column, value in equal.items():
        queries = queries.where(F.lower(F.trim(column)) == value.strip().lower())
    return queries


def problems(query: Column, role: Column) -> Column:
    """What is wrong with a query, as a list; empty if nothing is."""
    tests = {"empty": F.coalesce(F.trim(query), F.lit("")) == "", "too_long": F.length(query) > 200, "repeated_word": text.has_repeated_word(query), "no_role": ~F.coalesce(F.contains(F.lower(query), F.lower(role)), F.lit(False))}
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())), lambda x: x.isNotNull())


def results(pages: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """query, engine, rank, url, domain, title: links of landed result pages (query, engine, html), each URL once a query."""
    links = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*href="(https?://[^"]+|/url\?[^"]+)"[^>]*>.*?</a>'), F.lit(0))
    each = pages.select("query", "engine", F.posexplode(links).alias("at", "link"))
    raw = F.replace(F.regexp_extract("link", r'(?is)href="([^"]*)"', 1), F.lit("&amp;"), F.lit("&"))
    target = urls.canonical(urls.unwrap(raw, "q"))
    found = each.select("query", "engine", "at", target.alias("url"), text.result_title(text.html_text(F.col("link"))).alias("title")).withColumn("domain", urls.host(F.col("url")))
    kept = found.where(F.col("domain").isNotNull())
    for d in skip:
        kept = kept.where(~urls.under(F.col("domain"), d))
    first = Window.partitionBy("query", "engine", "url").orderBy("at")
    once = kept.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query", "engine").orderBy("at"))).select("query", "engine", "rank", "url", "domain", "title")


def blocked(status: Column, body: Column) -> Column:
    """Whether a page is no result page: by its status, its words, or because there is nothing on it."""
    return F.coalesce(status.isin(*BLOCKED_CODES), F.lit(False)) | (F.coalesce(body, F.lit("")) == "") | text.contains_any(body, BLOCKED_WORDS)


def failure(message: Column) -> Column:
    """permanent before transient: a message that names a missing board is final whatever else it says; else unknown."""
    return F.when(text.contains_any(message, PERMANENT), "permanent").when(text.contains_any(message, TRANSIENT), "transient").otherwise("unknown")
