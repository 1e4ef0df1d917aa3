import datetime

import pytest
from pyspark.sql import functions as F

from postlode.functions import text, urls, values
from postlode.operators import frames


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("written", "low", "high"),
    [("$257K - $335K", 257000, 335000), ("CA$400K – CA$500K", 400000, 500000), ("€80k–€120k", 80000, 120000), ("$60K to $80K", 60000, 80000), ("$200,000 - $300,000", 200000, 300000), ("OTE $1.5M - $2M", 1.5e6, 2e6), ("$100K", 1e5, 1e5), ("$300K - $200K", 200000, 300000), ("$180-250K", 180, 250000), ("Competitive", None, None), ("", None, None), (None, None, None)],
)
def test_salary(spark, written, low, high):
    found = one(spark, written, values.salary_range)
    assert (found["min"], found["max"]) == (low, high)


@pytest.mark.parametrize(("place", "code"), [("Berlin, Berlin, Deutschland", "DE"), ("Paris, FR", "FR"), ("Lausanne", ""), ("Lausanne, Suisse", "CH"), ("New York, USA", "US"), ("DE (DEA58)", "DE"), ("Remote, XX", ""), ("Wien, Österreich", "AT"), ("  ", ""), (None, "")])
def test_country(spark, place, code):
    assert one(spark, place, values.country_of) == code


@pytest.mark.parametrize(("title", "core"), [("Anlagenmechaniker (m/w/d) ab 20€/Std. (Anlagenmechaniker/in)", "anlagenmechaniker (m/w/d) ab 20€/std."), ("Marketing Manager (m/w/d)", "marketing manager (m/w/d)")])
def test_title_core(spark, title, core):
    assert one(spark, title, text.title_core) == core


@pytest.mark.parametrize(("title", "flag"), [("Engineer (Remote)", True), ("Work from home agent", True), ("Engineer", None), ("", None), (None, None)])
def test_remote_is_never_false(spark, title, flag):
    assert one(spark, title, values.remote_from_title) is flag


@pytest.mark.parametrize(("written", "low", "high"), [("2-4 years", 2, 4), ("3+ yrs", 3, None), ("5 years of work", 5, 5), ("none", None, None)])
def test_experience(spark, written, low, high):
    found = one(spark, written, values.experience_range)
    assert (found["min"], found["max"]) == (low, high)


def test_times(spark):
    assert one(spark, "2024-03-01T10:00:00Z", values.iso_time) == datetime.datetime(2024, 3, 1, 10)
    assert one(spark, "garbage", values.iso_time) is None
    assert one(spark, "Fri, 01 Mar 2024 10:00:00 +0000", values.feed_time) == datetime.datetime(2024, 3, 1, 10)
    assert one(spark, "1709287200", values.epoch_time) == one(spark, "1709287200000", values.epoch_time) == datetime.datetime(2024, 3, 1, 10)
    now = F.lit(datetime.datetime(2024, 3, 22))
    assert one(spark, "3 weeks ago", lambda c: values.relative_time(c, now)) == datetime.datetime(2024, 3, 1)


def test_ids(spark):
    make = lambda own: spark.createDataFrame([("lever", own)], "s string, i string").select(values.global_id(F.col("s"), F.col("i"))).first()[0]
    assert make(" a:B ") == "lever:a:B"
    assert len(make("")) == len(make("a\tb")) == len(make(None)) == 36
    assert one(spark, "yes", values.flag) == 1 and one(spark, "No", values.flag) == 0 and one(spark, "maybe", values.flag) is None


def test_urls(spark):
    assert one(spark, "HTTPS://Www.Ex.com/Jobs/?utm_source=x&id=7#top", urls.canonical) == "https://www.ex.com/Jobs?id=7"
    assert one(spark, "no url", urls.canonical) == "no url"
    assert one(spark, "https://jobs.ex.co/a", urls.base_domain) == "ex.co"
    assert one(spark, "nothing", urls.host) is None
    assert one(spark, "https://g.com/url?q=https%3A%2F%2Fa.b%2Fc&x=1", urls.unwrap) == "https://a.b/c"
    assert one(spark, "https://boards.ex.io/acme/jobs/1", lambda c: urls.board_token(c, "ex.io")) == "acme"
    kinds = {"board": ("ex.io",)}
    assert one(spark, "https://a.ex.io/", lambda c: urls.url_class(c, kinds)) == "board"
    assert one(spark, "https://notex.io/", lambda c: urls.url_class(c, kinds)) == "other"


def test_text(spark):
    assert one(spark, "R&D / QA|Dev!", text.match_text) == "r and d qa dev"
    assert one(spark, "Acme Pvt. Ltd.", text.company_words) == "acme"
    assert one(spark, "senior senior – engineer", text.query_text) == "senior - engineer"
    assert one(spark, "a b b", text.has_repeated_word) and not one(spark, "a b a", text.has_repeated_word)
    assert one(spark, "<p>a&amp;b</p><script>x</script>", text.html_text) == "a&b"


def test_character_references(spark):
    cases = {
        "a &#8211; b": "a – b",
        "it&#x27;s": "it's",
        "caf&eacute;": "café",
        "&#150;&#0;&#xD800;&#x110000;": "–���",
        "&amp;lt;": "&lt;",
        "AT&T &nosuch; &": "AT&T &nosuch; &",
        "&#128512;": "😀",
        "": "",
        None: None,
    }
    for given, told in cases.items():
        assert one(spark, given, text.unescape) == told, given
    assert one(spark, "<p>a&nbsp;&nbsp;b &eacute;</p>", text.html_text) == "a b é"


def test_apply_links(spark):
    page = F.lit("https://acme.com/jobs/1")
    html = """<a href='/apply'> <a HREF = "//x.acme.com/application/7?utm_source=a"> <a href="/how-to-apply"> <a href="https://Acme.com/apply/">
    <a href="https://acme.com/go?x=1&amp;to=candidate"> <a href="mailto:candidate@acme.com"> <a href="jobs/apply"> <a href="/apply">"""
    found = one(spark, html, lambda c: text.apply_links(c, page))
    assert found == ["https://acme.com/apply", "https://x.acme.com/application/7", "https://acme.com/go?x=1&to=candidate"]


def test_date_order_is_a_majority(spark):
    rows = [("a", d) for d in ("31/01/2024", "01/31/2024", "02/28/2024", "x/y", "3/4/2024", None)] + [("b", "30/1/2024")]
    found = frames.day_first_votes(spark.createDataFrame(rows, "s string, d string"), "s", F.col("d"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 2, False), ("b", 1, 0, True)]
