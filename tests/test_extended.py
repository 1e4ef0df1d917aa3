import base64
import datetime
import json

import pytest
from pyspark.sql import functions as F

from postlode.functions import money, places, urls, values
from postlode.operators import normalise, resolution, signals, state
from postlode.sources import adapters


def every(spark, written, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(written)], "i int, x string")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dollar_range(spark):
    cases = {"$180K - $250K": (180000, 250000, "USD"), "$180-250K": (180, 250000, "USD"), "$100K to 120": (100000, 120000, "USD"), "$1.5M": (1.5e6, 1.5e6, "USD"), "Equity only": (None, None, None), "": (None, None, None), None: (None, None, None)}
    assert [tuple(r) for r in every(spark, cases, money.dollar_range)] == list(cases.values())


def test_grouped_range(spark):
    cases = {"55 000 – 60 000 Kč": (55000, 60000), "60 000 Kč": (60000, None), "55 000 - 60 000 Kč": (55000, 60000), "dohodou": (None, None), None: (None, None)}
    assert [tuple(r) for r in every(spark, cases, money.grouped_range)] == list(cases.values())


def test_pay_component(spark):
    tier = lambda *parts: json.dumps({"compensationTiers": [{"components": list(parts)}]})
    bonus, pay = {"compensationType": "Bonus", "minValue": 1}, {"compensationType": "Salary", "minValue": 10, "maxValue": 20, "currencyCode": "EUR", "interval": "HOURLY"}
    cases = {tier(bonus, pay): (10, 20, "EUR", "HOUR"), tier(bonus): (None,) * 4, "{": (None,) * 4, '{"compensationTiers": null}': (None,) * 4, None: (None,) * 4, tier(pay | {"interval": "odd"}): (10, 20, "EUR", "YEAR")}
    assert [tuple(r) for r in every(spark, cases, money.pay_component)] == list(cases.values())


@pytest.mark.parametrize("day_first", [True, False])
def test_local_date(spark, day_first):
    d = datetime.date
    cases = {"03/04/2024": d(2024, 4, 3) if day_first else d(2024, 3, 4), "2024-05-06": d(2024, 5, 6), "1er août 2023": d(2023, 8, 1), "5 January 2024": d(2024, 1, 5), "Jan 5, 2024": d(2024, 1, 5), "30/02/2024": None, "soon": None, "": None, None: None}
    assert every(spark, cases, lambda c: values.local_date(c, day_first)) == list(cases.values())


def test_tenant(spark):
    uuid = "0A1b2c3d-0000-1111-2222-333344445555"
    cases = {
        "https://jobs.ashbyhq.com/acme/1": ("ashby", "acme"),
        "www.jobs.lever.co/acme?x=1": ("lever", "acme"),
        "https://boards.greenhouse.io/": None,
        "https://acme.recruitee.com": ("recruitee", "acme"),
        "https://acme.jobs.personio.de/x": ("personio", "acme"),
        "https://herp.careers/v1/acme/j": ("herp", "acme"),
        "https://jobs.jobvite.com/careers/acme/jobs": ("jobvite", "careers/acme"),
        "https://jobs.jobvite.com/search": None,
        "https://jobs.dayforcehcm.com/en-US/acme/portal/jobs/7": ("dayforce", "acme/portal"),
        "https://jobs.dayforcehcm.com/acme/portal": ("dayforce", "acme/portal"),
        f"https://recruiting.paylocity.com/Recruiting/Jobs/All/{uuid}": ("paylocity", uuid.lower()),
        "https://acme.darwinbox.com/x": ("darwinbox", "acme.com"),
        "https://acme.keka.com/careers/jobdetails/4": ("keka", "https://acme.keka.com/careers"),
        "https://acme.keka.com/careers/lab": ("keka", "https://acme.keka.com/careers/lab"),
        "https://app.mokahr.com/campus-recruitment/acme/12": ("moka", "acme/12/campus"),
        "https://acme.wd5.myworkdayjobs.com/Ext": ("workday", "https://acme.wd5.myworkdayjobs.com/Ext"),
        "https://careers.example.com/jobs": None,
        "": None,
        None: None,
    }
    found = every(spark, cases, urls.tenant)
    assert [tuple(r) if r else None for r in found] == list(cases.values())


def test_url_checks(spark):
    target = "https://jobs.example.com/a?b=1"
    wrapped = "https://www.bing.com/ck/a?!&u=a1" + base64.urlsafe_b64encode(target.encode()).decode().rstrip("=") + "&ntb=1"
    assert every(spark, [wrapped, "https://x.org/?u=a1!!", None], urls.unwrap_base64) == [target, "https://x.org/?u=a1!!", None]
    assert every(spark, ["https://a.com/x", "http://localhost/x", "https://10.0.0.1/", "https://me@a.com/", "ftp://a.com", None], urls.is_public) == [True, False, False, False, False, False]
    assert every(spark, ["https://a.com/careers", "https://a.com/about", None], urls.is_career_path) == [True, False, False]


def test_signals(spark):
    assert every(spark, ["Junior dev", "0-1 years", "Staff engineer", None], lambda c: signals.for_beginners(c, F.lit(None).cast("string"), F.lit(None).cast("string"))) == [True, True, False, False]
    assert every(spark, ["This  job is\nclosed.", "open", None], signals.is_closed) == [True, False, False]
    assert [len(x) for x in every(spark, ["Pay a FEE in bitcoin", "fine", None], signals.fraud)] == [2, 0, 0]
    none = F.lit(None).cast("string")
    assert [r["status"] for r in every(spark, ["US only", "Remote in India", "Onsite", "Remote", None], lambda c: signals.remote(c, none, none))] == ["COUNTRY_RESTRICTED", "INDIA_ELIGIBLE", "NOT_REMOTE", "UNKNOWN", "UNKNOWN"]


def test_set_status(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "k int, status string")
    changes = spark.createDataFrame([(1, "A"), (2, "C"), (3, "C"), (9, "C")], "k int, status string")
    put, history = state.set_status(rows, changes, "k", "status", F.lit("now"))
    assert sorted((r.k, r.status) for r in put.collect()) == [(1, "A"), (2, "C"), (3, "C")]
    assert sorted((r.k, r.old_value, r.new_value) for r in history.collect()) == [(2, "B", "C"), (3, None, "C")]
    assert state.set_status(rows, changes, "k", "status", F.lit("now"), always=True)[1].count() == 3


def test_finish_scans(spark):
    scans = spark.createDataFrame([("a", 1, None, "RUNNING", 0), ("b", 1, None, "RUNNING", 0), ("c", 1, 5, "COMPLETED", 7), ("d", 1, None, "RUNNING", 0)], "s string, started_at int, finished_at int, status string, found int")
    results = spark.createDataFrame([("a", None, 4), ("b", "timeout", 2), ("c", "late", 1)], "s string, error string, found int")
    assert sorted(tuple(r) for r in state.finish_scans(scans, results, "s", F.lit(9)).select("s", "finished_at", "status", "found").fillna(0).collect()) == [("a", 9, "COMPLETED", 4), ("b", 9, "FAILED", 2), ("c", 5, "COMPLETED", 7), ("d", 0, "RUNNING", 0)]


@pytest.mark.parametrize(
    ("provider", "payload", "ats_id", "title", "location"),
    [
        ("amazon", {"jobs": [{"id_icims": "1", "title": "T", "job_path": "/p", "location": "L", "posted_date": "May 3, 2024"}]}, "1", "T", "L"),
        ("usajobs", {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {"PositionID": "1", "PositionTitle": "T", "PositionLocation": [{"LocationName": "L"}], "PositionRemuneration": [{"MinimumRange": "10"}]}}]}}, "1", "T", "L"),
        ("workday", {"jobPostings": [{"title": "T", "externalPath": "/job/x_1", "locationsText": "L", "bulletFields": []}]}, "x_1", "T", "L"),
        ("oracle", {"items": [{"requisitionList": [{"Id": "1", "Title": "T", "PrimaryLocation": "L"}]}]}, "1", "T", "L"),
        ("gem", {"data": {"oatsExternalJobPostings": {"jobPostings": [{"extId": "1", "title": "T", "locations": [{"name": "L", "isRemote": True}]}]}}}, "1", "T", "L"),
        ("ycombinator", {"jobPostings": [{"id": "1", "title": "T", "location": "L"}]}, "1", "T", "L"),
        ("join_com", {"items": [{"id": 1, "idParam": "1-t", "title": " T ", "city": {"cityName": "L", "countryName": "M"}, "department": {"name": "D"}}]}, "1", "T", "L, M"),
        ("gupy", {"props": {"pageProps": {"jobs": [{"id": 1, "name": "T", "workplace": {"workplaceType": "remote", "address": {"city": "L", "country": "Brasil"}}}, {"id": 2}]}}}, "1", "T", "L, Brasil"),
        ("thehub", {"docs": [{"_id": "1", "title": "T", "status": "active", "location": {"locality": "L"}}, {"id": "2", "title": "T", "status": "DRAFT"}]}, "1", "T", "L"),
        ("uber", {"jobs": [{"Id": "1", "Title": "T", "Locations": [{"City": "L", "Region": "L", "Country": "M"}, {"Address": "A"}], "Urls": [{"Url": "/a"}, {"Url": "/b", "IsDefault": True}]}]}, "1", "T", "L, M; A"),
        ("wanted", {"data": [{"id": 1, "position": "T", "address": {"location": "L", "country": "M"}, "annual_from": 2}]}, "1", "T", "L, M"),
        ("recruiterbox", {"objects": [{"id": 1, "title": "T", "url": "u", "location": {"city": "L"}}, {"id": 2, "title": "T"}]}, "1", "T", "L"),
        ("mercor", {"listings": [{"listingId": "1", "title": "T", "location": "L"}]}, "1", "T", "L"),
        ("manfred", [{"slug": "1", "position": "T", "status": "ACTIVE", "locations": ["L", " ", "M"]}], "1", "T", "L | M"),
    ],
)
def test_parsers(spark, provider, payload, ats_id, title, location):
    landed = spark.createDataFrame([("c", json.dumps(payload)), ("c", "broken"), ("c", None)], "company string, payload string")
    (row,) = adapters.parse(provider, landed).collect()
    assert (row["ats_id"], row["title"], row["location"], row["global_id"]) == (ats_id, title, location, f"{provider}:{ats_id}")


def test_parsed_fields(spark):
    def first(provider, payload):
        return adapters.parse(provider, spark.createDataFrame([("c", json.dumps(payload))], "company string, payload string")).first()

    row = first("join_com", {"items": [{"id": 1, "idParam": "1-t", "title": "T", "department": {"name": "D"}, "employmentType": "E", "createdAt": "2024-05-03T00:00:00Z"}]})
    assert (row["url"], row["department"], row["commitment"], row["company"], row["posted_at"].day) == ("https://join.com/companies/c/jobs/1-t", "D", "E", "c", 3)
    row = first("gupy", {"props": {"pageProps": {"jobs": [{"id": 1, "title": "T", "jobUrl": "/x"}]}}})
    assert (row["url"], row["country_iso"], row["is_remote"]) == ("https://c.gupy.io/x", "BR", None)
    row = first("uber", {"jobs": [{"Id": "1", "Title": "T", "Urls": [{"Url": "/a"}, {"Url": "/b", "IsDefault": True}], "ContractType": "x", "WorkPattern": "x", "Salary": {"Currency": "usd", "MinValue": 2}}]})
    assert (row["company"], row["url"], row["commitment"], row["salary_currency"], row["salary_min"], row["location"]) == ("Uber", "https://jobs.uber.com/b", "x", "USD", 2.0, None)
    row = first("recruiterbox", {"objects": [{"id": 1, "title": "T", "url": "u", "client_name": "N"}]})
    assert (row["company"], row["url"]) == ("N", "u")
    row = first("mercor", {"listings": [{"listingId": "1", "title": "A  C++ (Dev)!", "commitment": "hourly", "hoursPerWeek": 20, "workArrangement": "Remote", "rateMin": 5}]})
    assert (row["company"], row["url"], row["commitment"], row["is_remote"], row["salary_currency"]) == ("Mercor", "https://work.mercor.com/jobs/1/a-c-dev", "Hourly · 20h/week", True, "USD")
    row = first("manfred", [{"slug": "1", "position": "T", "status": "ACTIVE", "remotePercentage": 50, "salaryFrom": 3, "currency": "$"}])
    assert (row["company"], row["is_remote"], row["salary_min"], row["salary_max"], row["salary_currency"]) == ("Unknown", True, 3.0, None, "USD")
    row = first("thehub", {"docs": [{"id": "1", "title": "T", "status": "ACTIVE", "link": "mailto:x", "company": {"name": "N"}}]})
    assert (row["company"], row["apply_url"], row["is_remote"], row["url"]) == ("N", None, False, "https://thehub.io/jobs/1")


def test_places(spark):
    assert every(spark, ["Bombay", "  New   Delhi ", "", None], lambda c: places.canonical(c, {"Bombay": "Mumbai"})) == ["Mumbai", "New Delhi", "", ""]
    assert every(spark, ["Indiana", "Pune", "Pune, USA", "Oslo", None], lambda c: places.is_near(c, ("india", "pune"), ("usa",))) == [True, True, False, False, False]
    many = F.array(F.lit("A"), F.lit(" B"), F.lit("A"), F.lit(None).cast("string"))
    assert every(spark, ["2 Locations", "Paris", None], lambda c: places.resolve_roll_up(c, many)) == ["A | B", "Paris", None]
    assert every(spark, ["2 Locations"], lambda c: places.resolve_roll_up(c, F.array().cast("array<string>"))) == ["2 Locations"]
    assert every(spark, ["Berlin", "", None], lambda c: places.written(c, F.lit("Berlin"), F.lit("DE"))) == ["Berlin, DE", "Berlin, DE", "Berlin, DE"]
    assert every(spark, ["", None], lambda c: places.written(c)) == [None, None]


def test_to_store(spark):
    rows = spark.createDataFrame([(" T ", None, "https://a/1", "true", "x:1"), ("T", "", " ", None, None), ("", "https://a/2", None, None, None), ("U", "https://a/3", None, "0", "")], "title string, url string, apply_url string, is_remote string, global_id string")
    out = sorted(normalise.to_store(rows, F.current_timestamp()).collect(), key=lambda r: r["url"])
    assert [(r["title"], r["url"], r["apply_url"], r["work_mode"]) for r in out] == [("T", "https://a/1", "https://a/1", "REMOTE"), ("U", "https://a/3", "https://a/3", "ONSITE")]
    assert len({r["fingerprint"] for r in out}) == 2
    assert normalise.to_store(rows.limit(0), F.current_timestamp()).count() == 0


def test_descriptions(spark):
    rows = spark.createDataFrame([(1, "own"), (2, " "), (3, None), (None, None)], "k int, description string")
    cache = spark.createDataFrame([(1, "other"), (2, "a"), (2, "abc"), (4, "x"), (None, "y")], "k int, description string")
    assert sorted(normalise.fill_descriptions(rows, cache, ["k"], 2).collect(), key=str) == sorted([(1, "own"), (2, "ab"), (3, None), (None, None)], key=lambda r: str(spark.createDataFrame([r], rows.schema).first()))
    assert [r.k for r in normalise.to_fetch(rows, cache, ["k"]).orderBy("k").collect()] == [None, 3]


def test_verify_page(spark):
    page = "Acme hires a data engineer in Pune."
    yes, none = F.lit(True), F.lit(0)
    check = lambda place, direct, scams: every(spark, [page], lambda c: resolution.verify_page(F.lit("Acme"), F.lit("Data engineer"), F.lit(place), c, yes, direct, scams))[0]
    assert tuple(check("Pune", yes, none)) == (100, "VERIFIED")
    assert tuple(check("Pune", yes, F.lit(9))) == (60, "UNCERTAIN")
    assert tuple(check("Oslo", yes, none)) == (80, "UNCERTAIN")
    assert every(spark, [None], lambda c: resolution.verify_page(c, c, c, c, F.lit(None).cast("boolean"), yes, F.lit(None).cast("int")))[0]["status"] == "REJECTED"
