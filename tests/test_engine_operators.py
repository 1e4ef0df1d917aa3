import json

import pytest
from pyspark.sql import functions as F

from postlode.functions import text
from postlode.operators import classify, dedup, frames, search, signals, state
from postlode.plans import catalog
from postlode.sources import adapters, readers, writers

POSTING = "source string, row_order long, url string, title string, company string, location string, country_iso string, ats_id string"


def survivors(spark, rows):
    return {(r["source"], r["row_order"]) for r in dedup.survivors(spark.createDataFrame(rows, POSTING)).collect()}


def test_mirrors_of_a_direct_source_go(spark):
    rows = [(s, i, f"https://{s}/{i}", f"Title {i}", "Acme", "Berlin", None, None) for s in ("workday", "eightfold") for i in range(3)]
    assert survivors(spark, rows) == {("workday", i) for i in range(3)}


def test_passes(spark):
    base = [("eures", 0, "u0", "Welder (m/w/d) (Welder/in)", "Bau AG", "DE (DEA58)", None, None), ("bundesagentur", 1, "u1", "Welder (m/w/d)", "Bau AG", "Köln, Deutschland", None, None)]
    assert survivors(spark, base) == {("eures", 0)}  # the last of two groups in brackets goes, so the cores are equal
    near = [("eures", 0, "u0", "Senior Data Engineer Platform", "Bau AG", "DE (DEA58)", None, None), ("bundesagentur", 1, "u1", "Sr. Data Engineer Platform", "Bau AG", "Köln, Deutschland", None, None)]
    assert survivors(spark, near) == {("eures", 0)}
    same = [(s, i, f"u{i}", t, "Bau AG", "DE (DEA58)", None, None) for i, (s, *_) in enumerate([("eures",), ("eures",)]) for t in [("Senior Data Engineer Platform", "Sr. Data Engineer Platform")[i]]]
    assert len(survivors(spark, same)) == 2
    ids = [("lever", 0, "a", "X", "Acme Inc", "", None, "7"), ("seek", 1, "b", "Y", "ACME inc", "", None, "7"), ("seek", 2, "", "Z", "", "", None, ""), ("lever", 3, "", "Z", "", "", None, "")]
    assert survivors(spark, ids) == {("lever", 0), ("seek", 2), ("lever", 3)}


def test_large_blocks_stay(spark):
    rows = spark.createDataFrame([(s, i, f"{s}{i}", f"Word number {i % 20} here", "Acme", "USA", None, None) for i, s in enumerate(["eures"] * 20 + ["gem"] * 20)], POSTING)
    ready = rows.withColumn("title_raw", F.col("title")).withColumn("priority", dedup.priority(F.col("source")))
    assert dedup.fuzzy(ready, ["company"], cap=30).count() == 40
    assert dedup.fuzzy(ready, ["company"], cap=100).count() < 40


def test_token_set_ratio():
    assert dedup.token_set_ratio("a b c", "c b a") == 100
    assert dedup.token_set_ratio("a b", "a b c") == 100
    assert dedup.token_set_ratio("", "a") == 0
    assert dedup.token_set_ratio("Senior Data Engineer Platform", "Sr. Data Engineer Platform") >= 90
    assert dedup.token_set_ratio("alpha", "omega", 90) == 0


def test_search(spark):
    rows = spark.createDataFrame([("ML Engineer", "Remote", None, 10.0, None), ("Sales", "Berlin", True, None, 50.0), ("C++ Dev", None, False, 90.0, 95.0)], "title string, location string, is_remote boolean, salary_min double, salary_max double")
    titles = lambda **k: {r["title"] for r in search.search(rows, **k).collect()}
    assert titles(title="ml") == {"ML Engineer"} and titles(title="c++") == {"C++ Dev"}
    assert titles(title="(unclosed") == titles(title=".*") == titles(title="ML|Sales") == set()
    assert titles(remote=True) == {"ML Engineer", "Sales"} and titles(remote=False) == {"C++ Dev"}
    assert titles(salary_min=50) == {"Sales", "C++ Dev"} and titles(salary_max=20) == {"ML Engineer"}
    assert {r["title"] for r in search.search(rows.drop("is_remote"), remote=True).collect()} == {"ML Engineer"}
    names = spark.createDataFrame([("OpenX Labs", "openx-labs"), ("OpenX", "openx"), ("Other", None)], "name string, slug string")
    assert [r["name"] for r in search.find_company(names, " openx ").collect()] == ["OpenX", "OpenX Labs"]
    assert search.find_company(names, " ").count() == 0


def test_state(spark):
    old = spark.createDataFrame([("a", "x", 1, 1, 1, "MISSING"), ("b", "y", 1, 1, 1, "ACTIVE")], "id string, title string, first_seen int, last_seen int, check_count int, status string")
    new = spark.createDataFrame([("a", "x1", 0), ("a", "x2", 1), ("c", "z", 2)], "id string, title string, __order int")
    rows = {r["id"]: r for r in state.upsert(old, new, "id", F.lit(9)).collect()}
    assert (rows["a"]["title"], rows["a"]["first_seen"], rows["a"]["last_seen"], rows["a"]["check_count"], rows["a"]["status"]) == ("x2", 1, 9, 2, "ACTIVE")
    assert (rows["b"]["last_seen"], rows["c"]["first_seen"], rows["c"]["check_count"]) == (1, 9, 1)


def test_match(spark):
    """Cases: title, description, location, experience, priority of the role, and what comes of them."""
    cases = [
        ("Data Analyst", "", "Hyderabad", "fresher", 90, ("TECHNICAL_FRESHER_MATCH", "GOOD", 86)),
        ("Data Analyst", "", "Pune, India", "", 90, ("TECHNICAL_FRESHER_MATCH", "MAYBE", 68)),
        ("Software Intern", "", "India Remote", "0-1 years", 100, ("TECHNICAL_FRESHER_MATCH", "STRONG", 98)),
        ("Senior Data Analyst", "", "Pune", "", 90, ("SENIOR_OR_EXPERIENCED_TITLE", "REJECTED", 0)),
        ("Software Engineer II", "", "Pune", "", 90, ("SENIOR_OR_EXPERIENCED_TITLE", "REJECTED", 0)),
        ("HR Recruiter", "", "Pune", "", 90, ("NON_TECHNICAL_ROLE", "NONE", 0)),
        ("Data Analyst", "", "London, UK", "", 90, ("NON_INDIA_LOCATION", "OUTSIDE_INDIA", 0)),
        ("Data Analyst", "", "Worldwide", "", 90, ("NON_INDIA_LOCATION", "OUTSIDE_INDIA", 0)),
        ("Data Analyst", "", None, "", 90, ("NON_INDIA_LOCATION", "OUTSIDE_INDIA", 0)),
        ("Data Analyst", "", "Pune", "3-5 years", 90, ("EXPERIENCE_REQUIREMENT_NOT_FRESHER", "EXPERIENCE_MISMATCH", 0)),
        ("Data Analyst", "Requires at least 3 years of work.", "Pune", None, 90, ("EXPERIENCE_REQUIREMENT_NOT_FRESHER", "EXPERIENCE_MISMATCH", 0)),
        ("Data Analyst", "Requires at least 3 years of work.", "Pune", "0-2 years", 90, ("TECHNICAL_FRESHER_MATCH", "GOOD", 83)),
        ("Welder", "", "Pune", "", None, ("ROLE_NOT_TARGETED", "NONE", 0)),
        (" ", "", "Pune", "", 90, ("NO_TITLE", "NONE", 0)),
        (None, None, None, None, None, ("NO_TITLE", "NONE", 0)),
    ]
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, title string, body string, place string, years string, prio int")
    m = classify.match(F.col("title"), F.col("body"), F.col("place"), F.col("years"), F.col("prio"))
    found = {r["i"]: tuple(r["m"])[:3] for r in rows.select("i", m.alias("m")).collect()}
    assert found == {i: c[5] for i, c in enumerate(cases)}


def test_best_role_with_and_without_a_join(spark, monkeypatch):
    roles = spark.createDataFrame([("data", "a", 70), ("data analyst", "b", 70), ("analyst", "c", 60), ("", "d", 99), (None, "e", 99)], "phrase string, role string, role_priority int")
    rows = spark.createDataFrame([(1, "Data Analyst"), (2, "ANALYST"), (3, None), (4, "x"), (4, "x")], "id int, title string")
    told = sorted([(1, "b", 70), (2, "c", 60), (3, None, None), (4, None, None), (4, None, None)], key=str)
    for most in (classify.LITERAL_ROLES, 1):
        monkeypatch.setattr(classify, "LITERAL_ROLES", most)
        assert sorted((tuple(r) for r in classify.best_role(rows, "title", roles, ["id"]).select("id", "role", "role_priority").collect()), key=str) == told


def test_verified_and_screened_remote(spark):
    texts = ["Remote. Must be located in Canada.", "Remote, US only", "Must live in Spain", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    none = F.lit(None).cast("string")
    x = rows.select("i", classify.remote_eligibility(none, F.col("t"), none)["status"].alias("a"), signals.verified_remote(none, F.col("t"), none)["status"].alias("b"), signals.remote(F.col("t"), none, none)["status"].alias("c")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in x] == [("UNKNOWN", "UNKNOWN", "UNKNOWN"), ("COUNTRY_RESTRICTED",) * 3, ("NOT_REMOTE", "COUNTRY_RESTRICTED", "UNKNOWN"), ("NOT_REMOTE", "UNKNOWN", "UNKNOWN")]


def test_sources_with_different_headers(spark, tmp_path):
    files = {"lever": "ats_id,title,odd\n01,Dev,x\n02,\"two\nlines\",y\n", "gem": "TITLE,location,company,ats_id\nOps,Berlin,Acme,7\n", "seek": "", "adp": "title,ats_id\n", "custom": "title,ats_id\nno,1\n"}
    for source, body in files.items():
        (tmp_path / source).mkdir()
        (tmp_path / source / "jobs.csv").write_text(body)
    rows = readers.postings(spark, str(tmp_path)).collect()
    assert sorted((r["ats_type"], r["ats_id"], r["title"], r["location"]) for r in rows) == [("gem", "7", "Ops", "Berlin"), ("lever", "01", "Dev", None), ("lever", "02", "two\nlines", None)]
    assert sorted(r["row_order"] & ((1 << 33) - 1) for r in rows if r["ats_type"] == "lever") == [0, 1] and len({r["row_order"] for r in rows}) == 3
    (tmp_path / "none").mkdir()
    assert readers.postings(spark, str(tmp_path / "none")).count() == 0


def test_survivors_plan(spark):
    rows = spark.createDataFrame([("lever", 1, "u", "T", "C", "x", None, "1")], POSTING)
    # The four passes over keys are one plan; what they keep is written down once, and the fuzzy pass reads that.
    plan = dedup.survivors(rows, cap=0)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 7 and plan.count("applyInPandas") + plan.count("FlatMapGroupsInPandas") == 0
    executed = dedup.survivors(rows, cap=0)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") <= 6
    fuzzy = dedup.survivors(rows)._jdf.queryExecution().sparkPlan().toString()
    assert fuzzy.count("Window [") == 0 and fuzzy.count("applyInPandas") + fuzzy.count("FlatMapGroupsInPandas") == 1
    executed = dedup.survivors(rows)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") <= 3


def test_normal_forms_are_made_of_what_is_left(spark, tmp_path):
    spark.createDataFrame([("lever", 1, "u", "T", "C", "x", None, "1")], POSTING).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    executed = dedup.survivors(rows, cap=0)._jdf.queryExecution().executedPlan().toString()
    # From the scan up to each shuffle; the last in the text is the first to run.
    *_, fourth, third, second, first = executed.split("Exchange")
    assert "RLIKE" not in first + second + third and "RLIKE" in fourth
    assert "[^a-z0-9]" not in first + second and "regexp_extract_all" not in first + second + third


def test_normal_forms_in_front_of_the_fuzzy_pass(spark, monkeypatch):
    plans, write = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    texts = (f"concat('{c[0]}', id) {c}" for c in ("source", "url", "title", "company", "location", "country_iso", "ats_id"))
    dedup.survivors(spark.range(3).selectExpr("id row_order", *texts))
    *_, third, second, first = plans[0].split("Exchange")
    assert "RLIKE" in plans[0] and "RLIKE" not in first + second + third


def test_nothing_is_sorted_in_front_of_the_first_shuffle(spark, tmp_path):
    spark.createDataFrame([("lever", 1, "u", "T", "C", "x", None, "1")], POSTING).write.parquet(f"{tmp_path}/rows")
    executed = dedup.survivor_keys(spark.read.parquet(f"{tmp_path}/rows"), cap=0)._jdf.queryExecution().executedPlan().toString()
    *_, third, second, first = executed.split("Exchange")
    assert "Sort [" not in first and "WindowGroupLimit" not in first
    # The texts of a key are sent once; their forms and the windows' other columns are made behind the shuffle.
    assert "__key_" not in first and "__own_" not in first and "lower(" in third.split("Window [")[0]


def test_queries_of_keys_do_not_read_the_rows_again(spark, tmp_path):
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string"
    rows = [(1, 5, 1, 1, 2.5, "A", "O"), (1, 5, 2, 1, 3.5, "A", "O"), (2, 22, 3, 3, 1.0, "N", "F")]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("dedup_survivors", "dedup_five_passes"):
        found = catalog.QUERIES[name](spark, str(tmp_path))
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == [("eures", 220_000_350), ("usajobs", 460_000_100)]


def test_key_text_is_what_the_pattern_makes(spark):
    ends = ["", " ", "\t", "\n", "\r\n", "\x0b\f", " \x85", "\x85 ", "\n\u2028", " \u2029", "\xa0", "\x00", "\x1f ", "!", "\u3000"]
    rows = spark.createDataFrame([(a + x + b,) for a in ends for b in ends for x in ("", "a", "a  b", "é\n中")] + [(None,)], "t string")
    both = rows.select(text.key_text(F.col("t")).alias("a"), F.coalesce(text.strip(F.col("t")), F.lit("")).alias("b")).collect()
    assert len(both) == 901 and all(r["a"] == r["b"] for r in both)


def test_priority_of_every_source(spark):
    rows = spark.createDataFrame([(s,) for s in [*dedup.PRIORITY, "other", "", None]], "source string")
    assert {r["source"]: r["p"] for r in rows.select("source", dedup.priority(F.col("source")).alias("p")).collect()} == dedup.PRIORITY | {"other": 2, "": 2, None: 2}


def test_rows_that_tie_in_one_key(spark):
    """The same row_order in several sources, and in one source more than once: one row of each key stays, whole keys of one source do."""
    rows = [("gem", 1, "", "T", "C"), ("eures", 1, "", "T", "C"), ("eures", 1, "", "t", "c"), ("lever", 2, "", "T", "D"), ("lever", 3, "", "T", "D"), ("other", 4, "", "", "C"), ("gem", 4, "", "", "C")]
    found = dedup.survivor_keys(spark.createDataFrame(rows, "source string, row_order long, url string, title string, company string"), cap=0)
    assert sorted(map(tuple, found.collect())) == [("eures", 1), ("gem", 4), ("lever", 2), ("lever", 3), ("other", 4)]


def test_passes_over_keys_against_plain_python(spark):
    import random
    import re

    rng, white = random.Random(8), " \t\n\x0b\f\r"
    places = {"Berlin, Germany": "DE", " Paris (FR)\n": "FR", "nowhere": "", "NOWHERE ": "", None: ""}
    pick = lambda *x: rng.choice([*x, None, "", " \t"])
    given = [(rng.choice(["lever", "gem", "eures", "other"]), i, pick(*(f" u{rng.randrange(150)}" for _ in range(9))), pick("Dev", " dev", "Dev (m) (w)", "dev  (m)", "Ops\tA", "Ops A"), pick("Acme Inc", "ACME INC ", "Acme-Inc", "Blue"), rng.choice(list(places)), pick("de", " DE", "fr"), pick("1", "2 ", "3", "4")) for i in range(400)]
    rows = []
    for source, i, *texts, iso, ats in given:
        url, title, company, place = ((x or "").strip(white) for x in texts)
        cut = re.sub(r"\s*\([^()]*\)\s*$", "", title) if len(re.findall(r"\([^()]*\)", title)) > 1 else title
        country = (iso or "").strip(white).upper() or places[texts[3]]
        key = re.sub("[^a-z0-9]", "", company.lower())
        keys = (url,), (company.lower(), title.lower(), place.lower()), (key, (ats or "").strip(white)), (key, country, re.sub(r"\s+", " ", cut.lower()).strip(" "))
        rows.append((dedup.PRIORITY.get(source, 2), i, source, keys))
    rows.sort()
    for n, needed in enumerate((1, 2, 2, 3)):
        groups = {}
        for r in rows:
            groups.setdefault(r[3][n] if all(r[3][n][:needed]) else r[1], []).append(r)
        rows = sorted(r for g in groups.values() for r in (g if n and len({x[2] for x in g}) == 1 else g[:1]))
    found = dedup.survivors(spark.createDataFrame(given, POSTING), cap=0).collect()
    assert len(rows) < 250 and sorted((r["source"], r["row_order"]) for r in found) == sorted((r[2], r[1]) for r in rows)


def test_fuzzy_pass_against_brute_force(spark):
    import random

    rng = random.Random(4)
    words = "data engineer platform senior junior analyst cloud systems".split()
    given = [(rng.choice(["lever", "gem", "eures", "usajobs"]), i, None, " ".join(rng.sample(words, rng.randrange(2, 5))), rng.choice(["Acme", "Blue", " "]), "", rng.choice(["DE", "FR", None]), None) for i in range(120)]
    told, kept = set(), []
    for s, i, _, title, company, _, country, _ in sorted(given, key=lambda r: (dedup.PRIORITY.get(r[0], 2), r[1])):
        block = (company.strip().lower(), country)
        exact = [k for k in kept if k[0] != s and all(block) and k[1] == block and dedup.token_set_ratio(k[2], title) >= 90]
        if not exact:
            kept.append((s, block, title))
            told.add((s, i))
    # No location, id or url: the passes before drop only rows whose titles equal, which the fuzzy one drops as well.
    assert survivors(spark, [(*g[:2], f"u{g[1]}", *g[3:5], str(g[1]), *g[6:]) for g in given]) == told


def test_stream_resumes(spark, tmp_path):
    from postlode.streaming.streams import run_upsert

    rows = lambda n: spark.createDataFrame([(u, f"2024-01-0{n} 00:00:00") for u in (1, n)], "user_id int, ts string").selectExpr("user_id", "timestamp(ts) ts").coalesce(1)
    rows(1).write.parquet(f"{tmp_path}/events.parquet")
    folder = f"file://{tmp_path}/work"
    assert {r["user_id"]: r["check_count"] for r in run_upsert(spark, str(tmp_path), "events", folder).collect()} == {1: 2}
    rows(2).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert {r["user_id"]: r["check_count"] for r in run_upsert(spark, str(tmp_path), "events", folder).collect()} == {1: 3, 2: 1}


def test_quarantine_takes_times(spark):
    held = spark.sql("select 'a' slug, 'old' reason, 2L failure_count, timestamp'2024-01-01' last_failure union all select 'n', 'none', 1L, null")
    failed, healed = spark.sql("select 'a' slug, 'new' reason"), spark.sql("select 'z' slug")
    found = {r["slug"]: (r["reason"], r["failure_count"]) for r in state.quarantine(held, failed, healed, "slug", F.lit("2025-01-01").cast("timestamp")).collect()}
    assert found == {"a": ("new", 3), "n": ("none", 1)}


def test_prune_and_limit(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    assert writers.prune(spark, f"file://{tmp_path}") == 1 and writers.prune(spark, f"file://{tmp_path}") == 0
    rows = spark.range(10).select(F.col("id"), F.lit("x").alias("title"))
    assert [r["id"] for r in search.search(rows, title="x", limit=2, order=("id",)).collect()] == [0, 1]
    assert frames.all_columns(rows, rows.withColumnRenamed("id", "n")) == ["id", "title", "n"]
    sent = spark.createDataFrame([("",), ("a",)], "k string")
    assert sorted(r["k"] for r in frames.not_yet(spark.createDataFrame([("",), ("a",), ("b",)], "k string"), sent, "k").collect()) == ["", "b"]


def test_adapters(spark):
    feed = "<rss><channel><item><guid>7</guid><title><![CDATA[Dev & Ops]]></title><link>https://a/7</link><pubDate>Fri, 01 Mar 2024 10:00:00 +0000</pubDate></item></channel></rss>"
    landed = spark.createDataFrame([("acme", json.dumps({"jobs": [{"id": 1, "title": "Dev", "absolute_url": "https://x/1", "location": {"name": "Berlin"}}]})), ("bad", "not json")], "company string, payload string")
    rows = adapters.parse("greenhouse", landed).collect()
    assert [(r["company"], r["ats_id"], r["location"], r["global_id"]) for r in rows] == [("acme", "1", "Berlin", "greenhouse:1")]
    row = adapters.parse("rss", spark.createDataFrame([("acme", feed)], "company string, payload string")).first()
    assert (row["ats_id"], row["title"], row["posted_at"].year) == ("7", "Dev & Ops", 2024)
    with pytest.raises(KeyError):
        adapters.parse("unknown", landed)


def test_more_formats(spark):
    xml = "<workzag-jobs><position><id>4</id><office>Berlin</office><name><![CDATA[Dev]]></name><createdAt>2024-03-01T10:00:00+00:00</createdAt></position></workzag-jobs>"
    row = adapters.parse("personio", spark.createDataFrame([("acme", xml)], "company string, payload string")).first()
    assert (row["ats_id"], row["title"], row["location"], row["posted_at"].day) == ("4", "Dev", "Berlin", 1)
    found = {"stellenangebote": [{"refnr": "r1", "titel": "Koch", "arbeitsort": {"ort": "Bonn", "land": "Deutschland"}}]}
    row = adapters.parse("bundesagentur", spark.createDataFrame([("acme", json.dumps(found))], "company string, payload string")).first()
    assert (row["ats_id"], row["location"]) == ("r1", "Bonn, Deutschland")
    page = '<script type="application/ld+json">{"@type":"JobPosting","title":"Ops","identifier":{"value":"9"},"datePosted":"2024-03-01"}</script><script type="application/ld+json">{"@type":"Thing"}</script>'
    row = adapters.job_posting(spark.createDataFrame([("acme", "https://a/9", page)], "company string, url string, payload string")).collect()
    assert [(r["ats_id"], r["title"], r["url"]) for r in row] == [("9", "Ops", "https://a/9")]


def test_queue_and_quarantine(spark):
    queue = spark.createDataFrame([(1, None, None, None, None), (2, 5, None, None, None)], "id int, started_at int, processed_at int, result string, error string")
    done = spark.createDataFrame([(1, "MATCHED", None)], "id int, result string, error string")
    assert sorted(map(tuple, state.mark(queue, done, "id", F.lit(9)).collect())) == [(1, 9, 9, "MATCHED", None), (2, 5, None, None, None)]
    held = spark.createDataFrame([("a", "404", 2, 1), ("b", "404", 1, 1)], "slug string, reason string, failure_count int, last_failure int")
    failed, healed = spark.createDataFrame([("a", "410"), ("c", "404")], "slug string, reason string"), spark.createDataFrame([("b",)], "slug string")
    assert sorted(map(tuple, state.quarantine(held, failed, healed, "slug", F.lit(9)).collect())) == [("a", "410", 3, 9), ("c", "404", 1, 9)]


def test_publish_and_read(spark, tmp_path):
    for s, rows in {"workday": ["u1,Dev,Berlin,Acme,01"], "eightfold": ["u2,Dev,Berlin,Acme,02", "u3,Ops,Berlin,Acme,03"]}.items():
        (tmp_path / "in" / s).mkdir(parents=True)
        (tmp_path / "in" / s / "jobs.csv").write_text("url,title,location,company,ats_id\n" + "\n".join(rows) + "\n")
    posts = readers.postings(spark, str(tmp_path / "in"))
    assert {(r["ats_type"], r["ats_id"]) for r in posts.collect()} == {("workday", "01"), ("eightfold", "02"), ("eightfold", "03")}
    out = f"file://{tmp_path}/out"
    manifest = writers.publish(posts, out, "t1", {"companies": {"kept": 1}, "by_date": {}})
    assert manifest["all"]["rows"] == 2 and manifest["by_ats"]["eightfold"]["jobs"]["rows"] == 2 and manifest["companies"] == {"kept": 1} and "by_date" not in manifest
    data = readers.Dataset(spark, out)
    assert data.load().count() == 2 and data.load(source="eightfold").count() == 2
    with pytest.raises(ValueError):
        data.load(source="workday", date="x")
    with pytest.raises(ValueError, match="workday"):
        writers.publish(posts.where("ats_type = 'eightfold'"), out, "t2", manifest)
    assert readers.Dataset(spark, out).manifest["generated_at"] == "t1"
    assert writers.checksums(spark, f"{out}/runs/t1/all.parquet").where("length(sha256) = 64").count() > 0


def test_json_and_registry(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"title": "x"}, None]}))
    (tmp_path / "b.json").write_text(json.dumps([{"title": "y"}]))
    assert {r["title"] for r in readers.json_records(spark, str(tmp_path / "*.json"), "title string").collect()} == {"x", "y"}
    (tmp_path / "c.csv").write_text("﻿Name,url\nAcme,https://a\n,https://b\n")
    assert [tuple(r) for r in readers.registry(spark, str(tmp_path / "c.csv")).collect()] == [(None, "https://a", "Acme")]


def test_every_order_is_resolved(spark, tmp_path):
    from postlode.plans.catalog import QUERIES

    rows = [(10, 1, "O", "1-URGENT"), (20, 1, "O", "1-URGENT"), (35, 1, "F", "1-URGENT"), (47, 2, "O", "5-LOW"), (48, 3, "O", "5-LOW"), (58, 3, "F", "2-HIGH")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["entity_resolution_all"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(10, 20, 85.0, 1), (10, 35, 65.0, 2), (20, 10, 85.0, 1), (20, 35, 65.0, 2), (35, 10, 65.0, 1), (35, 20, 65.0, 2)]
