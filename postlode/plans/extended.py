"""More queries: boards, pay and dates of single providers, signals, state changes, payloads. Beside each, SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.functions import money, places, urls, values
from postlode.operators import normalise, resolution, signals, state
from postlode.plans.queries import Tables, query
from postlode.sources import adapters


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'recruitee' WHEN 2 THEN 'darwinbox' END AS source,
CASE s_suppkey % 4 WHEN 0 THEN 't' || s_suppkey WHEN 1 THEN 't' || s_suppkey WHEN 2 THEN 't' || s_suppkey || '.com' END AS slug FROM supplier""")
def careers_tenant(t: Tables) -> DataFrame:
    k, own = F.col("s_suppkey") % 4, F.concat(F.lit("t"), F.col("s_suppkey").cast("string"))
    url = F.when(k == 0, F.concat(F.lit("https://boards.greenhouse.io/"), own, F.lit("/jobs/1"))).when(k == 1, F.concat(own, F.lit(".recruitee.com/o/x")))
    url = url.when(k == 2, F.concat(F.lit("https://"), own, F.lit(".darwinbox.com/ms"))).otherwise(F.concat(F.lit("https://careers.example.com/"), own))
    return t.supplier.select("s_suppkey", urls.tenant(url).alias("x")).select("s_suppkey", "x.source", "x.slug")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * CASE WHEN p_size % 3 = 2 THEN 1000 ELSE 1 END END AS low,
CAST(CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN (p_size + 10) * 1000 ELSE p_size * 1000 END AS DOUBLE) AS high FROM part""")
def pay_with_units(t: Tables) -> DataFrame:
    k, n = F.col("p_size") % 3, F.col("p_size").cast("string")
    written = F.when(k == 0, "Equity only").when(k == 1, F.concat(F.lit("$"), n, F.lit("-"), (F.col("p_size") + 10).cast("string"), F.lit("K"))).otherwise(F.concat(F.lit("$"), n, F.lit("K")))
    return t.part.select("p_partkey", money.dollar_range(written).alias("x")).select("p_partkey", F.col("x.min").alias("low"), F.col("x.max").alias("high"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS posted FROM orders""")
def local_dates(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return t.orders.select("o_orderkey", values.local_date(written, k == 0).alias("posted"))


@query(r"""SELECT doc_id, regexp_matches(x, '\b(graduate|trainee|junior|associate|apprentice|intern|internship|freshers?|entry[- ]level|no experience required|without experience|0\s*[-–]\s*[12]\s*years?|0\s*years?)\b') AS beginner,
(CASE WHEN regexp_matches(x, '\bcrypto\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '\bbitcoin\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '\bgift card\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '\bwire transfer\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '\b(pay a|registration|processing|training) fee\b') THEN 1 ELSE 0 END) > 0 AS fraud
FROM (SELECT doc_id, coalesce(regexp_replace(lower(text), '\s+', ' ', 'g'), '') || CASE doc_id % 5 WHEN 0 THEN ' junior' WHEN 1 THEN ' gift card' ELSE '' END AS x FROM documents)""")
def posting_signals(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    end = F.when(k == 0, "junior").when(k == 1, "gift card")
    return t.documents.select("doc_id", signals.for_beginners(end, F.lit(None).cast("string"), F.col("text")).alias("beginner"), (F.size(signals.fraud(F.concat_ws(" ", "text", end))) > 0).alias("fraud"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'NOT_REMOTE' WHEN o_orderkey % 3 = 0 THEN 'COUNTRY_RESTRICTED' WHEN o_orderkey % 3 = 1 THEN 'WORLDWIDE' WHEN o_orderstatus = 'O' THEN 'UNKNOWN' ELSE 'INDIA_ELIGIBLE' END AS status,
CASE WHEN o_orderstatus = 'F' THEN 0.98 WHEN o_orderkey % 3 < 2 THEN 0.96 WHEN o_orderstatus = 'O' THEN 0.70 ELSE 0.75 END::DOUBLE AS confidence FROM orders""")
def remote_by_source(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    place, mode = F.when(k == 0, "Remote, US only").when(k == 1, "Work from anywhere"), F.when(F.col("o_orderstatus") == "F", "Hybrid").when(F.col("o_orderstatus") == "O", "remote")
    return t.orders.select("o_orderkey", signals.remote(place, mode, F.lit("You can work from India.")).alias("x")).select("o_orderkey", "x.status", "x.confidence")


@query("""SELECT event_id FROM events WHERE event_type IN (SELECT min(event_type) FROM events) AND value >= 75 AND user_id % 2 = 0""")
def alert_eligible(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("event_type").alias("__first"))
    status = F.when(F.col("event_type") == F.col("__first"), "VERIFIED").otherwise("UNCERTAIN")
    return t.events.join(F.broadcast(first)).where(signals.may_alert(status, F.lit("GOOD"), F.col("value"), F.col("user_id") % 2 == 0, F.lit(None).cast("boolean"))).select("event_id")


@query("""SELECT o_orderkey, o_orderstatus AS old_value, 'F' AS new_value FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus IS DISTINCT FROM 'F'""")
def status_set(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey").distinct()
    _, history = state.set_status(t.orders, keys.withColumn("o_orderstatus", F.lit("F")), "o_orderkey", "o_orderstatus", F.current_timestamp())
    return history.drop("changed_at")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN coalesce(c_mktsegment, '') ELSE o_orderpriority END AS o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey""")
def queue_repair(t: Tables) -> DataFrame:
    queue = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    rows = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("o_orderpriority"))
    return state.repair(queue, rows, "o_custkey", ["o_orderpriority"], F.col("o_orderpriority").isNull()).select("o_orderkey", "o_orderpriority")


@query("""SELECT event_type, count(*) AS seen, count(*) FILTER (value > 50) AS good FROM events GROUP BY event_type""")
def source_counters(t: Tables) -> DataFrame:
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("seen"), F.count_if(F.col("value") > 50).alias("good"))
    return state.add_counts(count(t.events.where("event_id % 2 = 0")), count(t.events.where("event_id % 2 <> 0")), "event_type")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS ats_id, p_name AS title, p_type AS location, 'remoteok:' || p_partkey AS global_id FROM part""")
def payload_parse(t: Tables) -> DataFrame:
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("position"), F.col("p_type").alias("location"))
    landed = t.part.select(F.col("p_brand").alias("company"), F.to_json(F.array(item)).alias("payload"))
    return adapters.parse("remoteok", landed).select("ats_id", "title", "location", "global_id")


#: A payload of each provider around the fields id, title and place of a row.
PAYLOADS = {
    "greenhouse": '{"jobs": [{"id": <id>, "title": <title>, "location": {"name": <place>}}]}',
    "join_com": '{"items": [{"id": <id>, "title": <title>, "location": <place>}]}',
    "gupy": '{"props": {"pageProps": {"jobs": [{"id": <id>, "name": <title>, "workplace": {"address": {"city": <place>}}}]}}}',
    "thehub": '{"docs": [{"id": <id>, "title": <title>, "status": "active", "location": {"address": <place>}}, {"id": <id>, "title": <title>, "status": "DRAFT"}]}',
    "uber": '{"jobs": [{"Id": <id>, "Title": <title>, "Locations": [{"City": <place>, "Region": <place>}, {"Address": <place>}]}]}',
    "wanted": '{"data": [{"id": <id>, "position": <title>, "address": {"location": <place>, "country": <place>}}]}',
    "recruiterbox": '{"objects": [{"id": <id>, "title": <title>, "url": "u", "location": {"state": <place>}}, {"id": <id>, "title": <title>}]}',
    "mercor": '{"listings": [{"listingId": <id>, "title": <title>, "location": <place>}, {"listingId": <id>}]}',
    "manfred": '[{"slug": <id>, "position": <title>, "status": "ACTIVE", "locations": ["", <place>]}]',
}


@query("""SELECT p.provider || ':' || p_partkey AS global_id, p_name AS title, p_type AS location
FROM part CROSS JOIN (SELECT unnest(['greenhouse', 'join_com', 'gupy', 'thehub', 'uber', 'wanted', 'recruiterbox', 'mercor', 'manfred']) AS provider) p""")
def payload_providers(t: Tables) -> DataFrame:
    quoted = lambda c: F.expr(f"substr(to_json(array(cast({c} as string))), 2, length(to_json(array(cast({c} as string)))) - 2)")
    out = None
    for provider, form in PAYLOADS.items():
        payload = F.lit(form)
        for name, c in (("id", "p_partkey"), ("title", "p_name"), ("place", "p_type")):
            payload = F.replace(payload, F.lit(f"<{name}>"), quoted(c))
        landed = t.part.select(F.col("p_brand").alias("company"), payload.alias("payload"))
        rows = adapters.parse(provider, landed).select("global_id", "title", "location")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Nation ' || n_name || ' | Port' WHEN s_suppkey % 3 = 1 THEN n_name || ', ' || r_name ELSE 'Old Town' END AS place, s_suppkey % 3 = 1 AND contains(lower(r_name), 'asia') AS near
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def place_forms(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    k, nation = F.col("s_suppkey") % 3, F.concat(F.lit("Nation "), F.col("n_name"))
    summary = F.when(k == 0, "2 Locations").when(k == 1, places.written(F.col("n_name"), F.lit(" "), F.col("r_name"), F.col("r_name"))).otherwise("Old  Town ")
    place = places.canonical(places.resolve_roll_up(summary, F.array(nation, F.lit("Port"), nation)), {"Old": "New"})
    return rows.select("s_suppkey", place.alias("place"), (places.is_near(place, ("asia",), ("port", "town")) & (k == 1)).alias("near"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS ats_id, CASE doc_id % 3 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'ONSITE' ELSE 'UNKNOWN' END AS work_mode, sha256('docs:' || doc_id) AS fingerprint, 'https://x.org/' || doc_id AS apply_url
FROM documents WHERE trim(source) <> ''""")
def store_rows(t: Tables) -> DataFrame:
    k, own = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    rows = t.documents.select(own.alias("ats_id"), F.concat(F.lit("docs:"), own).alias("global_id"), F.col("source").alias("title"), F.concat(F.lit("https://x.org/"), own).alias("url"), F.when(k == 0, "yes").when(k == 1, "no").alias("is_remote"))
    return normalise.to_store(rows, F.current_timestamp()).select("ats_id", "work_mode", "fingerprint", "apply_url")


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'own' ELSE coalesce(l.x, '') END AS description FROM documents d LEFT JOIN (SELECT doc_id, max('quality ' || quality) AS x FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
def description_backfill(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "own").otherwise("").alias("description"))
    cache = t.labels.select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("description"))
    return normalise.fill_descriptions(rows, cache, ["doc_id"])


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 80 WHEN 2 THEN 70 ELSE 10 END AS score, CASE s_suppkey % 4 WHEN 0 THEN 'VERIFIED' WHEN 3 THEN 'REJECTED' ELSE 'UNCERTAIN' END AS status FROM supplier""")
def page_verification(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 4
    page = F.when(k == 3, "about us").otherwise("Acme hires a data engineer in Pune. Apply now.")
    place = F.when(k == 1, "Oslo").otherwise("Pune")
    x = resolution.verify_page(F.lit("Acme Inc"), F.lit("Data Engineer"), place, page, k < 4, k < 2, F.when(k == 2, 2).when(k == 3, 0))
    return t.supplier.select("s_suppkey", x.alias("x")).select("s_suppkey", "x.score", "x.status")
