"""Queries of the engine's operators on the driver's tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.functions import text, urls, values
from postlode.operators import classify, dedup, frames, search, state
from postlode.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None):
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Search and look-ups


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_type), 'e')")
def search_literal(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", F.col("p_name").alias("title"), F.col("p_type").alias("location"))
    return search.search(rows, title="RING", location="E").select("p_partkey", F.col("title").alias("p_name"), "p_brand")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality = 1 OR (l.quality IS NULL AND contains(lower(d.source), '1'))")
def search_tristate_flag(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.col("source").alias("location"), (F.col("quality") == 1).alias("is_remote"))
    rows = rows.withColumn("location", F.when(F.contains("location", F.lit("1")), F.lit("remote")).otherwise("location"))
    return search.search(rows, remote=True).select("doc_id")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE coalesce(c_acctbal, 0) >= 1000 AND coalesce(c_acctbal, 1e308) <= 5000 AND coalesce(c_nationkey, 0) <= 12")
def search_range_coalesce(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("salary_max"), F.col("c_acctbal").alias("salary_min"), F.col("c_nationkey").alias("experience"))
    return search.search(rows, salary_min=1000, salary_max=5000, experience_max=12).select("c_custkey", F.col("salary_max").alias("c_acctbal"))


@query("""SELECT s_suppkey, s_name, 2 * CASE WHEN lower(s_name) = 'supplier#000000001' THEN 0 ELSE 1 END + CASE WHEN lower(s_name) = 'supplier#000000001' THEN 0 ELSE 1 END AS match_rank
FROM supplier WHERE contains(lower(s_name), 'supplier#000000001')""")
def find_company_ranked(t: Tables) -> DataFrame:
    return search.find_company(t.supplier.select("s_suppkey", "s_name"), "Supplier#000000001", "s_name", "s_name", "s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY coalesce(o_totalprice, 0) DESC, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100")
def active_topk(t: Tables) -> DataFrame:
    rows = t.orders.where(F.col("o_orderstatus").isin("O", "P"))
    return search.top(rows, 100, F.coalesce("o_totalprice", F.lit(0.0)).desc(), F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 150")
def fifo_batch(t: Tables) -> DataFrame:
    return search.first_batch(t.orders.select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(t: Tables) -> DataFrame:
    return frames.by_key(t.orders, "o_orderkey", 7).select("o_orderkey", "o_totalprice")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 10")
def rotation_window(t: Tables) -> DataFrame:
    return frames.rotation(t.nation.select("n_nationkey", "n_name"), "n_nationkey", 10, 5)


# Aggregations


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(*) FILTER (WHERE o_orderstatus = 'F') AS verified,
count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_totalprice >= 75000) AS high, count(*) FILTER (WHERE o_orderstatus = 'P') AS sent FROM orders""")
def store_statistics(t: Tables) -> DataFrame:
    tests = {"active": F.col("o_orderstatus") == "O", "verified": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT", "high": F.col("o_totalprice") >= 75000, "sent": F.col("o_orderstatus") == "P"}
    return frames.profile(t.orders, tests, total="total")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY event_type")
def group_counts(t: Tables) -> DataFrame:
    return frames.profile(t.events, {"n_high": F.col("value") > 50}, ("event_type",), {"n_users": "user_id"})


@query("SELECT s_nationkey, max(s_acctbal) AS best_balance, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS best_supplier FROM supplier GROUP BY s_nationkey")
def candidate_best(t: Tables) -> DataFrame:
    return frames.best_of(t.supplier, "s_nationkey", "s_acctbal", "s_suppkey", "best_supplier", "best_balance")


@query("SELECT p_brand, p_partkey, rn FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rn FROM part) WHERE rn <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    return frames.top_of(t.part, "p_brand", 3, F.desc("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey", "rn")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS description FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def description_compose(t: Tables) -> DataFrame:
    return frames.compose(t.conversations, "conv_id", ("turn", "role"), "text", "description")


@query("""WITH x AS (SELECT o_orderpriority, CASE WHEN o_custkey % 2 = 0 THEN month(o_orderdate) ELSE day(o_orderdate) END AS a, CASE WHEN o_custkey % 2 = 0 THEN day(o_orderdate) ELSE month(o_orderdate) END AS b FROM orders)
SELECT o_orderpriority, count(*) FILTER (a > 12 AND b <= 12) AS day_first, count(*) FILTER (b > 12 AND a <= 12) AS month_first,
count(*) FILTER (a > 12 AND b <= 12) > count(*) FILTER (b > 12 AND a <= 12) AS is_day_first FROM x GROUP BY o_orderpriority""")
def date_order_vote(t: Tables) -> DataFrame:
    """Half of the customers write the month first."""
    written = F.date_format("o_orderdate", "dd/MM/yyyy")
    mixed = F.when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(written)
    return frames.day_first_votes(t.orders, "o_orderpriority", mixed)


@query("SELECT event_type, strftime(ts, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def run_report(t: Tables) -> DataFrame:
    return frames.monthly(t.events, "event_type", "ts", "value")


# Deduplication and windows

_CANONICAL_SQL = r"""CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*(\?[^#]*)?(#.*)?$') THEN
lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '')
|| CASE WHEN len(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gh_src','gh_jid','source','src','ref','referrer','trk','trkcampaign','lever-source','lever_source','fbclid','gclid','msclkid','mc_cid','mc_eid'))) > 0
THEN '?' || array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gh_src','gh_jid','source','src','ref','referrer','trk','trkcampaign','lever-source','lever_source','fbclid','gclid','msclkid','mc_cid','mc_eid')), '&') ELSE '' END
ELSE url END"""


@query(f"SELECT page_id, {_CANONICAL_SQL} AS canonical_url FROM pages")
def url_canonical(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


@query(f"SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {_CANONICAL_SQL} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def dedup_url_exact(t: Tables) -> DataFrame:
    return dedup.keep_first(t.pages.select("page_id", urls.canonical(F.col("url")).alias("u")), ["u"], [F.col("page_id")]).select("page_id")


_SRC_SQL = "SELECT *, CASE l_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 5 ELSE 6 END AS prio, l_suppkey % 5 AS src FROM lineitem"


def _postings(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    src = F.col("l_suppkey") % 5
    return rows.withColumn("src", src).withColumn("prio", F.when(src.isin(0, 1), 1).when(src == 2, 3).when(src == 3, 5).otherwise(6))


_ORDER = ["prio", "l_orderkey", "l_linenumber", "l_suppkey"]


@query(f"""WITH w AS (SELECT *, min(src) OVER g <> max(src) OVER g AS cross_source, row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_linestatus ORDER BY prio, l_orderkey, l_linenumber, l_suppkey) AS rn
FROM ({_SRC_SQL}) WINDOW g AS (PARTITION BY l_partkey, l_returnflag, l_linestatus))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, src, prio FROM w WHERE NOT cross_source OR rn = 1""")
def dedup_cross_source(t: Tables) -> DataFrame:
    kept = dedup.cross_source(_postings(t), ["l_partkey", "l_returnflag", "l_linestatus"], "src", [F.col(c) for c in _ORDER])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "src", "prio")


@query("""WITH w AS (SELECT event_id, user_id, event_type, min(event_type) OVER g <> max(event_type) OVER g AS cross_source,
row_number() OVER (PARTITION BY user_id, CAST(floor(value / 10) AS BIGINT) ORDER BY event_type, event_id) AS rn FROM events WINDOW g AS (PARTITION BY user_id, CAST(floor(value / 10) AS BIGINT)))
SELECT event_id, user_id, event_type FROM w WHERE NOT cross_source OR rn = 1""")
def dedup_cross_id(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type", F.floor(F.col("value") / 10).alias("own_id"))
    return dedup.cross_source(rows, ["user_id", "own_id"], "event_type", [F.col("event_type"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query(r"""WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS core FROM documents),
w AS (SELECT *, min(source) OVER g <> max(source) OVER g AS cross_source, row_number() OVER (PARTITION BY core, lang ORDER BY source, doc_id) AS rn FROM d WHERE core <> '' WINDOW g AS (PARTITION BY core, lang))
SELECT doc_id FROM w WHERE NOT cross_source OR rn = 1 UNION ALL SELECT doc_id FROM d WHERE core IS NULL OR core = ''""")
def dedup_title_core_country(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", text.collapse(F.lower("text")).alias("core"))
    return dedup.where_valid(rows, F.col("core") != "", lambda d: dedup.cross_source(d, ["core", "lang"], "source", [F.col("source"), F.col("doc_id")])).select("doc_id")


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY prio, l_suppkey, l_partkey) AS rn FROM ({_SRC_SQL})),
b AS (SELECT *, min(src) OVER g <> max(src) OVER g AS x, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY prio, l_orderkey, l_linenumber, l_suppkey) AS r2 FROM a WHERE rn = 1 WINDOW g AS (PARTITION BY l_partkey, l_returnflag)),
c AS (SELECT *, min(src) OVER g <> max(src) OVER g AS y, row_number() OVER (PARTITION BY l_suppkey // 10, l_linestatus ORDER BY prio, l_orderkey, l_linenumber, l_suppkey) AS r3 FROM b WHERE NOT x OR r2 = 1 WINDOW g AS (PARTITION BY l_suppkey // 10, l_linestatus))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM c WHERE NOT y OR r3 = 1""")
def dedup_chain_survivors(t: Tables) -> DataFrame:
    order = [F.col(c) for c in _ORDER]
    k = dedup.keep_first(_postings(t), ["l_orderkey", "l_linenumber"], [F.col("prio"), F.col("l_suppkey"), F.col("l_partkey")])
    k = dedup.cross_source(k, ["l_partkey", "l_returnflag"], "src", order)
    k = dedup.cross_source(k.withColumn("g", F.floor(F.col("l_suppkey") / 10)), ["g", "l_linestatus"], "src", order)
    return k.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(None)
def dedup_fuzzy_blocks(t: Tables) -> DataFrame:
    mirror = F.when(F.col("p_partkey") % 3 == 0, "eures").when(F.col("p_partkey") % 3 == 1, "seek").otherwise("lever")
    company = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    rows = t.part.select(F.col("p_partkey").alias("row_order"), mirror.alias("source"), F.col("p_name").alias("title"), company.alias("company"), F.lit("DE").alias("country_iso"))
    return dedup.survivors(rows).select(F.col("row_order").alias("p_partkey"), "source")


# Joins and set operations


@query("SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE len(list_intersect(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' '))) >= 1")
def similarity_join_blocked(t: Tables) -> DataFrame:
    return frames.similar_pairs(t.part, "p_partkey", ["p_brand", "p_type", "p_size"], F.split(F.lower("p_name"), " "))


@query(r"""SELECT c_custkey, s_suppkey, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 ELSE len(list_intersect(ta, tb)) / CAST(len(list_distinct(list_concat(ta, tb))) AS DOUBLE) END AS similarity FROM (
SELECT *, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM (SELECT c_custkey, s_suppkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey))""")
def company_similarity(t: Tables) -> DataFrame:
    # Names are normalised once a row, behind the shuffle and before the join makes pairs of them.
    made = lambda name, to: lambda df: df.select(*(c for c in df.columns if c != name), F.inline(F.array(classify.company_parts(F.col(name)))).alias(*(f"{to}_{p}" for p in classify.COMPANY_PARTS)))
    pairs = frames.spread_join(t.customer.select("c_custkey", "c_nationkey", "c_name"), t.supplier.select("s_suppkey", "s_nationkey", "s_name"), "c_nationkey", "s_nationkey", made("c_name", "a"), made("s_name", "b"))
    a, b = (F.struct(*(F.col(f"{to}_{p}").alias(p) for p in classify.COMPANY_PARTS)) for to in "ab")
    return pairs.select("c_custkey", "s_suppkey", classify.company_similarity(a, b).alias("similarity"))


_ROLES = [("brass", "metal", 80), ("steel", "metal", 90), ("economy", "grade", 70), ("small", "size", 100), ("promo", "grade", 95)]
_ROLES_SQL = ", ".join(f"('{p}', '{r}', {n})" for p, r, n in _ROLES)


@query(f"""SELECT p_partkey, role, phrase FROM (SELECT p_partkey, role, phrase, row_number() OVER (PARTITION BY p_partkey ORDER BY prio DESC, length(phrase) DESC, phrase DESC) AS rn
FROM part JOIN (VALUES {_ROLES_SQL}) v(phrase, role, prio) ON contains(lower(p_type), phrase)) WHERE rn = 1""")
def role_theta_join(t: Tables) -> DataFrame:
    roles = t.spark.createDataFrame(_ROLES, "phrase string, role string, role_priority int")
    return classify.best_role(t.part.select("p_partkey", "p_type"), "p_type", roles, ["p_partkey"]).where("role is not null").select("p_partkey", "role", "phrase")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(t: Tables) -> DataFrame:
    return frames.look_up(t.customer, (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT page_id, regexp_extract(lower(url), '://([^/?#]*)', 1) AS host, array_to_string(list_slice(string_split(regexp_extract(lower(url), '://([^/?#]*)', 1), '.'), -2, -1), '.') AS domain, CASE WHEN regexp_matches(url, '://([^/]*\\.)?example\\.com([/?#]|$)') THEN 'board' WHEN regexp_matches(url, '://([^/]*\\.)?example\\.net([/?#]|$)') THEN 'third_party' ELSE 'other' END AS url_class FROM pages".replace("\\\\", "\\"))
def url_host_class(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", urls.host(u).alias("host"), urls.base_domain(u).alias("domain"), urls.url_class(u, {"board": ("example.com",), "third_party": ("example.net",)}).alias("url_class"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS suppkey, CAST(c_nationkey AS VARCHAR) AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_suppkey, CAST(s_nationkey AS VARCHAR) FROM supplier")
def union_by_name_widen(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").cast("string").alias("nation"))
    return frames.widened(a, b)


@query("SELECT n_name AS place FROM nation UNION SELECT r_name FROM region")
def lexicon_union_distinct(t: Tables) -> DataFrame:
    return frames.lexicon(t.nation.select(F.col("n_name").alias("place")), t.region.select("r_name"))


@query("""SELECT substr(sha256(lower(r_name) || '|' || lower(n_name) || '|' || w), 1, 16) AS query_id, r_name, n_name, w AS modifier, '"' || n_name || '" ' || w AS query
FROM region CROSS JOIN nation CROSS JOIN (VALUES ('fresher'), ('intern'), ('trainee')) v(w)""")
def query_crossproduct(t: Tables) -> DataFrame:
    words = t.spark.createDataFrame([("fresher",), ("intern",), ("trainee",)], "modifier string")
    rows = t.region.select("r_name").crossJoin(t.nation.select("n_name")).crossJoin(words)
    return rows.select(values.short_id(F.col("r_name"), F.col("n_name"), F.col("modifier")).alias("query_id"), "r_name", "n_name", "modifier", F.concat(F.lit('"'), "n_name", F.lit('" '), "modifier").alias("query"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') ON l_orderkey = o_orderkey")
def semi_join_survivors(t: Tables) -> DataFrame:
    keep = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return frames.only(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), keep, "l_orderkey")


# State, queue, histories


@query("""WITH last AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS title FROM orders GROUP BY o_custkey)
SELECT coalesce(c_custkey, o_custkey) AS id, coalesce(l.title, c.c_name) AS title, CASE WHEN c_custkey IS NULL THEN 9 ELSE 1 END AS first_seen, CASE WHEN o_custkey IS NULL THEN 2 ELSE 9 END AS last_seen,
CASE WHEN c_custkey IS NULL THEN 1 WHEN o_custkey IS NULL THEN 1 ELSE 2 END AS check_count, CASE WHEN o_custkey IS NULL THEN 'MISSING' ELSE 'ACTIVE' END AS status FROM customer c FULL JOIN last l ON c.c_custkey = l.o_custkey""")
def upsert_state(t: Tables) -> DataFrame:
    """Customers as the state, orders as a batch in which a customer comes more than once."""
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(1).alias("first_seen"), F.lit(2).alias("last_seen"), F.lit(1).alias("check_count"), F.lit("MISSING").alias("status"))
    batch = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("__order"))
    return state.upsert(old, batch, "id", F.lit(9))


@query("SELECT event_id, user_id, old_value, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events) WHERE old_value IS NOT NULL AND old_value <> event_type")
def status_history(t: Tables) -> DataFrame:
    return state.change_log(t.events.select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "old_value", "event_type")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 90 AND event_type = 'purchase')")
def mark_missing(t: Tables) -> DataFrame:
    active = t.events.select("user_id").distinct()
    return state.missing(active, t.events.where("value > 90 and event_type = 'purchase'"), "user_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def queue_enqueue(t: Tables) -> DataFrame:
    return state.enqueue(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def queue_cleanup(t: Tables) -> DataFrame:
    queue = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return state.cleanup(queue, t.customer, "c_custkey", F.col("c_acctbal") > 0).select("o_orderkey", F.col("c_custkey").alias("o_custkey"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100")
def queue_ready(t: Tables) -> DataFrame:
    queue = t.orders.where("o_orderstatus = 'O'")
    return frames.ready(queue, t.customer, F.col("o_custkey") == F.col("c_custkey"), "o_orderkey", 100).select("o_orderkey", "c_name")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND ts < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def stale_lease(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    return state.expired(t.events.where("event_type = 'error'").crossJoin(now), "ts", F.col("now")).select("event_id")


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.lang = 'en' AND d.n_chars >= 75 AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def not_yet_alerted(t: Tables) -> DataFrame:
    good = frames.only(t.documents.where("lang = 'en' and n_chars >= 75").select("doc_id"), t.labels.where("quality = 1"), "doc_id")
    return frames.not_yet(good, t.labels.where("toxic = 1"), "doc_id")


@query("SELECT c_custkey, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def sparse_update(t: Tables) -> DataFrame:
    new = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return state.sparse_update(t.customer.select("c_custkey", "c_acctbal"), new, "c_custkey")


# Scalar functions on columns


@query("SELECT c_custkey, sha256(lower(concat_ws('|', trim(c_name), trim(c_mktsegment), CAST(c_nationkey AS VARCHAR)))) AS fingerprint FROM customer")
def fingerprint_sha256(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", values.fingerprint(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("fingerprint"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_text(F.col("html")).alias("body"))


@query("SELECT doc_id, lang || ' ' || chr(CAST(161 + doc_id % 50000 AS INTEGER)) || chr(CAST(65536 + doc_id AS INTEGER)) || ' é&#38;' || source AS body FROM documents")
def character_references(t: Tables) -> DataFrame:
    """References by number, in both notations and beyond 16 bits, by name, and one that is decoded once only."""
    code = lambda n: F.concat(F.lit("&#"), n.cast("string"), F.lit(";"))
    written = F.concat("lang", F.lit("&nbsp;"), code(161 + F.col("doc_id") % 50_000), F.lit("&#x"), F.hex(65_536 + F.col("doc_id")), F.lit(";&nbsp;&eacute;&amp;#38;"), "source")
    return t.documents.select("doc_id", text.html_text(written).alias("body"))


@query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title FROM pages")
def html_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_title(F.col("html")).alias("title"))


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)href="([^"]*)"', 1))) AS n_links, regexp_extract(html, '(?i)href="([^"]*)"', 1) AS first_link FROM pages""")
def html_links(t: Tables) -> DataFrame:
    links = text.html_links(F.col("html"))
    return t.pages.select("page_id", F.size(links).cast("long").alias("n_links"), F.coalesce(F.get(links, 0), F.lit("")).alias("first_link"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(p_type), '&', ' and '), '[/|]+', ' ', 'g'), '[^a-z0-9+#.\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS match_text, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS company_key, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9,\-/ ]', ' ', 'g'), '\s+', ' ', 'g')) AS place_text FROM part")
def normalise_titles(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.match_text(F.col("p_type")).alias("match_text"), text.company_key(F.col("p_name")).alias("company_key"), text.place_text(F.col("p_name")).alias("place_text"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) * 1000 AS low, CAST(p_size + 25 AS DOUBLE) * 1000 AS high FROM part""")
def salary_range_parse(t: Tables) -> DataFrame:
    written = F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit("K - $"), (F.col("p_size") + 25).cast("string"), F.lit("K"))
    r = values.salary_range(written)
    return t.part.select("p_partkey", r["min"].alias("low"), r["max"].alias("high"))


@query("SELECT p_partkey, p_size % 10 AS low, CASE p_size % 3 WHEN 0 THEN p_size % 10 + 3 WHEN 1 THEN NULL ELSE p_size % 10 END AS high FROM part")
def experience_range(t: Tables) -> DataFrame:
    n = F.col("p_size") % 10
    written = F.when(F.col("p_size") % 3 == 0, F.concat(n.cast("string"), F.lit("-"), (n + 3).cast("string"), F.lit(" years"))).when(F.col("p_size") % 3 == 1, F.concat(n.cast("string"), F.lit("+ yrs"))).otherwise(F.concat(n.cast("string"), F.lit(" years of work")))
    r = values.experience_range(written)
    return t.part.select("p_partkey", r["min"].alias("low"), r["max"].alias("high"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) // 1000000 - 21 * 86400 AS three_weeks_before FROM events")
def time_parse(t: Tables) -> DataFrame:
    iso = values.iso_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    ago = values.relative_time(F.lit("3 weeks ago"), values.epoch_time(F.unix_timestamp(iso).cast("string")))
    return t.events.select("event_id", F.unix_timestamp(iso).alias("seconds"), F.unix_timestamp(ago).alias("three_weeks_before"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def raw_json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT s_suppkey AS id, coalesce(NULL, s_name) AS company FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_name IS NOT NULL AND trim(c_name) <> ''")
def tolerant_registry_union(t: Tables) -> DataFrame:
    from postlode.sources.readers import registry_columns

    a = registry_columns(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("Company_Name")), ["id"])
    return a.unionByName(registry_columns(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("employer")), ["id"]))


# Classification


@query(r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'phone' END, CASE WHEN regexp_matches(text, '[a-z0-9]+@[a-z0-9.]+') THEN 'mail' END, CASE WHEN regexp_matches(text, 'https?://') THEN 'link' END], lambda x: x IS NOT NULL), ',') AS signals FROM documents")
def scam_signal_list(t: Tables) -> DataFrame:
    found = text.matching(F.col("text"), {"phone": "[0-9]{3}-[0-9]{4}", "mail": "[a-z0-9]+@[a-z0-9.]+", "link": "https?://"})
    return t.documents.select("doc_id", F.array_join(found, ",").alias("signals"))


@query("SELECT o_orderkey, least(100, 50 + 15 + CASE WHEN o_orderstatus IS NOT NULL AND trim(o_orderstatus) <> '' THEN 10 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN o_totalprice IS NOT NULL THEN 5 ELSE 0 END) AS confidence FROM orders LEFT JOIN labels ON o_orderkey = doc_id")
def completeness_confidence(t: Tables) -> DataFrame:
    rows = t.orders.join(t.labels, F.col("o_orderkey") == F.col("doc_id"), "left")
    return rows.select("o_orderkey", classify.completeness(id=(F.col("o_orderkey"), 15), url=(F.col("o_orderstatus"), 10), title=(F.col("quality"), 5), company=(F.col("o_totalprice"), 5)).alias("confidence"))


@query("""SELECT doc_id, greatest(0, least(100, CASE WHEN lang = 'en' THEN 25 ELSE 0 END + CASE WHEN n_chars > 500 THEN 20 ELSE 0 END + CASE WHEN quality = 1 THEN 40 ELSE 0 END + CASE WHEN toxic = 1 THEN -40 ELSE 0 END)) AS score FROM documents LEFT JOIN labels USING (doc_id)""")
def evidence_score(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    points = {"language": (F.col("lang") == "en", 25), "length": (F.col("n_chars") > 500, 20), "quality": (F.col("quality") == 1, 40), "toxic": (F.col("toxic") == 1, -40)}
    return rows.select("doc_id", classify.evidence(points).alias("score"))


# Streams, as batches of what is there


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS check_count FROM events GROUP BY user_id")
def stream_upsert(t: Tables) -> DataFrame:
    from postlode.streaming.streams import run_upsert

    return run_upsert(t.spark, t.dir, "events")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    from postlode.streaming.streams import run_first_seen

    return run_first_seen(t.spark, t.dir, "events", ["user_id", "event_type"])


# Discovery and resolution


@query("""SELECT DISTINCT substr(sha256('engine|' || lower(p_type) || ' ' || m || ' ' || lower(r_name)), 1, 16) AS query_id, lower(p_type) || ' ' || m || ' ' || lower(r_name) AS query
FROM (SELECT DISTINCT p_type FROM part) CROSS JOIN region CROSS JOIN (VALUES ('fresher'), ('intern')) v(m)""")
def discovery_queries(t: Tables) -> DataFrame:
    from postlode.operators import discovery

    roles = t.part.select(F.col("p_type").alias("role")).distinct()
    engines = t.spark.createDataFrame([("engine",)], "source string")
    made = discovery.generate(roles, engines, t.region.select(F.col("r_name").alias("place")), ("fresher", "intern"))
    return made.select("query_id", "query")


def _order_postings(t: Tables) -> DataFrame:
    """Orders as postings: the customer is the company."""
    word = F.regexp_extract("o_orderpriority", "([A-Z]+)", 1)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("company"), word.alias("title"), F.concat(F.lit("place"), F.lower("o_orderstatus")).alias("location"), F.lit(None).cast("string").alias("requisition_id"), F.lit(False).alias("is_ats"))


@query("""WITH pairs AS (SELECT a.o_orderkey AS id, b.o_orderkey AS official_id, CAST(30 + CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 35 ELSE 0 END + CASE WHEN a.o_orderstatus = b.o_orderstatus THEN 20 ELSE 0 END + 0 AS DOUBLE) AS score
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey IS DISTINCT FROM b.o_orderkey)
SELECT id, official_id, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, official_id) AS rn FROM pairs WHERE score >= 40) WHERE rn <= 2""")
def entity_resolution_all(t: Tables) -> DataFrame:
    """Every order against every other order of its customer."""
    from postlode.operators import resolution

    rows = _order_postings(t)
    return resolution.candidates(rows, rows, k=2, others=True)


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 1 AND n_chars > 1000 THEN 'VERIFIED' WHEN n_chars > 1000 THEN 'UNCERTAIN' ELSE 'NOT_VERIFIED' END AS status
FROM documents LEFT JOIN labels USING (doc_id)""")
def verification_status(t: Tables) -> DataFrame:
    from postlode.operators import resolution

    rows = t.documents.join(t.labels, "doc_id", "left")
    score = F.when(F.col("n_chars") > 1000, 80).otherwise(10)
    return rows.select("doc_id", resolution.status(score, F.coalesce(F.col("quality") == 1, F.lit(False)), F.lit(False), F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("status"))
