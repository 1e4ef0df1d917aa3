"""Cross-source deduplication: sequential passes of windows, and a greedy fuzzy pass in blocks.

Order within all passes: priority of the source, then the row's own order. A pass sees what the one before has kept.
Rows without a valid key are groups of their own within a window, so blank keys never meet in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlode.functions import text, values
from postlode.operators import near_titles
from postlode.shipping import ship
from postlode.staging import written

#: Priorities of sources; 2 where a source is not among them.
PRIORITY = {
    "adp": 1, "ashby": 1, "avature": 1, "bamboohr": 1, "beisen": 1, "beisen_legacy": 1, "breezy": 1, "cornerstone": 1, "darwinbox": 1,
    "dayforce": 1, "greenhouse": 1, "gupy": 1, "herp": 1, "hrmos": 1, "icims": 1, "jazzhr": 1, "join_com": 1, "jobvite": 1, "keka": 1,
    "lever": 1, "moka": 1, "oracle": 1, "pageup": 1, "paycom": 1, "paylocity": 1, "personio": 1, "phenom": 1, "pinpoint": 1,
    "recruitee": 1, "recruiterbox": 1, "rippling": 1, "smartrecruiters": 1, "softgarden": 1, "successfactors": 1, "taleo": 1,
    "teamtailor": 1, "ukg": 1, "workable": 1, "workday": 1, "amazon": 1, "apple": 1, "bytedance": 1, "google": 1, "meta": 1, "tesla": 1,
    "tiktok": 1, "uber": 1, "welcometothejungle": 3, "mercor": 3, "gem": 3, "seek": 4, "eightfold": 5, "bundesagentur": 6,
    "arbetsformedlingen": 6, "jobbankca": 6, "usajobs": 6,
}
#: The columns that name a posting of a source whose tenants share postings; elsewhere tenant and id do.
OWN_KEYS = {"oracle": "ats_id", "icims": "url"}


def priority(source: Column) -> Column:
    of = lambda rank: source.isin(*(s for s, r in PRIORITY.items() if r == rank))
    return F.coalesce(*(F.when(of(rank), rank) for rank in sorted({*PRIORITY.values()})), F.lit(2))


def scan_key(source: Column, tenant: Column, ats_id: Column, url: Column) -> Column:
    """What tells the postings of one scan apart: by source the id alone, the URL alone, or the id within the tenant."""
    own = {"ats_id": ats_id, "url": url}
    out = F.when(F.lit(False), F.lit(""))
    for name, column in OWN_KEYS.items():
        out = out.when(source == name, F.concat_ws("|", source, own[column]))
    return out.otherwise(F.concat_ws("|", source, tenant, ats_id))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def cross_source(df: DataFrame, keys: list[str], source: str, order: list[Column]) -> DataFrame:
    """All rows of keys that one source has; of others the first row."""
    w = Window.partitionBy(*keys)
    marked = df.withColumn("__cross", F.min(source).over(w) != F.max(source).over(w)).withColumn("__rank", F.row_number().over(w.orderBy(*order)))
    return marked.where(~F.col("__cross") | (F.col("__rank") == 1)).drop("__cross", "__rank")


def where_valid(df: DataFrame, valid: Column, step) -> DataFrame:
    ok = F.coalesce(valid, F.lit(False))
    return step(df.where(ok)).unionByName(df.where(~ok))


def token_set_ratio(a: str | frozenset, b: str | frozenset, cutoff: float = 0.0) -> float:
    """100 for equal word sets or a set within the other; else the best of three indel ratios (the public definition).

    Below cutoff the result is 0, found by lengths alone where they suffice.
    """
    x, y = (frozenset(s.split()) if isinstance(s, str) else s for s in (a, b))
    if not x or not y:
        return 0.0
    shared, left, right = x & y, x - y, y - x
    if shared and (not left or not right):
        return 100.0
    size = lambda words: sum(map(len, words)) + max(0, len(words) - 1)
    s, p, n, m = size(shared), 1 if shared else 0, size(left), size(right)
    total = 2 * (s + p) + n + m
    best = max(100 * (1 - (p + n) / (2 * s + p + n)), 100 * (1 - (p + m) / (2 * s + p + m))) if shared else 0.0
    if best < cutoff and 100 * (1 - abs(n - m) / total) < cutoff:
        return 0.0
    best = max(best, 100 * (1 - _indel(" ".join(sorted(left)), " ".join(sorted(right))) / total))
    return best if best >= cutoff else 0.0


def _indel(a: str, b: str) -> int:
    """Insertions and deletions between two strings: both lengths less twice the longest common subsequence."""
    row, mask = (1 << len(b)) - 1, {}
    for i, ch in enumerate(b):
        mask[ch] = mask.get(ch, 0) | 1 << i
    for ch in a:
        u = row & mask.get(ch, 0)
        row = (row + u) | (row - u)
    common = len(b) - (row & ((1 << len(b)) - 1)).bit_count()
    return len(a) + len(b) - 2 * common


#: Blocks of so many rows are compared row by row in one task; larger ones go through the index of near_titles.
SMALL = 200


def _fuzzy(threshold: float, keep: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2 or rows["source"].nunique() < 2:
            return rows[keep]
        rows = rows.sort_values(["priority", "row_order", "source"], kind="stable")
        # Rows of one source and the same words share the fate of their first.
        fate: dict[tuple[str, frozenset], bool] = {}
        stays = []
        for source, title in zip(rows["source"].tolist(), rows["title_raw"].fillna("").tolist(), strict=True):
            own = (source, frozenset(title.split()))
            if own not in fate:
                fate[own] = not any(ok and s != source and token_set_ratio(words, own[1], threshold) >= threshold for (s, words), ok in fate.items())
            stays.append(fate[own])
        return rows.loc[stays, keep]

    return run


def fuzzy(df: DataFrame, block: list[str], threshold: float = 90.0, cap: int | None = None, small: int = SMALL) -> DataFrame:
    """Within a block, rows whose title nearly equals a kept row's of another source go.

    df: source, row_order (unique within a source), priority, title_raw, and the columns of block (none null). Blocks of
    up to small rows are compared in one task each, larger ones by an index and in rounds, to the same result. cap:
    blocks of more rows stay whole, as a rule of the caller's; by default there is none.
    """
    rows = written(df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*block))))
    large = rows.where((F.col("__n") > small) & (F.col("__n") <= (cap if cap is not None else 2**62))).drop("__n")
    near = rows.where((F.col("__n") <= small) & (F.col("__n") > 1) & (F.col("__n") <= (cap if cap is not None else 2**62))).drop("__n")
    # A fixed number of partitions: the rows are few bytes and much work, so they must not be merged into few tasks.
    spread = near.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *block)
    out = rows.where((F.col("__n") == 1) | (F.col("__n") > (cap if cap is not None else 2**62))).drop("__n").unionByName(spread.groupBy(*block).applyInPandas(_fuzzy(threshold, df.columns), df.schema))
    if large.isEmpty():
        return out
    return out.unionByName(large.join(near_titles.dropped(large, block, threshold), ["source", "row_order"], "left_anti").select(*df.columns))


def _pass(k: DataFrame, keys: dict[str, Column], needed: list[str], order: list[Column], cross: bool, within: tuple[str, ...] = ()) -> DataFrame:
    """First of each key whose needed parts are not empty (cross: only of keys that two sources have); other rows stay.

    Rows are dealt by a hash of the key, with its parts made behind the shuffle; sorts compare that number and turn to
    the texts only within a group. Dealt before, not by the window, so that nothing is sorted in front of the shuffle
    either. within: columns by which k is dealt already; keys are told apart within them.
    """
    own = ("source", "row_order")
    valid = lambda parts: F.coalesce(reduce(and_, (parts[c] != "" for c in needed)), F.lit(False))
    k = k.withColumn("__mark", F.when(valid(keys), F.xxhash64(*keys.values())).otherwise(F.xxhash64(*own)))
    k = k if within else k.repartition("__mark")
    # A row without a valid key is told apart by its own name.
    k = k.withColumns({f"__key_{c}": v for c, v in keys.items()})
    ok = valid({c: F.col(f"__key_{c}") for c in keys})
    k = k.withColumns({f"__own_{c}": F.when(~ok, F.col(c)) for c in own})
    w = Window.partitionBy(*within, "__mark", *(f"__key_{c}" for c in keys), *(f"__own_{c}" for c in own)).orderBy(*order)
    stays = F.row_number().over(w) == 1
    if cross:
        # Most rows of keys with two sources leave here, so that only those that may stay are numbered; the sort is one.
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        k = k.withColumns({"__single": F.min("source").over(whole) == F.max("source").over(whole), "__leads": F.first("row_order").over(whole).eqNullSafe(F.col("row_order"))})
        k = k.where("__single or __leads")
        stays = stays | F.col("__single")
    k = k.withColumn("__stays", stays).where("__stays")
    return k.drop("__mark", "__stays", "__single", "__leads", *(f"__key_{c}" for c in keys), *(f"__own_{c}" for c in own))


def survivor_keys(df: DataFrame, threshold: float = 90.0, cap: int | None = None, small: int = SMALL) -> DataFrame:
    """source, row_order of the rows that stay after all passes.

    df: source, row_order (unique within a source), url, title, company, location, country_iso, ats_id; any of the
    last six may be absent, and null counts as empty. One scan of these thin columns, a shuffle for each of the first
    three passes, and one more that the last two share. Normal forms that a pass needs are made in front of it, of the
    rows that the passes before have kept. cap: see fuzzy(); of 1 or less, there is no fuzzy pass.
    """
    ship(df.sparkSession)
    given = {c: F.col(c).cast("string") if c in df.columns else F.lit("") for c in ("url", "title", "company", "location", "country_iso", "ats_id")}
    k = df.select("source", "row_order", priority(F.col("source")).alias("priority"), *(v.alias(c) for c, v in given.items()))
    order = [F.col("priority"), F.col("row_order"), F.col("source")]
    k = _pass(k.withColumn("url", text.key_text(F.col("url"))), {"url": F.col("url")}, ["url"], order, cross=False)
    k = k.withColumns({c: text.key_text(F.col(c)) for c in ("title", "company", "location")})
    k = _pass(k, {c: F.lower(c) for c in ("company", "title", "location")}, ["company", "title"], order, cross=True)
    k = k.withColumns({"key": text.company_key(F.col("company")), "ats_id": text.key_text(F.col("ats_id"))})
    k = _pass(k, {c: F.col(c) for c in ("key", "ats_id")}, ["key", "ats_id"], order, cross=True)
    # Without a company there is no block, and without a block no core: the costly forms are not made of such rows.
    country = F.coalesce(F.nullif(F.upper(text.key_text(F.col("country_iso"))), F.lit("")), values.country_of(F.col("location")))
    k = k.withColumn("country", F.when(F.col("key") != "", country).otherwise(""))
    blocked = F.col("country") != ""
    block = ["__key", "__country", "__salt"]
    k = k.withColumns({"core": F.when(blocked, F.coalesce(text.title_core(F.col("title")), F.lit(""))).otherwise(""), "__key": F.when(blocked, F.col("key")).otherwise(""), "__country": F.col("country"), "__salt": F.when(blocked, 0).otherwise(F.pmod(F.xxhash64("source", "row_order"), F.lit(1_000)).cast("int"))}).repartition(*block)
    k = _pass(k, {"core": F.col("core")}, ["core"], order, cross=True, within=tuple(block))
    thin = k.select("source", "row_order", "priority", F.col("title").alias("title_raw"), *block)
    if cap is not None and cap <= 1:
        return thin.select("source", "row_order")
    thin = written(thin)
    # Rows without a block meet nobody and stay.
    return thin.where("__key = ''").unionByName(fuzzy(thin.where("__key <> ''"), block, threshold, cap, small)).select("source", "row_order")


def survivors(df: DataFrame, threshold: float = 90.0, cap: int | None = None, small: int = SMALL) -> DataFrame:
    """The rows of df that survivor_keys() names; all their columns are read once, behind the decision."""
    return df.join(survivor_keys(df, threshold, cap, small), ["source", "row_order"], "left_semi").select(*df.columns)
