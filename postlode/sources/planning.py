"""Scans of providers that return no more than a fixed number of rows a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.staging import written


def plan_scans(totals: DataFrame, cap: int) -> DataFrame:
    """query, facet, value, expected, whole: the scans that together give all rows of each query.

    totals: query, total, facets (array of struct facet, value, total). A query below the cap is one scan. Another is
    cut by the first facet (by name) whose values add up to the total and stay below the cap each; if none does, by the
    one that covers most, and whole is false: the caller cuts it again, or refuses an incomplete result.
    """
    each = totals.select("query", "total", F.explode_outer("facets").alias("f")).select("query", "total", "f.facet", "f.value", F.col("f.total").alias("expected"))
    facets = each.groupBy("query", "facet").agg(F.sum("expected").alias("covered"), F.max("expected").alias("most"), F.max("total").alias("total"))
    fits = (F.col("covered") == F.col("total")) & (F.col("most") < cap)
    best = facets.groupBy("query").agg(F.min_by(F.struct("facet", fits.alias("whole")), F.struct((~fits).cast("int"), -F.coalesce("covered", F.lit(0)), "facet")).alias("b"))
    cut = each.where(F.col("total") >= cap).join(best, "query").where("facet = b.facet or b.facet is null")
    cut = cut.select("query", "facet", "value", F.coalesce("expected", "total").alias("expected"), F.coalesce("b.whole", F.lit(False)).alias("whole"))
    single = totals.where(F.col("total") < cap).select("query", F.lit(None).cast("string").alias("facet"), F.lit(None).cast("string").alias("value"), F.col("total").alias("expected"), F.lit(True).alias("whole"))
    return single.unionByName(cut)


def subdivide(rows: DataFrame, query: str, facets: list[str], cap: int) -> DataFrame:
    """query, path (array of struct facet, value), expected, whole: scans below the cap that together give all rows.

    A query of cap rows or more is cut by a facet, and each part that is still too large by another, until none is or no
    facet is left. Of the facets not used yet, one that shows all rows of the scan (none of its values is null) goes
    before one that does not, then the one whose largest part is smallest, then the name. whole is false where the scans
    of a path can't be proven to give its rows: below a facet that hides some, or at the cap with no facet left; the
    caller refuses such a result. Rows are counted once by query and facets; rounds, one a facet at most, work on these
    counts, each written down. Null queries are one of their own; facets are compared as text.
    """
    path = F.array().cast("array<struct<facet: string, value: string>>")
    cells = rows.select(F.col(query).alias("query"), *(F.col(f).cast("string").alias(f"__{i}") for i, f in enumerate(facets)))
    cells = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("path", path).withColumn("whole", F.lit(True))
    shown = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f"__{i}").alias("value")) for i, f in enumerate(facets))).cast("array<struct<facet: string, value: string>>")
    scan, out = ["query", "path", "whole"], None
    same = lambda a, b: F.col(f"{a}.query").eqNullSafe(F.col(f"{b}.query")) & (F.col(f"{a}.path") == F.col(f"{b}.path"))
    for level in range(len(facets) + 1):
        cells = written(cells, "cells")
        totals = cells.groupBy(*scan).agg(F.sum("n").alias("expected"))
        fits = totals.where(F.col("expected") < cap) if level < len(facets) else totals.withColumn("whole", F.col("whole") & (F.col("expected") < cap))
        out = fits if out is None else out.unionByName(fits)
        over = written(totals.where(F.col("expected") >= cap), "frontier")
        if level == len(facets) or over.isEmpty():
            break
        left = cells.alias("c").join(over.alias("o"), same("c", "o")).select("c.*")
        free = F.filter(shown, lambda s: ~F.exists("path", lambda p: p["facet"] == s["facet"]))
        parts = left.select("query", "path", "n", F.explode(free).alias("s")).groupBy("query", "path", "s.facet", "s.value").agg(F.sum("n").alias("n"))
        rated = parts.groupBy("query", "path", "facet").agg(F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("most"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("hidden"))
        order = F.struct(F.col("hidden") > 0, "most", "facet")
        best = rated.where("most is not null").groupBy("query", "path").agg(F.min_by(F.struct("facet", "hidden"), order).alias("by"))
        # A scan of which no facet shows a row stays as it is, and is not whole.
        stuck = over.alias("o").join(best.alias("b"), same("o", "b"), "left_anti").select("query", "path", F.lit(False).alias("whole"), "expected")
        out = out.unionByName(stuck)
        chosen = left.alias("c").join(best.alias("b"), same("c", "b")).select("c.*", "by").withColumn("__s", F.get(F.filter(shown, lambda s: s["facet"] == F.col("by.facet")), 0))
        cells = chosen.where("__s.value is not null").withColumn("path", F.concat("path", F.array("__s"))).withColumn("whole", F.col("whole") & (F.col("by.hidden") == 0)).drop("by", "__s")
    return out.select("query", "path", "expected", "whole")


def completeness(totals: DataFrame, rows: DataFrame, query: str, key: str) -> DataFrame:
    """query, expected, found, complete: whether the distinct keys that the scans of a query gave are as many as advertised.

    totals: query, total. Overlapping scans give a key more than once; it counts once. Queries without a row have 0.
    """
    got = rows.select(F.col(query).alias("__query"), F.col(key).alias("__key")).where("__key is not null").distinct().groupBy("__query").agg(F.count(F.lit(1)).alias("found"))
    joined = totals.join(got, F.col("query").eqNullSafe(F.col("__query")), "left")
    found = F.coalesce("found", F.lit(0))
    return joined.select("query", F.col("total").alias("expected"), found.alias("found"), (found == F.col("total")).alias("complete"))
