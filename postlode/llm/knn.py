"""Exact top-k by inner product: a Voronoi kNN join.

1. Pivots are data vectors, spread by farthest-first choice from a bounded sample; their number grows with the square
   root of the data's, from LEAST_PIVOTS to MOST_PIVOTS. Data goes to the cell of its nearest pivot.
2. The summary of a cell holds the distance of its farthest member and its k + 1 members nearest to the pivot, as
   vectors: pivots * (k + 1) rows at most, whatever the data.
3. Each query scores the summaries' vectors; its k-th best is a score that its k-th neighbour reaches at least. For a
   member s of the cell of pivot p, q.s <= q.p + |q| |s - p| (Cauchy-Schwarz on the residual), so the query needs only
   members at least (that score - q.p) / |q| away from their pivot, and only cells whose farthest member is. The least
   such distance over a group of queries (those of one or more neighbouring cells, up to QUERY_BLOCK) decides which
   members are replicated to it; a query itself goes to the cells that it needs and to no other.
4. Queries of a group meet a cell in blocks of DATA_BLOCK vectors, score them by a matrix product, and send k rows a
   query on; these are merged per query.

Distances are floating-point, so bounds give way by SLACK; scores are exact. Integer products are computed in doubles
where they stay below 2^53, else in exact Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlode.llm._tables import cut

LEAST_PIVOTS, MOST_PIVOTS, SAMPLE, QUERY_BLOCK, DATA_BLOCK, SLACK = 16, 512, 4_096, 2_000, 20_000, 1e-6


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of long) of the vectors without null or non-finite components, null vectors or null ids.

    Components whose scaled value does not fit a long make the vector take no part, as non-finite ones do.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) * scale >= F.lit(9.2e18)))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, those that are shorter filled with zeros."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths())
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors, each the farthest from those chosen before it; fewer if no other differs."""
    chosen = [0]
    left = _distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < n and left.max() > 0:
        chosen.append(int(left.argmax()))
        left = np.minimum(left, _distances(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column of the k best of each row, without its own id, ties to the smaller id. ids ascending."""
    rows, columns = [], []
    for i in range(len(scores)):
        ok = np.flatnonzero(ids != own[i])
        s = scores[i][ok]
        if len(s) > 4 * k and s.dtype != object:
            least = np.partition(s, len(s) - k)[len(s) - k]
            keep = np.flatnonzero(s >= least)
            ok, s = ok[keep], s[keep]
        order = sorted(range(len(s)), key=lambda j: (-int(s[j]), int(ids[ok[j]])))[:k]
        rows += [i] * len(order)
        columns += ok[order].tolist()
    return np.array(rows, int), np.array(columns, int), scores[rows, columns] if rows else np.zeros(0, np.int64)


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), pivots.shape[1])
            if not len(v):
                continue
            d = _distances(v, pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cell": pa.array(cell, pa.int32()), "distance": pa.array(d[np.arange(len(d)), cell]), "v": batch.column("v")})

    return run


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition, each cell's k + 1 members nearest to the pivot, and its farthest."""
        held: pd.DataFrame | None = None
        for batch in batches:
            new = batch.to_pandas()
            new = new if held is None else pd.concat((held, new))
            new = new.sort_values(["cell", "distance", "vec_id"])
            rank = new.groupby("cell").cumcount()
            last = new.groupby("cell").cumcount(ascending=False)
            held = new[(rank <= k) | (last == 0)]
        if held is not None:
            yield pa.RecordBatch.from_pandas(held[["vec_id", "cell", "distance", "v"]], schema=pa.schema([("vec_id", pa.int64()), ("cell", pa.int32()), ("distance", pa.float64()), ("v", pa.list_(pa.int64()))]), preserve_index=False)

    return run


def _bounds(pivots: np.ndarray, known: np.ndarray, known_ids: np.ndarray, farthest: np.ndarray, k: int):
    """For each query its cell, and for each cell of data the least distance to the pivot it needs (or infinity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v"), pivots.shape[1])
            if not len(q):
                continue
            ids = batch.column("vec_id").to_numpy()
            scores = _products(q, known).astype(float)
            scores[ids[:, None] == known_ids[None, :]] = -np.inf
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            norm = np.sqrt((q.astype(float) ** 2).sum(1))
            at_pivot = q.astype(float) @ pivots.astype(float).T
            gap = kth[:, None] - at_pivot - SLACK * (1 + np.abs(kth[:, None]) + np.abs(at_pivot))
            least = np.where(norm[:, None] > 0, gap / np.maximum(norm, 1e-300)[:, None], -np.inf)
            least = np.where(least > farthest[None, :] * (1 + SLACK) + SLACK, np.inf, least)
            cell = _distances(q, pivots).argmin(1)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": batch.column("v"), "cell": pa.array(cell, pa.int32()), "needs": pa.array(list(least), pa.list_(pa.float64()))})

    return run


def _solve(width: int, k: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)}
        if len(queries) and len(data):
            data = data.sort_values("vec_id")
            q, s = (_matrix(pa.array(x["v"].tolist(), pa.list_(pa.int64())), width) for x in (queries, data))
            own, ids = queries["vec_id"].to_numpy(), data["vec_id"].to_numpy()
            row, column, score = _best(_products(q, s), ids, own, k)
            out = {"query_id": own[row], "vec_id": ids[column], "score": score}
        return pd.DataFrame(out).astype("int64")

    return run


def top_k(rows: DataFrame, queries: F.Column | None = None, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each query (all, if there are fewer).

    rows: vec_id, embedding. queries: which rows are queries, by default those whose vec_id is divisible by 50.
    Vectors of unequal length are compared as if filled with zeros. Rows that share a vec_id are candidates each, but
    never of each other; as queries the first by its components stands for all. An empty table gives no rows.
    """
    queries = F.pmod("vec_id", F.lit(50)) == 0 if queries is None else queries
    data = cut(integer_vectors(rows, scale), "vectors")
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = facts["n"], max(1, facts["width"] or 0)
    asked = data.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    empty = "query_id long, rank int, vec_id long, score long"
    if not n:
        return rows.sparkSession.createDataFrame([], empty)
    some = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    pivots = spread(_matrix(pa.array([r["v"] for r in some], pa.list_(pa.int64())), width), min(MOST_PIVOTS, max(LEAST_PIVOTS, int(n**0.5) // 4)))
    member = "vec_id long, cell int, distance double, v array<long>"
    celled = cut(data.mapInArrow(_cells(pivots), member), "cells")
    # Bounded: k + 2 rows of each cell from a partition, merged to as many.
    parts = celled.mapInArrow(_summaries(k), member)
    near = Window.partitionBy("cell").orderBy("distance", "vec_id")
    far = Window.partitionBy("cell").orderBy(F.desc("distance"), "vec_id")
    merged = parts.withColumn("r", F.row_number().over(near)).withColumn("f", F.row_number().over(far)).where(f"r <= {k + 1} or f = 1").collect()
    farthest = np.full(len(pivots), -1.0)
    for r in merged:
        farthest[r["cell"]] = max(farthest[r["cell"]], r["distance"])
    known = _matrix(pa.array([r["v"] for r in merged], pa.list_(pa.int64())), width)
    known_ids = np.array([r["vec_id"] for r in merged], np.int64)
    bounded = cut(asked.mapInArrow(_bounds(pivots, known, known_ids, farthest, k), "vec_id long, v array<long>, cell int, needs array<double>"), "queries")
    # Neighbouring cells share a group until it has QUERY_BLOCK queries; a cell with more is dealt into blocks.
    count = lambda df: {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}
    sizes, members = count(bounded), count(celled)
    near_first = np.argsort(_distances(pivots, pivots[:1])[:, 0], kind="stable")
    group_of, blocks_of, filled, group = {}, {}, 0, 0
    for cell in (int(c) for c in near_first if int(c) in sizes):
        if filled and filled + sizes[cell] > QUERY_BLOCK:
            filled, group = 0, group + 1
        filled += sizes[cell]
        group_of[cell], blocks_of[cell] = group, -(-sizes[cell] // QUERY_BLOCK)
    parts_of = {c: -(-m // DATA_BLOCK) for c, m in members.items()}
    lookup = lambda m, c="cell": F.element_at(F.create_map(*(F.lit(x) for p in m.items() for x in p)), F.col(c)) if m else F.lit(1)
    grouped = bounded.withColumn("block", F.pmod(F.xxhash64("vec_id"), lookup(blocks_of)).cast("int")).withColumn("group", lookup(group_of).cast("int"))
    each = grouped.select("group", "block", "vec_id", "v", F.posexplode("needs").alias("of", "need")).where((F.col("need") < float("inf")) & F.col("of").isin(*parts_of))
    # As many rows as groups of queries times pivots: bounded by the query set's blocks.
    needs = each.groupBy("group", "block", F.col("of").alias("cell")).agg(F.min("need").alias("need"))
    dealt = celled.withColumn("p", F.pmod(F.xxhash64("vec_id"), lookup(parts_of)).cast("int"))
    sent = dealt.join(needs, "cell").where("distance >= need").select(F.col("group").alias("g"), F.col("block").alias("b"), F.col("cell").alias("c"), "p", "vec_id", "v")
    wanted = each.select("group", "block", "of", F.explode(F.sequence(F.lit(0), lookup(parts_of, "of") - 1)).alias("part"), "vec_id", "v")
    local = wanted.groupBy("group", "block", "of", "part").cogroup(sent.groupBy("g", "b", "c", "p")).applyInPandas(_solve(width, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
