"""Joins whose pairs are many more than their rows: every pair, dealt over a fixed number of tasks."""

import collections
import itertools

from pyspark.sql import functions as F

from postlode.operators import classify, frames
from postlode.plans.queries import QUERIES


def test_similar_pairs_of_large_blocks(spark):
    names = ["red ring", "red bolt", "blue bolt", "green", "ring red", None]
    rows = [(i, i % 3 if i % 20 else None, names[i % 6]) for i in range(300)] + [(7, 1, "red bolt"), (None, 1, "red bolt")]
    frame = spark.createDataFrame(rows, "k long, b int, name string").coalesce(1)
    found = frames.similar_pairs(frame, "k", ["b"], F.split("name", " "))
    plain = collections.Counter((x[0], y[0]) for x, y in itertools.permutations(rows, 2) if None not in (*x, *y) and x[0] < y[0] and x[1] == y[1] and set(x[2].split()) & set(y[2].split()))
    assert collections.Counter(tuple(r) for r in found.collect()) == plain and plain
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_company_similarity_of_one_nation(spark, tmp_path):
    c = spark.range(0, 200, 1, 1).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), F.concat(F.lit("Blue Rock "), (F.col("id") % 9).cast("string")).alias("c_name"))
    s = spark.range(0, 30, 1, 1).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey"), F.when(F.col("id") % 2 == 0, "Blue Rock").otherwise(F.concat(F.lit("Rock & "), F.col("id").cast("string"))).alias("s_name"))
    c.write.parquet(f"{tmp_path}/customer.parquet")
    s.write.parquet(f"{tmp_path}/supplier.parquet")
    out = QUERIES["company_similarity"](spark, str(tmp_path))
    a, b = F.split(F.col("x"), " "), F.split(F.col("y"), " ")
    names = c.crossJoin(s).select("c_custkey", "s_suppkey", F.lower("c_name").alias("x"), F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", " ").alias("y"))
    plain = names.select("c_custkey", "s_suppkey", F.when(F.col("x") == F.col("y"), 1.0).when(F.contains("x", "y") | F.contains("y", "x"), 0.9).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))))
    assert collections.Counter(tuple(r) for r in out.collect()) == collections.Counter(tuple(r) for r in plain.collect())
    # One nation's pairs are dealt over all tasks.
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_names_without_a_common_word(spark):
    one = spark.createDataFrame([("Acme Blue", "Rock Red"), ("Acme Blue", "Blue Ltd"), ("Acme Blue", "Blue Rock")], "a string, b string")
    got = [r[0] for r in one.select(classify.company_similarity(classify.company_parts(F.col("a")), classify.company_parts(F.col("b")))).collect()]
    assert got == [0.0, 0.9, 1 / 3]


def test_company_similarity_moves_names_alone(spark, tmp_path):
    """What is made of names is made behind the shuffle."""
    name = lambda n, end: F.concat(F.lit(f"{n}#"), F.lpad(F.col("id").cast("string"), 9, "0"), F.when(F.col("id") % 7 == 0, end).otherwise("")).alias
    spark.range(0, 500, 1, 1).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"), name("Customer", " Blue")("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 100, 1, 1).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey"), name("Supplier", " of Blue")("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    out = QUERIES["company_similarity"](spark, str(tmp_path))
    found = {(r[0], r[1]): r[2] for r in out.collect()}
    words = lambda n, i, end: {n, f"{i:09d}", *(end.split() if i % 7 == 0 else ())}
    plain = {(c, s): len(words("customer", c, "blue") & words("supplier", s, "of blue")) / len(words("customer", c, "blue") | words("supplier", s, "of blue")) for c in range(500) for s in range(100) if c % 25 == s % 25}
    assert found == plain and len(set(plain.values())) > 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    behind = "".join(plan.split("RepartitionByExpression")[1:])
    assert len(moved) == 2 and "array_join" in plan
    assert "array_join" not in behind.split("+- Generate inline")[0] and behind.count("array_join") == 1


def test_names_within_names(spark):
    """What spares pairs the comparison spares none that is alike."""
    names = ["", "a", "ab", "b c", "Blue Rock", "Blue", "lue Ro", "rock", "Rock Blue", "x9", "Blue Rock Ltd", "9", None, "blue-rock 9"]
    one = spark.createDataFrame([(x, y) for x in names for y in names], "a string, b string")
    parts = one.select("a", "b", classify.company_parts(F.col("a")).alias("x"), classify.company_parts(F.col("b")).alias("y"))
    for r in parts.select("a", "b", classify.company_similarity(F.col("x"), F.col("y")).alias("s"), "x.words", F.col("y.words").alias("others")).collect():
        x, y = r["words"], r["others"]
        if x is None or y is None or not x or not y:
            assert r["s"] == 0.0
        elif x == y:
            assert r["s"] == 1.0
        elif x in y or y in x:
            assert r["s"] == 0.9
        else:
            assert r["s"] == len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
