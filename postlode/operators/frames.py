"""Summaries, look-ups and unions over whole tables, as the queries and reports of the engine use them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key: a filter that reaches the scan."""
    return df.where(F.col(key) == value)


def rotation(df: DataFrame, order: str, start: int, size: int) -> DataFrame:
    """The next `size` rows of a small table in a round that started at `start`."""
    return df.orderBy(order).offset(start).limit(size)


def profile(df: DataFrame, tests: dict[str, Column], by: tuple[str, ...] = (), distinct: dict[str, str] | None = None, total: str = "n") -> DataFrame:
    """Number of rows, of distinct values and of rows that meet each test, over all or by group: one pass."""
    each = [F.count(F.lit(1)).alias(total), *(F.countDistinct(c).alias(n) for n, c in (distinct or {}).items()), *(F.count_if(c).alias(n) for n, c in tests.items())]
    return df.groupBy(*by).agg(*each) if by else df.agg(*each)


def best_of(df: DataFrame, by: str, value: str, best: str, label: str, most: str) -> DataFrame:
    """The largest value of each group and the smallest `best` that has it; no window."""
    return df.groupBy(by).agg(F.max(value).alias(most), F.max_by(best, F.struct(value, -F.col(best))).alias(label))


def top_of(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, numbered; Spark picks them before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= k)


def compose(df: DataFrame, by: str, order: tuple[str, ...], part: str, name: str, mark: str = "\n") -> DataFrame:
    """The parts of each group joined in their order; groups are one document's, so bounded."""
    parts = F.array_sort(F.collect_list(F.struct(*order, part)))
    return df.where(F.col(part).isNotNull()).groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p[part]), mark).alias(name))


def day_first_votes(df: DataFrame, by: str, written: Column) -> DataFrame:
    """by, day_first, month_first, is_day_first: how a source writes its dates, by the majority of those that tell.

    A date a/b/c tells that the day comes first if only a is above 12, and that the month does if only b is.
    """
    parts = F.split(F.trim(written), "/")
    a, b = (F.trim(F.get(parts, i)).try_cast("int") for i in (0, 1))
    whole = F.size(parts) == 3
    votes = df.groupBy(by).agg(F.count_if(whole & (a > 12) & (b <= 12)).alias("day_first"), F.count_if(whole & (b > 12) & (a <= 12)).alias("month_first"))
    return votes.withColumn("is_day_first", F.col("day_first") > F.col("month_first"))


def monthly(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Rows and the sum of a value by group and month."""
    return df.groupBy(by, F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))


def look_up(df: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """df with the columns of dimensions (frame, column of what is there so far, key of the frame); no row is lost."""
    return reduce(lambda a, d: a.join(d[0], F.col(d[1]) == F.col(d[2]), "left"), dimensions, df)


def only(df: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of df that keys names."""
    return df.join(keys, key, "left_semi").select(*df.columns)


def ready(queue: DataFrame, rows: DataFrame, key: Column, order: str, size: int) -> DataFrame:
    """The first queue rows that have a row behind them, with its columns."""
    return queue.join(rows, key).orderBy(order).limit(size)


def not_yet(df: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Rows not among the sent ones. A blank key can't be known as sent: its rows stay."""
    known = sent.where(F.trim(F.col(key).cast("string")) != "").select(key).distinct()
    return df.join(known, key, "left_anti").select(*df.columns)


def similar_pairs(df: DataFrame, key: str, block: list[str], words: Column, least: int = 1) -> DataFrame:
    """a_key < b_key within a block that share `least` words.

    Words are compared once for each two lists of words of a block, then the keys that have them are paired. A fixed
    number of partitions: the rows are few bytes and much work, so Spark must not merge them into few tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, *block, words.alias("__a")).repartition(parts, *block).groupBy(*block, "__a").agg(F.collect_list(key).alias("__keys"))
    other = rows.select(*block, F.col("__a").alias("__b"), F.col("__keys").alias("__others"))
    alike = rows.join(other.hint("shuffle_hash"), block).where(F.size(F.array_intersect("__a", "__b")) >= least)
    pairs = alike.select(F.explode("__keys").alias("a_key"), "__others").select("a_key", F.explode("__others").alias("b_key"))
    return pairs.where(F.col("a_key") < F.col("b_key"))


def spread_join(a: DataFrame, b: DataFrame, key: str, other: str, made: Callable[[DataFrame], DataFrame] = lambda df: df, other_made: Callable[[DataFrame], DataFrame] = lambda df: df, least: int = 8) -> DataFrame:
    """a joined with b on key = other, for keys of many rows on both sides: the pairs of a key are dealt over many tasks.

    These are `least`, or more if the keys of b are too few for all partitions; b is repeated for each, so it should be
    the smaller side. made and other_made add columns (or drop them) behind the shuffle, which should move no more than
    it takes to make them. A fixed number of partitions, as pairs are much more than the rows that Spark would merge
    tasks by.
    """
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = b.select(other).distinct().limit(parts).count()
    salts = max(least, -(-parts // max(keys, 1)))
    x = a.withColumn("__salt", F.pmod(F.xxhash64(*a.columns), F.lit(salts)).cast("int")).repartition(parts, key, "__salt")
    y = b.withColumn("__other_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(parts, other, "__other_salt")
    met = made(x).join(other_made(y).hint("shuffle_hash"), (F.col(key) == F.col(other)) & (F.col("__salt") == F.col("__other_salt")))
    return met.drop("__salt", "__other_salt")


def widened(*frames: DataFrame) -> DataFrame:
    """All rows of frames whose columns differ: missing ones are null, and a column of two types becomes text."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, kind in f.dtypes:
            kinds.setdefault(c, set()).add(kind)
    cast = lambda f: f.select(*(F.col(c).cast("string").alias(c) if len(kinds[c]) > 1 else F.col(c) for c in f.columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(cast, frames))


def all_columns(*frames: DataFrame) -> list[str]:
    """The names of all columns, each once, in the order in which they first come."""
    return list(dict.fromkeys(c for f in frames for c in f.columns))


def lexicon(*columns: DataFrame) -> DataFrame:
    """The distinct values of the first columns of all frames."""
    name = columns[0].columns[0]
    return reduce(DataFrame.union, (c.toDF(name) for c in columns)).distinct()
