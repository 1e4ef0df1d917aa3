"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Every document of a source is to appear target / source_size times in expectation. In a fixed order of the source's
documents (by size, then a salt, then doc_id) the expected copies are summed up, one random offset per source is
added, and a document is emitted once for each integer its stretch of the sum crosses. Ordered by size, the words
taken from a source differ from its target by about one document.

The order inside a source is never computed in one task: counts by (source, size, salt) are pre-aggregated and summed
up, and only the rank within such a group is a window over documents. The number of salts follows the number of a
source's documents of one size, so that no group grows with the input even if a third of all rows are alike, and a
source has no more groups to sum up than sizes and GROUP_ROWS-th parts of its documents. Salts come from doc_id; where
that leaves a group of more than UNEVEN times GROUP_ROWS (rows without a doc_id, or that share one), the group is split
again by its rows' texts and places in their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlode.llm._tables import cut, read_from_files

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
GROUP_ROWS = 10_000
UNEVEN = 8
#: Large groups that are broadcast at most, of about 50 bytes each.
BROADCAST_GROUPS = 100_000
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: one row a source, by water-filling.

    With every source at min(most * size, level * weight), the level that spends all words is found on the sources
    sorted by most * size / weight: those up to some point are full, the others share what is left by weight.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    fill = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))
    by = by.withColumn("level", left / F.sum("weight").over(after))
    # Levels fall as long as sources fill up; the first that its own source can hold is the level of all behind it.
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), "source", "level"))).over(Window.partitionBy())
    level = fits["level"]
    return by.select("source", "source_size", F.least(level * F.col("weight"), F.col("most").cast("double")).alias("target"))


def _offset(seed: int) -> F.Column:
    """In [0, 1), fixed for a seed and a source."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("(none)")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(sized: DataFrame, seed: int = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """sized (source, doc_id, __size and ties) with __source_size, __target and __copies (how often the mix takes the row).

    sized is narrow and read more than once, so it should be a written table. A size of 0 is taken 0 times. A null source
    is a source of its own, the last. Repeated rows count each; rows that tie in doc_id are told apart by the columns
    of ties, and where these tie too they are alike. Without ties, rows that share a doc_id, a source and a size are one group.
    """
    # Written down, the counts and the sources' table have a known size, so that the planner broadcasts them only if small.
    counts = cut(sized.groupBy("source", "__size").agg(F.count(F.lit(1)).alias("n")), "counts")
    found = cut(targets(counts.select("source", (F.col("__size") * F.col("n")).alias("size"))), "targets")
    source = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  never null, so one partitioning serves window and join
    by = found.select(source(F.col("source")).alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    many = counts.where(F.col("n") > GROUP_ROWS).select(source(F.col("source")).alias("__source"), "__size", F.ceil(F.col("n") / GROUP_ROWS).alias("__salts"))
    many = F.broadcast(many) if many.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else many
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    salt = F.pmod(F.pmod(number, F.lit(2147483648)) * 2654435761, F.lit(4294967296)) % F.coalesce("__salts", F.lit(1))
    place = ["__source", "__size", "__salt"]
    keyed = sized.withColumn("__source", source(F.col("source"))).join(many, ["__source", "__size"], "left").withColumn("__salt", salt)
    groups = cut(keyed.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "groups")
    uneven = groups.where(F.col("n") > UNEVEN * GROUP_ROWS).select(*place, F.ceil(F.col("n") / GROUP_ROWS).alias("__parts"))
    if ties and not uneven.isEmpty():
        keyed = keyed.join(uneven, place, "left").withColumn("__part", F.pmod(F.xxhash64(*ties), F.coalesce("__parts", F.lit(1)))).drop("__parts")
        place.append("__part")
        groups = keyed.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__source").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.where("__size > 0").select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*place).orderBy("doc_id", *ties)
    # Dealt by all of the place: a join's deal by source and size would serve the window, but hold a large group's salts together.
    ranked = keyed.join(by, "__source").repartition(*place).withColumn("__rank", F.row_number().over(within)).join(groups, place, "left")
    each = F.col("__target") / F.col("__source_size")
    upto = F.col("__before") + F.col("__rank")
    crossed = lambda x: F.floor(x * each + _offset(seed))
    copies = F.when(F.col("__size") == 0, F.lit(0)).otherwise(crossed(upto) - crossed(upto - 1)).cast("long")
    return ranked.withColumn("__copies", copies).select(*sized.columns, "__source_size", "__target", "__copies")


#: What tells rows of one doc_id apart.
TIES = ("__text", "__file", "__row")


def _place(docs: DataFrame) -> tuple[F.Column, F.Column]:
    """A row's file and its place in it; docs is a plain reading of files."""
    file = docs.metadataColumn("_metadata")
    return F.xxhash64(file["file_path"]).alias("__file"), file["row_index"].alias("__row")


def _sized(docs: DataFrame) -> DataFrame:
    """Narrow rows of docs, a plain reading of files: source, doc_id, size and what tells them apart."""
    return cut(docs.select("source", "doc_id", n_words(F.col("text")).alias("__size"), F.xxhash64("text").alias("__text"), *_place(docs)), "sizes")


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs; the texts stay at the scan.

    Ordered as mix() orders, by the rows' files and places in them; docs that are no plain reading of files are written
    down first.
    """
    out = with_copies(_sized(docs if read_from_files(docs) else cut(docs.select("doc_id", "source", "text"), "mix-input")), seed, TIES)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs.

    A row is known by its file and its place in it, so all sums, sorts and windows run on narrow rows and a text moves
    once, to the row that holds its number of copies. docs that are no plain reading of files are written down first.
    A null or empty text is taken 0 times. Rows that tie in doc_id are told apart by the hash of their text, then by
    their place; an empty table gives an empty mix; columns of any name are passed on.
    """
    docs = docs if read_from_files(docs) else cut(docs, "mix-input")
    taken = with_copies(_sized(docs), seed, TIES).where("__copies > 0").select("__file", "__row", "__copies")
    # The few bytes of a taken row are the side that is hashed; the texts stream past and are not sorted.
    found = docs.select(F.struct(*docs.columns).alias("__doc"), *_place(docs)).join(cut(taken, "copies").hint("shuffle_hash"), ["__file", "__row"])
    return found.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__doc.*")


#: The rows of mix_report(), one row a document, with the place in the source's order as `upto`.
_PLACED_SQL = r"""
WITH sized AS (
  SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM per_source),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
target AS (
  SELECT l.*, least((SELECT level FROM levels WHERE level * weight <= most ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST LIMIT 1) * weight, CAST(most AS DOUBLE)) AS target
  FROM levels l),
salted AS (
  SELECT *, greatest(1, CAST(ceil(count(*) OVER (PARTITION BY source, size) / 10000.0) AS BIGINT)) AS salts FROM sized),
placed AS (
  SELECT s.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY s.source, s.size = 0 ORDER BY s.size, (((((coalesce(s.doc_id, 0) % 2147483648) + 2147483648) % 2147483648) * 2654435761) % 4294967296) % s.salts, s.doc_id NULLS FIRST, s.text) AS upto,
         CAST(CAST('0x' || substr(md5('17:' || coalesce(s.source, '(none)')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift
  FROM salted s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(floor(upto * (target / source_size) + shift) - floor((upto - 1) * (target / source_size) + shift) AS BIGINT) END AS copies
  FROM placed)
"""
ORACLE_SQL = _PLACED_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
