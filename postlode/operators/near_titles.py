"""The fuzzy pass for blocks of any size: an inverted index finds pairs of titles, rounds decide which rows stay.

A row goes if its title nearly equals that of an earlier row that stays, of another source in its block. Rows of one
block, source and set of words share one fate, that of their first, so they are one node; order among nodes is that of
their first rows.

Two titles reach the threshold in one of two ways, and each has an index that loses no pair:

* One title's words lie in the other's, but for a few characters. Then, of that title's words from the rarest on, one
  of the first that together are longer than these few is in the other title. Both look-up and test are joins on words.
* What the titles do not share differs by few insertions and deletions, at most a share of both lengths. An insertion
  breaks one pair of neighbouring characters within a word (its ends count as characters), a deletion two. So of the
  rarest pairs of either title, one more than can be broken, the two titles have one in common.

The rows that stay are those of the lexicographically first independent set: in each round nodes without an earlier
undecided neighbour stay, and their later neighbours go, until no link is left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlode.staging import written

ORDER = ("priority", "row_order", "source")


def words_of(title: Column) -> Column:
    """A title's distinct words, sorted; white space is what str.split() takes for it."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(title, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")))


def _size(words: Column) -> Column:
    return F.char_length(F.array_join(words, " "))


def _rarest(grams: DataFrame, block: list[str], gram: str) -> DataFrame:
    """grams with rank: 1 for the rarest gram of its title within the block."""
    often = grams.groupBy(*block, gram).agg(F.count(F.lit(1)).alias("often"))
    w = Window.partitionBy("tid").orderBy("often", gram)
    return grams.join(often, [*block, gram]).withColumn("rank", F.row_number().over(w)).withColumn("__w", F.char_length(gram)).withColumn("before", F.coalesce(F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__w")


def _contained(titles: DataFrame, block: list[str], share: float) -> DataFrame:
    """a, b (tid): pairs of which one has, but for a share of its characters, only words of the other."""
    c = 2 * (1 - share) / share
    words = written(_rarest(titles.select(*block, "tid", F.explode("words").alias("word"), F.floor(F.col("size") * (c / (1 + c)) + 1e-6).alias("most")), block, "word"))
    probes = words.where("before <= most").select(*block, "word", F.col("tid").alias("a"))
    met = probes.join(words.select(*block, "word", F.col("tid").alias("b")), [*block, "word"]).where("a <> b").select("a", "b").distinct()
    side = lambda x: titles.select(F.col("tid").alias(x), F.col("words").alias(f"{x}_words"), F.col("size").alias(f"{x}_size"))
    both = met.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.array_intersect("a_words", "b_words"))
    s = _size(F.col("shared"))
    rest = F.col("a_size") - s  # with the blank before it
    near = (F.size("shared") == F.size("a_words")) | (F.col("a_size") * (1 - share) + s * (1 - share) >= rest - 1e-9)
    return both.where((F.size("shared") > 0) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _alike(titles: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """a, b (tid): pairs of which the words that they do not share differ by few characters."""
    from postlode.operators.dedup import token_set_ratio

    k = 1 - threshold / 100
    if k >= 1 / 3:
        raise ValueError("the index needs a threshold above 67")
    marked = F.transform("words", lambda w: F.concat(F.lit("\x02"), w, F.lit("\x03")))
    pairs = F.flatten(F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    # Repeated pairs are told apart by their number, so that sets count what lists hold.
    numbered = titles.withColumn("pairs", F.array_sort(pairs)).withColumn("grams", F.transform("pairs", lambda p, i: F.concat(p, (i - F.array_position("pairs", p) + 1).cast("string"))))
    numbered = written(numbered.select(*block, "tid", "words", "size", "grams"))
    grams = _rarest(numbered.select(*block, "tid", "size", F.explode("grams").alias("gram")), block, "gram")
    first = written(grams.where(F.col("rank") <= F.floor(F.col("size") * (4 * k / (1 + k)) + 1e-6) + 1).select(*block, "gram", "tid", "size"))
    side = lambda x: first.select(*block, "gram", F.col("tid").alias(x), F.col("size").alias(f"{x}_size"))
    edits = F.floor((F.col("a_size") + F.col("b_size")) * k + 1e-6)
    met = side("a").join(side("b"), [*block, "gram"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("a_size") - F.col("b_size")) <= edits))
    met = met.select("a", "b").distinct()
    whole = lambda x: numbered.select(F.col("tid").alias(x), F.col("words").alias(f"{x}_words"), F.col("grams").alias(f"{x}_grams"), F.col("size").alias(f"{x}_size"))
    both = met.join(whole("a"), "a").join(whole("b"), "b")
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    both = both.where((F.size("a_grams") - common) <= 1.5 * edits + (F.col("a_size") - F.col("b_size")) / 2).where((F.size("b_grams") - common) <= 1.5 * edits + (F.col("b_size") - F.col("a_size")) / 2)

    def compare(batches):
        for rows in batches:
            ok = [token_set_ratio(frozenset(x), frozenset(y), threshold) >= threshold for x, y in zip(rows["a_words"], rows["b_words"], strict=True)]
            yield rows.loc[pd.Series(ok, index=rows.index, dtype=bool), ["a", "b"]]

    return both.select("a", "b", "a_words", "b_words").mapInPandas(compare, "a long, b long")


def first_independent(links: DataFrame, order: list[str]) -> DataFrame:
    """The nodes that go: links (u, v: structs, u before v in order) join nodes of which one has to go.

    Each round writes what is left of the links; there are as many rounds as the longest chain of decisions.
    """
    left, gone = written(links), []
    while not left.isEmpty():
        heads = left.select("u").distinct().join(left.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        new = written(left.join(heads, "u", "left_semi").select(F.col("v").alias("node")).distinct())
        gone.append(new)
        u, v = new.withColumnRenamed("node", "u"), new.withColumnRenamed("node", "v")
        left = written(left.join(u, "u", "left_anti").join(v, "v", "left_anti"))
    out = links.select(F.col("v").alias("node")).limit(0)
    for new in gone:
        out = out.unionByName(new)
    return out.select(*(F.col(f"node.{c}").alias(c) for c in order))


def dropped(rows: DataFrame, block: list[str], threshold: float = 90.0) -> DataFrame:
    """source, row_order of the rows that the fuzzy pass drops. rows: source, row_order, priority, title_raw and block (none null)."""
    node = F.struct(*ORDER)
    kept = rows.withColumn("words", words_of(F.col("title_raw"))).where(F.size("words") > 0)
    # The same words of one source: one node, and the rows that share its fate.
    nodes = written(kept.groupBy(*block, "words", "source").agg(F.min(node).alias("node")))
    titles = written(nodes.groupBy(*block, "words").agg(F.count_distinct("source").alias("sources")).withColumn("size", _size(F.col("words"))).withColumn("tid", F.monotonically_increasing_id()))
    found = _contained(titles, block, threshold / 100).unionByName(_alike(titles, block, threshold)).distinct()
    same = titles.where("sources > 1").select(F.col("tid").alias("a"), F.col("tid").alias("b"))
    ids = written(nodes.join(titles.select(*block, "words", "tid"), [*block, "words"]).select("tid", "source", "node"))
    side = lambda x: ids.select(F.col("tid").alias(x), F.col("source").alias(f"{x}_source"), F.col("node").alias(f"{x}_node"))
    links = written(found.unionByName(same)).join(side("a"), "a").join(side("b"), "b").where("a_source <> b_source")
    links = links.select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).distinct()
    gone = first_independent(links, list(ORDER)).select(F.struct(*ORDER).alias("node"))
    fate = nodes.join(gone, "node", "left_semi").select(*block, "words", "source")
    return kept.join(fate, [*block, "words", "source"], "left_semi").select("source", "row_order")
