"""The fuzzy pass through its index and rounds, against the plain greedy rule."""

import random

import pytest
from pyspark.sql import functions as F

from postlode.operators import dedup, near_titles

SCHEMA = "source string, row_order long, priority int, title_raw string, company string"
WORDS = "senior junior lead software data platform engineer enginer engineers developer analyst manager back end backend front frontend ops sre qa test tester i ii iii berlin munich remote (m/f/d) a aa aaa".split()


def greedy(rows, threshold=90.0):
    kept, by_block = set(), {}
    for source, number, _, title, block in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        words = frozenset((title or "").split())
        others = by_block.setdefault(block, [])
        if not any(s != source and dedup.token_set_ratio(w, words) >= threshold for s, w in others):
            kept.add((source, number))
            others.append((source, words))
    return kept


def titles(rng, n):
    out = []
    for i in range(n):
        title = rng.choice([" ", "  "]).join(rng.choice(WORDS) for _ in range(rng.randrange(0, 6)))
        if rng.random() < 0.3 and title:  # a typo
            at = rng.randrange(len(title))
            title = title[:at] + rng.choice(["", "x", " ", "é"]) + title[at + 1 :]
        s = rng.randrange(4)
        out.append((f"s{s}", i // 4, s % 3, None if i % 97 == 5 else title, rng.choice("AAAB")))
    return list({(r[0], r[1]): r for r in out}.values())


@pytest.mark.parametrize("threshold", [90.0, 80.0])
def test_index_and_rounds_equal_the_greedy_rule(spark, threshold):
    rows = titles(random.Random(int(threshold)), 600)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    told = greedy(rows, threshold)
    for small in (0, 10_000):
        found = {(r[0], r[1]) for r in dedup.fuzzy(frame, ["company"], threshold, small=small).select("source", "row_order").collect()}
        assert found == told, small


def test_one_large_block_and_chains(spark):
    """Each title is near to its neighbours only, so fates alternate along the chain; beside them many equal titles."""
    rows = [(f"s{i % 2}", i, 1, "word" * 5 + "x" * i, "A") for i in range(30)]
    rows += [(f"s{i % 3}", 1000 + i, 2, "exactly the same title", "A") for i in range(400)]
    found = {(r[0], r[1]) for r in dedup.fuzzy(spark.createDataFrame(rows, SCHEMA), ["company"]).select("source", "row_order").collect()}
    assert found == greedy(rows)


def test_empty_and_blank(spark):
    frame = spark.createDataFrame([("a", 1, 1, None, "A"), ("b", 1, 1, "", "A"), ("b", 2, 1, " \t", "A")], SCHEMA)
    assert dedup.fuzzy(frame, ["company"], small=0).count() == 3
    assert dedup.fuzzy(frame.limit(0), ["company"], small=0).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        near_titles.dropped(frame, ["company"], 60.0)


def test_cap_is_the_callers_rule(spark):
    rows = [(f"s{i % 2}", i, 1, "one title", "A") for i in range(20)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert dedup.fuzzy(frame, ["company"], cap=10).count() == 20
    assert dedup.fuzzy(frame, ["company"], cap=10, small=0).count() == 20
    assert dedup.fuzzy(frame, ["company"]).agg(F.count_distinct("source")).first()[0] == 1
