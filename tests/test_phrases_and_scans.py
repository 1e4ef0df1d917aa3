"""Phrases within texts, and scans cut until they stay below a cap, against plain Python."""

import random
from collections import Counter

import pytest

from postlode.operators import phrases
from postlode.sources import planning


def held(spark, texts, lexicon):
    found = phrases.occurrences(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in lexicon], "p string"), "p").collect()
    return sorted(tuple(r) for r in found)


def plainly(texts, lexicon):
    return sorted({(t, p) for t in texts if t for p in lexicon if p and p in t})


def test_phrases_of_every_length(spark):
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("abc\n é\U0001f600") for _ in range(rng.randint(a, b)))
    texts = [word(0, 40) for _ in range(150)] + ["abcabc"] * 3 + [None, "", "a", "x" * 30_000 + "abc" + "y" * 30_000]
    lexicon = [word(0, 6) for _ in range(120)] + [None, "", "a", "bca", "bca", "xxabc", "nowhere", "\U0001f600"]
    assert held(spark, texts, lexicon) == plainly(texts, lexicon)


def test_phrases_without_rows(spark):
    assert held(spark, [], ["a"]) == [] and held(spark, ["a"], []) == [] and held(spark, [None], [None, ""]) == []


def test_one_phrase_in_a_third_of_all_texts(spark):
    texts = [f"engineer {i}" if i % 3 == 0 else f"cook {i}" for i in range(900)]
    lexicon = ["engineer", "engineer 9", "cook 10"]
    assert held(spark, texts, lexicon) == plainly(texts, lexicon)


def test_counts_of_rows_move_a_text_once(spark):
    texts = ["engineer and cook", "cook", "cook", None, "", "baker", "engineer"] * 5
    lexicon = ["engineer", "cook", "cook", "ook", "baker x", "and", None, ""]
    found = phrases.counts(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in lexicon], "p string"), "p", "n")
    assert sorted(tuple(r) for r in found.collect()) == sorted((p, sum(bool(t) and p in t for t in texts)) for p in ("engineer", "cook", "ook", "and"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan")[0].count("SortMergeJoin") == 1  # of texts with their candidates; no pair carries a text to another join


def cut(rows, facets, cap, path=(), whole=True):
    """The rule of planning.subdivide() for the rows of one query."""
    left = [f for f in facets if f not in dict(path)]
    if len(rows) < cap or not left:
        return [(path, len(rows), whole and len(rows) < cap)]
    rated = []
    for f in left:
        n = Counter(r[f] for r in rows)
        hidden = n.pop(None, 0)
        if n:
            rated.append((hidden > 0, max(n.values()), f))
    if not rated:
        return [(path, len(rows), False)]
    hides, _, f = min(rated)
    out = []
    for v in {r[f] for r in rows if r[f] is not None}:
        out += cut([r for r in rows if r[f] == v], facets, cap, (*path, (f, v)), whole and not hides)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scans_are_cut_until_they_fit(spark, seed):
    rng = random.Random(seed)
    facets = ["a", "b", "c"]
    rows = [(rng.choice(["big", "big", "big", "small", None]), rng.choice("123"), rng.choice(["1", "2", None]), rng.choice("1234")) for _ in range(400)]
    rows += [("mute", None, None, None)] * 30 + [("few", "1", None, None)]
    found = planning.subdivide(spark.createDataFrame(rows, "q string, a string, b string, c string"), "q", facets, 25).collect()
    told = []
    for q in {r[0] for r in rows}:
        told += [(q, path, n, whole) for path, n, whole in cut([dict(zip(facets, r[1:])) for r in rows if r[0] == q], facets, 25)]
    assert sorted(((r["query"], tuple((s["facet"], s["value"]) for s in r["path"]), r["expected"], r["whole"]) for r in found), key=str) == sorted(told, key=str)
    assert any(len(r["path"]) > 1 for r in found) and not all(r["whole"] for r in found)


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], "q string, a string")
    assert planning.subdivide(none, "q", ["a"], 5).count() == 0 and planning.subdivide(none, "q", [], 5).count() == 0


def test_completeness_counts_keys_once(spark):
    totals = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), (None, 1)], "query string, total long")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 5), ("d", 1)], "q string, k long")
    found = {r["query"]: (r["expected"], r["found"], r["complete"]) for r in planning.completeness(totals, rows, "q", "k").collect()}
    assert found == {"a": (2, 2, True), "b": (1, 0, False), "c": (1, 0, False), None: (1, 1, True)}


def test_phrases_in_texts_of_any_length(spark):
    """Counts move no text: they write none down, and take time by the length of the texts; phrases lie across all borders of steps."""
    word = lambda i: f"w{i * 7919 % 100_003}"
    texts = [" ".join(word(i) for i in range(start, start + n)) for start, n in ((0, 60_000), (60_000, 3), (50_000, 1), (59_000, 25_000))]
    lexicon = [" ".join(word(i) for i in range(start, start + n)) for start in range(0, 84_000, 3) for n in (1, 2)]
    lexicon += [texts[1], texts[3][5:140_000], texts[3][5:140_000] + "x", texts[0][-9:], texts[0][-9:] + " "]
    found = phrases.counts(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in lexicon], "p string"), "p", "n")
    told = {r["p"]: r["n"] for r in found.collect()}
    some = random.Random(3).sample(lexicon, 600) + lexicon[-5:]
    assert all(told.get(p, 0) == sum(p in t for t in texts) for p in some)
    assert set(told) <= set(lexicon) and len(told) > 50_000
    assert "/texts/" not in found._jdf.queryExecution().executedPlan().toString()
