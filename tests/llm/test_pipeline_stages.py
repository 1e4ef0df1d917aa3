"""Every stage of the pipeline on what the stage before kept, against plain Python that shares no code with the operators."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from postlode.llm import mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "kal lomo mira teru sovi andel".split() for b in "na sti ra limo ve".split()]
SHORT = "the of and a to in".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sentences(rng, n):
    """Lines of ten words with a stop each."""
    w = [rng.choice(SHORT) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n)]
    for k in range(1, n):
        while w[k] == w[k - 1]:
            w[k] = rng.choice(WORDS)
    return "\n".join(" ".join(w[k : k + 10]) + "." for k in range(0, n, 10))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    clean = [sentences(rng, rng.randrange(40, 400)) for _ in range(70)]
    bad = [t.upper().replace(" ", "!! ") for t in clean[:8]] + [t.replace(" ", "*** ") for t in clean[8:14]]
    mixed = ["same same " * 30, "few words.", "", None, (clean[3].split("\n")[0] + "\n") * 40, clean[4].replace(".", ""), "1 2 3 4 5 6 7 8 9 10 11 12. " * 3]
    shared = clean[0].split("\n")[0]
    texts = clean + bad + mixed
    texts += [t.replace("\n", " ") for t in clean[20:30]]  # the same words on one line: near-dedup's, not line dedup's
    texts += [t.replace("\n", " ").replace(t.split()[5], "zero", 1) for t in clean[30:40]]
    texts += [sentences(rng, 60) + "\n" + shared[:7] + "q" + shared[7:] + "\n" + shared for _ in range(5)]
    texts += [" ".join(sentences(rng, 2_600).split("\n"))]
    out = [(i, t) for i, t in enumerate(texts)] + [(None, sentences(rng, 80)), (None, None)]
    return [(i, t, "en", None if i is not None and i % 7 == 0 else f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in out]


def good(texts):
    """The texts that a label model fitted on all of them keeps; EM by document, not by pattern of votes."""
    cast, base = [], []
    for t in texts:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        upper = [len(re.findall("[A-Z]", x)) >= 2 and not re.search("[a-z]", x) for x in w]
        plain = [bool(re.fullmatch(r"[A-Za-z]+[.!?,;:]?", x)) for x in w]
        share = {
            "symbols": sum(c in "#*$%&|<>" for c in t or ""),
            "shouting": sum(upper),
            "odd_words": sum(p and not u for p, u in zip(plain, upper)),
            "short_words": sum(bool(re.fullmatch("[a-z]{1,3}", x)) for x in w),
            "sentences": sum(x[-1] in ".!?" for x in w),
            "stutter": sum(a == b for a, b in zip(w, w[1:])),
            "repeats": len(covered),
            "dup_lines": len(lines) - len(set(lines)),
        }
        share = {k: n / max(1, len(lines) if k == "dup_lines" else len(w)) for k, n in share.items()}
        bad = {k: share[k] < b if k in ("odd_words", "short_words", "sentences") else share[k] >= b for k, b in (("symbols", 0.1), ("shouting", 0.25), ("odd_words", 0.8), ("short_words", 0.08), ("sentences", 0.015), ("stutter", 0.06), ("repeats", 0.1), ("dup_lines", 0.3))}
        fine = {"odd_words": share["odd_words"] >= 0.93, "short_words": share["short_words"] >= 0.25}
        cast.append([0 if not w else -1 if bad[k] else 1 if fine.get(k) else 0 for k in share])
        base.append(len(w) < 10 or 100 * len(covered) > 20 * len(w))
    prior, sure, hold = 0.8, [0.9] * 8, 0.02 * max(1, len(texts))

    def belief(v):
        odds = math.log(prior / (1 - prior)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, sure))
        return 1 / (1 + math.exp(-odds))

    for _ in range(50):
        p = [belief(v) for v in cast]
        for_rule = []
        for r in range(8):
            right = sum(x if v[r] > 0 else 1 - x if v[r] < 0 else 0 for x, v in zip(p, cast))
            for_rule.append(min(0.99, max(0.55, (right + hold * 0.9) / (sum(v[r] != 0 for v in cast) + hold))))
        prior, sure = min(0.95, max(0.05, (sum(p) + hold * 0.8) / (len(texts) + hold))), for_rule
    return [not b and belief(v) >= 0.5 for b, v in zip(base, cast)]


def near_line(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 20:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def without_lines(given):
    seen, out = [], []
    for r in sorted((r for r in given if r[0] is not None), key=lambda r: r[0]):
        stay = []
        for line in r[1].split("\n"):
            if not words(line) or not any(near_line(line, s) for s in seen):
                stay.append(line)
            if words(line):
                seen.append(line)
        text = "\n".join(stay)
        out.append((r[0], text, *r[2:4], len(text)))
    return out + [(*r[:4], len(r[1])) for r in given if r[0] is None]


def one_of_each(given):
    def sets(t):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    named = sorted((r for r in given if r[0] is not None), key=lambda r: r[0])
    found = [sets(r[1]) for r in named]
    group = list(range(len(named)))
    for j in range(len(named)):
        for i in range(j):
            if found[i] and found[j] and 100 * len(found[i] & found[j]) >= 80 * len(found[i] | found[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return [r for k, r in enumerate(named) if group[k] == k] + [r for r in given if r[0] is None]


def test_each_stage_against_plain_python(spark, rows, tmp_path):
    steps, now = [rows], spark.createDataFrame(rows, SCHEMA).repartition(5)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"file://{tmp_path}/{k}")
        now = spark.read.parquet(f"file://{tmp_path}/{k}")
        steps.append([tuple(r) for r in now.collect()])
    order = lambda found: sorted(found, key=str)

    assert order(steps[1]) == order(r for r, kept in zip(rows, good([r[1] for r in rows])) if kept)
    assert 0 < len(steps[1]) < len(rows)
    assert order(steps[2]) == order(without_lines(steps[1])) and order(steps[2]) != order(steps[1])
    assert order(steps[3]) == order(one_of_each(steps[2])) and len(steps[3]) < len(steps[2])

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", steps[3])
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL})").fetchall()
    assert {s[0]: s[1] for s in taken} == {r[0]: len(words(r[1])) for r in steps[3]}
    copies = {i: n // size for i, size, n in taken if size}
    assert order(steps[4]) == order(r for r in steps[3] for _ in range(copies.get(r[0], 0))) and len(steps[4]) != len(steps[3])

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    told = collections.Counter()
    for r in steps[4]:
        ids = [*encoder.encode(r[1], add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            told[(r[0], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter(r[:5] for r in steps[5]) == told
    places = collections.defaultdict(list)
    for r in steps[5]:
        places[r[5]].append((r[6], r[3]))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 2048
    assert len(places) <= -(-sum(n for own in places.values() for _, n in own) // 2048) + 1


def test_verdicts_against_em_by_document(spark, rows):
    report = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert report == {(r[0], len(words(r[1]))): kept for r, kept in zip(rows, good([r[1] for r in rows]))}
