"""Operators 11 to 13 against the library, plain Python and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from postlode.llm import fill_middle, importance, sentence_pieces
from postlode.llm._text import buffer, lowered
from postlode.llm.piece_model import Normaliser, PieceEncoder, fields, rules_of

SCHEMA = "doc_id long, text string, lang string, `h1` string, ids string, score string, `group` string, n_words int"
BITS = ["a", "b", "the", "The", " ", "  ", "\n", "\t", "\r\n", "▁", "▁▁", "é", "É", "日本", "😀", " ", "　", "x" * 70, "1", "<0x41>", "<s>", "</s>", "<unk>", "<P>", "<M", ".", "...", "ab" * 50, "​", "﻿", "ﬁ", "①", "가", "é", "\x00", "\x7f", "\U0010ffff", "-" * 80, "日" * 90]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    out += [" ".join(rng.choice(["alpha", "beta", "Gamma9", "delté", "a" * 100]) for _ in range(rng.randrange(15, 80))) for _ in range(100)]
    return [*out, None, "", " ", "▁", "\n\n", "word " * 30_000]


@pytest.fixture(scope="module")
def rows(texts):
    out = list(enumerate(texts)) + [(None, texts[410]), (None, None), (None, texts[420]), (410, texts[410]), (410, texts[410]), (411, texts[412])]
    return [(i, t, "en", "h", "1", "s", None, 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def told(found):
    return collections.Counter(tuple(r) for r in found.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# SentencePiece


def test_pieces_ids_spans_and_text(texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), PieceEncoder(path)
    for turn in range(2):  # the second from the cache
        ids, at, starts, ends = encoder.encode_spans(pa.array(texts))
        for i, text in enumerate(texts):
            pieces = library.encode(text or "", return_type="proto").pieces
            own = slice(at[i], at[i + 1])
            assert ids[own].tolist() == [p.id for p in pieces], (turn, text)
            assert list(zip(starts[own].tolist(), ends[own].tolist(), strict=True)) == [(p.begin, p.end) for p in pieces], text
            assert encoder.decode(ids[own]) == library.decode([p.id for p in pieces])
    rng = random.Random(4)
    for _ in range(2_000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(300), rng.randrange(190, 259), 0, 1, 2]) for _ in range(rng.randrange(12))]
        assert encoder.decode(np.array(ids, int)) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [(True, True, True), (True, False, True), (False, True, False), (False, False, True)])
def test_normaliser_and_its_alignment(texts, rule, flags):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **dict(zip(("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"), flags, strict=True)))
    spec = next(v for k, v in fields(library.serialized_model_proto()) if k == 3)
    data, offsets = buffer(pa.array(texts))
    out, at, origin, final = Normaliser(rules_of(spec)).run(data, offsets)
    for i, text in enumerate(texts):
        form, places = library.normalize(text or "", with_offsets=True)
        own = out[at[i] : at[i + 1]].tobytes()
        assert own.decode() == form
        source = np.append(origin[at[i] : at[i + 1]], final[i]) - offsets[i]
        starts = [k for k, byte in enumerate(own + b"x") if byte & 0xC0 != 0x80]
        raw = (text or "").encode()
        assert [len(raw[:k].decode()) for k in source[starts]] == list(places)


def test_piece_rows(spark, docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    expected = collections.Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        expected[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    found = sentence_pieces.digest(docs)
    assert told(found.drop("span_bytes")) == expected
    # This model changes no character, so the spans cover the text.
    assert told(found.select("doc_id", "span_bytes")) == collections.Counter((i, len((t or "").encode())) for i, t, *_ in rows)
    assert sentence_pieces.digest(docs.limit(0)).count() == 0
    one, two = sentence_pieces.decode(sentence_pieces.encode(docs)), sentence_pieces.encode(docs, decoded=True)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    again = sentence_pieces.decode(spark.createDataFrame([(1, None), (2, [])], "x int, ids array<int>"))
    assert [r["decoded"] for r in again.orderBy("x").collect()] == [None, ""]
    with pytest.raises(ValueError, match="decoded"):
        sentence_pieces.decode(again)


# importance resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, most=2):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_resample(rows, target, percent=25, least=20):
    def buckets(text):
        return [zlib.crc32(f.encode()) % 10_000 for f in features(text)[1]]

    own, aim = (collections.Counter(b for t in side for b in buckets(t)) for side in ([t for _, t in rows], target))
    own_all, aim_all = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (own_all + 10_000) / ((own[b] + 1) * (aim_all + 10_000)))) for b in range(10_000)}
    out = []
    for i, t in rows:
        found = buckets(t)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, features(t)[0]])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in out]


def test_crc_algebra():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(90)), rng.randbytes(rng.choice([0, 1, 5, 64, 65, 300, 5000]))) for _ in range(300)]
    crcs = [np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1)]
    both = importance.combine(*crcs, np.array([len(b) for _, b in pairs]))
    assert both.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_feature_buckets(texts, most):
    data, offsets = buffer(pa.array(texts))
    bucket, text, n_words = importance.feature_buckets(lowered(data), offsets, most, 10_000)
    for i, t in enumerate(texts):
        n, found = features(t, most)
        assert n_words[i] == n
        assert sorted(bucket[text == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in found)
    assert len(importance.feature_buckets(lowered(data[:0]), np.zeros(1, np.int64), most, 10)[0]) == 0


def test_resample_rows(spark, docs, rows):
    target = ["alpha beta", "delté delté GAMMA9 alpha", None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    expected = plain_resample([r[:2] for r in rows], target)
    found = importance.resample(docs, frame)
    # Rows of one doc_id and score share out their ranks in any order.
    assert told(found) == collections.Counter(expected)
    drawn = {r[0] for r in expected if r[4]}
    kept = importance.draw_documents(docs, frame)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == drawn
    few = spark.createDataFrame([(1, "a b"), (2, "c " * 30)], "doc_id long, text string")
    assert told(importance.resample(few, frame.limit(0)).select("doc_id", "rank")) == {(1, None): 1, (2, None): 1}
    assert importance.resample(docs.limit(0), frame).count() == 0


def test_resample_ties(spark):
    rng = random.Random(2)
    rows = [(i % 40 if i % 3 else None, " ".join(rng.choice("pqrst") * 3 for _ in range(25)) if i % 5 else "one text " * 15) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = importance.resample(frame, frame.select("text").limit(20)).collect()
    ranks = sorted(r["rank"] for r in found if r["rank"])
    assert ranks == list(range(1, 25 * 300 // 100 + 1)) and len(found) == 300
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])]
    assert order == sorted(order)
    assert max(order) <= min((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in found if not r["rank"])


# fill in the middle


def plain_fim(i, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, key = len(tokens), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("chunk", [1, 7, 4_096])
def test_fim_outputs(docs, rows, chunk):
    expected = collections.Counter(plain_fim(i, t) for i, t, *_ in rows)
    found = fill_middle.transform(docs, chunk=chunk)
    assert told(found) == expected and {r[2] for r in expected} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_fim_round_trip(docs, rows):
    found = fill_middle.digest(docs)
    expected = collections.Counter((*plain_fim(i, t)[:5], sha(plain_fim(i, t)[5]), sha(t or "")) for i, t, *_ in rows)
    assert told(found) == expected


def test_fim_restores_what_touches_markers(spark):
    texts = ["<", "<S", "P>", ">", "<P", "M>x<", "S><P<"]
    rows = [(i, texts[i % len(texts)] * (1 + i % 3)) for i in range(300)]
    found = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    back = found.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert told(back) == collections.Counter(rows)
