"""Plain-Python counterparts of the learned operators and of each pipeline stage."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from loomgraph.llm import common, language, packing, toxicity  # noqa: E402

BYTE = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(17)
LANGUAGES = {lang: ["".join(RNG.choice(letters) for _ in range(RNG.randrange(3, 9))) for _ in range(90)] for lang, letters in (("aa", "abcdefgh"), ("bb", "ghijklmn"), ("cc", "nopqrstaeu"))}
RUDE = ["vile", "stupid", "hateful", "idiots"]


def prose(lang, n, rude=False):
    words = [RNG.choice(LANGUAGES[lang]) for _ in range(n)]
    for _ in range(n // 6 if rude else 0):
        words[RNG.randrange(n)] = RNG.choice(RUDE)
    return " ".join(words)


# --------------------------------------------------------------------------- 6
def bucket(gram: str) -> int:
    m, h = 2**32, ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x01000193 + ord(c)) % m
    mixed = (h ^ h >> 15) * (0x2C1B3C6D + 2 * len(gram)) % m
    return ((mixed ^ mixed >> 12) * 0x297A2D39 % m) >> (32 - toxicity.BUCKETS_LOG)


def features(text):
    t = (text or "").lower()
    return {bucket(t[i : i + n]) for n in toxicity.ORDERS for i in range(len(t) - n + 1)}


def brute_toxicity(texts, toxic, share, others):
    sets = [features(t) for t in texts]
    n_p, n_q = sum(toxic), len(toxic) - sum(toxic)
    p, q = (collections.Counter(b for s, y in zip(sets, toxic, strict=True) if y == side for b in s) for side in (1, 0))
    ratio = {b: math.log((p[b] + 1) / (n_p + 2)) - math.log((q[b] + 1) / (n_q + 2)) for b in {*p, *q}}
    ratio = {b: r for b, r in ratio.items() if p[b] + q[b] >= toxicity.MIN_ROWS and abs(r) >= toxicity.MIN_RATIO}
    sets = [[b for b in s if b in ratio] for s in sets]
    w, g2, bias, gb2 = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-8), 0.0, 1e-8
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-40, min(40, z))))
    for _ in range(toxicity.STEPS):
        e = [(sigmoid(bias + sum(w[b] * ratio[b] for b in s)) - y) / len(toxic) for s, y in zip(sets, toxic, strict=True)]
        g = {b: toxicity.DECAY * w[b] for b in ratio}
        for s, x in zip(sets, e, strict=True):
            for b in s:
                g[b] += x * ratio[b]
        for b in ratio:
            g2[b] += g[b] ** 2
            w[b] -= toxicity.RATE * g[b] / math.sqrt(g2[b])
        gb2 += sum(e) ** 2
        bias -= toxicity.RATE * sum(e) / math.sqrt(gb2)
    bias += math.log(share / (1 - share)) - math.log(n_p / n_q)
    return [sigmoid(bias + sum(w[b] * ratio[b] for b in features(t) if b in ratio)) for t in others]


def test_toxicity_against_brute_force(spark):
    texts = [prose("aa", 40, i % 3 == 0) for i in range(60)] + [None, "", "Vile IDIOTS!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = [(i, int(i % 3 == 0)) for i in range(0, 45)]
    model = toxicity.train(docs, spark.createDataFrame(known, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = brute_toxicity([texts[i] for i, _ in known], [y for _, y in known], 15 / 45, texts)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=2e-4)
    assert max(got[i] for i in range(60) if i % 3) < 0.5 < min(got[i] for i in range(60) if i % 3 == 0)


def test_toxicity_takes_a_bounded_sample_of_each_class(spark):
    docs = spark.createDataFrame([(i % 40, prose("aa", 20, i % 40 >= 30)) for i in range(200)], "doc_id long, text string")  # five texts for each id
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_per_class=6)
    assert {r.toxic: r.n for r in toxicity.sample(docs, labels, 6).groupBy("toxic").agg(F.count("*").alias("n")).collect()} == {0: 6, 1: 6}
    assert model.weights.any()


# --------------------------------------------------------------------------- 9
def grams(text):
    t = regex.sub(r"[^\p{L}\p{M}]+", " ", " " + (text or "").lower() + " ").ljust(language.N)
    return [t[i : i + language.N] for i in range(len(t) - language.N + 1)]


def brute_language(rows):
    """The n-grams of each language by plain sets."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        if lang is not None:
            counts[lang].update(grams(text))
    return {lang: {g for g, n in c.items() if n > 1 and n >= language.MIN_SHARE * sum(c.values())} for lang, c in counts.items()}


def brute_predict(sets, text):
    own = grams(text)
    shares = {lang: sum(g in s for g in own) / len(own) for lang, s in sorted(sets.items())}
    best = max(shares, key=lambda k: shares[k])
    if not regex.search(r"\p{L}", text or ""):
        return "und", 0.0, 0.0
    return best, shares[best] / (sum(shares.values()) or 1), shares[best]


def test_language_against_plain_sets(spark):
    rows = [(i, prose(lang, 30), lang if i % 5 else None) for i, lang in enumerate([*LANGUAGES] * 40)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "cc"), (903, "x", None), (904, "Ünï ΣΟΦΟΣ 日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, sets = language.learn(docs), brute_language([(t, lang) for _, t, lang in rows])
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for i, text, _ in rows:
        lang, score, known = brute_predict(sets, text)
        assert got[i].lang_pred == lang or known == 0
        assert (got[i].lang_score, got[i].lang_known) == pytest.approx((score, known), abs=0.02)


# --------------------------------------------------------------------------- 8
def test_repeat_counts_solve_the_least_squares():
    """On a problem small enough for an exact active-set search, the multiplicative updates end near the optimum."""
    import itertools

    combos = packing.combinations(np.array([2, 3, 5, 8]), 8)
    histogram = np.zeros(9)
    histogram[[2, 3, 5, 8]] = [7, 12, 9, 3]
    weight = np.where(histogram > 0, 1 / np.maximum(histogram, 1), 0.0)
    a = np.zeros((9, len(combos)))
    for j, c in enumerate(combos):
        for length in c[c > 0]:
            a[length, j] += 1
    root = np.sqrt(weight)
    best = math.inf
    for k in range(len(combos) + 1):
        for used in itertools.combinations(range(len(combos)), k):
            x = np.zeros(len(combos))
            if used:
                x[list(used)] = np.linalg.lstsq(root[:, None] * a[:, used], root * histogram, rcond=None)[0]
            if (x >= -1e-9).all():
                best = min(best, float((weight * (a @ x - histogram) ** 2).sum()))
    x = packing.repeat_counts(combos, histogram)
    assert (x >= 0).all() and float((weight * (a @ x - histogram) ** 2).sum()) <= best + 1e-3


# --------------------------------------------------------------------------- byte tokenizer
def test_byte_tokenizer_on_random_texts():
    from tokenizers import Tokenizer

    lib, own, rng = Tokenizer.from_file(BYTE), common.byte_tokenizer(BYTE), random.Random(23)
    pools = [range(32, 127), range(9, 33), range(0x80, 0x250), range(0x300, 0x530), range(0x2000, 0x2100), range(0x3000, 0xD7FF), range(0x1F300, 0x1FA00)]
    for _ in range(3000):
        t = "".join(chr(rng.choice(rng.choice(pools[: rng.randrange(1, 8)]))) for _ in range(rng.randrange(80)))
        assert own(t).tolist() == lib.encode(t, add_special_tokens=False).ids


# --------------------------------------------------------------------------- pipeline
def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_each_stage_against_brute_force(spark, tmp_path):
    passage = prose("bb", 60)
    texts = [prose("aa", 50, i % 4 == 0) for i in range(24)]
    texts += [prose("bb", 60) for _ in range(8)] + [prose("bb", 20) + " " + passage + " " + prose("bb", 20) for _ in range(3)]
    base = prose("cc", 150).split()
    texts += [" ".join(base), " ".join([*base[:140], *(f"neu{i}" for i in range(6))]), " ".join(base), None, "", "1 2 3", "".join(chr(0x4E00 + i) for i in range(40))]
    langs = [next((k for k, v in LANGUAGES.items() if t and t.split() and t.split()[0] in v), None) for t in texts]
    rows = [(i, t, lang, "web", len(t or "")) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    known = [(i, int(i < 24 and i % 4 == 0)) for i in [*range(32), 35, 36]]
    spark.createDataFrame(known, "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = docs.collect()
        if name == "toxicity":
            scores = brute_toxicity([texts[i] for i, _ in known], [y for _, y in known], 6 / 34, [left[i][1] for i in sorted(left)])
            left = {i: left[i] for i, s in zip(sorted(left), scores, strict=True) if s < 0.5}
            assert set(range(0, 24, 4)).isdisjoint(left)
        elif name == "language":
            sets = brute_language([(r[1], r[2]) for r in left.values()])
            left = {i: r for i, r in left.items() if brute_predict(sets, r[1])[2] >= language.MIN_KNOWN}
            assert {38, 39, 40, 41}.isdisjoint(left) and 35 in left
        elif name == "near_duplicates":
            ids = sorted(left)
            shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in ids for w in [words(left[i][1])]}
            root = {i: i for i in ids}
            for _ in ids:
                for a in ids:
                    for b in ids:
                        if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                            root[a] = root[b] = min(root[a], root[b])
            left = {i: left[i] for i in ids if root[i] == i}
            assert 35 in left and not {36, 37} & set(left)
        elif name == "substrings":
            seen = set()
            for i in sorted(left):
                w = words(left[i][1])
                gone = [False] * len(w)
                for k in range(len(w) - 19):
                    key = tuple(w[k : k + 20])
                    if key in seen:
                        gone[k : k + 20] = [True] * 20
                    seen.add(key)
                if any(gone):
                    t = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
                    left[i] = (i, t, *left[i][2:4], len(t))
            assert sum(r[1].count(passage) for r in left.values()) == 1
        if name != "packing":
            assert sorted(tuple(r) for r in got) == sorted(left.values()), name
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(BYTE)
            want = {i: 1 + len(lib.encode(r[1], add_special_tokens=False).ids) for i, r in left.items()}
            n = collections.Counter()
            for r in got:
                n[r.doc_id] += r.length
            assert n == want
