"""The training-data operators against brute force, the libraries they stand for, and exact round trips, on small and odd tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomgraph.llm import bpe, common, components, embedding_dedup, language, lm_scoring, near_dup, packing, search, substring, token_store, toxicity  # noqa: E402
from loomgraph.llm.common import Scratch, Words, byte_tokenizer  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, score double, ids string"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60)
BASE = prose(300).split()


def near(k):
    words = list(BASE)
    for i in range(k):
        words[(37 * i + k) % 300] = f"changed{k}x{i}"
    return " ".join(words)


TEXTS = [
    None, "", "   \n", "one", "two words", "Hello, world! <|endoftext|> it's 12 o'clock", "naïve Ünïcode — ſ ǅ Σίσυφος 日本語 🙂 \x1c\x85 \xa0end", "a" * 5000, " " * 3000 + "x",
    prose(40), prose(25) + " " + PASSAGE, PASSAGE + " " + prose(30), PASSAGE, "\n".join([prose(22)] * 5), *[near(k) for k in range(8)], " ".join(BASE), " ".join(BASE), prose(9000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, 1.0, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, repeated ids with different texts, null ids."""
    rows = [(1, PASSAGE, None, None, None), (1, PASSAGE, None, None, None), (1, "other " + PASSAGE, None, None, None), (None, PASSAGE, None, None, None), (None, None, None, None, None), (2, PASSAGE + " tail", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# --------------------------------------------------------------------------- common
def test_words_and_hashes():
    raw = [(t or "").encode() for t in TEXTS]
    w = Words(raw)
    assert [w.text(i).decode() for i in range(len(w.begin))] == [x for t in TEXTS for x in words(t)]
    texts = [w.text(i) for i in range(len(w.begin))]
    assert len(set(texts)) == len(set(w.hash.tolist())) == len(set(zip(texts, w.hash.tolist(), strict=True)))


def test_byte_tokenizer_is_the_library():
    lib, own = library(BYTE), byte_tokenizer(BYTE)
    for t in TEXTS:
        assert own(t or "").tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000, i) for i in range(900, 990)] + [(i, i + 1) for i in range(2000, 2060)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    least = {x: x for ab in links if ab[0] != ab[1] for x in ab}
    for _ in range(200):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least


# --------------------------------------------------------------------------- 1
def brute_links(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return {(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def classes(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_duplicates_against_brute_force(docs, odd, empty):
    links = brute_links(TEXTS)
    count, root = collections.Counter(x for ab in links for x in ab), classes(len(TEXTS), links)
    got = by_id(near_dup.near_duplicates(docs))
    assert len(links) > 20
    assert {i: (r.n_links, r.class_id, r.kept) for i, r in got.items()} == {i: (count[i], root[i], root[i] == i) for i in range(len(TEXTS))}
    assert near_dup.near_duplicates(empty).count() == 0
    out = near_dup.near_duplicates(odd).collect()
    assert len(out) == 6 and all(r.kept and r.class_id is None for r in out if r.doc_id is None)
    assert near_dup.keep_one(docs).columns == docs.columns


def test_large_groups_go_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    texts = [" ".join([*BASE[:120], f"own{i}"]) for i in range(23)] + [prose(50) for _ in range(5)]
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert all(got[i].n_links == 22 and got[i].class_id == 0 for i in range(23)) and all(got[i].n_links == 0 for i in range(23, 28))


def test_dense_nodes_are_left_for_longer_prefixes():
    import pyarrow as pa

    shortest, longest = near_dup.lengths_of_use(0.8)
    usual, lengths = near_dup.prefix_length(0.8), range(shortest, longest + 1)
    crowd = lambda tree: 500 if tree < 4 else 2
    of = lambda trees: ([t for t in range(trees) for _ in lengths], [k for _ in range(trees) for k in lengths], [0] * trees * len(lengths), [crowd(t) for t in range(trees) for _ in lengths])
    docs = [of(near_dup.TREES), of(2 * near_dup.TREES), ([7], [usual], [1], [2])]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in docs[:1]], pa.list_(t)) for i, t in enumerate(kinds)], names=["keys", "lengths", "prefixes", "sizes"])
    (out,) = near_dup._choose(shortest, longest, 0.8)(iter([batch]))
    at = dict(zip(out.column("key").to_pylist(), out.column("length").to_pylist(), strict=True))
    assert all(at[t] > usual for t in range(4)) and all(at[t] < usual or at[t] == usual for t in range(4, near_dup.TREES))
    assert near_dup.recall(np.array(list(at.values())), 0.8) >= near_dup.TARGET_RECALL
    batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in docs[1:]], pa.list_(t)) for i, t in enumerate(kinds)], names=["keys", "lengths", "prefixes", "sizes"])
    (out,) = near_dup._choose(shortest, longest, 0.8)(iter([batch]))
    assert set(out.column("length").to_pylist()) == {usual}


def test_prefixes_shorten_until_the_recall():
    assert near_dup.prefix_length(0.6) < near_dup.prefix_length(0.7) < near_dup.prefix_length(0.8) <= near_dup.DEEPEST - near_dup.MORE
    shortest, longest = near_dup.lengths_of_use(0.8)
    sizes = np.ones((near_dup.TREES, longest - shortest + 1))
    usual = near_dup.rest_at(sizes, shortest, longest, 0.8)
    assert (usual == near_dup.prefix_length(0.8)).all() and near_dup.recall(usual, 0.8) >= near_dup.TARGET_RECALL
    for dense in (3, 12, 25, 32):  # dense trees keep longer prefixes as far as the others make up for it
        sizes[:dense] = 5000 - np.arange(dense)[:, None]
        at = near_dup.rest_at(sizes, shortest, longest, 0.8)
        assert near_dup.recall(at, 0.8) >= near_dup.TARGET_RECALL
        assert at[:dense].mean() > usual[0] if dense < 20 else (at >= shortest).all()
    assert near_dup.rest_at(sizes, shortest, longest, 0.8)[0] >= near_dup.rest_at(sizes, shortest, longest, 0.8)[31]


@pytest.mark.parametrize("jaccard", [0.80, 0.85, 0.90])
def test_trees_reach_the_recall_by_simulated_signatures(jaccard):
    rng, n, missed = np.random.default_rng(12), 4, 0
    label = near_dup.labels(near_dup.prefix_length(0.8))
    for _ in range(n):
        same = rng.random((50_000, near_dup.HASHES), np.float32) < jaccard
        missed += int((~same[:, label].all(2).any(1)).sum())
    assert missed / (n * 50_000) <= 1 - near_dup.TARGET_RECALL


@pytest.mark.parametrize("jaccard", [0.80, 0.85, 0.90])
def test_labels_of_real_sets_meet(jaccard):
    """Pairs of sets with that similarity share the prefix they come to rest at in some tree, by the hashes of use."""
    rng, pairs, size = np.random.default_rng(14), 3000, 90
    both = round(jaccard * size)
    shared, own = rng.integers(0, 2**63, (pairs, both)), rng.integers(0, 2**63, (2, pairs, size - both))
    shortest, longest = near_dup.lengths_of_use(0.8)
    cut = 16 * (longest - near_dup.prefix_length(0.8))
    sides = []
    for part in (0, 1):
        mine = own[part][:, : (size - both) // 2 + part * ((size - both) % 2)]  # the union has `size` members
        sets = np.concatenate([shared, mine], 1).astype(np.uint64)
        sig = near_dup.min_hashes(sets.ravel(), np.arange(pairs) * sets.shape[1])
        sides.append(near_dup.tree_labels(sig, shortest, longest))
    (ka, ra), (kb, rb) = sides
    assert ((ka == kb) & (ra >> cut == rb >> cut)).any(1).mean() >= 0.999


def test_walk_over_sorted_labels_finds_all_shared_prefixes():
    import pyarrow as pa

    rng = np.random.default_rng(15)
    shortest, longest = 5, 8
    rows = [(int(rng.integers(3)), int.from_bytes(rng.integers(0, 3, 3).astype(">u2").tobytes(), "big"), i) for i in range(400)]
    want: dict[tuple, list[int]] = collections.defaultdict(list)
    for key, rest, i in rows:
        for k in range(shortest, longest + 1):
            want[key, k, rest >> 16 * (longest - k)].append(i)
    rows.sort()
    batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in part], "rest": [r[1] for r in part], "n": [1] * len(part), "head": [r[2] for r in part]}) for part in (rows[i : i + 7] for i in range(0, 400, 7))]
    got = {(r["key"], r["length"], r["prefix"]): (r["n"], r["head"]) for out in near_dup._walk(shortest, longest)(iter(batches)) for r in out.to_pylist()}
    assert got == {k: (len(v), min(v)) for k, v in want.items() if len(v) > 1}


def test_min_hashes_agree_as_independent_ones():
    rng, pairs = np.random.default_rng(13), 4000
    shared, own = rng.integers(0, 2**63, (pairs, 80)), rng.integers(0, 2**63, (2, pairs, 10))  # Jaccard 0.8
    a, b = (near_dup.min_hashes(np.concatenate([shared, x], 1).astype(np.uint64).ravel(), np.arange(pairs) * 90) for x in own)
    label = near_dup.labels(near_dup.prefix_length(0.8))
    trees = (a == b)[:, label].all(2).sum(1)
    p = 0.8 ** label.shape[1]
    assert trees.mean() == pytest.approx(len(label) * p, rel=0.02)
    assert trees.var() == pytest.approx(len(label) * p * (1 - p), rel=0.1)  # larger if trees share hashes


def test_alike_pairs_go_on_as_a_forest():
    import pyarrow as pa

    other = bytes(255 - i % 7 for i in range(near_dup.SKETCH))
    batch = pa.RecordBatch.from_pydict({"node": [5] * 31 + [6] * 2, "id": [*range(31), 40, 41], "sketch": [bytes(near_dup.SKETCH)] * 30 + [other] * 3})
    (out,) = near_dup._agree(0.8)(iter([batch]))
    a, b = out.column("a").to_numpy(), out.column("b").to_numpy()
    assert len(out) == 30 and components.local_roots(30, a[a < 30], b[a < 30]).max() == 0 and (40, 41) in zip(a, b, strict=True) and 30 not in {*a, *b}


# --------------------------------------------------------------------------- 2
def test_scores_against_brute_force(docs, empty):
    texts = [words(t) for t in TEXTS]

    def grams(w):
        return collections.Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

    total = collections.Counter()
    for w in texts:
        total.update(grams(w))
    n_words = sum(map(len, texts))
    got = by_id(lm_scoring.score(docs))
    for i, w in enumerate(texts):
        own, n, s = grams(w), max(1, n_words - len(w)), 0.0
        for k in range(len(w)):
            v = ((total[(w[k],)] - own[(w[k],)]) or 0.4) / n
            for m in (2, 3):
                if k - m + 1 >= 0:
                    g = tuple(w[k - m + 1 : k + 1])
                    f = total[g] - own[g]
                    v = f / (total[g[:-1]] - own[g[:-1]]) if f else 0.4 * v
            s += math.log(v)
        assert got[i].n_words == len(w) and got[i].score == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert (got[i]["mean"] is None) == (not w)
    assert lm_scoring.score(empty).count() == 0


def test_scores_of_repeated_and_null_ids(odd):
    rows = sorted((r.doc_id or 0, r.n_words, round(r.score, 9)) for r in lm_scoring.score(odd).collect())
    assert [r[:2] for r in rows] == [(0, 0), (0, 60), (1, 60), (1, 60), (1, 61), (2, 61)]
    assert rows[0][2] == 0 and rows[1][2] == rows[2][2] == rows[3][2] < 0


def test_scores_do_not_depend_on_blocks_and_ranges(docs, monkeypatch):
    """Workers run the module as it is, so blocks are made small by the number of partitions, ranges by their bytes."""
    want = {i: r.score for i, r in by_id(lm_scoring.score(docs)).items()}
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", 2000)
    assert {i: r.score for i, r in by_id(lm_scoring.score(docs.repartition(9))).items()} == pytest.approx(want, rel=1e-12)


# --------------------------------------------------------------------------- 3
def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + 0.03 * rng.standard_normal(16)).tolist(), int(i % 6 > 3)) for i in range(90)]
    rows += [(100 + i, rows[3][1], 0) for i in range(4)] + [(200, [0.0] * 16, 0), (201, None, 0), (202, [float("nan")] * 16, 0), (203, rows[3][1], None), (204, [1.0, None] * 8, 0), (205, [1.0, 2.0], 0), (None, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(df).collect()}
    ok = [(i, np.array(v), y) for i, v, y in rows if i is not None and y is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for x, (a, v, y) in enumerate(ok) for b, w, z in ok[:x] if y == z and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98]
    count = collections.Counter(x for ab in links for x in ab)
    root = {i: i for i, *_ in rows if i is not None}
    for _ in range(60):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert len(links) > 300
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items() if i is not None} == {i: (count[i], c, c == i) for i, c in root.items()}
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def brute_components(v, threshold=0.98):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = v @ v.T >= threshold
    np.fill_diagonal(linked, False)
    return linked.sum(1), components.local_roots(len(v), *np.nonzero(linked))


def embedding_rows(spark, v):
    got = embedding_dedup.near_embeddings(spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()
    return np.array([(r.n_links, r.component_id) for r in sorted(got, key=lambda r: r.vec_id)]).T


def test_a_star_of_embeddings_is_one_component(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    off = rng.standard_normal((3000, 64))
    off -= np.outer(off @ base, base)
    cos = rng.uniform(0.981, 0.987, 3000)[:, None]
    v = np.concatenate([base[None], cos * base + np.sqrt(1 - cos**2) * off / np.linalg.norm(off, axis=1, keepdims=True)])
    count, root = brute_components(v)
    n, c = embedding_rows(spark, v)
    assert not root.any() and (c == root).all() and (n == count).all()


def test_embeddings_are_linked_across_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "PASSES", 1)
    monkeypatch.setattr(embedding_dedup, "REACH", 1)
    v = np.random.default_rng(9).standard_normal((1500, 5)) + 0.7
    count, root = brute_components(v)
    n, c = embedding_rows(spark, v)
    assert count.sum() > 2000 and (n == count).all() and (c == root).all()


# --------------------------------------------------------------------------- 4
def test_bpe_is_the_library(docs, odd, empty):
    lib = library(WORD)
    encoded = bpe.encode(docs, WORD)
    ids, decoded, digests = by_id(encoded), by_id(bpe.decode(encoded, WORD)), by_id(bpe.round_trip(docs, WORD))
    for i, t in enumerate(TEXTS):
        want = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(want, skip_special_tokens=False)
        assert ids[i].ids == want and decoded[i].text == text
        assert (digests[i].n_tokens, digests[i].ids_sha256, digests[i].decoded_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode(odd, WORD).count() == 6 and bpe.encode(empty, WORD).count() == 0


def test_bpe_on_random_characters():
    lib, own, rng = library(WORD), bpe.Codec(WORD), random.Random(11)
    pools = [range(32, 127), range(0x80, 0x250), range(0x370, 0x530), range(0x2000, 0x2100), range(0x20, 0xD7FF)]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(60)) for _ in range(800)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert lib.encode(t, add_special_tokens=False).ids == ids.tolist()


# --------------------------------------------------------------------------- 5
def brute_search(texts, queries, k):
    """query -> [(doc, score)]: by score, then doc."""
    bags = [collections.Counter(regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())) for t in texts]
    sizes = [sum(b.values()) for b in bags]
    mean, n, df = sum(sizes) / len(bags), len(bags), collections.Counter(w for b in bags for w in b)
    out = {}
    for q in queries:
        found = []
        for i, b in enumerate(bags):
            s = sum(m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) for w, m in bags[q].items() if w in b)
            if s:
                found.append((-round(s, 9), i, s))
        out[q] = [(i, s) for _, i, s in sorted(found)[:k]]
    return out


def test_search_against_brute_force(docs, odd, empty):
    got = collections.defaultdict(list)
    for r in search.search(docs, docs.where("doc_id % 3 = 0"), k=4).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    for q, want in brute_search(TEXTS, range(0, len(TEXTS), 3), 4).items():
        assert [i for _, i, _ in sorted(got[q])] == [i for i, _ in want]  # equal texts tie, and the smaller doc_id comes first
        assert [s for *_, s in sorted(got[q])] == pytest.approx([s for _, s in want], rel=1e-9)
    assert search.search(empty, empty).count() == 0 and search.search(docs, empty).count() == 0
    assert {r.doc_id for r in search.search(odd, odd.where("doc_id = 2")).collect()} == {1, 2}


def test_search_prunes_and_stays_exact(monkeypatch):
    """Shards, blocks, waves and thresholds at small sizes, run without Spark."""
    import pyarrow as pa

    for name, value in (("SHARD_DOCS", 150), ("BLOCK_DOCS", 4), ("DENSE", 12), ("WAVES", (1, 5)), ("PART_QUERIES", 7), ("CLUSTERS", 6)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(21)
    dialects = [[f"{d}w{i}" for i in range(120)] for d in "abc"]
    texts = [" ".join(v[min(119, int(rng.paretovariate(0.7)))] for _ in range(rng.randrange(1, 60))) for v in (rng.choice(dialects) for _ in range(700))]
    texts += [texts[i] for i in range(0, 60, 5)] + [None, "", "!"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "part": [0] * len(texts)})
    index = [r for b in search._index(iter([batch])) for r in b.to_pylist()]
    assert len(index) > 3
    asked = list(range(0, len(texts), 9))
    parts = [r for b in search._query_parts(iter([batch.take(pa.array(asked))])) for r in b.to_pylist()]
    df = collections.Counter()
    for b in search._counted(iter([pa.RecordBatch.from_pylist(index)])):
        df.update(dict(zip(b.column("term").to_pylist(), b.column("n").to_pylist(), strict=True)))
    n, mean = sum(r["n"] for r in index), sum(r["words"] for r in index) / sum(r["n"] for r in index)
    shards, scored = [search._Shard(r, mean) for r in index], []
    whole = search._Shard._score
    monkeypatch.setattr(search._Shard, "_score", lambda self, p, q, t, w, d: (scored.append(len(d)), whole(self, p, q, t, w, d)))
    got = {}
    for row in parts:
        t = [x for x in np.frombuffer(row["terms"], "<i8").tolist() if x in df]
        row |= {"known": np.array(t, "<i8").tobytes(), "frequencies": np.array([df[x] for x in t], "<i8").tobytes()}
        row |= {"idf": search._idf(row, n)}
        first = search._Part(row, 5)
        shards[0].visit(first)
        queries = search._Part(row | {"floor": first.floor.tobytes()}, 5)
        for shard in shards:
            shard.visit(queries)
        got |= {int(i): list(zip(d.tolist(), s.tolist(), strict=True)) for i, (d, s) in zip(queries.ids, queries.best, strict=True)}
    for q, want in brute_search(texts, asked, 5).items():
        assert [i for i, _ in got[q]] == [i for i, _ in want] and [s for _, s in got[q]] == pytest.approx([s for _, s in want], rel=1e-9)
    assert sum(scored) < 0.5 * len(asked) * len(texts)


def test_search_joins_shards(monkeypatch):
    """A task searches neighbouring shards as one: short and long postings, frequent terms, words repeated in a query, and empty texts."""
    import types

    import pyarrow as pa

    for name, value in (("SHARD_DOCS", 40), ("JOINED_DOCS", 200), ("LONG", 6), ("REPEATS", 2), ("DENSE_SHARE", 4), ("PART_QUERIES", 9)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(5)
    texts = [" ".join(f"w{min(150, int(rng.paretovariate(0.6)))}" for _ in range(rng.randrange(1, 90))) for _ in range(600)]
    texts += [texts[i] for i in range(0, 50, 5)] + [None, "", "!"] * 4
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "part": [0] * len(texts)})
    index = list(search._index(iter([batch])))
    asked = [*range(0, len(texts), 11), *range(len(texts) - 12, len(texts))]
    parts = [r for b in search._query_parts(iter([batch.take(pa.array(asked))])) for r in b.to_pylist()]
    df = collections.Counter()
    for b in search._counted(iter(index)):
        df.update(dict(zip(b.column("term").to_pylist(), b.column("n").to_pylist(), strict=True)))
    n, words = sum(b.column("n")[0].as_py() for b in index), sum(b.column("words")[0].as_py() for b in index)
    for row in parts:
        t = [x for x in np.frombuffer(row["terms"], "<i8").tolist() if x in df]
        row |= {"known": np.array(t, "<i8").tobytes(), "frequencies": np.array([df[x] for x in t], "<i8").tobytes()}
        row |= {"idf": search._idf(row, n)}
    searched, whole = [], search._Shard.__init__
    monkeypatch.setattr(search._Shard, "__init__", lambda self, row, mean: (searched.append(len(row["ids"]) // 8), whole(self, row, mean))[1])
    got = collections.defaultdict(list)
    for b in search._search(types.SimpleNamespace(value=parts), 4, words / n)(iter(index)):
        for r in b.to_pylist():
            for q, d, x in zip(*(np.frombuffer(r[c], t).tolist() for c, t in (("queries", "<i8"), ("docs", "<i8"), ("scores", "<f8"))), strict=True):
                got[q].append((d, x))
    for q, want in brute_search(texts, asked, 4).items():
        assert [i for i, _ in got[q]] == [i for i, _ in want] and [s for _, s in got[q]] == pytest.approx([s for _, s in want], rel=1e-9)
    assert len(index) == 16 and searched == [200, 200, 200, 22]


def test_search_terms_are_runs_of_letters_marks_and_digits():
    rng = random.Random(17)
    pools = [range(0, 128), range(0x80, 0x250), range(0x300, 0x530), range(0x2000, 0x2100), range(0x20, 0xD7FF), range(0x1F300, 0x1F700)]
    few = ["Straße — naïve… ΣΊΣΥΦΟΣ e\u0301 ½ x²\u00a0\x85\x1c\tend\n" + "".join(chr(rng.choice(range(32, 256))) for _ in range(20)) for _ in range(3)]
    many = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(80)) for _ in range(300)]
    for texts in (few, many, [*few, *many], ["", "!", " "], [*TEXTS[1:9]]):
        got = [x.decode().split(" ") for x in search._spaced([x.encode() for x in texts])]
        assert [[w for w in x if w] for x in got] == [regex.findall(r"[\p{L}\p{M}\p{N}]+", x.lower()) for x in texts]
    assert search._spaced([]) == []


# --------------------------------------------------------------------------- 6
def test_toxicity_on_held_out_rows(spark, sf):
    d, labels = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{sf[:-5]}0.01/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(d, labels.where(~fold))
    held = toxicity.score(d.join(labels.where(fold), "doc_id"), model).select("toxic", "score").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) > 0.95
    clean = toxicity.keep_clean(d, model)
    assert clean.columns == d.columns and clean.schema == d.schema


def test_toxicity_of_odd_tables(docs, odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none).bias < 0
    one = spark.createDataFrame([(9, 1), (10, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, one)
    assert all(r.score > 0.5 for r in toxicity.score(docs.drop("score"), model).collect())
    assert toxicity.score(odd.drop("score"), model).count() == 6 and toxicity.score(empty.drop("score"), model).count() == 0
    assert toxicity.keep_clean(docs, toxicity.train(docs, none)).columns == docs.columns


# --------------------------------------------------------------------------- 7
def brute_cut(texts, n=20):
    seen, out = set(), []
    for t in texts:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[i : i + n] = [True] * n
            seen.add(key)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substrings_against_brute_force(docs, odd, empty, spark):
    want, got = brute_cut(TEXTS), by_id(substring.dedup(docs))
    assert sum(x[1] for x in want) > 1000
    for i, (n, gone, kept) in enumerate(want):
        assert (got[i].n_words, got[i].n_removed) == (n, gone)
        assert got[i].text == (kept if gone else TEXTS[i])
    assert substring.dedup(empty).count() == 0
    out = substring.dedup(odd).collect()  # the null doc_id comes first and keeps the passage
    assert {(r.doc_id, r.n_words, r.n_removed) for r in out} == {(None, 60, 0), (None, 0, 0), (1, 60, 60), (1, 61, 60), (2, 61, 60)}
    short = spark.createDataFrame([(1, prose(5))], "doc_id long, text string")
    assert substring.dedup(short).first().n_removed == 0


def test_a_full_sketch_loses_nothing(docs, monkeypatch):
    monkeypatch.setattr(substring, "MIN_WIDTH_LOG", 9)
    monkeypatch.setattr(substring, "MAX_WIDTH_LOG", 9)
    got = by_id(substring.dedup(docs))
    assert [(got[i].n_words, got[i].n_removed) for i in range(len(TEXTS))] == [x[:2] for x in brute_cut(TEXTS)]


# --------------------------------------------------------------------------- 8
def test_packing(docs, odd, empty):
    lib = library(BYTE)
    rows = packing.pack(docs, BYTE, 1, window=64).collect()
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert set(seqs) == set(range(len(seqs)))
    assert packing.pack(empty, BYTE, 1).count() == 0 and packing.pack(odd, BYTE, 1).count() == 6
    whole = packing.sequences(packing.pack(docs, BYTE, 1, window=64), docs, BYTE, 1)
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == sum(r.length for r in rows)


def test_plan_pads_little():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2049, 20_000)
    values, n = np.unique(lengths, return_counts=True)
    p = packing.plan(dict(zip(values.tolist(), n.tolist(), strict=True)), 2048)
    assert p.padding < 0.005 * lengths.sum()
    assert p.n.sum() == 20_000


# --------------------------------------------------------------------------- 9
def test_language_on_held_out_rows(spark, sf):
    d = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.learn(d.where(~fold))
    held = language.predict(d.where(fold), model).select("lang", "lang_pred", "lang_score").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.lang_score <= 1 for r in held)
    assert language.identified(d, model).schema == d.schema


def test_filter_returns_all_holders():
    rng = np.random.default_rng(1)
    sets = {f"l{i}": rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64) for i in range(70)}
    sets["l3"] = np.concatenate([sets["l3"], sets["l69"][:100]])
    f = language.Filter.build(sets)
    for k, name in enumerate(f.languages):
        masks = f.holders(sets[name])
        assert (masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).all()
    assert (f.false_positive < 0.01).all()


def test_language_of_odd_tables(docs, odd, empty, spark):
    model = language.learn(docs)
    got = by_id(language.predict(docs, model))
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in (0, 1, 2))
    assert {got[i].lang_pred for i in range(3, len(TEXTS))} == {"en"}
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0
    assert language.identified(docs.withColumn("lang_pred", F.lit(1)), model).columns == [*docs.columns, "lang_pred"]


# --------------------------------------------------------------------------- 10
def test_token_store_round_trip(spark, docs, odd, empty, tmp_path):
    lib = library(BYTE)
    store = token_store.TokenStore(spark, f"file://{tmp_path}/store").write(docs, BYTE, 2)
    read, ids = by_id(store.read_lengths_and_crc()), by_id(store.read_ids())
    start = 0
    for i, t in enumerate(TEXTS):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert ids[i].ids == want
        assert (read[i].start, read[i].n_tokens, read[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    chunks = spark.read.parquet(f"file://{tmp_path}/store/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert len(store.root()) == 32
    assert token_store.TokenStore(spark, f"file://{tmp_path}/odd").write(odd, BYTE, 2).read_lengths_and_crc().count() == 6
    assert token_store.TokenStore(spark, f"file://{tmp_path}/empty").write(empty, BYTE, 2).read_lengths_and_crc().count() == 0


def test_a_damaged_store_is_noticed(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    store = token_store.TokenStore(spark, path).write(docs, BYTE, 2)
    objects = spark.read.parquet(f"{path}/objects")
    objects.where("kind <> 'chunk' or hash(digest) % 5 <> 0").write.partitionBy("kind").parquet(f"{path}/less")
    store._read = lambda folder: spark.read.parquet(f"{path}/{'less' if folder == 'objects' else folder}")
    with pytest.raises(Exception, match="missing"):
        store.read_lengths_and_crc().collect()
    objects.withColumn("payload", F.when(F.col("kind") == "chunk", F.concat("payload", F.lit(b"\0\0")))).write.partitionBy("kind").parquet(f"{path}/bad")
    store._read = lambda folder: spark.read.parquet(f"{path}/{'bad' if folder == 'objects' else folder}")
    with pytest.raises(Exception, match="damaged"):
        store.read_lengths_and_crc().collect()


def test_crc_of_joined_parts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 4096, 1_000_003):
        a, b = rng.bytes(77), rng.bytes(n)
        got = token_store.shift_crc(np.array([zlib.crc32(a)]), np.array([n]))[0] ^ zlib.crc32(b)
        assert got == zlib.crc32(a + b)


# --------------------------------------------------------------------------- pipeline
def test_pipeline_keeps_the_columns(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert isinstance(docs.schema["sequence_id"].dataType, T.LongType)


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_keys_are_spread_over_partitions(spark):
    for n in (1, 7, 40):
        df = spark.createDataFrame([(int(k),) for k in common.spread_keys(n)], "k int").repartition(n, "k")
        assert [r[0] for r in df.select(F.spark_partition_id(), "k").orderBy(F.spark_partition_id()).collect()] == list(range(n))
        assert [r[1] for r in df.select(F.spark_partition_id(), "k").orderBy(F.spark_partition_id()).collect()] == common.spread_keys(n).tolist()
