"""N-gram Jaccard join by a MinHash LSH forest.

Documents whose sets of word ``SHINGLE``-grams have a Jaccard similarity of ``threshold`` or more are linked.

1. Each document gets min-hashes, none in two of the ``TREES`` trees. Its label in a tree is a sequence of them; documents
   with equal sets of shingles are one class from here on. Sorted labels are a prefix trie: one walk over the sorted
   labels of a tree gives its nodes, that is the shared prefixes of every length from the longest down to the shortest
   of use, with their sizes. Labels that share not even the shortest prefix with another are gone before.
2. Matched prefixes are shortened from the longest on, in all trees, until a pair at the threshold would meet with
   probability ``TARGET_RECALL``. A tree in which the document's next shorter prefix is shared by more than ``NODE``
   classes waits: the other trees are shortened further in its place, and only if the recall is still short are such dense
   trees shortened too, the smallest node first. So dense neighbourhoods are told apart by longer prefixes at the same recall.
3. A node that some document came to rest at, with up to ``NODE`` classes, compares the min-hashes of all its pairs and
   proposes those that do not differ too much (a forest of them leaves; a pair at the threshold is left out with probability
   3e-6, which the target leaves room for). A larger one proposes its members as one group, by a star to its least member; no pair
   of it is spelled out.
4. Proposals make groups (connected components). Inside each, all pairs are verified exactly on their full shingle
   sets, in tiles of two blocks, with bit maps over the shingles that a tile shares. Only link counts and stars leave.
5. Verified links make the classes of near-duplicates.

A link at similarity 0.8 is missed with probability 1e-4 at most by design, and less above it. What is linked is always verified.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A document with fewer words than a shingle has one shingle, all its words;
one without words (null and empty texts too) links with nothing. A very long text is read whole, as one slice of its own. Documents that share a
doc_id count as one node. A null doc_id takes no part (no class, no links, kept). Extra columns are ignored, whatever their names, or kept by
``keep_one``. Ties in doc_id order can't occur; a class is named by its least doc_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, mix64, parallelism, runs, span_hashes, text_slices
from .components import components, in_tiles, local_roots, tiles

SHINGLE, THRESHOLD = 5, 0.8
TREES = 32
MORE = 2  # hashes of a label beyond the prefix length that reaches the recall in all trees
DEEPEST = 8  # hashes of a label, at most
HASHES = TREES * DEEPEST  # no hash is in two trees, so that trees match independently
SKETCH = 128  # min-hashes that the estimate compares
TARGET_RECALL = 0.9999
NODE = 64  # classes in a node that proposes pairs
SLACK = 4.5  # standard deviations of the min-hash estimate that a pair may fall short
BLOCK = 256  # documents on either side of a tile


def recall(lengths: np.ndarray, threshold: float) -> float:
    """Probability that a pair at the threshold shares the prefix of the given length in some tree."""
    return 1 - float(np.prod(1 - threshold ** np.asarray(lengths, float)))


def prefix_length(threshold: float, target: float = TARGET_RECALL) -> int:
    """The longest prefix that reaches the target if all trees match by it."""
    length = DEEPEST - MORE
    while length > 1 and recall(np.full(TREES, length), threshold) < target:
        length -= 1
    return length


def lengths_of_use(threshold: float) -> tuple[int, int]:
    """The shortest and the longest prefix of the tries."""
    usual = prefix_length(threshold)
    return max(1, usual - 1), usual + MORE


def labels(depth: int) -> np.ndarray:
    """trees × depth: the min-hashes of each tree's label."""
    return np.arange(TREES * depth).reshape(TREES, depth)


_RNG = np.random.default_rng(31337)
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.int64).astype(np.uint64)


def shingles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, joined, and how many each has."""
    words = Words(raw)
    at, h = words.windows(SHINGLE)
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    h_short = span_hashes(words.hash, words.first[short], words.first[short] + words.count[short])
    doc = np.concatenate([words.doc[at], short])
    h = np.concatenate([h, h_short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(raw))


def min_hashes(h: np.ndarray, first: np.ndarray, n: int = HASHES) -> np.ndarray:
    """documents × n; every document has a shingle."""
    out = np.empty((len(first), n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(h * _A[k] + _B[k], first) >> np.uint64(32)
    return out


def tree_labels(sig: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """documents × trees: a hash of the tree and the shortest prefix, and the further min-hashes, 16 bits each, so that they sort as the label does."""
    keys, rests = np.empty((len(sig), TREES), np.int64), np.zeros((len(sig), TREES), np.int64)
    for t, places in enumerate(labels(longest)):
        x = np.full(len(sig), np.uint64(t + 1))
        for k in places[:shortest]:
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, k].astype(np.uint64))
        keys[:, t] = x.astype(np.int64)
        for k in places[shortest:]:
            rests[:, t] = rests[:, t] << 16 | sig[:, k] & 0xFFFF
    return keys, rests


def _sign(shortest: int, longest: int):
    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, TREES, dtype=np.int32), x.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_slices(batches):
            h, n = shingles(raw)
            has = np.flatnonzero(n)
            if not len(has):
                continue
            first = np.cumsum(n[has]) - n[has]
            k1, k2 = (np.add.reduceat(mix64(h ^ np.uint64(x)), first).astype(np.int64) for x in (0x51ED270B27B4F3CF, 0xA0761D6478BD642F))
            sig = min_hashes(h, first, max(SKETCH, TREES * longest))
            keys, rests = tree_labels(sig, shortest, longest)
            sketch = (sig[:, :SKETCH] & np.uint32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(has)), pa.array(k1), pa.array(k2), lists(keys), lists(rests), pa.array([r.tobytes() for r in sketch], pa.binary())], names=["doc_id", "k1", "k2", "keys", "rests", "sketch"])

    return run


# --------------------------------------------------------------------------- tries
def _walk(shortest: int, longest: int):
    """Neighbouring labels (key, rest, n, head) in order: the trie nodes of two classes or more. Of an unfinished node only its size and least member are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_nodes: dict[int, tuple[int, int, int, int]] = {}

        def nodes(length: int, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
            key, prefix, n, head = (np.concatenate(c) for c in zip(*found, strict=True))
            at = np.flatnonzero(n > 1)
            return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(np.full(len(at), length, np.int32)), pa.array(prefix[at]), pa.array(n[at]), pa.array(head[at])], names=["key", "length", "prefix", "n", "head"]) if len(at) else None

        for b in batches:
            if not len(b):
                continue
            key, rest, n, head = (b.column(c).to_numpy() for c in ("key", "rest", "n", "head"))
            for length in range(shortest, longest + 1):
                prefix = rest >> 16 * (longest - length)
                begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (prefix[1:] != prefix[:-1])]))
                k, p, size, least = key[begin], prefix[begin], np.add.reduceat(n, begin), np.minimum.reduceat(head, begin)
                found = []
                if length in open_nodes:
                    before = open_nodes[length]
                    if (k[0], p[0]) == before[:2]:
                        size[0] += before[2]
                        least[0] = min(least[0], before[3])
                    else:
                        found.append(tuple(np.array([x]) for x in before))
                open_nodes[length] = (int(k[-1]), int(p[-1]), int(size[-1]), int(least[-1]))
                found.append((k[:-1], p[:-1], size[:-1], least[:-1]))
                if (out := nodes(length, found)) is not None:
                    yield out
        for length, last in open_nodes.items():
            if (out := nodes(length, [tuple(np.array([x]) for x in last)])) is not None:
                yield out

    return run


def rest_at(sizes: np.ndarray, shortest: int, longest: int, threshold: float, target: float = TARGET_RECALL) -> np.ndarray:
    """The prefix length at which a document comes to rest in each tree. sizes: trees × lengths from shortest to longest, classes in its nodes."""
    at = np.full(TREES, longest)
    for length in range(longest - 1, shortest - 1, -1):
        if recall(at, threshold) >= target:
            return at
        at[(at == length + 1) & (sizes[:, length - shortest] <= NODE)] = length
    while recall(at, threshold) < target and (at > shortest).any():  # dense trees too, the smallest node first
        left = np.flatnonzero(at > shortest)
        at[left[np.argmin(sizes[left, at[left] - 1 - shortest])]] -= 1
    return at


def _choose(shortest: int, longest: int, threshold: float):
    """Documents with the nodes they are in (keys, lengths, prefixes, sizes): the nodes at which they come to rest, if others are there."""
    usual = rest_at(np.ones((TREES, longest - shortest + 1)), shortest, longest, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(c) for c in ("keys", "lengths", "prefixes", "sizes")]
            key, length, prefix, n = (x.flatten().to_numpy() for x in lists)
            ends = np.cumsum(lists[0].value_lengths().to_numpy())
            doc = np.repeat(np.arange(len(b)), np.diff(ends, prepend=0))
            dense = np.zeros(len(b), bool)
            dense[doc[n > NODE]] = True
            chosen = length == usual[0]  # without dense nodes all trees come to rest alike
            for d in np.flatnonzero(dense):
                own = np.arange(ends[d - 1] if d else 0, ends[d])
                keys, tree = np.unique(key[own], return_inverse=True)
                if len(keys) > TREES:  # several texts under one doc_id: they rest where documents usually do
                    continue
                sizes = np.ones((TREES, longest - shortest + 1))
                sizes[tree, length[own] - shortest] = n[own]
                chosen[own] = length[own] == rest_at(sizes, shortest, longest, threshold)[tree]
            kept = np.unique(np.rec.fromarrays([key[chosen], length[chosen], prefix[chosen]], names=["key", "length", "prefix"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(kept[c])) for c in ("key", "length", "prefix")], names=["key", "length", "prefix"])

    return run


# --------------------------------------------------------------------------- proposals
def _agree(threshold: float):
    """Neighbouring rows of one node: its members in connected pieces, by the pairs whose estimate is at most SLACK deviations below the threshold.

    A forest leaves that joins the same documents; the pairs, NODE² / 2 at most, are compared where the node is.
    """
    chance = threshold + (1 - threshold) / 256
    least = SKETCH * threshold - SLACK * np.sqrt(SKETCH * chance * (1 - chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, rows in runs(batches, "node"):
            ids = np.array([x[0] for x in rows])
            sketches = np.frombuffer(b"".join(x[1] for x in rows), np.uint8).reshape(-1, SKETCH)
            a, b = np.triu_indices(len(ids), 1)
            hit = (sketches[a] == sketches[b]).sum(1) >= least
            root = local_roots(len(ids), a[hit], b[hit])
            moved = np.flatnonzero(ids[root] != ids)
            found_a.append(ids[root[moved]])
            found_b.append(ids[moved])
            if len(found_a) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])
                found_a, found_b = [], []
        if found_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    return run


def _similar(threshold: float):
    num = round(threshold * 10_000)

    def compare(table: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1  # shingles that two rows of the tile share
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = count[place] > 1
        row, bit = row[shared], number[place[shared]]
        width = int((count > 1).sum()) // 64 + 1
        maps = np.zeros((len(sets), width), np.uint64)
        np.bitwise_or.at(maps, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        out = np.zeros((len(sets), len(sets)), bool)
        for i in range(len(sets) - 1):
            common = np.bitwise_count(maps[i + 1 :] & maps[i]).sum(1, dtype=np.int64)
            out[i, i + 1 :] = common * 10_000 >= num * (sizes[i] + sizes[i + 1 :] - common)
        return out | out.T

    return compare


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw in text_slices(batches):
        h, n = shingles(raw)
        at = np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("id"), batch.column("weight"), pa.array([h[e - k : e].tobytes() for e, k in zip(at, n, strict=True)], pa.binary())], names=["component", "id", "weight", "grams"])


def _proposed(heads: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """a, b: pairs whose connected components hold, with the target recall, every pair at the threshold or above in one piece. heads: id, keys, rests, sketch."""
    spark = heads.sparkSession
    shortest, longest = lengths_of_use(threshold)
    places = heads.select("id", F.explode(F.arrays_zip("keys", "rests")).alias("at")).select("id", F.col("at.keys").alias("key"), F.col("at.rests").alias("rest"))
    shared = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    placed = scratch.write(places.join(shared, "key"), "placed")  # labels alone in their tree are gone here
    sorted_labels = placed.groupBy("key", "rest").agg(F.count("*").alias("n"), F.min("id").alias("head")).repartition(parallelism(spark), "key").sortWithinPartitions("key", "rest")
    trie = scratch.write(sorted_labels.mapInArrow(_walk(shortest, longest), "key long, length int, prefix long, n long, head long"), "trie")
    lengths = F.array(*[F.struct(F.lit(k).alias("length"), F.shiftright("rest", 16 * (longest - k)).alias("prefix")) for k in range(shortest, longest + 1)])
    node = ["key", "length", "prefix"]
    members = placed.select("id", "key", F.explode(lengths).alias("at")).select("id", "key", "at.length", "at.prefix").join(trie, node)
    members = scratch.write(members, "members")
    own = [F.collect_list(x).alias(y) for x, y in (("key", "keys"), ("length", "lengths"), ("prefix", "prefixes"), ("n", "sizes"))]  # TREES nodes of each length at most
    chosen = members.groupBy("id").agg(*own).mapInArrow(_choose(shortest, longest, threshold), "key long, length int, prefix long").distinct()
    met = scratch.write(members.join(chosen, node), "met")
    stars = met.where((F.col("n") > NODE) & (F.col("id") != F.col("head"))).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    small = met.where(F.col("n") <= NODE).select(F.xxhash64(*node).alias("node"), "id").join(heads.select("id", "sketch"), "id")
    pieces = small.select("node", "id", "sketch").repartition(parallelism(spark), "node").sortWithinPartitions("node", "id").mapInArrow(_agree(threshold), "a long, b long")
    return pieces.unionByName(stars)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, class_id (least doc_id reachable by links), copy_of (least doc_id with the same shingles), n_links long (other documents linked directly), kept (doc_id = class_id)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dup")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = source.where("doc_id is not null").mapInArrow(_sign(*lengths_of_use(threshold)), "doc_id long, k1 long, k2 long, keys array<long>, rests array<long>, sketch binary")
    signed = scratch.write(signed, "signed")
    classes = scratch.write(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.countDistinct("doc_id").alias("weight")), "classes")
    # by doc_id first: copies of one text are spread over tasks
    heads = signed.withColumnRenamed("doc_id", "id").join(classes.drop("weight"), ["id", "k1", "k2"], "left_semi").select("id", "keys", "rests", "sketch")
    groups = scratch.write(components(_proposed(heads, threshold, scratch), scratch, "groups"), "groups")
    scratch.drop("placed", "members", "met", "trie")

    members = groups.join(classes.select("id", "weight"), "id")
    texts = source.join(members, F.col("doc_id") == F.col("id")).select("component", "id", "weight", "text")
    grams = scratch.write(texts.mapInArrow(_grams, "component long, id long, weight long, grams binary"), "grams")
    found = scratch.write(in_tiles(tiles(grams, BLOCK), _similar(threshold), "grams"), "found")
    scratch.drop("grams", "groups")
    linked = scratch.write(components(found.where("b is not null").select("a", "b"), scratch, "classes-of"), "linked")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    per_class = classes.join(linked, "id", "left").join(counts, "id", "left")
    per_class = per_class.select("k1", "k2", "id", F.coalesce("component", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"))
    by_doc = signed.select("doc_id", "k1", "k2").join(per_class, ["k1", "k2"]).groupBy("doc_id").agg(F.min("component").alias("component"), F.min("id").alias("id"), F.max("links").alias("links"))
    out = docs.select(F.col("doc_id").cast("long")).join(by_doc, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", component.alias("class_id"), F.coalesce("id", "doc_id").alias("copy_of"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least doc_id, with the columns it came with, whatever their names."""
    gone = near_duplicates(docs, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("key"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"))
    return rows.join(gone, "key", "left_anti").select("row.*")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
