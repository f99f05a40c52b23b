"""Scores of all pairs that share a neighbour, as products of blocks of the adjacency matrix: no wedge or pair is shuffled.

Vertices are dealt to blocks by a hash, and a task compares two blocks in strips, so that its memory is bounded by their edges and a strip.
Neighbours common in both blocks go through matrix products, the others are paired one by one. An edge is sent as often as there are blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEDGES = 1e8  # of a task, about
BLOCKS = 64
STRIP = 1 << 20  # pairs that are held at a time
DENSE = 256  # a neighbour goes through the product if more than one pair in so many shares it


class Side:
    """A block: its vertices, and edges to mid sorted by vertex."""

    def __init__(self, x, mid, d, near):
        order = np.lexsort((mid, x))
        x, self.mid, d = x[order], mid[order], d[order]
        self.ids, self.at, self.deg = np.unique(x, return_inverse=True, return_counts=True)
        self.weight = np.where(d > 1, 1 / np.log(np.maximum(d, 2)), 0.0)
        self.near = None
        if near is not None:
            ids, vectors = near
            width = vectors[0].shape[1] if vectors else 1
            self.near = np.zeros((2, len(self.ids), width))
            for v, both in zip(ids, vectors, strict=True):
                place = np.searchsorted(self.ids, v)
                if place < len(self.ids) and self.ids[place] == v:
                    self.near[:, place] = both

    def matrix(self, columns: np.ndarray, weighted: bool, low: int, high: int) -> np.ndarray:
        out = np.zeros((high - low, len(columns)))
        e = slice(*np.searchsorted(self.at, (low, high)))
        place = np.minimum(np.searchsorted(columns, self.mid[e]), max(len(columns) - 1, 0))
        if len(columns):
            own = columns[place] == self.mid[e]
            out[self.at[e][own] - low, place[own]] = self.weight[e][own] if weighted else 1.0
        return out


def compare(one: Side, two: Side, same: bool) -> Iterator[dict[str, np.ndarray]]:
    """Pairs a < b of the blocks that share a neighbour and are not linked."""
    m1, c1 = np.unique(one.mid, return_counts=True)
    m2, c2 = np.unique(two.mid, return_counts=True)
    mids, i1, i2 = np.intersect1d(m1, m2, assume_unique=True, return_indices=True)
    n = len(two.ids)
    heavy = mids[c1[i1].astype(float) * c2[i2] > len(one.ids) * n / DENSE]
    light = np.setdiff1d(mids, heavy, assume_unique=True)
    right = two.matrix(heavy, False, 0, n).T
    by_mid = np.argsort(two.mid, kind="stable")
    sorted_mid, their = two.mid[by_mid], two.at[by_mid]
    own = np.flatnonzero(np.isin(one.mid, light))
    starts = np.searchsorted(sorted_mid, one.mid[own], "left")
    sizes = np.searchsorted(sorted_mid, one.mid[own], "right") - starts
    linked = np.minimum(np.searchsorted(two.ids, one.mid), n - 1)
    has = np.flatnonzero(two.ids[linked] == one.mid)
    rows = max(1, STRIP // max(1, n))
    for low in range(0, len(one.ids), rows):
        high = min(len(one.ids), low + rows)
        common = one.matrix(heavy, False, low, high) @ right
        adar = one.matrix(heavy, True, low, high) @ right
        begin, end = np.searchsorted(one.at[own], (low, high))
        while begin < end:
            reach = np.cumsum(sizes[begin:end])
            stop = begin + max(1, int(np.searchsorted(reach, STRIP, "right")))
            k = sizes[begin:stop]
            e = np.repeat(np.arange(begin, stop), k)
            y = their[starts[e] + np.arange(len(e)) - np.repeat(np.cumsum(k) - k, k)]
            flat = (one.at[own[e]] - low) * n + y
            common += np.bincount(flat, minlength=common.size).reshape(common.shape)
            adar += np.bincount(flat, one.weight[own[e]], minlength=common.size).reshape(common.shape)
            begin = stop
        drop = has[slice(*np.searchsorted(one.at[has], (low, high)))]
        common[one.at[drop] - low, linked[drop]] = 0
        if same:
            common[one.ids[low:high, None] >= two.ids[None, :]] = 0
        x, y = np.nonzero(common)
        c = common[x, y]
        a, b = one.ids[low + x], two.ids[y]
        out = {"a": np.minimum(a, b), "b": np.maximum(a, b), "common": c.astype(np.int64), "jaccard": c / (one.deg[low + x] + two.deg[y] - c), "adamic_adar": adar[x, y]}
        if one.near is not None:
            for name, layer in (("near_once", 0), ("near_twice", 1)):
                out[name] = np.nan_to_num((one.near[layer, low:high] @ two.near[layer].T)[x, y], nan=0.0)
        yield out


def _run(count: bool, vectors: bool, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, near = None, {}, {}

        def done() -> Iterator[pa.RecordBatch]:
            i, j = divmod(now, blocks)
            if i not in held or j not in held:
                return
            sides = {k: Side(*(np.concatenate(z) for z in zip(*held[k], strict=True)), near.get(k, ([], [])) if vectors else None) for k in {i, j}}
            n = 0
            for out in compare(sides[i], sides[j], i == j):
                n += len(out["a"])
                if not count:
                    for low in range(0, len(out["a"]), 50_000):
                        yield pa.RecordBatch.from_pydict({k: v[low : low + 50_000] for k, v in out.items()})
            if count:
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

        for batch in batches:
            for task, block, x, mid, d, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != now:
                    if now is not None:
                        yield from done()
                    now, held, near = task, {}, {}
                if v is None:
                    held.setdefault(block, []).append(tuple(np.frombuffer(z, np.int64) for z in (x, mid, d)))
                else:
                    ids, rows = near.setdefault(block, ([], []))
                    ids.append(int(np.frombuffer(x, np.int64)[0]))
                    rows.append(np.frombuffer(v, np.float64).reshape(2, -1))
        if now is not None:
            yield from done()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a block as one row of bytes for each batch."""
    for batch in batches:
        block, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for k in np.unique(block).tolist():
            own = block == k
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32())} | {n: [z[own].astype(np.int64).tobytes()] for n, z in zip(("x", "mid", "d"), rest, strict=True)} | {"v": pa.array([None], pa.binary())})


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"block": [], "x": [], "mid": [], "d": [], "v": []}
        for block, x, *both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with np.errstate(all="ignore"):
                units = [z / np.sqrt((z * z).sum()) for z in (np.array(v or [np.nan], np.float64) for v in both)]
            for k, v in (("block", block), ("x", np.int64(x).tobytes()), ("mid", b""), ("d", b""), ("v", np.concatenate(units).tobytes())):
                rows[k].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "block" else pa.binary()) for k, v in rows.items()})


PACKED = "block int, x binary, mid binary, d binary, v binary"


def all_pairs(sym: DataFrame, degree: DataFrame, near: DataFrame | None = None, count: bool = False) -> DataFrame:
    """a, b, common, jaccard, adamic_adar, and with near (id, once, twice) the cosines of both; or n, counts of pairs to be summed.

    sym: distinct (a, b) of bigint in both orientations; degree: id, deg.
    """
    spark = sym.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    wedges = degree.agg(F.sum(F.col("deg").cast("double") * F.col("deg"))).first()[0] or 0.0
    blocks = min(BLOCKS, max(4, math.ceil(math.sqrt(wedges / WEDGES))))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(blocks)).cast("int").alias("block")
    edges = sym.join(degree.select(F.col("id").alias("b"), "deg"), "b").select(block("a"), "a", "b", "deg").mapInArrow(_pack, PACKED)
    if near is not None:
        edges = edges.unionByName(near.select(block("id"), F.col("id").cast("long"), "once", "twice").mapInArrow(_unit, PACKED))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = edges.select("*", other).select((F.least("block", "other") * blocks + F.greatest("block", "other")).alias("task"), "block", "x", "mid", "d", "v")
    names = ["a long", "b long", "common long", "jaccard double", "adamic_adar double"] + (["near_once double", "near_twice double"] if near is not None else [])
    return sent.repartition(blocks * (blocks + 1) // 2, "task").sortWithinPartitions("task").mapInArrow(_run(count, near is not None, blocks), "n long" if count else ", ".join(names))
