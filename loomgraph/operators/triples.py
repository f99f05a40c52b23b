"""Triangle counts by colours: no wedge, list or neighbour becomes a row of a shuffle.

Vertices take one of COLOURS by a hash. A task for each multiset of three colours gets the edges between them, so an edge is sent
COLOURS times, packed, and every triangle lies whole in the task of its ends' colours. A task holds about 6 / COLOURS² of the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLOURS = 12
CHUNK = 1 << 20  # edges that are packed together
WEDGES = 1 << 21  # that are looked up at a time


def colour(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(COLOURS)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on, which compresses well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _packed(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    p, q = colour(a), colour(b)
    kind = np.minimum(p, q) * COLOURS + np.maximum(p, q)
    order = np.lexsort((b, a, kind))
    a, b, kind = a[order], b[order], kind[order]
    kinds, starts = np.unique(kind, return_index=True)
    for k, low, high in zip(kinds.tolist(), starts, [*starts[1:], len(kind)], strict=True):
        yield pa.RecordBatch.from_pydict({"p": pa.array([k // COLOURS], pa.int32()), "q": pa.array([k % COLOURS], pa.int32()), "a": [_planes(a[low:high])], "b": [_planes(b[low:high])]})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= CHUNK:
            yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def count(a: np.ndarray, b: np.ndarray, key: tuple[int, int, int]) -> int:
    """Triangles of the edges whose ends have the colours of key; edges may repeat."""
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    n = len(ids)
    edges = np.unique(ends[: len(a)] * n + ends[len(a) :])
    u, v = edges // n, edges % n
    by_degree = np.argsort(np.bincount(np.concatenate((u, v)), minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_degree] = np.arange(n)
    u, v = rank[u], rank[v]
    edges = np.sort(np.minimum(u, v) * n + np.maximum(u, v))  # from the end of lower degree, so that hubs start few wedges
    u, v = edges // n, edges % n
    after = np.searchsorted(u, u, "right") - np.arange(len(u)) - 1  # later neighbours of the same vertex
    inner = colour(ids[by_degree]) == key[1] if key[0] != key[2] and key[1] in (key[0], key[2]) else None
    bits = min(27, max(10, int(8 * len(u)).bit_length()))
    factor, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    seen = np.zeros(1 << bits, bool)
    seen[(edges.astype(np.uint64) * factor) >> shift] = True
    ends, total, low = np.cumsum(after), 0, 0
    while low < len(u):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + WEDGES, "right")))
        first = np.repeat(np.arange(low, high), after[low:high])
        place = np.arange(len(first)) - np.repeat(ends[low:high] - after[low:high] - (ends[low - 1] if low else 0), after[low:high])
        second = first + 1 + place
        wanted = v[first] * n + v[second]
        near = np.flatnonzero(seen[(wanted.astype(np.uint64) * factor) >> shift])
        wanted = wanted[near]
        closed = edges[np.minimum(np.searchsorted(edges, wanted), len(edges) - 1)] == wanted
        if inner is not None:  # triangles inside the colour that comes twice belong to another task
            f = first[near]
            closed &= ~(inner[u[f]] & inner[v[f]] & inner[v[second[near]]])
        total += int(closed.sum())
        low = high
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; one task's edges are held at a time."""
    now, held = None, ([], [])

    def done() -> pa.RecordBatch:
        key = (now // COLOURS**2, now // COLOURS % COLOURS, now % COLOURS)
        return pa.RecordBatch.from_pydict({"n": pa.array([count(np.concatenate(held[0]), np.concatenate(held[1]), key)], pa.int64())})

    for batch in batches:
        for task, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if task != now:
                if now is not None:
                    yield done()
                now, held = task, ([], [])
            held[0].append(_values(a.as_buffer()))
            held[1].append(_values(b.as_buffer()))
    if now is not None:
        yield done()


def triangle_count(pairs: DataFrame) -> DataFrame:
    """n_triangles of undirected edges (src, dst) of bigint; repeated edges and loops do not count."""
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    packed = pairs.where("src <> dst").mapInArrow(_pack, "p int, q int, a binary, b binary")
    key = F.array_sort(F.array("p", "q", "r"))
    sent = packed.select("a", "b", "p", "q", F.explode(F.sequence(F.lit(0), F.lit(COLOURS - 1))).alias("r")).select(((key[0] * COLOURS + key[1]) * COLOURS + key[2]).alias("task"), "a", "b")
    tasks = min(COLOURS * (COLOURS + 1) * (COLOURS + 2) // 6, 8 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = sent.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(_count, "n long")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_triangles"))
