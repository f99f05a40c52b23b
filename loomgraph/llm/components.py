"""Connected components, and pairwise work inside components in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parallelism


SALTS = 16


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components under the links a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
    return root


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links: a, b (long). Returns id, component for every linked id; component is the least id reachable.

    Large-star and small-star rounds: each makes the stars flatter, and only least neighbours are aggregated, so that
    a hub's neighbours never meet in one task. Each round is written to the shared folder.
    """
    spark = links.sparkSession
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    n, before = 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        n += 1
        edges = scratch.write(small, f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def tiles(members: DataFrame, block: int) -> DataFrame:
    """members: component, id, and more. Adds i, j: each pair of a component's members meets in exactly one tile (component, i, j) or, within a block, in (component, i, i).

    A component is dealt by hash into blocks of about ``block`` members; side is 0 for a row's part in block i, 1 in j.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("blocks > 1")
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # the members of a large component meet it in SALTS tasks
    rows = members.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int")).join(sizes, ["component", "salt"], "left").drop("salt")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")).drop("own", "other", "blocks")


def in_tiles(rows: DataFrame, compare, *extra: str) -> DataFrame:
    """Runs compare on each tile's rows and returns its links. A tile holds two blocks at most; tiles stream through a task one after another.

    compare(table) -> boolean matrix of all rows of the tile, of which only pairs of different sides count if i < j.
    Returns a, b, n: with b null, id a has n more links (by the weights of its partners); else a and b are linked, as much as the components need.
    """
    keys = ["component", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = table.column("id").to_numpy()
            _, first = np.unique(ids, return_index=True)  # a row that is there twice counts once
            table = table.take(np.sort(first))
            if len(table) < 2:
                return
            ids, weight, side = (table.column(c).to_numpy() for c in ("id", "weight", "side"))
            linked = compare(table)
            np.fill_diagonal(linked, False)
            if table.column("i")[0] != table.column("j")[0]:
                linked &= side[:, None] != side[None, :]
            if not linked.any():
                return
            count = linked @ weight
            a, b = np.nonzero(np.triu(linked))
            root = local_roots(len(ids), a, b)
            has, moved = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[has], ids[moved]])), pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(ids[root[moved]], pa.int64())]), pa.concat_arrays([pa.array(count[has], pa.int64()), pa.nulls(len(moved), pa.int64())])],
                names=["a", "b", "n"],
            )

        def cut(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            c, i, j = (table.column(k).to_numpy() for k in keys)
            at = np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            ends = [*at.tolist(), *([len(c)] if last else [])]
            begin = 0
            for end in ends:
                yield from one(table.slice(begin, end - begin))
                begin = end
            held[:] = table.slice(begin).to_batches() if begin < len(c) else []

        for b in batches:
            held.append(b)
            if b.column("component")[0] != b.column("component")[len(b) - 1] or sum(map(len, held)) > 4096:
                yield from cut(pa.Table.from_batches(held), last=False)
        if held:
            yield from cut(pa.Table.from_batches(held), last=True)

    n = parallelism(rows.sparkSession)
    return rows.select(*keys, "id", "weight", "side", *extra).repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")
