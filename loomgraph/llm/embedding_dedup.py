"""Near-duplicate embeddings by sorted projection passes, and an exact check of what they may have missed.

1. Each pass orders the vectors of a label by the concatenated signs of random projections and compares each vector with
   the next ``REACH`` in that order, by exact cosine. Verified pairs of all passes are united to groups, and all pairs inside a
   group are compared, in tiles: these are the links of the passes.
2. The exact check looks for links between different groups, or vectors in none. About one representative of a group or lone
   vector in ``CELL`` is a pivot. A vector is at home in the cell of its nearest pivot and a guest in
   each lower cell whose border it could reach across with a link: for a linked pair at home in two cells, the one of the
   higher cell is a guest of the other (a link is at most sqrt(2 - 2 threshold) long, and no link is longer than the way
   to the border). So every pair that may be linked meets in exactly one cell, and is compared there in tiles unless step 1 did.

Links of both steps count and make the components, so that both are complete. Vectors that are equal value by value
are compared once, as a class with a weight.

Vectors that are null, empty, zero, or hold null or non-finite values, and rows without label, link with nothing. Vectors of
different length don't link; long ones are read whole. Vectors are scaled by powers of two before they are multiplied, which
rounds nothing and keeps very small and very large ones exact. Rows with a null vec_id take no part (no component). Rows with equal
vec_id are one vector, and each returns what holds for it; if their values or labels differ, the row of the least (label, digest) stands for all.
A link at exactly the threshold counts. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, parallelism
from .components import components, in_tiles, local_roots, tiles

THRESHOLD = 0.98
PASSES, REACH = 12, 24
BITS = 63  # signs in a sort key
CELL, PIVOTS = 4096, 2048  # representatives for a pivot; pivots of a label, about, at most
ALL_PIVOTS = 65_536  # of all labels, about, at most
BLOCK = 1024  # vectors on either side of a tile


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for x in column:
        values = None if not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False)
        ok = values is not None and len(values) and values.any() and np.isfinite(values).all()
        out.append(np.ascontiguousarray(values + 0.0, np.float64) if ok else None)  # -0.0 is 0.0
    return out


@functools.lru_cache(64)
def _planes(turn: int, size: int) -> np.ndarray:
    return np.random.default_rng([977, turn, size]).standard_normal((size, BITS))


def _digest(v: np.ndarray, label: int) -> tuple[int, int]:
    words = v.view(np.uint64)
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    seed = np.uint64(label % 2**64)
    return tuple(int(mix64(np.bitwise_xor.reduce(mix64(words + place * np.uint64(k)))[None] ^ mix64(seed[None] + np.uint64(len(words))))[0].astype(np.int64)) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, labels = b.column("vec_id").to_pylist(), b.column("label").to_pylist()
        rows = [(i, None, None, label, None) if v is None or label is None or i is None else (i, *_digest(v, label), label, v.tobytes()) for i, label, v in zip(ids, labels, _vectors(b.column("embedding")), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["vec_id", "k1", "k2", "label", "vec"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pass of each vector: its place in that pass's order."""
    for b in batches:
        vecs = [np.frombuffer(x, np.float64) for x in b.column("vec").to_pylist()]
        sizes = np.array([len(v) for v in vecs])
        for turn in range(PASSES):
            key = np.zeros(len(vecs), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                signs = np.stack([vecs[i] for i in at]) @ _planes(turn, int(size)) > 0
                key[at] = signs.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vecs), turn, np.int32)), b.column("label"), pa.array(sizes.astype(np.int32)), pa.array(key), b.column("id"), b.column("vec")], names=["turn", "label", "size", "key", "id", "vec"])


def _neighbours(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([last, t]).combine_chunks() if last is not None else t
            last = t.slice(max(0, len(t) - REACH))
            turn, label, size, ids = (t.column(c).to_numpy() for c in ("turn", "label", "size", "id"))
            raw = t.column("vec").to_pylist()
            found_a, found_b = [], []
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                v = _scaled([raw[i] for i in at])
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                for d in range(1, min(REACH, len(at) - 1) + 1):
                    x, y = at[:-d], at[d:]
                    hit = (turn[x] == turn[y]) & (label[x] == label[y]) & (np.einsum("ij,ij->i", v[:-d], v[d:]) / (norm[:-d] * norm[d:]) >= threshold)
                    found_a.append(x[hit])
                    found_b.append(y[hit])
            if not found_a:
                continue
            root = local_roots(len(ids), np.concatenate(found_a), np.concatenate(found_b))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

    return run


def _scaled(raw: list[bytes]) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish."""
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def _units(raw: list[bytes]) -> np.ndarray:
    v = _scaled(raw)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _place(pivots: dict[tuple[int, int], np.ndarray], threshold: float):
    """A row for each vector at home, and one for each cell that it is a guest of."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    apart = {k: np.sqrt(np.maximum(0.0, 2 - 2 * p @ p.T)) for k, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), BLOCK):
                b = whole.slice(begin, BLOCK)
                raw = b.column("vec").to_pylist()
                label, size = b.column("label").to_numpy(), np.fromiter(map(len, raw), np.int64, len(raw)) // 8
                row, cell, home = [np.arange(len(b))], [np.zeros(len(b), np.int64)], [np.ones(len(b), bool)]
                for key in {*zip(label.tolist(), size.tolist(), strict=True)} & pivots.keys():
                    at = np.flatnonzero((label == key[0]) & (size == key[1]))
                    near = _units([raw[i] for i in at]) @ pivots[key].T
                    own = near.argmax(1)
                    cell[0][at] = own
                    gap = near[np.arange(len(at)), own][:, None] - near
                    i, c = np.nonzero((gap <= reach * apart[key][own] + 1e-6) & (np.arange(near.shape[1]) < own[:, None]))
                    row.append(at[i])
                    cell.append(c)
                    home.append(np.zeros(len(i), bool))
                r, c, h = (np.concatenate(x) for x in (row, cell, home))
                for k in range(0, len(r), 8 * BLOCK):
                    at = pa.array(r[k : k + 8 * BLOCK])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("label").take(at), pa.array(size).take(at), pa.array(c[k : k + 8 * BLOCK]), pa.array(h[k : k + 8 * BLOCK]), *(b.column(x).take(at) for x in ("id", "group", "weight", "vec"))],
                        names=["label", "size", "cell", "home", "id", "group", "weight", "vec"],
                    )

    return run


def _pivots(heads: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Unit vectors of each label and length that has two pivots or more."""
    keys = ["label", "size"]
    alone = heads.where(F.col("id") == F.col("group")).withColumn("size", F.expr("length(vec) div 8"))
    sizes = alone.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    step = F.greatest(F.lit(CELL), F.ceil(F.col("n") / PIVOTS))
    wanted = sizes.agg(F.coalesce(F.sum(F.col("n") / step), F.lit(0.0))).first()[0]
    step = step * max(1, math.ceil(wanted / ALL_PIVOTS))  # many large labels get larger cells, so that what is sent to the tasks stays bounded
    chosen: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for r in alone.join(sizes, keys).where(F.pmod(F.xxhash64("id"), step) == 0).select(*keys, "id", "vec").toLocalIterator():
        chosen.setdefault((r.label, r.size), []).append((r.id, bytes(r.vec)))
    return {k: _units([v for _, v in sorted(x)]) for k, x in chosen.items() if len(x) > 1}


def _meetings(placed: DataFrame) -> DataFrame:
    """Tiles in which each vector at home meets the others at home, and the guests, of its cell once."""
    keys = ["label", "size", "cell"]
    blocks = [F.ceil(F.count_if(x) / F.lit(BLOCK)).cast("int").alias(name) for x, name in ((F.col("home"), "homes"), (~F.col("home"), "guests"))]
    cells = placed.groupBy(*keys).agg(F.min(F.when(F.col("home"), F.col("id"))).alias("component"), *blocks).where("component is not null")
    rows = placed.join(cells, keys)
    home = tiles(rows.where("home").select("component", "id", "group", "weight", "vec"), BLOCK)
    across = rows.where("guests > 0").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int"))
    across = across.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("guests")).otherwise(F.col("homes")) - 1)))
    i, j = (F.when(F.col("home"), F.col(x)).otherwise(F.col(y)) for x, y in (("own", "other"), ("other", "own")))
    across = across.select("component", "id", "group", "weight", "vec", i.alias("i"), (-1 - j).alias("j"), (~F.col("home")).cast("int").alias("side"))
    return home.select(*across.columns).unionByName(across)


def _apart(close):
    """Of the links, those between different groups."""

    def compare(table: pa.Table) -> np.ndarray:
        group = table.column("group").to_numpy()
        return close(table) & (group[:, None] != group[None, :])

    return compare


def _close(threshold: float):
    def compare(table: pa.Table) -> np.ndarray:
        v = _scaled(table.column("vec").to_pylist())
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        if table.column("i")[0] == table.column("j")[0]:
            return v @ v.T / (norm[:, None] * norm[None, :]) >= threshold
        side = table.column("side").to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = v[x] @ v[y].T / (norm[x][:, None] * norm[y][None, :]) >= threshold
        out = np.zeros((len(v), len(v)), bool)
        out[np.ix_(x, y)], out[np.ix_(y, x)] = hit, hit.T
        return out

    return compare


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept; vectors: vec_id, embedding, label."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embeddings")
    rows = scratch.write(vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long")).mapInArrow(_classes, "vec_id long, k1 long, k2 long, label long, vec binary"), "vectors")
    of_id = rows.where("k1 is not null").groupBy("vec_id").agg(F.min(F.struct("label", "k1", "k2")).alias("of")).select("vec_id", "of.k1", "of.k2")
    of_id = scratch.write(of_id, "of-id")
    classes = scratch.write(of_id.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "classes")
    # by id first: copies of one vector are spread over tasks
    heads = rows.withColumnRenamed("vec_id", "id").join(classes, ["id", "k1", "k2"]).dropDuplicates(["id"]).select("id", "weight", "label", "vec")
    heads = scratch.write(heads, "heads")
    order = ["turn", "label", "size", "key", "id"]
    passes = heads.mapInArrow(_keys, "turn int, label long, size int, key long, id long, vec binary")
    pairs = passes.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).mapInArrow(_neighbours(threshold), "a long, b long")
    dense = scratch.write(components(pairs, scratch, "dense-links"), "dense")
    grouped = heads.join(dense, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    grouped = scratch.write(grouped, "grouped")
    inside = heads.join(dense, "id").select("component", "id", "weight", "vec")
    inside = scratch.write(in_tiles(tiles(inside, BLOCK), _close(threshold), "vec"), "inside")
    placed = scratch.write(grouped.mapInArrow(_place(_pivots(grouped), threshold), "label long, size long, cell long, home boolean, id long, group long, weight long, vec binary"), "placed")
    between = scratch.write(in_tiles(_meetings(placed), _apart(_close(threshold)), "vec", "group"), "between")
    links = inside.unionByName(between)
    scratch.drop("placed", "grouped")
    found = scratch.write(components(links.where("b is not null").select("a", "b"), scratch, "components-of"), "components")
    counts = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    per_class = classes.join(found, "id", "left").join(counts.withColumnRenamed("a", "id"), "id", "left")
    per_class = per_class.select("k1", "k2", F.coalesce("component", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"))
    found = of_id.join(per_class, ["k1", "k2"]).drop("k1", "k2")
    out = rows.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return near_embeddings(table(spark, sf_dir, "embeddings"))
