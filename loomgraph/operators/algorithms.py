"""Graph algorithms as DataFrame plans. Edges are (src, dst); ids may be of any type with an order."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import pairs as block_pairs
from . import triples

HUB = 1000  # neighbours of one vertex that a task joins with the others at a time


def vertex_count(edges: DataFrame) -> DataFrame:
    """Distinct vertices seen in edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.count_distinct("id").alias("n_vertices"))


def edge_count(edges: DataFrame) -> DataFrame:
    """Edges as loaded, repeated ones included."""
    return edges.agg(F.count("*").alias("n_edges"))


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops, as a < b."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    """Distinct in-neighbours of each vertex that has any."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))


def out_degree(edges: DataFrame) -> DataFrame:
    """Distinct out-neighbours of each vertex that has any."""
    return edges.select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree_distribution(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("degree").agg(F.count("*").alias("n_vertices"))


def oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges u -> v from the end of lower (degree, id): no vertex keeps more than about sqrt(2 |E|) of them."""
    c = canonical(edges)
    degree = c.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    ends = c.join(degree.select(F.col("id").alias("a"), F.col("deg").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("deg").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    return ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle of the undirected graph once, as a < b < c."""
    o = oriented(edges)
    wedges = o.alias("x").join(o.alias("y"), (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v"))).select(F.col("x.u").alias("u"), F.col("x.v").alias("p"), F.col("y.v").alias("q"))
    closing = o.select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
    tri = wedges.join(closing, ["p", "q"])
    return tri.select(F.least("u", "p", "q").alias("a"), (F.when(F.col("u") < F.col("p"), F.col("p")).when(F.col("u") > F.col("q"), F.col("q")).otherwise(F.col("u"))).alias("b"), F.greatest("u", "p", "q").alias("c"))


def triangle_count(edges: DataFrame) -> DataFrame:
    """The number of triangles, counted in tasks by colours of the vertices (``triples``); ids that are no numbers are numbered first."""
    pairs = edges.select("src", "dst")
    if not whole_numbers(pairs):
        ids = dense_ids(pairs)
        at = ids.select(F.col("id").alias("src"), F.col("new_id").alias("s")), ids.select(F.col("id").alias("dst"), F.col("new_id").alias("d"))
        pairs = pairs.join(at[0], "src").join(at[1], "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return triples.triangle_count(pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))


def egonets(edges: DataFrame, egos: DataFrame | None = None) -> DataFrame:
    """(ego, u, v): the ego's out-edges, and the edges between its out-neighbours. egos: id, else every vertex."""
    e = edges.select("src", "dst").distinct()
    first = e if egos is None else e.join(egos.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    own = first.select(F.col("src").alias("ego"), F.col("src").alias("u"), F.col("dst").alias("v"))
    shares = F.ceil(F.col("d") / HUB).cast("int")  # a hub's out-edges meet its egos in so many tasks
    degree = e.groupBy(F.col("src").alias("u")).agg(F.count("*").alias("d"))
    edges_of = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).join(degree, "u").withColumn("share", F.pmod(F.xxhash64("v"), shares).cast("int")).drop("d")
    reached = own.select("ego", F.col("v").alias("u")).join(degree, "u").select("ego", "u", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    second = reached.join(edges_of, ["u", "share"]).select("ego", "u", "v")
    between = second.join(own.select("ego", "v"), ["ego", "v"], "left_semi").select("ego", "u", "v")
    return own.unionByName(between).distinct()


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int = 10, checkpoint_every: int = 5) -> DataFrame:
    """id, rank after so many synchronous rounds from 1 / N: (1 - alpha) / N + alpha * (incoming + dangling / N).

    Ranks sum to 1. A vertex's rank goes in equal parts to its distinct out-neighbours; a vertex without any gives its rank to all.
    """
    if not 0 <= alpha < 1 or not 0 < iterations < 100:
        raise ValueError("alpha must lie in [0, 1) and iterations in 1 to 99")
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    vertices = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    base = vertices.join(out.withColumnRenamed("src", "id"), "id", "left")
    n = base.count()
    if not n:
        return vertices.withColumn("rank", F.lit(1.0))
    links = e.join(out, "src").select("src", "dst", "out").repartition("src").persist()
    base = base.persist()
    nothing = base.select("id", F.lit(0.0).alias("part"))  # every vertex is in the sum, so that no join has to bring it back
    ranks = base.select("id", F.lit(1.0 / n).alias("rank"))
    for i in range(iterations):
        parts = links.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("rank") / F.col("out")).alias("part"))
        loose = base.where("out is null").join(ranks, "id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))  # one row
        ranks = parts.unionByName(nothing).groupBy("id").agg(F.sum("part").alias("incoming")).crossJoin(F.broadcast(loose)).select("id", (F.lit((1 - alpha) / n) + alpha * (F.col("incoming") + F.col("loose") / n)).alias("rank"))
        if i + 1 < iterations:  # both the next sum and the next dangling mass read it; a lost executor's part is computed again
            ranks = ranks.checkpoint() if (i + 1) % checkpoint_every == 0 and has_checkpoints(ranks) else ranks.persist()
    return ranks.select("id", "rank")


def has_checkpoints(df: DataFrame) -> bool:
    """Lineage is cut only where the session names a shared folder for it."""
    spark = df.sparkSession
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def rank_distribution(ranks: DataFrame, digits: int = 4) -> DataFrame:
    return ranks.groupBy(F.round("rank", digits).alias("rank")).agg(F.count("*").alias("n_vertices"))


# --------------------------------------------------------------------------- link prediction
def whole_numbers(df: DataFrame) -> bool:
    return all(isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for f in df.schema)


def neighbour_scores(edges: DataFrame, pairs: DataFrame | None = None, near: DataFrame | None = None, count: bool = False) -> DataFrame:
    """a, b, common, jaccard, adamic_adar of pairs that share a neighbour and are not linked (or of the given pairs a < b that share one).

    Ids that are numbers are compared in blocks (``pairs.all_pairs``, which near and count go to), others by joins.
    """
    c = canonical(edges)
    sym = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = sym.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("deg"))
    if pairs is None and whole_numbers(c):
        kind = c.schema["a"].dataType
        found = block_pairs.all_pairs(sym.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), degree, near, count)
        return found if count else found.withColumns({x: F.col(x).cast(kind) for x in ("a", "b")})
    # degrees are joined to the edges, which are fewer than the pairs
    weighted = sym.join(degree.select(F.col("id").alias("b"), F.col("deg").alias("d")), "b").join(degree.select(F.col("id").alias("a"), F.col("deg").alias("da")), "a")
    left = weighted.select(F.col("b").alias("mid"), F.col("a").alias("x"), "d", F.col("da").alias("dx"))
    shares = F.ceil(F.col("d") / HUB).cast("int")  # the pairs of a hub's neighbours are made in so many tasks
    if pairs is not None:
        wanted = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
        # the neighbours of the end of lower degree are looked up at the other, so that a hub's are not paired with each of its pairs
        ends = wanted.join(degree.select(F.col("id").alias("x"), F.col("deg").alias("dx")), "x").join(degree.select(F.col("id").alias("y"), F.col("deg").alias("dy")), "y")
        low = F.struct("dx", "x") < F.struct("dy", "y")
        ends = ends.withColumns({"u": F.when(low, F.col("x")).otherwise(F.col("y")), "v": F.when(low, F.col("y")).otherwise(F.col("x"))})
        shared = ends.join(left.select(F.col("x").alias("u"), "mid", "d"), "u").join(sym.select(F.col("a").alias("v"), F.col("b").alias("mid")), ["v", "mid"])
    else:
        dealt = left.withColumn("share", F.pmod(F.xxhash64("x"), shares).cast("int"))
        others = weighted.select(F.col("b").alias("mid"), F.col("a").alias("y"), F.col("da").alias("dy"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
        shared = dealt.join(others, ["mid", "share"]).where("x < y")
    s = shared.groupBy("x", "y", "dx", "dy").agg(F.count("*").alias("common"), F.sum(1 / F.log("d")).alias("adamic_adar"))
    if pairs is None:
        s = s.join(c.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    return s.select(F.col("x").alias("a"), F.col("y").alias("b"), "common", (F.col("common") / (F.col("dx") + F.col("dy") - F.col("common"))).alias("jaccard"), "adamic_adar")


# --------------------------------------------------------------------------- partitioning
def hash_partition(ids: DataFrame, n: int, key: str = "id") -> DataFrame:
    return ids.withColumn("pid", F.pmod(F.col(key).cast("long"), F.lit(n)).cast("int"))


def partition_statistics(edges: DataFrame, placement: DataFrame) -> DataFrame:
    """pid, n_vertices, n_local edges, n_cut edges that leave or enter, cut_ratio = cut / (local + cut). placement: id, pid."""
    at = placement.select(F.col("id").alias("src"), F.col("pid").alias("p")), placement.select(F.col("id").alias("dst"), F.col("pid").alias("q"))
    placed = edges.select("src", "dst").join(at[0], "src").join(at[1], "dst")
    local = F.col("p") == F.col("q")
    ends = placed.select(F.explode(F.when(local, F.array("p")).otherwise(F.array("p", "q"))).alias("pid"), local.alias("local"))
    by = ends.groupBy("pid").agg(F.count_if("local").alias("n_local"), F.count_if(~F.col("local")).alias("n_cut"))
    n = placement.groupBy("pid").agg(F.count("*").alias("n_vertices"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.join(by, "pid", "left").select("pid", "n_vertices", zero("n_local").alias("n_local"), zero("n_cut").alias("n_cut"), F.when(zero("n_local") + zero("n_cut") > 0, F.col("n_cut") / (F.col("n_local") + F.col("n_cut"))).otherwise(0.0).alias("cut_ratio"))


def label_partition(edges: DataFrame, n: int, rounds: int = 8, slack: float = 0.1) -> DataFrame:
    """id, pid: parts of nearly equal size that cut few edges, by balanced label propagation; a scalable stand-in for multilevel partitioners.

    Vertices start in parts by a hash. In each round a vertex would like the part where most of its neighbours are, if that is
    more than in its own; of those who would move from one part to another, as many go as the other way round, and as many more as
    keep every part below (1 + slack) of its share. Who goes is decided by gain, then by a hash. All steps are joins and aggregations.
    """
    c = canonical(edges)
    sym = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("b").persist()  # every round reads it
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    at = ids.withColumn("pid", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    total = ids.count()
    limit = int((1 + slack) * total / n) + 1
    asked_before: DataFrame | None = None
    for turn in range(rounds):
        at = at.checkpoint() if has_checkpoints(at) else at.persist()
        near = sym.join(at.select(F.col("id").alias("b"), "pid"), "b").groupBy(F.col("a").alias("id"), "pid").agg(F.count("*").alias("k"))
        best = near.groupBy("id").agg(F.max(F.struct("k", (-F.col("pid")).alias("q"))).alias("best")).select("id", F.col("best.k").alias("k"), (-F.col("best.q")).alias("to"))
        own = near.withColumnRenamed("k", "own").join(at, ["id", "pid"]).select("id", "own")
        wish = at.join(best, "id").join(own, "id", "left").select("id", "pid", "to", (F.col("k") - F.coalesce("own", F.lit(0))).alias("gain")).where("to <> pid and gain > 0").persist()  # counted, ranked and moved
        sizes = {r.pid: r.n for r in at.groupBy("pid").agg(F.count("*").alias("n")).collect()}  # n rows
        if asked_before is not None:  # the parts are kept by now
            asked_before.unpersist()
        asked_before = wish
        asked = {(r.pid, r.to): r.n for r in wish.groupBy("pid", "to").agg(F.count("*").alias("n")).collect()}  # n² rows at most
        room = {p: max(0, limit - sizes.get(p, 0)) for p in range(n)}
        quota = []
        for (p, q), k in sorted(asked.items()):
            even = min(k, asked.get((q, p), 0))
            more = min(k - even, room[q])
            room[q] -= more
            if even + more:
                quota.append((p, q, (even + more) / k))
        if not quota:
            break
        shares = edges.sparkSession.createDataFrame(quota, "pid int, to int, share double")
        # the gains at which a share of the wishes is above, by quantile: no task ranks all wishes of a pair
        draw = F.col("gain") + F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 21))
        ranked = wish.withColumn("draw", draw)
        cut = ranked.groupBy("pid", "to").agg(F.percentile_approx("draw", F.array(*[F.lit(x / 64) for x in range(65)]), 10000).alias("marks")).join(F.broadcast(shares), ["pid", "to"])
        cut = cut.select("pid", "to", F.element_at("marks", 65 - F.floor(F.col("share") * 64).cast("int")).alias("least"))
        moves = ranked.join(F.broadcast(cut), ["pid", "to"]).where("draw >= least").select("id", "to")
        at = at.join(moves, "id", "left").select("id", F.coalesce("to", "pid").alias("pid"))
    return at


def stream_partition(edges: DataFrame, n: int, method: str, order: Column | str = "src", vertices: int | None = None) -> DataFrame:
    """id, pid by the one-pass partitioners "fennel" and "ldg", which look at each edge after all before it.

    The rule is sequential: edges are sorted by many tasks and packed, one task handles them in order, and its memory follows the vertices. Use ``hash_partition`` where that is too much.
    """
    totals = edges.agg(F.count("*").alias("m")).first()
    n_vertices = vertices or vertex_count(edges).first()[0]
    m = totals.m

    if method not in ("fennel", "ldg"):
        raise ValueError("the method is fennel or ldg")
    gamma = 1.5
    weight = m * n ** (gamma - 1) / max(1, n_vertices) ** gamma
    limit = max(1.0, n_vertices / n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sorted partition's edges as numbered rows of compressed bytes."""
        for i, batch in enumerate(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "i": pa.array([i], pa.int32()), "edges": [sink.getvalue().to_pybytes()]})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot: dict = {}  # vertex -> its place in the arrays
        where, inside, sizes = array("i"), array("q"), [0] * n  # inside: neighbours of a vertex in each part, n for a vertex

        def slot_of(v) -> int:
            s = slot.setdefault(v, len(where))
            if s == len(where):
                where.append(-1)
                inside.extend([0] * n)
            return s

        def best(v: int) -> int:
            def score(p: int) -> float:
                k = inside[v * n + p]
                if method == "ldg":
                    return max(1, k) * (1 - sizes[p] / limit)
                return k - weight * ((sizes[p] + 1) ** gamma - sizes[p] ** gamma)

            return max(range(n), key=lambda p: (score(p), -p))

        for batch in batches:
            for blob in batch.column(2):
                pairs = pa.ipc.open_stream(blob.as_buffer()).read_all()
                for a, b in zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist(), strict=True):
                    x, y = slot_of(a), slot_of(b)
                    for v, other in ((x, y), (y, x)):
                        if where[v] < 0:
                            if where[other] >= 0:
                                inside[v * n + where[other]] += 1
                            where[v] = best(v)
                            sizes[where[v]] += 1
                        inside[other * n + where[v]] += 1
        ids = list(slot)
        for low in range(0, len(ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + 50_000], arrow_kind), pa.array(where[low : low + 50_000], pa.int32())], ["id", "pid"])

    kind, arrow_kind = edges.schema["src"].dataType.simpleString(), to_arrow_type(edges.schema["src"].dataType)
    edges.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    last = lambda c: F.col(c).asc_nulls_last()
    ordered = edges.select("src", "dst", (F.col(order) if isinstance(order, str) else order).alias("o")).orderBy(last("o"), last("src"), last("dst")).select("src", "dst")
    packed = ordered.mapInArrow(pack, "part int, i int, edges binary")
    return packed.repartition(1).sortWithinPartitions("part", "i").mapInArrow(place, f"id {kind}, pid int")


BUCKETS = 256  # of numbered(), at most; a bucket is sorted by one task, on disk if need be


def numbered(values: DataFrame, key: str, first: int = 0) -> DataFrame:
    """key and id, from first in the order of the distinct keys, without a task that sees them all.

    Keys are dealt to buckets by quantiles of all of them, found once on the driver; buckets are then fixed by value, so that a
    bucket that is computed again holds the same keys. Ranks inside a bucket and the sizes of the buckets before add up.
    """
    spark = values.sparkSession
    n = min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = values.select(key)
    draw = F.xxhash64(key, F.lit(1))
    sample = keys.groupBy(F.pmod(F.xxhash64(key), F.lit(64 * n)).alias("h")).agg(F.min_by(F.col(key), draw).alias("k"))  # 64 keys a bucket, drawn by hashes
    cuts = [r.k for r in sample.orderBy("k").collect()][63::64]
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    tagged = keys.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_start"))  # a row per bucket
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return tagged.withColumn("_rank", rank).join(F.broadcast(starts), "_bucket").select(key, (F.col("_start") + F.col("_rank") - 1 + first).alias("id"))


def dense_ids(edges: DataFrame) -> DataFrame:
    """id, new_id from 0 in the order of the ids."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return numbered(ids.withColumnRenamed("id", "old"), "old").select(F.col("old").alias("id"), F.col("id").alias("new_id"))
