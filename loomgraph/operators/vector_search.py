"""Exact nearest neighbours and semantic beam search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, l2_squared

SEEDS, HOPS, WIDTH = 5, 3, 10


def _literal(vector: list[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k vectors of least squared L2 distance; ties go to the smaller key. Each task keeps k rows (TakeOrdered)."""
    return vectors.select(key, l2_squared(F.col(column), _literal(query)).alias("distance")).orderBy("distance", key).limit(k)


def most_similar(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    return vectors.select(key, cosine(F.col(column), _literal(query)).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def beam_search(vectors: DataFrame, edges: DataFrame | Callable[[list], DataFrame], query: list[float], type_vectors: DataFrame | None = None, *, seeds: int = SEEDS, hops: int = HOPS, width: int = WIDTH) -> DataFrame:
    """path_nodes, path_rels, score: the best walks from the seeds.

    vectors: id, embedding. edges: eid, src, dst, type, or a function that gives those at some ids at least. type_vectors: type, embedding. Seeds are nearest by L2 and score
    their cosine with the query; a hop adds the cosine of the node it reaches and of its relationship's type. The
    relationship a walk came by is not taken back at once. ``width`` walks are kept at each hop, over the whole graph.
    """
    q = _literal(query)
    known = vectors.select("id", "embedding")

    def around(ids: list) -> DataFrame:
        """Edges from ids in both orientations; as literals they reach the scans."""
        e = (edges(ids) if callable(edges) else edges).select("eid", "src", "dst", "type")
        turned = e.where(F.col("dst").isin(ids)).select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "type").where("src <> dst")
        both = e.where(F.col("src").isin(ids)).unionByName(turned)
        if type_vectors is None:
            return both.withColumn("type_score", F.lit(0.0))
        types = type_vectors.select("type", cosine(F.col("embedding"), q).alias("type_score"))
        return both.join(types, "type", "left").withColumn("type_score", F.coalesce("type_score", F.lit(0.0)))

    start = known.select("id", l2_squared(F.col("embedding"), q).alias("d"), cosine(F.col("embedding"), q).alias("score")).orderBy("d", "id").limit(seeds)
    none = F.array().cast("array<string>")
    frontier = start.select(F.array(F.col("id")).alias("path_nodes"), none.alias("path_rels"), "score", F.col("id").alias("at"), F.lit(None).cast("string").alias("came"))
    for _ in range(hops):
        beam = frontier.collect()  # ``width`` or ``seeds`` rows at most
        frontier = frontier.sparkSession.createDataFrame(beam, frontier.schema)
        step = around(sorted({r["at"] for r in beam})).select(F.col("src").alias("at"), "dst", F.col("eid").cast("string").alias("eid"), "type_score")
        # a beam has at most ``width`` (or ``seeds``) rows, so it is sent to the edges
        moved = step.join(F.broadcast(frontier), "at").where("came is null or came <> eid")
        reached = known.select(F.col("id").alias("dst"), cosine(F.col("embedding"), q).alias("node_score"))
        moved = moved.join(reached, "dst", "left")
        frontier = moved.select(
            F.array_append("path_nodes", F.col("dst")).alias("path_nodes"), F.array_append("path_rels", F.col("eid")).alias("path_rels"),
            (F.col("score") + F.coalesce("node_score", F.lit(0.0)) + F.col("type_score")).alias("score"), F.col("dst").alias("at"), F.col("eid").alias("came"),
        ).orderBy(F.desc("score"), "path_rels", "path_nodes").limit(width)
    return frontier.select("path_nodes", "path_rels", "score")
