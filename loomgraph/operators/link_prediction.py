"""Trained link prediction: a logistic regression over features of candidate pairs.

Neighbourhood features come from the graph alone. With ``vectors`` (attributes of the vertices), two more compare what the
pair's neighbourhoods hold: each vertex takes the mean of its own vector and of those of a sample of its neighbours, once and twice over.

A share of the edges is held out by a hash, so that the split is the same wherever it runs. Features come from the graph
without those edges; negatives are pairs two steps apart that no edge links, as many as there are positives, by the order of a hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .algorithms import canonical, neighbour_scores, whole_numbers

FEATURES = ["common", "jaccard", "adamic_adar"]
VECTOR_FEATURES = ["near_once", "near_twice"]
SAMPLE = 10  # neighbours of a vertex that are aggregated, about


def _mean(of: str):
    """The mean of a short list of vectors, value by value."""
    width = F.size(F.col(of)[0])
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(of, F.lit(0.0), lambda total, v: total + v[i]) / F.size(of))


def aggregated(edges: DataFrame, vectors: DataFrame, seed: int = 13) -> DataFrame:
    """id, once, twice: means of a vertex's vector and its sampled neighbours' vectors, and the same again of the means.

    A neighbour is sampled by a hash with probability SAMPLE / degree, so a hub sends and gathers no more than others.
    """
    c = canonical(edges)
    sym = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = sym.groupBy("a").agg(F.count("*").alias("deg"))
    drawn = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1 << 20)) * F.col("deg") < F.lit(SAMPLE << 20)
    sampled = sym.join(degree, "a").where(drawn).select("a", "b")

    def layer(x: DataFrame) -> DataFrame:
        """x: id, v."""
        around = sampled.join(x.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "v").unionByName(x)
        return around.groupBy("id").agg(F.collect_list("v").alias("vs")).select("id", _mean("vs").alias("v"))

    once = layer(vectors.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where("size(v) > 0"))
    return once.select("id", F.col("v").alias("once")).join(layer(once).select("id", F.col("v").alias("twice")), "id")


def features(edges: DataFrame, vectors: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """a, b and features of pairs that share a neighbour and are not linked, or of the given ones that share one. A pair without vectors has 0 for what they compare."""
    near = None if vectors is None else aggregated(edges, vectors)
    if near is not None and pairs is None and whole_numbers(edges.select("src", "dst")):
        return neighbour_scores(edges, near=near)  # where the pairs are made, so that no vector is joined to them
    scored = neighbour_scores(edges, pairs)
    if near is None:
        return scored
    for end in ("a", "b"):
        scored = scored.join(near.select(F.col("id").alias(end), F.col("once").alias(f"once_{end}"), F.col("twice").alias(f"twice_{end}")), end, "left")
    for name, x in zip(VECTOR_FEATURES, ("once", "twice"), strict=True):
        scored = scored.withColumn(name, F.coalesce(F.nanvl(cosine(F.col(f"{x}_a"), F.col(f"{x}_b")), F.lit(0.0)), F.lit(0.0)))
    return scored.drop("once_a", "once_b", "twice_a", "twice_b")


@dataclass
class Trained:
    model: PipelineModel
    auc: float

    def predict(self, edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """a, b, probability of pairs that share a neighbour and are not linked."""
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(features(edges, vectors))
        return scored.select("a", "b", vector_to_array("probability")[1].alias("probability"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        SparkSession.active().createDataFrame([(self.auc,)], "auc double").write.mode("overwrite").json(f"{path}/auc")

    @staticmethod
    def load(path: str) -> "Trained":
        return Trained(PipelineModel.load(f"{path}/model"), SparkSession.active().read.json(f"{path}/auc").first().auc)


def _n_pairs(edges: DataFrame) -> int:
    if not whole_numbers(edges):
        return neighbour_scores(edges).count()
    return neighbour_scores(edges, count=True).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def examples(edges: DataFrame, held_out: float = 0.2, seed: int = 13, vectors: DataFrame | None = None) -> DataFrame:
    """a, b, features and label: 1 for held-out edges that still share a neighbour, 0 for as many pairs without an edge."""
    c = canonical(edges)
    place = lambda: F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(10_000))
    kept, gone = c.where(place() >= int(held_out * 10_000)), c.where(place() < int(held_out * 10_000))
    graph = kept.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    scored = features(graph, vectors)
    positive = features(graph, vectors, gone).withColumn("label", F.lit(1.0))
    n_pos, n_all = positive.count(), _n_pairs(graph)
    share = min(1.0, n_pos / max(1, n_all - n_pos))
    negative = scored.join(c, ["a", "b"], "left_anti").where(F.pmod(F.xxhash64("a", "b", F.lit(seed + 1)), F.lit(1_000_000)) < int(share * 1_000_000)).withColumn("label", F.lit(0.0))
    return positive.unionByName(negative)


def train(edges: DataFrame, held_out: float = 0.2, test_share: float = 0.25, seed: int = 13, vectors: DataFrame | None = None) -> Trained:
    rows = examples(edges, held_out, seed, vectors).persist()  # the fit reads them many times; a lost part is computed again
    test = F.pmod(F.xxhash64("a", "b", F.lit(seed + 2)), F.lit(10_000)) < int(test_share * 10_000)
    names = FEATURES + (VECTOR_FEATURES if vectors is not None else [])
    steps = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), LogisticRegression(maxIter=50, regParam=0.01)]
    model = Pipeline(stages=steps).fit(rows.where(~test))
    out = Trained(model, BinaryClassificationEvaluator().evaluate(model.transform(rows.where(test))))
    rows.unpersist()
    return out
