"""Graph views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NodeTable, RelTable, TableGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commerce(spark: SparkSession, sf_dir: str) -> TableGraph:
    t = {x: table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nodes = {"Customer": ("customer", "c_custkey"), "Order": ("orders", "o_orderkey"), "Part": ("part", "p_partkey"), "Supplier": ("supplier", "s_suppkey"), "Nation": ("nation", "n_nationkey"), "Region": ("region", "r_regionkey")}
    supplies = t["lineitem"].select("l_partkey", "l_suppkey").distinct()
    pair = lambda *c: F.concat_ws("-", *c)
    rels = {
        "PLACED": [RelTable(t["orders"].select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", "Customer", "Order", F.col("o_orderkey"))],
        "CONTAINS": [RelTable(t["lineitem"], "l_orderkey", "l_partkey", "Order", "Part", pair("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"))],
        "SUPPLIED_BY": [RelTable(supplies, "l_partkey", "l_suppkey", "Part", "Supplier", pair("l_partkey", "l_suppkey"))],
        "IN_NATION": [RelTable(t["customer"].select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", "Customer", "Nation", F.col("c_custkey")), RelTable(t["supplier"].select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", "Supplier", "Nation", F.col("s_suppkey"))],
        "IN_REGION": [RelTable(t["nation"].select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey", "Nation", "Region", F.col("n_nationkey"))],
    }
    return TableGraph({label: NodeTable(t[name], key) for label, (name, key) in nodes.items()}, rels, True, "commerce")


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges (src < dst) between parts that share an order."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).repartition("o").distinct()  # one shuffle serves the distinct rows and the join
    return items.alias("x").join(items.alias("y"), (F.col("x.o") == F.col("y.o")) & (F.col("x.p") < F.col("y.p"))).select(F.col("x.p").alias("src"), F.col("y.p").alias("dst")).distinct()


def copurchase_around(spark: SparkSession, sf_dir: str, ids: list) -> DataFrame:
    """The edges of copurchase() with an end in ids, by the orders of these parts only."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    own = items.where(F.col("p").isin(ids)).distinct().withColumnRenamed("p", "q")
    pairs = items.join(F.broadcast(own), "o").where("p <> q")
    return pairs.select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).distinct()


def copurchase_graph(spark: SparkSession, sf_dir: str) -> TableGraph:
    e = copurchase(spark, sf_dir)
    return TableGraph({"Part": NodeTable(table(spark, sf_dir, "part"), "p_partkey")}, {"WITH": [RelTable(e, "src", "dst", "Part", "Part", F.concat_ws("-", "src", "dst"))]}, False, "copurchase")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id -> props.k, with the event's type and time."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").alias("src"), k.alias("dst"), F.col("event_type").alias("type"), "ts").where("src is not null and dst is not null")
