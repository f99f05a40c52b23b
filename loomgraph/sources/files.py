"""Readers and writers of graph files; every reader takes any path that Spark opens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MapGraph
from ..operators.algorithms import numbered

END = T.StructType([T.StructField("id", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])
EDGE_RECORD = T.StructType([T.StructField("source", END), T.StructField("destination", END), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])


def edge_list(spark: SparkSession, path: str, directed: bool = True) -> DataFrame:
    """src, dst (bigint) from lines split at white space or a comma; other lines are left out. Undirected: both orientations."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    e = spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].try_cast("long").alias("src"), parts[1].try_cast("long").alias("dst")).where("src is not null and dst is not null")
    return e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def text_attributes(spark: SparkSession, path: str, dtype: str | None = None) -> DataFrame:
    """vertex_id, features from lines of an id and values. dtype: int8, int16, int32 or float, else the narrowest that holds all values."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].try_cast("long").alias("vertex_id"), F.slice(parts, F.lit(2), F.size(parts) - 1).alias("v")).where("vertex_id is not null")
    kinds = {"int8": "tinyint", "int16": "smallint", "int32": "int", "float": "float"}
    if dtype is None:
        values = rows.select(F.explode("v").alias("x"))
        low, high, real = values.agg(F.min(F.col("x").try_cast("double")), F.max(F.col("x").try_cast("double")), F.coalesce(F.bool_or(F.col("x").contains(".")), F.lit(False))).first()
        dtype = "float" if real or low is None else "int8" if -125 <= low and high <= 127 else "int16" if -32768 <= low and high <= 32767 else "int32"
    if dtype not in kinds:
        raise ValueError("the type is int8, int16, int32 or float")
    return rows.select("vertex_id", F.transform("v", lambda x: x.try_cast(kinds[dtype])).alias("features"))


def json_attributes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def xml_attributes(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).format("xml").option("rowTag", row_tag).load(path)


def property_graph(records: DataFrame, partitions: int = 2, directed: bool = True, name: str = "graph") -> MapGraph:
    """A graph from edge records (EDGE_RECORD). A node's properties are those of its first mention by value; pid is id mod partitions; relationships seen twice by their property id count once."""
    ends = records.select(F.explode(F.array("source", "destination")).alias("n")).select(F.col("n.id").alias("id"), F.col("n.properties").alias("props")).where("id is not null")
    nodes = ends.groupBy("id").agg(F.max(F.to_json("props")).alias("p")).select("id", F.from_json("p", T.MapType(T.StringType(), T.StringType())).alias("props"))
    vertices = nodes.select("id", F.col("props")["label"].alias("label"), "props", F.coalesce(F.pmod(F.col("id").try_cast("long"), F.lit(partitions)), F.pmod(F.xxhash64("id"), F.lit(partitions))).cast("int").alias("pid"))
    e = records.where("source.id is not null and destination.id is not null").select(F.col("source.id").alias("src"), F.col("destination.id").alias("dst"), F.col("properties").alias("props"))
    own = F.col("props")["id"]
    e = e.select(F.coalesce(own, F.concat_ws(":", "src", "dst", F.xxhash64(F.to_json("props")).cast("string"))).alias("eid"), "src", "dst", F.col("props")["type"].alias("type"), "props")
    return MapGraph(vertices, e.dropDuplicates(["eid"]), directed, name)


def property_graph_json(spark: SparkSession, path: str, partitions: int = 2, directed: bool = True) -> MapGraph:
    """Lines of one edge record each; lines that are no record are left out."""
    return property_graph(spark.read.schema(EDGE_RECORD).json(path), partitions, directed)


def citation_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, attributes) of papers: id, references, and fields of study with weights; a field counts from above 0.5.

    Papers without references start no edge. Attributes are one 0 or 1 per field, in the order of the fields' names.
    """
    papers = spark.read.schema("id string, references array<string>, fos array<struct<name:string,w:double>>").json(path).where("id is not null")
    edges = papers.select(F.col("id").alias("src"), F.explode("references").alias("dst"))
    strong = papers.select("id", F.transform(F.filter(F.coalesce("fos", F.array().cast("array<struct<name:string,w:double>>")), lambda x: x["w"] > 0.5), lambda x: x["name"]).alias("fields"))
    names = [r.f for r in strong.select(F.explode("fields").alias("f")).distinct().orderBy("f").collect()]  # the vocabulary of fields
    return edges, strong.select(F.col("id").alias("vertex_id"), F.array(*[F.array_contains("fields", n).cast("tinyint") for n in names]).alias("features"))


def rdf_xml(spark: SparkSession, path: str, row_tag: str = "article") -> tuple[DataFrame, DataFrame]:
    """(edges, authors) of articles: an edge per pair of authors in their order, with the article's attributes and both names; authors numbered from 1 by name."""
    fields = ["title", "type", "journal", "web", "month", "year", "volume"]
    schema = T.StructType([T.StructField("author", T.ArrayType(T.StringType())), *[T.StructField(c, T.StringType()) for c in fields]])
    articles = spark.read.schema(schema).format("xml").option("rowTag", row_tag).load(path).where(F.size("author") > 0)
    articles = articles.withColumn("article", F.xxhash64(F.to_json(F.struct("author", *fields)))).dropDuplicates(["article"])  # an article that is there twice counts once
    authors = articles.select(F.explode("author").alias("name")).distinct()
    authors = numbered(authors, "name", 1)
    placed = articles.select("article", *fields, F.posexplode("author").alias("pos", "name")).join(authors, "name")
    # an article's authors are brought together once and paired in place, with their names, so that pairs are neither joined nor shuffled
    whole = placed.groupBy("article", *fields).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "name"))).alias("all"))
    first = whole.select("article", *fields, "all", F.explode("all").alias("x"))
    pairs = first.select("article", *fields, "x", F.explode(F.filter("all", lambda y: y["pos"] > F.col("x.pos"))).alias("y"))
    return pairs.select(F.col("x.id").alias("src"), F.col("y.id").alias("dst"), "article", *fields, F.col("x.name").alias("src_name"), F.col("y.name").alias("dst_name")), authors


def rdf_triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges: src, dst, predicate; nodes; predicates), the last two numbered from 0 by name. A tab follows the subject, white space the predicate."""
    m = r"^([^\t]+)\t(\S+)\s+(.+)$"
    t = spark.read.text(path).where(F.col("value").rlike(m)).select(F.regexp_extract("value", m, 1).alias("s"), F.regexp_extract("value", m, 2).alias("p"), F.trim(F.regexp_extract("value", m, 3)).alias("o"))
    nodes = numbered(t.select(F.explode(F.array("s", "o")).alias("name")).distinct(), "name")
    predicates = numbered(t.select(F.col("p").alias("name")).distinct(), "name")
    e = t.join(nodes.select(F.col("name").alias("s"), F.col("id").alias("src")), "s").join(nodes.select(F.col("name").alias("o"), F.col("id").alias("dst")), "o").join(predicates.select(F.col("name").alias("p"), F.col("id").alias("predicate")), "p")
    return e.select("src", "dst", "predicate"), nodes, predicates


def write_edge_list(edges: DataFrame, path: str, single_file: bool = False) -> None:
    """Lines "src dst"."""
    lines = edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def write_graph(graph: MapGraph, path: str) -> None:
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, directed: bool = True) -> MapGraph:
    edges = spark.read.parquet(f"{path}/edges").select("eid", "src", "dst", F.col("type").cast("string").alias("type"), "props")
    return MapGraph(spark.read.parquet(f"{path}/vertices"), edges, directed)
