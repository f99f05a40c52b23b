"""Streaming graphs: edge records from a stream, de-duplicated, counted and searched for triangles as they come.

Every micro-batch works on the edges so far (G, a table in the state folder) and its own new ones (D). Triangles with at
least one new edge are found by joining the new edges to all edges at either end; each is kept once, and the running
total only grows by them. State is keyed by batch id: a batch that runs again writes what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.algorithms import canonical, triangle_count
from ..sources.files import EDGE_RECORD

STATE = "batch long, a long, b long"


END_MARK = "-1"


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Lines of files as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def kafka_lines(spark: SparkSession, servers: str, topic: str, max_offsets: int = 100_000) -> DataFrame:
    """The values of a topic; needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def edge_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Edge records of JSON files as they appear in a folder."""
    return parse(line_stream(spark, path, files_per_trigger))


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int = 100_000) -> DataFrame:
    return parse(kafka_lines(spark, servers, topic, max_offsets))


def parse(lines: DataFrame) -> DataFrame:
    """src, dst, eid, type, props; the end mark -1 and lines that are no record are left out."""
    r = F.from_json("value", EDGE_RECORD)
    e = lines.select(r.alias("r")).where("r.source.id is not null and r.destination.id is not null")
    return e.select(F.col("r.source.id").try_cast("long").alias("src"), F.col("r.destination.id").try_cast("long").alias("dst"), F.col("r.properties")["id"].alias("eid"), F.col("r.properties")["type"].alias("type"), F.col("r.properties").alias("props"))


class TriangleStream:
    """Counts the triangles of a stream of (src, dst). state: a folder all executors share."""

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state.rstrip("/")

    def _read(self, table: str, schema: str, before: int) -> DataFrame:
        try:
            df = self.spark.read.schema(schema).parquet(f"{self.state}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = self.spark.createDataFrame([], schema)
        return df.where(F.col("batch") < before)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        old = self._read("edges", STATE, batch_id).select("a", "b")
        new = canonical(batch).join(old, ["a", "b"], "left_anti").persist()
        found = new_triangles(new, old.unionByName(new))
        self._write(new, "edges", batch_id)
        self._write(found, "triangles", batch_id)
        new.unpersist()

    def _write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.state}/{table}/batch={batch_id}")

    def start(self, edges: DataFrame, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
        writer = edges.select("src", "dst").writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        if name:
            writer = writer.queryName(name)
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    def edges(self) -> DataFrame:
        return self._read("edges", STATE, 2**62).select("a", "b")

    def triangles(self) -> DataFrame:
        return self._read("triangles", STATE + ", c long", 2**62).select("a", "b", "c")

    def total(self) -> DataFrame:
        return self.triangles().agg(F.count("*").alias("n_triangles"))

    def recount(self) -> DataFrame:
        """Mode 0: all triangles of the edges so far, from scratch."""
        return triangle_count(self.edges().select(F.col("a").alias("src"), F.col("b").alias("dst")))


def new_triangles(new: DataFrame, edges: DataFrame) -> DataFrame:
    """Triangles a < b < c of distinct edges (a, b) with at least one edge in new (a, b), which edges holds too.

    A new edge meets the neighbours of its end of lower degree only, so no two neighbours of a hub are paired. A triangle comes from the
    first of its new edges, so that none has to be dropped again.
    """
    mark = edges.select("a", "b").join(new.select("a", "b", F.lit(True).alias("new")), ["a", "b"], "left").select("a", "b", F.coalesce("new", F.lit(False)).alias("new"))
    sym = mark.unionByName(mark.select(F.col("b").alias("a"), F.col("a").alias("b"), "new"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("deg"))
    ends = new.select("a", "b").join(degree.select(F.col("v").alias("a"), F.col("deg").alias("da")), "a").join(degree.select(F.col("v").alias("b"), F.col("deg").alias("db")), "b")
    low = F.struct("da", "a") < F.struct("db", "b")
    started = ends.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    first = lambda x, y: F.struct(F.least(x, y), F.greatest(x, y))
    later = lambda x, y: ~F.col("new") | (first(x, y) > first("u", "v"))
    wedge = started.join(sym.select(F.col("a").alias("u"), F.col("b").alias("w"), "new"), "u").where((F.col("w") != F.col("v")) & later("u", "w")).select("u", "v", "w")
    sides = wedge.select("u", "v", "w", F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"))
    closed = sides.join(mark, ["a", "b"]).where(later("v", "w"))
    tri = F.array_sort(F.array("u", "v", "w"))
    return closed.select(tri[0].alias("a"), tri[1].alias("b"), tri[2].alias("c"))


def running_degrees(edges: DataFrame) -> DataFrame:
    """A streaming aggregation: how many edges each vertex has had as source (complete or update mode)."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_edges"))


def windowed_edges(edges: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Edges by type and time window; needs a timestamp column ts."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "type").agg(F.count("*").alias("n_edges")).select(F.col("w.start").alias("start"), "type", "n_edges")


def deduplicated(edges: DataFrame, late: str | None = None, time: str = "ts") -> DataFrame:
    """Edges whose property id was seen before are left out; those without one stay, and leave no state.

    With late (such as "1 hour") and a timestamp column, an id is forgotten that long after its edge, so that state is bounded.
    """
    named = edges.where("eid is not null")
    named = named.withWatermark(time, late).dropDuplicatesWithinWatermark(["eid"]) if late else named.dropDuplicates(["eid"])
    return named.unionByName(edges.where("eid is null"))
