"""The library's front door: graphs by name, Cypher, algorithms, and a text shim for single-line commands."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import GraphCatalog
from .model import MapGraph, TableGraph
from .operators import algorithms, knowledge, link_prediction, vector_search
from .plans import compiler
from .sources import files
from .streaming.triangles import END_MARK, TriangleStream, kafka_lines, line_stream, parse


def _pairs(graph: MapGraph | TableGraph) -> DataFrame:
    return graph.to_map().edges.select("src", "dst")


def _number_pairs(graph: MapGraph | TableGraph) -> DataFrame:
    """Pairs for results that show no id: the numbers of a typed graph whose ends all have one label, else the ids."""
    tables = [t for ts in graph.rel_tables.values() for t in ts] if graph.typed else []
    if len({x for t in tables for x in (t.src_label, t.dst_label)}) != 1:
        return _pairs(graph)
    return reduce(DataFrame.unionAll, [t.df.select(F.col(t.src).cast("long").alias("src"), F.col(t.dst).cast("long").alias("dst")) for t in tables])


PROCEDURES: dict[str, Callable[..., DataFrame]] = {
    "algo.indegree": lambda g: algorithms.in_degree(_pairs(g)),
    "algo.outdegree": lambda g: algorithms.out_degree(_pairs(g)),
    "algo.trianglecount": lambda g: algorithms.triangle_count(_number_pairs(g)),
    "algo.triangles": lambda g: algorithms.triangles(_pairs(g)),
    "algo.pagerank": lambda g, alpha=0.85, iterations=10: algorithms.pagerank(_pairs(g), alpha, iterations),
    "algo.egonet": lambda g: algorithms.egonets(_pairs(g)),
}


class GraphSession:
    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, GraphCatalog(spark)
        self.streams: dict[str, object] = {}
        self.models: dict[str, link_prediction.Trained] = {}
        self.stopping: set[str] = set()
        self.timings: list[tuple[str, str, float]] = []  # command, graph, seconds until the plan is ready or the result is there

    # ---- loading
    def add(self, name: str, graph: MapGraph | TableGraph, path: str = "", edges: DataFrame | None = None) -> int:
        return self.catalog.register(name, path, graph, edges).id

    def add_pairs(self, name: str, e: DataFrame, path: str = "", directed: bool = True, partitions: int = 2) -> int:
        """A graph without properties from (src, dst)."""
        ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        pid = F.pmod(F.coalesce(F.col("id").try_cast("long"), F.xxhash64("id")), F.lit(partitions)).cast("int").alias("pid")
        vertices = ids.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("label"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("props"), pid)
        src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
        edges = e.select("src", "dst").distinct().select(F.concat_ws("-", src, dst).alias("eid"), src.alias("src"), dst.alias("dst"), F.lit(None).cast("string").alias("type"), F.create_map().cast("map<string,string>").alias("props"))
        return self.catalog.register(name, path, MapGraph(vertices, edges, directed, name), e, partitions=partitions).id

    def add_edge_list(self, name: str, path: str, directed: bool = True, partitions: int = 2) -> int:
        return self.add_pairs(name, files.edge_list(self.spark, path), path, directed, partitions)

    def add_attributed_edge_list(self, name: str, path: str, attributes: str, dtype: str | None = None) -> int:
        """An edge list whose vertices hold their attributes as the property ``features``, joined by commas."""
        key = self.add_edge_list(name, path)
        entry, features = self.catalog.get(key), files.text_attributes(self.spark, attributes, dtype)
        f = features.select(F.col("vertex_id").cast("string").alias("id"), F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("f"))
        v = entry.graph.vertices.join(f, "id", "left").withColumn("props", F.when(F.col("f").isNotNull(), F.map_concat("props", F.create_map(F.lit("features"), F.col("f")))).otherwise(F.col("props"))).drop("f")
        entry.graph = MapGraph(v.select("id", "label", "props", "pid"), entry.graph.edges, entry.graph.directed, name)
        return key

    def add_property_graph(self, name: str, path: str, directed: bool = True, partitions: int = 2) -> int:
        return self.add(name, files.property_graph_json(self.spark, path, partitions, directed), path)

    def construct_knowledge_graph(self, name: str, docs: DataFrame, extractor=knowledge.sentence_tuples, state: str | None = None, attempts: int = 1) -> int | None:
        """A graph from the sentences of docs. With state, a folder, tuples are written part by part; a stopped or failed
        construction is taken up by the same call. Returns None if it was stopped."""
        texts = knowledge.sentences(docs)
        extractor = knowledge.with_retries(extractor, attempts) if attempts > 1 else extractor
        if state is None:
            return self.add(name, knowledge.build(knowledge.extract(texts, extractor)))
        self.stopping.discard(name)
        tuples = knowledge.extract_in_parts(texts, state, extractor, stopped=lambda: name in self.stopping)
        return None if tuples is None else self.add(name, knowledge.build(tuples), state)

    def stop_construction(self, name: str) -> str:
        """The construction of that graph ends after the part it is in; called from another thread."""
        self.stopping.add(name)
        return "done"

    # ---- queries
    def cypher(self, graph: int | str, text: str, **params) -> DataFrame | None:
        """Rows of a query; a query that updates replaces the graph in the catalog."""
        e = self.catalog.get(graph)
        out = compiler.run(self.spark, e.graph, text, params, PROCEDURES)
        if out.graph is not e.graph:
            e.graph, e.edges = out.graph, _pairs(out.graph)
        return out.rows

    def beam_search(self, graph: int | str, vectors: DataFrame, query: list[float], **options) -> DataFrame:
        return vector_search.beam_search(vectors, self.catalog.get(graph).graph.to_map().edges, query, **options)

    def link_scores(self, graph: int | str) -> DataFrame:
        return algorithms.neighbour_scores(self.catalog.get(graph).edges)

    # ---- commands, parts separated by |
    def run_command(self, line: str) -> DataFrame | str:
        began = time.perf_counter()
        name, *args = [x.strip() for x in line.split("|")]
        edges = lambda: self.catalog.get(args[0]).edges
        commands: dict[str, Callable[[], DataFrame | str]] = {
            "lst": self.catalog.list,
            "vcnt": lambda: algorithms.vertex_count(edges()),
            "ecnt": lambda: algorithms.edge_count(edges()),
            "trian": lambda: algorithms.triangle_count(edges()),
            "idd": lambda: algorithms.in_degree(edges()),
            "odd": lambda: algorithms.out_degree(edges()),
            "egnt": lambda: algorithms.egonets(edges()),
            "pgrnk": lambda: algorithms.pagerank(edges(), float(args[1]) if len(args) > 1 else 0.85, int(args[2]) if len(args) > 2 else 10),
            "predict": lambda: self.models[args[1]].predict(edges()) if len(args) > 1 else algorithms.neighbour_scores(edges()),
            "train": lambda: self.train_links(args[0], args[1] if len(args) > 1 else None),
            "admdl": lambda: self.add_model(args[0], args[1]),
            "sbs": lambda: self.beam_search(args[0], self.spark.read.parquet(args[1]), [float(x) for x in args[2].split(",")]),
            "sla": lambda: self.latencies(args[0] if args else None),
            "stop-constructkg": lambda: self.stop_construction(args[0]),
            "adgr-cust": lambda: f"graph {self.add_attributed_edge_list(args[0], args[1], args[2], args[3] if len(args) > 3 else None)}",
            "adrdf": lambda: f"graph {self.add_pairs(args[0], files.rdf_xml(self.spark, args[1])[0], args[1])}",
            "process_dataset": lambda: f"graph {self.add_pairs(args[0], files.citation_json(self.spark, args[1])[0], args[1])}",
            "constructkg": lambda: f"graph {self.construct_knowledge_graph(args[0], self.spark.read.text(args[1]).select(F.xxhash64('value').alias('doc_id'), F.col('value').alias('text')), state=args[2] if len(args) > 2 else None)}",
            "adstrmk": lambda: self.start_stream(args[0], args[1], args[2]),
            "strian": lambda: self.streams[args[0]].recount() if args[1:] == ["0"] else self.streams[args[0]].total(),
            "stopstrian": lambda: self.stop_stream(args[0]),
            "cypher": lambda: self.cypher(args[0], "|".join(args[1:])) or "done",
            "adgr": lambda: f"graph {self.add_edge_list(args[0], args[1])}",
            "adhdfs": lambda: f"graph {self.add_property_graph(args[0], args[1])}",
            "sdhdfs": lambda: files.write_edge_list(edges(), args[1]) or "done",
            "merge": lambda: "done",  # a graph is one table; there are no partition files to merge
            "dp-cntrl": lambda: "done",  # central edges are not kept twice
            "rmgr": lambda: self.catalog.remove(args[0]) or "done",
            "truncate": lambda: self.catalog.truncate() or "done",
            "prp": lambda: str(self.catalog.get(args[0]).partitions),
            "ktop": lambda: ",".join(q.name or str(q.id) for q in self.spark.streams.active),
            "stopstrm": lambda: self.stop_stream(args[0] if args else None),
            "exit": lambda: "bye",
        }
        if name not in commands:
            raise ValueError(f"there is no command {name}")
        out = commands[name]()
        self.timings.append((name, args[0] if args else "", time.perf_counter() - began))
        return out

    def train_links(self, graph: str, path: str | None = None) -> str:
        self.models[graph] = trained = link_prediction.train(self.catalog.get(graph).edges)
        if path:
            trained.save(path)
        return f"auc {trained.auc:.4f}"

    def add_model(self, name: str, path: str) -> str:
        self.models[name] = link_prediction.Trained.load(path)
        return f"model {name}"

    def latencies(self, graph: str | None = None) -> DataFrame:
        """command, graph, n, mean and longest seconds of this session's commands, which a service level can be held against."""
        rows = [t for t in self.timings if graph in (None, t[1])]
        df = self.spark.createDataFrame(rows, "command string, graph string, seconds double")
        return df.groupBy("command", "graph").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.max("seconds").alias("longest"))

    def start_stream(self, name: str, source: str, state: str) -> str:
        """Edge records go into a triangle count kept under state; source: a folder, or kafka:SERVERS/TOPIC.

        A line that is the end mark stops the stream once its batch is done; started again, it goes on where it was.
        """
        if source.startswith("kafka:"):
            servers, topic = source.removeprefix("kafka:").rsplit("/", 1)
            lines = kafka_lines(self.spark, servers, topic)
        else:
            lines = line_stream(self.spark, source)
        self.streams[name] = s = TriangleStream(self.spark, f"{state}/state")
        ended: list[int] = []

        def step(batch: DataFrame, batch_id: int) -> None:
            s.step(parse(batch).select("src", "dst"), batch_id)
            if not batch.where(F.trim("value") == END_MARK).isEmpty():
                ended.append(batch_id)

        query = lines.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/checkpoint").queryName(name).trigger(processingTime="1 second").start()

        def watch() -> None:
            while query.isActive:
                done = query.lastProgress
                if ended and done and done["batchId"] >= ended[0]:
                    query.stop()
                time.sleep(0.2)

        threading.Thread(target=watch, daemon=True).start()
        return f"stream {name}"

    def stop_stream(self, name: str | None) -> str:
        found = [q for q in self.spark.streams.active if name in (None, q.name, str(q.id))]
        if len(found) != 1:
            if not found and name in self.streams:
                return "done"  # its end mark has stopped it
            return "no such stream" if not found else "several streams: " + ",".join(q.name or str(q.id) for q in found)
        found[0].stop()
        return "done"
