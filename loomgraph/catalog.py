"""A catalog of graphs: what is loaded, under which name, and its counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .model import MapGraph, TableGraph

LOADING, OPERATIONAL, DELETED, NON_OPERATIONAL, STREAMING = "loading", "op", "deleted", "nop", "streaming"


@dataclass
class Entry:
    id: int
    name: str
    path: str
    status: str
    graph: MapGraph | TableGraph
    edges: DataFrame  # src, dst
    directed: bool = True
    partitions: int = 2


@dataclass
class GraphCatalog:
    spark: SparkSession
    entries: dict[int, Entry] = field(default_factory=dict)
    last: int = 0

    def register(self, name: str, path: str, graph: MapGraph | TableGraph, edges: DataFrame | None = None, status: str = OPERATIONAL, partitions: int = 2) -> Entry:
        self.last += 1
        pairs = edges if edges is not None else graph.to_map().edges.select("src", "dst")
        self.entries[self.last] = e = Entry(self.last, name, path, status, graph, pairs, graph.directed, partitions)
        return e

    def get(self, key: int | str) -> Entry:
        for e in self.entries.values():
            if key in (e.id, str(e.id), e.name):
                return e
        raise KeyError(f"there is no graph {key}")

    def remove(self, key: int | str) -> None:
        del self.entries[self.get(key).id]

    def truncate(self) -> None:
        self.entries.clear()

    def list(self) -> DataFrame:
        rows = [(e.id, e.name, e.path, e.status, e.directed, e.partitions) for e in self.entries.values()]
        return self.spark.createDataFrame(rows, "id int, name string, path string, status string, is_directed boolean, n_partitions int")
