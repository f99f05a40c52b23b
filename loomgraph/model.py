"""Property graphs as tables of nodes and of relationships.

``MapGraph`` holds schema-less graphs: one vertex table (id string, label, props map of strings, pid) and one edge
table (eid, src, dst, type, props). ``TableGraph`` lays a graph over typed tables, one per label and per relationship
type, so that filters and column pruning reach their scans; keys are numbers that are unique within a label.

Both offer the compiler the same view: ``nodes`` and ``rels`` return a DataFrame whose columns are prefixed by the variable.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "__"


@dataclass(frozen=True)
class MapGraph:
    vertices: DataFrame  # id, label, props, pid
    edges: DataFrame  # eid, src, dst, type, props
    directed: bool = True
    name: str = "graph"

    typed = False

    def nodes(self, var: str, labels: Iterable[str] = ()) -> DataFrame:
        df = self.vertices
        for label in labels:
            df = df.where(F.col("label") == label)
        return df.select([F.col(c).alias(f"{var}{SEP}{c}") for c in ("id", "label", "props", "pid")])

    def rels(self, var: str, types: Iterable[str] = ()) -> DataFrame:
        types = list(types)
        df = self.edges.where(F.col("type").isin(types)) if types else self.edges
        return df.select([F.col(c).alias(f"{var}{SEP}{c}") for c in ("eid", "src", "dst", "type", "props")])

    def property(self, df_columns: set[str], var: str, key: str) -> Column:
        if key == "partitionID":  # a virtual property of nodes
            return F.col(f"`{var}{SEP}pid`").cast("string")
        return F.col(f"`{var}{SEP}props`")[key]

    def end_matches(self, node: str, rel: str, end: str) -> Column:
        return F.col(f"`{node}{SEP}id`") == F.col(f"`{rel}{SEP}{end}`")

    def same_node(self, a: str, b: str) -> Column:
        return F.col(f"`{a}{SEP}id`") == F.col(f"`{b}{SEP}id`")

    def to_map(self) -> "MapGraph":
        return self


@dataclass(frozen=True)
class NodeTable:
    df: DataFrame
    key: str


@dataclass(frozen=True)
class RelTable:
    df: DataFrame
    src: str
    dst: str
    src_label: str
    dst_label: str
    eid: Column | None = None  # default: rows that are equal in all columns are one relationship

    def identity(self) -> Column:
        return self.eid if self.eid is not None else F.xxhash64(*[F.col(c) for c in self.df.columns])


@dataclass(frozen=True)
class TableGraph:
    node_tables: dict[str, NodeTable]
    rel_tables: dict[str, list[RelTable]]
    directed: bool = True
    name: str = "graph"
    typed = True
    _: dict = field(default_factory=dict, compare=False)

    def nodes(self, var: str, labels: Iterable[str] = ()) -> DataFrame:
        labels = list(labels)
        chosen = [x for x in self.node_tables if all(x == y for y in labels)]
        parts = []
        for label in chosen or list(self.node_tables)[:1]:
            t = self.node_tables[label]
            cols = [F.col(t.key).cast("long").alias(f"{var}{SEP}id"), F.lit(label).alias(f"{var}{SEP}label")]
            part = t.df.select(*cols, *[F.col(c).alias(f"{var}{SEP}{c}") for c in t.df.columns])
            parts.append(part if chosen else part.where(F.lit(False)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def rels(self, var: str, types: Iterable[str] = ()) -> DataFrame:
        types = list(types)
        parts = []
        for kind, tables in self.rel_tables.items():
            if types and kind not in types:
                continue
            for n, t in enumerate(tables):
                eid = t.identity()
                cols = {"eid": F.concat(F.lit(f"{kind}{n}:"), eid.cast("string")) if len(types) != 1 or len(tables) > 1 else eid.cast("string"), "src": F.col(t.src).cast("long"), "dst": F.col(t.dst).cast("long"), "src_label": F.lit(t.src_label), "dst_label": F.lit(t.dst_label), "type": F.lit(kind)}
                parts.append(t.df.select(*[c.alias(f"{var}{SEP}{k}") for k, c in cols.items()], *[F.col(c).alias(f"{var}{SEP}{c}") for c in t.df.columns if c not in cols]))
        if not parts:
            return self.rels(var).where(F.lit(False))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def property(self, df_columns: set[str], var: str, key: str) -> Column:
        name = f"{var}{SEP}{key}"
        return F.col(f"`{name}`") if name in df_columns else F.lit(None).cast("string")

    def end_matches(self, node: str, rel: str, end: str) -> Column:
        # labels are constants unless several tables were united; then the optimizer folds the second test away
        return (F.col(f"`{node}{SEP}id`") == F.col(f"`{rel}{SEP}{end}`")) & (F.col(f"`{node}{SEP}label`") == F.col(f"`{rel}{SEP}{end}_label`"))

    def same_node(self, a: str, b: str) -> Column:
        return (F.col(f"`{a}{SEP}id`") == F.col(f"`{b}{SEP}id`")) & (F.col(f"`{a}{SEP}label`") == F.col(f"`{b}{SEP}label`"))

    def to_map(self) -> MapGraph:
        """The schema-less form; ids become label:key, properties strings."""
        nodes, rels = [], []
        for label, t in self.node_tables.items():
            props = F.map_from_arrays(F.array(*[F.lit(c) for c in t.df.columns]), F.array(*[F.col(c).cast("string") for c in t.df.columns]))
            nodes.append(t.df.select(F.concat(F.lit(label + ":"), F.col(t.key).cast("string")).alias("id"), F.lit(label).alias("label"), props.alias("props"), F.lit(0).alias("pid")))
        for kind, tables in self.rel_tables.items():
            for n, t in enumerate(tables):
                props = F.map_from_arrays(F.array(*[F.lit(c) for c in t.df.columns]), F.array(*[F.col(c).cast("string") for c in t.df.columns]))
                eid = t.identity()
                rels.append(t.df.select(F.concat(F.lit(f"{kind}{n}:"), eid.cast("string")).alias("eid"), F.concat(F.lit(t.src_label + ":"), F.col(t.src).cast("string")).alias("src"), F.concat(F.lit(t.dst_label + ":"), F.col(t.dst).cast("string")).alias("dst"), F.lit(kind).alias("type"), props.alias("props")))
        union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
        return MapGraph(union(nodes), union(rels), self.directed, self.name)
