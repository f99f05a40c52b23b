"""Compiles parsed openCypher to DataFrame operations; Catalyst does the rest.

A variable's columns are prefixed by its name: ``n__id``, ``n__label``, and a column per property or one map of them. A MATCH
becomes a chain of equi-joins from the most selective node outwards; relationship uniqueness, labels, types and
property maps become plain predicates, which the optimizer pushes into the scans. Properties of schema-less graphs are
strings: a comparison follows the type of the literal on its other side (numbers as DOUBLE, booleans by the words
true and false), and null follows SQL's three-valued logic. Where the query language leaves a gap, openCypher's rules
hold: NOT negates, DISTINCT removes duplicates, ORDER BY ascends by default with nulls last.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import SEP, MapGraph, TableGraph
from ..operators.algorithms import has_checkpoints
from .syntax import Clause, Node, Path, Rel, parse

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}

SMALL = 16 << 20  # bytes of a table's files that may be sent to all tasks


class CypherSemanticError(ValueError):
    pass


@dataclass
class Env:
    df: DataFrame | None
    kinds: dict[str, str]  # variable -> node, rel, rels, path, value

    def has(self, var: str) -> bool:
        return var in self.kinds


@dataclass
class Result:
    rows: DataFrame | None
    graph: MapGraph | TableGraph


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def _number(c: Column) -> Column:
    return c.try_cast("double")


_STRING_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "toupper": F.upper,
    "tolower": F.lower,
    "trim": F.trim,
    "ltrim": F.ltrim,
    "rtrim": F.rtrim,
    "reverse": F.reverse,
    "abs": F.abs,
    "ceil": F.ceil,
    "floor": F.floor,
    "round": F.round,
    "sqrt": F.sqrt,
    "sign": F.signum,
    "exp": F.exp,
    "log": F.ln,
    "log10": F.log10,
    "tostring": lambda c: c.cast("string"),
    "tointeger": lambda c: c.try_cast("double").cast("long"),
    "tofloat": lambda c: c.try_cast("double"),
    "toboolean": lambda c: F.when(F.lower(c.cast("string")).isin("true", "false"), F.lower(c.cast("string")) == "true"),
    "head": lambda c: F.get(c, F.lit(0)),
    "last": lambda c: F.get(c, F.size(c) - 1),
    "tail": lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))),
    "length": lambda c: F.length(c),
    "coalesce": F.coalesce,
    "replace": lambda s, a, b: F.replace(s, a, b),
    "split": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))),
    "left": lambda s, n: F.substring(s, F.lit(1), n.cast("int")),
    "right": lambda s, n: F.right(s, n.cast("int")),
    "substring": lambda s, a, n=None: F.substring(s, a.cast("int") + 1, n.cast("int") if n is not None else F.lit(2**31 - 1)),
    "range": lambda a, b, s=None: F.sequence(a, b, s) if s is not None else F.when(a <= b, F.sequence(a, b, F.lit(1))).otherwise(F.array().cast("array<int>")),
    "pi": lambda: F.lit(3.141592653589793),
}


class Compiler:
    def __init__(self, spark: SparkSession, graph: MapGraph | TableGraph, params: dict[str, Any] | None = None, procedures: dict[str, Callable] | None = None):
        self.spark, self.graph, self.params, self.procedures = spark, graph, params or {}, procedures or {}
        self.fresh = 0
        self.tests: list = []  # conjuncts of the WHERE of the pattern that is being matched

    # ------------------------------------------------------------------ queries
    def run(self, text: str) -> Result:
        out: DataFrame | None = None
        for op, clauses in parse(text):
            rows = self.single(clauses)
            if not op:
                out = rows
                continue
            if rows is None or out is None or rows.columns != out.columns:
                raise CypherSemanticError("the parts of a set operation must return the same columns")
            if op == "UNION":
                out = out.unionByName(rows).distinct()
            elif op == "UNION ALL":
                out = out.unionByName(rows)
            elif op.startswith("INTERSECT"):
                out = out.intersectAll(rows) if op.endswith("ALL") else out.intersect(rows)
            else:
                out = out.exceptAll(rows) if op.endswith("ALL") else out.subtract(rows)
        return Result(out, self.graph)

    def single(self, clauses: list[Clause]) -> DataFrame | None:
        env = Env(None, {})
        counted = self.counted_pairs(clauses)
        if counted is not None:
            return counted
        for c in clauses:
            if c.kind == "return":
                return self.project(env, c.data, final=True).df
            env = getattr(self, "do_" + c.kind)(env, c.data)
        if clauses[-1].kind in ("match", "unwind", "with"):
            raise CypherSemanticError("the query must end with RETURN or an update")
        return env.df if clauses[-1].kind == "call" else None

    def counted_pairs(self, clauses: list[Clause]) -> DataFrame | None:
        """Rows of MATCH (a)-[r]-(m)-[s]-(b) [WHERE ... a <> b] RETURN values of m, count(*), without a row for each pair.

        Both sides are counted for each m and the counts multiplied; pairs that are no match, of one node or of one relationship, are
        counted alike by joins on both and taken off. None if the query has another form.
        """
        if [c.kind for c in clauses] != ["match", "return"]:
            return None
        found, out = clauses[0].data, clauses[1].data
        if found["optional"] or len(found["paths"]) != 1 or out["distinct"] or out["order"] or out["skip"] is not None or out["limit"] is not None:
            return None
        path = found["paths"][0]
        if path.var or len(path.rels) != 2 or any(r.hops for r in path.rels) or any(x.props for x in path.nodes + path.rels):
            return None
        (a, m, b), (r, s) = path.nodes, path.rels
        if len({x.var for x in (a, m, b, r, s)}) < 5:
            return None
        unlike, sides = False, ([], [])
        for e in self.conjuncts(found["where"]):
            if e in (("compare", "<>", ("var", a.var), ("var", b.var)), ("compare", "<>", ("var", b.var), ("var", a.var))):
                unlike = True
            elif e[0] != "compare" or self.aggregates(e):
                return None
            elif (used := self.variables(e)) <= {a.var, m.var, r.var}:
                sides[0].append(e)
            elif used <= {b.var, s.var}:
                sides[1].append(e)
            else:
                return None
        count = ("call", "count", [("lit", 1)], False)
        keys = [(e, n) for e, n in out["items"] if e != count]
        if len(keys) == len(out["items"]) or any(e == "*" or e[0] != "get" or e[1] != ("var", m.var) for e, _ in keys) or len({n for _, n in out["items"]}) < len(out["items"]):
            return None
        first = self.expand(self.bind_node(Env(None, {}), a), a, r, m, [])
        steps = self.oriented(s, s.var)  # from m: its row is joined once, on the first side
        second = Env(steps.join(self.node_rows(b), self.graph.end_matches(b.var, s.var, "dst")), {s.var: "rel", b.var: "node"})
        first, second = (self.filter(x, ("and", tests)) for x, tests in ((first, sides[0]), (second, sides[1])))
        ends = ["id", "label"] if self.graph.typed else ["id"]
        names = [f"_key{i}" for i in range(len(keys))]
        at, who = [f"_m{i}" for i in range(len(ends))], [f"_n{i}" for i in range(len(ends))]
        place = ["src", "src_label"][: len(ends)]
        apart = bool(not r.types or not s.types or set(r.types) & set(s.types))
        one = first.df.select(*[self.value(e, first).alias(n) for (e, _), n in zip(keys, names, strict=True)], *[col(f"{m.var}{SEP}{x}").alias(y) for x, y in zip(ends, at, strict=True)], *[col(f"{a.var}{SEP}{x}").alias(y) for x, y in zip(ends, who, strict=True)], col(f"{r.var}{SEP}eid").alias("_rel"))
        two = second.df.select(*[col(f"{s.var}{SEP}{x}").alias(y) for x, y in zip(place, at, strict=True)], *[col(f"{b.var}{SEP}{x}").alias(y) for x, y in zip(ends, who, strict=True)], col(f"{s.var}{SEP}eid").alias("_rel"))
        if apart:
            one, two = one.where("_rel is not null"), two.where("_rel is not null")
        if unlike:  # a comparison with null is no match
            known = " and ".join(f"{x} is not null" for x in who)
            one, two = one.where(known), two.where(known)

        def pairs(by: list[str], sign: int) -> DataFrame:
            x = one.groupBy(*names, *at, *by).agg(F.count("*").alias("_x"))
            y = two.groupBy(*at, *by).agg(F.count("*").alias("_y"))
            return x.join(y, [*at, *by]).select(*names, (F.col("_x") * F.col("_y") * sign).alias("_c"))

        total = pairs([], 1)
        if unlike:
            total = total.unionByName(pairs(who, -1))
        if apart:
            total = total.unionByName(pairs(["_rel"], -1))
        if unlike and apart:
            total = total.unionByName(pairs([*who, "_rel"], 1))
        n = F.coalesce(F.sum("_c"), F.lit(0)).alias("_c")
        rows = total.groupBy(*names).agg(n).where("_c > 0") if names else total.agg(n)
        columns = {n: k for (_, n), k in zip(keys, names, strict=True)}
        return rows.select([col(columns.get(n, "_c")).alias(n) for _, n in out["items"]])

    # ------------------------------------------------------------------ reading
    def do_match(self, env: Env, data: dict) -> Env:
        bound = dict(env.kinds)
        if data["optional"] and env.df is not None:
            return self.optional(env, data["paths"], data["where"])
        out = self.match(Env(env.df, bound), data["paths"], data["where"])
        if data["optional"]:  # a first clause: one row of nulls if nothing matches
            one = self.spark.range(1).select(F.lit(1).alias("_one"))
            df = one.join(out.df.withColumn("_two", F.lit(1)), F.col("_one") == F.col("_two"), "left").drop("_one", "_two")
            return Env(df, out.kinds)
        return out

    def optional(self, env: Env, paths: list[Path], where) -> Env:
        """Rows without a match stay, with nulls. The pattern is matched once for each distinct binding of the variables it
        shares with the rows, and joined back by what identifies them, so that no order of rows matters."""
        used = self.variables(paths) | self.variables(where)
        shared = [v for v in env.kinds if v in used]
        keys = [c for v in shared for c in self.identity(env, v)]
        bindings = env.df.select([col(c) for c in env.df.columns if any(c == v or c.startswith(v + SEP) for v in shared)])
        if not shared:
            inner = self.match(Env(None, {}), paths, where)
            return Env(env.df.join(inner.df, F.lit(True), "left"), env.kinds | inner.kinds)
        inner = self.match(Env(bindings.dropDuplicates(keys), {v: env.kinds[v] for v in shared}), paths, where)
        added = [c for c in inner.df.columns if c not in bindings.columns]
        own = inner.df.select([col(c).alias(f"_k{i}") for i, c in enumerate(keys)] + [col(c) for c in added])
        test = F.lit(True)
        for i, c in enumerate(keys):
            test = test & col(c).eqNullSafe(col(f"_k{i}"))
        rows = env.df.join(own, test, "left").drop(*[f"_k{i}" for i in range(len(keys))])
        return Env(rows, env.kinds | inner.kinds)

    @staticmethod
    def identity(env: Env, var: str) -> list[str]:
        """The columns that tell one binding of a variable from another."""
        names = {"node": ("id", "label"), "rel": ("eid",), "rels": ("eids",), "path": ("ids",)}.get(env.kinds[var])
        return [var] if names is None else [c for n in names if (c := f"{var}{SEP}{n}") in env.df.columns]

    def variables(self, x) -> set[str]:
        """Names of all variables in a pattern or expression."""
        if isinstance(x, (Path, Node, Rel)):
            parts = [x.nodes, x.rels] if isinstance(x, Path) else [x.props]
            return {x.var} - {None} | self.variables(parts)
        if isinstance(x, dict):
            return self.variables(list(x.values()))
        if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
            return {x[1]}
        if isinstance(x, tuple) and x and x[0] == "haslabel":
            return {x[1]}
        return set().union(*map(self.variables, x)) if isinstance(x, (list, tuple)) else set()

    def match(self, env: Env, paths: list[Path], where) -> Env:
        rels: list[tuple[Rel, str]] = []
        seek = self.seeks(where)
        outer, self.tests = self.tests, self.conjuncts(where)
        for path in paths:
            env = self.walk(env, path, rels, seek)
        self.tests = outer
        for i, (a, ka) in enumerate(rels):
            for b, kb in rels[:i]:
                if set(a.types or ["?"]) & set(b.types or ["?"]) or not a.types or not b.types:
                    env.df = env.df.where(self.apart(a, ka, b, kb))
        return self.filter(env, where)

    def apart(self, a: Rel, ka: str, b: Rel, kb: str) -> Column:
        """Within one MATCH, no relationship is used twice."""
        if ka == kb == "rel":
            return col(f"{a.var}{SEP}eid") != col(f"{b.var}{SEP}eid")
        if ka == kb:
            return ~F.arrays_overlap(col(f"{a.var}{SEP}eids"), col(f"{b.var}{SEP}eids"))
        one, many = (a, b) if ka == "rel" else (b, a)
        return ~F.array_contains(col(f"{many.var}{SEP}eids"), col(f"{one.var}{SEP}eid"))

    def seeks(self, where) -> set[str]:
        """Variables that a conjunct fixes by id(n) = literal: the walk begins there."""
        out = set()
        for e in self.conjuncts(where):
            if e[0] == "compare" and e[1] == "=":
                for x, y in ((e[2], e[3]), (e[3], e[2])):
                    if x[0] == "call" and x[1] == "id" and y[0] in ("lit", "param"):
                        out.add(x[2][0][1])
        return out

    @staticmethod
    def conjuncts(e) -> list:
        return [] if e is None else [x for y in e[1] for x in Compiler.conjuncts(y)] if e[0] == "and" else [e]

    def walk(self, env: Env, path: Path, rels: list, seek: set[str]) -> Env:
        nodes = path.nodes

        def rank(i: int) -> tuple:
            n = nodes[i]
            return (not env.has(n.var), n.var not in seek, not n.props, not n.labels, i)

        start = min(range(len(nodes)), key=rank)
        env = self.bind_node(env, nodes[start])
        for i in range(start, len(path.rels)):
            env = self.expand(env, nodes[i], path.rels[i], nodes[i + 1], rels)
        for i in range(start - 1, -1, -1):
            r = path.rels[i]
            flipped = replace(r, direction={"out": "in", "in": "out", "any": "any"}[r.direction])
            env = self.expand(env, nodes[i + 1], flipped, nodes[i], rels)
        if path.var:
            hops = [F.size(col(f"{r.var}{SEP}eids")) if env.kinds[r.var] == "rels" else F.lit(1) for r in path.rels]
            length = sum(hops[1:], hops[0]) if hops else F.lit(0)
            ids = [col(f"{n.var}{SEP}id").cast("string") for n in nodes]
            env = Env(env.df.withColumns({f"{path.var}{SEP}length": length.cast("long"), f"{path.var}{SEP}ids": F.array(*ids)}), env.kinds | {path.var: "path"})
        return env

    def with_props(self, df: DataFrame, var: str, props: dict) -> DataFrame:
        env = Env(df, {var: "node"})
        for key, value in props.items():
            df = df.where(self.compare("=", ("get", ("var", var), key), value, env))
        return df

    def node_rows(self, node: Node) -> DataFrame:
        """Nodes by labels and by the properties that no other variable decides."""
        return self.with_props(self.graph.nodes(node.var, node.labels), node.var, {k: v for k, v in node.props.items() if not self.variables(v)})

    def dependent(self, env: Env, var: str, props: dict) -> Env:
        """Properties in a pattern that other variables of the rows decide."""
        for key, value in props.items():
            if self.variables(value):
                env = Env(env.df.where(self.compare("=", ("get", ("var", var), key), value, env)), env.kinds)
        return env

    def bind_node(self, env: Env, node: Node) -> Env:
        if env.has(node.var):
            if env.kinds[node.var] != "node":
                raise CypherSemanticError(f"{node.var} is not a node")
            df = env.df
            for label in node.labels:
                df = df.where(col(f"{node.var}{SEP}label") == label)
            own = {k: v for k, v in node.props.items() if not self.variables(v)}
            return self.dependent(Env(self.with_props(df, node.var, own), env.kinds), node.var, node.props)
        rows = self.node_rows(node)
        out = Env(rows if env.df is None else self.spread(env.df, rows), env.kinds | {node.var: "node"})  # a predicate in WHERE makes it an equi-join
        return self.dependent(out, node.var, node.props)

    def spread(self, df: DataFrame, rows: DataFrame) -> DataFrame:
        """All pairs. There may be many for a row, so df is dealt to all cores, whatever files it came from, and small tables are sent to it
        lest few values of an equality make few tasks."""
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.repartition(4 * self.spark.sparkContext.defaultParallelism).crossJoin(F.broadcast(rows) if size <= SMALL else rows)

    def oriented(self, rel: Rel, var: str) -> DataFrame:
        """Relationships as (from = src, to = dst) in the walk's direction; undirected ones in both, self-loops once."""
        df = self.graph.rels(var, rel.types)
        ends = [("src", "dst")] + ([("src_label", "dst_label")] if self.graph.typed else [])

        def turned() -> DataFrame:
            names = {f"{var}{SEP}{a}": f"{var}{SEP}{b}" for a, b in ends} | {f"{var}{SEP}{b}": f"{var}{SEP}{a}" for a, b in ends}
            return df.select([col(c).alias(names.get(c, c)) for c in df.columns])

        df = df if rel.direction == "out" else turned() if rel.direction == "in" else df.unionByName(turned().where(~self.loop(var)))
        return df

    def loop(self, var: str) -> Column:
        same = col(f"{var}{SEP}src") == col(f"{var}{SEP}dst")
        return same & (col(f"{var}{SEP}src_label") == col(f"{var}{SEP}dst_label")) if self.graph.typed else same

    def expand(self, env: Env, a: Node, rel: Rel, b: Node, rels: list) -> Env:
        if rel.hops:
            return self.expand_many(env, a, rel, b, rels)
        if env.has(rel.var):
            raise CypherSemanticError(f"{rel.var} is bound already")
        edges = self.oriented(rel, rel.var)
        for key, value in rel.props.items():
            if not self.variables(value):
                edges = edges.where(self.compare("=", ("get", ("var", rel.var), key), value, Env(edges, {rel.var: "rel"})))
        kinds = env.kinds | {rel.var: "rel"}
        df = self.dependent(Env(env.df.join(edges, self.graph.end_matches(a.var, rel.var, "src")), kinds), rel.var, rel.props).df
        rels.append((rel, "rel"))
        if env.has(b.var):
            return self.bind_node(Env(df.where(self.graph.end_matches(b.var, rel.var, "dst")), kinds), b)
        out = Env(df.join(self.node_rows(b), self.graph.end_matches(b.var, rel.var, "dst")), kinds | {b.var: "node"})
        return self.dependent(out, b.var, b.props)

    def expand_many(self, env: Env, a: Node, rel: Rel, b: Node, rels: list) -> Env:
        """Hops from low to high as a union of joins; a relationship comes at most once in a walk.

        Without an upper bound hops go on until no walk gets longer; each is written or kept before the next, as its rows are counted.
        """
        low, high = rel.hops
        if high is not None and high < low:
            raise CypherSemanticError("the upper bound of a variable-length pattern is below its lower bound")
        if high is None:  # hops that are kept hide the rows from the optimizer, so what WHERE says of them comes first
            for test in self.tests:
                if test[0] not in ("pattern", "not") and self.variables(test) <= env.kinds.keys():
                    env = Env(env.df.where(self.value(test, Env(env.df, env.kinds))), env.kinds)
        e, here, ids = rel.var, self.new("at"), f"{rel.var}{SEP}eids"
        ends = ["id", "label"] if self.graph.typed else ["id"]
        df = env.df.withColumns({f"{here}{SEP}{x}": col(f"{a.var}{SEP}{x}") for x in ends} | {ids: F.array().cast("array<string>")})
        reached = [df] if low == 0 else []
        step = self.oriented(rel, e)
        for key, value in rel.props.items():
            step = step.where(self.compare("=", ("get", ("var", e), key), value, Env(step, {e: "rel"})))
        step = step.select(*[col(f"{e}{SEP}{x}") for x in ("eid", "src", "dst", *(["src_label", "dst_label"] if self.graph.typed else []))])
        for hop in itertools.count(1) if high is None else range(1, high + 1):
            df = df.join(step, self.graph.end_matches(here, e, "src")).where(~F.array_contains(col(ids), col(f"{e}{SEP}eid")))
            moved = {f"{here}{SEP}id": col(f"{e}{SEP}dst"), ids: F.array_append(col(ids), col(f"{e}{SEP}eid"))}
            if self.graph.typed:
                moved[f"{here}{SEP}label"] = col(f"{e}{SEP}dst_label")
            df = df.withColumns(moved).drop(*step.columns)
            if high is None:
                df = df.checkpoint() if has_checkpoints(df) else df.persist()
                if not df.count() and reached:  # the count also tells the optimizer how small the walks so far are
                    break
            if hop >= low:
                reached.append(df)
        df = reached[0]
        for more in reached[1:]:
            df = df.unionByName(more)
        kinds = env.kinds | {e: "rels"}
        rels.append((rel, "rels"))
        if env.has(b.var):
            out = self.bind_node(Env(df.where(self.graph.same_node(here, b.var)), kinds), b)
        else:
            out = self.dependent(Env(df.join(self.node_rows(b), self.graph.same_node(here, b.var)), kinds | {b.var: "node"}), b.var, b.props)
        return Env(out.df.drop(*[f"{here}{SEP}{x}" for x in ends]), out.kinds)

    def filter(self, env: Env, where) -> Env:
        for e in self.conjuncts(where):
            negated = e[0] == "not" and e[1][0] == "pattern"
            if e[0] == "pattern" or negated:
                env = self.semi(env, e[1] if negated else e, negated)
            else:
                here = Env(env.df, env.kinds)
                test = self.value(e, here)  # may join columns to the rows
                env = Env(here.df.where(test), env.kinds)
        return env

    def shared_keys(self, env: Env, paths: list[Path], where) -> tuple[list[str], list[str]]:
        used = {n.var for p in paths for n in p.nodes}
        shared = sorted(v for v in used if env.kinds.get(v) == "node")
        if not shared:
            raise CypherSemanticError("a pattern in an expression must hold a variable of the query")
        return shared, [c for v in shared for c in self.identity(env, v)]

    def joined(self, env: Env, keys: list[str], found: DataFrame, name: str) -> None:
        """Adds the column of that name to the rows, by the columns of their nodes; found holds keys renamed _k0, _k1, ... once each."""
        test = F.lit(True)
        for i, c in enumerate(keys):
            test = test & (col(c) == col(f"_k{i}"))
        env.df = env.df.join(found, test, "left").drop(*[f"_k{i}" for i in range(len(keys))])

    def e_pattern(self, env, paths, where):
        """A pattern as a value: true where it has a match. One row for each binding comes from the pattern."""
        shared, keys = self.shared_keys(env, paths, where)
        name = self.new("found")
        inner = self.match(Env(None, {}), paths, where)
        found = inner.df.select([col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).distinct().withColumn(name, F.lit(True))
        self.joined(env, keys, found, name)
        return F.coalesce(col(name), F.lit(False))

    def e_listed_pattern(self, env, path, where, value):
        """[(a)-->(b) WHERE … | value]: the values of all matches, grouped by the nodes the pattern shares with the rows."""
        shared, keys = self.shared_keys(env, [path], where)
        name = self.new("listed")
        inner = self.match(Env(None, {}), [path], where)
        item = self.value(value, inner)
        found = inner.df.select([col(c).alias(f"_k{i}") for i, c in enumerate(keys)] + [item.alias("_v")])
        found = found.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.collect_list("_v").alias(name))
        kind = found.schema[name].dataType
        self.joined(env, keys, found, name)
        return F.coalesce(col(name), F.array().cast(kind))

    def semi(self, env: Env, e, negated: bool) -> Env:
        """EXISTS { pattern }: a semi-join (or anti-join) on the nodes that the pattern shares with the rows."""
        _, paths, where = e
        shared, _ = self.shared_keys(env, paths, where)
        inner = self.match(Env(None, {}), paths, where)
        ends = ["id", "label"] if self.graph.typed else ["id"]
        keys = inner.df.select([col(f"{v}{SEP}{x}").alias(f"_x{SEP}{v}{SEP}{x}") for v in shared for x in ends])
        test = None
        for v in shared:
            for x in ends:
                one = col(f"{v}{SEP}{x}") == col(f"_x{SEP}{v}{SEP}{x}")
                test = one if test is None else test & one
        return Env(env.df.join(keys, test, "left_anti" if negated else "left_semi"), env.kinds)

    def do_unwind(self, env: Env, data: dict) -> Env:
        here = Env(env.df if env.df is not None else self.spark.range(1).select(), env.kinds)
        value = self.value(data["value"], here)
        df = here.df
        return Env(df.select("*", F.explode(value).alias(data["var"])), env.kinds | {data["var"]: "value"})

    def do_with(self, env: Env, data: dict) -> Env:
        return self.filter(self.project(env, data, final=False), data["where"])

    def do_call(self, env: Env, data: dict) -> Env:
        name = data["proc"].lower()
        if name not in self.procedures:
            raise CypherSemanticError(f"there is no procedure {data['proc']}")
        args = [self.constant(a) for a in data["args"]]
        rows = self.procedures[name](self.graph, *args)
        chosen = data["yields"] or [(c, c) for c in rows.columns]
        rows = rows.select([col(a).alias(b) for a, b in chosen])
        return Env(rows if env.df is None else env.df.crossJoin(rows), env.kinds | {b: "value" for _, b in chosen})

    # ------------------------------------------------------------------ projection
    def project(self, env: Env, data: dict, final: bool) -> Env:
        items: list[tuple] = []
        for e, name in data["items"]:
            if e == "*":
                items += [(("var", v), v) for v in env.kinds if not v.startswith("_")]
            else:
                items.append((e, name))
        if len({n for _, n in items}) < len(items):
            raise CypherSemanticError("two columns of the same name")
        grouped = any(self.aggregates(e) for e, _ in items)
        out: list[Column] = []
        kinds: dict[str, str] = {}
        keys, sums = [], []
        for e, name in items:
            if e[0] == "var" and env.kinds.get(e[1], "value") != "value" and not final:
                kinds[name] = env.kinds[e[1]]
                cols = [col(c).alias(name + c[len(e[1]) :]) for c in env.df.columns if c.startswith(e[1] + SEP)]
            else:
                kinds[name] = "value"
                cols = [self.value(e, env).alias(name)]
            if grouped:
                (sums if self.aggregates(e) else keys).extend(cols)
            out += cols
        if grouped:
            df = env.df if env.df is not None else self.spark.range(1)
            df = df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)
            names = [c for e, n in items for c in ([n] if kinds[n] == "value" else [x for x in df.columns if x.startswith(n + SEP)])]
            df = df.select([col(c) for c in names])
        else:
            df = (env.df if env.df is not None else self.spark.range(1)).select(*out)
        if data["distinct"]:
            df = df.distinct()
        if data["order"]:
            df = self.order(env, df, data, items, kinds, out, grouped)
        if data["skip"] is not None:
            df = df.offset(self.constant(data["skip"]))
        if data["limit"] is not None:
            df = df.limit(self.constant(data["limit"]))
        return Env(df, kinds)

    def order(self, env: Env, df: DataFrame, data: dict, items: list, kinds: dict, out: list[Column], grouped: bool) -> DataFrame:
        after = Env(df, kinds)
        keys, hidden = [], []
        for e, down in data["order"]:
            match = next((n for x, n in items if x == e), None)
            if match is not None and kinds[match] == "value":
                key = col(match)
            else:
                try:
                    key = self.value(e, after)
                except CypherSemanticError:
                    if grouped or data["distinct"]:
                        raise
                    name = self.new("key")
                    hidden.append(self.value(e, env).alias(name))
                    key = col(name)
            keys.append(key.desc_nulls_first() if down else key.asc_nulls_last())
        if hidden:
            base = env.df.select(*out, *hidden)
            return base.orderBy(*keys).select([col(c) for c in df.columns])
        return df.orderBy(*keys)

    def aggregates(self, e) -> bool:
        if isinstance(e, tuple):
            return (e[0] == "call" and e[1] in AGGREGATES) or any(self.aggregates(x) for x in e[1:])
        return isinstance(e, list) and any(self.aggregates(x) for x in e)

    # ------------------------------------------------------------------ expressions
    def new(self, prefix: str) -> str:
        self.fresh += 1
        return f"_{prefix}{self.fresh}"

    def constant(self, e) -> Any:
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            if e[1] not in self.params:
                raise CypherSemanticError(f"parameter {e[1]} is missing")
            return self.params[e[1]]
        if e[0] == "negative":
            return -self.constant(e[1])
        if e[0] == "list":
            return [self.constant(x) for x in e[1]]
        raise CypherSemanticError("a constant is expected")

    def value(self, e, env: Env) -> Column:
        return getattr(self, "e_" + e[0])(env, *e[1:])

    def e_lit(self, env, x):
        return F.lit(x)

    def e_param(self, env, name):
        return F.lit(self.constant(("param", name)))

    def e_var(self, env, name):
        if name in getattr(self, "locals", {}):
            return self.locals[name]
        kind = env.kinds.get(name)
        if kind is None:
            raise CypherSemanticError(f"variable {name} is not defined")
        if kind == "value":
            return col(name)
        return F.struct(*[col(c).alias(c[len(name) + len(SEP) :]) for c in env.df.columns if c.startswith(name + SEP)])

    def e_get(self, env, e, key):
        if e[0] == "var" and env.kinds.get(e[1]) in ("node", "rel"):
            return self.graph.property(set(env.df.columns), e[1], key)
        return self.value(e, env)[key]

    def e_haslabel(self, env, var, label):
        if env.kinds.get(var) != "node":
            raise CypherSemanticError(f"{var} is not a node")
        return col(f"{var}{SEP}label") == label

    def fold(self, parts, env, op):
        out = self.value(parts[0], env)
        for p in parts[1:]:
            out = op(out, self.value(p, env))
        return out

    def e_and(self, env, parts):
        return self.fold(parts, env, lambda a, b: a & b)

    def e_or(self, env, parts):
        return self.fold(parts, env, lambda a, b: a | b)

    def e_xor(self, env, parts):
        return self.fold(parts, env, lambda a, b: (a | b) & ~(a & b))

    def e_not(self, env, e):
        return ~self.value(e, env)

    def e_null(self, env, e):
        return self.presence(e, env).isNull()

    def e_notnull(self, env, e):
        return self.presence(e, env).isNotNull()

    def presence(self, e, env: Env) -> Column:
        """A node or relationship is null if its identity is."""
        kind = env.kinds.get(e[1]) if e[0] == "var" else None
        return col(f"{e[1]}{SEP}{'id' if kind == 'node' else 'eid'}") if kind in ("node", "rel") else self.value(e, env)

    def e_compare(self, env, op, left, right):
        return self.compare(op, left, right, env)

    def compare(self, op: str, left, right, env: Env) -> Column:
        kinds = [env.kinds.get(x[1]) if x[0] == "var" else None for x in (left, right)]
        if kinds[0] in ("node", "rel") and kinds[0] == kinds[1] and op in ("=", "<>"):
            same = self.graph.same_node(left[1], right[1]) if kinds[0] == "node" else col(f"{left[1]}{SEP}eid") == col(f"{right[1]}{SEP}eid")
            return same if op == "=" else ~same
        a, b = self.value(left, env), self.value(right, env)
        if not self.graph.typed:  # properties are strings: the other side's type decides
            a, b = self.by_type(a, left, right, env), self.by_type(b, right, left, env)
        if op == "=~":
            return a.rlike("^(?:" + self.constant(right) + ")$") if right[0] in ("lit", "param") else F.regexp_like(a, b)
        return {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, ">": a.__gt__, "<=": a.__le__, ">=": a.__ge__}[op](b)

    def is_property(self, e, env: Env) -> bool:
        return (e[0] == "get" and e[1][0] == "var" and env.kinds.get(e[1][1]) in ("node", "rel")) or (e[0] == "call" and e[1] == "id")

    def by_type(self, c: Column, e, other, env: Env) -> Column:
        if not self.is_property(e, env):
            return c
        kind = self.literal_type(other)
        if kind is bool:
            return F.when(F.lower(c).isin("true", "false"), F.lower(c) == "true")
        return _number(c) if kind in (int, float) else c

    def literal_type(self, e) -> type | None:
        if e[0] in ("lit", "param"):
            return type(self.constant(e))
        if e[0] == "negative" or e[0] == "math":
            return float
        return None

    def e_starts(self, env, a, b):
        return self.value(a, env).startswith(self.value(b, env))

    def e_ends(self, env, a, b):
        return self.value(a, env).endswith(self.value(b, env))

    def e_contains(self, env, a, b):
        return self.value(a, env).contains(self.value(b, env))

    def e_in(self, env, a, b):
        if b[0] == "list":
            tests = [self.compare("=", a, x, env) for x in b[1]]
            if not tests:
                return F.lit(False)
            values = [x[1] for x in b[1] if x[0] == "lit"]
            if len(values) == len(b[1]) and (self.graph.typed or all(isinstance(v, str) for v in values)):
                return self.value(a, env).isin(values)
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out
        return F.array_contains(self.value(b, env), self.value(a, env))

    def e_math(self, env, op, a, b):
        x, y = self.value(a, env), self.value(b, env)
        if not self.graph.typed:
            x = _number(x) if self.is_property(a, env) and (op != "+" or self.literal_type(b) in (int, float)) else x
            y = _number(y) if self.is_property(b, env) and (op != "+" or self.literal_type(a) in (int, float)) else y
        if op == "+":
            texts = [self.literal_type(z) is str for z in (a, b)]
            return F.concat(x.cast("string"), y.cast("string")) if any(texts) else x + y
        return {"-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y, "^": lambda: F.pow(x, y)}[op]()

    def e_negative(self, env, e):
        return -self.value(e, env)

    def e_list(self, env, items):
        return F.array(*[self.value(x, env) for x in items])

    def e_map(self, env, items):
        return F.struct(*[self.value(v, env).alias(k) for k, v in items.items()])

    def e_index(self, env, e, i):
        at = self.value(i, env).cast("int")
        c = self.value(e, env)
        return F.get(c, F.when(at >= 0, at).otherwise(at + F.size(c)))

    def e_slice(self, env, e, low, high):
        c = self.value(e, env)
        n = F.size(c)

        def place(x, default: Column) -> Column:
            if x is None:
                return default
            v = self.value(x, env).cast("int")
            return F.greatest(F.lit(0), F.least(n, F.when(v < 0, v + n).otherwise(v)))

        a, b = place(low, F.lit(0)), place(high, n)
        return F.slice(c, a + 1, F.greatest(b - a, F.lit(0)))

    def scoped(self, var: str, f: Callable[[], Column]) -> Callable[[Column], Column]:
        def run(x: Column) -> Column:
            before = getattr(self, "locals", {})
            self.locals = before | {var: x}
            try:
                return f()
            finally:
                self.locals = before

        return run

    def e_comprehension(self, env, var, items, test, value):
        c = self.value(items, env)
        if test is not None:
            c = F.filter(c, self.scoped(var, lambda: self.value(test, env)))
        return F.transform(c, self.scoped(var, lambda: self.value(value, env))) if value is not None else c

    def e_quantifier(self, env, word, var, items, test):
        c, f = self.value(items, env), self.scoped(var, lambda: self.value(test, env))
        if word == "ALL":
            return F.forall(c, f)
        if word == "SINGLE":
            return F.size(F.filter(c, f)) == 1
        return F.exists(c, f) if word == "ANY" else ~F.exists(c, f)

    def e_case(self, env, subject, whens, other):
        out = None
        for test, value in whens:
            t = self.value(test, env) if subject is None else self.compare("=", subject, test, env)
            v = self.value(value, env)
            out = F.when(t, v) if out is None else out.when(t, v)
        return out.otherwise(self.value(other, env)) if other is not None else out

    def e_call(self, env, name, args, distinct):
        kind = env.kinds.get(args[0][1]) if args and args[0][0] == "var" else None
        var = args[0][1] if kind else ""
        if name == "id" and kind in ("node", "rel"):
            return col(f"{var}{SEP}{'id' if kind == 'node' else 'eid'}")
        if name == "type" and kind == "rel":
            return col(f"{var}{SEP}type")
        if name == "labels" and kind == "node":
            return F.array(col(f"{var}{SEP}label"))
        if name in ("startnode", "endnode") and kind == "rel":
            return col(f"{var}{SEP}{'src' if name == 'startnode' else 'dst'}")
        if name == "length" and kind == "path":
            return col(f"{var}{SEP}length")
        if name == "nodes" and kind == "path":
            return col(f"{var}{SEP}ids")
        if name == "keys" and kind in ("node", "rel") and not self.graph.typed:
            return F.map_keys(col(f"{var}{SEP}props"))
        if name == "properties" and kind in ("node", "rel") and not self.graph.typed:
            return col(f"{var}{SEP}props")
        if name == "exists" and args:
            return self.presence(args[0], env).isNotNull()
        if name == "size" and kind == "rels":
            return F.size(col(f"{var}{SEP}eids")).cast("long")
        if name in AGGREGATES:
            return self.aggregate(env, name, args, distinct)
        values = [self.value(a, env) for a in args]
        if name == "size":
            text = args[0][0] == "lit" or self.is_property(args[0], env) or (args[0][0] == "call" and args[0][1] in ("tostring", "toupper", "tolower", "trim", "substring", "replace", "left", "right"))
            return F.length(values[0]).cast("long") if text else F.size(values[0]).cast("long")
        if name not in _STRING_FUNCTIONS:
            raise CypherSemanticError(f"there is no function {name}")
        return _STRING_FUNCTIONS[name](*values)

    def aggregate(self, env: Env, name: str, args: list, distinct: bool) -> Column:
        c = self.presence(args[0], env) if name == "count" else self.value(args[0], env)
        if name in ("sum", "avg", "stdev", "stdevp") and not self.graph.typed and self.is_property(args[0], env):
            c = _number(c)
        if name == "count":
            return F.count_distinct(c) if distinct else F.count(c)
        if distinct and name not in ("collect", "sum", "min", "max"):
            arg = self.new("arg")
            env.df = (env.df if env.df is not None else self.spark.range(1).select()).withColumn(arg, _number(c) if name.startswith("percentile") else c)
            if name.startswith("percentile"):
                share = float(self.constant(args[1]))
                return F.expr(f"percentile(DISTINCT `{arg}`, {share!r})") if name.endswith("cont") else F.array_sort(F.collect_set(arg))[F.greatest(F.ceil(F.size(F.collect_set(arg)) * share) - 1, F.lit(0)).cast("int")]
            return F.expr(f"{ {'avg': 'avg', 'stdev': 'stddev_samp', 'stdevp': 'stddev_pop'}[name] }(DISTINCT `{arg}`)")
        if name == "collect":
            return F.collect_set(c) if distinct else F.collect_list(c)
        if name.startswith("percentile"):
            share = self.constant(args[1])
            return F.percentile(_number(c), share) if name.endswith("cont") else F.percentile_approx(_number(c), share)
        return {"sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stdev": F.stddev_samp, "stdevp": F.stddev_pop}[name](c)

    # ------------------------------------------------------------------ updates: a new graph
    def do_create(self, env: Env, data: dict) -> Env:
        rows = env.df if env.df is not None else self.spark.range(1).select(F.lit(1).alias("_one"))
        env = Env(rows, dict(env.kinds))
        g = self.graph.to_map()
        self.graph = g
        vertices, edges = g.vertices, g.edges
        for path in data["paths"]:
            for n in path.nodes:
                if env.has(n.var):
                    continue
                if "id" not in n.props:
                    raise CypherSemanticError("a new node needs the property id")
                label = n.labels[0] if n.labels else None
                props = self.props_map(env, n.props | ({"label": ("lit", label)} if label else {}))
                ident = self.value(n.props["id"], env).cast("string")
                env.df = env.df.withColumns({f"{n.var}{SEP}id": ident, f"{n.var}{SEP}label": F.lit(label).cast("string"), f"{n.var}{SEP}props": props, f"{n.var}{SEP}pid": F.lit(0)})
                env.kinds[n.var] = "node"
                new = env.df.select(*[col(f"{n.var}{SEP}{c}").alias(c) for c in ("id", "label", "props", "pid")]).dropDuplicates(["id"])
                vertices = vertices.unionByName(new.join(vertices.select("id"), "id", "left_anti"))
            for i, r in enumerate(path.rels):
                if r.direction == "any" or len(r.types) != 1:
                    raise CypherSemanticError("a new relationship needs a direction and one type")
                a, b = (path.nodes[i], path.nodes[i + 1])[:: 1 if r.direction == "out" else -1]
                new = self.new_edges(env, r, a.var, b.var)
                env.df = env.df.withColumns({f"{r.var}{SEP}{k}": c for k, c in new.items()})
                env.kinds[r.var] = "rel"
                edges = edges.unionByName(env.df.select(*[col(f"{r.var}{SEP}{k}").alias(k) for k in new]))
        self.graph = replace(g, vertices=vertices, edges=edges)
        return env

    def props_map(self, env: Env, props: dict) -> Column:
        pairs = [x for k, v in props.items() for x in (F.lit(k), self.value(v, env).cast("string"))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    def new_edges(self, env: Env, r: Rel, a: str, b: str) -> dict[str, Column]:
        props = self.props_map(env, r.props | {"type": ("lit", r.types[0])})
        src, dst = col(f"{a}{SEP}id").cast("string"), col(f"{b}{SEP}id").cast("string")
        if "id" in r.props:
            eid = self.value(r.props["id"], env).cast("string")
        else:  # one number for the clause, and one for the place among its edges of the same ends: the same however often the plan runs
            among = Window.partitionBy(src, dst).orderBy(F.to_json(props))
            eid = F.concat_ws(":", src, F.lit(r.types[0]), dst, F.lit(uuid.uuid4().hex), F.row_number().over(among).cast("string"))
        return {"eid": eid, "src": src, "dst": dst, "type": F.lit(r.types[0]), "props": props}

    def do_merge(self, env: Env, data: dict) -> Env:
        path: Path = data["path"]
        self.graph = self.graph.to_map()
        if not path.rels:
            n = path.nodes[0]
            found = self.node_rows(n)
            missing = found.isEmpty()
            if missing:
                env = self.do_create(env, {"paths": [path]})
            else:
                env = self.bind_node(env, n)
            items = data["create"] if missing else data["match"]
            return self.do_set(env, {"items": items}) if items else env
        return self.merge_pattern(env, path, data)

    def merge_pattern(self, env: Env, path: Path, data: dict) -> Env:
        """The whole pattern is matched; for bindings without a match all of it that is not bound is created, once for each binding."""
        bound = [v for v in env.kinds if v in self.variables([path])]
        before = Env(env.df, dict(env.kinds))
        found = self.match(Env(before.df, dict(before.kinds)), [path], None)
        if before.df is None:
            made, missing = found.df.isEmpty(), Env(None, {})
        else:
            keys = [c for v in bound for c in self.identity(before, v)]
            rows = before.df.dropDuplicates(keys) if keys else before.df.limit(1)
            there = found.df.select([col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
            test = F.lit(True)
            for i, c in enumerate(keys):
                test = test & col(c).eqNullSafe(col(f"_k{i}"))
            missing, made = Env(rows.join(there, test, "left_anti"), dict(before.kinds)), True
        turned = replace(path, rels=[replace(r, direction="out") if r.direction == "any" else r for r in path.rels])
        if made:
            made_rows = self.do_create(missing, {"paths": [turned]})
            if data["create"]:
                self.do_set(made_rows, {"items": data["create"]})
        if data["match"] and (before.df is not None or not made):
            self.do_set(found, {"items": data["match"]})
        return self.match(Env(before.df, dict(before.kinds)), [path], None)

    def do_set(self, env: Env, data: dict) -> Env:
        self.graph = self.graph.to_map()
        for item in data["items"]:
            kind, var = item[0], item[1]
            of, key = ("vertices", "id") if env.kinds.get(var) == "node" else ("edges", "eid")
            if env.kinds.get(var) not in ("node", "rel"):
                raise CypherSemanticError(f"{var} is not a node or relationship")
            if kind == "label":
                change = F.lit(item[2])
            elif kind == "property":
                change = self.props_map(env, {item[2]: item[3]})
            else:
                change = self.props_map(env, dict(item[2][1]))
            changes = env.df.select(col(f"{var}{SEP}{key}").alias("_k"), change.alias("_v")).dropDuplicates(["_k"])
            df = getattr(self.graph, of)
            joined = df.join(changes, df[key] == F.col("_k"), "left")
            if kind == "label":
                df = joined.withColumn("label", F.coalesce("_v", "label"))
            else:
                kept = F.create_map().cast("map<string,string>") if kind == "replace" else F.map_filter("props", lambda k, v: ~F.array_contains(F.map_keys("_v"), k))
                merged = F.map_filter(F.map_concat(kept, "_v"), lambda k, v: v.isNotNull())
                df = joined.withColumn("props", F.when(F.col("_k").isNotNull(), merged).otherwise(F.col("props")))
            self.graph = replace(self.graph, **{of: df.drop("_k", "_v")})
        return self.rebound(env)

    def rebound(self, env: Env) -> Env:
        """Rows that a later clause sees hold the changed properties."""
        df = env.df
        for var, kind in env.kinds.items():
            if kind not in ("node", "rel"):
                continue
            of, key = ("vertices", "id") if kind == "node" else ("edges", "eid")
            now = getattr(self.graph, of).select(F.col(key).alias("_k"), F.col("props").alias("_p"))
            df = df.join(now, col(f"{var}{SEP}{key}") == F.col("_k"), "left").withColumn(f"{var}{SEP}props", F.col("_p")).drop("_k", "_p")
        return Env(df, env.kinds)

    def do_delete(self, env: Env, data: dict) -> Env:
        self.graph = g = self.graph.to_map()
        vertices, edges = g.vertices, g.edges
        for var in data["vars"]:
            if env.kinds.get(var) == "rel":
                edges = edges.join(env.df.select(col(f"{var}{SEP}eid").alias("eid")), "eid", "left_anti")
                continue
            if env.kinds.get(var) != "node":
                raise CypherSemanticError(f"{var} is not a node or relationship")
            gone = env.df.select(col(f"{var}{SEP}id").alias("_id")).distinct()
            if not data["detach"] and any(not edges.join(gone, edges[end] == F.col("_id"), "left_semi").isEmpty() for end in ("src", "dst")):
                raise CypherSemanticError("a node with relationships needs DETACH DELETE")
            vertices = vertices.join(gone, vertices["id"] == F.col("_id"), "left_anti")
            for end in ("src", "dst"):
                edges = edges.join(gone, edges[end] == F.col("_id"), "left_anti")
        self.graph = replace(g, vertices=vertices, edges=edges)
        return env

    def do_remove(self, env: Env, data: dict) -> Env:
        self.graph = self.graph.to_map()
        for kind, var, name in data["items"]:
            of, key = ("vertices", "id") if env.kinds.get(var) == "node" else ("edges", "eid")
            chosen = env.df.select(col(f"{var}{SEP}{key}").alias("_k")).distinct()
            df = getattr(self.graph, of)
            joined = df.join(chosen, df[key] == F.col("_k"), "left")
            hit = F.col("_k").isNotNull()
            if kind == "label":
                df = joined.withColumn("label", F.when(hit & (F.col("label") == name), F.lit(None)).otherwise(F.col("label")))
            else:
                df = joined.withColumn("props", F.when(hit, F.map_filter("props", lambda k, v: k != name)).otherwise(F.col("props")))
            self.graph = replace(self.graph, **{of: df.drop("_k")})
        return self.rebound(env)


def run(spark: SparkSession, graph: MapGraph | TableGraph, text: str, params: dict | None = None, procedures: dict | None = None) -> Result:
    return Compiler(spark, graph, params, procedures).run(text)
