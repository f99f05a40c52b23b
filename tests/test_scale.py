"""Steps whose cost must not follow the square of a hub or carry what a result doesn't show."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomgraph import queries as catalogue
from loomgraph import session
from loomgraph.functions.vectors import cosine
from loomgraph.model import MapGraph
from loomgraph.operators import algorithms, link_prediction
from loomgraph.plans.compiler import run
from loomgraph.sources import views
from loomgraph.streaming import triangles as stream


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(df) -> list[int]:
    """Rows that the joins of the executed plan of a collected frame gave out."""
    found, queue = [], [df._jdf.queryExecution().executedPlan()]
    while queue:
        p = queue.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            queue.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            queue.append(p.plan())
            continue
        if "Join" in name and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        children = p.children()
        queue += [children.apply(i) for i in range(children.size())]
    return found


def test_triangles_are_counted_without_rows_of_lists_or_text(spark, sf):
    rng = random.Random(3)
    pairs = [(rng.randrange(-30, 60), rng.randrange(90)) for _ in range(1500)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = sum(len(near[a] & near[b]) for a in near for b in near[a]) // 6
    e = graph(spark, pairs)
    assert algorithms.triangle_count(e).first()[0] == want > 1000
    assert algorithms.triangle_count(e.select(F.concat(F.lit("x"), "src").alias("src"), F.concat(F.lit("x"), "dst").alias("dst"))).first()[0] == want
    called = session.PROCEDURES["algo.trianglecount"](views.copurchase_graph(spark, sf))
    assert "collect_list" not in plan(called) and "Part:" not in plan(called)


def test_new_triangles_pair_no_neighbours_of_a_hub(spark):
    rng = random.Random(5)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(500)) if a < b} | {(0, i) for i in range(1, 900)})
    fresh = set(rng.sample(pairs, 150))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    want = {(a, b, c) for a, b in pairs for c in near.get(b, ()) if c in near[a] and {(a, b), (a, c), (b, c)} & fresh}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "a long, b long")
    found = stream.new_triangles(frame(fresh), frame(pairs))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    # every row that the last join but one makes is an edge and a neighbour of its end of lower degree
    degree = {}
    for p in pairs:
        for v in p:
            degree[v] = degree.get(v, 0) + 1
    bound = sum(min(degree[a], degree[b]) for a, b in fresh)
    rows = made(found)
    assert rows and max(rows) <= max(bound, 2 * len(pairs))


def test_counts_of_pairs_make_no_row_for_a_pair(spark, sf):
    v = spark.createDataFrame([(str(i), "AB"[i % 2], {"id": str(i), "g": str(i % 3)}, 0) for i in range(12)], "id string, label string, props map<string,string>, pid int")
    rng = random.Random(6)
    rows = [(f"e{i}", str(rng.randrange(12)), str(rng.randrange(12)), "ST"[i % 2], {"w": str(i % 5)}) for i in range(70)]
    g = MapGraph(v, spark.createDataFrame(rows, "eid string, src string, dst string, type string, props map<string,string>"))
    for text in (
        "(a)-[:S]->(m)<-[:S]-(b) WHERE a <> b", "(a)-[:S]-(m)-[:T]-(b)", "(a:A)-[]->(m)-[:S]->(b:B)", "(a)-[r:S]-(m)-[s]-(b) WHERE b <> a AND r.w > 1 AND s.w < 4 AND m.g = 1", "(a)-[]-(m:A)-[]-(b)",
    ):
        for key in ("m.g AS g, ", ""):
            fast = run(spark, g, f"MATCH {text} RETURN {key}count(*) AS n").rows
            slow = run(spark, g, f"MATCH {text} WITH m AS m RETURN {key}count(*) AS n").rows
            assert sorted(map(tuple, fast.collect()), key=repr) == sorted(map(tuple, slow.collect()), key=repr)
    customers = spark.read.parquet(f"{sf}/customer.parquet").count()
    found = catalogue.QUERIES["var_compare"](spark, sf)
    found.collect()
    assert 0 < max(made(found)) <= customers


def test_all_pairs_are_made_on_all_cores(spark, sf):
    found = catalogue.QUERIES["cartesian_equi"](spark, sf)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pairs_in_blocks_are_those_of_the_joins(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(900)] + [(h, rng.randrange(-50, 250)) for h in (1, 2) for _ in range(150)]
    e = graph(spark, pairs)
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(0, 300, 2)] + [(1, [0.0, 0.0, 0.0])], "id long, embedding array<double>")
    text = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})
    near = link_prediction.aggregated(e, vectors)
    slow = algorithms.neighbour_scores(text(e, "src", "dst"))  # by joins
    for end in ("a", "b"):
        slow = slow.join(text(near, "id").select(F.col("id").alias(end), F.col("once").alias(f"once_{end}"), F.col("twice").alias(f"twice_{end}")), end, "left")
    cos = [F.coalesce(F.nanvl(cosine(F.col(f"{x}_a"), F.col(f"{x}_b")), F.lit(0.0)), F.lit(0.0)) for x in ("once", "twice")]
    row = lambda r: ((min(int(r[0]), int(r[1])), max(int(r[0]), int(r[1]))), (r[2], *(round(x, 9) for x in r[3:])))
    want = dict(map(row, slow.select("a", "b", "common", "jaccard", "adamic_adar", *cos).collect()))
    found = link_prediction.features(e, vectors).collect()
    got = dict(map(row, found))
    assert len(found) == len(got) and got == want and len(got) > 5000 and any(v[3] for v in got.values())
    assert link_prediction._n_pairs(e) == len(got)
    assert "Join" not in plan(algorithms.neighbour_scores(e)).split("MapInArrow")[0]  # pairs are made after all joins
    assert plan(algorithms.neighbour_scores(e)).count("Join") == 1


def test_scores_of_given_pairs_pass_by_hubs(spark):
    e = graph(spark, [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1, 400)])
    wanted = spark.createDataFrame([(0, i) for i in range(1, 200)], "a long, b long")
    found = algorithms.neighbour_scores(e, wanted)
    got = {(r.a, r.b): r.common for r in found.collect()}
    assert got == {(0, i): 1 + (i > 1) for i in range(1, 200)}
    assert 0 < max(made(found)) < 5000  # a row for each neighbour of the hub and pair would be 79,401


def test_beams_read_the_orders_of_their_parts_only(spark, sf):
    whole, ids = views.copurchase(spark, sf), [1, 5, 7]
    want = {(r.src, r.dst) for r in whole.where(F.col("src").isin(ids) | F.col("dst").isin(ids)).collect()}
    near = views.copurchase_around(spark, sf, ids)
    assert {(r.src, r.dst) for r in near.collect()} == want and want
    assert 0 < max(made(near)) < whole.count() / 10


def test_stream_partitioners_pass_packed_edges_to_their_task(spark):
    e = spark.range(30_000).select(F.col("id").alias("o"), (F.col("id") % 97).alias("src"), (F.col("id") % 89).alias("dst"))
    found = algorithms.stream_partition(e, 4, "ldg", "o")
    assert found.count() == 97
    assert "edges#" in plan(found) and "FlatMapGroups" not in plan(found)


def test_rounds_of_label_partition_read_kept_edges(spark):
    rng = random.Random(9)
    e = graph(spark, [(rng.randrange(200), rng.randrange(200)) for _ in range(900)])
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert algorithms.label_partition(e, 4, rounds=3).count() == 199
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() > before


def test_authors_of_articles_are_paired_without_a_join_of_pairs(spark, sf):
    found = catalogue.QUERIES["rdf_xml_roundtrip"](spark, sf)
    assert plan(found).count("Join") <= 2  # names to numbers only: of pairs none
