"""Operators without SQL against plain Python, and operators that stop, resume or take odd inputs."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import queries as catalogue
from loomgraph.model import MapGraph
from loomgraph.operators import algorithms, knowledge, link_prediction, vector_search
from loomgraph.plans.compiler import CypherSemanticError, run
from loomgraph.session import GraphSession
from loomgraph.sources import views
from loomgraph.streaming import triangles as stream

RNG = random.Random(4)


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def small_world(n=1500, extra=0.1):
    """A ring whose vertices know the next two, some edges bent elsewhere."""
    pairs = set()
    for i in range(n):
        for d in (1, 2):
            j = RNG.randrange(n) if RNG.random() < extra else (i + d) % n
            if i != j:
                pairs.add((min(i, j), max(i, j)))
    return sorted(pairs)


def test_counts_of_a_generated_graph(spark):
    pairs = small_world()
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = sum(len(near[a] & near[b]) for a, b in pairs) // 3
    e = graph(spark, pairs)
    assert want > 500
    assert [algorithms.edge_count(e).first()[0], algorithms.vertex_count(e).first()[0]] == [len(pairs), len(near)]
    assert algorithms.triangle_count(e).first()[0] == algorithms.triangles(e).count() == want


def test_numbering_is_dense_and_in_order(spark):
    names = [f"k{RNG.randrange(10**6)}" for _ in range(3000)]
    got = sorted((r.name, r.id) for r in algorithms.numbered(spark.createDataFrame([(n,) for n in set(names)], "name string"), "name", 5).collect())
    assert got == [(n, i + 5) for i, n in enumerate(sorted(set(names)))]
    assert algorithms.numbered(spark.createDataFrame([], "name string"), "name").count() == 0


def brute_stream_partition(edges, n, method):
    where, sizes, near = {}, [0] * n, collections.defaultdict(set)
    m, vertices = len(edges), len({x for e in edges for x in e})
    copies = collections.defaultdict(collections.Counter)
    for a, b in edges:
        for v, other in ((a, b), (b, a)):
            if v not in where:
                if other in where:
                    copies[where[other]][v] += 1

                def score(p):
                    inside = copies[p][v]
                    if method == "ldg":
                        return max(1, inside) * (1 - sizes[p] / max(1.0, vertices / n))
                    return inside - m * n**0.5 / vertices**1.5 * ((sizes[p] + 1) ** 1.5 - sizes[p] ** 1.5)

                where[v] = max(range(n), key=lambda p: (score(p), -p))
                sizes[where[v]] += 1
            copies[where[v]][other] += 1
            near[v].add(other)
    return where


@pytest.mark.parametrize("method", ["fennel", "ldg"])
def test_stream_partitioners_against_the_formula(spark, method):
    pairs = [(RNG.randrange(60), RNG.randrange(60)) for _ in range(300)]
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "o long, src long, dst long")
    got = {r.id: r.pid for r in algorithms.stream_partition(df, 4, method, "o").collect()}
    assert got == brute_stream_partition(pairs, 4, method)


def test_label_partition_cuts_less_and_stays_even(spark):
    """Four dense groups with few edges between them; the start by hash cuts three quarters of the edges."""
    pairs = [(100 * g + RNG.randrange(100), 100 * g + RNG.randrange(100)) for g in range(4) for _ in range(900)] + [(RNG.randrange(400), RNG.randrange(400)) for _ in range(60)]
    parts = {r.id: r.pid for r in algorithms.label_partition(graph(spark, pairs), 4, rounds=12).collect()}
    assert set(parts) == {x for p in pairs for x in p}
    sizes = collections.Counter(parts.values())
    assert max(sizes.values()) <= 1.1 * len(parts) / 4 + 2
    cut = sum(parts[a] != parts[b] for a, b in pairs) / len(pairs)
    assert cut < 0.55


def test_beam_search_against_brute_force(spark):
    size, hops, width, seeds = 6, 3, 10, 5
    vectors = {i: [RNG.uniform(-1, 1) for _ in range(size)] for i in range(40)}
    edges = [(f"e{i}", RNG.randrange(40), RNG.randrange(40), "T") for i in range(90)]
    query = [RNG.uniform(-1, 1) for _ in range(size)]

    def cos(v):
        return sum(a * b for a, b in zip(v, query, strict=True)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in query))

    start = sorted((sum((a - b) ** 2 for a, b in zip(v, query, strict=True)), i) for i, v in vectors.items())[:seeds]
    beam = [([i], [], cos(vectors[i])) for _, i in start]
    both = [(e, a, b) for e, a, b, _ in edges] + [(e, b, a) for e, a, b, _ in edges if a != b]
    for _ in range(hops):
        beam = [(nodes + [b], rels + [e], s + cos(vectors[b])) for nodes, rels, s in beam for e, a, b in both if a == nodes[-1] and (not rels or rels[-1] != e)]
        beam = sorted(beam, key=lambda x: (-x[2], x[1], x[0]))[:width]
    v = spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>")
    got = vector_search.beam_search(v, spark.createDataFrame(edges, "eid string, src long, dst long, type string"), query).collect()
    assert [(list(r.path_nodes), list(r.path_rels)) for r in got] == [(n, r) for n, r, _ in beam]
    assert [r.score for r in got] == pytest.approx([s for *_, s in beam])


def test_link_model_with_vectors_is_saved_and_loaded(spark, tmp_path):
    rng = random.Random(8)  # edges are mostly inside groups, which the vectors tell
    groups = [[g * 60 + i for i in range(60)] for g in range(4)]
    pairs = [tuple(rng.sample(g, 2)) for g in groups for _ in range(300)] + [(rng.randrange(240), rng.randrange(240)) for _ in range(300)]
    e = graph(spark, pairs)
    vectors = spark.createDataFrame([(v, [float(g == k) + rng.uniform(-0.2, 0.2) for k in range(4)]) for g, vs in enumerate(groups) for v in vs], "id long, embedding array<double>")
    plain, rich = link_prediction.train(e), link_prediction.train(e, vectors=vectors)
    assert 0.5 < plain.auc <= 1 and rich.auc > 0.6
    rich.save(f"file://{tmp_path}/model")
    again = link_prediction.Trained.load(f"file://{tmp_path}/model")
    assert again.auc == rich.auc
    a, b = ({(r.a, r.b): r.probability for r in m.predict(e, vectors).collect()} for m in (rich, again))
    assert a == pytest.approx(b, abs=1e-9) and all(0 <= p <= 1 for p in a.values())  # sums come in any order


# --------------------------------------------------------------------------- Cypher
def test_relationships_keep_their_ids_after_a_shuffle(spark):
    v = spark.createDataFrame([(str(i), "N", {"id": str(i), "g": str(i % 3)}, 0) for i in range(30)], "id string, label string, props map<string,string>, pid int")
    g = MapGraph(v, spark.createDataFrame([], "eid string, src string, dst string, type string, props map<string,string>"))
    g = run(spark, g, "MATCH (a:N), (b:N) WHERE a.g = b.g AND a.id < b.id CREATE (a)-[:SAME]->(b), (a)-[:SAME]->(b)").graph
    ids = [sorted(r.eid for r in g.edges.repartition(n).select("eid").collect()) for n in (1, 5)]
    assert ids[0] == ids[1] and len(set(ids[0])) == len(ids[0]) > 100
    one = ids[0][0]
    left = run(spark, g, "MATCH (a)-[r]->(b) WHERE id(r) = $one DELETE r", {"one": one}).graph
    assert left.edges.count() == len(ids[0]) - 1


def test_plain_delete_needs_nodes_without_relationships(spark):
    v = spark.createDataFrame([("1", "N", {"id": "1"}, 0), ("2", "N", {"id": "2"}, 0), ("3", "N", {"id": "3"}, 0)], "id string, label string, props map<string,string>, pid int")
    g = MapGraph(v, spark.createDataFrame([("e", "1", "2", "T", {"type": "T"})], "eid string, src string, dst string, type string, props map<string,string>"))
    for i in (1, 2):
        with pytest.raises(CypherSemanticError):
            run(spark, g, f"MATCH (n) WHERE n.id = {i} DELETE n")
    assert run(spark, g, "MATCH (n) WHERE n.id = 3 DELETE n").graph.vertices.count() == 2
    made = run(spark, g, "MATCH (a {id: '1'}) MERGE (a)-[:T]->(b:N {id: '2'}) ON CREATE SET b.x = 'new' ON MATCH SET b.x = 'old'").graph
    assert made.edges.count() == 1 and [tuple(r) for r in run(spark, made, "MATCH (b {id: '2'}) RETURN b.x AS x").rows.collect()] == [("old",)]
    made = run(spark, g, "MATCH (a {id: '3'}) MERGE (a)-[:T]->(b:N {id: '9'}) ON CREATE SET b.x = 'new'").graph
    assert made.edges.count() == 2 and [tuple(r) for r in run(spark, made, "MATCH (a)-[:T]->(b {id: '9'}) RETURN a.id AS a, b.x AS x").rows.collect()] == [("3", "new")]


def test_open_walks_go_to_their_end(spark):
    v = spark.createDataFrame([(str(i), "N", {"id": str(i)}, 0) for i in range(14)], "id string, label string, props map<string,string>, pid int")
    e = spark.createDataFrame([(f"e{i}", str(i), str(i + 1), "T", {"type": "T"}) for i in range(13)], "eid string, src string, dst string, type string, props map<string,string>")
    g = MapGraph(v, e)
    assert run(spark, g, "MATCH (a {id: '0'})-[*]->(b) RETURN count(*) AS n").rows.first()[0] == 13
    assert run(spark, g, "MATCH (a {id: '0'})-[*3..]->(b) RETURN count(*) AS n").rows.first()[0] == 11


def test_events_with_broken_properties_are_left_out(spark, tmp_path):
    rows = [(1, 5, "a", '{"k": 7}'), (2, 5, "a", '{"k": "x"}'), (3, 5, "a", "broken"), (4, None, "a", '{"k": 7}')]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"file://{tmp_path}/events.parquet")
    assert [tuple(r) for r in views.event_edges(spark, f"file://{tmp_path}").select("src", "dst").collect()] == [(5, 7)]


def test_vector_queries_without_vector_zero(spark, tmp_path):
    spark.createDataFrame([(3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert [r.vec_id for r in catalogue.QUERIES["cosine_topk"](spark, f"file://{tmp_path}").collect()][:2] == [3, 4]


# --------------------------------------------------------------------------- streams and knowledge graphs
def test_the_end_mark_stops_a_stream_and_it_can_go_on(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    record = '{"source":{"id":"%d","properties":{}},"destination":{"id":"%d","properties":{}},"properties":{}}'
    ring = lambda b: "\n".join(record % e for e in ((b, b + 1), (b + 1, b + 2), (b + 2, b)))
    (tmp_path / "in" / "1.txt").write_text(ring(0) + "\n-1\n")
    s = GraphSession(spark)

    def ended() -> bool:
        for _ in range(600):
            if not [q for q in spark.streams.active if q.name == "ending"]:
                return True
            time.sleep(0.1)
        return False

    s.run_command(f"adstrmk|ending|file://{tmp_path}/in|file://{tmp_path}/st")
    assert ended() and s.run_command("strian|ending|1").first()[0] == 1
    (tmp_path / "in" / "2.txt").write_text(ring(10) + "\n-1\n")
    s.run_command(f"adstrmk|ending|file://{tmp_path}/in|file://{tmp_path}/st")
    assert ended() and s.run_command("strian|ending|1").first()[0] == 2


def test_deduplication_keeps_edges_without_id(spark):
    e = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (1, 2, None), (1, 2, None)], "src long, dst long, eid string")
    assert stream.deduplicated(e).count() == 3


def test_windows_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ts":"2024-01-01T00:10:00","type":"a"}\n{"ts":"2024-01-01T00:50:00","type":"a"}\n{"ts":"2024-01-01T01:10:00","type":"a"}\n')
    lines = spark.readStream.schema("ts timestamp, type string").json(f"file://{tmp_path}/in")
    q = stream.windowed_edges(lines).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n_edges for r in spark.table("windows").collect()) == [1, 2]


def test_construction_stops_and_goes_on(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Thing{i} likes other{i % 3} very much. Odd one") for i in range(40)], "doc_id long, text string")
    s, calls = GraphSession(spark), []

    def stopped() -> bool:
        calls.append(1)
        return len(calls) > 3

    texts = knowledge.sentences(docs)
    assert knowledge.extract_in_parts(texts, f"file://{tmp_path}/kg", parts=8, stopped=stopped) is None
    whole = knowledge.extract_in_parts(texts, f"file://{tmp_path}/kg", parts=8)
    assert len(calls) == 4 and whole.count() == 40
    s.construct_knowledge_graph("k", docs, state=f"file://{tmp_path}/kg2")
    assert s.run_command("cypher|k|MATCH (a)-[r:likes]->(b) RETURN count(*) AS n").first()[0] == 40
    assert s.run_command("stop-constructkg|k") == "done" and s.run_command("sla").count() >= 2


def test_extractors_are_asked_again_after_an_error():
    tries = []

    def weak(text):
        tries.append(text)
        if len(tries) < 3:
            raise OSError("busy")
        yield from knowledge.sentence_tuples(text)

    assert list(knowledge.with_retries(weak, 3, 0)("a b c d")) == [("a", "b", "c d", "Entity", "Entity")] and len(tries) == 3


def test_model_and_search_commands(spark, tmp_path):
    (tmp_path / "e.txt").write_text("\n".join(f"{i} {(i + d) % 40}" for i in range(40) for d in (1, 2, 3)))
    s = GraphSession(spark)
    s.run_command(f"adgr|g|file://{tmp_path}/e.txt")
    assert s.run_command(f"train|g|file://{tmp_path}/model").startswith("auc ")
    assert s.run_command(f"admdl|m|file://{tmp_path}/model") == "model m"
    assert s.run_command("predict|g|m").columns == ["a", "b", "probability"]
    spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(40)], "id string, embedding array<double>").write.parquet(f"file://{tmp_path}/v")
    assert s.run_command(f"sbs|g|file://{tmp_path}/v|3,1").count() == 10


def test_the_package_can_be_sent_to_executors(spark):
    import loomgraph

    loomgraph.ship(spark)
    assert any(f.endswith("loomgraph.zip") for f in spark.sparkContext.listFiles)

    def where(_):
        import loomgraph.operators.algorithms as a

        return [a.__name__]

    assert set(spark.sparkContext.parallelize(range(2), 2).mapPartitions(where).collect()) == {"loomgraph.operators.algorithms"}
