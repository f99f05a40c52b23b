"""Every operator and every pipeline stage on odd tables: nulls, empty and very long texts, repeated rows, no rows, clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from loomgraph.llm import bpe, language, lm_scoring, near_dup, packing, search, substring, token_store, toxicity  # noqa: E402
from loomgraph.llm.embedding_dedup import near_embeddings  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
# names that plans use inside
CLASH = "row key id ids keys rests component part block range starts doc tie n n_words n_removed score lang_pred lang_score lang_known length rank sequence_id a b weight node salt __gone __starts __tie __doc toxic at".split()
RNG = random.Random(5)
LONG = " ".join(f"word{RNG.randrange(4000)}" for _ in range(250_000))  # over 2 MB
PLAIN = " ".join(f"plain{RNG.randrange(300)}" for _ in range(80))
ROWS = [(1, PLAIN), (1, PLAIN), (1, "another text under the same number"), (None, PLAIN), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, "!?"), (6, LONG), (7, LONG + " end"), (8, PLAIN + " more")]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('wide')}/documents.parquet"
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    df.select("*", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(7).cast("long").alias("n_chars"), *[F.lit(f"own {c}").alias(c) for c in CLASH]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (8, 0), (6, 0), (None, 1), (3, None)], "doc_id long, toxic int")


def filters(spark, wide, labels):
    model, known = toxicity.train(wide, labels), language.learn(wide)
    return {
        "near_duplicates": near_dup.near_duplicates,
        "lm_scoring": lm_scoring.score,
        "bpe": lambda d: bpe.round_trip(d, WORD),
        "toxicity": lambda d: toxicity.score(d, model),
        "substring": substring.dedup,
        "cut": substring.cut,
        "language": lambda d: language.predict(d, known),
    }


def test_one_row_out_for_each_row_in(spark, wide, labels):
    empty = spark.createDataFrame([], wide.schema)
    for name, f in filters(spark, wide, labels).items():
        out = f(wide)
        assert sorted((r.doc_id or 0) for r in out.select("doc_id").collect()) == sorted(i or 0 for i, _ in ROWS), name
        assert f(empty).count() == 0, name


def test_own_columns_stay(spark, wide, labels):
    model, known = toxicity.train(wide, labels), language.learn(wide)
    for f in (near_dup.keep_one, substring.cut, lambda d: toxicity.keep_clean(d, model), lambda d: language.identified(d, known)):
        out = f(wide)
        assert out.columns == wide.columns
        assert all(r[c] == f"own {c}" for r in out.drop("text").collect() for c in CLASH)
    assert set(substring.dedup(wide).columns) == set(wide.columns) and {r.n_words for r in substring.dedup(wide).where("doc_id = 3").collect()} == {0}
    assert {r["score"] for r in toxicity.score(wide, model).collect()} != {"own score"}


def test_near_duplicates_of_long_and_repeated_texts(wide):
    got = [(r.doc_id, r.class_id, r.n_links, r.kept) for r in near_dup.near_duplicates(wide).collect()]
    assert {g for g in got if g[0] in (6, 7)} == {(6, 6, 1, True), (7, 6, 1, False)}
    assert {g for g in got if g[0] in (1, 8)} == {(1, 1, 1, True), (8, 1, 1, False)}
    assert [g for g in got if g[0] is None] == [(None, None, 0, True)] * 2


def test_search_of_odd_tables(wide):
    rows = search.search(wide, wide.where("doc_id in (2, 3, 6, 8)"), k=3).collect()
    assert {r.query_id for r in rows} == {6, 8}  # null and empty texts find nothing
    assert {r.doc_id for r in rows if r.query_id == 6} == {6, 7} and {r.doc_id for r in rows if r.query_id == 8} >= {1, 8}
    assert search.search(wide.limit(0), wide).count() == 0


def test_packing_and_store_of_odd_tables(spark, wide, tmp_path):
    packed = packing.pack(wide, BYTE, 1)
    by_doc = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    stored = token_store.TokenStore(spark, f"file://{tmp_path}/s").write(wide, BYTE, 2).read_lengths_and_crc().groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in by_doc} == {r.doc_id: r.n for r in stored}
    assert packing.pack(wide.limit(0), BYTE, 1).count() == 0


def test_a_store_refuses_ids_that_do_not_fit(spark, wide, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        token_store.TokenStore(spark, f"file://{tmp_path}/narrow", 256).write(wide, BYTE, 70_000)


def test_stages_on_odd_and_empty_tables(spark, wide, labels, tmp_path):
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for docs in (wide, spark.createDataFrame([], wide.schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, f"file://{tmp_path}")
            if name == "packing":
                assert set("doc_id start length ids_crc32 doc_tokens sequence_id offset".split()) <= set(out.columns)
            else:
                assert out.schema.names == wide.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in wide.schema], name
            n = out.count()
            assert n == 0 if docs is not wide else n >= 1, name


def test_embeddings_of_any_size_and_repeated_ids(spark):
    rows = [(1, [1e-200] * 8, 0), (2, [1.0] + [0.0] * 7, 0), (3, [1e200] * 8, 0), (4, [2e200] * 8, 0), (5, [0.5] * 8, 0), (5, [0.5] * 8, 0), (6, [], 0), (7, [float("inf")] * 8, 0), (8, [1.0] * 8, None), (8, [1.0] * 8, 0), (9, [0.0] * 7 + [1.0], 0), (9, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(c).alias(c) for c in ("id", "k1", "weight", "component", "salt", "n_links", "of")])
    got = near_embeddings(df).select("vec_id", "n_links", "component_id", "kept").collect()
    by = {r.vec_id: tuple(r)[1:] for r in got}
    assert len(got) == len(rows)
    assert by[1][1] == by[3][1] == by[4][1] == by[5][1] == by[8][1] == 1 and by[1][0] >= 4
    assert by[2] == (0, 2, True) and by[6] == (0, 6, True) and by[7] == (0, 7, True)
