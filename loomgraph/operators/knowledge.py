"""Knowledge graphs from text: chunks or sentences, a pluggable extractor of tuples, canonical ids, and the graph.

``extract_in_parts`` writes the tuples part by part and can be stopped and taken up again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_name, entity_id
from ..model import MapGraph

Tuple5 = tuple[str, str, str, str, str]  # subject, predicate, object, subject type, object type


def chunks(docs: DataFrame, size: int = 1000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk, start, text: cuts of ``size`` characters; empty texts give none."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    rows = docs.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return rows.select(key, "chunk", (F.col("chunk") * size).alias("start"), F.substring("_t", F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk, text: the whole text cut at full stops and line ends, so that no sentence is split between chunks."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), r"[.\n]+")).alias("chunk", "text"))
    return parts.where(F.trim("text") != "")


def sentence_tuples(text: str) -> Iterator[Tuple5]:
    """A deterministic stand-in for a model: the first word of a sentence, its second, and all the others make a tuple."""
    for sentence in text.replace("\n", ".").split("."):
        words = sentence.split()
        if len(words) >= 3:
            yield words[0], words[1], " ".join(words[2:]), "Entity", "Entity"


def with_retries(extractor: Callable[[str], Iterator[Tuple5]], attempts: int = 3, pause: float = 1.0) -> Callable[[str], Iterator[Tuple5]]:
    """The extractor, asked again after an error (each pause twice the one before); the last error is raised."""

    def run(text: str) -> Iterator[Tuple5]:
        import time

        for attempt in range(attempts):
            try:
                found = list(extractor(text))
                break
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(pause * 2**attempt)
        yield from found

    return run


def extract(texts: DataFrame, extractor: Callable[[str], Iterator[Tuple5]] = sentence_tuples) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [t for x in pdf.text for t in extractor(x or "")]
            yield pd.DataFrame(rows, columns=["subject", "predicate", "object", "subject_type", "object_type"], dtype="object")

    return texts.select("text").mapInPandas(run, "subject string, predicate string, object string, subject_type string, object_type string")


def extract_in_parts(texts: DataFrame, path: str, extractor: Callable[[str], Iterator[Tuple5]] = sentence_tuples, parts: int = 16, stopped: Callable[[], bool] = lambda: False) -> DataFrame | None:
    """Tuples of all texts, written under path in so many parts, dealt by a hash of the text.

    A part that is there already is not extracted again, so a run that failed or was stopped goes on where it ended. Returns
    the tuples, or None if ``stopped`` said so before the last part.
    """
    spark = texts.sparkSession
    jvm = spark.sparkContext._jvm
    for part in range(parts):
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            continue
        if stopped():
            return None
        extract(texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part), extractor).write.mode("overwrite").parquet(f"{path}/part={part}")
    return spark.read.parquet(path).drop("part")


def build(tuples: DataFrame) -> MapGraph:
    """Nodes by canonical id, so that mentions of one name and type meet; one relationship per distinct (subject, predicate, object)."""
    t = tuples.select(
        entity_id(F.col("subject"), F.col("subject_type")).alias("src"), entity_id(F.col("object"), F.col("object_type")).alias("dst"), canonical_name(F.col("predicate")).alias("type"),
        "subject", "subject_type", "object", "object_type",
    )
    ends = t.select(F.col("src").alias("id"), F.col("subject").alias("name"), F.col("subject_type").alias("label")).unionByName(t.select(F.col("dst").alias("id"), F.col("object").alias("name"), F.col("object_type").alias("label")))
    nodes = ends.groupBy("id").agg(F.min("name").alias("name"), F.min("label").alias("label"))
    vertices = nodes.select("id", "label", F.create_map(F.lit("name"), F.col("name"), F.lit("label"), F.col("label")).alias("props"), F.lit(0).alias("pid"))
    links = t.groupBy("src", "type", "dst").agg(F.count("*").alias("n"))
    edges = links.select(F.concat_ws("|", "src", "type", "dst").alias("eid"), "src", "dst", "type", F.create_map(F.lit("type"), F.col("type"), F.lit("mentions"), F.col("n").cast("string")).alias("props"))
    return MapGraph(vertices, edges, directed=True, name="knowledge")
