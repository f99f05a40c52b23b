"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the distinct 3- to 5-grams of the lower-cased text, hashed. ``train`` takes a bounded sample of labelled
rows (``max_per_class`` of each label, in the order of a hash of doc_id), computes each feature's log-count ratio
between toxic and clean rows, drops features that are rare or near balance, and fits a logistic regression on presence
times ratio. The bias is set for the true share of toxic rows. ``score`` sends the weights along with the tasks (their
size is fixed by ``BUCKETS``) and reads every whole text once.

Null and empty texts have no features and get the score of the bias. Rows with equal doc_id are scored one by one.
A null doc_id is not held out and is never learned from. Very long texts are read whole, as slices of their own. Without toxic or without
clean labelled rows, every score is the share of toxic rows (about 0 if there are no labels). Rows of the sample that tie in the hash
order go by doc_id, then by text. Extra columns are kept, whatever their names, but ``score`` replaces a column of that name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import lean_batches, text_slices

ORDERS = (3, 4, 5)
BUCKETS_LOG = 20
BUCKETS = 1 << BUCKETS_LOG
MAX_PER_CLASS = 3000  # labelled rows of each class that train() takes at most
MIN_ROWS = 4  # rows of the sample that hold a feature, at least
MIN_RATIO = 0.7  # absolute log-count ratio of a feature, at least
SMOOTHING = 1.0
STEPS, RATE, DECAY = 60, 0.3, 1e-3


def _features(raw: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct n-grams of each document; wanted: only those buckets count."""
    texts = [x.decode().lower() for x in raw]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    doc_parts, bucket_parts = [], []
    h = codes.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n not in ORDERS:
            continue
        mixed = (h ^ h >> np.uint32(15)) * np.uint32((0x2C1B3C6D + 2 * n) & 0xFFFFFFFF)
        bucket = (mixed ^ mixed >> np.uint32(12)) * np.uint32(0x297A2D39) >> np.uint32(32 - BUCKETS_LOG)
        at = np.flatnonzero(wanted[bucket]) if wanted is not None else np.arange(len(bucket))
        doc = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[doc]  # n-grams don't reach into the next document
        doc_parts.append(doc[inside])
        bucket_parts.append(bucket[at[inside]])
    if not doc_parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.unique(np.concatenate(doc_parts) << BUCKETS_LOG | np.concatenate(bucket_parts).astype(np.int64))
    return key >> BUCKETS_LOG, key & (BUCKETS - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fit(texts: list[bytes], toxic: np.ndarray, share: float) -> Model:
    """share: of toxic rows among all labelled rows."""
    toxic = toxic.astype(bool)
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS, np.float32), prior)
    parts = [(i, texts[i : i + 200]) for i in range(0, len(texts), 200)]
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for begin, part in parts:  # counts first, so that memory holds the features of use only
        d, b = _features(part)
        held = toxic[d + begin]
        p += np.bincount(b[held], minlength=BUCKETS)
        q += np.bincount(b[~held], minlength=BUCKETS)
    n_p, n_q = toxic.sum(), (~toxic).sum()
    ratio = np.log((p + SMOOTHING) / (n_p + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (n_q + 2 * SMOOTHING))
    ratio[(p + q < MIN_ROWS) | (np.abs(ratio) < MIN_RATIO)] = 0
    found = [(d + begin, b) for begin, part in parts for d, b in [_features(part, ratio != 0)]]
    doc, bucket = (np.concatenate([x[k] for x in found]).astype(np.int32) for k in (0, 1))
    del found
    scale = ratio[bucket]
    y, w, b = toxic.astype(float), np.zeros(BUCKETS), 0.0
    g2, gb2 = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(STEPS):  # full-batch AdaGrad
        z = b + np.bincount(doc, w[bucket] * scale, len(y))
        e = (_sigmoid(z) - y) / len(y)
        g = np.bincount(bucket, e[doc] * scale, BUCKETS) + DECAY * w
        g2 += g * g
        w -= RATE * g / np.sqrt(g2)
        gb2 += e.sum() ** 2
        b -= RATE * e.sum() / np.sqrt(gb2)
    return Model((w * ratio).astype(np.float32), b + prior - float(np.log(n_p / n_q)))


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")


def sample(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """doc_id, text, toxic: max_per_class labelled rows of each class at most, the first by a hash of doc_id."""
    labels = _labelled(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = labels.where("toxic = 1").orderBy(*order).limit(max_per_class).unionAll(labels.where("toxic = 0").orderBy(*order).limit(max_per_class))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # bounded by max_per_class
    rows = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    order = [F.xxhash64("doc_id"), "doc_id", "text"]  # repeated doc_ids bring more rows than labels
    return rows.where("toxic = 1").orderBy(*order).limit(max_per_class).unionAll(rows.where("toxic = 0").orderBy(*order).limit(max_per_class))


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (0 or 1; null: no label). One task holds at most 2 * max_per_class texts."""
    counts = {r.toxic: r.n for r in _labelled(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    lean_batches(docs.sparkSession)
    rows = sample(docs, labels, max_per_class).coalesce(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column("text").cast(pa.binary()).to_pylist()
            toxic += b.column("toxic").to_pylist()
        if texts:
            model = fit(texts, np.array(toxic), share)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    # one task fits the sample; only the weights come to the driver
    found = rows.mapInArrow(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(found.weights), np.float32), found.bias) if found else fit([], np.zeros(0), share)


def scores(model: Model, raw: list[bytes]) -> np.ndarray:
    doc, bucket = _features(raw, model.weights != 0)
    return _sigmoid(model.bias + np.bincount(doc, model.weights[bucket], len(raw)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and score, from 0 to 1; a column score that docs has is replaced."""
    spark = docs.sparkSession
    lean_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(shared.value, raw), pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents scored below the threshold, with the columns they came with."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return score(rows, model).where(F.col("score") < threshold).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, table(spark, sf_dir, "labels").where(~fold))
    return score(docs, model).select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
