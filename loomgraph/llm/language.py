"""Language identification by language-bitmask n-gram filters.

``learn`` counts the character 4-grams of a bounded sample of labelled documents (about ``max_docs`` of each language,
by a hash of doc_id), keeps those that make up at least ``MIN_SHARE`` of a language's n-grams (so at most 1 / MIN_SHARE
of each language), and enters them into one Bloom filter whose slots are bit masks, a bit for each language. One look-up
(the AND of ``PROBES`` slots) returns all languages that hold an n-gram. ``predict`` counts, for each language, the
n-grams of a text that hit its bit, takes off the false positives expected from the share of slots with that bit, and
answers the language with the most; its score is that language's part of all corrected counts.

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learned. A text
without a known n-gram gets the first learned language by name, with score 0. Ties go to the first by name. Rows with
equal doc_id are predicted one by one; a null doc_id is not held out and not learned from. Very long texts are read whole, as slices of
their own. Extra columns are kept, whatever their names, but ``predict`` replaces those named lang_pred, lang_score or lang_known. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import lean_batches, mix64, text_slices

N = 4
MAX_DOCS = 2000  # documents of each language that learn() reads, about
MAX_LANGUAGES = 512  # languages that learn() takes at most, the most frequent first
MIN_SHARE = 2e-5
PROBES = 3
SLOTS_LOG = 20
MIN_KNOWN = 0.2  # part of a text's n-grams that its language must hold, for identified()
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def _grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the words (with a space at either end), each document's first, and which documents have letters."""
    texts = [_NOT_LETTERS.sub(" ", " " + x.decode().lower() + " ") for x in raw]
    letters = np.array([bool(_LETTER.search(t)) for t in texts], bool)
    texts = [t.ljust(N) for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.zeros(max(0, len(codes) - N + 1), np.uint64)
    for i in range(N):
        h = h << np.uint64(16) ^ codes[i : i + len(h)] * np.uint64(0x9E3779B1)
    inside = np.ones(len(h), bool)
    ends = np.cumsum(sizes)
    for i in range(1, N):  # n-grams that reach into the next document
        inside[ends[:-1] - i] = False
    first = ends - sizes - np.arange(len(sizes)) * (N - 1)
    return mix64(h[inside]), first, letters


@dataclass
class Filter:
    languages: list[str]
    planes: np.ndarray  # slots × words of 64 languages
    false_positive: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> "Filter":
        languages = sorted(grams)
        planes = np.zeros((1 << SLOTS_LOG, max(1, -(-len(languages) // 64))), np.uint64)
        filled = []
        for k, language in enumerate(languages):
            bit = np.uint64(1 << k % 64)
            for slot in _probes(grams[language]):
                planes[slot, k // 64] |= bit
            filled.append(float((planes[:, k // 64] & bit != 0).mean()) ** PROBES)
        return cls(languages, planes, np.array(filled))

    def holders(self, grams: np.ndarray) -> np.ndarray:
        """Bit masks of the languages that hold each n-gram."""
        first, *rest = _probes(grams)
        out = self.planes[first]
        for slot in rest:
            out &= self.planes[slot]
        return out

    def shares(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """documents × languages: the share of each document's n-grams in each language, less false positives."""
        masks = self.holders(grams)
        n = np.diff(first, append=len(grams))
        out = np.zeros((len(first), len(self.languages)))
        for k in range(len(self.languages)):
            hits = np.add.reduceat((masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.int64), first)
            out[:, k] = np.maximum(0, (hits / n - self.false_positive[k]) / (1 - self.false_positive[k]))
        return out


def _probes(grams: np.ndarray) -> list[np.ndarray]:
    a, b = grams & np.uint64((1 << SLOTS_LOG) - 1), grams >> np.uint64(64 - SLOTS_LOG) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64((1 << SLOTS_LOG) - 1)).astype(np.int64) for i in range(PROBES)]


def learn(docs: DataFrame, max_docs: int = MAX_DOCS, max_languages: int = MAX_LANGUAGES) -> Filter:
    """docs: doc_id, text, lang; rows without lang are left out. The driver gets a count and at most 1 / MIN_SHARE n-grams of max_languages languages."""
    lean_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and doc_id is not null")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return Filter([], np.zeros((1, 1), np.uint64), np.zeros(0))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, float(min(1.0, max_docs / n) * (1 << 30)))])
    sample = known.where(part < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_slices(batches, limit=1 << 23):
            grams, first, _ = _grams(raw)
            langs = np.array(batch.column("lang").to_pylist(), object)
            of = np.repeat(np.arange(len(raw)), np.diff(first, append=len(grams)))
            for lang in sorted(set(langs)):
                g, n = np.unique(grams[(langs == lang)[of]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("lang").agg((F.sum("n") * MIN_SHARE).alias("least"))
    frequent = grams.join(F.broadcast(totals), "lang").where("n >= least and n > 1").select("lang", "gram").toPandas()  # broadcast: a row per language
    return Filter.build({lang: frequent.gram[frequent.lang == lang].to_numpy().astype(np.uint64) for lang in counts})


def decide(model: Filter, raw: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, and which part of the text's n-grams the language holds."""
    grams, first, letters = _grams(raw)
    if not model.languages:
        return ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
    shares = model.shares(grams, first)
    best = shares.argmax(1)
    total = shares.sum(1)
    score = np.where(letters & (total > 0), shares[np.arange(len(raw)), best] / np.where(total > 0, total, 1), 0.0)
    return [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], score, np.where(letters, shares[np.arange(len(raw)), best], 0.0)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """All columns of docs, and lang_pred, lang_score and lang_known; columns of these names that docs has are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots × 8 bytes
    added = ["lang_pred", "lang_score", "lang_known"]
    docs = docs.drop(*added)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_slices(batches):
            lang, score, known = decide(shared.value, raw)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], names=[*names, *added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(c, t) for c, t in zip(added, (StringType(), DoubleType(), DoubleType()), strict=True)]]))


def identified(docs: DataFrame, model: Filter) -> DataFrame:
    """The documents of which a learned language holds MIN_KNOWN of the n-grams or more, with the columns they came with.

    Texts of random letters share a few per cent of their n-grams with a language; nearly all labelled documents share most.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).where((F.col("lang_pred") != "und") & (F.col("lang_known") >= MIN_KNOWN)).select("row.*")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.where(~fold))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return predict(texts, model).select("doc_id", fold.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
