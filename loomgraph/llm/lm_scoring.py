"""Stupid-backoff language-model scores from counts of the whole corpus.

A relational plan on packed columns. Documents are read in blocks of ``BLOCK_DOCS`` neighbouring rows, or fewer with
``BLOCK_BYTES`` of text (a longer text is a block of its own).

1. Exploded n-grams, pre-aggregated: each block lists its distinct n-grams of order 1 to ``order`` with their counts, in
   one row for each range of the n-gram's hash. The number of ranges follows the corpus, so that a range stays small.
2. Count table, partitioned by hash: rows meet by range; a range adds the blocks' counts up, and the totals are joined
   back to the n-grams of each block, in the order in which it listed them.
3. Sum per document: each block meets its documents again, every n-gram gets its total, and the terms of each document are summed.

A row for each n-gram of each block instead would shuffle some 240 million rows for 0.5 GB of documents (measured: 48
million for 0.1 GB), twice over, against some 6 bytes an n-gram here; that is beyond the disk that the job may use.

The documents do not count for themselves: a document's own n-grams are taken off the totals, else every n-gram would
be known and nothing would ever back off. With f the remaining counts, N the words of all other documents and
``ALPHA`` = 0.4: S(w | u v) = f(u v w) / f(u v) if f(u v w) > 0, else ALPHA * S(w | v), and in the end f(w) / N; a word that
no other document has scores ALPHA / N. The first words of a document have shorter contexts. ``score`` is the sum of
ln S, ``mean`` its share per word.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. N-grams are known by 64 bits of hash: among 1e9 distinct ones about 0.03
pairs are expected to share a count. Null and empty texts have no words, score 0 and a null mean. Rows with
equal doc_id, or a null one, are scored one by one (each takes off its own n-grams only). If no other document has words, N counts as 1. Extra columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, expand, pack_ints, parallelism, runs, spread_keys, squeeze, text_blocks, unpack_ints, with_part

ORDER = 3
ALPHA = 0.4
BLOCK_DOCS, BLOCK_BYTES = 2048, 4 << 20
RANGE_BYTES = 8 << 20  # text of the corpus for one range of hashes, about


class _Block:
    """The n-grams of a block's documents; its distinct ones in the order of their hashes, whatever the documents' order."""

    def __init__(self, raw: list[bytes], order: int):
        self.words = Words(raw)
        at, hashes = [], []
        for n in range(1, order + 1):
            place, h = self.words.windows(n)
            at.append(place)
            hashes.append(h ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
        self.at, self.sizes = at, [len(x) for x in at]
        self.joined = np.concatenate(hashes)

    def scores(self, order: int, totals: np.ndarray, inverse: np.ndarray, n_words: int, docs: int) -> np.ndarray:
        words, cut = self.words, np.cumsum([0, *self.sizes])
        others: list[np.ndarray] = []
        for n in range(order):
            own = inverse[cut[n] : cut[n + 1]]
            key = own * docs + words.doc[self.at[n]]
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            f = np.zeros(len(words.doc))  # by the n-gram's first word
            f[self.at[n]] = totals[own].astype(float) - times[back]
            others.append(f)
        n_others = np.maximum(1, n_words - words.count[words.doc])
        value = np.where(others[0] > 0, others[0], ALPHA) / n_others
        for n in range(1, order):  # each longer n-gram that others have replaces the score so far of its last word
            last = self.at[n] + n
            f, context = others[n][self.at[n]], others[n - 1][self.at[n]]
            value[last] = np.where(f > 0, f / np.maximum(context, 1), ALPHA * value[last])
        return np.bincount(words.doc, np.log(value), docs)


def _requests(order: int, ranges: int, tasks: int):
    begins = np.array([-(-(r << 64) // ranges) for r in range(ranges)], np.uint64)
    keys = spread_keys(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, raw in text_blocks(batches, BLOCK_DOCS, BLOCK_BYTES):
            own = _Block(raw, order)
            words, joined = len(own.words.doc), own.joined
            del own
            grams, counts = np.unique(joined, return_counts=True)
            del joined
            cut = [*np.searchsorted(grams, begins).tolist(), len(grams)]
            rows = [(-1, -1, block, words, b"", b"")]
            for r in range(ranges):
                if cut[r] < cut[r + 1]:
                    g, c = grams[cut[r] : cut[r + 1]], counts[cut[r] : cut[r + 1]]
                    rows.append((int(keys[r % tasks]), r, block, len(g), squeeze(pack_ints(np.diff(g, prepend=begins[r]), 8)), squeeze(pack_ints(c, 4))))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["task", "range", "block", "n", "grams", "counts"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one range: for each block, the totals of the n-grams it listed. One range is held at a time."""
    for of, rows in runs(batches, "range"):
        blocks, n, grams, counts = zip(*rows, strict=True)
        if of < 0:
            totals = [b""] * len(blocks)
        else:
            grams = [np.cumsum(unpack_ints(expand(g), 8)) for g in grams]
            _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([unpack_ints(expand(c), 4) for c in counts]))[inverse].astype(np.uint64)
            totals = [squeeze(pack_ints(x, 5)) for x in np.split(total, np.cumsum(n)[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([of] * len(blocks), pa.int32()), pa.array(n, pa.int64()), pa.array(totals, pa.binary())], names=["block", "range", "n", "totals"])


_TEXTS = "block long, range int, totals binary, ids array<long>, sizes array<long>, texts binary"


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block, cut as _requests cuts them, with its documents."""
    for block, ids, raw in text_blocks(batches, BLOCK_DOCS, BLOCK_BYTES):
        columns = [pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in raw]], pa.list_(pa.int64())), pa.array([squeeze(b"".join(raw))])]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "range", "totals", "ids", "sizes", "texts"])


def _score(order: int, n_words: int):
    def one(ids: list, raw: list[bytes], answers: list[tuple]) -> pa.RecordBatch:
        own = _Block(raw, order)
        grams, inverse = np.unique(own.joined, return_inverse=True)
        own.joined = None
        inverse, n_grams = inverse.astype(np.int32), len(grams)
        del grams
        totals = np.concatenate([np.zeros(0, np.uint64), *(unpack_ints(expand(t), 5) for _, t in sorted(answers))])
        if len(totals) != n_grams:
            raise ValueError("the documents were not read in the same blocks twice; write them to a table first")
        score = own.scores(order, totals, inverse, n_words, len(raw))
        n = own.words.count
        mean = pa.array(score / np.maximum(n, 1), mask=n == 0)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(score), mean], names=["doc_id", "n_words", "score", "mean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "block"):
            raw: list[bytes] = []
            for _, _, _, sizes, texts in rows:
                if texts is not None:
                    whole, end = expand(texts), np.cumsum(sizes).tolist()
                    raw = [whole[e - n : e] for e, n in zip(end, sizes, strict=True)]
            ids = next((x[2] for x in rows if x[4] is not None), [])
            answers = [(x[0], x[1]) for x in rows if x[0] is not None and x[0] >= 0]
            if raw:
                yield one(ids, raw, answers)

    return run


def score(docs: DataFrame, order: int = ORDER, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, score, mean. The documents must come from tables, as they are read twice in the same order."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    source = with_part(docs)
    size = int(source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    ranges = max(parallelism(spark), -(-size // RANGE_BYTES))
    tasks = max(parallelism(spark), ranges // 2)
    asked = source.mapInArrow(_requests(order, ranges, tasks), "task int, range int, block long, n long, grams binary, counts binary")
    answered = asked.repartition(tasks, "task").sortWithinPartitions("range").select("range", "block", "n", "grams", "counts").mapInArrow(_totals, "block long, range int, n long, totals binary")
    answered = scratch.write(answered, "totals")
    n_words = int(answered.where("range = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rows = answered.where("range >= 0").select("block", "range", "totals", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes"), F.lit(None).cast("binary").alias("texts"))
    rows = rows.unionByName(source.mapInArrow(_tagged, _TEXTS))
    return rows.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_score(order, n_words), "doc_id long, n_words long, score double, mean double")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return score(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("score", "mean")})
