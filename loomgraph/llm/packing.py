"""Sequence packing by non-negative least squares over length combinations.

Each document's ids (plus an end id) are cut into full windows and one remainder. A full window is a sequence of its
own. For the remainders, the operator enumerates shallow combinations of lengths that fill a window exactly, finds
non-negative repeat counts whose lengths approximate the histogram, rounds them down, and packs what is left greedily.
All of this works on the histogram, whose size is bounded by the window; no row comes to the driver. A remainder's
place follows from its rank among the remainders of its length, found from ranks inside hashed blocks plus the counts
of the blocks before, so that one length that holds most documents is spread over tasks.

Null text is an empty document and holds the end id alone. Rows with equal or null doc_id stay separate documents. A very long text is
tokenized whole and cut into windows. Pieces that tie in length and in all columns are interchangeable. Extra columns
are ignored, whatever their names. An empty table gives no rows.

Enumeration is limited, not the rows: combinations are all pairs of lengths, and triples whose shortest length is a multiple of
``TRIPLE_STEP``. What these don't use is packed by the greedy step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_tokenizer, text_slices

TRIPLE_STEP = 32  # the shortest of three lengths is a multiple of this
STEPS = 300  # of the multiplicative least-squares updates
BLOCK_ROWS = 20_000  # remainders ranked by one task, about


# --------------------------------------------------------------------------- cutting
def _pieces(tokenizer: str, end_id: int, window: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(tokenizer)
        for batch, raw in text_slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw, strict=True):
                ids = np.append(encode(text.decode()), np.uint32(end_id)).astype("<u4")
                out += [(doc_id, at, min(window, len(ids) - at), zlib.crc32(ids[at : at + window].tobytes()), len(ids)) for at in range(0, len(ids), window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


# --------------------------------------------------------------------------- the plan
@dataclass
class Plan:
    """Slots for ranks [first, first + n) of one length: rank r goes to sequence base + (r - first) // per, at offset + (r - first) % per * length."""

    length: np.ndarray
    first: np.ndarray
    n: np.ndarray
    base: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    sequences: int
    padding: int


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of one to three lengths (0: none) that occur and together fill the window."""
    occurs = np.zeros(window + 1, bool)
    occurs[lengths] = True
    rows = [np.array([[window, 0, 0]])] if occurs[window] else []
    a = lengths[lengths <= window // 2]
    b = window - a
    rows.append(np.stack([a, b, np.zeros_like(a)], 1)[occurs[b]])
    for x in range(TRIPLE_STEP, window // 3 + 1, TRIPLE_STEP):
        if occurs[x]:
            y = lengths[(lengths >= x) & (lengths <= (window - x) // 2)]
            z = window - x - y
            rows.append(np.stack([np.full_like(y, x), y, z], 1)[occurs[z]])
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative x that lessens |A x - histogram|², by multiplicative updates, A being the lengths in each combination."""
    n = len(histogram)
    used = combos > 0

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), np.repeat(x, 3) * used.ravel(), n)

    def backward(v: np.ndarray) -> np.ndarray:
        return (v[combos] * used).sum(1)

    # lengths weigh by how rare they are, so that relative errors count
    weight = np.where(histogram > 0, 1 / np.maximum(histogram, 1), 0.0)
    target = backward(histogram * weight)
    x = np.full(len(combos), histogram.sum() / max(1, 2 * len(combos)))
    for _ in range(STEPS):
        x *= target / np.maximum(backward(forward(x) * weight), 1e-12)
    return x


def plan(histogram: dict[int, int], window: int) -> Plan:
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    slots: list[tuple[int, int, int, int, int, int]] = []
    taken = np.zeros(window + 1, np.int64)
    sequences = padding = 0

    def place(items: list[tuple[int, int]], repeats: int) -> None:
        """items: length and how many of it each of the repeated sequences holds."""
        nonlocal sequences, padding
        offset = 0
        for length, per in items:
            slots.append((length, int(taken[length]), per * repeats, sequences, per, offset))
            taken[length] += per * repeats
            left[length] -= per * repeats
            offset += per * length
        sequences += repeats
        padding += repeats * (0 if offset & (offset - 1) == 0 else window - offset)

    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        solved = np.floor(repeat_counts(combos, left.astype(float)) + 1e-9).astype(np.int64)
        for i in np.argsort(-solved, kind="stable"):
            if solved[i] <= 0:
                break
            lengths, per = np.unique(combos[i][combos[i] > 0], return_counts=True)
            if (repeats := min(int(solved[i]), int((left[lengths] // per).min()))) > 0:
                place(list(zip(lengths.tolist(), per.tolist(), strict=True)), repeats)
    # What rounding left: fill a window with the longest lengths that still fit, and repeat that as often as they last.
    while left.any():
        room, items, free = window, [], left.copy()
        while room:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            per = int(min(free[length], room // length))
            items.append((length, per))
            free[length] = 0
            room -= per * length
        place(items, min(int(left[length]) // per for length, per in items))
    columns = np.array(slots, np.int64).reshape(-1, 6).T
    return Plan(*columns, sequences, padding)


# --------------------------------------------------------------------------- the operator
def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = source.mapInArrow(_pieces(tokenizer, end_id, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = scratch.write(pieces, "pieces")  # tokenized once
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    solved = plan(histogram, window)
    blocks = max(1, sum(histogram.values()) // BLOCK_ROWS)
    key = ["length", "block"]
    keyed = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    before = keyed.groupBy(*key).agg(F.count("*").alias("n")).select(*key, (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    ranked = ranked.join(before, key).withColumn("rank", F.col("rank") + F.col("before"))
    order = np.lexsort((solved.first, solved.length))
    slot_length, slot_first = solved.length[order], solved.first[order]
    slot_base, slot_per, slot_offset = solved.base[order], solved.per[order], solved.offset[order]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the plan goes along with the task: its rows are bounded by the combinations, not by the documents
        at = slot_length << 40 | slot_first
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            s = np.searchsorted(at, length << 40 | rank, "right") - 1
            k = rank - slot_first[s]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(slot_base[s] + k // slot_per[s], pa.int64()), pa.array(slot_offset[s] + k % slot_per[s] * length, pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """sequence_id and its ids, from what ``pack`` returned; doc_id must be unique here. Padding is left to the reader."""

    @F.pandas_udf("array<int>")
    def encode(texts):
        import pandas as pd

        own = byte_tokenizer(tokenizer)
        return pd.Series([np.append(own(t or ""), np.uint32(end_id)).astype(np.int32) for t in texts])

    ids = docs.select("doc_id", encode(F.coalesce("text", F.lit(""))).alias("ids"))
    parts = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))  # at most one window of ids a group


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), 1)
