"""Substring dedup with a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. Words covered by a window whose word sequence also starts
earlier (smaller doc_id, or same document and earlier start) are removed; windows are judged on the input.

Pass 1 builds count-min sketches. A window is counted under its anchor: the least hash among the ``GRAM``-word grams
inside it (the last one among equals), a choice that depends on the window's words alone. Equal windows in two places
have equal anchors in two places, so the number of places of an anchor, and with it the sketch, never counts a window
too low. Each task keeps the cells its anchors fall in, with a mark for those hit twice; the partitions' sketches are
merged range by range of cells, and the cells hit at least twice go to the second pass as a bitmap, whose width follows
the number of anchors up to ``MAX_WIDTH_LOG`` (beyond that the filter lets more through, and the result stays the same).

Pass 2 hashes the windows whose anchor is estimated repeated, drops later copies inside a task at once, and sends one
row set per task and hash bucket; a bucket finds the first place of each 96-bit window hash over all tasks. As a window
comes at most once from each task, no frequent window makes a bucket large. The places of removed windows travel packed
by buckets of documents. Last, each document meets its own removed windows, and gives up the words they cover.

Null and empty texts have no words and stay as they are. Rows with equal doc_id are ordered by a hash of their text; rows that are equal in both count
as one document, and none of them loses words to the other. A null doc_id comes first. A very long text is read whole, as a slice of its own. An empty table
gives no rows. Extra columns are kept, whatever their names: by ``cut`` all of them, by ``dedup`` all but n_words and n_removed, which it replaces.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SECOND_BASE, Scratch, Words, mix64, parallelism, runs, span_hashes, text_slices

WINDOW, GRAM = 20, 5
DEPTH = 2  # rows of the sketch
CELLS_PER_ANCHOR_LOG = 2
MIN_WIDTH_LOG, MAX_WIDTH_LOG = 16, 29  # cells in a row of the sketch
RANGES_LOG = 6  # ranges of cells that are merged by different tasks
WINDOWS_PER_BUCKET = 2_000_000


# --------------------------------------------------------------------------- anchors
def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the position of the least of values[i : i + width], the last among equals."""
    n = len(values) - width + 1
    best, value, span = np.arange(len(values)), values, 1
    while span < width:  # doubling: minima over spans of 1, 2, 4, ... then of width from two spans that overlap
        step = min(span, width - span)
        left, right = value[: len(value) - step], value[step:]
        take = right <= left
        best = np.where(take, best[step:], best[: len(best) - step])
        value = np.where(take, right, left)
        span += step
    return best[:n]


def _anchored(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the hash of each one's anchor gram, and the gram's place."""
    n = len(words.doc)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.flatnonzero(words.doc[window - 1 :] == words.doc[: n - window + 1])
    gram = min(GRAM, window)
    at, h = words.windows(gram)
    grams = np.full(n - gram + 1, np.iinfo(np.uint64).max, np.uint64)
    grams[at] = h
    place = _window_minima(grams, window - gram + 1)[starts]
    return starts, grams[place], place


def _cells(anchors: np.ndarray, row: int) -> np.ndarray:
    """32-bit cells of a row of the sketch, to be shortened to its width."""
    return (mix64(anchors + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)).astype(np.uint32)


def _sketch(window: int):
    """Rows (sketch row, range, n, cells, twice): a task's sketch; cells are sorted, twice marks those hit more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            anchors = np.concatenate(held)
            out = []
            for row in range(DEPTH):
                cells, n = np.unique(_cells(anchors, row), return_counts=True)
                cut = np.searchsorted(cells, np.arange(1 << RANGES_LOG, dtype=np.uint64) << np.uint64(32 - RANGES_LOG))
                for r, (c, k) in enumerate(zip(np.split(cells, cut[1:]), np.split(n, cut[1:]), strict=True)):
                    if len(c):
                        out.append((row, r, len(anchors) if r == int(cells[0] >> (32 - RANGES_LOG)) else 0, np.diff(c, prepend=np.uint32(0)).tobytes(), np.packbits(k > 1).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["row", "range", "n", "cells", "twice"])

        for _, raw in text_slices(batches):
            _, anchor, place = _anchored(Words(raw), window)
            # windows that share an anchor's place follow one another, or nearly so
            _, first = np.unique(place, return_index=True)
            held.append(anchor[first])
            size += len(first)
            if size > 1 << 21:  # a task's memory stays bounded; it then sends several sketches
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _merge(width_log: int):
    """Ranges of sketch rows: the cells that all sketches together hit at least twice, as bitmaps. Memory follows the ranges, not the sketches."""
    span = max(0, width_log - RANGES_LOG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, inside = np.uint32(32 - width_log), np.uint32((1 << span) - 1)
        state: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for row, part, cells, twice in zip(*(b.column(c).to_pylist() for c in ("row", "range", "cells", "twice")), strict=True):
                once, again = state.setdefault((row, part), (np.zeros(1 << span, bool), np.zeros(1 << span, bool)))
                full = np.cumsum(np.frombuffer(cells, np.uint32), dtype=np.uint32)
                cell = (full >> shift) & inside
                again[cell[np.unpackbits(np.frombuffer(twice, np.uint8), count=len(full)).astype(bool)]] = True
                again[cell[1:][cell[1:] == cell[:-1]]] = True  # two cells of this sketch that meet at this width
                again[cell[once[cell]]] = True
                once[cell] = True
        for (row, part), (_, again) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([part], pa.int32()), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())], names=["row", "range", "bits"])

    return run


# --------------------------------------------------------------------------- windows
def _order(ids: pa.Array, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two integers by which documents come in order: doc_id (null first), and a hash of the text where doc_ids are equal."""
    first = pc.fill_null(ids, -(2**63)).to_numpy(zero_copy_only=False)
    return first, np.array([hash_text(x) for x in raw], np.int32)


def hash_text(x: bytes) -> int:
    return zlib.crc32(x) & 0x7FFFFFFF


_WINDOW_BYTES = np.dtype([("hash", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("tie", "<i4"), ("start", "<i4")])


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """Sorts rows by window and place, and returns which stand at a window's first place."""
    order = np.lexsort((rows["start"], rows["tie"], rows["doc"], rows["check"], rows["hash"]))
    rows[:] = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["hash"][1:] != rows["hash"][:-1]) | (rows["check"][1:] != rows["check"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    # documents repeated whole, doc_id included, stand at the same place
    return (rows["doc"] == rows["doc"][head]) & (rows["tie"] == rows["tie"][head]) & (rows["start"] == rows["start"][head])


def _removed(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The places of removed windows, packed into one row for each bucket of documents (-1, -2, ...), column by column."""
    bucket = (mix64(rows["doc"].astype(np.uint64) ^ rows["tie"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((rows["start"], rows["tie"], rows["doc"], bucket))
    rows, bucket = rows[order], bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    parts = np.split(rows, at[1:]) if len(at) else []
    return pa.RecordBatch.from_arrays([pa.array(-1 - bucket[at], pa.int32()), pa.array([b"".join(x[c].tobytes() for c in ("doc", "tie", "start")) for x in parts], pa.binary())], names=["bucket", "data"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with the sorted starts of its removed windows; all of a document's are in one bucket."""
    for _, rows in runs(batches, "bucket"):
        parts = [x for (x,) in rows]
        doc, tie, start = (np.concatenate([np.frombuffer(x, kind, len(x) // 16, at * (len(x) // 16)) for x in parts]) for kind, at in (("<i8", 0), ("<i4", 8), ("<i4", 12)))
        order = np.lexsort((start, tie, doc))
        doc, tie, start = doc[order], tie[order], start[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]))
        yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(tie[new]), pa.array([x.tobytes() for x in np.split(start, new[1:])], pa.binary())], names=["doc", "tie", "starts"])


_ROWS = "bucket int, data binary"


def _candidates(bits, width_log: int, buckets: int, window: int):
    def repeated(anchor: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchor), bool)
        for row, bitmap in enumerate(bits.value):
            cell = _cells(anchor, row) >> np.uint32(32 - width_log)
            out &= bitmap[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8) & np.uint8(1) != 0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            first = _first_of_each(rows)
            yield _removed(rows[~first], buckets)
            rows = rows[first]
            bucket = (rows["hash"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array([x.tobytes() for x in np.split(rows, at[1:])] if len(at) else [], pa.binary())], names=["bucket", "data"])

        for batch, raw in text_slices(batches):
            words = Words(raw)
            starts, anchor, _ = _anchored(words, window)
            starts = starts[repeated(anchor)]
            if not len(starts):
                continue
            doc, tie = _order(batch.column("doc_id"), raw)
            rows = np.zeros(len(starts), _WINDOW_BYTES)
            rows["hash"], rows["check"] = _two_hashes(words, starts, window)
            of = words.doc[starts]
            rows["doc"], rows["tie"], rows["start"] = doc[of], tie[of], starts - words.first[of]
            held.append(rows)
            size += len(rows)
            if size > 1 << 20:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _two_hashes(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return span_hashes(words.hash, starts, starts + window), (span_hashes(words.hash, starts, starts + window, SECOND_BASE) >> np.uint64(32)).astype(np.uint32)


def _settle(buckets: int):
    """Neighbouring rows of one bucket: passes removed windows on, and finds those that another task has earlier. One bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened() -> Iterator[pa.RecordBatch]:
            for b in batches:
                gone = pc.less(b.column("bucket"), 0)
                passed.extend([b.filter(gone)] if pc.any(gone).as_py() else [])
                yield b.filter(pc.invert(gone))

        passed: list[pa.RecordBatch] = []
        for _, parts in runs(opened(), "bucket"):
            yield from passed
            passed.clear()
            rows = np.concatenate([np.frombuffer(x, _WINDOW_BYTES) for (x,) in parts])
            first = _first_of_each(rows)
            yield _removed(rows[~first], buckets)
        yield from passed

    return run


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of starts."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edge)[:n_words] > 0


# --------------------------------------------------------------------------- the operator
def removed_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """doc, tie, starts (int32, as bytes): the windows to remove, by document."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketches = scratch.write(source.select("text").mapInArrow(_sketch(window), "row int, range int, n long, cells binary, twice binary"), "sketches")
    anchors = sketches.where("row = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width_log = int(np.clip(int(anchors).bit_length() + CELLS_PER_ANCHOR_LOG, MIN_WIDTH_LOG, MAX_WIDTH_LOG))
    bits = np.zeros((DEPTH, 1 << (width_log - 3)), np.uint8)
    part = 1 << (width_log - RANGES_LOG - 3)
    merged = sketches.drop("n").repartition(min(DEPTH << RANGES_LOG, parallelism(spark)), "row", "range").mapInArrow(_merge(width_log), "row int, range int, bits binary")
    for r in scratch.write(merged, "bits").toLocalIterator():  # at most DEPTH << MAX_WIDTH_LOG bits
        bits[r.row, r.range * part : (r.range + 1) * part] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    del bits
    scratch.drop("sketches", "bits")
    buckets = max(parallelism(spark), int(anchors) * (WINDOW - GRAM + 1) // 2 // WINDOWS_PER_BUCKET + 1)
    found = source.mapInArrow(_candidates(shared, width_log, buckets, window), _ROWS)
    settled = scratch.write(found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(buckets), _ROWS), "removed")
    scratch.release()
    return settled.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather, "doc long, tie int, starts binary")


def _joined(docs: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """row (the other columns of docs), doc_id, text, starts."""
    removed = removed_windows(docs, scratch, window)
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    tie = F.crc32(F.coalesce(text, F.lit(""))).bitwiseAND(0x7FFFFFFF).cast("int")
    rows = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), doc.alias("doc"), tie.alias("tie"))
    return rows.join(removed, ["doc", "tie"], "left").select("row", "doc_id", "text", "starts")


def _keep(starts: bytes | None, text: bytes, window: int) -> tuple[int, int, bytes]:
    words = text.split()  # bytes split at exactly the white space of the words' definition
    if not starts:
        return len(words), 0, b" ".join(words)
    gone = covered(len(words), np.frombuffer(starts, "<i4"), window)
    return len(words), int(gone.sum()), b" ".join(itertools.compress(words, (~gone).tolist()))


def _cut(docs: DataFrame, window: int, scratch: Scratch | None) -> DataFrame:
    """row (the other columns of docs), text without the removed words, n_words, n_removed."""
    joined = _joined(docs, scratch or Scratch(docs.sparkSession, "substring"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_slices(batches):
            kept = [_keep(p, x, window) for p, x in zip(batch.column("starts").to_pylist(), raw, strict=True)]
            # a text that loses nothing stays as it is, white space included
            texts = [k[2].decode() if k[1] else None if null else x.decode() for k, x, null in zip(kept, raw, batch.column("text").is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["row", "text", "n_words", "n_removed"])

    fields = [joined.schema["row"], StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]
    return joined.select("row", "text", "starts").mapInArrow(run, StructType(fields))


def cut(docs: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """The columns of docs, and no other, with text without the removed words."""
    rows = _cut(docs, window, scratch)
    return rows.select([F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def dedup(docs: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """All columns of docs, text without the removed words, and n_words and n_removed."""
    docs = docs.drop("n_words", "n_removed")
    rows = _cut(docs, window, scratch)
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], "n_words", "n_removed")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_slices(batches):
            kept = [_keep(p, x, WINDOW) for p, x in zip(batch.column("starts").to_pylist(), raw, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[2]).hexdigest() for k in kept])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _joined(docs, Scratch(spark, "substring"), WINDOW).drop("row").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
