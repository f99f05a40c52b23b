"""Shared pieces: scratch tables, text slices, vectorised word hashing and the byte-level tokenizer."""

from __future__ import annotations

import atexit
import functools
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
ARROW_BATCH = "8m"
HASH_BYTES = 1 << 19
SLICE_BYTES = 1 << 20  # text handled by one numpy pass; a longer single document is one slice


# --------------------------------------------------------------------------- scratch tables
def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local master without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lean_batches(spark: SparkSession) -> None:
    """Batches of whole texts that go to Python stay small, so that a task's memory doesn't follow the length of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive executors.

    ``drop`` removes one as soon as nothing reads it; the rest go when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        lean_batches(spark)
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, *by: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(self.path(table))
        return self.read(table)

    def release(self) -> None:
        """Shuffle files that only finished writes needed are removed now, and not when the driver's memory runs short."""
        self.spark.sparkContext._jvm.System.gc()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for t in tables:
            remove_path(self.spark, self.path(t))

    def close(self) -> None:
        try:
            remove_path(self.spark, self.root)
        except Exception:  # the session has ended before Python did
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- batches of text
def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts Arrow batches into slices of about ``limit`` text bytes, so that memory follows the slice; null texts are empty."""
    for batch in batches:
        raw = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
        begin = size = 0
        for i, x in enumerate(raw):
            if size and size + len(x) > limit:
                yield batch.slice(begin, i - begin), raw[begin:i]
                begin, size = i, 0
            size += len(x) + 1
        if begin < len(raw):
            yield batch.slice(begin), raw[begin:]


def with_part(docs: DataFrame) -> DataFrame:
    """doc_id, text and the number of the partition they are read in."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("part"))


def text_blocks(batches: Iterator[pa.RecordBatch], docs: int, size: int, text: str = "text") -> Iterator[tuple[int, list, list[bytes]]]:
    """(block, doc_ids, texts): neighbouring rows, ``docs`` of them or ``size`` bytes of text at most; a longer text is a block of its own.

    The block's number holds the partition (column ``part``, see ``with_part``) and its place there, so it is the same
    whenever the same partition is read.
    """
    first = block = 0
    ids, raw, held = [], [], 0
    for batch in batches:
        first = batch.column("part")[0].as_py() << 32 if len(batch) else first
        for i, x in zip(batch.column("doc_id").to_pylist(), batch.column(text).cast(pa.binary()).to_pylist(), strict=True):
            x = x or b""
            if raw and (len(raw) == docs or held + len(x) > size):
                yield first | block, ids, raw
                block, ids, raw, held = block + 1, [], [], 0
            ids.append(i)
            raw.append(x)
            held += len(x)
    if raw:
        yield first | block, ids, raw


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """(value, rows): neighbouring rows of one value, as tuples of the other columns; one run is held at a time."""
    current, held = None, []
    for b in batches:
        others = [b.column(c).to_pylist() for c in b.schema.names if c != key]
        for value, *row in zip(b.column(key).to_pylist(), *others, strict=True):
            if value != current and held:
                yield current, held
                held = []
            current = value
            held.append(tuple(row))
    if held:
        yield current, held


# --------------------------------------------------------------------------- packed integers
def pack_ints(x: np.ndarray, width: int) -> bytes:
    """Integers by byte planes, so that compression drops the empty ones."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_ints(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def squeeze(data: bytes) -> bytes:
    """Compressed, with the length in front."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def spread_keys(n: int) -> np.ndarray:
    """n integers, one for each of n partitions: the integer at place p goes to partition p of repartition(n, key).

    Spark deals rows by Murmur3 of the key; whole numbers from 0 on are tried until each partition has one.
    """

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return x << np.uint32(bits) | x >> np.uint32(32 - bits)

    x = np.arange(64 * n + 1024, dtype=np.uint32)
    h = turned(turned(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    places = (h ^ h >> np.uint32(16)).view(np.int32) % n
    found, first = np.unique(places, return_index=True)
    keys = np.arange(n, dtype=np.int32)
    keys[found] = x[first]
    return keys


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [begin, end), and the range of each."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n - begin, n), of


# --------------------------------------------------------------------------- word hashing
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers of the two polynomial hashes
_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


@functools.lru_cache(8)
def _powers_of(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to size."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(size + 1, U64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(base, 1 << max(19, int(n).bit_length()))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each input bit reaches each output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = _BASE[0]) -> np.ndarray:
    """Hash of values[begin:end] for each span, from one prefix sum: equal spans get equal hashes wherever they stand."""
    power, inverse = _powers(base, len(values))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix64((total[end] - total[begin]) * inverse[begin])


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of documents: byte spans, 64-bit hashes, and each word's document."""

    def __init__(self, raw: list[bytes]):
        self.data = b"\n".join(raw) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.hash = np.empty(len(self.begin), U64)
        cut = np.searchsorted(self.end, np.arange(HASH_BYTES, len(buf), HASH_BYTES))  # eight bytes for each byte of a part, not of all texts
        for i, j in zip([0, *cut], [*cut, len(self.begin)], strict=True):
            if i < j:
                at = self.begin[i]
                self.hash[i:j] = span_hashes(_BYTE[buf[at : self.end[j - 1]]], self.begin[i:j] - at, self.end[i:j] - at)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        starts = np.cumsum(lengths) - lengths
        self.first = np.searchsorted(self.begin, starts)  # index of each document's first word
        self.count = np.diff(self.first, append=len(self.begin))
        self.doc = np.repeat(np.arange(len(raw)), self.count)

    def windows(self, n: int, base: int = _BASE[0]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that start a window of n words inside one document, and the windows' hashes."""
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1]) if len(self.doc) >= n else np.zeros(0, np.int64)
        return at, span_hashes(self.hash, at, at + n, base)

    def text(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]]


SECOND_BASE = _BASE[1]


# --------------------------------------------------------------------------- byte-level tokenizer
def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies (printable ones for themselves, the others from U+0100 on)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}


def vocabulary_size(path: str) -> int:
    """One more than the greatest id of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


@functools.lru_cache(4)
def byte_tokenizer(path: str):
    """Text to ids (numpy array) for a byte-level BPE file of the tokenizers library.

    The file's vocabulary runs through tiktoken's merge loop, which gives the same ids several times faster when
    ids follow the merge order; a file in which they don't, and texts whose regex search overflows, go to the library itself.
    """

    @functools.lru_cache(1)
    def library():  # loaded only where it is needed, as a worker's memory is small
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return own

    def slow(text: str) -> np.ndarray:
        return np.array(library().encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    of_char = byte_alphabet()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    in_order = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(vocab) == 256 + len(merges)
    plain = spec.get("normalizer") is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and not model.get("ignore_merges")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if not (in_order and plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])):
        return slow
    import tiktoken

    # Fixed value: the pattern of the byte-level pre-tokenizer.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(of_char[c] for c in token): i for token, i in vocab.items()}
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the Rust side panics on very long runs of white space; its class can't be imported
            if type(e).__name__ != "PanicException":
                raise
            return slow(text)

    return ids

