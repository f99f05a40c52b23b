"""Token-id output as a content-addressed store.

``TokenStore.write`` tokenizes documents, cuts each id stream into chunks where a rolling hash of the last
``WINDOW`` ids hits a mask, and writes three parquet folders in the given directory:

``objects/kind=chunk``  digest (SHA-256 of the payload), payload (little-endian ids); each distinct chunk once.
``recipes``             per document, in ascending doc_id order over the shards: its chunk digests and lengths,
                        the ids before it in its shard, and a leaf hash over all of these.
``manifest``            per shard: documents, ids, the ids before it, and the Merkle root of its leaves.

``read_lengths_and_crc`` and ``read_ids`` take everything from those files. Every stored chunk is checked against
its digest and every shard against its Merkle root; a missing or changed chunk raises an error.

Null text is an empty document (its only id is the end id). Rows with equal doc_id stay separate documents, ordered
by their recipes; a null doc_id comes first. A very long text is tokenized whole and cut to chunks as any other. Extra columns are ignored, whatever
their names. An empty table makes an empty store.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_tokenizer, mix64, parallelism, span_hashes, text_slices, vocabulary_size

WINDOW = 16  # ids under the rolling hash
CUT_MASK = 0xFF  # one cut in 256 ids on average
MIN_CHUNK, MAX_CHUNK = 64, 1024
PART_BYTES = 64 << 20  # text of the corpus for one partition, at most about, of chunks or of recipes


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream. They depend on nearby ids only, so equal passages get equal chunks."""
    n = len(ids)
    hits = np.zeros(0, np.int64)
    if n > WINDOW:
        at = np.arange(n - WINDOW + 1)
        hits = np.flatnonzero(span_hashes(mix64(ids.astype(np.uint64) + np.uint64(1)), at, at + WINDOW) & np.uint64(CUT_MASK) == 0) + WINDOW
    ends, last = [], 0
    for hit in [*hits.tolist(), n]:
        while hit - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if hit - last >= MIN_CHUNK or hit == n > last:
            ends.append(hit)
            last = hit
    return ends


def _leaf(doc_id: int | None, lens: list[int], digests: list[bytes]) -> bytes:
    return hashlib.sha256(f"{doc_id}|{','.join(map(str, lens))}|".encode() + b"".join(digests)).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last node moves up unchanged."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_STAGED = pa.schema([("key", pa.int64()), ("kind", pa.string()), ("digest", pa.binary()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("lens", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())), ("leaf", pa.binary())])
_STAGED_SQL = "key long, kind string, digest binary, payload binary, doc_id long, n_tokens long, lens array<int>, digests array<binary>, leaf binary"


_FOLDERS = {
    "objects": "digest binary, payload binary, doc_id long, n_tokens long, lens array<int>, digests array<binary>, leaf binary, kind string",
    "recipes": "doc_id long, n_tokens long, lens array<int>, digests array<binary>, leaf binary, local_start long, row long, shard int",
    "manifest": "shard int, n_docs long, n_tokens long, root binary, shard_start long",
}


def _stage(tokenizer: str, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, largest = byte_tokenizer(tokenizer), set(), int(np.iinfo(np.dtype(width)).max)
        for batch, raw in text_slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw, strict=True):
                ids = np.append(encode(text.decode()), np.uint32(end_id))
                if int(ids.max()) > largest:
                    raise ValueError(f"id {int(ids.max())} does not fit a store of ids up to {largest}; give it the tokenizer's vocabulary")
                data = ids.astype(width)
                lens, digests, begin = [], [], 0
                for end in cut_points(ids):
                    payload = data[begin:end].tobytes()
                    digest = hashlib.sha256(payload).digest()
                    lens.append(end - begin)
                    digests.append(digest)
                    begin = end
                    if digest not in seen:  # at most one copy of a chunk leaves a task, however many documents hold it
                        seen.add(digest)
                        out.append((int.from_bytes(digest[:8], "little", signed=True), "chunk", digest, payload, None, None, None, None, None))
                leaf = _leaf(doc_id, lens, digests)
                out.append((int.from_bytes(leaf[:8], "little", signed=True), "recipe", None, None, doc_id, len(ids), lens, digests, leaf))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _STAGED, strict=True)], schema=_STAGED)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the first row of each digest; equal digests are in one partition, at most one from each task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for digest in batch.column("digest").to_pylist():
            keep.append(digest is None or digest not in seen)
            if digest is not None:
                seen.add(digest)
        yield batch.filter(pa.array(keep, pa.bool_()))


# --------------------------------------------------------------------------- CRC-32 of joined parts
@functools.lru_cache(1)
def _shift_tables() -> list[np.ndarray]:
    """For each k, four byte tables that append 2**k zero bytes to what a CRC-32 has read."""
    poly = 0xEDB88320
    step = np.array([(1 << (i - 1)) if i else poly for i in range(32)], np.uint32)  # one zero bit

    def apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where(v >> np.uint32(i) & np.uint32(1), m[i], np.uint32(0))
        return out

    for _ in range(3):
        step = apply(step, step)  # 8 zero bits
    tables = []
    for _ in range(48):
        tables.append(np.stack([apply(step, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)]))
        step = apply(step, step)
    return tables


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32(a + b) == shift_crc(crc32(a), len(b)) ^ crc32(b)."""
    crc = crc.astype(np.uint32)
    for k, t in enumerate(_shift_tables()):
        hit = np.flatnonzero(n_bytes >> k & 1)
        if len(hit):
            v = crc[hit]
            crc[hit] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
        elif not (n_bytes >> k).any():
            break
    return crc


class TokenStore:
    def __init__(self, spark: SparkSession, path: str, vocabulary: int = 50257):
        """vocabulary: ids are below it (see ``vocabulary_size``); up to 65,536 they take two bytes each, else four. An id that does not fit raises an error."""
        self.spark, self.path = spark, path.rstrip("/")
        self.width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def write(self, docs: DataFrame, tokenizer: str, end_id: int) -> "TokenStore":
        source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        size = int(source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
        parts = max(parallelism(self.spark), size // PART_BYTES)
        staged = source.mapInArrow(_stage(tokenizer, end_id, self.width), _STAGED_SQL)
        once = staged.repartition(parts, "key").mapInArrow(_once, _STAGED_SQL)
        once.drop("key").write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{self.path}/objects")
        recipes = self._read("objects").where("kind = 'recipe'").select("doc_id", "n_tokens", "lens", "digests", "leaf")
        ordered = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "leaf").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "leaf")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = row = 0
            for b in batches:
                n = b.column("n_tokens").to_numpy(zero_copy_only=False)
                start = before + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start, pa.int64()), pa.array(np.arange(row, row + len(n)), pa.int64())], names=[*b.schema.names, "local_start", "row"])
                before, row = before + int(n.sum()), row + len(n)

        placed = ordered.mapInArrow(place, "doc_id long, n_tokens long, lens array<int>, digests array<binary>, leaf binary, local_start long, row long")
        placed.withColumn("shard", F.spark_partition_id()).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/recipes")
        roots = self._roots(F.col("leaf"))
        roots.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")
        return self

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(_FOLDERS[folder]).parquet(f"{self.path}/{folder}")

    def _roots(self, leaf) -> DataFrame:
        """A row per shard; a shard holds one range of documents, and 32 bytes of each come to the task that folds it."""

        def fold(pdf):
            pdf = pdf.sort_values("row")
            return pdf.head(1)[["shard"]].assign(n_docs=len(pdf), n_tokens=int(pdf.n_tokens.sum()), root=[merkle_root([bytes(x) for x in pdf.leaf])])

        return self._read("recipes").select("shard", "row", "n_tokens", leaf.alias("leaf")).groupBy("shard").applyInPandas(fold, "shard int, n_docs long, n_tokens long, root binary")

    def root(self) -> bytes:
        """Merkle root over the shards' roots: one row per shard comes to the driver."""
        return merkle_root([bytes(r.root) for r in self._read("manifest").orderBy("shard").select("root").collect()])

    def verify(self) -> None:
        """Leaves and roots are computed again from the recipes on disk and held against the manifest."""

        @F.pandas_udf("binary")
        def leaf(doc_id, lens, digests):
            import pandas as pd

            return pd.Series([_leaf(None if pd.isna(d) else int(d), [int(x) for x in n], [bytes(x) for x in h]) for d, n, h in zip(doc_id.astype("Int64"), lens, digests, strict=True)])

        now = self._roots(leaf("doc_id", "lens", "digests")).select("shard", F.col("root").alias("now"))
        bad = self._read("manifest").join(now, "shard", "full").where("root is null or now is null or root <> now").limit(5).collect()
        if bad:
            raise ValueError(f"the recipes of shards {[r.shard for r in bad]} do not match the manifest")

    def _chunks(self, with_ids: bool = False) -> DataFrame:
        width = self.width

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                digests, payloads = b.column("digest").to_pylist(), b.column("payload").to_pylist()
                crcs, sizes = [], []
                for digest, payload in zip(digests, payloads, strict=True):
                    if hashlib.sha256(payload).digest() != digest:
                        raise ValueError(f"chunk {digest.hex()} is damaged")
                    ids = np.frombuffer(payload, width)
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    sizes.append(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64()), *([b.column("payload")] * with_ids)], names=["digest", "crc", "size", *["payload"] * with_ids])

        return self._read("objects").where("kind = 'chunk'").select("digest", "payload").mapInArrow(check, "digest binary, crc long, size long" + ", payload binary" * with_ids)

    def _occurrences(self, *, with_ids: bool = False) -> DataFrame:
        """A row for each place of a chunk in a document, with the ids that follow it there."""
        parts = self._read("recipes").select("shard", "row", "doc_id", "n_tokens", "local_start", F.size("lens").alias("n_chunks"), F.posexplode(F.arrays_zip("lens", "digests")).alias("pos", "part"))
        before = Window.partitionBy("shard", "row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.select("shard", "row", "doc_id", "n_tokens", "local_start", "n_chunks", "pos", F.col("part.digests").alias("digest"), F.col("part.lens").cast("long").alias("len"), (F.col("n_tokens") - F.sum("part.lens").over(before)).alias("after"))
        return parts.join(self._chunks(with_ids), "digest")

    def read_lengths_and_crc(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document. Each stored chunk is read once, however often it occurs."""
        self.verify()

        @F.pandas_udf("long")
        def shifted(crc, after):
            import pandas as pd

            return pd.Series(shift_crc(crc.to_numpy(), 4 * after.to_numpy()).astype(np.int64))

        docs = self._occurrences().withColumn("crc", shifted("crc", "after")).groupBy("shard", "row", "doc_id", "local_start", "n_tokens", "n_chunks").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("found"), F.count("*").alias("parts"))
        whole = F.when((F.col("found") == F.col("n_tokens")) & (F.col("parts") == F.col("n_chunks")), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's chunks are missing")).cast("long"))
        recipes = self._read("recipes").select("shard", "row").withColumnRenamed("shard", "s").withColumnRenamed("row", "r")
        docs = recipes.join(docs, (F.col("s") == F.col("shard")) & (F.col("r") == F.col("row")), "left").withColumn("shard", F.col("s"))
        starts = F.broadcast(self._read("manifest").select("shard", "shard_start"))  # a row per shard
        return docs.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), F.coalesce(whole, F.raise_error(F.lit("a document's chunks are missing")).cast("long")).alias("n_tokens"), "ids_crc32")

    def read_ids(self) -> DataFrame:
        """doc_id and ids of every document, rebuilt from its chunks; a document's own ids meet in one row."""
        width = self.width

        @F.pandas_udf("array<int>")
        def joined(parts):
            import pandas as pd

            return pd.Series([np.frombuffer(b"".join(bytes(x["payload"]) for x in p), width).astype(np.int32) for p in parts])

        rows = self._occurrences(with_ids=True).groupBy("shard", "row", "doc_id", "n_chunks").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
        whole = F.when(F.size("parts") == F.col("n_chunks"), joined("parts")).otherwise(F.raise_error(F.lit("a document's chunks are missing")).cast("array<int>"))
        return rows.select("shard", "row", "doc_id", whole.alias("ids"))


def op10_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from .common import table

    scratch = Scratch(spark, "token-store")
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    store = TokenStore(spark, scratch.root, vocabulary_size(tokenizer)).write(table(spark, sf_dir, "documents"), tokenizer, 2)
    return store.read_lengths_and_crc()
