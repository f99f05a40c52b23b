"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a slice of a partition are laid out as one linked list of symbols. An index maps each
adjacent pair that has a merge rank to all its positions; the lowest active rank is taken from a heap, applied at all
its positions in ascending order, and the lists of the pairs that a merge makes are extended. Merges that other merges
have overtaken are recognised when their turn comes. Words don't touch, so each word goes through exactly its own
merges. A bounded cache carries encoded words from slice to slice.

Normalization and splitting follow the file's own settings: texts within common scripts take a fast path, all others
go through the library's normalizer and pre-tokenizer. Both give the same words.

Null text is empty: no ids, empty decoded text. Rows with equal or null doc_id stay separate. A very long text is read whole, as a slice of its own.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_alphabet, lean_batches, text_slices

CACHE_WORDS = 500_000  # about 100 MB
# Scripts in which Python's and the library's Unicode tables agree on letters, digits and case.
_UNUSUAL = regex.compile(r"[^\x00-ɏͰ-ͳΑ-ωЀ-џ‐-‧‰-⁞₠-₵]")


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("dropout") or spec["decoder"] or spec["post_processor"]:
            raise ValueError("a plain BPE file without decoder and post-processor is needed")
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or splits[1]["add_prefix_space"] or splits[1]["use_regex"]:
            raise ValueError("the words must come from one inverted split, followed by the byte alphabet")
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        self.simple = steps == ["NFC", "Replace", "Lowercase"]
        self.split = regex.compile(splits[0]["pattern"]["Regex"].replace(r"^\s", r"^\t-\r \x85\xa0"))
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.on_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.cache: dict[str, bytes] = {}

    # ---- text to words
    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens; each is encoded on its own."""
        if not self.simple or _UNUSUAL.search(text):
            plain = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            of_char = self._bytes_of
            return [bytes(of_char[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lowers each letter on its own
        return self.split.findall(text.lower())

    @functools.cached_property
    def _bytes_of(self) -> dict[str, int]:
        return {c: b for b, c in self.alphabet.items()}

    def parts(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """Alternately words and special tokens."""
        for i, x in enumerate(self.on_special.split(text) if self.on_special and any(s in text for s in self.special) else [text]):
            yield bool(i % 2), [x] if i % 2 else self.words(x)

    # ---- words to ids
    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the words, through one pair occurrence index over all of them."""
        ranks, vocab, alphabet, suffix = self.ranks, self.vocab, self.alphabet, self.suffix
        symbols: list[int] = [-1]
        begins = []
        for w in words:
            begins.append(len(symbols))
            chars = [alphabet[b] for b in w.encode()]
            chars[-1] += suffix
            symbols += [i for c in chars if (i := vocab.get(c)) is not None]  # without an unknown token, the library drops what it lacks
            symbols.append(-1)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for at in range(len(symbols) - 1):
            pair = (symbols[at], symbols[at + 1])
            if pair in ranks:
                places.setdefault(pair, []).append(at)
        active = [(ranks[p][0], p) for p in places]
        heapq.heapify(active)
        while active:
            rank, pair = heapq.heappop(active)
            first, second = pair
            made = ranks[pair][1]
            found = places.pop(pair, None)
            if found is None:
                continue
            found.sort()
            for k, at in enumerate(found):
                then = after[at]
                if symbols[at] != first or symbols[then] != second or before[then] != at:
                    continue
                symbols[at], symbols[then] = made, -2
                after[at] = beyond = after[then]
                before[beyond] = at
                lower = False
                for new, where in (((symbols[before[at]], made), before[at]), ((made, symbols[beyond]), at)):
                    if new in ranks:
                        if new not in places:
                            places[new] = [where]
                            heapq.heappush(active, (ranks[new][0], new))
                        else:
                            places[new].append(where)
                        lower |= ranks[new][0] < rank
                if lower and k + 1 < len(found):  # a lower rank has become active: it goes first
                    places.setdefault(pair, []).extend(found[k + 1 :])
                    heapq.heappush(active, (rank, pair))
                    break
        out = []
        for at in begins:
            ids = []
            if symbols[at] != -1:
                while symbols[at] != -1:
                    ids.append(symbols[at])
                    at = after[at]
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [list(self.parts(t)) for t in texts]
        cache = self.cache
        new = list(dict.fromkeys(w for parts in split for special, words in parts if not special for w in words if w not in cache))
        for w, ids in zip(new, self.merge(new), strict=True):
            cache[w] = np.array(ids, "<i4").tobytes()
        special = {t: np.array([i], "<i4").tobytes() for t, i in self.special.items()}
        out = [np.frombuffer(b"".join([x for is_special, words in parts for x in map((special if is_special else cache).__getitem__, words)]), "<i4") for parts in split]
        if len(cache) > CACHE_WORDS:  # what came first is what is frequent; later words last for their slice
            for w in new:
                del cache[w]
        return out

    # ---- ids to text
    def decode(self, ids: Iterable[int]) -> str:
        """A file without decoder joins its tokens by spaces; special tokens stay."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


@functools.lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def _source(docs: DataFrame) -> DataFrame:
    lean_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    own = codec(path)
    for batch, raw in text_slices(batches):
        yield batch.column("doc_id"), own.encode([x.decode() for x in raw])


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate([np.zeros(0, np.int32), *ids]))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids."""

    def run(batches):
        for doc_ids, ids in _encoded(path, batches):
            yield pa.RecordBatch.from_arrays([doc_ids, _lists(ids)], names=["doc_id", "ids"])

    return _source(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of a table of doc_id, ids."""

    def run(batches):
        own = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.decode(x or ()) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the text decoded from them, in one pass over the documents."""

    def run(batches):
        own = codec(path)
        for doc_ids, ids in _encoded(path, batches):
            lists = [x.tolist() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in lists]), pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in lists])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _source(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from .common import table

    return round_trip(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
