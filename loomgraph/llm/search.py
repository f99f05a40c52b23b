"""Exact BM25 top-k search over an inverted index: estimates of all scores, exact ones where an estimate reaches the threshold.

Index: documents are taken in shards of ``SHARD_DOCS`` neighbouring rows, or fewer with ``SHARD_BYTES`` of text (a longer
text is a shard of its own). A shard is one row of the index table and holds, for each of its terms, the postings
(document, frequency) in document order. Document frequencies, the number of documents and their mean length are
those of all shards: the shards' counts are added up by term and joined to the terms of the queries.

Search: a task joins neighbouring shards up to ``JOINED_DOCS`` documents, as much of a query's work comes once for each.
Every document's score is estimated for every query: the frequent terms by one matrix product for a part of the queries,
the others by adding up their postings, in which a document and its weighted impact share one number. The estimate is off by
less than ``ROUNDING``; documents whose estimate reaches the query's threshold are scored in double precision, all
others can't enter. The threshold is the k-th best score so far over all shards that the task has seen. It does not start
at zero: before the search, each query is answered from ``SEEDS`` shards, and the k-th best score there is a true lower
bound of the k-th best of all. Each task returns its k best per query, and merging them is exact because all scores use the
same global statistics. There are no bounds of blocks: texts that share only common words leave a third of the blocks in question,
and the bounds cost more than the sums.

Queries go out in rounds of at most ``ROUND_BYTES``, so that what is broadcast does not grow with the query set. A shard
is read where its row is stored, once for each round; the index is never shuffled.

Terms are runs of letters, digits and combining marks of the lower-cased text, known by 64 bits of hash: of 1e9 distinct
terms about 0.03 pairs are expected to share one. Ties in score go to the smaller doc_id.
Null and empty texts have no terms: as queries they find nothing. Documents that share no term with a query are not
returned. Rows with a null doc_id are neither found nor used as queries. Rows with equal doc_id are found one by one;
queries that share a doc_id are answered one by one, under the same query_id.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, Words, expand, pack_ints, parallelism, ranges, squeeze, text_blocks, unpack_ints, with_part

K1, B = 1.2, 0.75
SHARD_DOCS, SHARD_BYTES = 8192, 16 << 20
BLOCK_DOCS = 16  # documents of a shard with no more than two such blocks are ordered by length only
DENSE = 2048  # terms of a shard, at most, whose postings are kept as rows of a matrix, and
DENSE_SHARE = 10  # in how many documents, one of these, such a term occurs at least
JOINED_DOCS, JOINED_BYTES = 16384, 48 << 20  # shards that are searched as one, at most (the bytes are those of a shard's row)
LONG = 128  # postings of a term, from which on they are copied as one piece
REPEATS = 4  # of a word in a query, up to which its postings are added again and again
DOC_BITS = 16  # for places in a shard
CLUSTERS, TURNS = 64, 3  # of similar documents
WAVES = (1,)  # a query without threshold gets one from so many times k documents, those that look best
ROUNDING = 2e-4  # relative error of sums of DENSE products in single precision, and more
LIKENESS = 512  # frequent terms by which documents are found alike
SEEDS = 5
PART_QUERIES, PART_BYTES = 192, 3 << 19
ROUND_BYTES = 48 << 20
_GAPS = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_ASCII_GAPS = bytes(x if x > 127 or chr(x).isalnum() else 32 for x in range(256))
FEW_GAPS = 32  # kinds of characters outside ASCII that are replaced kind by kind


def _spaced(raw: list[bytes]) -> list[bytes]:
    """Texts in lower case with spaces for all that is no letter, mark or digit: bytes by a table, other characters by what kinds there are."""
    texts = [x.decode().lower() for x in raw]
    gaps = [c for c in set().union(*map(set, texts)) if c > "\x7f" and _GAPS.match(c)]
    if len(gaps) > FEW_GAPS:
        return [_GAPS.sub(" ", x).encode() for x in texts]
    for c in gaps:
        texts = [x.replace(c, " ") for x in texts]
    return [x.encode().translate(_ASCII_GAPS) for x in texts]


def _terms(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by document, then term: document, term hash, frequency; and each document's length. Texts are cut to terms slice by slice."""
    found: list[tuple[np.ndarray, ...]] = []
    begin = size = 0
    for i, x in enumerate(raw):
        size += len(x)
        if size < SLICE_BYTES and i + 1 < len(raw):
            continue
        words = Words(_spaced(raw[begin : i + 1]))
        order = np.lexsort((words.hash, words.doc))
        doc, h = words.doc[order], words.hash[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
        found.append(((doc[new] + begin).astype(np.int32), h[new], np.diff(new, append=len(h)).astype(np.uint32), words.count))
        begin, size = i + 1, 0
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# --------------------------------------------------------------------------- index
_INDEX = "shard long, ids binary, lengths binary, terms binary, sizes binary, docs binary, counts binary, n long, words long"


def _frequent(sizes: np.ndarray, n: int, most: int) -> np.ndarray:
    """The terms kept as columns."""
    chosen = np.flatnonzero(sizes >= max(2, n // DENSE_SHARE))
    return np.sort(chosen[np.argsort(-sizes[chosen], kind="stable")[:most]])


def _by_likeness(doc: np.ndarray, place: np.ndarray, sizes: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """An order of the documents in which those with like frequent terms, and among them those of like length, are neighbours."""
    n = len(length)
    columns = _frequent(sizes, n, min(LIKENESS, DENSE))
    if n <= 2 * BLOCK_DOCS or not len(columns):
        return np.argsort(length, kind="stable")
    number = np.full(len(sizes), -1)
    number[columns] = np.arange(len(columns))
    on = number[place] >= 0
    m = np.zeros((n, len(columns)), np.float32)
    m[doc[on], number[place[on]]] = count[on] / (count[on] + K1) * np.log1p(n / sizes[place[on]])
    m /= np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-9)[:, None]
    centres = m[:: max(1, n // CLUSTERS)][:CLUSTERS].copy()
    own = np.zeros(n, np.int64)
    for _ in range(TURNS):
        own = (m @ centres.T).argmax(1)
        for k in np.unique(own):
            mean = m[own == k].sum(0)
            centres[k] = mean / max(float(np.sqrt(mean @ mean)), 1e-9)
    return np.lexsort((length, own))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, ids, raw in text_blocks(batches, SHARD_DOCS, SHARD_BYTES):
        doc, term, count, length = _terms(raw)
        terms, place, sizes = np.unique(term, return_inverse=True, return_counts=True)
        order = _by_likeness(doc, place, sizes, count, length)
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        doc = moved[doc]
        at = np.lexsort((doc, place))
        row = [shard, np.array(ids, "<i8")[order].tobytes(), length[order].astype("<u4").tobytes(), pack_ints(np.diff(terms, prepend=np.uint64(0)), 8), pack_ints(sizes, 4), doc[at].astype("<u2").tobytes(), pack_ints(count[at], 4), len(ids), int(length.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "ids", "lengths", "terms", "sizes", "docs", "counts", "n", "words"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each shard: in how many of its documents it is."""
    for b in batches:
        for terms, sizes in zip(b.column("terms").to_pylist(), b.column("sizes").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(unpack_ints(terms, 8)).view(np.int64)), pa.array(unpack_ints(sizes, 4).astype(np.int64))], names=["term", "n"])


# --------------------------------------------------------------------------- queries
_PART = "part long, ids binary, sizes binary, terms binary, place binary, counts binary"


def _query_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in parts; a part lists its terms once, and each query refers to them."""
    for part, ids, raw in text_blocks(batches, PART_QUERIES, PART_BYTES):
        doc, term, count, _ = _terms(raw)
        terms, place = np.unique(term, return_inverse=True)
        row = [part, np.array(ids, "<i8").tobytes(), np.bincount(doc, minlength=len(ids)).astype("<u4").tobytes(), terms.astype("<u8").tobytes(), squeeze(pack_ints(np.diff(place.astype(np.uint32), prepend=np.uint32(0)), 4)), squeeze(pack_ints(count, 4))]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "ids", "sizes", "terms", "place", "counts"])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, terms in zip(b.column("part").to_pylist(), b.column("terms").to_pylist(), strict=True):
            t = np.frombuffer(terms, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), part)), pa.array(t)], names=["part", "term"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one part: its terms that documents have, and their document frequencies."""
    current, found, known = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([np.concatenate(found).tobytes()]), pa.array([np.concatenate(known).tobytes()])], names=["part", "known", "frequencies"])

    for b in batches:
        part, term, n = (b.column(c).to_numpy() for c in ("part", "term", "n"))
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for begin, end in zip(edges, edges[1:], strict=False):
            if begin == end:
                continue
            if part[begin] != current:
                yield from flush()
                current, found, known = int(part[begin]), [], []
            found.append(term[begin:end].copy())
            known.append(n[begin:end].copy())
    yield from flush()


def _idf(row: dict, n_docs: int) -> bytes:
    """The weight of each of a part's terms; 0 for those that no document has."""
    f = np.zeros(len(row["terms"]) // 8)
    if row["known"]:
        f[np.searchsorted(np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["known"], "<u8"))] = np.frombuffer(row["frequencies"], "<i8")
    return np.where(f > 0, np.log1p((n_docs - f + 0.5) / (f + 0.5)), 0.0).tobytes()


class _Part:
    """Queries with the weight of each of their terms, their thresholds, and the best documents so far."""

    def __init__(self, row: dict, k: int):
        self.part, self.k = row["part"], k
        self.row = row
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.floor = np.frombuffer(row["floor"], "<f8").copy() if row.get("floor") else np.zeros(len(self.ids))
        self.best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in self.ids]

    def expanded(self) -> tuple[np.ndarray, ...]:
        """The part's terms; for each term of each query its place among them, its count and the query; and the terms' idf.

        Not kept, as a task holds all parts of a round.
        """
        sizes = np.frombuffer(self.row["sizes"], "<u4").astype(np.int64)
        place = np.cumsum(unpack_ints(expand(self.row["place"]), 4).astype(np.uint32), dtype=np.uint32).astype(np.int64)
        count = unpack_ints(expand(self.row["counts"]), 4).astype(np.int64)
        return np.frombuffer(self.row["terms"], "<u8"), place, count, np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(self.row["idf"], "<f8")

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = (np.concatenate(x) for x in zip(self.best[q], (ids, scores), strict=True))
        top = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = ids[top], scores[top]
        if len(top) == self.k:
            self.floor[q] = max(self.floor[q], scores[top[-1]])


# --------------------------------------------------------------------------- search
def _joined(rows: list[dict]) -> dict:
    """Shards as one."""
    if len(rows) == 1:
        return rows[0]
    terms, sizes = [np.cumsum(unpack_ints(r["terms"], 8)) for r in rows], [unpack_ints(r["sizes"], 4).astype(np.int64) for r in rows]
    first = np.cumsum([0, *(r["n"] for r in rows)])
    docs = np.concatenate([np.frombuffer(r["docs"], "<u2") + x for r, x in zip(rows, first.tolist(), strict=False)])
    counts, sizes = np.concatenate([unpack_ints(r["counts"], 4) for r in rows]), np.concatenate(sizes)
    terms, place = np.unique(np.concatenate(terms), return_inverse=True)
    order = np.argsort(place, kind="stable")
    end = np.cumsum(sizes)
    at, _ = ranges((end - sizes)[order], end[order])
    sizes = np.bincount(place, sizes, len(terms))
    return {"ids": b"".join(r["ids"] for r in rows), "lengths": b"".join(r["lengths"] for r in rows), "terms": pack_ints(np.diff(terms, prepend=np.uint64(0)), 8), "sizes": pack_ints(sizes, 4), "docs": docs[at].astype("<u2").tobytes(), "counts": pack_ints(counts[at], 4)}


def _together(rows: Iterator[dict]) -> Iterator[dict]:
    """Neighbouring shards as one, up to the size that a task can hold: what a query costs for each shard is paid more rarely."""
    held, n, size = [], 0, 0
    for row in rows:
        own = sum(len(x) for x in row.values() if isinstance(x, (bytes, bytearray)))
        if held and (n + row["n"] > JOINED_DOCS or size + own > JOINED_BYTES):
            yield _joined(held)
            held, n, size = [], 0, 0
        held.append(row)
        n, size = n + row["n"], size + own
    if held:
        yield _joined(held)


def _marks(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) & ((1 << DOC_BITS) - 1)


def _mark(x: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Puts documents in place of the last bits of doubles, which changes these by less than 2**-35 of their size."""
    bits = x.view(np.int64)
    bits &= -1 << DOC_BITS
    bits |= docs
    return x


class _Shard:
    def __init__(self, row: dict, mean: float):
        self.ids = np.frombuffer(row["ids"], "<i8")
        n = len(self.ids)
        length = np.frombuffer(row["lengths"], "<u4").astype(float)
        self.terms = np.cumsum(unpack_ints(row["terms"], 8))
        sizes = unpack_ints(row["sizes"], 4).astype(np.int64)
        docs = np.frombuffer(row["docs"], "<u2")
        tf = unpack_ints(row["counts"], 4).astype(np.uint32)
        self.norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        # postings by term, for estimates: impacts less idf, which the queries bring, with the document in the last bits
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.postings = self.norm[docs]
        self.postings += tf
        np.divide(tf, self.postings, out=self.postings)
        self.postings *= K1 + 1
        self.weighed = np.zeros(len(sizes), bool)  # the terms whose postings have been multiplied by idf
        # frequent terms: a row of impacts each, in single precision and without idf
        dense = _frequent(sizes, n, DENSE)
        self.row = np.full(len(sizes), -1, np.int32)
        self.row[dense] = np.arange(len(dense), dtype=np.int32)
        self.impacts = np.zeros((len(dense), n), np.float32)
        for i, x in enumerate(dense.tolist()):
            own = slice(self.begin[x], self.begin[x + 1])
            self.impacts[i, docs[own]] = self.postings[own]
        _mark(self.postings, docs)
        # the postings by document
        order = np.argsort(docs, kind="stable")
        self.doc_term, self.doc_tf = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], tf[order]
        self.doc_begin = np.searchsorted(docs[order], np.arange(n + 1))

    def _weigh(self, terms: np.ndarray, idf: np.ndarray) -> None:
        """Brings idf to the postings of terms that no query had yet; it is the same for all queries."""
        new = ~self.weighed[terms]
        terms, idf = terms[new], idf[new]
        at, of = ranges(self.begin[terms], self.begin[terms + 1])
        found = self.postings[at]
        self.postings[at] = _mark(found * idf[of], _marks(found))
        self.weighed[terms] = True

    def visit(self, queries: _Part) -> None:
        if not len(self.terms):
            return
        nq, n = len(queries.ids), len(self.ids)
        asked, place, count, of, idf = queries.expanded()
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        here = (self.terms[at] == asked) & (idf > 0)
        self._weigh(at[here], idf[here])
        on = here[place]
        place, count, of = place[on], count[on], of[on]
        at, weight = at[place], count * idf[place]
        own = np.searchsorted(of, np.arange(nq + 1)).tolist()
        # frequent terms: one product
        row = self.row[at]
        on = row >= 0
        w = np.zeros((nq, len(self.impacts)), np.float32)
        w[of[on], row[on]] = weight[on]
        common = w @ self.impacts
        # the others: short lists of postings are picked one by one, long ones copied as they are
        size = self.begin[at + 1] - self.begin[at]
        short = ~on & (size < LONG) & (count <= REPEATS)
        few, more = np.flatnonzero(short), np.flatnonzero(~on & ~short)
        times = np.where(count[more] <= REPEATS, count[more], 1)
        few, more = np.repeat(few, count[few]), np.repeat(more, times)  # a word that a query has twice is added twice
        many = count[more] > REPEATS
        order = np.lexsort((many, of[more]))
        more, many = more[order], many[order]
        begin, long = self.begin[at[few]], size[few]
        last = np.cumsum(long)
        jump = begin - np.concatenate([[0], (begin + long)[:-1]]) + 1  # from the last posting of a term to the first of the next
        cut, cut_more = (np.searchsorted(of[x], np.arange(nq + 1)).tolist() for x in (few, more))
        cut_many = np.searchsorted(2 * of[more] + many, 2 * np.arange(nq) + 1).tolist()
        lists = list(zip(self.begin[at[more]].tolist(), self.begin[at[more] + 1].tolist(), strict=True))
        for q in range(nq):
            i, j = cut[q], cut[q + 1]
            pieces = [self.postings[x:y] for x, y in lists[cut_more[q] : cut_more[q + 1]]]
            if i < j:
                step = np.ones(last[j - 1] - last[i] + long[i], np.int64)
                step[0] = begin[i]
                step[last[i : j - 1] - (last[i] - long[i])] = jump[i + 1 : j]
                pieces.insert(0, self.postings[np.cumsum(step, out=step)])
            score = common[q]
            if pieces:
                found = np.concatenate(pieces)
                where = _marks(found)
                if cut_many[q] < cut_more[q + 1]:
                    which = more[cut_many[q] : cut_more[q + 1]]
                    times = np.repeat(count[which], size[which])
                    found[len(found) - len(times) :] *= times
                score = np.bincount(where, found, n)
                score += common[q]
            terms = slice(own[q], own[q + 1])
            if not queries.floor[q]:
                some = min(n, WAVES[0] * queries.k)
                best = np.argpartition(score, n - some)[n - some :]
                best = best[score[best] > 0]
                if len(best):
                    self._score(queries, q, at[terms], weight[terms], best)
                score[best] = 0
            least = queries.floor[q] * (1 - ROUNDING)
            kept = np.flatnonzero(score >= least) if least else np.flatnonzero(score)
            if len(kept):
                self._score(queries, q, at[terms], weight[terms], kept)

    def _score(self, queries: _Part, q: int, terms: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> None:
        """The scores of documents in double precision, each added up in the order of the terms, so that equal texts get equal ones."""
        terms = terms.astype(np.int32)
        for begin in range(0, len(docs), 1024):
            part = docs[begin : begin + 1024]
            start, end = self.doc_begin[part], self.doc_begin[part + 1]
            postings, which = [], []
            for i, j in zip(start.tolist(), end.tolist(), strict=True):
                own = self.doc_term[i:j]
                at = np.searchsorted(own, terms)
                at[at == len(own)] = 0
                hit = np.flatnonzero(own[at] == terms)
                postings.append(at[hit] + i)
                which.append(hit)
            of = np.repeat(np.arange(len(part)), [len(x) for x in which])
            tf = self.doc_tf[np.concatenate(postings)].astype(float)
            score = np.bincount(of, weight[np.concatenate(which)] * (tf * (K1 + 1) / (tf + self.norm[part][of])), len(part))
            hit = (score > 0) & (score >= queries.floor[q])
            if hit.any():
                queries.add(q, self.ids[part[hit]], score[hit])


def _floors(seeds, k: int, n_docs: int, mean: float):
    """Answers each part from the seed shards; the k-th best score becomes its queries' threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row | {"idf": _idf(row, n_docs)} for row in b.to_pylist()]
            parts = [_Part(row, k) for row in rows]
            for row in _together(seeds.value if parts else []):  # one is held at a time
                shard = _Shard(row, mean)
                for queries in parts:
                    shard.visit(queries)
                del shard
            names = ["part", "ids", "sizes", "terms", "place", "counts"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([r["idf"] for r in rows], pa.binary()), pa.array([p.floor.tobytes() for p in parts], pa.binary())], names=[*names, "idf", "floor"])

    return run


def _search(shared, k: int, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = None
        for row in _together(b.slice(i, 1).to_pylist()[0] for b in batches for i in range(len(b))):
            parts = [_Part(row, k) for row in shared.value] if parts is None else parts
            shard = _Shard(row, mean)
            for queries in parts:
                shard.visit(queries)
            del shard
        for queries in parts or []:
            rows = [(np.full(len(d), queries.ids[q]), d, s, np.full(len(d), q)) for q, (d, s) in enumerate(queries.best) if len(d)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (queries.part, *(np.concatenate(c).tobytes() for c in zip(*rows, strict=True)))], names=["part", "queries", "docs", "scores", "rows"])

    return run


def _merged(k: int):
    """Neighbouring rows of one part: the k best of each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        best: list[np.ndarray] = []  # query row, query, document, score

        def cut() -> None:
            nonlocal best
            order = np.lexsort((best[2], -best[3], best[0]))
            best = [x[order] for x in best]
            first = np.flatnonzero(np.diff(best[0], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
            best = [x[rank < k] for x in (*best[:4], rank + 1)]

        def flush() -> Iterator[pa.RecordBatch]:
            if best:
                cut()
                yield pa.RecordBatch.from_arrays([pa.array(best[1]), pa.array(best[4]), pa.array(best[2]), pa.array(best[3])], names=["query_id", "rank", "doc_id", "score"])

        for b in batches:
            for r in b.to_pylist():
                if r["part"] != current:
                    yield from flush()
                    current, best = r["part"], []
                more = [np.frombuffer(r[c], t) for c, t in (("rows", "<i8"), ("queries", "<i8"), ("docs", "<i8"), ("scores", "<f8"))]
                best = [np.concatenate(x) for x in zip(best[:4], more, strict=True)] if best else more
                if len(best[0]) > 1 << 20:
                    cut()
        yield from flush()

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents for each query; both tables: doc_id, text."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "search")

    def texts(df: DataFrame) -> DataFrame:
        return with_part(df).where("doc_id is not null")

    index = scratch.write(texts(docs).mapInArrow(_index, _INDEX), "index")
    n_docs, words = (int(x) for x in index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first())
    mean = words / max(1, n_docs)
    parts = scratch.write(texts(queries).mapInArrow(_query_parts, _PART), "parts")
    frequencies = index.select("terms", "sizes").mapInArrow(_counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    wanted = parts.select("part", "terms").mapInArrow(_wanted, "part long, term long")  # a term comes once from each part
    known = wanted.join(frequencies, "term").repartition(parallelism(spark), "part").sortWithinPartitions("part", "term").mapInArrow(_gathered, "part long, known binary, frequencies binary")
    seeds = [r.shard for r in index.where("n >= 1").select("shard").orderBy(F.xxhash64("shard")).limit(SEEDS).collect()]
    seeds = [r.asDict() for r in index.where(F.col("shard").isin(seeds)).collect()]  # SEEDS shards, each bounded by SHARD_BYTES or one text
    shared = spark.sparkContext.broadcast(seeds)
    ready = parts.join(known, "part", "left").repartition(parallelism(spark), "part").mapInArrow(_floors(shared, k, n_docs, mean), f"{_PART}, idf binary, floor binary")
    ready = scratch.write(ready, "queries")
    shared.unpersist()
    rounds, held, size = [], [], 0

    def go() -> None:
        shared = spark.sparkContext.broadcast(list(held))  # ROUND_BYTES and one part at most
        hits = index.mapInArrow(_search(shared, k, mean), "part long, queries binary, docs binary, scores binary, rows binary")
        rounds.append(scratch.write(hits, f"hits-{len(rounds)}"))
        shared.unpersist()

    for r in ready.toLocalIterator():
        held.append(r.asDict())
        size += sum(len(x) for x in held[-1].values() if isinstance(x, (bytes, bytearray)))
        if size >= ROUND_BYTES:
            go()
            held, size = [], 0
    if held or not rounds:
        go()
    hits = rounds[0]
    for more in rounds[1:]:
        hits = hits.unionByName(more)
    return hits.repartition(parallelism(spark), "part").sortWithinPartitions("part").mapInArrow(_merged(k), "query_id long, rank long, doc_id long, score double")


def every_50th(doc_id: Column) -> Column:
    return F.coalesce(doc_id % 50 == 0, F.lit(False))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where(every_50th(F.col("doc_id").cast("long")))).withColumn("score", F.round("score", 6))
