"""Ranked lexical search over bit-sliced Bloom signatures.

Documents lie in blocks of at most ``BLOCK`` of like size. A block is a matrix of bits, a row for each bit position of
a Bloom filter and a column for each document: a term's rows, and-ed, name the documents that may hold it. A term
that occurs tf times is put in at the levels 0 to floor(log2(tf)), each under other rows, so that the levels bound tf
from above as well. For each item the rows of its terms, summed by weight, level by level, bound every document's score.

A first pass over the blocks takes each item's documents with the highest bounds and scores them exactly; the lowest of
their best ``top`` scores is the item's threshold. A second pass names every document whose bound reaches it. All of
these are scored exactly from their whole texts: what is left out is proven to be worse, so the result is that of a
search through all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import floor, log

from pyspark.sql import DataFrame, Window, functions as F

from ._util import cut, discard, small_side

BLOCK = 1024
_HASHES = 4
_BITS_PER_TERM = 16
_LEVELS = 12
_MOST = 1_000_000
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """A text's terms in order: runs of ASCII letters, digits and all characters beyond ASCII, only A-Z lower-cased."""
    return _TERM.findall((text or "").encode().lower())


def _hashes(terms) -> "np.ndarray":
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, terms), "u8", len(terms))


def _positions(hashes, level, rows: int):
    """The bit positions (len(hashes), ``_HASHES``) of terms at levels."""
    import numpy as np

    x = (hashes + np.asarray(level, "u8") * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] & np.uint64(0xFFFFFFFF)) + np.arange(_HASHES, dtype="u8") * step[:, None]) % np.uint64(rows)


def _packed(group: list):
    """One block of documents (doc_id, tag, n, hashes, levels): (ids, tags, lengths, rows, bits)."""
    import numpy as np

    size = [int((levels + 1).sum()) for *_, levels in group]
    rows = max(64, _BITS_PER_TERM * max(size))
    bits = np.zeros((rows, len(group)), "u1")
    for d, (_, _, _, hashes, levels) in enumerate(group):
        for level in range(int(levels.max(initial=0)) + 1):
            bits[_positions(hashes[levels >= level], level, rows).ravel().astype("i8"), d] = 1
    column = lambda i: np.array([g[i] for g in group], "i8").tobytes()
    return column(0), column(1), column(2), rows, np.packbits(bits, axis=1).tobytes()


def build_index(docs: DataFrame) -> DataFrame:
    """(ids, tags, lengths, n_rows, bits, n_docs, n_terms) of every block; n_docs and n_terms count only documents with a term.

    Documents without a doc_id or without terms, null and empty texts among them, can't be found and are left out. A
    worker holds one open block for each doubling of the documents' size; a block of very long texts closes early.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def row(group):
            lengths = [g[2] for g in group]
            values = (*_packed(group), len(group), sum(lengths))
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["ids", "tags", "lengths", "n_rows", "bits", "n_docs", "n_terms"])

        open_: dict[int, list] = {}
        for batch in batches:
            for doc_id, text, tag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = Counter(terms_of(text.as_py()))
                if not found:
                    continue
                tf = np.fromiter(found.values(), "i8", len(found))
                levels = np.minimum(np.frexp(tf)[1] - 1, _LEVELS - 1)
                kind = len(found).bit_length()
                group = open_.setdefault(kind, [])
                group.append((doc_id, tag, int(tf.sum()), _hashes(found), levels))
                # The bits of a block are bounded: 2 bytes for each of at most 2 ** kind terms at some levels, times its documents.
                if len(group) >= max(8, min(BLOCK, (1 << 22) >> kind)):
                    yield row(open_.pop(kind))
        for group in open_.values():
            yield row(group)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("tag"))
    return texts.mapInArrow(run, "ids binary, tags binary, lengths binary, n_rows long, bits binary, n_docs long, n_terms long")


@dataclass
class Items:
    """A bounded block of items: their terms, each once, and the terms' places in a common list."""

    keys: list = field(default_factory=list)
    terms: list[bytes] = field(default_factory=list)
    places: list[list[int]] = field(default_factory=list)

    @classmethod
    def blocks(cls, items: DataFrame, most_items: int = 512, most_terms: int = 100_000) -> Iterator["Items"]:
        """The distinct rows of ``items`` (key, text), a block at a time on the driver."""
        block, at = cls(), {}
        for key, text in items.distinct().toLocalIterator():
            own = list(dict.fromkeys(terms_of(text)))
            block.keys.append(key)
            block.places.append([at.setdefault(t, len(at)) for t in own])
            if len(block.keys) >= most_items or len(at) >= most_terms:
                block.terms = list(at)
                yield block
                block, at = cls(), {}
        if block.keys:
            block.terms = list(at)
            yield block


def document_frequencies(docs: DataFrame, items: Items) -> list[int]:
    """In how many documents each term of the block of items occurs, counted from all whole texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wanted, found = set(items.terms), Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(wanted.intersection(terms_of(text.as_py())))
        at = {t: i for i, t in enumerate(items.terms)}
        yield pa.RecordBatch.from_arrays([pa.array([at[t] for t in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["place", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    counts = texts.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = [0] * len(items.terms)
    for place, n in counts:
        out[place] = n
    return out


def term_weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def length_factor(n, documents: int, total: int):
    """A document's m, of a number or an array of lengths."""
    return 50 + 50 * n * documents // total


def term_score(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _bounds(block: dict, items: Items, weights: list[int], documents: int, total: int):
    """Upper bounds (items, documents) of all scores in a block."""
    import numpy as np

    lengths = np.frombuffer(block["lengths"], "i8")
    bits = np.frombuffer(block["bits"], "u1").reshape(block["n_rows"], -1)
    m = length_factor(lengths, documents, total)
    hashes, w = _hashes(items.terms), np.array(weights, "i8")
    bounds = np.zeros((len(items.keys), len(lengths)), "i8")
    alive, have, before = np.arange(len(hashes)), None, np.zeros(len(lengths), "i8")
    for level in range(_LEVELS):
        at = _positions(hashes[alive], level, block["n_rows"]).astype("i8")
        now = np.bitwise_and.reduce(bits[at], axis=1)
        now = now if have is None else now & have
        some = now.any(axis=1)
        alive, have = alive[some], now[some]
        if not len(alive):
            break
        row = np.full(len(hashes), -1)
        row[alive] = np.arange(len(alive))
        present = np.unpackbits(have, axis=1, count=len(lengths))
        cap = term_score(np.int64((2 << level) - 1), m) if level < _LEVELS - 1 else np.full(len(lengths), _MOST)
        gain, before = cap - before, cap
        for i, places in enumerate(items.places):
            r = row[places]
            mine = w[places][r >= 0]
            if len(mine):
                bounds[i] += gain * (mine.astype("f8") @ present[r[r >= 0]]).astype("i8")
    return bounds


def _candidates(index: DataFrame, items: Items, weights: list[int], documents: int, total: int, top: int, least: list[int] | None) -> DataFrame:
    """(item, doc_id, tag, bound): every document whose bound reaches the item's ``least``; without it the ``top`` highest bounds of each task."""

    def run(batches: Iterator) -> Iterator:
        import heapq

        import numpy as np
        import pyarrow as pa

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["item", "doc_id", "tag", "bound"])

        best: list[list] = [[] for _ in items.keys]
        for batch in batches:
            for block in batch.to_pylist():
                bounds = _bounds(block, items, weights, documents, total)
                ids, tags = np.frombuffer(block["ids"], "i8"), np.frombuffer(block["tags"], "i8")
                if least is not None:
                    i, d = np.nonzero(bounds >= np.maximum(np.array(least, "i8"), 1)[:, None])
                    yield batch_of((i, ids[d], tags[d], bounds[i, d]))
                    continue
                for i, row in enumerate(bounds):
                    low = best[i][0][0] if len(best[i]) >= top else 0
                    hits = np.flatnonzero(row > low)
                    if len(hits) > top:
                        hits = hits[np.argpartition(row[hits], -top)[-top:]]
                    for d in hits.tolist():
                        entry = (int(row[d]), int(ids[d]), int(tags[d]))
                        heapq.heappush(best[i], entry) if len(best[i]) < top else heapq.heappushpop(best[i], entry)
        if least is None:
            rows = [(i, d, t, b) for i, heap in enumerate(best) for b, d, t in heap]
            yield batch_of(list(zip(*rows)) if rows else ([],) * 4)

    return index.select("ids", "tags", "lengths", "n_rows", "bits").mapInArrow(run, "item long, doc_id long, tag long, bound long")


def _scored(docs: DataFrame, candidates: DataFrame, items: Items, weights: list[int], documents: int, total: int, broadcast_rows: int) -> DataFrame:
    """(item, doc_id, score) of the candidates (item, doc_id, tag), exactly; a document's items, a part of the block, are one array."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = Counter(terms_of(text.as_py()))
                m = length_factor(sum(found.values()), documents, total)
                for item in set(wanted):
                    score = sum(weights[p] * term_score(tf, m) for p in items.places[item] if (tf := found.get(items.terms[p])))
                    if score > 0:
                        out.append((item, doc_id, score))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([],) * 3)], ["item", "doc_id", "score"])

    asked = candidates.groupBy("doc_id", "tag").agg(F.collect_set("item").alias("items"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    met = texts.withColumn("tag", F.xxhash64("text")).join(small_side(cut(asked), broadcast_rows), ["doc_id", "tag"])
    return met.select("doc_id", "text", "items").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 50, broadcast_rows: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) its ``top`` documents with a score above 0, the highest first, equal scores by doc_id.

    N counts the documents with a term, L all their terms, n one document's. A term weighs w = floor(1000 ln((2N + 2) /
    (2df + 1))); a document's score sums w * ((10^9 tf) div (1000 tf + 20 m)) over the item's different terms, with
    m = 50 + (50 n N) div L.

    Null and empty texts have no terms: such documents aren't found, such items find nothing. Documents without a doc_id
    count in N, L and df but can't be found. Rows that repeat a doc_id are documents of their own; equal rows of items
    count once. Empty tables give no rows; other columns, of any name, are left out. Items come to the driver in blocks
    of at most 512, for each of which the index is read twice and the texts once and where they are scored.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = cut(build_index(sized))
    nameless = sized.where("doc_id is null and text is not null").select(F.lit(0).cast("long").alias("doc_id"), "text")
    counts = [r for r in (index.agg(F.sum("n_docs"), F.sum("n_terms")).first(), build_index(nameless).agg(F.sum("n_docs"), F.sum("n_terms")).first())]
    documents, total = (sum(r[i] or 0 for r in counts) for i in (0, 1))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not documents:
        discard(index)
        return out
    for block in Items.blocks(items.select("item_id", F.col("text").cast("string").alias("text"))):
        weights = [term_weight(documents, df) for df in document_frequencies(sized, block)]
        basis = (block, weights, documents, total)
        by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
        first = _candidates(index, *basis, top, None).withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= top)
        by_score = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = lambda scored: scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
        least = [0] * len(block.keys)
        for item, score in ranked(_scored(sized, first, *basis, broadcast_rows)).where(F.col("rank") == top).select("item", "score").collect():
            least[item] = score
        every = _candidates(index, *basis, top, least)
        best = cut(ranked(_scored(sized, every, *basis, broadcast_rows)).select("item", "rank", "doc_id", "score"))
        names = spark.createDataFrame(list(enumerate(block.keys)), f"item long, item_id {kind}")
        out = out.union(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    discard(index)
    return out
