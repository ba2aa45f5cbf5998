"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Lengths fall into classes by reciprocals of the capacity: a piece of class k is at most capacity/k long, and a bin of
class k takes exactly k pieces. Bins fill on each worker alone, without a shuffle. Long documents give off whole
sequences, then halves, quarters and so on down to ``least``, which fill bins of their classes to the last place; the
shorter rest of a document stays in one piece. What a worker's unfilled bins hold at its end is strung together and cut
at the capacity; the last part is cut at powers of two, lengths that need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ._util import documents_of, in_slices
from .words import portions, table, without_cycles

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def rest_classes(capacity: int, least: int) -> list[int]:
    """Pieces a bin for rests: every number while they are large, then steps of about an eighth."""
    out, k = [], capacity // least
    while k < capacity:
        out.append(k)
        k += max(1, k // 16)
    return [*out, capacity]


class Packer:
    """One worker's bins. ``add`` and ``close`` return finished rows."""

    def __init__(self, worker: int, capacity: int, least: int):
        self.capacity, self.least, self.next = capacity, least, worker << 40
        self.halves = [capacity >> i for i in range(1, capacity.bit_length()) if capacity >> i >= least]
        self.rests = rest_classes(capacity, least)
        self.bins: dict[tuple[int, bool], list[tuple]] = {}

    def rest_class(self, length: int) -> int:
        from bisect import bisect_right

        return self.rests[bisect_right(self.rests, self.capacity // length) - 1]

    def sequence(self, pieces: list[tuple]) -> list[tuple]:
        """pieces: (doc_id, start, ids, doc_tokens)."""
        rows, offset = [], 0
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, len(ids), total, self.next, offset, ids.tobytes()))
            offset += len(ids)
        self.next += 1
        return rows

    def put(self, k: int, whole: bool, piece: tuple) -> list[tuple]:
        held = self.bins.setdefault((k, whole), [])
        held.append(piece)
        return self.sequence(self.bins.pop((k, whole))) if len(held) == k else []

    def add(self, doc_id, ids) -> list[tuple]:
        rows, at, total = [], 0, len(ids)
        while total - at >= self.capacity:
            rows += self.sequence([(doc_id, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        for half in self.halves:
            if total - at >= half:
                rows += self.put(self.capacity // half, False, (doc_id, at, ids[at : at + half], total))
                at += half
        if total > at:
            rows += self.put(self.rest_class(total - at), True, (doc_id, at, ids[at:].copy(), total))
        return rows

    def close(self) -> list[tuple]:
        left = [p for key in sorted(self.bins) for p in self.bins[key]]
        room = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (room // self.capacity) + [1 << i for i in reversed(range(self.capacity.bit_length())) if room % self.capacity >> i & 1]
        rows, left = [], left[::-1]
        for size in sizes:
            taken = []
            while size:
                doc_id, start, ids, total = left.pop()
                if len(ids) > size:
                    left.append((doc_id, start + size, ids[size:], total))
                    ids = ids[:size]
                taken.append((doc_id, start, ids, total))
                size -= len(ids)
            rows += self.sequence(taken)
        self.bins.clear()
        return rows


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, least: int = 256, known_words: int = 400_000, portion: int = 16_000_000, small_workers: bool = False) -> DataFrame:
    """The pieces of all documents with their place: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    A document is its ids and ``end_id``; each id lies in exactly one piece. ``capacity`` is a power of two. Null and
    empty texts are just ``end_id``. A worker remembers about ``known_words`` words and reads ``portion`` bytes of text at
    once; smaller numbers take less memory and more time, and give the same result. ``small_workers`` forget their words
    when a task ends and read few rows at once, which does so too: an idle worker keeps the vocabulary only. Repeated rows and null ids are packed like any other; an empty table gives no rows.
    """
    if capacity & (capacity - 1) or least > capacity:
        raise ValueError("capacity must be a power of two, and least not above it")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words = table(tokenizer_path, known_words)
        packer = Packer(TaskContext.get().partitionId(), capacity, least)
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        rows: list[tuple] = []
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for start, texts in portions(batch.column(1), portion):
                ids, ends = words.encode(texts)
                for i in range(len(texts)):
                    rows += packer.add(doc_ids[start + i], np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)))
                    if len(rows) > portion // 800:
                        yield batch_of(rows)
                        rows = []
        rows += packer.close()
        if rows:
            yield batch_of(rows)
        if small_workers:
            words.forget()

    return documents_of(docs).mapInArrow(without_cycles(in_slices(run) if small_workers else run), SCHEMA)
