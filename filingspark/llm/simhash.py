"""SimHash near-duplicates, found with vantage-point trees.

A tree from a bounded sample splits the fingerprints by their Hamming distance to vantage points. Of a linked pair that
a split separates, the farther one lies within ``radius`` beyond the split's distance (triangle inequality), so the
near side takes these boundary fingerprints in as well and every linked pair shares a shard. Inside a shard, splitting
goes on in the same way down to leaves in which all distances are computed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ._util import cut, documents_of, in_slices
from .components import connected_components

SEED = 42


def _fingerprint(text: str | None, hash_of, width: int) -> int:
    import numpy as np

    words = (text or "").encode().lower().split()
    if len(words) < width:
        return hash_of(b" ".join(words)) if words else 0
    hashes = np.fromiter(map(hash_of, map(b" ".join, zip(*(words[i:] for i in range(width))))), "<u8", len(words) - width + 1)
    ones = np.zeros(64, "i8")
    for i in range(0, len(hashes), 1 << 17):
        bits = np.unpackbits(hashes[i : i + (1 << 17)].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="i4")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the 64-bit SimHash of the text's shingles of so many words as a signed long, 0 without words (null or empty text)."""

    def run(batches: Iterator) -> Iterator:
        from functools import partial

        import pyarrow as pa
        from xxhash import xxh64_intdigest

        hash_of = partial(xxh64_intdigest, seed=SEED)
        for batch in batches:
            fps = [_fingerprint(t, hash_of, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f - (f >> 63 << 64) for f in fps], pa.int64())], ["doc_id", "fp"])

    return documents_of(docs).mapInArrow(in_slices(run), "doc_id long, fp long")


def build_tree(sample, shards: int, radius: int):
    """Nested (vantage, distance, near, far); a leaf is its shard's number. The distance is the median, or the nearest one that leaves something on either side."""
    import numpy as np

    numbers = iter(range(1 << 30))

    def grow(points, parts: int):
        if parts > 1 and len(points) >= 8:
            best = None
            for vantage in points[:: max(1, len(points) // 5)][:5]:
                d = np.bitwise_count(points ^ vantage)
                for m in {int(np.median(d)), int(np.median(d)) - 1}:
                    near, far = int((d <= m + radius).sum()), int((d > m).sum())
                    if (d > m).any() and (d <= m).any() and (best is None or max(near, far) < best[0]):
                        best = (max(near, far), vantage, m, d)
            if best is not None and best[0] < 0.9 * len(points):
                _, vantage, m, d = best
                return int(vantage), m, grow(points[d <= m + radius], parts // 2), grow(points[d > m], parts - parts // 2)
        return next(numbers)

    return grow(np.asarray(sample, "u8"), shards)


def route(points, tree, radius: int):
    """Pairs (index of the point, shard)."""
    import numpy as np

    out = []

    def down(index, node):
        if not len(index):
            return
        if isinstance(node, int):
            out.append((index, np.full(len(index), node)))
            return
        vantage, m, near, far = node
        d = np.bitwise_count(points[index] ^ np.uint64(vantage))
        down(index[d <= m + radius], near)
        down(index[d > m], far)

    down(np.arange(len(points)), tree)
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.empty(0, int), np.empty(0, int))


class _Union:
    def __init__(self, n: int):
        import numpy as np

        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, pairs) -> None:
        for a, b in pairs:
            a, b = self.find(a), self.find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)


def link(points, radius: int = 2, leaf: int = 192):
    """For distinct fingerprints, each one's class: linked within ``radius``, directly or through others. No list of all pairs is made.

    A set that no vantage point divides (a dense ball) is looked up instead: each point's neighbours within ``radius`` by flipped bits.
    """
    import numpy as np

    union = _Union(len(points))
    one = [np.uint64(1 << i) for i in range(64)]

    def masks():
        from itertools import combinations

        for r in range(1, radius + 1):
            for c in combinations(one, r):
                m = np.uint64(0)
                for x in c:
                    m |= x
                yield m

    def brute(index):
        p = points[index]
        for start in range(0, len(p), 512):
            near = np.bitwise_count(p[start : start + 512, None] ^ p[None, start:]) <= radius
            a, b = np.nonzero(near)
            keep = b > a
            union.join(zip(index[start + a[keep]].tolist(), index[start + b[keep]].tolist()))

    def neighbours(index):
        order = index[np.argsort(points[index])]
        p = points[order]
        for m in masks():
            other = p ^ m
            at = np.minimum(np.searchsorted(p, other), len(p) - 1)
            hit = np.flatnonzero((p[at] == other) & (other > p))
            union.join(zip(order[hit].tolist(), order[at[hit]].tolist()))

    todo = [np.arange(len(points))]
    while todo:
        index = todo.pop()
        if len(index) <= leaf:
            if len(index) > 1:
                brute(index)
            continue
        p, best = points[index], None
        for vantage in p[:: max(1, len(p) // 4)][:4]:
            d = np.bitwise_count(p ^ vantage)
            m = int(np.median(d))
            m -= m and not (d > m).any()
            near, far = d <= m + radius, d > m
            size = max(int(near.sum()), int(far.sum()))
            if best is None or size < best[0]:
                best = (size, near, far)
        if best[0] < 0.8 * len(index):
            todo += [index[best[1]], index[best[2]]]
        elif len(index) <= 4096:
            brute(index)
        else:
            neighbours(index)
    return np.array([union.find(i) for i in range(len(points))])


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, sample_rows: int = 40_000, per_shard: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of at most ``radius`` differing bits reach, itself included.

    Equal fingerprints count once in the search. The tree that deals out the shards is fitted on at most
    ``sample_rows`` fingerprints; every fingerprint is routed through it and the result doesn't depend on it. Rows of
    one doc_id share a component only if their fingerprints do; a row with a null doc_id keeps a null or a linked
    document's component; an empty table gives no rows.
    """
    own = cut(fingerprints(docs, words))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    total = distinct.count()
    shards = max(1, -(-total // per_shard))
    tree = 0
    if shards > 1:
        some = distinct.select("fp")
        if total > sample_rows:
            some = some.where(F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * 0.9 * sample_rows / total)).limit(sample_rows)
        tree = build_tree(sorted(r.fp & (1 << 64) - 1 for r in some.collect()), shards, radius)

    def deal(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy()
            at, shard = route(fps.view("u8"), tree, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fps[at], pa.int64()), pa.array(np.asarray(shard, "i8"), pa.int64())], ["fp", "shard"])

    def forest(table):
        import pyarrow as pa

        fps = table.column("fp").to_numpy()
        root = link(fps.view("u8"), radius)
        mine = root != range(len(root))
        return pa.table({"a": pa.array(fps[mine], pa.int64()), "b": pa.array(fps[root[mine]], pa.int64())})

    links = distinct.select("fp").mapInArrow(deal, "fp long, shard long").groupBy("shard").applyInArrow(forest, "a long, b long")
    roots = cut(connected_components(links))
    members = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "least")
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    components = members.join(smallest, "root").select("fp", "component_id")
    alone = distinct.join(components, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return own.join(components.union(alone), "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
