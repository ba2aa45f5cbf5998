"""Exact Jaccard join of shingle sets by PartEnum signatures, and its connected components.

Sets are put into bands of sizes. Of two similar sets the larger one's band names a group, to which the smaller one
belongs as well; by the largest size of a group's band, similar sets of the group differ in at most k elements. The
domain of elements is parted by hash into n1 parts of n2 cells. As each part with more than k2 differing elements takes
k2 + 1 of the k, ``slack`` + 1 parts at least have k2 or fewer, and of such a part n2 - k2 cells agree whole: the
subsets of so many cells are enumerated, and a hash of the elements that fall there is a signature. Similar sets share one.

A subset without elements says little, and many sets would share it. A set leaves such signatures out while no more
than ``slack`` parts have them, for then one agreeing part is left with elements; the few other sets keep all.

Equal sets are one class. All signatures are shuffled once; only those that two classes share go on. So that a large
group of similar sets doesn't give all its pairs, each class first meets the first class of each shared signature;
what an exact count confirms joins components, and only pairs of different components that share a signature meet then.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import cut, discard, documents_of, small_side
from .components import connected_components

_WORDS = 8
_BITS = tuple(f"b{i}" for i in range(_WORDS))
_WIDEN = 1.35
_M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class Scheme(NamedTuple):
    """How a group parts the domain: parts, cells of each, cells that may differ, parts that may be empty."""

    n1: int
    n2: int
    k2: int
    slack: int


def most_different(total: int, percent: int) -> int:
    """In how many elements two sets may differ whose sizes add to ``total`` and whose similarity is ``percent`` at least."""
    return (100 - percent) * total // (100 + percent)


def scheme(k: int) -> Scheme:
    """One part and more cells for a few differences; else three cells of which one may differ."""
    if k <= 2:
        return Scheme(1, k + 3, k, 0)
    least = k // 2 + 1
    slack = 1 + -(-least // 20)
    return Scheme(least + slack, 3, 1, slack)


@cache
def bands(percent: int) -> list[tuple[int, int]]:
    """(lowest, highest) size of each band; neighbours at most are similar."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * max(_WIDEN, 102 / percent)))
        out.append((low, high))
        low = high + 1
    return out


@cache
def groups_of(n: int, percent: int) -> tuple[tuple[int, Scheme], ...]:
    """The groups that a set of ``n`` elements belongs to, where other than equal sets can be similar."""
    every = bands(percent)
    own = next(i for i, (low, high) in enumerate(every) if low <= n <= high)
    both = [own] + [own + 1] * (100 * n >= percent * every[own + 1][0])
    ks = [(g, most_different(2 * every[g][1], percent)) for g in both]
    return tuple((g, scheme(k)) for g, k in ks if k)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(29))) * np.uint64(_M1)
    return (x ^ (x >> np.uint64(32))) * np.uint64(_M2)


def signatures(elements, percent: int):
    """The signatures of a set of unsigned 64-bit hashes."""
    import numpy as np

    out = [np.empty(0, "u8")]
    if len(elements):
        mixed = _mixed(elements)
        part, cell = mixed >> np.uint64(32), mixed & np.uint64((1 << 32) - 1)
        for group, s in groups_of(len(elements), percent):
            at = ((part * np.uint64(s.n1) >> np.uint64(32)) * np.uint64(s.n2) + cell % np.uint64(s.n2)).astype("i8")
            sums = np.zeros(s.n1 * s.n2, "u8")
            np.add.at(sums, at, mixed)
            filled = np.bincount(at, minlength=len(sums)).reshape(s.n1, s.n2) > 0
            sums = sums.reshape(s.n1, s.n2)
            kept = [list(c) for c in combinations(range(s.n2), s.n2 - s.k2)]
            totals = np.stack([sums[:, c].sum(axis=1) for c in kept], axis=1)
            some = np.stack([filled[:, c].any(axis=1) for c in kept], axis=1)
            names = np.arange(totals.size, dtype="u8").reshape(totals.shape) + np.uint64(group << 40)
            found = _mixed(totals ^ _mixed(names + np.uint64(1)))
            out.append(found[some] if (~some.all(axis=1)).sum() <= s.slack else found.ravel())
    return np.unique(np.concatenate(out))


def shingles(text: str | None, width: int):
    """The sorted 64-bit hashes of a text's runs of ``width`` words; of all its words if it has fewer, none without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    hashes = np.fromiter(map(xxh64_intdigest, words), "u8", len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, "u8") if words else hashes
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(_M1) + hashes[k : k + n]
    return np.unique((out ^ (out >> np.uint64(29))) * np.uint64(_M2))


def _bitmap(elements):
    """Each element flips one of 512 bits, so no more bits than elements differ."""
    import numpy as np

    flips = np.bincount((elements >> np.uint64(3) & np.uint64(64 * _WORDS - 1)).astype("i8"), minlength=64 * _WORDS) & 1
    return np.packbits(flips.astype("u1"), bitorder="little").view("<i8").tolist()


def _set_hashes(elements) -> tuple[int, int]:
    from xxhash import xxh64_intdigest

    raw = elements.tobytes()
    return tuple(x - (x >> 63 << 64) for x in (xxh64_intdigest(raw, 1), xxh64_intdigest(raw, 2)))


def signed_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, b0..b7, sigs) of every row: the size of its set, two hashes of it, its bitmap and its signatures."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n", "h1", "h2", *_BITS, "sigs"]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, len(ids), 256):
                rows, sigs, ends = [], [], [0]
                for t in texts.slice(start, 256):
                    e = shingles(t.as_py(), width)
                    rows.append((len(e), *_set_hashes(e), *_bitmap(e)))
                    sigs.append(signatures(e, percent))
                    ends.append(ends[-1] + len(sigs[-1]))
                yield pa.RecordBatch.from_arrays([ids.slice(start, 256), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3 + _WORDS)), _lists(sigs, ends)], names)

    bits = ", ".join(f"{b} long" for b in _BITS)
    return documents_of(docs).mapInArrow(sign, f"doc_id long, n long, h1 long, h2 long, {bits}, sigs array<long>")


def _lists(parts, ends):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view("i8"), pa.int64()))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, words) of the wanted classes (node, doc_id, h1)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                sets = [shingles(t.as_py(), width) for t in part.column(1)]
                same = pc.equal(pa.array([_set_hashes(e)[0] for e in sets], pa.int64()), part.column(2))
                words = _lists([np.empty(0, "u8"), *sets], [0, *np.cumsum([len(e) for e in sets]).tolist()])
                yield pa.RecordBatch.from_arrays([part.column(3), words], ["node", "words"]).filter(same)

    texts = documents_of(docs).join(wanted, "doc_id").select("doc_id", "text", "h1", "node")
    return texts.mapInArrow(run, "node long, words array<long>")


def _near(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, broadcast_rows: int) -> DataFrame:
    """Of the pairs (a, b) of nodes those that are similar: by size and bitmap first, then by an exact count of common elements."""
    size = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), *(F.col(b).alias(f"{b}_{s}") for b in _BITS))
    fit = pairs.join(size("a"), "a").join(size("b"), "b").where(_fit(percent))
    fit = cut(fit.select("a", "b", "n_a", "n_b"))
    ids = fit.select(F.col("a").alias("node")).union(fit.select("b")).distinct()
    wanted = cut(classes.join(ids, "node", "left_semi").select("node", "doc_id", "h1"))
    sets = cut(_sets(docs, small_side(wanted, broadcast_rows), width).dropDuplicates(["node"]), wanted)
    words = lambda s: sets.select(F.col("node").alias(s), F.col("words").alias(f"words_{s}"))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    near = fit.join(words("a"), "a").join(words("b"), "b").where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared))
    return cut(near.select("a", "b"), fit, sets)


def _fit(percent: int) -> Column:
    n, m = F.col("n_a"), F.col("n_b")
    differ = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in _BITS[1:]), F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def similar_components(docs: DataFrame, width: int = 4, percent: int = 85, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when ``100 * common >= percent * union`` of their sets of lower-cased runs of ``width`` words;
    component_id is the smallest doc_id that links reach, itself included. A null or empty text, or one without words,
    has no shingles, is linked with nothing and is its own component. Rows without a doc_id have a NULL component and
    link nothing. Rows that repeat a doc_id count by their texts, equal ones alike. An empty table gives no rows; other
    columns, of any name, are left out. Very long texts are one set in one worker.
    """
    own = cut(signed_sets(docs, width, percent).withColumn("row", F.monotonically_increasing_id()))
    known = own.where("doc_id is not null and n > 0")
    classes = cut(known.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")))
    copies = cut(known.join(classes, ["h1", "h2"]).where("row <> node").select("row"))
    firsts = known.join(small_side(copies, broadcast_rows), "row", "left_anti").withColumnRenamed("row", "node")
    # The one shuffle of all signatures: those that only one class has end here.
    index = firsts.select("node", F.explode("sigs").alias("sig"))
    shared = Window.partitionBy("sig")
    multi = index.select("sig", "node", F.min("node").over(shared).alias("first"), F.max("node").over(shared).alias("last"))
    multi = cut(multi.where("first <> last").select("sig", "node", "first"))

    near = lambda pairs: _near(docs, firsts, pairs, width, percent, broadcast_rows)
    firsts = cut(firsts.drop("sigs"), copies)
    links = near(multi.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    roots = cut(connected_components(links))
    placed = multi.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    placed = cut(placed)
    split = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sig")
    rest = cut(placed.join(split, "sig", "left_semi"), placed)
    sized = rest.join(firsts.select("node", "n", *_BITS), "node")
    side = lambda s: sized.select("sig", F.col("node").alias(s), F.col("root").alias(f"root_{s}"), F.col("n").alias(f"n_{s}"), *(F.col(b).alias(f"{b}_{s}") for b in _BITS))
    meet = side("a").join(side("b"), "sig").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _fit(percent))
    more = near(cut(meet.select("a", "b").distinct()))
    every = cut(connected_components(links.union(more)), roots, rest, links, more, multi)

    placed = classes.join(every, "node", "left").select("h1", "h2", "least", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.join(smallest, "root").select("h1", "h2", "component_id")
    rows = own.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2")
    joined = rows.join(found, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")))
    out = cut(joined.select("doc_id", "n_shingles", component.alias("component_id")))
    discard(own, classes, firsts, every)
    return out
