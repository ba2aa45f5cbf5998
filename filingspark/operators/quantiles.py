"""Exact quantiles of large tables: a sketch brackets each one, and only the values in the brackets are counted and ordered."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.places import cut, discard

ACCURACY = 10_000


def quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, n, q): for each group the number of values that aren't NULL, and their quantiles by linear interpolation, in the order of ``probs``.

    A first scan sketches the values at most two ranks of ``1 / accuracy`` beside each quantile. A second one counts:
    a value outside all brackets only adds to its stretch's count and ends, one inside is counted by itself. So a group
    orders about ``4 / accuracy`` of its different values for each quantile.
    """
    keys = list(keys)
    some = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__x"))
    step = 2.0 / accuracy
    around = [max(0.0, p - step) for p in probs] + [min(1.0, p + step) for p in probs]
    edges = some.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__x", around, accuracy).alias("__e"))
    k = len(probs)
    x, edge = F.col("__x"), lambda i: F.col("__e")[i]
    stretch, inside = F.lit(0), F.lit(False)
    for i in range(k):
        stretch = stretch + (x >= edge(i)).cast("int") + (x > edge(k + i)).cast("int")
        inside = inside | x.between(edge(i), edge(k + i))
    if keys:
        same = F.lit(True)
        for c in keys:
            same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}"))
        both = some.alias("s").join(edges.alias("e"), same).select(*(F.col(f"s.{c}").alias(c) for c in keys), "__x", "n", "__e")
    else:
        one = edges.first()
        both = some.withColumns({"n": F.lit(one.n).cast("long"), "__e": F.array(*(F.lit(e) for e in one["__e"] or [0.0] * (2 * k)))})
    cells = both.groupBy(*keys, "n", stretch.alias("__stretch"), F.when(inside, x).alias("__in")).agg(F.count("*").alias("__k"), F.min("__x").alias("__first"), F.max("__x").alias("__last"))
    return _ranked(cells, keys, probs)


def _ranked(cells: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, n, q) of counted cells (keys, n, __stretch, __in, __k, __first, __last): the values inside brackets, NULL for those of a stretch between."""
    upto = Window.partitionBy(*keys).orderBy("__stretch", "__in").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("__upto", F.sum("__k").over(upto))
    # A rank just beside a bracket is the first or last of a stretch.
    value = lambda rank: F.when(F.col("__upto") - F.col("__k") == rank, F.col("__first")).otherwise(F.col("__last"))
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.struct("__upto", value(rank).alias("v"))))["v"]
    rank = lambda p: F.lit(p) * (F.col("n") - 1)
    found = cells.groupBy(*keys, "n").agg(*(at(f(rank(p))).alias(f"__{side}{i}") for i, p in enumerate(probs) for side, f in (("lo", F.floor), ("hi", F.ceil))))
    part = lambda p: rank(p) - F.floor(rank(p))
    return found.select(*keys, "n", F.array(*(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * part(p) for i, p in enumerate(probs))).alias("q"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY, many: int = 500_000) -> dict[str, list[float]]:
    """For each of many double columns what ``quantiles`` gives; a column without values is left out.

    A value is read in its row and not as a row of its own. With more than ``many`` rows the sketch sees every 25th value of
    sorted stretches of 50,000 rows. Brackets from there are counted like any; where a rank isn't in one, the column goes
    through ``quantiles``, so results are exact whatever the sketch says.
    """
    columns = list(columns)
    rows = df.count()
    if not columns or not rows:
        return {}
    stride = 25 if rows > many else 1
    values = df.select(*(F.col(c).alias(f"x{i}") for i, c in enumerate(columns)))
    step = 2.0 / accuracy + (stride - 1) * (1 / _STRETCH + values.rdd.getNumPartitions() / rows)
    around = [max(0.0, p - step) for p in probs] + [min(1.0, p + step) for p in probs]
    sketched = _thinned(values, stride).groupBy("at").agg(F.percentile_approx("x", around, accuracy).alias("e")).collect()
    ends = {r.at: _apart(list(zip(r.e[: len(probs)], r.e[len(probs) :]))) for r in sketched}
    brackets = [ends.get(i) for i in range(len(columns))]

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        width = 2 * len(probs) + 1
        size, first, last = np.zeros((len(brackets), width), "i8"), np.full((len(brackets), width), np.nan), np.full((len(brackets), width), -np.inf)
        inside: dict[tuple, list] = {}
        for batch in batches:
            for i, ends in enumerate(brackets):
                if ends is None:
                    continue
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                above = np.searchsorted(ends[0], x, "right")
                place = above + np.searchsorted(ends[1], x, "left")  # even between brackets, odd inside
                found = np.bincount(place, minlength=width)
                size[i] += found
                for s in np.flatnonzero(found):
                    v = x[place == s]
                    if s % 2:
                        inside.setdefault((i, int(s)), []).append(v)
                    else:
                        first[i, s], last[i, s] = np.fmin(first[i, s], np.fmin.reduce(v)), max(last[i, s], v.max()) if not np.isnan(v).any() else np.nan
        rows = [(i, s, None, int(size[i, s]), float(first[i, s]), float(last[i, s])) for i in range(len(brackets)) for s in range(0, width, 2) if size[i, s]]
        for (i, s), parts in inside.items():
            rows += [(i, s, v, k, v, v) for v, k in zip(*(a.tolist() for a in np.unique(np.concatenate(parts), return_counts=True)))]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["at", "__stretch", "__in", "__k", "__first", "__last"])

    each = values.mapInArrow(count, "at int, __stretch int, __in double, __k long, __first double, __last double")
    cells = cut(each.groupBy("at", "__stretch", "__in").agg(F.sum("__k").alias("__k"), F.min("__first").alias("__first"), F.max("__last").alias("__last")))
    sizes: dict[int, dict[int, int]] = {}
    for at, s, k in cells.groupBy("at", "__stretch").agg(F.sum("__k")).collect():
        sizes.setdefault(at, {})[s] = k
    n = {at: sum(ks.values()) for at, ks in sizes.items()}
    sure = [at for at, ks in sizes.items() if all(_told(ks, r) for p in probs for r in (math.floor(p * (n[at] - 1)), math.ceil(p * (n[at] - 1))))]
    counts = F.get(F.array(*(F.lit(n.get(i)).cast("long") for i in range(len(columns)))), F.col("at"))
    found = {columns[r.at]: list(r.q) for r in _ranked(cells.where(F.col("at").isin(sure)).withColumn("n", counts), ["at"], probs).collect()}
    discard(cells)
    for i, c in enumerate(columns):
        if c not in found:
            one = quantiles(df, [], c, probs, accuracy).first()
            found |= {c: list(one.q)} if one is not None else {}
    return found


_STRETCH = 50_000


def _thinned(values: DataFrame, stride: int) -> DataFrame:
    """(at, x): the values of each column, or of sorted stretches of them the middle one of each ``stride``."""
    width = len(values.columns)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def taken(held):
            each = [np.concatenate(h) for h in held]
            each = [np.sort(v)[stride // 2 :: stride] if stride > 1 else v for v in each]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width, dtype="i4"), [len(v) for v in each])), pa.array(np.concatenate(each))], ["at", "x"])

        held, rows = [[] for _ in range(width)], 0
        for batch in batches:
            for i in range(width):
                held[i].append(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
            rows += len(batch)
            if rows >= _STRETCH or stride == 1:
                yield taken(held)
                held, rows = [[] for _ in range(width)], 0
        if rows:
            yield taken(held)

    return values.mapInArrow(run, "at int, x double")


def _told(sizes: dict[int, int], rank: int) -> bool:
    """Whether counted cells give the value of a rank: it lies in a bracket, the odd stretches, or is the first or last of a stretch between."""
    begin = 0
    for s in sorted(sizes):
        end = begin + sizes[s]
        if begin <= rank < end:
            return s % 2 == 1 or rank in (begin, end - 1)
        begin = end
    return False


def _apart(brackets: list[tuple[float, float]]) -> tuple[list[float], list[float]]:
    """The lower and the upper ends of brackets, those that meet made one."""
    low, high = [], []
    for a, z in sorted(brackets):
        if high and not a > high[-1]:
            high[-1] = max(high[-1], z)
        else:
            low.append(a)
            high.append(z)
    return low, high


def _place(x, edges, size: int):
    """How many of the sorted ``edges``, at most ``size``, are not above ``x``: a binary search, so an expression of a few steps."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(size.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(edges)) & (F.get(edges, at + s - 1) <= x), at + s).otherwise(at))


def knots(df: DataFrame, keys: Sequence[str], column: str, most: int = 1000, parts: int = 255) -> DataFrame:
    """(keys, n, knots): for each group its evenly spaced exact quantiles from the lowest value to the highest, min(most, n) of them but two at least.

    Values are cut into stretches at a sketch's quantiles; each is ordered by itself and begins at the count of those before it.
    A sketch depends on the order in which its parts arrive, so it is written once: stretches and their counts must have the same ends.
    """
    keys = list(keys)
    some = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__x"))
    edges = cut(some.groupBy(*keys).agg(F.count("*").alias("n"), F.array_distinct(F.percentile_approx("__x", [(i + 1) / (parts + 1) for i in range(parts)], ACCURACY)).alias("__e")))
    cells = some.join(edges, keys).select(*keys, "n", "__x", _place(F.col("__x"), F.col("__e"), parts).alias("__part")).groupBy(*keys, "n", "__part", "__x").agg(F.count("*").alias("__k"))
    begin = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy(*keys, "__part").agg(F.sum("__k").alias("__s")).select(*keys, "__part", F.coalesce(F.sum("__s").over(begin), F.lit(0)).alias("__before"))
    upto = Window.partitionBy(*keys, "__part").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("__upto", F.sum("__k").over(upto)).join(offsets, [*keys, "__part"])
    m = F.greatest(F.lit(2), F.least(F.lit(most), F.col("n")))
    low, high = F.col("__before") + F.col("__upto") - F.col("__k"), F.col("__before") + F.col("__upto")
    near = lambda rank: F.coalesce(F.try_divide(rank * (m - 1), F.col("n") - 1), F.lit(0.0))
    first, last = F.greatest(F.lit(0), F.floor(near(low)) - 1), F.when(F.col("n") > 1, F.least(m - 1, F.ceil(near(high)) + 1)).otherwise(m - 1)
    each = cells.select(*keys, "n", "__x", low.alias("__low"), high.alias("__high"), m.alias("__m"), F.explode(F.sequence(first, last)).alias("__i"))
    rank = F.col("__i") / (F.col("__m") - 1) * (F.col("n") - 1)
    holds = lambda r: F.max(F.when((r >= F.col("__low")) & (r < F.col("__high")), F.col("__x")))
    found = each.groupBy(*keys, "n", "__m", "__i").agg(holds(F.floor(rank)).alias("a"), holds(F.ceil(rank)).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank))
    found = found.where("a is not null").groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("__i", value.alias("v")))).alias("__s"))
    return found.select(*keys, "n", F.col("__s.v").alias("knots"))
