"""Look-ups along an order inside a key, in linear time, also where one key holds most rows.

Rows of both sides are laid into one sequence a key. A key with more than ``hot`` rows is cut into ranges at the
quantiles of a sketch, which tasks scan by themselves; what a range needs from the others, one row of each, is carried
over in a table of at most ``RANGES`` rows a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.places import cut
from .quantiles import _place

HOT, RANGES = 1_000_000, 256


def ranged(rows: DataFrame, key: str, at: str, hot: int = HOT, ranges: int = RANGES) -> tuple[DataFrame, bool]:
    """``rows`` with ``__range``, which grows with ``at`` in a hot key and is 0 in any other; and whether there is a hot key.

    The count of each key is one small aggregation; only hot keys are sketched. A sketch depends on the order in which its
    parts arrive, so it is written once: all who read the rows must see the same ranges.
    """
    crowded = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__k")).where(F.col("__k") > hot).select(key)
    if crowded.isEmpty():
        return rows.withColumn("__range", F.lit(0)), False
    probs = [i / ranges for i in range(1, ranges)]
    number = F.unix_date(F.col(at).cast("date")).cast("double")
    edges = cut(rows.join(crowded, key, "left_semi").groupBy(key).agg(F.array_distinct(F.percentile_approx(number, probs, 10_000)).alias("__e")))
    placed = rows.join(edges, key, "left").withColumn("__range", F.when(F.col("__e").isNull(), 0).otherwise(_place(number, F.col("__e"), ranges)))
    return placed.select(*rows.columns, F.coalesce("__range", F.lit(0)).alias("__range")), True


def next_row(rows: DataFrame, key: str, at: str, kind: str, row: str, hot: int = HOT) -> DataFrame:
    """``rows`` of kind 0 with ``__next``: the ``row`` of the first one of kind 1 at or after them in their key."""
    placed, split = ranged(rows, key, at, hot)
    w = Window.partitionBy(key, "__range").orderBy(F.desc(at), F.desc(kind)).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("__next", F.last(row, ignorenulls=True).over(w)).where(F.col(kind) == 0)
    if not split:
        return found.drop("__range")
    firsts = placed.where((F.col(kind) == 1) & F.col(key).isNotNull()).groupBy(key, "__range").agg(F.min_by(row, at).alias("__first"))
    grid = placed.where(F.col(key).isNotNull()).select(key, "__range").distinct().join(firsts, [key, "__range"], "left")
    after = Window.partitionBy(key).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.select(key, "__range", F.last("__first", ignorenulls=True).over(after).alias("__later")).where("__later is not null")
    joined = found.join(carried, [key, "__range"], "left")
    return joined.select(*(c for c in found.columns if c not in ("__next", "__range")), F.coalesce("__next", "__later").alias("__next"))


def running_max(rows: DataFrame, key: str, at: str, kind: str, value: str, hot: int = HOT) -> DataFrame:
    """``rows`` of kind 0 with ``__max``: the largest ``value`` of those of kind 1 at or before them in their key."""
    placed, split = ranged(rows, key, at, hot)
    w = Window.partitionBy(key, "__range").orderBy(at, F.desc(kind)).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("__max", F.max(F.when(F.col(kind) == 1, F.col(value))).over(w)).where(F.col(kind) == 0)
    if not split:
        return found.drop("__range")
    tops = placed.where(F.col(key).isNotNull()).groupBy(key, "__range").agg(F.max(F.when(F.col(kind) == 1, F.col(value))).alias("__top"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(key, "__range", F.max("__top").over(before).alias("__earlier")).where("__earlier is not null")
    joined = found.join(carried, [key, "__range"], "left")
    return joined.select(*(c for c in found.columns if c not in ("__max", "__range")), F.greatest("__max", "__earlier").alias("__max"))


def exists_within(rows: DataFrame, events: DataFrame, key: str, at: str, on: str, days: int, label: str, hot: int = HOT) -> DataFrame:
    """``rows`` with ``label``: 1 if any event (key, on) of the same key lies in [at, at + days], else 0; by the next event at or after ``at``."""
    asked = rows.select(F.col(key).alias("__key"), F.col(at).cast("date").alias("__at")).where("__key is not null and __at is not null").distinct()
    told = events.select(F.col(key).alias("__key"), F.col(on).cast("date").alias("__at")).where("__key is not null and __at is not null").distinct()
    both = asked.select("*", F.lit(0).alias("__kind"), F.lit(None).cast("date").alias("__row")).union(told.select("*", F.lit(1), F.col("__at")))
    hit = next_row(both, "__key", "__at", "__kind", "__row", hot).where(F.col("__next") <= F.date_add("__at", days)).select("__key", "__at")
    return _flagged(rows, hit, key, at, label)


def overlaps(rows: DataFrame, spans: DataFrame, key: str, at: str, days: int, label: str, hot: int = HOT) -> DataFrame:
    """``rows`` with ``label``: 1 if any span (key, start_date, end_date) of the same key overlaps [at, at + days], else 0.

    Of the spans that start by the window's end the latest end must reach ``at``: a sweep with a running maximum.
    """
    end = F.date_add(F.col(at).cast("date"), days)
    asked = rows.select(F.col(key).alias("__key"), end.alias("__end"), F.col(at).cast("date").alias("__at")).where("__key is not null and __at is not null").distinct()
    told = spans.select(F.col(key).alias("__key"), F.col("start_date").cast("date").alias("__end"), F.col("end_date").cast("date").alias("__at")).where("__key is not null and __end is not null and __at is not null").groupBy("__key", "__end").agg(F.max("__at").alias("__at"))
    both = asked.withColumn("__kind", F.lit(0)).union(told.withColumn("__kind", F.lit(1)))
    hit = running_max(both, "__key", "__end", "__kind", "__at", hot).where(F.col("__max") >= F.col("__at")).select("__key", "__at")
    return _flagged(rows, hit, key, at, label)


def _flagged(rows: DataFrame, hit: DataFrame, key: str, at: str, label: str) -> DataFrame:
    found = hit.select("__key", F.col("__at").alias("__day"), F.lit(1).alias("__hit"))
    joined = rows.join(found, (F.col(key) == F.col("__key")) & (F.col(at).cast("date") == F.col("__day")), "left")
    return joined.select(*rows.columns, F.coalesce("__hit", F.lit(0)).alias(label))
