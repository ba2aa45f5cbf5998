"""Bootstrap intervals of areas under the curve.

Rows of one score and label are one counted cell: in a replicate k such rows weigh together as often as a Poisson
variable of mean k says, which is drawn once for the cell and the replicate, by inverse distribution, from a hash of
both. So the work grows with the distinct cells, not with the rows, and a replicate is the same on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import portable_uniform
from .metrics import ranking
from .quantiles import _place

#: Counts farther than this many deviations from the mean have no weight in double precision.
_REACH = 12


def poisson_range(k: float) -> tuple[int, int]:
    """The counts that a Poisson variable of mean ``k`` takes."""
    wide = _REACH * math.sqrt(k) + 20
    return max(0, math.floor(k - wide)), math.ceil(k + wide)


def poisson_cdf(k: float) -> list[float]:
    """The probabilities of at most each count of ``poisson_range``."""
    low, high = poisson_range(k)
    out, total = [], 0.0
    for j in range(low, high + 1):
        total += math.exp(j * math.log(k) - k - math.lgamma(j + 1))
        out.append(total)
    return out


def _tables(cells: DataFrame) -> DataFrame:
    """(k, low, cdf) of the different sizes of cells; there are far fewer of them than cells."""
    @F.pandas_udf("low long, cdf array<double>")
    def table(k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"low": [poisson_range(x)[0] for x in k], "cdf": [poisson_cdf(x) for x in k]})

    return cells.select("k").distinct().select("k", table("k").alias("t")).select("k", "t.low", "t.cdf")


def scaled(score: Column) -> Column:
    """A score as a whole number of 10 ** -9, the same text in any engine."""
    return F.round(score * 1e9).cast("long").cast("string")


def drawn(cells: DataFrame, identity: Sequence[Column], n: int, seed: int) -> DataFrame:
    """cells (…, k) with replicate and w, for each of ``n`` replicates the weight of the whole cell; those that weigh nothing are left out."""
    each = cells.withColumn("__id", F.concat_ws("|", *identity)).join(_tables(cells), "k").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = portable_uniform(F.col("__id"), F.col("replicate").cast("string"), F.lit(str(seed)))
    # A binary search whose steps suit counts of up to 2 ** 28.
    w = F.col("low") + _place(u, F.col("cdf"), (1 << 20) - 1)
    return each.withColumn("w", w).where("w > 0").drop("__id", "k", "low", "cdf")


def replicates(pred: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """(keys, replicate, auroc): NULL in a replicate of one class."""
    cells = pred.groupBy(*keys, "score", "y").agg(F.count("*").cast("double").alias("k"))
    identity = [*(F.col(k).cast("string") for k in keys), scaled(F.col("score")), F.col("y").cast("string")]
    return ranking(drawn(cells, identity, n, seed), [*keys, "replicate"], "w").select(*keys, "replicate", "auroc")


def _bounds(alpha: float) -> Column:
    return F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))


def bootstrap_auroc(pred: DataFrame, keys: Sequence[str], n: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(keys, estimate, low, high): the area and the interval of its replicates, as many numbers a group as replicates. Rows are (keys, score, y)."""
    own = ranking(pred, keys).select(*keys, F.col("auroc").alias("estimate"))
    found = replicates(pred, keys, n, seed).groupBy(*keys).agg(F.percentile("auroc", _bounds(alpha)).alias("q"))
    return own.join(found, list(keys)).select(*keys, "estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_delta(pred: DataFrame, key: str, row: Sequence[str], a: str, b: str, n: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(key, estimate, low, high, significant): the lead of model ``a`` over ``b`` on the rows that both have; significant if the interval leaves out 0. A model's rows are unique by ``key`` and ``row``.

    Cells are pairs of scores, so a replicate weighs a row alike for both models.
    """
    side = lambda m: pred.where(F.col("model") == m).select(key, *row, "y", F.col("score").alias(f"score_{m}"))
    both = side(a).join(side(b).drop("y"), [key, *row])
    cells = both.groupBy(key, f"score_{a}", f"score_{b}", "y").agg(F.count("*").cast("double").alias("k"))

    def lead(weighed: DataFrame, by: list[str]) -> DataFrame:
        long = weighed.select(*by, "y", "w", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"score_{m}").alias("score")) for m in (a, b)))).alias("s")).select(*by, "y", "w", "s.*")
        wide = ranking(long, [*by, "model"], "w").groupBy(*by).pivot("model", [a, b]).agg(F.first("auroc"))
        return wide.select(*by, (F.col(a) - F.col(b)).alias("delta"))

    identity = [F.col(key).cast("string"), scaled(F.col(f"score_{a}")), scaled(F.col(f"score_{b}")), F.col("y").cast("string")]
    own = lead(cells.withColumn("w", F.col("k")), [key]).withColumnRenamed("delta", "estimate")
    found = lead(drawn(cells, identity, n, seed), [key, "replicate"]).groupBy(key).agg(F.percentile("delta", _bounds(alpha)).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    return own.join(found, key).select(key, "estimate", low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).cast("int").alias("significant"))
