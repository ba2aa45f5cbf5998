"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def col_or_null(df: DataFrame, name: str) -> Column:
    """The column, or NULL where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def normalize_key(key: Column, width: int = 10, guard: bool = False) -> Column:
    """Trimmed and padded with zeros on the left, never cut; with ``guard``, blank and "nan" are NULL."""
    text = F.trim(key.cast("string"))
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.when(F.lower(text).isin("", "nan"), F.lit(None)).otherwise(padded) if guard else padded


def number_of(x: Column) -> Column:
    """A double; NaN is missing as well and becomes NULL."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def safe_div(num: Column, den: Column, least: float = 1e-8) -> Column:
    """NULL where the denominator is missing or nearly zero."""
    return F.when(F.abs(den) >= least, num / den)


def clip(x: Column, low: Column, high: Column) -> Column:
    """NULL stays NULL, which greatest and least would pass over."""
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def portable_uniform(*keys: Column) -> Column:
    """A number in [0, 1) from an MD5 hash, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("double") / float(1 << 32)
