"""Industry sectors by SIC code, and each sector's benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Sectors in their order, with their benchmark tickers.
SECTORS = (
    ("Consumer NonDurables", "XLP"),
    ("Consumer Durables", "XLY"),
    ("Manufacturing", "XLI"),
    ("Energy", "XLE"),
    ("Chemicals", "XLB"),
    ("Business Equipment", "XLK"),
    ("Telecom", "XLC"),
    ("Utilities", "XLU"),
    ("Shops", "XLY"),
    ("Health Care", "XLV"),
    ("Finance", "XLF"),
    ("Other", "^GSPC"),
)
# SIC ranges of each sector, both ends included; where ranges overlap, the last one listed holds.
RANGES = (
    ("Consumer NonDurables", ((100, 999), (2000, 2099), (2100, 2199), (2200, 2399), (2700, 2749), (2770, 2799), (3140, 3149), (3440, 3469), (3900, 3989), (3993, 3993))),
    ("Consumer Durables", ((2500, 2599), (3630, 3639), (3650, 3659), (3710, 3711), (3714, 3714), (3716, 3716), (3750, 3751), (3792, 3792), (3900, 3939), (3990, 3991))),
    ("Manufacturing", ((2400, 2499), (2600, 2699), (2750, 2769), (2800, 2829), (2840, 2899), (3000, 3099), (3200, 3299), (3300, 3399), (3400, 3439), (3470, 3489), (3490, 3499), (3500, 3569), (3580, 3599), (3670, 3679), (3700, 3709), (3712, 3713), (3715, 3715), (3720, 3749), (3760, 3791), (3793, 3799), (3830, 3839), (3860, 3899))),
    ("Energy", ((1200, 1299), (1300, 1399), (2900, 2999), (4600, 4699))),
    ("Chemicals", ((2800, 2824), (2860, 2879), (2890, 2891))),
    ("Business Equipment", ((3570, 3579), (3660, 3669), (3670, 3679), (3674, 3674), (3810, 3829), (7370, 7379))),
    ("Telecom", ((4800, 4813), (4890, 4899))),
    ("Utilities", ((4900, 4949), (4950, 4991))),
    ("Shops", ((5000, 5199), (5200, 5999), (7200, 7299), (7600, 7699))),
    ("Health Care", ((2830, 2836), (3840, 3851), (5047, 5047), (5122, 5122), (8000, 8099))),
    ("Finance", ((6000, 6999),)),
)
MARKET = "^GSPC"
#: Before this date the telecom benchmark has no prices, and the market stands in.
TELECOM_START = "2018-06-18"


def listed_ranges() -> list[tuple[int, int, int, str]]:
    """(place, low, high, sector) in the order of the list."""
    flat = [(low, high, sector) for sector, ranges in RANGES for low, high in ranges]
    return [(i, *r) for i, r in enumerate(flat)]


def sector_dimension(spark: SparkSession) -> DataFrame:
    """(sic int, sector): one row for each code that a range covers."""
    ranges = spark.createDataFrame(listed_ranges(), "place int, low int, high int, sector string")
    return ranges.select("place", "sector", F.explode(F.sequence("low", "high")).alias("sic")).groupBy("sic").agg(F.max_by("sector", "place").alias("sector"))


def sector_index(sector: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s, _ in SECTORS)), sector).cast("int") - 1


def with_sector(df: DataFrame, sic: str = "sic_code") -> DataFrame:
    """``df`` with sector: "Other" for codes that are missing, unparsable or not listed. The dimension has fewer than 10,000 rows."""
    dim = sector_dimension(df.sparkSession).withColumnRenamed("sector", "__sector")
    joined = df.join(F.broadcast(dim), F.expr(f"try_cast({sic} as int)") == F.col("sic"), "left")
    return joined.select(*df.columns, F.coalesce("__sector", F.lit("Other")).alias("sector"))


def benchmark(sector: Column, filing_date: Column) -> Column:
    """The sector's benchmark; the market's for unknown sectors, and for telecom before its benchmark's first day."""
    ticker = F.coalesce(*(F.when(sector == s, F.lit(t)) for s, t in SECTORS), F.lit(MARKET))
    return F.when((ticker == "XLC") & (filing_date < F.lit(TELECOM_START).cast("date")), F.lit(MARKET)).otherwise(ticker)
