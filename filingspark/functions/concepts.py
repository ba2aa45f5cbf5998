"""Which reported concepts stand for each annual feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The features with their concepts, the preferred one first.
SIMPLE = {
    "total_assets": ("Assets",),
    "total_liabilities": ("Liabilities",),
    "total_equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "current_assets": ("AssetsCurrent",),
    "current_liabilities": ("LiabilitiesCurrent",),
    "retained_earnings": ("RetainedEarningsAccumulatedDeficit",),
    "cash_equivalents": ("CashAndCashEquivalentsAtCarryingValue", "Cash", "CashCashEquivalentsAndShortTermInvestments"),
    "total_revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet"),
    "cost_of_sales": ("CostOfGoodsSold", "CostOfRevenue", "CostOfGoodsAndServicesSold"),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"),
    "interest_expense": ("InterestExpense", "InterestExpenseDebt"),
    "cash_from_operations": ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "cash_from_investing": ("NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInInvestingActivitiesContinuingOperations"),
    "cash_from_financing": ("NetCashProvidedByUsedInFinancingActivities", "NetCashProvidedByUsedInFinancingActivitiesContinuingOperations"),
}
# The parts of total_debt, each with its own order of concepts.
DEBT = {"long_term_debt": ("LongTermDebt", "LongTermDebtNoncurrent"), "short_term_debt": ("ShortTermBorrowings", "DebtCurrent")}
# The concepts that tell which years a company reports, of which the first four date them.
PROBES = ("Assets", "Revenues", "NetIncomeLoss", "Liabilities", "StockholdersEquity", "AssetsCurrent")
DATING = PROBES[:4]


def concept_rows() -> list[tuple[str, str, int]]:
    """(tag, feature, priority) of all features and parts of debt."""
    return [(tag, feature, i) for feature, tags in (SIMPLE | DEBT).items() for i, tag in enumerate(tags)]


def concept_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(concept_rows(), "tag string, feature string, priority int")


ALL_TAGS = tuple(tag for tag, _, _ in concept_rows())
FEATURES = (*list(SIMPLE)[:7], "total_debt", *list(SIMPLE)[7:])
