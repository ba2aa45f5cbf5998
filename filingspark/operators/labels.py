"""Outcome labels of company-years from filings, the registry, vendor and external files; 0 says "no event", NULL "no data"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import normalize_key
from ..sources.landed import tag_phrases
from .market import stock_decline
from .panel import dedup_keep, event_in_window, interval_overlap, validate_labels

# The outcomes, the amended forms, and the vendor's reason code for bankruptcy.
OUTCOMES = ("stock_decline", "earnings_restate", "audit_qualification", "sec_enforcement", "bankruptcy")
WIDE_FORMS, STRICT_FORMS, BANKRUPT = ("10-K/A", "10-KT/A", "NT 10-K/A"), ("10-K/A",), "03"
KEY = ["cik", "period_end"]


def _unknown(grid: DataFrame, label: str) -> DataFrame:
    return grid.withColumn(label, F.lit(None).cast("int"))


def _by_event(grid: DataFrame, events: DataFrame, at: Column, days: int, label: str) -> DataFrame:
    dated = events.select(normalize_key(F.col("cik")).alias("cik"), at.cast("date").alias("event_date")).where("event_date is not null")
    return event_in_window(grid, dated, "cik", "period_end", days, label)


def external_label(grid: DataFrame, external: DataFrame, label: str, order: Sequence[Column] = ()) -> DataFrame:
    """grid with ``label`` of an external table by (cik, period_end), of rows with one key the first in ``order``; NULL where there is none or it isn't a number."""
    one = external.withColumns({"cik": normalize_key(F.col("cik")), "period_end": F.col("period_end").cast("date"), "__v": F.col(label).cast("string")})
    one = dedup_keep(one, KEY, list(order) or [F.col("__v").isNull(), F.col("__v")]).select(*KEY, "__v")
    value = F.expr("cast(try_cast(__v as double) as int)").alias(label)
    return grid.join(one, KEY, "left").select(*grid.columns, value)


def amended_pairs(grid: DataFrame, registry: DataFrame, label: str = "amended") -> DataFrame:
    """1 where the registry has two filings or more for (cik, period_end), else 0."""
    twice = registry.where("cik is not null and period_end is not null").groupBy(*KEY).agg(F.count("*").alias("__k")).where("__k >= 2")
    return grid.join(twice, KEY, "left").select(*grid.columns, F.col("__k").isNotNull().cast("int").alias(label))


def filed_amendments(grid: DataFrame, filings: DataFrame, forms: Sequence[str], days: int, label: str) -> DataFrame:
    """1 where the company filed one of ``forms`` in [period_end, period_end + days], else 0."""
    return _by_event(grid, filings.where(F.trim("form_type").isin(list(forms))), F.col("date_filed"), days, label)


def restate_strict(grid: DataFrame, filings: DataFrame | None, days: int = 365, label: str = "earnings_restate") -> DataFrame:
    """All NULL without filings."""
    return _unknown(grid, label) if filings is None else filed_amendments(grid, filings, STRICT_FORMS, days, label)


def restate_reconciled(grid: DataFrame, filings: DataFrame | None, registry: DataFrame | None, days: int = 1095, forms: Sequence[str] = WIDE_FORMS, label: str = "earnings_restate") -> DataFrame:
    """1 where filings or the registry tell of an amendment, and in {label}_source which: both, edgar, xbrl or none. A missing source counts as 0; without both all is NULL."""
    if filings is None and registry is None:
        return _unknown(grid, label).withColumn(f"{label}_source", F.lit(None).cast("string"))
    zero = lambda df, c: df.withColumn(c, F.lit(0))
    rows = zero(grid, "__e") if filings is None else filed_amendments(grid, filings, forms, days, "__e")
    rows = zero(rows, "__x") if registry is None else amended_pairs(rows, registry, "__x")
    e, x = F.col("__e") == 1, F.col("__x") == 1
    source = F.when(e & x, "both").when(e, "edgar").when(x, "xbrl").otherwise("none")
    return rows.select(*grid.columns, F.greatest("__e", "__x").alias(label), source.alias(f"{label}_source"))


def audit_label(grid: DataFrame, external: DataFrame | None, label: str = "audit_qualification") -> DataFrame:
    return external_label(grid, external, label) if external is not None and label in external.columns else _unknown(grid, label)


def enforcement_label(grid: DataFrame, external: DataFrame | None, days: int = 365, label: str = "sec_enforcement") -> DataFrame:
    """By what the external table has: the label itself; nothing without a company number; spans that overlap the window; dates inside it (aaer_date); else 0."""
    if external is None:
        return _unknown(grid, label)
    have = set(external.columns)
    if label in have:
        return external_label(grid, external, label)
    if "cik" not in have:
        return _unknown(grid, label)
    if {"start_date", "end_date"} <= have:
        spans = external.select("cik", F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date"))
        return interval_overlap(grid, spans, "cik", "period_end", days, label)
    if "aaer_date" in have:
        return _by_event(grid, external, F.col("aaer_date"), days, label)
    return grid.withColumn(label, F.lit(0))


def bankruptcy_label(grid: DataFrame, companies: DataFrame | None, external: DataFrame | None, days: int = 365, source: str = "compustat", label: str = "bankruptcy") -> DataFrame:
    """By the vendor's delisting reason and date, if ``source`` says so and ``companies`` has them; else by the external table's label or filing dates; else NULL."""
    if source != "external_csv" and companies is not None and {"cstat_dlrsn", "cstat_dldte"} <= set(companies.columns):
        return _by_event(grid, companies.where(F.trim("cstat_dlrsn") == BANKRUPT), F.col("cstat_dldte"), days, label)
    if external is not None and label in external.columns:
        return external_label(grid, external, label)
    if external is not None and "filing_date" in external.columns:
        return _by_event(grid, external, F.col("filing_date"), days, label)
    return _unknown(grid, label)


# The phrases that tell of an event, the forms that they count in, and how precise they are.
BANKRUPTCY_RULES = ((1, ["Item 1.03"], ["8-K"], "high"), (2, ["bankruptcy or receivership"], ["8-K"], "high"))
ENFORCEMENT_RULES = (
    (1, ["AAER"], None, "high"),
    (2, ["Wells notice"], ["8-K"], "high"),
    (3, ["Wells notice"], ["10-K"], "high"),
    (4, ["formal order of investigation"], ["8-K"], "high"),
    (5, ["SEC settlement", "enforcement"], ["8-K"], "moderate"),
    (6, ["settled charges", "Securities and Exchange Commission"], ["8-K"], "moderate"),
    (7, ["Accounting and Auditing Enforcement Release"], None, "moderate"),
)


def sourced_events(filings: DataFrame, rules: Sequence[tuple], universe: DataFrame, on: str = "event_date") -> DataFrame:
    """(cik, ``on``), each once, of the companies in ``universe`` (cik): filings (adsh, cik, form, file_date, text) that any of the ``rules`` (rule, phrases, forms, tier) finds.

    A filing counts once, whichever rules find it; filings without a readable date or a company go.
    """
    table = filings.sparkSession.createDataFrame(list(rules), "rule int, phrases array<string>, forms array<string>, tier string")
    hits = tag_phrases(filings, table, "adsh", "text", "form").select("adsh").distinct()
    dated = filings.join(hits, "adsh", "left_semi").select(normalize_key(F.col("cik"), 10, True).alias("cik"), F.try_to_date(F.col("file_date").cast("string"), "yyyy-MM-dd").alias(on))
    return dated.where(F.col("cik").isNotNull() & F.col(on).isNotNull()).distinct().join(universe.select("cik").distinct(), "cik", "left_semi")


def build_labels(market: DataFrame, primary: int, filings=None, registry=None, companies=None, audit=None, enforcement=None, bankruptcies=None, threshold: float = -0.2, delisting_counts: bool = True, restatement_days: int = 1095, days: int = 365) -> DataFrame:
    """(cik, period_end, the five outcomes, earnings_restate_source) for each row of an aligned market table; a source that is None is missing."""
    decline = stock_decline(F.col(f"mkt_adj_{primary}"), F.coalesce(F.col("delisted").cast("boolean"), F.lit(False)), threshold, delisting_counts)
    rows = market.select(normalize_key(F.col("cik")).alias("cik"), "period_end", decline.alias("stock_decline"))
    rows = restate_reconciled(rows, filings, registry, restatement_days)
    rows = audit_label(rows, audit)
    rows = enforcement_label(rows, enforcement, days)
    rows = bankruptcy_label(rows, companies, bankruptcies, days)
    return rows.select(*KEY, *OUTCOMES, "earnings_restate_source")


def label_stats(labels: DataFrame, outcomes: Sequence[str] = OUTCOMES) -> DataFrame:
    """As ``validate_labels``; an outcome that the table lacks is missing in all rows."""
    whole = labels.select("*", *(F.lit(None).cast("int").alias(c) for c in outcomes if c not in labels.columns))
    return validate_labels(whole, outcomes)


def label_overview(labels: DataFrame, outcomes: Sequence[str] = OUTCOMES) -> DataFrame:
    """One row: observations, rows with all outcomes known, and outcomes known for more than half of the rows."""
    have = [c for c in outcomes if c in labels.columns]
    every = F.lit(len(have) == len(outcomes))
    for c in have:
        every = every & F.col(c).isNotNull()
    known = [(F.count(c) * 2 > F.count("*")).cast("int") for c in have]
    return labels.agg(F.count("*").alias("n_observations"), F.count_if(every).alias("n_all_present"), sum(known, F.lit(0)).alias("n_majority"))


def amendment_audit(registry: DataFrame, labels: DataFrame, filings: DataFrame, label: str = "earnings_restate", days: int = 365) -> DataFrame:
    """(cik, period_end, label, bucket) of each pair with two filings or more in the registry.

    Buckets, the first that holds: both (labelled 1), xbrl_only (the company filed no amended form), edgar_misses_by_window
    (a strict form after the window), label_only (strict forms, none after it), edgar_misses_by_form (other forms only).
    """
    pairs = registry.where("cik is not null and period_end is not null").groupBy(*KEY).agg(F.count("*").alias("__k")).where("__k >= 2").select(*KEY)
    forms = filings.where(F.trim("form_type").isin(list(WIDE_FORMS)))
    strict = F.trim("form_type").isin(list(STRICT_FORMS))
    last = forms.groupBy(F.col("cik")).agg(F.max(F.when(strict, F.col("date_filed"))).alias("__strict"))
    j = pairs.join(labels.select(*KEY, label), KEY, "left").join(last.withColumn("__any", F.lit(True)), "cik", "left")
    bucket = F.when(F.col(label) == 1, "both").when(F.col("__any").isNull(), "xbrl_only").when(F.col("__strict") > F.date_add("period_end", days), "edgar_misses_by_window").when(F.col("__strict").isNotNull(), "label_only").otherwise("edgar_misses_by_form")
    return j.select(*KEY, label, bucket.alias("bucket"))


def audit_summary(audited: DataFrame, label: str = "earnings_restate") -> DataFrame:
    """(bucket, n, n_positive, positive_rate)."""
    return audited.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_positive"), F.avg(F.coalesce((F.col(label) == 1).cast("int"), F.lit(0))).alias("positive_rate"))
