"""Queries on normalisation and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_panel as Q
from .functions import normal
from .operators import features as N
from .operators.panel import RATIO_NAMES
from .views import FEATURES, view

CUTS = ("1997-12-31", "1998-12-31", "2000-12-31")
_COLS = Q._PANEL_COLS


def _panel(spark, sf):
    p = view(spark, sf, "panel").select("cik", "fiscal_year", *_COLS)
    return p, p.where("fiscal_year <= 1998")


def scaler_quantile(spark, sf):
    p, train = _panel(spark, sf)
    scaled = N.PanelScaler(_COLS, method="quantile").fit(train).transform(p)
    return scaled.select("cik", "fiscal_year", *(F.round(c, 4).alias(c) for c in _COLS))


def _step(method):
    def run(spark, sf):
        p, train = _panel(spark, sf)
        scaled = N.PanelScaler(_COLS, method=method).fit(train).transform(p)
        return scaled.select("cik", "fiscal_year", *(F.round(c, 4).alias(c) for c in _COLS))

    return run


def scaler_fit_stats(spark, sf):
    t = N.PanelScaler(_COLS).fit(_panel(spark, sf)[1]).table(spark)
    return t.select("feature", *(F.round(c, 4).alias(c) for c in ("median", "low", "high", "mean", "std")))


def _long(df, features):
    return df.unpivot(["cik", "fiscal_year", "split"], [F.col(f).cast("double").alias(f) for f in features], "feature", "value")


def feature_matrix(spark, sf):
    """The whole matrix, a row a value."""
    df, _, features, categorical = N.build_feature_matrix(view(spark, sf, "panel"), FEATURES, CUTS, view(spark, sf, "company"), method="zscore")
    return _long(df, [*features, *categorical]).withColumn("value", F.round("value", 4) + 0.0)


def labelled_rows(spark, sf):
    labels = Q.restate_reconciled(spark, sf).select("cik", "period_end", F.when(F.col("source") != "edgar", F.col("label")).alias("y"))
    p = view(spark, sf, "panel").select("cik", "fiscal_year", "period_end", *_COLS).join(labels, ["cik", "period_end"])
    return N.labelled_rows(p, "y", _COLS)


def _poly(cs, r):
    out = repr(cs[-1])
    for c in reversed(cs[:-1]):
        out = f"({out} * {r} + {c!r})"
    return out


def _ratio(table, r):
    return f"({_poly(table[0], r)} / {_poly(table[1], r)})"


def _probit(p):
    q, t = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    outer = f"case when {t} <= 5 then {_ratio(normal._NEAR, f'({t} - 1.6)')} else {_ratio(normal._FAR, f'({t} - 5)')} end"
    return f"case when abs({q}) <= 0.425 then {q} * {_ratio(normal._CENTRE, f'(0.180625 - {q} * {q})')} else sign({q}) * ({outer}) end"


_KNOTS = "sv as (select " + ", ".join(f"list_sort(list(greatest(lo_{c}, least(hi_{c}, {c})))) as {c}" for c in _COLS) + ", count(*) as n, least(1000, count(*)) as m from im, bo), kn as (select m, " + ", ".join(f"list_transform(range(0, m), lambda i: {c}[cast(floor(i / cast(m - 1 as double) * (n - 1)) as bigint) + 1] + ({c}[cast(ceil(i / cast(m - 1 as double) * (n - 1)) as bigint) + 1] - {c}[cast(floor(i / cast(m - 1 as double) * (n - 1)) as bigint) + 1]) * (i / cast(m - 1 as double) * (n - 1) - floor(i / cast(m - 1 as double) * (n - 1)))) as {c}" for c in _COLS) + " from sv)"
_CLIPPED = "cl as (select p.cik, p.fiscal_year, " + ", ".join(f"greatest(lo_{c}, least(hi_{c}, coalesce(p.{c}, md.{c}))) as {c}" for c in _COLS) + " from {panel} p, md, bo)"
_FOUND = "fo as (select cl.*, m, " + ", ".join(f"greatest(len(list_filter(kn.{c}, lambda v: v <= cl.{c})), 1) - 1 as l_{c}, len(list_filter(kn.{c}, lambda v: v < cl.{c})) as s_{c}, kn.{c}[1] as k0_{c}, kn.{c}[m] as k9_{c}, kn.{c} as k_{c}" for c in _COLS) + " from cl, kn)"
_RANKED = "ra as (select *, " + ", ".join(f"(case when {c} = k_{c}[l_{c} + 1] then (l_{c} + s_{c}) / 2.0 else l_{c} + coalesce(({c} - k_{c}[l_{c} + 1]) / (k_{c}[least(l_{c} + 2, m)] - k_{c}[l_{c} + 1]), 0) end) / (m - 1.0) as r_{c}" for c in _COLS) + " from fo)"
_SCORED = ", ".join(f"round(case when {c} - 1e-7 < k0_{c} then -{N.FARTHEST} when {c} + 1e-7 > k9_{c} then {N.FARTHEST} else greatest(-{N.FARTHEST}, least({N.FARTHEST}, {_probit(f'r_{c}')})) end, 4) + 0.0 as {c}" for c in _COLS)
_YOYS = ", ".join(f"case when first = 1 then 0.0 when l_{c} <> 0 then ({c} - l_{c}) / abs(l_{c}) end as yoy_{c}" for c in FEATURES)
_NUMERIC = [*FEATURES, *RATIO_NAMES, *(f"yoy_{c}" for c in FEATURES)]
_MATRIX = (
    "ch as (select *, case when lag(fiscal_year) over w is null or fiscal_year - lag(fiscal_year) over w > 1 then 1 else 0 end as first, "
    + ", ".join(f"lag({c}) over w as l_{c}" for c in FEATURES)
    + " from {panel} window w as (partition by cik order by fiscal_year, filed_date)), fe as (select cik, fiscal_year, first, case when period_end <= date '1997-12-31' then 'train' when period_end <= date '1998-12-31' then 'val' else 'test' end as split, "
    + ", ".join(f"cast({c} as double) as {c}" for c in FEATURES)
    + ", "
    + ", ".join(f"cast({e} as double) as {n}" for n, e in Q._RATIO_EXPR.items())
    + f", {_YOYS} from ch where period_end <= date '2000-12-31'), lo as (unpivot (select * exclude (first) from fe) on {', '.join(_NUMERIC)} into name feature value value), "
    + "al as (select fe.cik, fe.fiscal_year, fe.split, f.feature from fe, (select unnest(["
    + ", ".join(f"'{n}'" for n in _NUMERIC)
    + "]) as feature) f), ln as (select al.*, lo.value from al left join lo on al.cik = lo.cik and al.fiscal_year = lo.fiscal_year and al.feature = lo.feature), "
    + "kp as (select feature, coalesce(median(value), 0) as md from ln where split = 'train' group by 1 having count(value) >= 0.5 * count(*)), im as (select cik, fiscal_year, split, ln.feature, value, coalesce(value, md) as v from ln join kp on ln.feature = kp.feature), "
    + "bo as (select feature, quantile_cont(v, 0.01) as a, quantile_cont(v, 0.99) as z from im where split = 'train' group by 1), mo as (select im.feature, avg(greatest(a, least(z, v))) as m, case when stddev_samp(greatest(a, least(z, v))) > 1e-12 then stddev_samp(greatest(a, least(z, v))) else 1 end as s from im join bo on im.feature = bo.feature where split = 'train' group by 1)"
)
_Q_COLS = ("cik", "fiscal_year", "split")
QUERIES = {
    "scaler_quantile": (scaler_quantile, f"with {Q._SCALE}, {_KNOTS}, {_CLIPPED}, {_FOUND}, {_RANKED} select cik, fiscal_year, {_SCORED} from ra"),
    "scaler_impute": (_step("impute"), f"with {Q._SCALE} select cik, fiscal_year, {', '.join(f'round(coalesce(p.{c}, md.{c}), 4) as {c}' for c in _COLS)} from {{panel}} p, md"),
    "scaler_winsorize": (_step("winsorize"), f"with {Q._SCALE}, {_CLIPPED} select cik, fiscal_year, {', '.join(f'round({c}, 4) as {c}' for c in _COLS)} from cl"),
    "scaler_fit_stats": (scaler_fit_stats, f"with {Q._SCALE} " + " union all ".join(f"select '{c}' as feature, round(md.{c}, 4) as median, round(lo_{c}, 4) as low, round(hi_{c}, 4) as high, round(m_{c}, 4) as mean, round(s_{c}, 4) as std from md, bo, mo" for c in _COLS)),
    "feature_matrix": (feature_matrix, f"with {_MATRIX} select cik, fiscal_year, split, im.feature, round((greatest(a, least(z, v)) - m) / s, 4) + 0.0 as value from im join bo on im.feature = bo.feature join mo on im.feature = mo.feature union all select cik, fiscal_year, split, feature || '_missing', cast(value is null as double) from im union all select cik, fiscal_year, split, 'is_first_year', cast(first as double) from fe union all select fe.cik, fiscal_year, split, 'sector_idx', cast(s.idx as double) from fe left join {{company_sector}} c on fe.cik = c.cik left join {{sector_list}} s on s.sector = coalesce(c.sector, 'Other')"),
    "labelled_rows": (labelled_rows, f"with {Q._REC} select p.cik, p.fiscal_year, p.period_end, label as y, {', '.join(f'coalesce({c}, 0.0) as {c}' for c in _COLS)} from {{panel}} p join rec on p.cik = rec.cik and p.period_end = rec.period_end where source <> 'edgar'"),
}
