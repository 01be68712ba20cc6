"""Forecasters (M1–M6) as DataFrame plans over a long, listed panel (sid, wk, y).

Contract (M4): ``forecaster(panel, cuts, spec, levels, **params)`` with ``cuts`` a list of
(fold, cut) origins returns
``(fold, cut, [param columns], sid, step, wk, q50, q_cr)`` for every rolling origin in the
``cuts`` table at once. History for a cut is ``wk < cut``; folds and parameters are columns,
so one plan scores every trial (T1).

Origins are few (folds + 1, a protocol constant) and enter as literal arrays. Seasonal residual quantiles of all
origins come from one sort per bounded group (``nested_percentiles``); the moving average works on one row of arrays
per series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import MA_WINDOWS, PanelSpec
from shelfcast.operators.features import computed, full_means, seasonal_residuals, series_rows
from shelfcast.operators.panel import at_origins
from shelfcast.operators.quantiles import array_percentile, nested_percentiles, quantile_forecast

LEVEL_NAMES = ("q50", "q_cr")
R_NAMES = [f"r_{n}" for n in LEVEL_NAMES]


def seasonal_naive(panel: DataFrame, cuts, spec: PanelSpec, levels) -> DataFrame:
    """M1: point = value one season before each target week (W4); residual quantiles of the
    seasonal differences in the history (W1, A1), shared by all steps (G7); clipped (A2).

    ``cuts`` is a list of (fold, cut) origins.
    """
    m, h = spec.seasonality, spec.horizon
    assert h < m, "seasonal naive needs horizon < seasonality (G9)"
    res = seasonal_residuals(panel, m)
    rq = nested_percentiles(res, ["sid"], "residual", "wk", cuts, levels, R_NAMES)
    pts = (panel.select("*", at_origins(cuts, lambda cut: (F.col("wk") >= cut - m) & (F.col("wk") < cut - m + h)))
                .select("fold", "cut", "sid", (F.col("wk") - (F.col("cut") - m) + 1).alias("step"),
                        F.col("y").alias("point")))
    fc = quantile_forecast(pts, rq, ["fold", "cut", "sid"], LEVEL_NAMES)
    return fc.select("fold", "cut", "sid", "step", (F.col("cut") + F.col("step") - 1).alias("wk"), *LEVEL_NAMES)


def moving_average(panel: DataFrame, cuts, spec: PanelSpec, levels,
                   windows=MA_WINDOWS) -> DataFrame:
    """M2: point = last full-window mean repeated over the horizon (W5); per-step residual
    quantiles of every earlier origin whose horizon lies in the history (W3, A1, G7, G8).

    A series is one row of arrays; all windows, steps and origins are worked out within it. The only shuffle
    is the one that brings a series' weeks together.
    """
    h = spec.horizon
    rows = series_rows(panel)
    kk = F.array(*[F.struct(F.lit(k).alias("window"), full_means("ys", k).alias("means")) for k in windows])
    rows = rows.select("sid", "wks", "ys", F.inline(kk)).select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    # (residual, first week after the origin's horizon) by residual; an origin counts for a cut from that week on
    n = F.greatest(F.size("ys") - F.col("step"), F.lit(0))
    resid = F.arrays_zip(F.zip_with(F.slice("means", F.lit(1), n), F.slice("ys", F.col("step") + 1, n), lambda m, y: y - m).alias("v"),
                         F.transform(F.slice("wks", F.lit(1), n), lambda w: w + F.lit(h)).alias("p"))
    rows = computed(rows, r=F.array_sort(F.filter(resid, lambda r: r["v"].isNotNull())))
    per = rows.select("sid", "window", "step", "wks", "means", "r", F.inline(F.array(*[
        F.struct(F.lit(f).alias("fold"), F.lit(c).alias("cut")) for f, c in cuts])))
    at = F.array_position("wks", F.col("cut") - 1).cast("int")
    per = computed(per.select("fold", "cut", "window", "sid", "step", "r", F.when(at > 0, F.element_at("means", F.greatest(at, F.lit(1)))).alias("point"))
                   .filter(F.col("point").isNotNull()), own=F.transform(F.filter("r", lambda r: r["p"] < F.col("cut")), lambda r: r["v"]))
    q = [F.greatest(F.col("point") + array_percentile(F.col("own"), lv), F.lit(0.0)) for lv in levels]
    return per.select(
        "fold", "cut", "window", "sid", "step", (F.col("cut") + F.col("step") - 1).alias("wk"),
        *[F.when(F.size("own") > 0, x).alias(name) for x, name in zip(q, LEVEL_NAMES)])


# M5: name → forecaster. Parameter columns each forecaster adds to its output.
FORECASTERS: dict[str, Callable[..., DataFrame]] = {
    "seasonal_naive": seasonal_naive,
    "moving_average": moving_average,
}
PARAM_COLUMNS: dict[str, list[str]] = {"seasonal_naive": [], "moving_average": ["window"]}
GRIDS: dict[str, list[dict]] = {
    "seasonal_naive": [{}],
    "moving_average": [{"window": w} for w in MA_WINDOWS],
}


def _forest(*args, **kwargs):
    from shelfcast.plans.forest import quantile_forest
    return quantile_forest(*args, **kwargs)


FORECASTERS["quantile_forest"] = _forest
PARAM_COLUMNS["quantile_forest"] = ["depth", "trees"]
GRIDS["quantile_forest"] = [{"depth": d, "trees": t} for d in (4, 8) for t in (10, 20)]


def get_forecaster(name: str) -> Callable[..., DataFrame]:
    """M5 registry lookup."""
    try:
        return FORECASTERS[name]
    except KeyError:
        raise KeyError(f"unknown forecaster {name!r}; known: {sorted(FORECASTERS)}") from None


def register_forecaster(name: str, fn: Callable[..., DataFrame], params: list[str], grid: list[dict]) -> None:
    FORECASTERS[name] = fn
    PARAM_COLUMNS[name] = params
    GRIDS[name] = grid
