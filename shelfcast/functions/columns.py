"""Column expressions (all JVM-side, codegen-friendly). No Python UDFs here."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "week_index", "week_start", "series_id", "clip_zero", "critical_ratio", "order_levels", "quantile_levels",
    "half_even", "newsvendor_cost", "served", "pvalue_text", "cell_label", "percent_label",
    "parse_geolocation", "compose_geolocation", "with_default_location", "md5_uniform",
    "md5_int", "signed_quantity", "to_day",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_day(c) -> Column:
    """Timestamp / string → DATE."""
    return F.to_date(_col(c))


def week_index(date_col, epoch: _dt.date) -> Column:
    """Whole weeks since ``epoch`` with a true floor (F12): day -3 is week -1, not 0."""
    days = F.datediff(_col(date_col), F.lit(epoch))
    return F.floor(days / F.lit(7)).cast("int")


def week_start(wk_col, epoch: _dt.date) -> Column:
    """First day of week ``wk``."""
    return F.date_add(F.lit(epoch), (_col(wk_col) * F.lit(7)).cast("int"))


def series_id(store_col, item_col) -> Column:
    """Composite series id ``store_item``."""
    return F.concat_ws("_", _col(store_col).cast("string"), _col(item_col).cast("string"))


def clip_zero(c) -> Column:
    """max(x, 0) that keeps NULL as NULL."""
    x = _col(c)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(x, F.lit(0.0)))


def critical_ratio(holding, stockout) -> Column:
    """stockout / (stockout + holding)."""
    return _col(stockout) / (_col(stockout) + _col(holding))


def order_levels(costs) -> tuple[float, float]:
    """F18, F19 of a cost row (holding, stockout) as plain numbers: the median and the level that an order aims at."""
    return 0.5, costs.stockout / sum(costs)


def quantile_levels(cr) -> Column:
    """[0.5, critical ratio]."""
    return F.array(F.lit(0.5), _col(cr))


def half_even(c) -> Column:
    """Round to whole units, ties to even (F20): 0.5→0, 1.5→2, 2.5→2."""
    return F.bround(_col(c), 0).cast("long")


def newsvendor_cost(order, demand, holding: float | Column, stockout: float | Column) -> Column:
    """holding·max(order−demand, 0) + stockout·max(demand−order, 0) (A10)."""
    o, d = _col(order), _col(demand)
    h = holding if isinstance(holding, Column) else F.lit(float(holding))
    s = stockout if isinstance(stockout, Column) else F.lit(float(stockout))
    return h * F.greatest(o - d, F.lit(0.0)) + s * F.greatest(d - o, F.lit(0.0))


def served(order, demand) -> Column:
    """Units served: min(order, demand) (A12 numerator)."""
    return F.least(_col(order), _col(demand))


def pvalue_text(p) -> Column:
    """'<0.001' below 0.001, otherwise three decimals."""
    x = _col(p)
    return F.when(x < F.lit(0.001), F.lit("<0.001")).otherwise(F.format_number(x, 3))


def cell_label(model, regime) -> Column:
    """'model regime' (F24)."""
    return F.concat_ws(" ", _col(model), _col(regime))


def percent_label(q: float) -> int:
    """Quantile column label with truncation toward zero: 0.8→80, 2/3→66 (F22). Driver-side."""
    return int(q * 100)


def parse_geolocation(c) -> Column:
    """'lat,lon' text → struct<lat double, lon double>."""
    parts = F.split(_col(c), ",")
    return F.struct(F.trim(parts.getItem(0)).cast("double").alias("lat"),
                    F.trim(parts.getItem(1)).cast("double").alias("lon"))


def compose_geolocation(lat, lon) -> Column:
    """lat, lon → 'lat,lon' text."""
    return F.concat_ws(",", _col(lat).cast("string"), _col(lon).cast("string"))


def with_default_location(c, default: str) -> Column:
    """Stored location or the model default when unset (F8)."""
    return F.coalesce(_col(c), F.lit(default))


def md5_int(*parts) -> Column:
    """Deterministic 32-bit draw from md5 of ':'-joined parts, as a long in [0, 2^32)."""
    text = F.concat_ws(":", *[_col(p).cast("string") if not isinstance(p, (int, float)) else F.lit(str(p))
                              for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def md5_uniform(*parts) -> Column:
    """md5 draw scaled to [0, 1)."""
    return md5_int(*parts) / F.lit(float(2 ** 32))


def signed_quantity(qty, returnflag) -> Column:
    """Signed sales view: returned lines count negative."""
    return F.when(_col(returnflag) == F.lit("R"), -_col(qty)).otherwise(_col(qty))
