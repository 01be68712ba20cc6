"""Experiment constants and small value objects.

Fixed values that must equal the published benchmark protocol (kept together):
seed 51, forecast horizon 4 weeks, 2 validation folds, seasonality 52 weeks,
1,000 sampled series, 104 weeks of minimum history, 13 weeks of recent activity,
cost ratios stockout:holding of 4:1 (M5) and 2:1 (Favorita), the moving-average
window grid 2, 4, 6, 8, 13, 26, 52, the daily order plan horizon of 28 days,
and the default store location "33.8938,35.5018".
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from typing import NamedTuple

# --- fixed values (protocol) -------------------------------------------------
SEED = 51
HORIZON = 4
FOLDS = 2
SEASONALITY = 52
N_SERIES = 1000
MIN_HISTORY = 104
ACTIVE = 13
MA_WINDOWS = (2, 4, 6, 8, 13, 26, 52)
DAILY_HORIZON = 28
DEFAULT_GEOLOCATION = "33.8938,35.5018"
N_RESAMPLES = 10_000
MAKE_MODELS = ("seasonal_naive", "moving_average", "quantile_forest")
# -----------------------------------------------------------------------------


class Costs(NamedTuple):
    """What one unit left over and one unit short cost. Ratio and levels: ``functions.columns.order_levels``."""

    holding: float
    stockout: float


#: cost set -> (left over, short)
COST_SETS = {"m5": Costs(1.0, 4.0), "favorita": Costs(1.0, 2.0)}


@dataclass(frozen=True)
class PanelSpec:
    """Calendar of a weekly panel: week 0 starts at ``epoch``; ``weeks`` whole weeks kept.

    ``horizon``/``seasonality``/``folds`` follow the protocol; all cut weeks derive from them.
    """

    epoch: _dt.date
    weeks: int
    horizon: int = HORIZON
    seasonality: int = SEASONALITY
    folds: int = FOLDS
    costs: Costs = COST_SETS["m5"]

    @property
    def test_cut(self) -> int:
        """First forecast week of the held-out test window."""
        return self.weeks - self.horizon

    def fold_cut(self, fold: int) -> int:
        """First forecast week of validation fold ``fold`` (1-based)."""
        return self.weeks - (fold + 1) * self.horizon

    @property
    def established_week(self) -> int:
        return self.weeks - (self.horizon + MIN_HISTORY)

    @property
    def active_weeks(self) -> tuple[int, int]:
        """The last ``ACTIVE`` weeks (first and last of them) that every validation fold may learn from."""
        earliest = min(self.fold_cut(f) for f in range(1, self.folds + 1))
        return earliest - ACTIVE, earliest - 1


# Driver test data: dates run 1995-01-02 .. 2001-11-04, so epoch 1995-01-01 gives 2,500 days
# = 357 whole weeks and one dropped day.
TESTDATA_SPEC = PanelSpec(epoch=_dt.date(1995, 1, 1), weeks=357)
