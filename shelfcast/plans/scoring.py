"""External-model scoring seam (M6): per-series history arrays → user scorer → quantiles.

A scorer is a plain function ``score(history: ndarray[n, T]) -> ndarray[n, H, L]`` over a batch
of equal-length histories (NaN = not listed yet). It runs inside ``mapInPandas`` on Arrow
batches; a heavy model should be loaded once per Python worker (module-level cache), not per
batch. Each series' array is bounded by the calendar length. Batch size follows
``spark.sql.execution.arrow.maxRecordsPerBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.panel import align_to_panel

Scorer = Callable[[np.ndarray], np.ndarray]


def history_arrays(panel: DataFrame, cut: int) -> DataFrame:
    """(sid, values array<double>) of weeks < cut in week order; missing weeks stay NULL."""
    hist = panel.filter(F.col("wk") < cut)
    g = hist.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("wk", "y"))).alias("_p"))
    return g.select("sid", F.transform("_p", lambda p: p["y"]).alias("values"))


def score_with(panel: DataFrame, cut: int, scorer: Scorer, names=("q50", "q_cr"), horizon: int | None = None) -> DataFrame:
    """Run ``scorer`` over every series; returns (sid, step, wk, <names>) with steps from 1. With ``horizon`` the result
    is aligned to the panel's weeks from ``cut`` on (R10): a series or week too few or too many raises."""
    out_schema = "sid string, step int, wk int, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            lengths = pdf["values"].map(len)
            for length, part in pdf.groupby(lengths):
                hist = np.array([np.asarray(v, dtype="float64") for v in part["values"]]).reshape(len(part), length)
                q = np.asarray(scorer(hist), dtype="float64")  # (n, H, L)
                n, h, _ = q.shape
                cols = {"sid": np.repeat(part["sid"].to_numpy(), h),
                        "step": np.tile(np.arange(1, h + 1, dtype="int32"), n)}
                cols["wk"] = (cut + cols["step"] - 1).astype("int32")
                for i, name in enumerate(names):
                    cols[name] = q[:, :, i].reshape(-1)
                yield pd.DataFrame(cols)

    scored = history_arrays(panel, cut).mapInPandas(run, out_schema)
    if horizon is None:
        return scored
    return align_to_panel(scored, panel, cut, horizon)


def seasonal_naive_scorer(m: int, h: int, levels) -> Scorer:
    """numpy seasonal naive; must equal the Spark plan ``forecasters.seasonal_naive``."""
    lv = [float(q) for q in levels]

    def score(hist: np.ndarray) -> np.ndarray:
        t = hist.shape[1]
        point = hist[:, t - m:t - m + h]                      # same weeks one season back
        diffs = hist[:, m:] - hist[:, :t - m]                 # seasonal differences
        out = np.empty((hist.shape[0], h, len(lv)))
        for i, q in enumerate(lv):
            with np.errstate(all="ignore"):
                rq = np.nanquantile(diffs, q, axis=1) if diffs.shape[1] else np.full(hist.shape[0], np.nan)
            out[:, :, i] = point + rq[:, None]
        return np.where(np.isnan(out), np.nan, np.maximum(out, 0.0))

    return score
