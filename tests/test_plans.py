"""Plan-shape guards for scale: no cartesian products, pruned scans, map-side partial aggregation."""

import pytest

from tests.conftest import SF001

LIGHT = ["export_company_sales", "sales_keyed", "dim_upsert", "daily_panel", "weekly_panel",
         "weekly_panel_returns", "next_month_forecast", "order_plan", "eligible_series", "panel_profile",
         "cost_parameters", "store_locations", "company_upsert"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_no_cartesian_product(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan


def test_sales_are_pre_aggregated_and_pruned(spark):
    from shelfcast.config import TESTDATA_SPEC
    from shelfcast.operators.panel import weekly_sums
    from shelfcast.sources.testdata import TableSource, sales_view
    # the sums that weekly_panel writes once: the one plan that reads the raw sales
    plan = _plan(weekly_sums(sales_view(TableSource(spark, SF001)), TESTDATA_SPEC))
    assert "partial_sum" in plan                      # map-side combine before the series shuffle
    lineitem_scans = [ln for ln in plan.splitlines() if "lineitem" in ln and "ReadSchema" in ln]
    assert lineitem_scans and all("l_comment" not in ln and "l_orderkey" not in ln for ln in lineitem_scans)
