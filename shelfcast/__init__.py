"""shelfcast: demand forecasting and inventory analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; the core work
(aggregation, densification, windows, quantiles, joins, resampling) runs in Spark.
"""

from shelfcast.config import Costs, PanelSpec

__all__ = ["Costs", "PanelSpec"]
