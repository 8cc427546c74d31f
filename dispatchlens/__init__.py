"""dispatchlens: courier-order analytics as lazy Spark DataFrame operators.

Layout
------
sources/    readers and writers (CSV, Parquet, star-schema adapter)
functions/  column expressions and distributed helpers (exact quantiles)
plans/      the cleaned fact table and the run-everything plan
operators/  the analytical catalogue (profit, pricing, demand, geo, ...)
streaming/  the row-level enrichment applied to a streaming source
"""

from dispatchlens.params import CostParams, EnvParams, FactParams

__all__ = ["CostParams", "EnvParams", "FactParams"]
