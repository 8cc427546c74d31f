"""The fact build on a streaming source.

The same row-level enrichment (P1-P21) on a Structured Streaming source of raw
delivery rows. The data-dependent columns need whole-table statistics, which come
from the parsed rows of a batch (before imputation and the null-drop, as in the
batch build): the mean wait is a one-row static table and the per-driver and
per-restaurant means are static aggregates joined to the stream (stream-static
left joins, no streaming state). Every column equals the batch build's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlens.params import FactParams
from dispatchlens.plans.facts import group_means, parse_rows, with_costs, with_rates


def stream_facts(raw_stream: DataFrame, batch_raw: DataFrame, p: FactParams = FactParams()) -> DataFrame:
    batch = parse_rows(batch_raw, p)
    mean_wait = batch.agg(F.avg("Wait_Time_Minutes").alias("_mean_wait"))
    rated = lambda rows: with_rates(rows.crossJoin(F.broadcast(mean_wait)), F.col("_mean_wait"), p)  # noqa: E731  one row: fixed bound
    by_driver, by_restaurant = group_means(rated(batch))
    rows = rated(parse_rows(raw_stream, p)).join(by_driver, "Delivery_person_ID", "left").join(by_restaurant, "Restaurant_ID", "left")
    return with_costs(rows, p)
