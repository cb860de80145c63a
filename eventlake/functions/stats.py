"""Statistical columns: mean, population deviation, z-score and anomaly over all rows, and the trailing mean.

The first four need three numbers per value, which are aggregated once and joined back as a single broadcast row; an
unpartitioned window would send every row to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_stats(df: DataFrame, value: Column, name: str = "x") -> DataFrame:
    """df with {name}, {name}_mean and {name}_sd (0 for fewer than two numbers) over all rows."""
    df = df.withColumn(name, value)
    sd = F.when(F.count(name) < 2, 0.0).otherwise(F.stddev_pop(name))
    stats = df.agg(F.coalesce(F.avg(name), F.lit(0.0)).alias(f"{name}_mean"), sd.alias(f"{name}_sd"))
    return df.crossJoin(F.broadcast(stats))


def zscore(name: str = "x") -> Column:
    """Distance from the mean in deviations; 0 where there is no deviation. A missing value counts as 0."""
    x, mean, sd = F.coalesce(F.col(name), F.lit(0.0)), F.col(f"{name}_mean"), F.col(f"{name}_sd")
    return F.when(sd == 0, 0.0).otherwise((x - mean) / sd)


def anomaly(name: str = "x", threshold: float = 2.0) -> Column:
    return F.abs(zscore(name)) > threshold


def moving_avg(value: Column, n: int = 10, order: Sequence[str] = ("partition", "offset"), partition: Sequence[str] = ()) -> Column:
    """Mean of the numbers among the last n rows. Without ``partition`` the rows pass through one task, in order."""
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(1 - n, 0)
    return F.avg(value).over(frame)
