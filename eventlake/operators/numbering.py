"""Dense numbers for ordered rows of a group, without sending a large group through one task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.session import shared_dir

#: Estimated bytes up to which a window numbers the rows of each group in one task.
SMALL = 1 << 30


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's output; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "place", small: int = SMALL) -> DataFrame:
    """df with the place of each row in its group, from 0, by ``order`` (ties in any order).

    Larger inputs are dealt out by ranges of (group, order), sorted and written to the shared folder with a running number of each
    range. A row's place is that number, and the rows of its group in earlier ranges: a table with a row for each group and range.
    """
    if estimated_bytes(df) <= small:
        by = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(by) - 1).cast("long"))
    laid = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id())
    path = f"{shared_dir(df.sparkSession)}/numbered/{uuid.uuid4().hex}"
    laid.write.parquet(path)
    return by_running_number(df.sparkSession.read.schema(laid.schema).parquet(path), group, F.shiftright("__at", 33), name)


def by_running_number(rows: DataFrame, group: Sequence[str], run, name: str = "place") -> DataFrame:
    """rows with their place in their group, from ``__at``, which counts up within each run; runs of a group follow each other by
    ``run``."""
    rows = rows.withColumn("__run", run)
    runs = rows.groupBy(*group, "__run").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    keys = [*group, "__run"]
    same = [rows[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    runs = runs.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__before", "__first")
    out = rows.join(runs, same).withColumn(name, (F.col("__before") + F.col("__at") - F.col("__first")).cast("long"))
    return out.select(*[c for c in rows.columns if c not in ("__at", "__run")], name)
