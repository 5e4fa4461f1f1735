"""Running totals in the order of a column, without one task that sorts everything."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upto(rows: DataFrame, order: str, n: str, name: str, accuracy: float = 0.005) -> DataFrame:
    """``rows`` with ``name``, the sum of ``n`` over all rows whose ``order`` (a double, no nulls, no value twice) is not larger.

    Ranges of about equal size are cut at approximate quantiles, which are fixed before any row is dealt: a task run again deals alike.
    One job finds them; their number is that of the shuffle partitions. NaN is the largest value, as Spark sorts it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.where(~F.isnan(order)).approxQuantile(order, [i / parts for i in range(1, parts)], accuracy) if parts > 1 else []
    inner = sorted({c for c in cuts if abs(c) != float("inf")}) or [0.0]
    ranged = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol=order, outputCol="_range", handleInvalid="keep").transform(rows)
    sizes = ranged.groupBy("_range").agg(F.sum(n).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # one row a range
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(name, F.sum(n).over(within)).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
