"""Exact quantiles of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bracket with no more distinct values than this is read whole.
FEW = 20_000
ACCURACY = 2_000


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles, None for a column without values. The column is kept (in memory or on disk) between passes."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)").persist()
    try:
        return _quantiles(values, shares)
    finally:
        values.unpersist()


def _quantiles(values: DataFrame, shares: list[float]) -> list[float | None]:
    """Quantiles of the column v.

    Each pass counts what lies below a bracket around every rank still sought and sketches inside it, which narrows the bracket by a
    factor of some hundreds; a bracket of few distinct values is read with their counts. No task and not the driver holds the column.
    """
    whole = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not whole.n:
        return [None] * len(shares)
    ranks = sorted({k for s in shares for k in (math.floor(s * (whole.n - 1)), math.ceil(s * (whole.n - 1)))})
    found: dict[int, float] = {}
    spans = {k: (whole.low, whole.high, 0, whole.n) for k in ranks}  # low, high, values below low, values inside
    while spans:
        for k in [k for k, (low, high, _, _) in spans.items() if low == high]:
            found[k] = spans.pop(k)[0]
        ready = {k: s for k, s in spans.items() if s[3] <= FEW}
        if ready:
            inside = F.lit(False)
            for low, high, _, _ in set(ready.values()):
                inside = inside | F.col("v").between(low, high)
            rows = [(r.v, r.n) for r in values.where(inside).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()]
            for k, (low, high, below, _) in ready.items():
                for v, n in rows:
                    if low <= v <= high:
                        below += n
                        if below > k:
                            found[k] = v
                            break
                del spans[k]
        if not spans:
            break
        keys = list(spans)
        sketches = []
        for k in keys:
            low, high, below, n = spans[k]
            at, slack = (k - below) / n, 3 / ACCURACY
            sketches.append(F.percentile_approx(F.when(F.col("v").between(low, high), F.col("v")), [max(0.0, at - slack), min(1.0, at + slack)], ACCURACY))
        narrow = values.agg(*(s.alias(str(i)) for i, s in enumerate(sketches))).first()
        cuts = [tuple(narrow[i]) for i in range(len(keys))]
        counts = values.agg(*(x for i, (a, b) in enumerate(cuts) for x in (F.count_if(F.col("v") < a).alias(f"b{i}"), F.count_if(F.col("v").between(a, b)).alias(f"n{i}")))).first()
        for i, k in enumerate(keys):
            below, n = counts[f"b{i}"], counts[f"n{i}"]
            low, high, was_below, was = spans[k]
            if below <= k < below + n and n < was:
                spans[k] = (*cuts[i], below, n)
            elif k < below:
                spans[k] = (low, cuts[i][0], was_below, below - was_below + 1)
            elif k >= below + n:
                spans[k] = (cuts[i][1], high, below + n - 1, was_below + was - below - n + 1)
            else:  # the bracket holds few distinct values, all of them needed
                spans[k] = (low, high, was_below, FEW)
    out = []
    for s in shares:
        at = s * (whole.n - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out
