"""Connected components over edges of long ids, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, forget
from .blocks import HOT_ROWS, counts_of, dealt_join


def _star(edges: DataFrame, size: int) -> DataFrame:
    """One large-star and one small-star step over ``size`` edges (a, b), a > b; no step keeps more rows than it was given edges, twice.

    A node's least neighbour is found by partial aggregation. Edges are told their node's parent by joins that deal the edges of a hot
    node, such as the centre of a star with a third of all edges, over as many parts as its count asks for.
    """
    parent = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    degree = counts_of(edges, "b") if size > HOT_ROWS else None
    large = checkpointed(dealt_join(edges, parent, "b", "a", degree, "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
    lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    several = lowest.where("n > 1")
    busy = checkpointed(several.select("a", "n")) if size > HOT_ROWS else None
    moved = dealt_join(large, several.select("a", "m"), "a", "b", busy).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = checkpointed(moved.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct())
    forget(*(x for x in (degree, large, busy) if x is not None))
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (a, b): component is the smallest id that edges reach.

    Nulls and loops are ignored, repeated edges and directions do not matter; no edges give no rows. Rounds go on until one changes
    nothing, however many that takes. Each is written to the checkpoint folder, so a lost executor costs at most a round, and removed when
    the next one stands.
    """
    now = checkpointed(
        edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("a is not null and b is not null and a <> b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    )
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before, after = None, mark(now)
    while after != before and after[0]:
        new = _star(now, after[0])
        forget(now)
        now, before, after = new, after, mark(new)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
