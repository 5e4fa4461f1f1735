"""OPTICS (Ankerst et al., 1999) with xi clusters and predecessor correction (Schubert and Gertz, 2018), one scene to a task.

The order in which points are reached is sequential by definition, so a scene is one unit of work; scenes run in parallel. Distances are
computed from one point at a time to those in the cells of a grid around it, which are all that can be within ``max_eps``, and memory is
linear in a scene's tracks (one row each, not its points).
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT_SCHEMA = "scene string, track_id bigint, index bigint, ord bigint, core_distance double, reachability double, predecessor bigint, cluster bigint"


class Near:
    """The points that can be within ``eps`` of one: a grid over the four widest columns, whose cells are at least ``eps`` wide."""

    def __init__(self, x: np.ndarray, eps: float) -> None:
        self.columns = np.ascontiguousarray(x.T)
        self.all, self.cell, self.around = np.arange(len(x)), np.zeros(len(x), np.int64), {}
        self.steps, self.members = [0], {0: self.all}
        span = np.ptp(x, 0)
        if not np.isfinite(eps) or not np.isfinite(span).all():
            return
        size, used = 1, []
        for c in np.argsort(-span, kind="stable")[:4].tolist():
            width = max(eps * (1 + 1e-9), span[c] / 1000)
            if span[c] < 2 * width or not width:
                break
            place = np.floor((x[:, c] - x[:, c].min()) / width).astype(np.int64) + 1
            self.cell += place * size
            used.append(size)
            size *= int(place.max()) + 2
        self.steps = [sum(p) for p in product(*((-u, 0, u) for u in used))]
        order = np.argsort(self.cell, kind="stable")
        cells, first = np.unique(self.cell[order], return_index=True)
        self.members = dict(zip(cells.tolist(), np.split(order, first[1:]), strict=True))

    def candidates(self, i: int) -> np.ndarray:
        cell = int(self.cell[i])
        if cell not in self.around:
            parts = [self.members[cell + s] for s in self.steps if cell + s in self.members]
            self.around[cell] = np.sort(np.concatenate(parts)).astype(np.int32) if len(parts) > 1 else parts[0]
        return self.around[cell]


def distances(columns: np.ndarray, of: np.ndarray) -> np.ndarray:
    s = np.zeros(columns.shape[1])
    for c, v in zip(columns, of, strict=True):
        gap = c - v
        gap *= gap
        s += gap
    return np.sqrt(s, out=s)


def reach_order(x: np.ndarray, min_samples: int, max_eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, core distances, reachabilities, predecessors)."""
    n = len(x)
    near = Near(x, max_eps)
    core, cell = np.full(n, np.inf), None
    for i in np.argsort(near.cell, kind="stable").tolist():
        if near.cell[i] != cell:  # the points of a cell have the same candidates
            cell, here = near.cell[i], near.columns[:, near.candidates(i)]
        if here.shape[1] >= min_samples:
            core[i] = np.partition(distances(here, near.columns[:, i]), min_samples - 1)[min_samples - 1]
    core[core > max_eps] = np.inf
    reach, before, waiting, order = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool), np.empty(n, np.int64)
    turn = np.full(n, np.finfo(float).max)  # the reachability of those that wait; infinite for those that are done
    for step in range(n):
        i = int(np.argmin(turn))
        waiting[i], order[step], turn[i] = False, i, np.inf
        if np.isfinite(core[i]):
            to = near.candidates(i)
            to = to[waiting[to]]
            d = distances(near.columns[:, to], near.columns[:, i])
            through = np.maximum(d, core[i])
            better = (d <= max_eps) & (through < reach[to])
            to = to[better]
            reach[to] = turn[to] = through[better]
            before[to] = i
    return order, core, reach, before


# The extraction of clusters from here on is the published one (Ankerst et al., 1999; predecessor correction by Schubert and Gertz, 2018) in
# the form that scikit-learn gives it (cluster_optics_xi; BSD 3-Clause licence, copyright the scikit-learn developers), whose results it has
# to match step by step.


def steep_end(steep: np.ndarray, against: np.ndarray, start: int, min_samples: int) -> int:
    """The last steep place of the area that starts at ``start``: it ends before a step the other way, or after too many flat ones."""
    end, flat, i = start, 0, start + 1
    while i < len(steep) and not against[i] and flat < min_samples:
        if steep[i]:
            end, flat = i, 0
        else:
            flat += 1
        i += 1
    return end


def xi_clusters(reach: np.ndarray, before: np.ndarray, order: np.ndarray, xi: float, min_samples: int) -> list[tuple[int, int]]:
    """(first, last) places of clusters in the order, inner ones before the ones around them."""
    plot, keep = np.append(reach[order], np.inf), 1 - xi
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = plot[:-1] / plot[1:]
    up, down = ratio <= keep, ratio >= 1 / keep
    rising, falling = ratio < 1, ratio > 1
    descents: list[dict] = []
    found: list[tuple[int, int]] = []
    at, between = 0, 0.0
    for start in np.flatnonzero(up | down).tolist():
        if start < at:
            continue
        between = max(between, float(plot[at : start + 1].max()))
        descents = [d for d in descents if between <= plot[d["first"]] * keep]
        for d in descents:
            d["between"] = max(d["between"], between)
        if down[start]:
            end = steep_end(down, rising, start, min_samples)
            descents.append({"first": start, "last": end, "between": 0.0})
        else:
            end = steep_end(up, falling, start, min_samples)
            here = []
            for d in descents:
                if plot[end + 1] * keep < d["between"]:
                    continue
                span = trimmed(plot, keep, d, start, end)
                span = by_predecessor(before, order, place, plot, *span)
                if span and span[1] - span[0] + 1 >= min_samples and span[0] <= d["last"] and span[1] >= start:
                    here.append(span)
            found += here[::-1]
        at = end + 1
        between = float(plot[at])
    return found


def trimmed(plot: np.ndarray, keep: float, descent: dict, start: int, end: int) -> tuple[int, int]:
    """The cluster between a descent and an ascent, cut so that both ends are about as high."""
    first, last = descent["first"], end
    high, after = plot[first], plot[end + 1]
    if high * keep >= after:
        while first < descent["last"] and plot[first + 1] > after:
            first += 1
    elif after * keep >= high:
        while last > start and plot[last - 1] > high:
            last -= 1
    return first, last


def by_predecessor(before: np.ndarray, order: np.ndarray, place: np.ndarray, plot: np.ndarray, first: int, last: int) -> tuple[int, int] | None:
    """Points at the end whose predecessor lies outside the cluster don't belong to it."""
    while first < last:
        if plot[first] > plot[last]:
            return first, last
        p = before[order[last]]
        if p >= 0 and first <= place[p] < last:
            return first, last
        last -= 1
    return None


def optics(x: np.ndarray, min_samples: int, xi: float, max_eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, order, core distances, reachabilities, predecessors); fewer points than ``min_samples`` are all noise."""
    n = len(x)
    if n < min_samples or n == 0:
        return np.full(n, -1), np.arange(n), np.full(n, np.inf), np.full(n, np.inf), np.full(n, -1)
    reached = reach_order(x, min_samples, max_eps)
    return extracted(reached, min_samples, xi), *reached


def extracted(reached: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], min_samples: int, xi: float) -> np.ndarray:
    """The cluster of each point, -1 for noise."""
    order, _, reach, before = reached
    labels, next_ = np.full(len(order), -1), 0
    for first, last in xi_clusters(reach, before, order, xi, min_samples):
        if (labels[first : last + 1] == -1).all():
            labels[first : last + 1] = next_
            next_ += 1
    out = np.full(len(order), -1)
    out[order] = labels
    return out


def optics_clusters(ends: DataFrame, columns: list[str], min_samples: int = 30, xi: float = 0.05, max_eps: float = float("inf"), scene: str | None = None) -> DataFrame:
    """Per track: its cluster (-1: noise), place in the order, core distance, reachability and predecessor, by scene."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("track_id", kind="stable").reset_index(drop=True)
        labels, order, core, reach, before = optics(rows[columns].to_numpy(float), min_samples, xi, max_eps)
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        ids = rows["track_id"].to_numpy()
        return pd.DataFrame({
            "scene": rows["scene"], "track_id": ids, "index": np.arange(len(rows)), "ord": place, "core_distance": core, "reachability": reach,
            "predecessor": np.where(before >= 0, ids[before], -1), "cluster": labels,
        })

    whole = ends.dropna(subset=columns).select((F.col(scene) if scene else F.lit("")).cast("string").alias("scene"), F.col("track_id").cast("bigint").alias("track_id"), *columns)
    return whole.groupBy("scene").applyInPandas(run, POINT_SCHEMA)


def grid_search(ends: DataFrame, columns: list[str], min_samples: list[int], xis: list[float], max_eps: list[float]) -> DataFrame:
    """Clusters and outliers for every combination of parameters. The order does not depend on xi: it is found once for each of the other pairs, a task each."""
    spark = ends.sparkSession
    grid = spark.createDataFrame([(m, e) for m in min_samples for e in max_eps], "min_samples int, max_eps double")
    work = ends.dropna(subset=columns).select("track_id", *columns).crossJoin(F.broadcast(grid))  # the grid is a parameter

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("track_id", kind="stable")
        m, e = int(rows["min_samples"].iloc[0]), float(rows["max_eps"].iloc[0])
        x = rows[columns].to_numpy(float)
        reached = reach_order(x, m, e) if len(x) >= m else None
        out = []
        for xi in xis:
            labels = extracted(reached, m, xi) if reached else np.full(len(x), -1)
            noise = int((labels == -1).sum())
            out.append({"min_samples": m, "xi": float(xi), "max_eps": e, "n_clusters": len(set(labels.tolist()) - {-1}), "n_outliers": noise, "pct_outliers": 100.0 * noise / len(labels)})
        return pd.DataFrame(out)

    from ..schemas import TUNING

    # Ranges of so few values keep the tasks apart; a hash would put several into one, and small ones would be put together.
    return work.repartitionByRange(len(min_samples) * len(max_eps), "max_eps", "min_samples").groupBy("max_eps", "min_samples").applyInPandas(run, TUNING)


def good_parameters(results: DataFrame, low: int = 8, high: int = 20) -> DataFrame:
    return results.where(F.col("n_clusters").between(low, high))


def reachability_plot(clusters: DataFrame) -> DataFrame:
    """ord, reachability and whether the point is clustered, for a bar chart in the order reached."""
    return clusters.select("scene", "ord", "reachability", (F.col("cluster") >= 0).alias("clustered"))


