"""Representatives of a universe: exact k-medoids by branch and bound per decision, one distance matrix per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_subset(dist: np.ndarray, k: int, first: int | None = None) -> tuple[tuple[int, ...], float, int]:
    """The subset with the least sum of distances to the nearest member (to 11 places; of equal ones the first in
    order), its sum, and the nodes visited. first: only subsets whose first member it is. Depth first over the subset tree in
    order: what r more members can save is at most the sum of the r largest savings of one member, since later
    savings only shrink, and never more than all later members together save. A greedy subset with swaps
    gives the first limit."""
    n = len(dist)
    if not 0 < k <= n:
        raise ValueError("k")
    dist = np.ascontiguousarray(dist, dtype=float)
    last = np.minimum.accumulate(dist[:, ::-1], axis=1)[:, ::-1]  # nearest of the members from j on
    best: tuple[tuple[int, ...] | None, float] = None, _swapped(dist, k, first)
    nodes = 0

    def grow(members: tuple[int, ...], near: np.ndarray, start: int) -> None:
        nonlocal best, nodes
        nodes += 1
        left = k - len(members)
        if not left:
            cost = float(near.sum())
            if round(cost, 11) < round(best[1], 11) or best[0] is None and round(cost, 11) <= round(best[1], 11):
                best = members, cost
            return
        bare = near.copy()
        bare[np.isinf(bare)] = 2 * len(dist) * (1 + np.abs(dist).max())  # so that a first member saves, too
        total = bare.sum()
        stop = n - left + 1
        saved = np.maximum(bare[:, None] - dist[:, start:], 0).sum(axis=0)
        for j in range(start, stop) if members or first is None else (first,):
            more = np.sort(saved[j + 1 - start :])[::-1][: left - 1].sum() if left > 1 else 0.0
            floor = total - saved[j - start] - more
            if max(floor, np.minimum(bare, last[:, j]).sum()) > best[1] + 1e-9:
                continue
            grow((*members, j), np.minimum(near, dist[:, j]), j + 1)

    grow((), np.full(n, np.inf), 0)
    return best[0], best[1], nodes


def _swapped(dist: np.ndarray, k: int, first: int | None) -> float:
    """Cost of a subset found by taking the best member each time and then exchanging members while that helps."""
    n = len(dist)
    fixed = [] if first is None else [first]
    free = [j for j in range(n) if first is None or j > first]
    chosen = list(fixed)

    def cost(x: list[int]) -> float:
        return float(dist[:, x].min(axis=1).sum())

    while len(chosen) < k:
        chosen.append(min((j for j in free if j not in chosen), key=lambda j: cost([*chosen, j])))
    while True:
        tries = [[*(x for x in chosen if x != out), j] for out in chosen if out not in fixed for j in free if j not in chosen]
        better = min(tries, key=cost, default=chosen)
        if cost(better) >= cost(chosen) - 1e-12:
            return cost(chosen)
        chosen = better


def medoids(distances: DataFrame, k: int) -> DataFrame:
    """Per t the chosen assets, the objective and the nodes visited, from (t, a, b, dist). Subsets are dealt by their
    first member, so one t spreads over as many tasks as it has assets; each takes the distance matrix, whose
    size is the square of the universe's, and gives its best."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for t, assets, flat, first in zip(pdf["t"], pdf["assets"], pdf["flat"], pdf["first"], strict=True):
                n = len(assets)
                chosen, cost, nodes = best_subset(np.asarray(flat, float).reshape(n, n), min(k, n), int(first))
                rows.append((t, round(cost, 11), [assets[i] for i in chosen], cost, nodes))
            yield pd.DataFrame(rows, columns=["t", "rounded", "chosen", "objective", "nodes"])

    packed = distances.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("a", "b", "dist"))).alias("x"), F.array_sort(F.collect_set("a")).alias("assets"))
    parts = packed.select("t", "assets", F.col("x.dist").alias("flat"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("assets") - k, F.lit(0)))).alias("first"))
    found = parts.repartition("t", "first").mapInPandas(run, "t long, rounded double, chosen array<string>, objective double, nodes long")
    best = found.groupBy("t").agg(F.min(F.struct("rounded", "chosen", "objective")).alias("m"), F.sum("nodes").alias("nodes"))
    return best.select("t", F.explode("m.chosen").alias("asset"), F.col("m.objective").alias("objective"), "nodes")


def nearest(distances: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each asset's nearest chosen one; of equal ones the first by name."""
    rows = distances.join(chosen.select("t", F.col("asset").alias("b")), ["t", "b"])
    return rows.groupBy("t", F.col("a").alias("asset")).agg(F.min(F.struct("dist", "b")).alias("m")).select("t", "asset", F.col("m.b").alias("representative"), F.col("m.dist").alias("dist"))


def objective(distances: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per t the sum over all assets of the distance to the nearest chosen one, by the distances of that t."""
    met = chosen.select("t", F.col("asset").alias("b")).join(distances.select("t", "a", "b", "dist"), ["t", "b"])
    return met.groupBy("t", "a").agg(F.min("dist").alias("m")).groupBy("t").agg(F.sum("m").alias("objective"))


def steadiest(volatility: DataFrame, k: int) -> DataFrame:
    """The k assets of least volatility per t; ties by name."""
    rank = F.row_number().over(Window.partitionBy("t").orderBy("vol", "asset"))
    return volatility.filter("vol is not null").withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)


def changes(chosen: DataFrame) -> DataFrame:
    """Per t the chosen set, its Jaccard similarity with the one before and the number of newcomers."""
    sets = chosen.groupBy("t").agg(F.array_sort(F.collect_set("asset")).alias("members"))
    before = F.lag("members").over(Window.orderBy("t"))
    rows = sets.withColumn("before", before)
    same, all_ = F.size(F.array_intersect("members", "before")), F.size(F.array_union("members", "before"))
    return rows.select("t", "members", F.when(F.col("before").isNotNull(), same / all_).alias("jaccard"), F.when(F.col("before").isNotNull(), F.size(F.array_except("members", "before"))).cast("bigint").alias("switched"))
