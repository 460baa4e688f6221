"""Choosing models: top-k, cutoffs, representatives, quality, clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.arrays import lddt_share
from helixframe.operators.linkage import single_linkage
from helixframe.operators.relational import with_earlier
from helixframe.operators.windows import hanning


def top_k(rows: DataFrame, k: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """The first k rows of each group in the order given, whose last column settles ties."""
    rank = F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def top_half(rows: DataFrame, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """The first n // 2 rows of each group."""
    group = Window.partitionBy(*(keys or []))
    ranked = rows.withColumns({"_rank": F.row_number().over(group.orderBy(*order)), "_n": F.count("*").over(group)})
    return ranked.filter(F.col("_rank") <= F.floor(F.col("_n") / 2)).drop("_rank", "_n")


def within_best(rows: DataFrame, value: str, share: float = 0.9, keys: list[str] | None = None) -> DataFrame:
    """Rows whose (negative) score is under share times the group's least."""
    if keys:
        least = rows.groupBy(*keys).agg(F.min(value).alias("_least"))
        return rows.join(least, keys).filter(F.col(value) < F.col("_least") * share).drop("_least")
    least = rows.agg(F.min(value).alias("_least"))
    return rows.join(F.broadcast(least), F.col(value) < F.col("_least") * share).drop("_least")


def representative(rows: DataFrame, keys: list[str], value: str, tie: str, lowest: bool = False) -> DataFrame:
    """One row per group: of the highest (lowest) value, the first by tie."""
    order = [F.asc(value) if lowest else F.desc(value), F.asc(tie)]
    return top_k(rows, 1, order, keys)


def ensemble_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias(value))


def lddt_by_residue(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, lddt) of error histograms (i, j, esto, mask), the diagonal left out; null where nothing is masked in."""
    off = pairs.filter("i <> j")
    sums = off.groupBy(*(keys or []), "i").agg(F.sum(F.col("mask") * lddt_share(F.col("esto"))).alias("_s"), F.sum("mask").alias("_m"))
    return sums.select(*(keys or []), "i", F.try_divide("_s", "_m").alias("lddt"))


def long_range_quality(pairs: DataFrame, least_separation: int = 13, least_mask: float = 0.1, keys: list[str] | None = None) -> DataFrame:
    """(keys, num, quality): masked mean quality over long-range pairs i < j, counted at both ends; sums start at 1e-4."""
    keys = keys or []
    kept = pairs.filter((F.col("j") - F.col("i") >= least_separation) & (F.col("mask") > least_mask))
    both = F.explode(F.array("i", "j")).alias("num")
    rows = kept.select(*keys, both, (F.col("mask") * lddt_share(F.col("esto"))).alias("v"), "mask")
    sums = rows.groupBy(*keys, "num").agg(F.sum("v").alias("_v"), F.sum("mask").alias("_m"))
    return sums.select(*keys, "num", ((F.col("_v") + 1e-4) / (F.col("_m") + 1e-4)).alias("quality"))


def ca_deviation(quality: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds deviation, 1.5 exp(4 (0.7 - q)) of the smoothed quality."""
    smooth = hanning(quality, "quality", "num", keys)
    return smooth.withColumn("deviation", 1.5 * F.exp(4 * (0.7 - F.col("quality"))))


def distance_histogram(distances: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, bin, share): bins of asinh(max(d, 6) - 6) in steps of a quarter, over the decoys of each pair."""
    keys = keys or []
    bins = F.floor(F.asinh(F.greatest(F.col("d"), F.lit(6.0)) - 6) / 0.25).cast("int")
    counts = distances.groupBy(*keys, "i", "j", bins.alias("bin")).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*keys, "i", "j").agg(F.sum("_c").alias("_n"))
    return counts.join(totals, [*keys, "i", "j"]).select(*keys, "i", "j", "bin", (F.col("_c") / F.col("_n")).alias("share"))


def model_distances(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, a, b, distance) in both directions from (a, b, l1, l2) with a < b: 1 - (l1 + l2) / 2."""
    keys = keys or []
    d = (1 - (F.col("l1") + F.col("l2")) / 2).alias("distance")
    return pairs.select(*keys, "a", "b", d).unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), d))


def _agglomerate(matrix: np.ndarray, k: int) -> np.ndarray:
    """Average linkage."""
    n = len(matrix)
    d, sizes, label = matrix.astype(float).copy(), np.ones(n), np.arange(n)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    for _ in range(n - max(1, k)):
        a, b = sorted(np.unravel_index(np.argmin(d), d.shape))
        merged = (sizes[a] * d[a] + sizes[b] * d[b]) / (sizes[a] + sizes[b])
        d[a], d[:, a] = merged, merged
        d[b], d[:, b], d[a, a] = np.inf, np.inf, np.inf
        label[label == b] = a
        sizes[a] += sizes[b]
        alive[b] = False
    return np.searchsorted(np.flatnonzero(alive), label)


def clustered(distances: DataFrame, key: str, k: int = 3, linkage: str = "average") -> DataFrame:
    """(key, model, cluster) by agglomeration of each key's distance matrix (a, b, distance) to k clusters.

    Average linkage needs a key's whole matrix, one target's few models; targets are what
    Spark deals out. Single linkage (linkage.single_linkage) needs none.
    """
    if linkage == "single":
        return single_linkage(distances, [key], k)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        matrix = group.pivot_table(index="a", columns="b", values="distance")
        names = sorted(set(matrix.index) | set(matrix.columns))
        full = matrix.reindex(index=names, columns=names).fillna(0.0).to_numpy()
        return pd.DataFrame({key: group[key].iloc[0], "model": names, "cluster": _agglomerate(full, min(k, len(names)))})

    kinds = dict(distances.dtypes)
    return distances.groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, model {kinds['a']}, cluster int")


def final_models(scores: DataFrame, clusters: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, number, model, score, why): the models that are handed in for each target, numbered from 1.

    First the best model of each cluster among the better half of scores (key, model,
    score), best first; then the best of the first half of candidates (key, model, score) in
    order of model, which one method made, and the best of the rest, the other's. Candidates
    are judged by themselves, picked or not. Of equal scores the greater model comes first in
    the pool, the lesser among candidates. A target without candidates has picks only.
    """
    better = top_half(scores.select(key, "model", "score"), [F.desc("score"), F.desc("model")], [key])
    picked = top_k(better.join(clusters.select(key, "model", "cluster"), [key, "model"]), 1, [F.desc("score"), F.desc("model")], [key, "cluster"])
    placed = with_earlier(candidates.select(key, "model", "score"), ["model"], "_before", keys=[key], total="_all")
    first = F.col("_before") < F.floor(F.col("_all") / 2)
    best = top_k(placed.withColumn("why", F.when(first, "MSA").otherwise("TBM")), 1, [F.desc("score"), F.asc("model")], [key, "why"])
    rows = picked.select(key, "model", "score", F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("why"), F.lit(0).alias("_turn"))
    rows = rows.unionByName(best.select(key, "model", "score", "why", F.when(F.col("why") == "MSA", 1).otherwise(2).alias("_turn")))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_turn", F.desc("score"), F.desc("model")))  # a handful a target
    return rows.withColumn("number", number).select(key, "number", "model", "score", "why")
