"""Centroid clustering by sort-means.

Each round, every centroid lists the others by their distance from it. A vector starts at
the centroid it had before and goes through that one's list, until the next centroid is
strictly more than twice as far from the old one as the vector is: by the triangle
inequality neither it nor any after it can be nearer, nor as near. Centroids are a few rows
of whole numbers and go to the tasks with the function; a round's vectors and clusters are
a table that the next one reads, and only sums for each cluster come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import settle
from helixframe.llm.vectors import flat, usable, whole

CLUSTERS, ROUNDS, COMPONENTS = 16, 3, 64


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = points - centre
    return np.einsum("ij,ij->i", apart, apart)


def nearest(points: np.ndarray, before: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centre of each point (of equals the first), its squared distance, and how many distances were computed.

    before has the centre that each point starts from.
    """
    between = np.stack([squared(centres, c) for c in centres])
    cluster, distance = before.copy(), squared(points, centres[before])
    computed = len(points)
    for old in range(len(centres)):
        rows = np.flatnonzero(before == old)
        if not len(rows):
            continue
        rows = rows[np.argsort(-distance[rows], kind="stable")]  # those that look farthest first: the ones still looking are a prefix
        x, own = points[rows], distance[rows]
        best, at = own.copy(), np.full(len(rows), old)
        for other in np.argsort(between[old], kind="stable"):
            if other == old:
                continue
            n = int(np.searchsorted(-4 * own, -between[old, other], side="right"))
            if not n:
                break
            d = squared(x[:n], centres[other])
            computed += n
            closer = (d < best[:n]) | ((d == best[:n]) & (other < at[:n]))
            best[:n][closer], at[:n][closer] = d[closer], other
        cluster[rows], distance[rows] = at, best
    return cluster, distance, computed


def _assign(centres: list[list[int]]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.array(centres, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = flat(batch.column("q"))[0].reshape(batch.num_rows, -1)
            cluster, distance, _ = nearest(points, batch.column("cluster").to_numpy(), places)
            arrays = [batch.column("_id"), batch.column("q"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "q", "cluster", "distance"])

    return assign


def _moved(assigned: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """The exact floor of each cluster's mean; an empty cluster's centre stays."""
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(len(centres[0]))])
    moved = list(centres)
    for row in sums.collect():  # a row a cluster
        moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(len(centres[0]))]
    return moved


def sort_means(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    seed: str = "1",
) -> DataFrame:
    """One row per vector kept: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Kept are the vectors of exactly so many components, none null or not finite; each
    component x becomes floor(64 * x), and one that is too large for exact sums is an error.
    The first centres are the kept vectors of smallest SHA-256 of seed:id, in that order; of
    equal ids the smaller vector comes first, and null ids come last. Where fewer vectors
    are kept than clusters are asked for, each is a centre. Ties go to the smaller
    number. Repeated rows are vectors of their own; equal centres leave the later ones
    empty, and those stay where they are. distance is squared, cluster_inertia its sum over
    the cluster, inertia over all, centroid_sha256 of the last centre's components joined
    by commas. No kept vectors give no rows; other columns are not read.
    """
    rows = vectors.filter(usable(vector_col) & (F.size(vector_col) == components))
    rows = rows.select(F.col(id_col).alias("_id"), whole(vector_col).alias("q"), F.lit(0).alias("cluster"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    rows = settle(rows)
    centres = [list(r["q"]) for r in rows.orderBy(mark.asc_nulls_last(), "q").select("q").limit(clusters).collect()]
    kind = dict(rows.dtypes)["_id"]
    columns = f"_id {kind}, q array<bigint>, cluster int, distance bigint"
    for _ in range(rounds if centres else 0):
        rows = settle(rows.select("_id", "q", "cluster").mapInArrow(_assign(centres), columns))
        centres = _moved(rows, centres)
    rows = rows.select("_id", "q", "cluster").mapInArrow(_assign(centres), columns).select("_id", "cluster", "distance")
    rows = settle(rows)
    sums = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # a row a cluster
    texts = [",".join(map(str, c)) for c in centres]
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return rows.select(
        F.col("_id").alias(id_col),
        "cluster",
        "distance",
        of([sums.get(i, 0) for i in range(len(centres))] or [0], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        of([hashlib.sha256(t.encode()).hexdigest() for t in texts] or [""], "string").alias("centroid_sha256"),
    )
