"""Operators over ordered rows: smoothing, chopping, ranks, breaks, covering windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import geometry as g
from helixframe.functions.arrays import hanning_weights


def _by(keys: list[str] | None) -> Window:
    return Window.partitionBy(*(keys or []))


def hanning(rows: DataFrame, value: str, order: str, keys: list[str] | None = None, size: int = 13) -> DataFrame:
    """The value convolved with a normalised Hanning window; the ends are repeated."""
    half, weights = size // 2, hanning_weights(size)
    ordered, whole = _by(keys).orderBy(order), _by(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    parts = []
    for k, w in enumerate(weights):
        step = k - half
        x = F.lag(value, -step).over(ordered) if step < 0 else F.lead(value, step).over(ordered)
        parts.append(F.coalesce(x, first if step < 0 else last) * w)
    return rows.withColumn(value, sum(parts[1:], parts[0]))


def chopped_ends(residues: DataFrame, keys: list[str] | None = None, shares=range(0, 25, 3), shortest: int = 40) -> DataFrame:
    """(keys, chain, num, share): residues left when a share in percent of each chain is cut at both ends.

    A structure with a chain under the shortest length gives no rows.
    """
    keys = keys or []
    chain = Window.partitionBy(*keys, "chain")
    ranked = residues.select(*keys, "chain", "num").withColumns({"_rank": F.row_number().over(chain.orderBy("num")) - 1, "_n": F.count("*").over(chain)})
    ranked = ranked.withColumn("_least", F.min("_n").over(Window.partitionBy(*keys))) if keys else ranked.join(
        F.broadcast(ranked.agg(F.min("_n").alias("_least"))), F.lit(True)
    )
    table = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    rows = ranked.filter(F.col("_least") >= shortest).select(*keys, "chain", "num", "_rank", "_n", table)
    cut = F.floor(F.col("share") * F.col("_n") / 100)
    return rows.filter((cut <= F.col("_rank")) & (F.col("_rank") + cut < F.col("_n"))).select(*keys, "chain", "num", "share")


def dense_index(rows: DataFrame, columns: list[str], keys: list[str] | None = None, name: str = "idx") -> DataFrame:
    """Adds the 0-based place of each distinct value of the columns, in their order."""
    return rows.withColumn(name, F.dense_rank().over(_by(keys).orderBy(*columns)) - 1)


def match_index(columns: DataFrame, is_match: Column, order: str, start: Column, keys: list[str] | None = None) -> DataFrame:
    """Adds match: the start plus the number of earlier matches; null in gaps."""
    seen = F.sum(F.when(is_match, 1).otherwise(0)).over(_by(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return columns.withColumn("match", F.when(is_match, start + seen - 1))


def insertion_counts(columns: DataFrame, is_match: Column, order: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, inserted): insertions before each match position."""
    seen = F.sum(F.when(is_match, 1).otherwise(0)).over(_by(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = columns.withColumn("_at", F.when(is_match, seen - 1).otherwise(seen)).withColumn("_in", F.when(is_match, 0).otherwise(1))
    return placed.groupBy(*(keys or []), F.col("_at").alias("pos")).agg(F.sum("_in").alias("inserted"))


def chain_breaks(ca: DataFrame, order: str = "num", keys: list[str] | None = None, longest: float = 4.0) -> DataFrame:
    """Adds broken: whether the CA before or after is farther than the longest."""
    w = _by(keys).orderBy(order)
    before, after = (g.distance(F.col("p"), f("p").over(w)) > longest for f in (F.lag, F.lead))
    return ca.withColumn("broken", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


def backbone_torsions(residues: DataFrame, order: str = "num", keys: list[str] | None = None) -> DataFrame:
    """Adds phi and psi from the C before and the N after; 0 at the ends."""
    w = _by(keys).orderBy(order)
    before, after = F.lag("c").over(w), F.lead("n").over(w)
    phi = g.dihedral(before, F.col("n"), F.col("ca"), F.col("c"))
    psi = g.dihedral(F.col("n"), F.col("ca"), F.col("c"), after)
    return residues.withColumns({"phi": F.coalesce(phi, F.lit(0.0)), "psi": F.coalesce(psi, F.lit(0.0))})


def sliding_windows(lengths: DataFrame, length_col: str = "length", sizes=(64, 128, 256)) -> DataFrame:
    """(..., size, first): windows of stride 1; one of the whole length where it is no longer than the size."""
    size = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    rows = lengths.select("*", size)
    starts = F.sequence(F.lit(0), F.greatest(F.col(length_col) - F.col("size"), F.lit(0)))
    return rows.select("*", F.explode(starts).alias("first"))


def window_cover(lengths: DataFrame, keys: list[str], length_col: str = "length", sizes=(64, 128, 256)) -> DataFrame:
    """(keys, pos, cover): how many windows hold each position, from the two ends alone and without listing windows."""
    pos = F.explode(F.sequence(F.lit(0), F.col(length_col) - 1)).alias("pos")
    rows = lengths.filter(F.col(length_col) > 0).select(*keys, length_col, pos)
    parts = []
    for s in sizes:
        last = F.greatest(F.col(length_col) - s, F.lit(0))
        parts.append(F.least(F.col("pos"), last) - F.greatest(F.col("pos") - s + 1, F.lit(0)) + 1)
    return rows.select(*keys, "pos", sum(parts[1:], parts[0]).alias("cover"))


def window_pairs(lengths: DataFrame, length_col: str = "length", sizes=(64, 96, 128), shift: int = 8) -> DataFrame:
    """(..., size, i, j, i_length, j_length): pairs of windows that start at multiples of the shift under length - size, j from i + size on.

    Windows are size long, but the last one reaches to the end of the sequence.
    """
    size = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    rows = lengths.select("*", size).filter(F.col(length_col) >= 2 * F.col("size"))
    starts = F.sequence(F.lit(0), F.col(length_col) - F.col("size") - 1, F.lit(shift))
    rows = rows.withColumn("_starts", starts).select("*", F.explode("_starts").alias("i"))
    #  whole shifts from i to j, as many as a window has
    apart = F.expr(f"size div {shift}") * shift
    rows = rows.select("*", F.explode(F.filter("_starts", lambda j: j >= F.col("i") + apart)).alias("j"))
    reach = [F.when(F.col(at) == F.element_at("_starts", -1), F.col(length_col) - F.col(at)).otherwise(F.col("size")).alias(f"{at}_length") for at in "ij"]
    return rows.select("*", *reach).drop("_starts")


def covered_mean(windows: DataFrame, values: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, pos, value): the weighted mean of what windows (keys, size, first) say of their places (size, first, offset, value)."""
    w = F.lit(1.0) if weight is None else weight
    joined = windows.join(values, [*keys, "size", "first"]).withColumn("pos", F.col("first") + F.col("offset"))
    sums = joined.groupBy(*keys, "pos").agg(F.sum(F.col("value") * w).alias("_v"), F.sum(w).alias("_w"))
    return sums.select(*keys, "pos", F.try_divide("_v", "_w").alias("value"))
