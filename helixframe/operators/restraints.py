"""Restraints from predicted distributions: probability cuts, separations, potentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.arrays import angle_potential, distance_potential, mass, padded_circle, padded_mirror, rolled

#: What each kind's probability cut adds to the common one.
EXTRA_CUT = {"dist": 0.0, "omega": 0.5, "theta": 0.5, "phi": 0.6}
FIRST_BIN, BIN_WIDTH = 2.25, 0.5


def contact_probability(kind: Column, probs: Column) -> Column:
    """Mass of a pair's bins that mean contact: 5 to 20 for distances, all but the first for angles."""
    return F.when(kind == "dist", mass(probs, 5, 21)).otherwise(mass(probs, 1))


def candidates(pairs: DataFrame) -> DataFrame:
    """Pairs (i, j, kind, probs) with p; symmetric kinds keep i < j, and no kind keeps i = j."""
    symmetric = F.col("kind").isin("dist", "omega")
    kept = pairs.filter(F.when(symmetric, F.col("i") < F.col("j")).otherwise(F.col("i") != F.col("j")))
    return kept.withColumn("p", contact_probability(F.col("kind"), F.col("probs")))


def chosen(rows: DataFrame, first: int, last: int, cut: float, glycines: DataFrame | None = None, second_cut: float | None = None) -> DataFrame:
    """Rows with first <= |i - j| < last and p at the kind's cut or over; without glycines (num) if asked; distances also have p12 at second_cut or over."""
    apart = F.abs(F.col("i") - F.col("j"))
    least = F.lit(cut)
    for kind, extra in EXTRA_CUT.items():
        least = F.when(F.col("kind") == kind, cut + extra).otherwise(least)
    kept = rows.filter((apart >= first) & (apart < last) & (F.col("p") >= least))
    if glycines is not None:
        for end in "ij":
            kept = kept.join(glycines.select(F.col("num").alias(end)), end, "left_anti")
    return kept if second_cut is None else kept.filter((F.col("kind") != "dist") | (F.col("p12") >= second_cut))


def restraints(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, kind, i, j, p, spline): potentials of the chosen rows, padded where angles wrap round."""
    bins = [FIRST_BIN + BIN_WIDTH * k for k in range(36)]
    probs = F.col("probs")
    distances = distance_potential(F.slice(probs, 2, 36), bins)
    angles = angle_potential(F.slice(probs, 2, F.size(probs) - 1))
    spline = F.when(F.col("kind") == "dist", distances).when(F.col("kind") == "phi", padded_mirror(angles)).otherwise(padded_circle(angles))
    return rows.select(*(keys or []), "kind", "i", "j", "p", spline.alias("spline"))


def between_chains_weight(i: Column, j: Column, first_length: int) -> Column:
    """2 for pairs from the first chain to the second, else 1."""
    return F.when((i < first_length) & (j >= first_length), 2.0).otherwise(1.0)


def no_contact_first(probs: Column) -> Column:
    """Moves the last bin, no contact, to the front."""
    return rolled(probs, 1)


def torsion_bin(u: Column) -> Column:
    """0 to 5 for a number in 0 to 1, by how common the regions of backbone torsions are."""
    out = F.lit(5)
    for at, share in reversed(list(enumerate((0.135, 0.29, 0.363, 0.485, 0.982)))):
        out = F.when(u <= share, at).otherwise(out)
    return out
