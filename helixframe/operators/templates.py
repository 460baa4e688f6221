"""Features that template structures lend to a query sequence, by the matched places of their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.msa import first_rows
from helixframe.scratch import settled

#: Edges of distance bins: the first, the step and how many; a pair that doesn't touch is in the last bin.
FIRST_EDGE, EDGE_STEP, EDGES = 2.5, 0.5, 36
HIT = ["structure_id", "hit"]
#: The most pairs of template residues that are broadcast.
BROADCAST_PAIRS = 500_000


def first_hits(hits: DataFrame, most: int) -> DataFrame:
    """The first most hits (structure_id, hit, ...) of each structure, in the order of their file."""
    return first_rows(hits, most, "hit", ["structure_id"])


def placed(matches: DataFrame, residues: DataFrame) -> DataFrame:
    """Matches (structure_id, hit, label, q, t, similarity, confidence) whose template (label, num) has the residue.

    Of matches that repeat a template's place the one of the least q counts, then of those
    that repeat the query's place the one of the largest t. Matches are shuffled
    once, by hit.
    """
    there = residues.select("label", F.col("num").alias("t")).distinct()
    row = F.struct("similarity", "confidence")
    dealt = matches.join(there, ["label", "t"]).repartition(*HIT)
    one = dealt.groupBy(*HIT, "label", "t").agg(F.min(F.struct("q", row.alias("row"))).alias("m"))
    return one.groupBy(*HIT, "label", F.col("m.q").alias("q")).agg(F.max(F.struct("t", "m.row")).alias("m")).select(*HIT, "label", "q", "m.t", "m.row.similarity", "m.row.confidence")


def columns(matches: DataFrame) -> DataFrame:
    """(structure_id, hit, pos, t1d): similarity and confidence at the query's matched places; elsewhere both are 0."""
    return matches.select(*HIT, F.col("q").alias("pos"), F.array(F.col("similarity").cast("double"), F.col("confidence").cast("double")).alias("t1d"))


def distance_bin(d: Column) -> Column:
    """How many edges are at or under the distance: 0 to EDGES; null, which is no contact, gives EDGES."""
    bin = F.floor((d - FIRST_EDGE) / EDGE_STEP) + 1
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(EDGES), bin)), F.lit(EDGES)).cast("int")


def pairs(matches: DataFrame, orientations: DataFrame, hits: DataFrame) -> DataFrame:
    """(structure_id, hit, i, j, t2d): distance bin, omega, theta and phi of the template's pair, and the hit's prob, seqid and neff.

    orientations: (label, i, j, d, omega, theta, phi) of the templates by residue number. Only
    pairs that touch have rows; any other pair of matched places holds bin EDGES, angles of 0
    and its hit's numbers, any other place zeros.
    """
    #  a hit's places meet where the hit is; where the templates' pairs are few, none of theirs is shuffled
    places = F.collect_list(F.struct("q", "t", "label"))
    one = matches.groupBy(*HIT).agg(places.alias("places")).join(hits.select(*HIT, "prob", "seqid", "neff"), HIT)
    one = one.select("*", F.explode("places").alias("a")).select("*", F.explode("places").alias("b"))
    names = {"label": "a.label", "i": "a.q", "_t1": "a.t", "j": "b.q", "_t2": "b.t"}
    both = one.select(*HIT, "prob", "seqid", "neff", *[F.col(c).alias(n) for n, c in names.items()])
    template = settled(orientations.select("label", F.col("i").alias("_t1"), F.col("j").alias("_t2"), "d", "omega", "theta", "phi"))
    found = both.join(F.broadcast(template) if template.count() <= BROADCAST_PAIRS else template, ["label", "_t1", "_t2"])
    angles = [F.coalesce(c, F.lit(0.0)).cast("double") for c in ("omega", "theta", "phi")]
    return found.select(*HIT, "i", "j", F.array(distance_bin(F.col("d")).cast("double"), *angles, *[F.col(c).cast("double") for c in ("prob", "seqid", "neff")]).alias("t2d"))
