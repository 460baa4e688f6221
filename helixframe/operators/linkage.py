"""Single linkage over a table of edges: minimum spanning forests by Boruvka's rounds, clusters by cutting their longest edges.

In a round every component takes its shortest edge to another, and the components that are
so joined become one, so the rounds are as many as the logarithm of the nodes. Edges are
ordered by distance, then by their ends, so no two are equal and the forest is one whatever
the partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.relational import with_earlier
from helixframe.scratch import settled


def _roots(picks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, comp, root) from each component's choice (keys, comp, other): the component that its chain of choices ends in."""
    back = picks.select(*keys, F.col("comp").alias("other"), F.col("other").alias("_back"))
    chosen = picks.select(*keys, "comp", "other").join(back, [*keys, "other"])
    own = (F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("other"))  # the least of two that chose each other
    roots = chosen.select(*keys, "comp", F.when(own, F.col("comp")).otherwise(F.col("other")).alias("root"))
    while True:  # each pass goes three times as far
        roots = settled(roots)
        ahead = roots
        for _ in range(2):
            step = roots.select(*keys, F.col("comp").alias("root"), F.col("root").alias("_next"))
            ahead = ahead.join(step, [*keys, "root"]).select(*keys, "comp", F.col("_next").alias("root"))
        ends = roots.select(*keys, F.col("comp").alias("root"), F.col("root").alias("_end"))
        if roots.join(ends, [*keys, "root"]).filter("_end <> root").isEmpty():
            return roots
        roots = ahead


def spanning_forest(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, a, b, distance) of the minimum spanning forest, a < b, and (keys, node, comp) with the component of every node.

    Of several edges between two nodes the shortest counts, and those of a node with itself,
    or without a distance, only name the node. Components are named by one of their nodes.
    """
    ends = F.explode(F.array("a", "b")).alias("node")
    labels = settled(edges.select(*keys, ends).filter("node is not null").distinct().withColumn("comp", F.col("node")))
    sides = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = edges.filter("a is not null and b is not null and distance is not null and a <> b").select(*keys, *sides, "distance")
    left = settled(left.groupBy(*keys, "a", "b").agg(F.min("distance").alias("distance")).withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    none = left.select(*keys, "a", "b", "distance").limit(0)
    tree = [none]
    while not left.isEmpty():
        both = F.inline(F.array(F.struct(F.col("ca").alias("comp"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("comp"), F.col("ca").alias("other"))))
        picks = left.select(*keys, "distance", "a", "b", both).groupBy(*keys, "comp").agg(F.min(F.struct("distance", "a", "b", "other")).alias("_e"))
        picks = settled(picks.select(*keys, "comp", "_e.*"))
        tree.append(picks.select(*keys, "a", "b", "distance").distinct())
        roots = _roots(picks, keys)
        of = lambda c: roots.select(*keys, F.col("comp").alias(c), F.col("root").alias(f"_{c}"))
        moved = left.join(of("ca"), [*keys, "ca"]).join(of("cb"), [*keys, "cb"]).filter("_ca <> _cb")
        left = settled(moved.select(*keys, "a", "b", "distance", F.col("_ca").alias("ca"), F.col("_cb").alias("cb")))
        labels = settled(labels.join(roots, [*keys, "comp"], "left").select(*keys, "node", F.coalesce("root", "comp").alias("comp")))
    return settled(reduce(DataFrame.unionByName, tree)), labels


def single_linkage(distances: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, model, cluster) of k clusters, or as many as there are, from distances (keys, a, b, distance) in one or both directions.

    The longest edges of the minimum spanning forest are cut, those of equal distance by
    their ends, the greatest first, until there are k clusters; parts that no distance joins
    are apart already. Clusters are numbered by their least member.
    """
    tree, labels = spanning_forest(distances, keys)
    parts = labels.groupBy(*keys).agg(F.count_distinct("comp").alias("_parts"))
    ranked = with_earlier(tree, ["distance", "a", "b"], "_before", keys=keys, total="_all").join(parts, keys)
    kept = ranked.filter(F.col("_before") < F.col("_all") - F.greatest(F.lit(k) - F.col("_parts"), F.lit(0)))
    alone = labels.select(*keys, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(None).cast(dict(tree.dtypes)["distance"]).alias("distance"))
    _, clusters = spanning_forest(kept.select(*keys, "a", "b", "distance").unionByName(alone), keys)
    least = settled(clusters.groupBy(*keys, "comp").agg(F.min("node").alias("_least")))
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("_least")) - 1).alias("cluster")  # a row a cluster
    return clusters.join(least.select(*keys, "comp", number), [*keys, "comp"]).select(*keys, F.col("node").alias("model"), "cluster")
