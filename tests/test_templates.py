"""Template features against loops."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import templates

MATCH = "structure_id int, hit int, label string, q int, t int, similarity int, confidence int"


def test_columns_and_pairs(spark):
    random.seed(2)
    matches = [(s, h, "ab"[h % 2], 3 + k + k // 4, k + k // 5, random.randrange(5), random.randrange(10)) for s in (1, 2) for h in range(3) for k in range(12)]
    residues = [(label, t) for label in "ab" for t in range(16) if t % 6 != 2]
    geometry = [(label, i, j, random.uniform(1, 24), random.random(), random.random(), random.random()) for label in "ab" for i in range(16) for j in range(16) if i != j and random.random() < 0.5]
    hits = [(s, h, 0.1 * h, 0.2 * s, 5.0) for s in (1, 2) for h in range(3)]
    first = templates.first_hits(spark.createDataFrame(hits, "structure_id int, hit int, prob double, seqid double, neff double"), 2)
    kept = templates.placed(spark.createDataFrame(matches, MATCH), spark.createDataFrame(residues, "label string, num int"))
    one = {(r["structure_id"], r["hit"], r["pos"]): tuple(r["t1d"]) for r in templates.columns(kept).collect()}
    there = [m for m in matches if (m[2], m[4]) in set(residues)]
    assert one == {(s, h, q): (float(a), float(c)) for s, h, _, q, _, a, c in there}

    found = templates.pairs(kept, spark.createDataFrame(geometry, "label string, i int, j int, d double, omega double, theta double, phi double"), first)
    got = {(r["structure_id"], r["hit"], r["i"], r["j"]): tuple(r["t2d"]) for r in found.collect()}
    edges = np.linspace(2.5, 20, 36)
    at = {(g[0], g[1], g[2]): g[3:] for g in geometry}
    expected = {}
    for a in there:
        for b in there:
            if a[:2] == b[:2] and a[1] < 2 and (a[2], a[4], b[4]) in at:
                d, *angles = at[a[2], a[4], b[4]]
                expected[a[0], a[1], a[3], b[3]] = (float(np.digitize(d, edges)), *angles, 0.1 * a[1], 0.2 * a[0], 5.0)
    assert got == expected and got


def test_repeated_places_and_edges(spark):
    data = [(1, 0, "a", 7, 3, 1, 1), (1, 0, "a", 5, 3, 2, 2), (1, 0, "a", 5, 4, 3, 3), (1, 0, "a", None, 9, 1, 1)]
    kept = templates.placed(spark.createDataFrame(data, MATCH), spark.createDataFrame([("a", 3), ("a", 4), ("a", 4)], "label string, num int"))
    assert [(r["q"], r["t"], r["similarity"]) for r in kept.collect()] == [(5, 4, 3)]
    bins = spark.createDataFrame([(v,) for v in (0.0, 2.49, 2.5, 2.99, 3.0, 19.99, 20.0, 999.9, None)], "d double").select(templates.distance_bin(F.col("d")))
    assert [r[0] for r in bins.collect()] == [0, 0, 1, 1, 2, 35, 36, 36, 36]
    assert kept.filter("q < 0").count() == 0 and templates.columns(kept.filter("q < 0")).count() == 0
