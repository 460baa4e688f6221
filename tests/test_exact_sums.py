"""Sums of doubles against math.fsum, bit by bit, under several partitionings."""

from __future__ import annotations

import math
import random
import struct

from pyspark.sql import functions as F

from helixframe.operators import exact_sums, scoring


def bits(x):
    return None if x is None else struct.pack(">d", x)


def groups():
    random.seed(9)
    out = {
        "plain": [random.uniform(-1, 1) for _ in range(500)],
        "wide": [random.choice((-1, 1)) * math.ldexp(random.random(), random.randint(-300, 300)) for _ in range(500)],
        "cancel": [v for k in range(200) for v in (1e300 / (k + 1), -1e300 / (k + 1))] + [1e-300, 3.5],
        "minus": [-random.random() * 10.0 ** random.randint(-20, 5) for _ in range(300)],
        "tiny": [5e-324, 5e-324, -1e-323, 2.5e-310, 5e-324],
        "nothing": [1.0, -1.0],
        "zeros": [0.0, -0.0],
        "one": [0.1],
        "powers": [2.0**k for k in range(-60, 60)] + [-(2.0**k) for k in range(-60, 30)],
        "half": [2.0**53, 1.0],
        "over half": [2.0**53, 1.0, 2.0**-200],
        "under half": [2.0**53, 1.0, -(2.0**-200)],
        "odd half": [2.0**53 + 2, 1.0],
        "large": [1.7e308, 1e292, -3.0],
        "some": [None, 2.5, None],
    }
    for k in range(60):
        out[f"random{k}"] = [random.choice((-1, 1)) * math.ldexp(random.random(), random.randint(-70, 70)) for _ in range(random.randint(1, 40))]
    return out


def test_sums_are_nearest_and_order_free(spark):
    data = groups()
    rows = spark.createDataFrame([(k, v) for k, values in data.items() for v in values], "k string, v double")
    expected = {k: bits(math.fsum(v for v in values if v is not None) + 0.0) for k, values in data.items()}
    for n, seed in ((1, 1), (7, 2)):
        dealt = rows.repartition(n, F.rand(seed))
        found = {r["k"]: bits(r["s"]) for r in exact_sums.exact_sum(dealt, ["k"], "v", "s").collect()}
        assert {k: v for k, v in found.items() if v != expected[k]} == {}
        assert set(found) == set(expected)


def test_states_merge(spark):
    rows = spark.createDataFrame([(k, i, v) for k, values in groups().items() for i, v in enumerate(values)], "k string, i int, v double")
    parts = [exact_sums.sum_states(rows.filter(F.col("i") % 3 == p), ["k"], "v") for p in range(3)]
    whole = exact_sums.merged(parts[2].unionByName(parts[0]).unionByName(parts[1]), ["k"])
    one, all_at_once = (sorted((r["k"], bits(r["s"])) for r in df.collect()) for df in (exact_sums.finished(whole, ["k"], "s"), exact_sums.exact_sum(rows, ["k"], "v", "s")))
    assert one == all_at_once


def test_nulls_and_values_that_are_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    data = [("up", inf), ("up", 1.0), ("both", inf), ("both", -inf), ("nan", nan), ("nan", 2.0), ("null", None), ("zero", 0.0), ("zero", None)]
    got = {r["k"]: r["s"] for r in exact_sums.exact_sum(spark.createDataFrame(data, "k string, v double"), ["k"], "v", "s").collect()}
    assert got["up"] == inf and math.isnan(got["both"]) and math.isnan(got["nan"]) and got["null"] is None and got["zero"] == 0.0
    assert exact_sums.exact_sum(spark.createDataFrame([], "k string, v double"), ["k"], "v", "s").count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_sums.exact_sum(spark.range(3).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v")), ["k"], "v", "s")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_scores_do_not_depend_on_order(spark):
    random.seed(3)
    data = [("AB"[i % 2], i % 5, "A", i, "AA", random.random() * 10.0 ** random.randint(-8, 8), random.random()) for i in range(600)]
    merged = spark.createDataFrame(data, "a_chain string, a_num int, b_chain string, b_num int, class string, t_area double, m_area double")
    found = []
    for n, seed in ((1, 1), (6, 2)):
        profiles = scoring.profile(merged.repartition(n, F.rand(seed)), 1, exact=True)
        found.append((sorted(map(tuple, profiles.collect())), scoring.global_scores(profiles, exact=True).first()))
    assert found[0] == found[1]
    of = {(c, n): math.fsum(t for a, k, _, _, _, t, _ in data if (a, k) == (c, n)) for c in "AB" for n in range(5)}
    assert {(r[0], r[1]): r[4] for r in found[0][0]} == of
    assert found[0][1]["reference"] == math.fsum(of.values()) and found[0][1]["residues"] == 10
