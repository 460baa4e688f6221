"""Centroid clustering, exact top-k search and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm.centroids import nearest, sort_means
from helixframe.llm.filter_audit import filter_audit
from helixframe.llm.topk_search import best_of, top_scores
from tests.llm.fixtures import SCHEMA, documents

VECTORS = "vec_id long, embedding array<float>, cluster string, q string, rank string, score string, block string"


def vectors(components=4, n=160):
    rng = random.Random(5)
    rows = [[i, [rng.choice([0.0, rng.uniform(-1, 1), 0.25]) for _ in range(components)]] for i in range(n)]
    rows += [rows[3], rows[3], [20, rows[7][1]], [None, rows[9][1]], [None, [0.5] * components], [500, None], [501, []], [520, [0.5] * (components + 1)]]
    rows += [[540, [math.nan] + [0.0] * (components - 1)], [560, [math.inf] * components], [580, [None] + [0.1] * (components - 1)], [600, [0.0] * components]]
    return [tuple(r) + (None,) * 5 for r in rows]


def is_query():
    return F.col("vec_id") % 20 == 0


def whole(vector):
    return [math.floor(64 * float(np.float32(x))) for x in vector]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def brute_clusters(rows, clusters, rounds, components):
    kept = [(i, whole(v)) for i, v, *_ in rows if usable(v) and len(v) == components]
    mark = lambda x: (x[0] is None, "" if x[0] is None else hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1])
    centres = [v for _, v in sorted(kept, key=mark)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for r in range(rounds + 1):
        at = [min((far(v, c), k) for k, c in enumerate(centres)) for _, v in kept]
        if r < rounds:
            for k in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == k]
                if own:
                    centres[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, k in at:
        inertia[k] += d
    return sorted(
        ((i is None, i or 0), k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest())
        for (i, _), (d, k) in zip(kept, at, strict=True)
    )


@pytest.mark.parametrize("clusters, rounds", [(5, 3), (1, 2), (400, 1), (16, 0)])
def test_sort_means(spark, clusters, rounds):
    rows = vectors()
    df = sort_means(spark.createDataFrame(rows, VECTORS).repartition(5), clusters=clusters, rounds=rounds, components=4)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in df.collect())
    assert got == brute_clusters(rows, clusters, rounds, 4)


def test_nearest_stops_early_and_misses_no_tie():
    rng = np.random.default_rng(3)
    centres = rng.integers(-40, 40, (40, 3))
    centres[7] = centres[2]  # equal centres: the first wins
    points = np.concatenate((rng.integers(-40, 40, (3000, 3)), centres, (centres[:-1] + centres[1:]) // 2))
    every = ((points[:, None, :] - centres[None]) ** 2).sum(2)
    for before in (np.zeros(len(points), np.int64), every.argmin(1), rng.integers(0, 40, len(points))):
        cluster, distance, computed = nearest(points, before, centres)
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    _, _, computed = nearest(points, every.argmin(1), centres)
    assert computed < every.size / 2


def test_clusters_and_search_of_nothing(spark):
    for rows in ([], [r for r in vectors() if r[1] is None or len(r[1]) == 0]):
        df = spark.createDataFrame(rows, VECTORS)
        assert sort_means(df).collect() == []
        assert top_scores(df.filter("vec_id = 500"), is_query()).collect() == []
    assert top_scores(spark.createDataFrame([], VECTORS), is_query()).collect() == []


def test_components_that_would_overflow_are_errors(spark):
    df = spark.createDataFrame([(20, [3e38] * 64)], "vec_id long, embedding array<float>")
    for f in (lambda: sort_means(df).collect(), lambda: top_scores(df, is_query()).collect()):
        with pytest.raises(Exception, match="a component is"):
            f()


def brute_search(rows, kept):
    there = [(i, whole(v)) for i, v, *_ in rows if usable(v)]
    out = []
    for a, (i, x) in enumerate(there):
        if i is not None and i % 20 == 0:
            found = [(-sum(p * q for p, q in zip(x, y, strict=False)), k is None, k or 0) for b, (k, y) in enumerate(there) if b != a]
            out += [(i, rank, (none, k), -s) for rank, (s, none, k) in enumerate(sorted(found)[:kept], 1)]
    return sorted(out)


@pytest.mark.parametrize("kept, query_block, block", [(20, 3, 7), (1, 100, 1000), (500, 4, 40)])
def test_top_scores(spark, kept, query_block, block):
    rows = vectors()
    df = top_scores(spark.createDataFrame(rows, VECTORS).repartition(3), is_query(), kept=kept, query_block=query_block, block=block)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((q, rank, (v is None, v or 0), s) for q, rank, v, s in df.collect()) == brute_search(rows, kept)


def test_search_of_sparse_and_large_vectors(spark):
    rng = random.Random(2)
    sparse = [(i, [rng.choice([0.0] * 9 + [1000.0, -900.5]) for _ in range(30)]) for i in range(200)]
    large = [(i, [float(rng.randrange(-(10**6), 10**6)) for _ in range(8)]) for i in range(100)]
    for rows in (sparse, large, [(0, [1.0, 2.0])], [(0, [1.0]), (20, [1.0]), (40, [1.0])]):
        df = top_scores(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), is_query())
        assert sorted((q, rank, (False, v), s) for q, rank, v, s in df.collect()) == brute_search(rows, 20)


def test_best_of_takes_the_first_of_equals():
    rng = np.random.default_rng(1)
    for n in (1, 19, 20, 21, 300):
        scores = rng.integers(0, 6, n)
        assert sorted(best_of(scores, 20)) == sorted(sorted(range(n), key=lambda i: (-scores[i], i))[:20])


def brute_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    marked = []
    for i, text, _, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        marked.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {m[0] for m in marked}:
        for order in permutations("ABCDE"):
            left = [m for m in marked if m[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                removed = [m for m in left if name in m[1]]
                redundant = sum(name in m[1] for m in gone)
                left = [m for m in left if name not in m[1]]
                unique = sum(m[0] == part and m[1] == {name} for m in marked)
                shapley[part, name] += len(removed)
                out.append((part, "".join(order), step, name, len(left), len(removed), redundant, unique, sum(m[2] for m in removed), sum(m[3] for m in removed)))
                gone += removed
    return sorted((*x[:3], *x[4:], shapley[x[0], x[3]]) for x in out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    rng = random.Random(4)
    docs = documents()
    for i in range(60):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "a&b", "c#", "ähre", f"w{rng.randrange(500)}"][rng.randrange(3) * 2 :]) for _ in range(rng.choice([3, 49, 50, 90]))]
        docs.append((2000 + i, " ".join(words), "en", rng.choice(["s1", "", None, "s9"]), None) + (None,) * 4)
        if i % 3 == 0:
            docs.append((rng.choice([1, 1999, 3000 + i]), " ".join(words), "en", rng.choice(["s1", None]), None) + (None,) * 4)
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for d in docs if rng.random() < 0.7] + [(None, 1, 1), (99_999, 1, 1), (docs[4][0], 0, 1)]
    label_schema = "doc_id long, quality int, toxic int"
    df = filter_audit(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, label_schema))
    assert sorted(df.columns) == sorted(AUDIT)
    assert sorted(tuple(r) for r in df.select(*AUDIT).collect()) == brute_audit(docs, labels)
    unlabelled = filter_audit(spark.createDataFrame(docs[:8], SCHEMA), spark.createDataFrame([], label_schema))
    assert sorted(tuple(r) for r in unlabelled.select(*AUDIT).collect()) == brute_audit(docs[:8], [])
    assert filter_audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, label_schema)).collect() == []
