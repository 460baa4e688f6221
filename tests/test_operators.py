"""Operators on tiny hand-computed frames."""

from __future__ import annotations

import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import arrays, colour, geometry as g, text
from helixframe.operators import alignment, contacts, curves, forum, linkage, moments, msa, relational, restraints, scoring, selection, store, structures, windows
from helixframe.streaming.rollup import windowed_areas, write_windows

CONTACTS = "a_chain string, a_num int, b_chain string, b_num int, class string, area double"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def linkers(spark):
    data = [(i, x, n) for i, (x, n) in enumerate([("EAAAK", "20"), ("GGS", "40"), ("EKG", "60"), ("AEG", "80"), ("", "100"), ("EK", "x")])]
    return spark.createDataFrame(data, "id long, linker string, length string")


def test_store(spark):
    tf = spark.createDataFrame([(1, "lacI", "E"), (2, "LACi", "E"), (3, "la_X%", "B"), (4, "tetR", "B")], "id long, names string, species string")
    assert rows(store.query(tf, "names", "LAC"), "id") == [(1,), (2,)]
    assert rows(store.query(tf, "Names", "a_x"), "id") == [(3,)]
    assert store.query(tf, "", "").count() == 4
    assert rows(store.query(tf, "species", "B"), "id") == [(3,), (4,)]
    assert rows(store.delete(tf, "species", "E"), "id") == [(3,), (4,)]
    with pytest.raises(ValueError):
        store.query(tf, "names = 1 OR 1", "x")
    more = store.append(tf, spark.createDataFrame([("a", "b"), ("c", "d")], "names string, species string"), "id")
    assert rows(more, "id") == [(1,), (2,), (3,), (4,), (5,), (6,)]
    status, added = store.dispatch(tf, "add", {"col_name": ["names", "species"], "content": [["n", "s"]]})
    assert (status, added.count()) == (0, 5)
    assert store.dispatch(tf, "drop", {})[0] == -1
    assert rows(store.dispatch(tf, "query", {"col_name": "species", "content": "E"})[1]) == [("LACi", "E"), ("lacI", "E")]
    assert store.summary_columns(["AA", "AA_diff", "AW", "SS_ref", "MM"]) == ["AA", "MM"]
    nulls = spark.createDataFrame([(1, None), (2, "x")], "id long, names string")
    assert rows(store.delete(nulls, "names", "x"), "id") == [(1,)]


def test_linker_query(spark):
    df = linkers(spark)
    assert rows(store.linker_query(df, "small"), "id") == [(0,), (1,)]
    assert rows(store.linker_query(df, "large"), "id") == rows(store.linker_query(df, "middle"), "id") == [(1,), (2,)]
    assert rows(store.linker_query(df, "large", strict=True), "id") == [(2,), (3,)]
    assert rows(store.linker_query(df, "very_large", "A", "all"), "id") == [(3,)]
    assert store.linker_query(df, "no such size").count() == 0
    assert rows(store.dispatch(df, "Cquery", {"size": "middle", "N": "E", "C": "G"})[1]) == [("EKG", "60")]


def test_forum(spark):
    topics = spark.createDataFrame([(1, "Alpha", "x", 0), (2, "b", "has ALPHA", 1), (3, "c", "none", 2), (4, "alphabet", "y", 2)], "id long, title string, content string, type int")
    assert rows(forum.search(topics, forum.visible(topics, False), "alpha"), "id") == [(1,), (4,)]
    assert rows(forum.search(topics, forum.visible(topics, True), "alpha"), "id") == [(1,), (2,), (4,)]
    comments = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (6, 5), (7, 6), (8, 7)], "id long, ansto_id long")
    assert rows(forum.threads(comments), "id", "root", "depth") == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4)]
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1), (5, None), (6, 5)], "id long, ansto_id long")
    assert rows(forum.threads(ring), "id", "root", "depth") == [(1, None, None), (2, None, None), (3, None, None), (4, None, None), (5, 5, 0), (6, 5, 1)]
    left = forum.cascade(topics.filter("id <> 2"), spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, topic_id long"), "id", "topic_id")
    assert rows(left, "id") == [(10,), (12,)]

    assert rows(forum.owned(spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, owner_id long"), 7), "id") == [(1,)]
    assert rows(forum.replies_of(spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, topic_id long"), 8), "id") == [(2,)]


def test_forum_changes(spark):
    users = spark.createDataFrame([(1, "Researcher"), (2, "Student"), (3, None)], "owner_id long, job_title string")
    schema = "id long, owner_id long, type int, title string"
    topics = spark.createDataFrame([(1, 1, 1, "private"), (2, 2, 0, "open")], schema)
    new = spark.createDataFrame([(10, 1, 1, "a"), (11, 2, 1, "b"), (12, 2, 2, "c"), (13, 9, 0, "d"), (14, 1, None, "e"), (15, 3, 1, "f")], schema)
    kept, refused = forum.created_topics(topics, new, users)
    assert (rows(kept, "id"), rows(refused, "id")) == ([(1,), (10,), (12,), (2,)], [(11,), (13,), (14,), (15,)])
    comments = spark.createDataFrame([(1, 2, 2)], "id long, owner_id long, topic_id long")
    more = spark.createDataFrame([(2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 1, 99), (6, None, 2)], "id long, owner_id long, topic_id long")
    kept, refused = forum.created_replies(comments, more, topics, users)
    assert (rows(kept, "id"), rows(refused, "id")) == ([(1,), (2,), (4,)], [(3,), (5,), (6,)])
    changes = spark.createDataFrame([(1, 2, "x"), (2, 2, "y"), (9, 1, "z")], "id long, user_id long, title string")
    changed, refused = forum.updated_topics(topics, changes, users)
    assert (rows(changed, "id", "title"), rows(refused, "id")) == ([(1, "private"), (2, "y")], [(1,), (9,)])
    left, refused = forum.destroyed(topics, spark.createDataFrame([(1, 2), (2, 2), (9, 1)], "id long, user_id long"))
    assert (rows(left, "id"), rows(refused, "id")) == ([(1,)], [(1,), (9,)])


def test_intervals():
    assert relational.parse_intervals("(A1-A9,B3)(C)(3-8)") == [(0, "A", 1, 9), (0, "B", 3, 3), (1, "C", relational.INT_MIN, relational.INT_MAX), (2, "?", 3, 8)]
    for bad in ("(A1-B2)", "()", "A1", "(A1", "(A-)", "(1-A2)"):
        with pytest.raises(ValueError):
            relational.parse_intervals(bad)


def test_merge(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, area double")
    b = spark.createDataFrame([("y", 3.0), ("z", 4.0)], "k string, area double")
    expected = [("x", 1.0, 0.0), ("y", 2.0, 3.0), ("z", 0.0, 4.0)]
    assert rows(relational.merge_by_tag(a, b, ["k"], "area", ("t", "m")), "k", "t", "m") == expected
    outer = relational.full_outer_merge(a.withColumnRenamed("area", "t"), b.withColumnRenamed("area", "m"), ["k"], {"t": 0.0, "m": 0.0})
    assert rows(outer, "k", "t", "m") == expected
    assert rows(relational.ratio_zip(a, a, ["k"], "area"), "k", "area") == [("x", 1.0), ("y", 1.0)]
    assert relational.ratio_zip(a, b, ["k"], "area").count() == 0


def test_contacts(spark):
    data = [("A", 1, "A", 1, "AW", 5.0), ("A", 1, "A", 2, "AA", 3.0), ("A", 2, "B", 1, "AA", 4.0), ("B", 1, "A", 2, "SS", 1.0), ("A", 3, "A", 2, "AA", 2.0), ("A", 2, "A", 2, "MW", 9.0)]
    df = spark.createDataFrame(data, CONTACTS)
    assert rows(contacts.core(df), "area") == [(1.0,), (2.0,), (4.0,), (9.0,)]
    assert rows(contacts.interface_zone(df), "area") == [(1.0,), (4.0,), (9.0,)]
    assert rows(contacts.with_reflexive(contacts.inter_chain(df), df), "area") == [(1.0,), (4.0,), (9.0,)]
    assert rows(contacts.summary(df)) == [("all_AA", 9.0), ("all_MW", 9.0), ("all_SS", 1.0), ("inter_chain_A_B_AA", 4.0), ("inter_chain_B_A_SS", 1.0), ("sas", 5.0)]
    assert ("A", 2, "A", 2, "AA_exposed_to_B", 4.0) in rows(contacts.exposure(df))
    assert ("A00002", "B00001", 400) in rows(contacts.graph_edges(df))
    only = contacts.accepted_contacts(df, "inter_interval", intervals=relational.parse_intervals("(B)"))
    assert rows(only, "area") == [(1.0,), (4.0,)]
    assert rows(contacts.filtered(df, core_only=True, across=True), "area") == [(1.0,), (4.0,)]


def test_contact_classes(spark):
    atoms = spark.createDataFrame([(0, "A", 1, "C", True), (1, "A", 2, "N", True), (2, "A", 2, "CB", False), (3, "A", 3, "CA", True)], "atom_idx int, chain string, num int, name string, main boolean")
    pairs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 2, 4.0), (0, 2, 8.0), (2, 3, 16.0), (0, 3, 32.0)], "a int, b int, area double")
    got = rows(contacts.residue_contacts(pairs, atoms), "a_num", "b_num", "class", "area")
    assert got == sorted(
        [(1, 1, "AW", 1.0), (1, 1, "MW", 1.0), *[(1, 2, c, 8.0) for c in ("AA", "AS", "MA", "MS")], *[(2, 3, c, 16.0) for c in ("AA", "AM", "SA", "SM")], *[(1, 3, c, 32.0) for c in ("AA", "AM", "MA", "MM")]],
        key=str,
    )


def test_scores(spark):
    target = spark.createDataFrame([("A", 1, "A", 2, "AA", 10.0), ("A", 1, "A", 2, "SS", 4.0)], CONTACTS)
    model = spark.createDataFrame([("A", 1, "A", 2, "AA", 7.0), ("A", 1, "A", 2, "AS", 2.0)], CONTACTS)
    merged = contacts.combined(target, model)
    assert rows(scoring.profile(merged), "class", "difference", "reference") == [("AA", 3.0, 10.0), ("AS", 0.0, 0.0), ("SS", 4.0, 4.0)]
    assert rows(scoring.global_scores(scoring.profile(merged)), "class", "score") == [("AA", 0.7), ("AS", 0.0), ("SS", 0.0)]
    same = scoring.global_scores(scoring.profile(contacts.combined(target, target)))
    assert {r["score"] for r in same.collect()} == {1.0}
    residues = spark.createDataFrame([("A", 1), ("A", 2)], "chain string, num int")
    assert ("A", 2, None, 0.0, 0.0) in rows(scoring.profile(merged, residues=residues), "chain", "num", "class", "difference", "reference")
    assert rows(contacts.combined(target, model, binarize=True), "class", "t_area", "m_area") == [("AA", 1.0, 1.0), ("AS", 0.0, 1.0), ("SS", 1.0, 0.0)]


def local_by_loop(data):
    """(chain, num) -> value, in the order of keys."""
    out, last = {}, None
    for (chain, num), value in sorted(data.items()):
        if last is not None and last[0] == chain:
            for k in range(last[1] + 1, num):
                out.setdefault((chain, k), -1.0)
        elif last is not None:
            out.setdefault((chain, 0), -2.0)
        out.setdefault((chain, num), value)
        last = (chain, num)
    return out


def blur_by_loop(scores, w):
    keys, out = sorted(scores), {}
    for i, k in enumerate(keys):
        if scores[k] < 0:
            out[k] = scores[k]
            continue
        total = scores[k]
        for way in (-1, 1):
            held = scores[k]
            for step in range(1, w + 1):
                j = i + way * step
                if 0 <= j < len(keys) and keys[j][0] == k[0] and abs(keys[j][1] - k[1]) <= w and scores[keys[j]] > 0:
                    held = scores[keys[j]]
                total += held
        out[k] = total / (1 + 2 * w)
    return out


@pytest.mark.parametrize("width", [0, 1, 3])
def test_local_scores_and_blur(spark, width):
    random.seed(width)
    data = {}
    for chain in "ABC":
        for num in range(-2 if chain == "C" else 0, 25):
            if random.random() < 0.7:
                data[chain, num] = (random.choice([0.0, 1.5, 2.0, 3.25]), random.choice([0.0, 4.0, 5.0]))
    frame = spark.createDataFrame([(*k, *v) for k, v in data.items()], "chain string, num int, difference double, reference double")
    values = {k: d / r if r > 0 else -3.0 for k, (d, r) in data.items()}
    expected = local_by_loop(values)
    local = scoring.local_scores(frame)
    assert {(r["chain"], r["num"]): r["score"] for r in local.collect()} == expected
    smooth = {(r["chain"], r["num"]): r["score"] for r in scoring.blurred(local, width).collect()}
    for k, v in blur_by_loop(expected, width).items():
        assert math.isclose(smooth[k], v, abs_tol=1e-12)


def test_windows(spark):
    chain = spark.createDataFrame([("A", i) for i in range(50)], "chain string, num int")
    cut = windows.chopped_ends(chain)
    assert sum(r["share"] == 24 for r in cut.collect()) == 26
    assert windows.chopped_ends(chain.filter("num < 39")).count() == 0
    ranked = structures.lowest_share(spark.createDataFrame([(i, float(-i)) for i in range(13)], "num int, v double"), "v", "num")
    assert rows(ranked, "num") == [(10,), (11,), (12,)]
    even = structures.lowest_share(spark.createDataFrame([(i, float(i)) for i in range(5)], "num int, v double"), "v", "num", 0.5)
    assert even.count() == 2
    lengths = spark.createDataFrame([(1, 10), (2, 3)], "k int, length int")
    cover = {(r["k"], r["pos"]): r["cover"] for r in windows.window_cover(lengths, ["k"], sizes=(4,)).collect()}
    listed = {}
    for r in windows.sliding_windows(lengths, sizes=(4,)).collect():
        for p in range(r["first"], min(r["first"] + 4, r["length"])):
            listed[r["k"], p] = listed.get((r["k"], p), 0) + 1
    assert cover == listed
    values = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0]
    smooth = [r["v"] for r in windows.hanning(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v", "i").orderBy("i").collect()]
    padded = [values[0]] * 6 + values + [values[-1]] * 6
    weights = np.hanning(13) / np.hanning(13).sum()
    assert np.allclose(smooth, np.convolve(padded, weights, "valid"))


def test_collisions(spark):
    data = [(0, "A", 1, "CYS", "SG", (0.0, 0.0, 0.0), 1.0), (1, "A", 9, "CYS", "SG", (1.0, 0.0, 0.0), 1.0), (2, "B", 2, "GLY", "CA", (1.5, 0.0, 0.0), 1.0), (3, "B", 3, "GLY", "CA", (40.0, 0.0, 0.0), 1.0), (4, "C", 1, "GLY", "C", (-1.2, 0.0, 0.0), 1.0), (5, "C", 2, "GLY", "N", (-2.4, 0.0, 0.0), 1.0)]
    atoms = spark.createDataFrame(data, "atom_idx int, chain string, num int, resname string, name string, p struct<x:double,y:double,z:double>, r double")
    assert rows(structures.clashes(atoms, 1.0), "i", "j") == [(0, 2), (0, 4), (1, 2)]
    assert rows(structures.touching_chains(atoms, 1.0)) == [("A", "B"), ("A", "C"), ("B", "C")]
    assert rows(structures.touching_chains(atoms, 1.0, 0.0)) == [("A", "B"), ("A", "C")]
    random.seed(1)
    cloud = spark.createDataFrame([(i, tuple(random.uniform(-3, 3) for _ in "xyz")) for i in range(150)], "idx int, p struct<x:double,y:double,z:double>")
    points = {r["idx"]: np.array(r["p"]) for r in cloud.collect()}
    expected = sorted((i, j) for i, j in itertools.product(points, points) if np.linalg.norm(points[i] - points[j]) <= 0.9)
    found = relational.range_join(cloud, cloud, 0.9).select(F.col("l.idx").alias("i"), F.col("r.idx").alias("j"))
    assert sorted(map(tuple, found.collect())) == expected
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_geometry(spark):
    df = spark.range(1)
    p = [g.point(*[F.lit(float(v)) for v in c]) for c in ((1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1))]
    r = df.select(
        g.angle(p[0], p[1], p[2]).alias("angle"), g.dihedral(*p).alias("dihedral"), g.triangle_area(*p[:3]).alias("area"), g.tetrahedron_volume(*p).alias("volume"),
        g.spherical_triangle_area(p[0], p[2], g.point(F.lit(0.0), F.lit(0.0), F.lit(1.0)), 2).alias("cap"), g.rotated(p[0], g.point(F.lit(0.0), F.lit(0.0), F.lit(2.0)), F.lit(math.pi / 2)).alias("turned"),
        g.quadratic_roots(F.lit(1.0), F.lit(-3.0), F.lit(2.0)).alias("roots"), g.quadratic_roots(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("none"), g.line_distance(p[3], p[1], p[0]).alias("line"),
        g.halfspace(p[2], p[1], p[2]).alias("side"), g.unit(p[1]).alias("zero"),
    ).first()
    assert math.isclose(r["angle"], math.pi / 2)
    assert math.isclose(abs(r["dihedral"]), math.pi / 2)
    assert r["area"] == 0.5
    assert math.isclose(abs(r["volume"]), 1 / 6)
    assert math.isclose(r["cap"], 4 * math.pi * 4 / 8)
    assert math.isclose(r["turned"]["y"], 1.0)
    assert r["roots"] == [1.0, 2.0]
    assert r["none"] == []
    assert math.isclose(r["line"], math.sqrt(2))
    assert r["side"] == 1
    assert r["zero"] is None


def test_text_and_arrays(spark):
    df = spark.createDataFrame([("TRP124", "O1P", "C5*", "a/b/x.pdb", [1.0, 2.0, 3.0, 4.0])], "label string, o string, c string, path string, v array<double>")
    r = df.select(
        text.digits_of(F.col("label")).alias("n"), text.canonical_atom(F.col("o")).alias("o"), text.canonical_atom(F.col("c")).alias("c"), text.file_stem(F.col("path")).alias("stem"),
        text.one_letter(F.lit("trp")).alias("w"), text.three_letters(F.lit("W")).alias("trp"), text.residue_code(F.lit("-")).alias("gap"), text.residue_code(F.lit("Z")).alias("z"), text.residue_code(F.lit("R")).alias("r"),
        arrays.rolled(F.col("v")).alias("rolled"), arrays.padded_mirror(F.col("v")).alias("mirror"), arrays.mass(F.col("v"), 1, 3).alias("mass"), arrays.digitized(F.lit(3.0), 2.5, 20.0, 35).alias("bin"),
        text.found_at(F.lit("aXb"), F.lit("XXcab")).alias("at"), text.found_at(F.lit("q"), F.lit("abc")).alias("no"),
    ).first()
    assert (r["n"], r["o"], r["c"], r["stem"], r["w"], r["trp"], r["gap"], r["z"], r["r"]) == (124, "OP1", "C5'", "x", "W", "TRP", 20, 20, 1)
    assert r["rolled"] == [4.0, 1.0, 2.0, 3.0]
    assert r["mirror"] == [2.0, 1.0, 1.0, 2.0, 3.0, 4.0, 4.0, 3.0]
    assert (r["mass"], r["bin"], r["at"], r["no"]) == (5.0, 2, 1, -1)
    noisy = [0.0, 1.0, 8.0, 27.0, 64.0, 125.0, 216.0, 343.0]
    smooth = spark.createDataFrame([(noisy,)], "v array<double>").select(arrays.savitzky_golay(F.col("v")).alias("s")).first()["s"]
    assert np.allclose(smooth, noisy)
    assert spark.range(1).select(colour.blue_white_red(F.lit(0.5)).alias("c")).first()["c"] == 0xFFFFFF


def slow_couplings(seqs, states="ARNDCQEGHILKMFPSTWYV-"):
    """Covariance term by term, norms over the twenty letters, average product correction."""
    length = len(seqs[0])
    code = [[states.index(c) if c in states else 20 for c in s] for s in seqs]
    weights = [1 / sum(sum(x == y for x, y in zip(a, b, strict=True)) > 0.8 * length for b in code) for a in code]
    points = sum(weights) - math.sqrt(sum(weights) / len(weights))
    columns = [(p, s) for p in range(length) for s in range(21)]
    mean = {c: sum(w for w, row in zip(weights, code, strict=True) if row[c[0]] == c[1]) / points for c in columns}
    rows_ = [[(float(row[p] == s) - mean[p, s]) for p, s in columns] for row in code]
    covariance = [[sum(w * r[x] * r[y] for w, r in zip(weights, rows_, strict=True)) / points for y in range(len(columns))] for x in range(len(columns))]
    for x in range(len(columns)):
        covariance[x][x] += 4.5 / math.sqrt(sum(weights))
    inverse = np.linalg.inv(np.array(covariance))
    norm = [[0.0] * length for _ in range(length)]
    for i in range(length):
        for j in range(length):
            if i != j:
                norm[i][j] = math.sqrt(sum(inverse[21 * i + a][21 * j + b] ** 2 for a in range(20) for b in range(20)))
    total, by_row = sum(map(sum, norm)), [sum(r) for r in norm]
    return [[norm[i][j] - by_row[i] * by_row[j] / total if i != j else 0.0 for j in range(length)] for i in range(length)]


def test_window_pairs(spark):
    found = windows.window_pairs(spark.createDataFrame([(n,) for n in (15, 16, 21, 40)], "length int"), sizes=(8,), shift=4)
    expected = []
    for n in (16, 21, 40):
        starts = list(range(0, n - 8, 4))
        reach = [8] * len(starts)
        reach[-1] = n - starts[-1]
        expected += [(n, starts[i], starts[j], reach[i], reach[j]) for i in range(len(starts)) for j in range(i + 2, len(starts))]
    assert rows(found, "length", "i", "j", "i_length", "j_length") == sorted(expected, key=str)


def test_molecule_classes(spark):
    data = [("A", 1, i, n, "GLY") for i, n in enumerate(["CA"])] + [("A", 2, i, "P", "U") for i in range(2)]
    data += [("A", 3, i, n, "UNK") for i, n in enumerate(["N", "CA", "C"])] + [("A", 4, i, n, "UNK") for i, n in enumerate(["N", "CA", "CA"])]
    data += [("A", 5, i, n, "XNA") for i, n in enumerate(["P", "O1P", "O2P", "O5*", "C5'", "C4'", "O4'", "C3'", "O3'", "C2'", "O2'"])]
    data += [("A", 6, 0, "N", "UNK"), ("A", 6, 1, "CB", "GLY"), ("A", 7, 0, "X", None)]
    found = structures.molecule_classes(spark.createDataFrame(data, "chain string, num int, atom_idx int, name string, resname string"))
    assert rows(found.select("num", "molecule_class").distinct(), "num", "molecule_class") == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 2), (6, 0), (7, 0)]


def walked_chains(nodes, right):
    """Chains walked one after another from the residues that no bond leads to."""
    found, visited = {i: (None, None) for i in nodes}, set()
    for root in sorted(set(nodes) - set(right.values())):
        at, depth = root, 0
        while at is not None and at not in visited:
            visited.add(at)
            found[at] = (root, depth)
            at, depth = right.get(at), depth + 1
    return found


def test_chains_of_bonds(spark):
    #  two bonds into 5, and a start with a bond into a chain that a later number began
    cases = [(range(1, 8), {1: 5, 3: 5, 5: 6}), (range(8), {7: 3, 3: 4, 2: 7, 1: 6, 6: 4}), (range(6), {0: 1, 1: 2, 2: 1, 3: 4, 4: 3})]
    generator = random.Random(5)
    cases.append((range(60), {i: generator.randrange(60) for i in generator.sample(range(60), 45)}))
    for nodes, right in cases:
        links = spark.createDataFrame(list(right.items()), "from long, to long")
        found = structures.topological_order(links, spark.createDataFrame([(i,) for i in nodes], "idx long")).collect()
        assert {r["idx"]: (r["root"], r["depth"]) for r in found} == walked_chains(nodes, right)


def test_chains_of_atoms(spark):
    data = []
    for chain, num, x in [("A", 1, 0.0), ("A", 2, 4.0), ("B", 7, 8.0), ("C", 1, 50.0)]:  # A 1, A 2 and B 7 are bonded
        data += [(chain, num, "GLY", "N", (x, 0.0, 0.0)), (chain, num, "GLY", "C", (x + 2.6, 0.0, 0.0)), (chain, num, "GLY", "CA", (x + 1.0, 1.0, 0.0))]
    for num in (1, 2):
        data += [("R", num, "G", "P", (100.0 + 5 * num, 0.0, 0.0)), ("R", num, "G", "O3*", (103.6 + 5 * num, 0.0, 0.0))]
    data += [("W", 1, "HOH", "N", (200.0, 0.0, 0.0))]
    atoms = spark.createDataFrame([(i, *a) for i, a in enumerate(data)], "atom_idx long, chain string, num int, resname string, name string, p struct<x:double,y:double,z:double>")
    protein = structures.residue_chains(atoms)
    assert rows(protein, "chain", "num", "root", "depth") == [("A", 1, 0, 0), ("A", 2, 0, 1), ("B", 7, 0, 2), ("C", 1, 3, 0)]
    assert rows(structures.residue_chains(atoms, "nucleic"), "chain", "num", "root", "depth") == [("R", 1, 0, 0), ("R", 2, 0, 1)]
    lettered = structures.relettered(atoms, protein)
    assert rows(lettered.select("chain").distinct()) == [("A",), ("B",), ("R",), ("W",)]
    assert lettered.filter("chain = 'A'").count() == 9
    many = spark.createDataFrame([("A", i, i) for i in range(27)], "chain string, num int, root long")
    with pytest.raises(ValueError):
        structures.relettered(atoms, many)


def test_all_residue_distances(spark):
    data = [(i, "A", i // 2, (float(3 * i), 0.0, 0.0), 1.0) for i in range(6)]
    atoms = spark.createDataFrame(data, "atom_idx int, chain string, num int, p struct<x:double,y:double,z:double>, r double")
    gaps = {(r["a_num"], r["b_num"]): r["gap"] for r in structures.min_residue_distance(atoms, None, 1.0).collect()}
    assert gaps == {(a, b): min(abs(3.0 * i - 3.0 * j) - 2 for i in (2 * a, 2 * a + 1) for j in (2 * b, 2 * b + 1)) for a in range(3) for b in range(3) if a != b}


def test_earlier_rows(spark):
    generator = random.Random(2)
    data = [(generator.choice(["a", "a", "a", "b", None]), i, generator.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, v int, size long").repartition(5)
    for keys in ([], ["k"]):
        found = relational.with_earlier(df, ["v"], "before", F.col("size"), keys, "total").collect()
        assert len(found) == 200
        for r in found:
            same = [x for x in data if not keys or x[0] == r["k"]]
            assert (r["before"], r["total"]) == (sum(x[2] for x in same if x[1] < r["v"]), sum(x[2] for x in same))
    assert relational.with_earlier(df.filter("v < 0"), ["v"], "before").count() == 0


def test_msa(spark):
    seqs = ["ACDEFGHI", "ACDEFGHI", "ACDEFGHK", "--------", "ZCDEKKKK"]
    long = msa.encoded(spark.createDataFrame(list(enumerate(seqs)), "seq int, aligned string"))
    weights = {r["seq"]: r["weight"] for r in msa.sequence_weights(long).collect()}
    assert weights == {0: 1 / 3, 1: 1 / 3, 2: 1 / 3, 3: 1.0, 4: 1.0}
    long_rows = {i: s for i, s in enumerate("".join(random.Random(i // 4).choices("ACDE-", k=12)) for i in range(40))}
    many = msa.encoded(spark.createDataFrame(list(long_rows.items()), "seq int, aligned string"))
    expected = {i: 1 / sum(sum(x == y for x, y in zip(s, t)) > 0.8 * 12 for t in long_rows.values()) for i, s in long_rows.items()}
    for block in (3, 16, 1024):
        assert {r["seq"]: r["weight"] for r in msa.sequence_weights(many, block_rows=block).collect()} == expected
    keyed = many.withColumn("k", F.col("seq") % 2)
    halves = {r["seq"]: r["weight"] for r in msa.sequence_weights(keyed, keys=["k"], block_rows=4).collect()}
    assert halves == {i: 1 / sum(sum(x == y for x, y in zip(s, long_rows[j])) > 0.8 * 12 for j in long_rows if j % 2 == i % 2) for i, s in long_rows.items()}
    profile = msa.profile(long, msa.sequence_weights(long))
    sums = profile.groupBy("pos").agg(F.sum("f").alias("s")).collect()
    assert all(math.isclose(r["s"], 1 + 21e-9) for r in sums)
    assert profile.count() == 8 * 21
    assert rows(msa.covered(long).select("seq").distinct()) == [(0,), (1,), (2,), (4,)]
    scores = msa.couplings(spark.createDataFrame([(1, s) for s in seqs] + [(2, "ACD")], "m int, aligned string"), "m")
    found = {(r["m"], r["i"], r["j"]): r["score"] for r in scores.collect()}
    assert len(found) == 28 + 3
    expected = slow_couplings(seqs)
    assert all(math.isclose(found[1, i, j], expected[i][j], abs_tol=1e-9) for i in range(8) for j in range(i + 1, 8))
    choice = spark.createDataFrame([("t", 1e-30, 10, 6000), ("t", 1e-10, 3000, 9000), ("u", 1e-30, 1, 1), ("u", 1e-3, 2, 2)], "t string, e_value double, n75 int, n50 int")
    assert rows(msa.coverage_choice(choice, ["t"]), "t", "e_value", "coverage") == [("t", 1e-30, 50), ("u", 1e-3, 50)]


def test_moments_merge(spark):
    """Any blocks, chunks and partitions give the sums of one pass; places without a code have no state."""
    rng = random.Random(12)
    data = [(k, i, p, rng.randrange(21)) for k in range(2) for i in range(60) for p in range(23 - 9 * k) if rng.random() < 0.9]
    weights = [(k, i, rng.random()) for k in range(2) for i in range(60) if i != 7]
    long = spark.createDataFrame(data, "k int, seq int, pos int, code int")
    weighted = spark.createDataFrame(weights, "k int, seq int, weight double")
    w, want = {(k, i): x for k, i, x in weights}, {}
    by_seq = {}
    for k, i, p, c in data:
        by_seq.setdefault((k, i), []).append((p, c))
    for (k, i), places in by_seq.items():
        for (p, a), (q, b) in itertools.product(places, places):
            want[k, p, a, q, b] = want.get((k, p, a, q, b), 0) + w.get((k, i), 0)
    for block, chunk, together, parts in ((32, 4096, 16, 1), (5, 7, 2, 5), (4, 1, 3, 3)):
        found = moments.column_moments(long.repartition(parts), weighted, ["k"], block=block, chunk=chunk, together=together).collect()
        assert len({(r["k"], r["i_block"], r["j_block"]) for r in found}) == len(found)
        for k in range(2):
            whole = moments.assembled([r.asDict() for r in found if r["k"] == k], block).reshape(23 - 9 * k, 21, 23 - 9 * k, 21)
            for p, a, q, b in zip(*np.nonzero(whole)):
                assert math.isclose(whole[p, a, q, b], want[k, p, a, q, b])
            assert sum(v > 0 for (own, *_), v in want.items() if own == k) == np.count_nonzero(whole)
    entropies = {(r["k"], r["i"], r["j"]): (r["h"], r["gaps"]) for r in msa.pair_entropy(long, weighted, ["k"]).collect()}
    for (k, i, j), (h, gaps) in entropies.items():
        v = [x for (own, p, _, q, _), x in want.items() if (own, p, q) == (k, i, j) and x > 0]
        assert i < j and math.isclose(h, -sum(x / sum(v) * math.log(x / sum(v)) for x in v), abs_tol=1e-9) and math.isclose(gaps, want.get((k, i, 20, j, 20), 0) / sum(v), abs_tol=1e-12)
    assert len(entropies) == 23 * 11 + 7 * 13
    assert moments.column_moments(long.limit(0), weighted, ["k"]).count() == 0


def test_ranks_of_one_group(spark):
    df = spark.createDataFrame([(i % 2, (i * 37) % 101, f"r{i}") for i in range(101)], "k int, o int, name string").repartition(5)
    assert rows(msa.first_rows(df, 10, "o").select("o")) == [(i,) for i in range(10)]
    assert msa.first_rows(df, 7, "o", ["k"]).groupBy("k").count().collect() and {r["count"] for r in msa.first_rows(df, 7, "o", ["k"]).groupBy("k").count().collect()} == {7}


def test_pair_table(spark):
    msas = {1: ["ACDE", "ACDK", "AKDE", "A-DV", "ACDE"], 2: ["ACD"]}
    data = [(m, i, s) for m, seqs in msas.items() for i, s in enumerate(seqs)]
    df = spark.createDataFrame(data, "m int, seq int, aligned string")
    long = msa.encoded(df, keys=["m"])
    rates = spark.createDataFrame([(1, 2, 0.25)], "m int, pos int, rate double")
    columns = msa.column_features(long, msa.sequence_weights(long, keys=["m"]), rates, ["m"])
    found = {(r["m"], r["i"], r["j"]): r["inputs"] for r in msa.pair_table(columns, msa.pair_inputs(df, "m"), "m").collect()}
    assert set(found) == {(1, i, j) for i in range(4) for j in range(4)} | {(2, i, j) for i in range(3) for j in range(3)}
    states = "ARNDCQEGHILKMFPSTWYV-"
    for m, seqs in msas.items():
        w = [1 / sum(sum(x == y for x, y in zip(s, t)) > 0.8 * len(s) for t in seqs) for s in seqs]
        scores = slow_couplings(seqs) if len(seqs) > 1 else None
        for i, j in itertools.product(range(len(seqs[0])), repeat=2):
            values = found[m, i, j]
            assert len(values) == 533
            for k, side in ((i, values[:44]), (j, values[44:88])):
                f = [sum(x for x, s in zip(w, seqs) if s[k] == c) / sum(w) + 1e-9 for c in states]
                expected = [float(seqs[0][k] == c) for c in states[:20]] + f + [-sum(x * math.log(x) for x in f)]
                expected += [math.log(sum(x for x, s in zip(w, seqs) if s[k] != "-")), 0.25 if (m, k) == (1, 2) else 0.0]
                assert np.allclose(side, expected)
            both = {}
            for x, s in zip(w, seqs):
                both[s[i], s[j]] = both.get((s[i], s[j]), 0) + x / sum(w)
            h = -sum((v := both.get((a, b), 0) + 1e-9) * math.log(v) for a in states for b in states)
            if len(seqs) > 1:
                assert np.allclose(values[529:532], [scores[min(i, j)][max(i, j)] if i != j else 0, h, both.get(("-", "-"), 0) + 1e-9], atol=1e-5)
                assert np.allclose(np.reshape(values[88:529], (21, 21)), np.reshape(found[m, j, i][88:529], (21, 21)).T, atol=1e-5)
            else:
                assert not any(values[88:532])
            assert math.isclose(values[532], math.log(abs(i - j) + 1), abs_tol=1e-12)


def full_tables(a: str, b: str, match: int = 10, mismatch: int = -10, start: int = -20, extend: int = -1, local: bool = False) -> tuple[int, list[tuple[int, int]]]:
    """The same alignment from three whole tables of scores."""
    n, m, low = len(a), len(b), -(10**9)
    best, ins, dele = (np.full((n + 1, m + 1), low, np.int64) for _ in range(3))
    edge = [0, *(0 if local else start + k * extend for k in range(max(n, m)))]
    best[:, 0], best[0, :] = edge[: n + 1], edge[: m + 1]
    dele[1:, 0], ins[0, 1:] = best[1:, 0], best[0, 1:]
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    flat_best, flat_ins, flat_dele = best.ravel(), ins.ravel(), dele.ravel()
    #  an anti-diagonal at a time: i + j = d lies at places i * m + d of the flat tables, m apart
    for d in range(2, n + m + 1) if n and m else ():
        i, last = max(1, d - m), min(n, d - 1)

        def along(row: int, diagonal: int, count: int = last - i + 1) -> slice:
            return slice(row * m + diagonal, (row + count - 1) * m + diagonal + 1, m)

        here, left, up = along(i, d), along(i, d - 1), along(i - 1, d - 1)
        flat_ins[here] = np.maximum(flat_best[left] + start, flat_ins[left] + extend)
        flat_dele[here] = np.maximum(flat_best[up] + start, flat_dele[up] + extend)
        equal = x[i - 1 : last] == y[d - last - 1 : d - i][::-1]
        score = np.maximum(np.maximum(flat_ins[here], flat_dele[here]), flat_best[along(i - 1, d - 2)] + np.where(equal, match, mismatch))
        flat_best[here] = np.maximum(score, 0) if local else score
    i, j = (int(x) for x in np.unravel_index(np.argmax(best), best.shape)) if local else (n, m)
    score, pairs = int(best[i, j]), []
    while i > 0 or j > 0:
        if local and best[i, j] == 0:
            break
        if j > 0 and (i == 0 or best[i, j] == ins[i, j]):
            pairs.append((-1, j - 1))
            while j > 1 and ins[i, j] == ins[i, j - 1] + extend and ins[i, j] != best[i, j - 1] + start:
                j -= 1
                pairs.append((-1, j - 1))
            j -= 1
        elif i > 0 and (j == 0 or best[i, j] == dele[i, j]):
            pairs.append((i - 1, -1))
            while i > 1 and dele[i, j] == dele[i - 1, j] + extend and dele[i, j] != best[i - 1, j] + start:
                i -= 1
                pairs.append((i - 1, -1))
            i -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return score, pairs[::-1]


@pytest.mark.parametrize("kept_cells", [1 << 24, 40, 1])
def test_alignment_keeps_few_rows(monkeypatch, kept_cells):
    monkeypatch.setattr(alignment, "KEPT_CELLS", kept_cells)
    rng = random.Random(5)
    kinds = ({}, {"local": True}, {"start": -3, "match": 2, "mismatch": -1}, {"start": -1, "match": 1, "mismatch": -1}, {"start": -2, "extend": 0, "match": 1, "mismatch": 0, "local": True})
    for t in range(250):
        a, b = ("".join(rng.choice(("AC", "ACDE")[t % 2]) for _ in range(rng.randrange(0, 26))) for _ in range(2))
        for scoring in kinds:
            assert alignment.align_pair(a, b, **scoring) == full_tables(a, b, **scoring)
    with pytest.raises(ValueError, match="cheaper"):
        alignment.align_pair("A", "C", start=0, extend=-1)


def test_alignment_in_little_memory(monkeypatch):
    """8,000 letters each: a table of one byte a pair would take 64 MB."""
    monkeypatch.setattr(alignment, "KEPT_CELLS", 1 << 20)
    rng = random.Random(1)
    a = "".join(rng.choice("ACDEFGHIKL") for _ in range(8000))
    tracemalloc.start()
    score, places = alignment.align_pair(a, a[:3000] + a[5000:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and score == 6000 * 10 - 20 - 1999 and len(places) == 8000


def slow_best(a, b, start, extend, local):
    """The best score by trying every gap length at every cell."""
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = [0] if local or i == j == 0 else []
            if i and j:
                options.append(best[i - 1, j - 1] + (10 if a[i - 1] == b[j - 1] else -10))
            options += [best[i - k, j] + start + (k - 1) * extend for k in range(1, i + 1)]
            options += [best[i, j - k] + start + (k - 1) * extend for k in range(1, j + 1)]
            best[i, j] = max(options)
    return max(best.values()) if local else best[len(a), len(b)]


def test_alignment_scores():
    generator = random.Random(3)
    for _ in range(150):
        a, b = ("".join(generator.choices("ACDé", k=generator.randrange(9))) for _ in "ab")
        start, extend, local = generator.choice([-20, -4]), generator.choice([-1, -3]), generator.random() < 0.5
        score, pairs = alignment.align_pair(a, b, start=start, extend=extend, local=local)
        assert score == slow_best(a, b, start, extend, local)
        told, gap = 0, None
        for i, j in pairs:
            side = "a" if j < 0 else "b" if i < 0 else None
            told += (10 if a[i] == b[j] else -10) if side is None else extend if side == gap else start
            gap = side
        assert told == score
        if not local:
            assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))


def test_common_numbers(spark):
    assert alignment.composed([(0, 0), (1, -1), (2, 1)], [(0, 0), (-1, 1), (1, 2)]) == [(0, 0), (1, 1), (2, 2)]
    assert alignment.composed([(0, 0), (1, -1)], [(0, 0)]) == [(0, 0), (1, -1)]
    with pytest.raises(ValueError):
        alignment.composed([(0, 0), (1, 1)], [(0, 0)])
    chains = spark.createDataFrame([("A", "X", "ACDE", "ADEF", "ACDE-", "A-DEF"), ("B", "Y", "AC", "AC", "AC", "A"), ("C", "Z", None, "A", "A", "A")], "target_chain string, model_chain string, target_seq string, model_seq string, target_aligned string, model_aligned string")
    numbers = alignment.common_numbers(chains)
    places = {r["target_chain"]: r["places"] for r in numbers.collect()}
    assert [tuple(p) for p in places["A"]] == [(0, 0), (1, -1), (2, 1), (3, 2), (-1, 3)]
    assert places["B"] is None and places["C"] is None
    model = spark.createDataFrame([("X", n, name) for n in (10, 11, 12, 13) for name in ("N", "CA")] + [("Q", 3, "N")], "chain string, num int, name string")
    assert rows(alignment.with_common_numbers(model, numbers, "model").select("chain", "num").distinct()) == [("Q", 3), ("X", 1), ("X", 3), ("X", 4), ("X", 5)]
    target = spark.createDataFrame([("A", n, "CA") for n in (7, 8, 9, 20)], "chain string, num int, name string")
    assert rows(alignment.with_common_numbers(target, numbers, "target"), "num") == [(1,), (2,), (3,), (4,)]


def test_alignment(spark):
    pairs = spark.createDataFrame([("ACDE", "ADE"), ("ABC", "ABC"), (None, "AB"), ("", "")], "a string, b string")
    found = {r["a"]: r for r in alignment.aligned(pairs).collect()}
    assert [tuple(p) for p in found["ACDE"]["places"]] == [(0, 0), (1, -1), (2, 1), (3, 2)]
    assert found["ACDE"]["score"] == 10
    assert found["ABC"]["score"] == 30
    assert [tuple(p) for p in found[None]["places"]] == [(-1, 0), (-1, 1)]
    assert found[""]["places"] == []
    score, places = alignment.align_pair("XXABCYY", "ZABCZZ", local=True)
    assert (score, places) == (30, [(2, 1), (3, 2), (4, 3)])
    table = [("m", t, c, v) for t, c, v in [("A", "x", 5.0), ("A", "y", 4.0), ("B", "x", 5.0), ("B", "y", 0.0)]]
    overlay = alignment.chain_overlay(spark.createDataFrame(table, "k string, target_chain string, model_chain string, score double"), ["k"])
    assert rows(overlay, "target_chain", "model_chain") == [("A", "y"), ("B", "x")]


def test_selection(spark):
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.85, 0.9], [0.9, 0.85, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    data = [("t", f"m{i}", f"m{j}", float(d[i, j])) for i in range(4) for j in range(4) if i != j]
    clusters = selection.clustered(spark.createDataFrame(data, "t string, a string, b string, distance double"), "t", 2)
    assert rows(clusters, "model", "cluster") == [("m0", 0), ("m1", 0), ("m2", 1), ("m3", 1)]
    schema = "t string, model string, score double"
    pool = [("t", f"m{i}", v) for i, v in enumerate([0.5, 0.9, 0.7, 0.7, 0.4, 0.9, 0.1, 0.2, 0.3])]  # the better half: m5, m1, m3, m2
    groups = spark.createDataFrame([("t", f"m{i}", i % 2) for i in range(9)], "t string, model string, cluster int")
    given = [("t", n, v) for n, v in (("c1", 0.3), ("c2", 0.8), ("c3", 0.8), ("m5", 0.9), ("c9", 0.9))] + [("u", "only", 0.1)]
    final = selection.final_models(spark.createDataFrame(pool, schema), groups, spark.createDataFrame(given, schema), "t")
    want = [("t", 1, "m5", "cluster 1"), ("t", 2, "m2", "cluster 0"), ("t", 3, "c2", "MSA"), ("t", 4, "c9", "TBM"), ("u", 1, "only", "TBM")]
    assert rows(final, "t", "number", "model", "why") == want


def test_curves(spark):
    for bad in ("__import__('os')", "l.x", "x+1", "exp(l, 2)", "l if l else 1", "1 +"):
        with pytest.raises(ValueError):
            curves.sweep(spark, bad)
    assert curves.sweep(spark, "2*l^2", count=3, step=1.0).orderBy("i").collect()[2]["rate"] == 8.0
    x = np.linspace(-1, 1, 40)
    frame = spark.createDataFrame([(1, float(v), float(v**3 - v)) for v in x], "k int, x double, y double")
    fit = curves.best_polynomial(frame, "k", range(2, 4)).first()
    assert (fit["degree"], fit["rmse"] < 1e-9) == (3, True)
    random.seed(3)
    points = []
    for _ in range(50):
        u = np.random.default_rng(len(points)).normal(size=3)
        u /= np.linalg.norm(u)
        points.append(("s", tuple(float(c) for c in np.array([1, -2, 3]) + 4 * u)))
    r = curves.sphere_fit(spark.createDataFrame(points, "k string, p struct<x:double,y:double,z:double>"), ["k"]).first()
    assert np.allclose([r["cx"], r["cy"], r["cz"], r["radius"]], [1, -2, 3, 4])


def test_restraints(spark):
    probs = [0.0] * 37
    probs[6] = 0.9
    probs[36] = 0.1
    data = [(i, j, k, probs) for i, j in ((0, 5), (5, 0), (2, 2)) for k in ("dist", "phi")]
    pairs = restraints.candidates(spark.createDataFrame(data, "i int, j int, kind string, probs array<double>"))
    assert rows(pairs, "i", "j", "kind") == [(0, 5, "dist"), (0, 5, "phi"), (5, 0, "phi")]
    kept = restraints.chosen(pairs, 3, 12, 0.3)
    assert kept.count() == 3
    second = kept.withColumn("p12", F.when(F.col("kind") == "dist", 0.1))
    assert rows(restraints.chosen(second, 3, 12, 0.3, second_cut=0.2), "kind") == [("phi",), ("phi",)]
    splines = {r["kind"]: len(r["spline"]) for r in restraints.restraints(kept).collect()}
    assert splines == {"dist": 36, "phi": 40}
    assert restraints.chosen(pairs, 3, 12, 0.3, spark.createDataFrame([(0,)], "num int")).count() == 0


def test_streaming(spark, tmp_path):
    data = [(f"2024-01-01 0{h}:{m:02d}:00", "AA", 1.5) for h in range(3) for m in (0, 30)]
    frame = spark.createDataFrame(data, "t string, class string, area double").select(F.col("t").cast("timestamp").alias("ts"), "class", "area")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = write_windows(windowed_areas(stream, keys=["class"]), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert rows(closed, "area", "n") == [(3.0, 2), (3.0, 2)]
    assert windowed_areas(frame, keys=["class"]).count() == 3


def test_transfer_and_properties(spark):
    places = spark.createDataFrame([(1, "CA"), (1, "CB"), (2, "CB"), (3, "N")], "pos int, atom string")
    have = spark.createDataFrame([(1, "CA", (1.0, 0.0, 0.0)), (2, "CA", (2.0, 0.0, 0.0)), (2, "CB", (2.5, 0.0, 0.0))], "pos int, atom string, p struct<x:double,y:double,z:double>")
    got = {(r["pos"], r["atom"]): r["p"] and r["p"]["x"] for r in structures.transferred(places, have).collect()}
    assert got == {(1, "CA"): 1.0, (1, "CB"): 1.0, (2, "CB"): 2.5, (3, "N"): None}
    letters = spark.createDataFrame([(0, "A", 4), (1, "V", 4), (2, "?", 4)], "pos int, letter string, n int")
    steric = spark.createDataFrame([("A", 1.28), ("V", 3.67)], "letter string, steric double")
    found = {r["pos"]: r for r in structures.property_vectors(letters, [steric], length_col="n").collect()}
    assert found[0]["one_hot"][0] == 1.0 and sum(found[0]["one_hot"]) == 1.0
    assert (found[1]["steric"], found[1]["position"], found[2]["steric"], sum(found[2]["one_hot"])) == (3.67, 0.25, None, 0.0)
    features = msa.pair_features(spark.createDataFrame([(0,), (1,), (2,)], "pos int"))
    assert features.count() == 9
    rows_ = spark.createDataFrame([(i,) for i in range(1000)], "seq int")
    half = msa.subsample(rows_, 0.5, 1)
    assert 400 < half.count() < 600
    assert rows(half) == rows(msa.subsample(rows_.repartition(3), 0.5, 1))


def test_stacking(spark):
    data = [("A", 1, "B", 1, "SS", 5.0), ("A", 1, "B", 2, "SS", 6.0), ("A", 1, "B", 1, "AA", 7.0)]
    df = spark.createDataFrame(data, CONTACTS)
    planes = spark.createDataFrame([("A", 1, (0.0, 0.0, 0.0), (0.0, 0.0, 1.0))], "chain string, num int, origin struct<x:double,y:double,z:double>, normal struct<x:double,y:double,z:double>")
    atoms = spark.createDataFrame([("B", 1, (0.0, 1.0, 2.0)), ("B", 1, (1.0, 0.0, 3.0)), ("B", 2, (0.0, 0.0, 1.0)), ("B", 2, (0.0, 0.0, -1.0))], "chain string, num int, p struct<x:double,y:double,z:double>")
    added = rows(contacts.stacking_labels(df, planes, atoms).filter("class like 'na%'"), "b_num", "class", "area")
    assert added == [(1, "na_stacking", 5.0), (1, "na_stacking_up", 5.0), (2, "na_siding", 6.0)]


def test_scratch_on_a_cluster_is_shared():
    from helixframe.scratch import _in_warehouse

    assert _in_warehouse("hdfs://name/warehouse/") == "hdfs://name/warehouse/_scratch"
    for own in ("file:/home/me/spark-warehouse", "file:///w", "spark-warehouse", "/w"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            _in_warehouse(own)


def brute_permutation(target, model, names):
    """Every renaming, contact by contact."""
    best = None
    for order, p in enumerate(itertools.permutations(names)):
        to, areas = dict(zip(names, p, strict=True)), {}
        for a, i, b, k, kind, area in model:
            if kind == "AA":
                end = (to.get(a, a), i, to.get(b, b), k)
                areas[end] = areas.get(end, 0) + area
        t = {}
        for a, i, b, k, kind, area in target:
            if kind == "AA":
                t[a, i, b, k] = t.get((a, i, b, k), 0) + area
        ref = sum(t.values())
        score = 1 - sum(min(abs(v - areas.get(x, 0)), v) for x, v in t.items()) / ref if ref else 0.0
        if best is None or score > best[1]:
            best = (",".join(p), score, order)
    return best


@pytest.mark.parametrize("names", ["A", "AB", "ABC", "ABCDE"])
def test_chain_permutation(spark, names):
    rng = random.Random(len(names))
    for case in range(3):
        chains = names + "z"  # z keeps its name
        rows_ = [(rng.choice(chains), rng.randrange(4), rng.choice(chains), rng.randrange(4), rng.choice(["AA", "AA", "SS"]), float(rng.randrange(1, 50))) for _ in range(160)]
        turn = dict(zip(names, rng.sample(names, len(names)), strict=True))
        model = [(turn.get(a, a), i, turn.get(b, b), k, kind, area + rng.choice([0, 1])) for a, i, b, k, kind, area in rows_ if rng.random() < 0.9]
        if case == 2:  # all the same: the first wins
            rows_ = model = [(a, 1, b, 2, "AA", 8.0) for a in chains for b in chains]
        found = scoring.best_chain_permutation(spark.createDataFrame(rows_, CONTACTS), spark.createDataFrame(model, CONTACTS), list(names)).first()
        want = brute_permutation(rows_, model, list(names))
        assert (found["permutation"], found["order"]) == (want[0], want[2]) and math.isclose(found["score"], want[1])
    empty = spark.createDataFrame([], CONTACTS)
    assert tuple(scoring.best_chain_permutation(empty, empty, list(names)).first()) == (",".join(names), 0.0, 0)


def test_ten_chains(spark):
    names = "ABCDEFGHIJ"
    rng = random.Random(4)
    target = [(a, i, b, i + 1, "AA", float(rng.randrange(1, 90))) for a in names for b in names for i in range(6) if rng.random() < 0.4]
    turn = dict(zip(names, "DGAJBHCIFE", strict=True))
    model = [(turn[a], i, turn[b], k, kind, area + 0.5) for a, i, b, k, kind, area in target]
    found = scoring.best_chain_permutation(spark.createDataFrame(target, CONTACTS), spark.createDataFrame(model, CONTACTS), list(names)).first()
    back = {v: k for k, v in turn.items()}
    assert found["permutation"] == ",".join(back[n] for n in names) and found["score"] > 0.9


def kruskal(nodes, edges, k):
    """Clusters by joining along the shortest edges, ties by their ends, until k are left; numbered by least member."""
    part = {n: n for n in nodes}
    for _, a, b in sorted((d, min(a, b), max(a, b)) for a, b, d in edges if d is not None and a != b):
        if len(set(part.values())) <= k:
            break
        if part[a] != part[b]:
            low, high = sorted((part[a], part[b]))
            part = {n: low if p == high else p for n, p in part.items()}
    numbers = {p: i for i, p in enumerate(sorted(set(part.values())))}
    return {n: numbers[p] for n, p in part.items()}


def test_single_linkage(spark, k=3):
    rng = random.Random(k)
    edges = [("ties", f"n{a:02}", f"n{b:02}", float(rng.randrange(4))) for a in range(12) for b in range(a)]  # many of each distance
    edges += [("sparse", f"n{rng.randrange(20):02}", f"n{rng.randrange(20):02}", rng.random()) for _ in range(22)]  # several parts, loops, repeats
    edges += [("line", f"n{a:02}", f"n{a + 1:02}", 1.0) for a in range(9)] + [("one", "n0", "n0", 0.0), ("one", "n1", "n0", None)]
    found = linkage.single_linkage(spark.createDataFrame(edges, "key string, a string, b string, distance double").repartition(4), ["key"], k)
    got = {}
    for r in found.collect():
        got.setdefault(r["key"], {})[r["model"]] = r["cluster"]
    for key in ("ties", "sparse", "line", "one"):
        own = [(a, b, d) for name, a, b, d in edges if name == key]
        assert got[key] == kruskal({n for a, b, _ in own for n in (a, b)}, own, k)
    assert linkage.single_linkage(spark.createDataFrame([], "key string, a string, b string, distance double"), ["key"], 2).count() == 0


def test_refused_rows_and_results(spark):
    atoms = spark.createDataFrame([(1, "ALA", "CB"), (2, "GLY", "CA"), (3, "XXX", "Q")], "i int, res string, atom string")
    patterns = spark.createDataFrame([("ALA_CB", 1.9), ("*_C*", 1.7)], "pattern string, value double")
    options = relational.pattern_options(F.col("res"), F.col("atom"))
    known = relational.first_match_lookup(atoms.filter("i < 3"), patterns, options, ["i"], required=True)
    assert rows(known, "i", "value") == [(1, 1.9), (2, 1.7)]
    assert rows(relational.first_match_lookup(atoms, patterns, options, ["i"]), "i", "value") == [(1, 1.9), (2, 1.7), (3, None)]
    with pytest.raises(Exception, match="no pattern fits the row of i=3"):
        relational.first_match_lookup(atoms, patterns, options, ["i"], required=True).collect()
    some = relational.NotEmpty(atoms.filter("i > 1"), "atoms")
    assert len(some.df.collect()) == 2 and some.check() == 2
    none = relational.NotEmpty(atoms.filter("i > 9"), "atoms of that name")
    assert none.df.collect() == []
    with pytest.raises(ValueError, match="no atoms of that name"):
        none.check()
    assert relational.without(atoms, F.col("res").isNull(), "no residue").count() == 3
    with pytest.raises(Exception, match="unknown residue"):
        relational.without(atoms, F.col("res") == "XXX", "unknown residue").collect()


def test_overwrite_blob(spark):
    before = spark.createDataFrame([("old",)], "text string")
    for text in ("new\nlines 😀", ""):
        after = store.overwrite_blob(before, text)
        assert after.schema == before.schema and [tuple(r) for r in after.collect()] == [(text,)]
    assert [tuple(r) for r in before.collect()] == [("old",)]
