"""What is broadcast, shuffled and held in one task, and the same rows as loops."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe import plans
from helixframe.operators import contacts, frames, relational, structures, surfaces
from helixframe.plans import geometry_queries


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [200_000, 1])
def test_rows_with_their_options_are_not_broadcast(spark, most, monkeypatch):
    monkeypatch.setattr(relational, "BROADCAST_PATTERNS", most)
    rows = spark.range(50).select("id", F.concat(F.lit("R"), F.col("id") % 4).alias("res"), F.concat(F.lit("C"), F.col("id") % 7).alias("name"))
    patterns = spark.createDataFrame([("R1_C1", 1), ("R1_C*", 2), ("*_C5", 3), ("R2_*", 4)], "pattern string, value int")
    found = relational.first_match_lookup(rows, patterns, relational.pattern_options(F.col("res"), F.col("name")), ["id"])
    joins = [line for line in plan_of(found).splitlines() if "pattern#" in line and "Join" in line]
    assert joins and all("BuildRight" in line or "SortMergeJoin" in line for line in joins)
    best = lambda i: 1 if i % 4 == 1 and i % 7 == 1 else 2 if i % 4 == 1 else 4 if i % 4 == 2 else 3 if i % 7 == 5 else None
    assert {r["id"]: r["value"] for r in found.collect()} == {i: best(i) for i in range(50)}


def test_parts_are_not_broadcast(spark, sf_dir):
    plan = plan_of(plans.QUERIES["first_match_lookup"](spark, sf_dir))
    assert "BuildLeft" not in "".join(line for line in plan.splitlines() if "pattern#" in line)


def exchanged_after_join(df) -> bool:
    """Whether rows are shuffled above (in the plan's text, before) the topmost join."""
    lines = plan_of(df).splitlines()
    top = next(i for i, line in enumerate(lines) if "Join" in line or "CoGroup" in line)
    return any("Exchange" in line for line in lines[:top])


@pytest.mark.parametrize("name", ["chain_distances", "min_distance"])
def test_pairs_of_residues_are_not_shuffled(spark, sf_dir, name):
    assert not exchanged_after_join(plans.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("radius, keys, block", [(None, ["s"], 3), (None, None, 1000), (0.9, ["s"], 3), (0.3, None, 3), (5.0, ["s"], 3)])
def test_gaps_of_residues_with_several_atoms(spark, radius, keys, block, monkeypatch):
    """Residues that reach over many cells, whatever the blocks, against loops."""
    monkeypatch.setattr(structures, "BLOCK", block)
    random.seed(6)
    data = [(s, "AB"[n % 2], n // 2, tuple(random.uniform(-1, 1) + n % 5 * 0.3 for _ in "xyz"), 0.1 + 0.01 * k) for s in "st" for n in range(14) for k in range(1 + n % 4)]
    atoms = spark.createDataFrame(data, "s string, chain string, num int, p struct<x:double,y:double,z:double>, r double")
    expected = {}
    for s, c, n, p, r in data:
        for s2, c2, n2, p2, r2 in data:
            d = math.dist(p, p2)
            if (keys is None or s == s2) and (c, n) != (c2, n2) and (radius is None or d <= radius):
                at = ((s,) if keys else ()) + (c, n, c2, n2)
                expected[at] = min(expected.get(at, math.inf), d - r - r2)
    found = structures.min_residue_distance(atoms, radius, 0.2, keys).collect()
    assert len(found) == len(expected)
    assert {tuple(r)[:-1]: pytest.approx(r["gap"], abs=1e-9) for r in found} == expected


@pytest.mark.parametrize("name, dealt", [("chain_distances", "_i"), ("min_distance", "_part")])
def test_pairs_of_single_atoms_are_made_by_the_join_alone(spark, sf_dir, name, dealt):
    """No array function is evaluated for a pair of residues of one atom, the radius is the join's own condition, and crowds are dealt."""
    lines = plan_of(plans.QUERIES[name](spark, sf_dir)).splitlines()
    top = next(i for i, line in enumerate(lines) if "Join" in line)
    assert "SortMergeJoin" in lines[top] and f"{dealt}#" in lines[top] and (name == "chain_distances" or "SQRT" in lines[top])
    assert not any("lambda" in line or "Filter" in line or "round(" in line for line in lines[: top + 1])


def test_residues_are_sent_to_so_many_blocks_at_most(spark, monkeypatch):
    """However large a structure is, what is shuffled grows as its residues; every pair is still made once."""
    monkeypatch.setattr(structures, "BLOCK", 2)
    monkeypatch.setattr(structures, "BLOCKS", 4)
    point = F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    atoms = spark.range(60).select(F.lit("A").alias("chain"), F.col("id").cast("int").alias("num"), point.alias("p"), F.lit(0.25).alias("r"))
    residues = atoms.select("chain", "num", "p", "r")
    left, right, _ = structures._all_pairs(residues, residues, ["chain"], structures.BLOCK)
    assert left.count() == right.count() == 4 * 60
    found = {(r["a_num"], r["b_num"]): r["gap"] for r in structures.min_residue_distance(atoms, None, 0.25, ["chain"]).collect()}
    assert found == {(i, j): abs(i - j) - 0.5 for i in range(60) for j in range(60) if i != j}


@pytest.mark.parametrize("radius", [None, 1.0])
@pytest.mark.parametrize("crowd", [1, 1000])
def test_gaps_of_residues_with_one_atom_and_with_several(spark, radius, crowd, monkeypatch):
    """Few have several atoms; places and radii may be null, and many share one cell."""
    monkeypatch.setattr(structures, "CROWD", crowd)
    random.seed(7)
    data = [("A", n, tuple(random.uniform(-1, 1) for _ in "xyz"), None if n == 3 else 0.1) for n in range(20) for _ in range(3 if n in (5, 11) else 1)]
    data.append(("A", 20, None, 0.1))
    atoms = spark.createDataFrame(data, "chain string, num int, p struct<x:double,y:double,z:double>, r double")
    expected = {}
    for _, n, p, r in data:
        for _, n2, p2, r2 in data:
            d = math.dist(p, p2) if p and p2 else None
            if n != n2 and (radius is None or d is not None and d <= radius):
                gap = d - r - r2 if d is not None and r and r2 else None
                expected[n, n2] = min((x for x in (expected.get((n, n2)), gap) if x is not None), default=None)
    found = structures.min_residue_distance(atoms, radius, 0.2).collect()
    assert len(found) == len(expected) == (420 if radius is None else len(expected)) and len(expected) > 50
    assert {(r["a_num"], r["b_num"]): r["gap"] if r["gap"] is None else pytest.approx(r["gap"], abs=1e-9) for r in found} == expected


def test_rounding_without_decimals(spark):
    values = [None, 0.0, -0.0, 1.0000005, -1.0000005, 0.1234564, -0.1234565, 123456.7890125, 5e12, -5e12, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "gap double")
    same = lambda a, b: a == b or a is not None and b is not None and a != a and b != b
    got = [r["gap"] for r in geometry_queries._rounded_many(df, "gap").collect()]
    assert all(same(a, r["gap"]) for a, r in zip(got, geometry_queries._rounded(df, "gap").collect(), strict=True))


def test_stacking_counts_a_place_once(spark):
    """Atoms in one place and residues with one plane make no more pairs than there are places and planes."""
    point = lambda x, y, z: F.struct(*[F.lit(float(v)).alias(c) for v, c in zip((x, y, z), "xyz", strict=True)])
    rows = spark.range(40).select(F.lit("A").alias("a_chain"), F.col("id").cast("int").alias("a_num"), F.lit("B").alias("b_chain"), (F.col("id") % 3).cast("int").alias("b_num"), F.lit("SS").alias("class"), F.col("id").cast("double").alias("area"))
    planes = spark.range(40).select(F.lit("A").alias("chain"), F.col("id").cast("int").alias("num"), point(0, 0, 0).alias("origin"), point(0, 0, 1).alias("normal"))
    height = F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, -1.0).otherwise(F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0))
    atoms = spark.range(3000).select(F.lit("B").alias("chain"), (F.col("id") % 3).cast("int").alias("num"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), height.alias("z")).alias("p"))
    found = contacts.stacking_labels(rows, planes, atoms)
    added = sorted((r["a_num"], r["class"]) for r in found.collect() if r["class"] != "SS")
    assert added == sorted((i, c) for i in range(40) for c in (["na_stacking", "na_stacking_up"], ["na_stacking", "na_stacking_down"], ["na_siding"])[i % 3])
    #  places, and the planes that ask for them
    assert len(re.findall("Deduplicate|Distinct", found._jdf.queryExecution().analyzed().toString())) == 2
    assert contacts.stacking_labels(rows, planes, atoms.limit(0)).count() == 40


def test_template_pairs_are_not_shuffled(spark, sf_dir):
    lines = [line for line in plan_of(plans.QUERIES["template_pairs"](spark, sf_dir)).splitlines() if "Exchange hashpartitioning" in line]
    assert lines and not any("_t1#" in line or "_t2#" in line for line in lines)


def test_template_hits_are_shuffled_once(spark, sf_dir):
    plan = plan_of(plans.QUERIES["template_hits"](spark, sf_dir))
    assert sum("Exchange" in line for line in plan.splitlines()) == 1 and "Join" not in plan and "Window" not in plan


def test_voxels_are_not_shuffled(spark, sf_dir):
    plan = plan_of(plans.QUERIES["residue_voxels"](spark, sf_dir))
    assert "FlatMapCoGroupsInArrow" in plan and "explode" not in plan.split("FlatMapCoGroupsInArrow")[0] and not exchanged_after_join(plans.QUERIES["residue_voxels"](spark, sf_dir))


@pytest.mark.parametrize("atoms, boxes", [(1, 1), (7, 3), (1 << 15, 16)])
def test_boxes_however_many_atoms_at_once(atoms, boxes, monkeypatch):
    """A residue's cells leave the task as two lists for each type, and not as rows; no corner is lost at the box's border."""
    monkeypatch.setattr(frames, "ATOMS_AT_ONCE", atoms)
    monkeypatch.setattr(frames, "BOXES_AT_ONCE", boxes)
    rng, bins, width, radius = np.random.default_rng(9), 5, 8.0, 7.0
    turn = [np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(10)]
    centres, at, kinds = rng.normal(0, 3, (10, 3)), rng.normal(0, 3, (60, 3)), ["CA", None, "O"] * 20
    xyz = lambda p: {c: p[:, i] for i, c in enumerate("xyz")}
    axes = {f"{a}{c}": np.array([t[i, j] for t in turn]) for i, a in enumerate("xyz") for j, c in enumerate("xyz")}
    left, right = pa.table({"_o0": ["m"] * 10, "idx": list(range(10)), **xyz(centres), **axes}), pa.table({"type": kinds, **xyz(at)})
    want = {}
    for n, t in enumerate(turn):
        for p, kind in zip(at - centres[n], kinds, strict=True):
            place = (t @ p + width / 2) / (width / (bins - 1))
            for corner in np.ndindex(2, 2, 2):
                cell = np.floor(place).astype(int) + corner
                share = np.prod(np.where(corner, place - np.floor(place), 1 - (place - np.floor(place))))
                if math.dist(p, (0, 0, 0)) <= radius and (cell >= 0).all() and (cell < bins).all() and share > 1e-3:
                    key = (n, kind, int(cell @ (bins * bins, bins, 1)))
                    want[key] = want.get(key, 0) + share
    found = frames._filled(left, right, ["model"], radius, width, bins, 1e-3)
    assert found.num_rows == 30 and found.column_names == ["model", "residue", "type", "cell", "share"]
    got = {(r["residue"], r["type"], c): s for r in found.to_pylist() for c, s in zip(r["cell"], r["share"], strict=True)}
    assert got.keys() == want.keys() and len(got) > 500 and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    none = frames._filled(left, right.slice(0, 0), ["model"], radius, width, bins, 1e-3)
    assert none.num_rows == 0 and none.schema.equals(found.schema)


def test_pairs_of_spheres_are_no_rows(spark, sf_dir):
    """Only owners leave the step that measures: the plan has no join or arg-min of pairs above it, and copies don't meet each other."""
    plan = plan_of(plans.QUERIES["mesh_contact_areas"](spark, sf_dir))
    above, below = plan.split("FlatMapCoGroupsInArrow")
    assert "Join" not in above and above.count("Exchange") == 1 and "min(atom_idx" in below
    copies = spark.range(3000).select(F.col("id").alias("atom_idx"), F.struct(*[F.lit(1.0).alias(c) for c in "xyz"]).alias("p"), F.lit(1.0).alias("r"))
    found = surfaces.mesh_areas(copies, 1.0, 0.5, 1)
    assert found.filter("a = b").count() == found.count() == 3000  # of spheres as near, a vertex goes to its own


@pytest.mark.parametrize("measured", [1, 40, 1 << 30])
def test_owners_of_crowded_vertices(measured, monkeypatch):
    """However boxes of vertices are halved, against all spheres; with copies, and spheres inside others."""
    monkeypatch.setattr(surfaces, "MEASURED", measured)
    rng = np.random.default_rng(8)
    p, r, probe, unit = rng.normal(0, 1, (70, 3)), rng.choice([0.3, 0.5, 0.9], 70), 0.4, np.array(surfaces.icosphere(1)[0])
    p[40:50], r[40:50] = p[:10], r[:10]
    p[50:55], r[50:55] = p[10:15], 0.1
    x = p[:, None] + (r + probe)[:, None, None] * unit
    far = np.linalg.norm(x[:, :, None] - p, axis=3) - r
    found = surfaces._owners(p, r, p, r, unit, probe)
    assert 0.2 < (found >= 0).mean() < 0.98 and not np.isin(found, range(50, 55)).any()
    at = np.take_along_axis(far, np.where(found < 0, np.arange(70)[:, None], found)[:, :, None], 2)[:, :, 0]
    assert np.allclose(at, far.min(axis=2), rtol=0, atol=1e-12)
    assert not np.isin(found, range(40, 50)).any()  # of copies the first


def test_pairs_of_orientations_are_dealt_in_parts(spark, sf_dir):
    """A cell's residues are dealt, so a crowd is no single task; nothing is shuffled once pairs are made."""
    df = plans.QUERIES["residue_orientations"](spark, sf_dir)
    assert "FlatMapCoGroupsInArrow" in plan_of(df) and "_part" in plan_of(df) and not exchanged_after_join(df)


@pytest.mark.parametrize("at_once", [1, 100, 1 << 20])
def test_orientations_however_many_at_once(at_once, monkeypatch):
    monkeypatch.setattr(frames, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    atoms = {f"{a}_{c}": rng.normal(0, 5, 40) for a in ("n", "ca", "cb") for c in "xyz"}
    left = pa.table({"_o0": ["m"] * 40, "idx": list(range(40)), **atoms})
    right = pa.table({"other": list(range(40)), **{k: v for k, v in atoms.items() if k[0] != "n"}})
    found = frames._turned(left, right, ["model"], 9.0)
    cb = np.stack([atoms[f"cb_{c}"] for c in "xyz"], axis=1)
    near = {(i, j) for i in range(40) for j in range(40) if i != j and np.linalg.norm(cb[i] - cb[j]) <= 9}
    assert sorted(zip(found["i"].to_pylist(), found["j"].to_pylist(), strict=True)) == sorted(near) and 100 < len(near) < 1500
    assert found.column_names == ["model", "i", "j", "d", "omega", "theta", "phi"] and not any(c.null_count for c in found.columns)
    assert frames._turned(left.slice(0, 0), right, ["model"], 9.0).schema.equals(found.schema) and frames._turned(left, right.slice(0, 0), ["model"], 9.0).num_rows == 0
