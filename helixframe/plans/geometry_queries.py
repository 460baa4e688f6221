"""Geometry, array, alignment and curve queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from helixframe.functions import arrays as a
from helixframe.functions import geometry as g
from helixframe.operators import curves, frames, msa, restraints, selection, structures, surfaces, windows
from helixframe.operators.crowded import dealt_range_join
from helixframe.operators.relational import range_join
from helixframe.plans.registry import query
from helixframe.plans.tables import ACCENTED, ALIGNMENT, LARGEST_RADIUS, POINTS, alignment, points, table


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _rounded_many(df, *names):
    """_rounded to 6 digits without a decimal for each value, which tells where rows are many; numbers too large for such digits stay."""
    whole = lambda c: F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6 + F.lit(0.0)
    return df.withColumns({n: F.when(F.abs(F.col(n)) < 1e9, whole(F.col(n))).otherwise(F.col(n)) for n in names})


@query(f"WITH {POINTS} SELECT i, k, round(d, 6) AS d FROM d WHERE i < k AND d <= 0.08::double")
def range_neighbors(spark, d):
    p = points(spark, d)
    pairs = range_join(p, p, 0.08).filter("l.atom_idx < r.atom_idx")
    return _rounded(pairs.select(F.col("l.atom_idx").alias("i"), F.col("r.atom_idx").alias("k"), "d"), "d")


@query(
    """WITH s AS (SELECT vec_id, floor(embedding[1]::double * 20) AS x, floor(embedding[2]::double * 20) AS y, floor(embedding[3]::double * 20) AS z FROM embeddings),
       c AS (SELECT x, y, z, count(*) AS n FROM s GROUP BY ALL)
       SELECT s.vec_id, sum(c.n)::bigint AS near FROM s JOIN c ON (s.x - c.x) ** 2 + (s.y - c.y) ** 2 + (s.z - c.z) ** 2 <= 2 GROUP BY s.vec_id"""
)
def crowded_neighbors(spark, d):
    """Embeddings in few places, so that many share each one: how many are near, the own one included."""
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", g.point(*[F.floor(F.col("embedding")[i].cast("double") * 20).cast("double") for i in range(3)]).alias("p"))
    return dealt_range_join(p, p, 1.5, most=256).groupBy(F.col("l.vec_id").alias("vec_id")).agg(F.count("*").alias("near"))


@query(f"WITH {POINTS} SELECT i, k AS j, round(ra + rb - d, 6) AS overlap FROM d WHERE i < k AND d < ra + rb AND ra + rb - d > 0.005::double")
def clashes(spark, d):
    return _rounded(structures.clashes(points(spark, d), LARGEST_RADIUS, 0.005), "overlap")


@query(f"WITH {POINTS} SELECT DISTINCT least(ca, cb) AS chain_a, greatest(ca, cb) AS chain_b FROM d WHERE ca <> cb AND d < ra + rb + 2 * 0.01::double")
def chain_pairs(spark, d):
    return structures.touching_chains(points(spark, d), LARGEST_RADIUS, 0.01)


@query(f"WITH {POINTS} SELECT i AS a_num, k AS b_num, round(d - ra - rb, 6) AS gap FROM d WHERE d <= 0.06::double")
def min_distance(spark, d):
    gaps = structures.min_residue_distance(points(spark, d), 0.06, LARGEST_RADIUS)
    return _rounded_many(gaps.select(F.col("a_num").cast("long").alias("a_num"), F.col("b_num").cast("long").alias("b_num"), "gap"), "gap")


@query(f"WITH {POINTS} SELECT atom_idx FROM p WHERE atom_idx NOT IN (SELECT i FROM d WHERE d + ra <= rb AND (NOT (d = 0 AND ra = rb) OR k < i))")
def hidden_points(spark, d):
    return structures.visible_spheres(points(spark, d), LARGEST_RADIUS).select("atom_idx")


@query(f"WITH {POINTS} SELECT i, k AS j, round(d, 6) AS d, ca <> cb AS between_chains FROM d WHERE d < 0.05::double")
def contact_map(spark, d):
    p = points(spark, d).withColumnRenamed("atom_idx", "idx")
    return _rounded(structures.contact_map(p, 0.05), "d")


@query(
    f"""WITH {POINTS}, c AS (SELECT chain, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY chain)
        SELECT p.chain, round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) + r), 6) AS radius FROM p JOIN c ON p.chain = c.chain GROUP BY p.chain"""
)
def bounding_spheres(spark, d):
    return _rounded(structures.bounding_spheres(points(spark, d)).select("chain", "radius"), "radius")


@query(f"WITH {POINTS} SELECT i, k, round(d, 6) AS d FROM d WHERE ca = 'L1' AND d < 0.1::double")
def active_neighbours(spark, d):
    p = points(spark, d)
    pairs = structures.neighbours(p.filter("chain = 'L1'"), p, 0.1)
    return _rounded(pairs.select(F.col("l.atom_idx").alias("i"), F.col("r.atom_idx").alias("k"), "d"), "d")


def _corner(k: int):
    return g.point(*[F.col("embedding")[3 * k + i].cast("double") for i in range(3)])


_V = "embedding[{i}]::double"
_XYZ = ", ".join(f"{_V.format(i=3 * k + i + 1)} AS {n}{c}" for k, n in enumerate("pqrs") for i, c in enumerate("xyz"))
_E = f"e AS (SELECT vec_id, {_XYZ} FROM embeddings)"


def _cb_sql(axis: int) -> str:
    c = ["x", "y", "z"]
    u, v = c[(axis + 1) % 3], c[(axis + 2) % 3]
    cross = f"((q{u} - p{u}) * (r{v} - q{v}) - (q{v} - p{v}) * (r{u} - q{u}))"
    x = c[axis]
    return f"round(-0.58273431::double * {cross} + 0.56802827::double * (q{x} - p{x}) - 0.54067466::double * (r{x} - q{x}) + q{x}, 6) AS {x}"


@query(f"WITH {_E} SELECT vec_id, {', '.join(_cb_sql(i) for i in range(3))} FROM e")
def virtual_cb(spark, d):
    cb = g.virtual_cb(*[_corner(k) for k in range(3)])
    rows = table(spark, d, "embeddings").select("vec_id", cb.alias("p"))
    return rows.select("vec_id", *[F.round(F.col("p")[c], 6).alias(c) for c in "xyz"])


@query(
    f"""WITH {_E}, u AS (SELECT vec_id, px - qx AS ax, py - qy AS ay, pz - qz AS az, rx - qx AS bx, ry - qy AS by_, rz - qz AS bz FROM e)
        SELECT vec_id, round(acos(greatest(-1, least(1, (ax * bx + ay * by_ + az * bz) / sqrt(ax * ax + ay * ay + az * az) / sqrt(bx * bx + by_ * by_ + bz * bz)))), 6) AS angle FROM u"""
)
def planar_angle(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(g.angle(_corner(0), _corner(1), _corner(2)), 6).alias("angle"))


@query(
    f"""WITH {_E}, k AS (
            SELECT vec_id, px - qx AS ax, py - qy AS ay, pz - qz AS az, (rx - qx) / n AS ux, (ry - qy) / n AS uy, (rz - qz) / n AS uz, sx - rx AS dx, sy - ry AS dy, sz - rz AS dz
            FROM (SELECT *, sqrt((rx - qx) * (rx - qx) + (ry - qy) * (ry - qy) + (rz - qz) * (rz - qz)) AS n FROM e)),
        v AS (SELECT *, ax * ux + ay * uy + az * uz AS da, dx * ux + dy * uy + dz * uz AS dd FROM k),
        w AS (SELECT vec_id, ux, uy, uz, ax - da * ux AS vx, ay - da * uy AS vy, az - da * uz AS vz, dx - dd * ux AS wx, dy - dd * uy AS wy, dz - dd * uz AS wz FROM v)
        SELECT vec_id, round(atan2((uy * vz - uz * vy) * wx + (uz * vx - ux * vz) * wy + (ux * vy - uy * vx) * wz, vx * wx + vy * wy + vz * wz), 6) AS dihedral FROM w"""
)
def torsion(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(g.dihedral(*[_corner(k) for k in range(4)]), 6).alias("dihedral"))


@query(
    f"""WITH {_E}, k AS (SELECT vec_id, qx - px AS ax, qy - py AS ay, qz - pz AS az, rx - px AS bx, ry - py AS by_, rz - pz AS bz, sx - px AS cx, sy - py AS cy, sz - pz AS cz FROM e)
        SELECT vec_id, round(sqrt((ay * bz - az * by_) * (ay * bz - az * by_) + (az * bx - ax * bz) * (az * bx - ax * bz) + (ax * by_ - ay * bx) * (ax * by_ - ay * bx)) / 2, 6) AS area,
               round(abs(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6, 6) AS volume FROM k"""
)
def triangle_tetrahedron(spark, d):
    p = [_corner(k) for k in range(4)]
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(g.triangle_area(*p[:3]), 6).alias("area"), F.round(F.abs(g.tetrahedron_volume(*p)), 6).alias("volume")
    )


@query(
    """SELECT vec_id, CASE WHEN v < 2.5 THEN 0 WHEN v >= 20 THEN 36 ELSE floor((v - 2.5) / 0.5)::int + 1 END AS bin
       FROM (SELECT vec_id, 10 + embedding[1]::double * 40 AS v FROM embeddings)"""
)
def digitize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", a.digitized(10 + F.col("embedding")[0].cast("double") * 40, 2.5, 20.0, 35).alias("bin"))


@query("SELECT vec_id, list_transform(embedding[64:64] || embedding[1:63], lambda x: x::double) AS rolled FROM embeddings")
def roll_bins(spark, d):
    return table(spark, d, "embeddings").select("vec_id", a.rolled(F.col("embedding")).cast("array<double>").alias("rolled"))


_SOFT = """s AS (SELECT vec_id, list_transform(embedding, lambda x: exp((x - list_max(embedding))::double)) AS e FROM embeddings),
    p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s)"""


@query(f"WITH {_SOFT} SELECT vec_id, round(list_sum(p[6:21]), 6) AS contact, round(list_sum(p[2:]), 6) AS rest FROM p")
def prob_mass(spark, d):
    probs = table(spark, d, "embeddings").select("vec_id", a.softmax(F.col("embedding")).alias("p"))
    return probs.select("vec_id", F.round(a.mass(F.col("p"), 5, 21), 6).alias("contact"), F.round(a.mass(F.col("p"), 1), 6).alias("rest"))


@query(
    """SELECT vec_id, list_transform(embedding[63:64] || embedding || embedding[1:2], lambda x: x::double) AS circle,
              list_transform(list_reverse(embedding[1:2]) || embedding || list_reverse(embedding[63:64]), lambda x: x::double) AS mirror FROM embeddings"""
)
def padded_bins(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", a.padded_circle(e).cast("array<double>").alias("circle"), a.padded_mirror(e).cast("array<double>").alias("mirror"))


@query(f"WITH {_SOFT} SELECT vec_id, list_transform(p, lambda x: round(-ln((x + 0.0001::double) / (p[64] + 0.0001::double)), 6) + 0::double) AS potential FROM p")
def angle_potential(spark, d):
    probs = table(spark, d, "embeddings").select("vec_id", a.softmax(F.col("embedding")).alias("p"))
    return probs.select("vec_id", F.transform(a.angle_potential(F.col("p")), lambda x: F.round(x, 6) + 0.0).alias("potential"))


_PAIRS = """h AS (SELECT (vec_id // 25)::int AS i, (vec_id % 25)::int AS j, (vec_id // 500)::int AS part, vec_id % 7 / 7.0::double AS mask,
        (4 * p[8] + 3 * (p[7] + p[9]) + 2 * (p[6] + p[10]) + p[5] + p[11]) / 4 AS q FROM p)"""


def _histograms(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", a.softmax(F.col("embedding")).alias("p"))
    return rows.select(
        F.expr("vec_id div 25").cast("int").alias("i"), (F.col("vec_id") % 25).cast("int").alias("j"), F.expr("vec_id div 500").cast("int").alias("part"),
        F.slice("p", 1, 15).alias("esto"), (F.col("vec_id") % 7 / 7.0).alias("mask"),
    )


@query(f"WITH {_SOFT}, {_PAIRS} SELECT part, i, round(sum(mask * q) / nullif(sum(mask), 0), 6) AS lddt FROM h WHERE i <> j GROUP BY part, i")
def lddt_from_hist(spark, d):
    return _rounded(selection.lddt_by_residue(_histograms(spark, d), ["part"]), "lddt")


_TAPS = [0.5 - 0.5 * math.cos(2 * math.pi * i / 12) for i in range(13)]
_QUALITY = f"""{_PAIRS}, o AS (SELECT part, unnest([i, j]) AS num, mask * q AS v, mask FROM h WHERE j - i >= 3 AND mask > 0.1::double),
    u AS (SELECT part, num, (sum(v) + 1e-4) / (sum(mask) + 1e-4) AS quality FROM o GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY num) AS r, count(*) OVER (PARTITION BY part) AS n FROM u),
    w AS (SELECT generate_subscripts(t, 1) - 7 AS step, unnest(t) AS weight FROM (SELECT {[x / sum(_TAPS) for x in _TAPS]}::double[] AS t)),
    sm AS (SELECT k.part, k.num, sum(b.quality * w.weight) AS quality FROM k, w JOIN k b ON b.part = k.part AND b.r = greatest(1, least(k.n, k.r + w.step)) GROUP BY ALL)"""


@query(f"WITH {_SOFT}, {_QUALITY} SELECT part, num, round(quality, 6) AS quality, round(1.5::double * exp(4 * (0.7::double - quality)), 6) AS deviation FROM sm")
def ca_deviation(spark, d):
    quality = selection.long_range_quality(_histograms(spark, d), least_separation=3, keys=["part"])
    return _rounded(selection.ca_deviation(quality, ["part"]), "quality", "deviation")


@query(
    """WITH k AS (SELECT (vec_id % 20)::int AS i, label AS j, floor(asinh(greatest(8 + embedding[1]::double * 20, 6) - 6) / 0.25)::int AS bin FROM embeddings)
       SELECT i, j, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY i, j), 6) AS share FROM k GROUP BY i, j, bin"""
)
def distance_histogram(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 20).cast("int").alias("i"), F.col("label").alias("j"), (8 + F.col("embedding")[0].cast("double") * 20).alias("d"))
    return _rounded(selection.distance_histogram(rows), "share")


@query(f"WITH {ALIGNMENT} SELECT seq, pos, code FROM e")
def msa_encode(spark, d):
    return msa.encoded(alignment(spark, d))


@query(f"WITH {ALIGNMENT} SELECT seq, round(weight, 6) AS weight FROM w")
def msa_weights(spark, d):
    return _rounded(msa.sequence_weights(msa.encoded(alignment(spark, d))), "weight")


_PSSM = f"""{ALIGNMENT}, t AS (SELECT pos, code, sum(weight) AS w FROM e JOIN w ON e.seq = w.seq GROUP BY ALL), z AS (SELECT pos, sum(w) AS n FROM t GROUP BY pos),
    q AS (SELECT z.pos, c.code::int AS code, coalesce(t.w, 0) / z.n + 1e-9 AS f FROM z CROSS JOIN range(0, 21) c(code) LEFT JOIN t ON t.pos = z.pos AND t.code = c.code)"""


def _profile(spark, d):
    long = msa.encoded(alignment(spark, d))
    return msa.profile(long, msa.sequence_weights(long))


@query(f"WITH {_PSSM} SELECT pos, code, round(f, 6) AS f FROM q")
def msa_pssm(spark, d):
    return _rounded(_profile(spark, d), "f")


@query(f"WITH {_PSSM} SELECT pos, round(-sum(f * ln(f)), 6) AS h FROM q GROUP BY pos")
def msa_entropy(spark, d):
    return _rounded(msa.entropy(_profile(spark, d)), "h")


@query(f"WITH {ALIGNMENT} SELECT pos, round(ln(sum(weight) FILTER (code <> 20)), 6) AS occupancy FROM e JOIN w ON e.seq = w.seq GROUP BY pos")
def msa_occupancy(spark, d):
    long = msa.encoded(alignment(spark, d))
    return _rounded(msa.occupancy(long, msa.sequence_weights(long)), "occupancy")


@query(f"WITH {ALIGNMENT} SELECT e.seq, pos, code FROM e JOIN (SELECT seq FROM e GROUP BY seq HAVING count(*) FILTER (code = 20) < count(*) * 0.3::double) k ON e.seq = k.seq")
def msa_covered(spark, d):
    return msa.covered(msa.encoded(alignment(spark, d)), 0.3)


@query(
    f"""WITH {ALIGNMENT}, x AS (SELECT a.pos AS i, b.pos AS j, a.code AS ca, b.code AS cb, sum(weight) AS w FROM e a JOIN e b ON a.seq = b.seq AND a.pos < b.pos JOIN w ON w.seq = a.seq GROUP BY ALL)
        SELECT i, j, round(ln(sum(w)) - sum(w * ln(w)) / sum(w), 6) AS h, round(coalesce(sum(w) FILTER (ca = 20 AND cb = 20), 0) / sum(w), 6) AS gaps FROM x GROUP BY i, j"""
)
def msa_pair_entropy(spark, d):
    long = msa.encoded(alignment(spark, d))
    return _rounded(msa.pair_entropy(long, msa.sequence_weights(long)), "h", "gaps")


def _lines(spark, d):
    """Each text is an alignment, of its lines of 16 characters."""
    text = F.upper(F.translate("text", ACCENTED, ""))
    lines = F.regexp_extract_all(F.concat(text, F.lit("-" * 15)), F.lit("(?s).{16}"), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", F.explode(lines).alias("aligned"))


@query()
def msa_couplings(spark, d):
    return _rounded(msa.couplings(_lines(spark, d), "item_id"), "score", digits=4)


@query(
    f"""WITH t AS (SELECT item_id, upper(translate(text, '{ACCENTED}', '')) || repeat('-', 15) AS t FROM benchmark),
        l AS (SELECT item_id, k AS seq, substr(t, (16 * k + 1)::int, 16) AS aligned FROM t, range(0, 10000) r(k) WHERE k < length(t) // 16),
        e AS (
            SELECT item_id, seq, i::int AS pos, CASE WHEN strpos('ARNDCQEGHILKMFPSTWYV-', substr(aligned, i::int + 1, 1)) > 0
                                             THEN strpos('ARNDCQEGHILKMFPSTWYV-', substr(aligned, i::int + 1, 1)) - 1 ELSE 20 END AS code
            FROM l, range(16) r(i)),
        w AS (
            SELECT item_id, a AS seq, 1.0::double / count(*) AS w
            FROM (SELECT x.item_id, x.seq AS a, y.seq AS b FROM e x JOIN e y ON x.item_id = y.item_id AND x.pos = y.pos AND x.code = y.code
                  GROUP BY ALL HAVING count(*) > 16 * 0.8::double) GROUP BY item_id, a),
        p AS (SELECT item_id, sum(w) AS total, CASE WHEN sum(w) - sqrt(avg(w)) > 1e-9 THEN sum(w) - sqrt(avg(w)) ELSE 1 END AS points FROM w GROUP BY item_id),
        f AS (SELECT item_id, pos, code, sum(w) AS s FROM e JOIN w USING (item_id, seq) GROUP BY ALL),
        s AS (SELECT x.item_id, x.pos AS i, y.pos AS j, x.code AS a, y.code AS b, sum(w) AS s
              FROM e x JOIN e y ON x.item_id = y.item_id AND x.seq = y.seq AND x.pos < y.pos JOIN w ON w.item_id = x.item_id AND w.seq = x.seq GROUP BY ALL),
        c AS (
            SELECT x.item_id, x.pos AS i, y.pos AS j, (coalesce(s.s, 0) - (2 / points - total / points / points) * x.s * y.s) / points AS c
            FROM f x JOIN f y ON x.item_id = y.item_id AND x.pos < y.pos JOIN p ON p.item_id = x.item_id
            LEFT JOIN s ON s.item_id = x.item_id AND s.i = x.pos AND s.j = y.pos AND s.a = x.code AND s.b = y.code)
        SELECT item_id, i, j, round(sqrt(sum(c * c)), 6) AS norm FROM c GROUP BY item_id, i, j"""
)
def msa_covariance(spark, d):
    return _rounded(msa.column_covariance(_lines(spark, d), "item_id"), "norm")


@query(
    """WITH k AS (SELECT p_partkey, p_size AS length FROM part WHERE p_size > 0)
       SELECT p_partkey, pos::int AS pos, sum(least(pos, greatest(length - s, 0)) - greatest(pos - s + 1, 0) + 1)::int AS cover
       FROM k, range(0, 50) r(pos), (VALUES (8), (16)) v(s) WHERE pos < length GROUP BY p_partkey, pos"""
)
def window_cover(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("length"))
    return windows.window_cover(rows, ["p_partkey"], sizes=(8, 16)).withColumn("cover", F.col("cover").cast("int"))


@query(
    """WITH k AS (SELECT DISTINCT p_size AS length FROM part), w AS (SELECT length, s AS size, unnest(range(0, length - s, 4))::int AS st FROM k, (VALUES (8), (12)) v(s) WHERE length >= 2 * s),
            z AS (SELECT *, CASE WHEN st = max(st) OVER (PARTITION BY length, size) THEN length - st ELSE size END AS reach FROM w)
       SELECT x.length, x.size, x.st AS i, y.st AS j, x.reach AS i_length, y.reach AS j_length FROM z x JOIN z y ON x.length = y.length AND x.size = y.size AND y.st >= x.st + x.size"""
)
def window_pairs(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").alias("length")).distinct()
    return windows.window_pairs(rows, sizes=(8, 12), shift=4)


@query(
    """WITH k AS (SELECT DISTINCT p_size AS length FROM part), w AS (SELECT length, s AS size, unnest(range(0, greatest(length - s, 0) + 1))::int AS st FROM k, (VALUES (8), (16)) v(s)),
            o AS (SELECT length, st + unnest(range(0, size)) AS pos, (length + 3 * st + unnest(range(0, size))) % 7 AS value FROM w)
       SELECT length, pos::int AS pos, round(avg(value), 6) AS value FROM o GROUP BY ALL"""
)
def covered_mean(spark, d):
    lengths = table(spark, d, "part").select(F.col("p_size").alias("length")).distinct()
    w = windows.sliding_windows(lengths, sizes=(8, 16))
    offsets = w.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("offset"))
    values = offsets.withColumn("value", ((F.col("length") + 3 * F.col("first") + F.col("offset")) % 7).cast("double"))
    return _rounded(windows.covered_mean(w, values, ["length"]), "value")


@query("SELECT i, 3.0::double * power(2.0::double, i + 1) AS value FROM range(0, 200) t(i)")
def compounded_sweep(spark, d):
    return spark.range(200).select(F.col("id").alias("i"), curves.compounded(3.0, F.col("id"), 2.0).alias("value"))


@query(f"WITH {POINTS} SELECT ca AS chain, i AS a_num, k AS b_num, round(d - ra - rb, 6) AS gap FROM d WHERE ca = cb")
def chain_distances(spark, d):
    gaps = structures.min_residue_distance(points(spark, d), None, LARGEST_RADIUS, ["chain"])
    return _rounded_many(gaps.select("chain", F.col("a_num").cast("long").alias("a_num"), F.col("b_num").cast("long").alias("b_num"), "gap"), "gap")


@query("SELECT s_nationkey, s_suppkey, (dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::int AS idx FROM supplier")
def dense_index(spark, d):
    return windows.dense_index(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_suppkey"], ["s_nationkey"])


_SOFT36 = f"{_SOFT}, r AS (SELECT (vec_id % 40)::int AS i, (vec_id // 40)::int AS j, list_sum(p[6:21]) AS q FROM p)"


@query(f"WITH {_SOFT36} SELECT i, j, round(q, 6) AS p FROM r WHERE i < j AND abs(i - j) >= 3 AND abs(i - j) < 12 AND q >= 0.2::double")
def restraint_filter(spark, d):
    probs = table(spark, d, "embeddings").select(
        (F.col("vec_id") % 40).cast("int").alias("i"), F.expr("vec_id div 40").cast("int").alias("j"), F.lit("dist").alias("kind"), a.softmax(F.col("embedding")).alias("probs")
    )
    return _rounded(restraints.chosen(restraints.candidates(probs), 3, 12, 0.2).select("i", "j", "p"), "p")


@query("SELECT i, round(i * 0.1::double, 6) AS light, round(2 * exp(-(i * 0.1::double) / 30) + (i * 0.1::double) / (5 + i * 0.1::double), 6) AS rate FROM range(0, 1000) t(i)")
def sweep_curve(spark, d):
    return _rounded(curves.sweep(spark, "2*exp(-l/30) + l/(5+l)"), "light", "rate")


@query()
def polynomial_fit(spark, d):
    rows = curves.sweep(spark, "sin(l/20)", count=200).select(F.lit(1).alias("curve"), F.col("light").alias("x"), F.col("rate").alias("y"))
    return curves.best_polynomial(rows, "curve", range(2, 7)).select("curve", "degree", F.round("rmse", 6).alias("rmse"))


@query(
    f"""WITH {POINTS}, m AS (SELECT chain, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p GROUP BY chain),
        c AS (SELECT p.chain, mx, my, mz, x - mx AS x, y - my AS y, z - mz AS z FROM p JOIN m ON p.chain = m.chain),
        s AS (SELECT *, x * x + y * y + z * z AS s FROM c),
        g AS (
            SELECT chain, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, avg(s) AS s, avg(x * x) AS xx, avg(x * y) AS xy, avg(x * z) AS xz, avg(y * y) AS yy, avg(y * z) AS yz,
                   avg(z * z) AS zz, avg(x * s) / 2 AS sx, avg(y * s) / 2 AS sy, avg(z * s) / 2 AS sz FROM s GROUP BY chain),
        k AS (
            SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det,
                   sx * (yy * zz - yz * yz) - xy * (sy * zz - yz * sz) + xz * (sy * yz - yy * sz) AS da,
                   xx * (sy * zz - yz * sz) - sx * (xy * zz - yz * xz) + xz * (xy * sz - sy * xz) AS db,
                   xx * (yy * sz - sy * yz) - xy * (xy * sz - sy * xz) + sx * (xy * yz - yy * xz) AS dc FROM g)
        SELECT chain, round(da / det + mx, 6) AS cx, round(db / det + my, 6) AS cy, round(dc / det + mz, 6) AS cz,
               round(sqrt(s + (da / det) ** 2 + (db / det) ** 2 + (dc / det) ** 2), 6) AS radius FROM k"""
)
def sphere_fit(spark, d):
    return _rounded(curves.sphere_fit(points(spark, d), ["chain"]), "cx", "cy", "cz", "radius")


#: Embeddings as residues of the structure that their label names: N, CA, C and one more atom, in the size of a protein.
SIZE = 40.0
_RESIDUES = f"""
    e0 AS (SELECT vec_id AS idx, label, {", ".join(f"{SIZE}::double * embedding[{3 * k + i + 1}]::double AS {n}{c}" for k, n in enumerate(("n", "a", "c", "o")) for i, c in enumerate("xyz"))} FROM embeddings),
    b0 AS (SELECT *, ax - nx AS ux, ay - ny AS uy, az - nz AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM e0),
    r AS (
        SELECT *, ax + {g.CB_CROSS}::double * (uy * vz - uz * vy) + {g.CB_NORMAL}::double * ux + {g.CB_BOND}::double * vx AS bx,
               ay + {g.CB_CROSS}::double * (uz * vx - ux * vz) + {g.CB_NORMAL}::double * uy + {g.CB_BOND}::double * vy AS by_,
               az + {g.CB_CROSS}::double * (ux * vy - uy * vx) + {g.CB_NORMAL}::double * uz + {g.CB_BOND}::double * vz AS bz FROM b0)"""


def _residues(spark, d):
    sized = [g.point(*[SIZE * F.col("embedding")[3 * k + i].cast("double") for i in range(3)]).alias(n) for k, n in enumerate(("n", "ca", "c", "o"))]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "label", *sized)


#: Vectors as lists in SQL.
_VECTORS = {
    "dot": lambda a, b: f"(({a})[1] * ({b})[1] + ({a})[2] * ({b})[2] + ({a})[3] * ({b})[3])",
    "minus": lambda a, b: f"[({a})[1] - ({b})[1], ({a})[2] - ({b})[2], ({a})[3] - ({b})[3]]",
    "cross": lambda a, b: f"[({a})[2] * ({b})[3] - ({a})[3] * ({b})[2], ({a})[3] * ({b})[1] - ({a})[1] * ({b})[3], ({a})[1] * ({b})[2] - ({a})[2] * ({b})[1]]",
}


def _orientation_sql() -> str:
    dot, minus, cross = (_VECTORS[k] for k in ("dot", "minus", "cross"))

    def dihedral(name: str, back: str, axis: str, ahead: str) -> str:
        """Three steps: the axis's unit, the ends across it, the angle."""
        return f"""
        {name}1 AS (SELECT i, j, {back} AS back, {ahead} AS ahead, list_transform({axis}, lambda x: x / sqrt({dot(axis, axis)})) AS axis FROM p),
        {name}2 AS (
            SELECT i, j, axis, list_transform([1, 2, 3], lambda k: back[k] - {dot("back", "axis")} * axis[k]) AS v,
                   list_transform([1, 2, 3], lambda k: ahead[k] - {dot("ahead", "axis")} * axis[k]) AS w FROM {name}1),
        {name} AS (SELECT i, j, atan2({dot(cross("axis", "v"), "w")}, {dot("v", "w")}) AS {name} FROM {name}2)"""

    return f"""
        WITH {_RESIDUES},
        q AS (SELECT idx, label, [nx, ny, nz] AS n, [ax, ay, az] AS ca, [bx, by_, bz] AS cb FROM r),
        p AS (
            SELECT a.label, a.idx AS i, b.idx AS j, a.n, a.ca, a.cb, b.ca AS ca2, b.cb AS cb2, {minus("b.cb", "a.cb")} AS between_cb
            FROM q a JOIN q b ON a.label = b.label AND a.idx <> b.idx WHERE list_sum(list_transform({minus("b.cb", "a.cb")}, lambda x: x * x)) <= {frames.ORIENTATION_RADIUS**2}::double),
        {dihedral("omega", minus("ca", "cb"), "between_cb", minus("ca2", "cb2"))},
        {dihedral("theta", minus("n", "ca"), minus("cb", "ca"), "between_cb")},
        phi AS (SELECT i, j, label, between_cb, {minus("ca", "cb")} AS u FROM p)
        SELECT label, i, j, round(sqrt({dot("between_cb", "between_cb")}), 6) AS d, round(omega, 6) AS omega, round(theta, 6) AS theta,
               round(acos(greatest(-1, least(1, {dot("u", "between_cb")} / sqrt({dot("u", "u")}) / sqrt({dot("between_cb", "between_cb")})))), 6) AS phi
        FROM phi JOIN omega USING (i, j) JOIN theta USING (i, j)
    """


@query(_orientation_sql())
def residue_orientations(spark, d):
    found = frames.orientations(_residues(spark, d), keys=["label"])
    #  as round(x, 6), without a decimal for each of so many values
    return found.withColumns({c: F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6 + F.lit(0.0) for c in ("d", "omega", "theta", "phi")})


def _voxel_sql() -> str:
    dot, minus, cross = (_VECTORS[k] for k in ("dot", "minus", "cross"))
    unit = lambda v: f"list_transform({v}, lambda x: x / sqrt({dot(v, v)}))"
    size = f"({frames.VOXEL_WIDTH}::double / {frames.VOXEL_BINS - 1})"
    place = lambda axis: f"({dot(axis, 's')} + {frames.VOXEL_WIDTH / 2}::double) / {size}"
    return f"""
        WITH {_RESIDUES},
        q AS (SELECT idx, label, [ax, ay, az] AS ca, [ux, uy, uz] AS bond, [bx - ax, by_ - ay, bz - az] AS out, [ox, oy, oz] AS o FROM r),
        z AS (SELECT *, {unit("out")} AS z FROM q),
        x0 AS (SELECT *, {cross("bond", "z")} AS across FROM z),
        x AS (SELECT *, {unit("across")} AS x FROM x0),
        f0 AS (SELECT *, {cross("z", "x")} AS third FROM x),
        f AS (SELECT *, {unit("third")} AS y FROM f0),
        t AS (SELECT label, 'CA' AS type, ca AS p FROM q UNION ALL SELECT label, 'O' AS type, o AS p FROM q),
        s AS (SELECT f.label, f.idx, t.type, f.x, f.y, f.z, {minus("t.p", "f.ca")} AS s FROM f JOIN t ON f.label = t.label),
        c AS (SELECT label, idx, type, {place("x")} AS px, {place("y")} AS py, {place("z")} AS pz FROM s WHERE {dot("s", "s")} <= {frames.VOXEL_RADIUS**2}::double),
        w AS (
            SELECT label, idx AS residue, floor(px)::int + a AS i, floor(py)::int + b AS j, floor(pz)::int + e AS k, type,
                   (CASE a WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE b WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END)
                   * (CASE e WHEN 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END) AS share
            FROM c, range(2) ra(a), range(2) rb(b), range(2) re(e))
        SELECT label, residue, i::int AS i, j::int AS j, k::int AS k, type, round(sum(share), 6) AS share FROM w
        WHERE i BETWEEN 0 AND {frames.VOXEL_BINS - 1} AND j BETWEEN 0 AND {frames.VOXEL_BINS - 1} AND k BETWEEN 0 AND {frames.VOXEL_BINS - 1} AND share > {frames.LEAST_SHARE}::double
        GROUP BY ALL
    """


@query(_voxel_sql())
def residue_voxels(spark, d):
    r = _residues(spark, d)
    atoms = r.select("label", F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).alias("p")) for t, c in (("CA", "ca"), ("O", "o"))])))
    return _rounded_many(frames.voxels(r, atoms, keys=["label"]), "share")


#: The probe, and how often the mesh of the query is divided.
AREA_PROBE, AREA_DEPTH = 0.01, 2


def _mesh_sql() -> str:
    """Vertices by vertices and triangles by triangles, with the same mesh and the same splits."""
    vertices, triangles = surfaces.icosphere(AREA_DEPTH)
    minus, cross = _VECTORS["minus"], _VECTORS["cross"]
    length = lambda v: f"sqrt({_VECTORS['dot'](v, v)})"
    far = ", ".join(f"{length(minus(f'l[{i}].q', f'l[{j}].c'))} - l[{j}].r AS w{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    share = lambda i, j: f"coalesce((w{i}{i} - w{i}{j}) / nullif((w{i}{i} - w{i}{j}) - (w{j}{i} - w{j}{j}), 0), 0.5) AS t{i}{j}"
    point = lambda i, j: f"list_transform([1, 2, 3], lambda n: l[{i}].q[n] + (l[{j}].q[n] - l[{i}].q[n]) * t{i}{j}) AS e{i}{j}"
    template = lambda parts: "[" + ", ".join(f"{{'o': {o + 1}, 'x': {x + 1}, 'y': {y + 1}, 'z': {z + 1}}}" for o, x, y, z in parts) + "]"
    return f"""
        WITH {POINTS},
        v(vn, u) AS (VALUES {", ".join(f"({n}, [{x!r}::double, {y!r}::double, {z!r}::double])" for n, (x, y, z) in enumerate(vertices))}),
        t(i, j, k) AS (VALUES {", ".join(map(str, triangles))}),
        s AS (
            SELECT atom_idx AS a, 0 AS other, atom_idx AS b, [0::double, 0::double, 0::double] AS c, r, r + {AREA_PROBE}::double AS reach FROM p
            UNION ALL
            SELECT a.atom_idx, 1, b.atom_idx, [b.x - a.x, b.y - a.y, b.z - a.z], b.r, a.r + {AREA_PROBE}::double
            FROM p a JOIN p b ON a.atom_idx <> b.atom_idx
            WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < a.r + b.r + 2 * {AREA_PROBE}::double),
        g AS (SELECT a, other, b, c, r, vn, list_transform(u, lambda x: x * reach) AS q FROM s, v),
        o AS (SELECT a, vn, arg_min({{'b': b, 'q': q, 'c': c, 'r': r}}, {{'far': {length(minus("q", "c"))} - r, 'other': other, 'b': b}}) AS k FROM g GROUP BY a, vn),
        f AS (
            SELECT x.a, CASE WHEN y.k.b = z.k.b THEN [x.k, y.k, z.k] WHEN x.k.b = z.k.b THEN [y.k, x.k, z.k] WHEN x.k.b = y.k.b THEN [z.k, x.k, y.k] ELSE [x.k, y.k, z.k] END AS l
            FROM t JOIN o x ON x.vn = t.i JOIN o y ON y.vn = t.j AND y.a = x.a JOIN o z ON z.vn = t.k AND z.a = x.a),
        w AS (SELECT a, l, {far} FROM f),
        h AS (SELECT a, l, {share(1, 2)}, {share(1, 3)}, {share(2, 3)} FROM w),
        e AS (SELECT a, l, {point(1, 2)}, {point(1, 3)}, {point(2, 3)} FROM h),
        m AS (
            SELECT a, l, [l[1].q, l[2].q, l[3].q, e12, e13, e23, list_transform([1, 2, 3], lambda n: (e12[n] + e13[n] + e23[n]) * (1.0::double / 3))] AS pts,
                   unnest(CASE WHEN l[2].b = l[3].b AND l[1].b = l[2].b THEN {template(surfaces.WHOLE)} WHEN l[2].b = l[3].b THEN {template(surfaces.ODD)} ELSE {template(surfaces.ALL)} END) AS i
            FROM e),
        n AS (SELECT a, l[i.o].b AS b, {minus("pts[i.y]", "pts[i.x]")} AS p, {minus("pts[i.z]", "pts[i.x]")} AS q FROM m)
        SELECT a, b, round(sum({length(cross("p", "q"))} / 2), 9) AS area FROM n GROUP BY a, b HAVING sum({length(cross("p", "q"))} / 2) > 0
    """


@query(_mesh_sql())
def mesh_contact_areas(spark, d):
    return _rounded(surfaces.mesh_areas(points(spark, d), LARGEST_RADIUS, AREA_PROBE, AREA_DEPTH), "area", digits=9)
