"""Restraint rows, template features, exact sums, torsions and intervals over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import arrays as a, geometry as g
from helixframe.operators import exact_sums, relational, restraints, store, structures, templates, windows
from helixframe.plans.registry import query
from helixframe.plans.tables import LARGEST_RADIUS, POINTS, points, table
from helixframe.sources import sequences

_KINDS = ("dist", "omega", "theta", "phi")


def _chosen(spark, d):
    """Embeddings as predicted distributions of all four kinds; the second cut and the excluded residues are in use."""
    e = table(spark, d, "embeddings")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.expr("vec_id div 3") % 4 + 1).cast("int"))
    probs = a.softmax(F.col("embedding"))
    rows = e.select((F.col("vec_id") % 40).cast("int").alias("i"), F.expr("vec_id div 40").cast("int").alias("j"), kind.alias("kind"), probs.alias("probs"))
    glycines = table(spark, d, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("num"))
    return restraints.chosen(restraints.candidates(rows).withColumn("p12", a.mass(F.col("probs"), 5, 17)), 3, 1000, 0.2, glycines, second_cut=0.17)


_CHOSEN = """
    s AS (SELECT vec_id, list_transform(embedding, lambda x: exp((x - list_max(embedding))::double)) AS e FROM embeddings),
    p AS (SELECT (vec_id % 40)::int AS i, (vec_id // 40)::int AS j, ['dist', 'omega', 'theta', 'phi'][(vec_id // 3 % 4 + 1)::int] AS kind, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s),
    q AS (SELECT *, CASE WHEN kind = 'dist' THEN list_sum(p[6:21]) ELSE list_sum(p[2:]) END AS mass FROM p),
    k AS (
        SELECT * FROM q WHERE CASE WHEN kind IN ('dist', 'omega') THEN i < j ELSE i <> j END AND abs(i - j) BETWEEN 3 AND 999
            AND mass >= 0.2::double + CASE kind WHEN 'dist' THEN 0 WHEN 'phi' THEN 0.6::double ELSE 0.5::double END
            AND (kind <> 'dist' OR list_sum(p[6:17]) >= 0.17::double)
            AND i NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) AND j NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))"""


@query(
    f"""WITH {_CHOSEN},
        v AS (
            SELECT *, CASE WHEN kind = 'dist'
                THEN list_transform(range(1, 37), lambda b: -ln((p[b + 1] + 1e-4) / ((p[37] + 1e-4) * ((1.75::double + 0.5::double * b) / 19.75::double) ** 1.57::double)) - 0.5::double)
                ELSE list_transform(p[2:], lambda x: -ln((x + 1e-4) / (p[64] + 1e-4))) END AS v FROM k),
        w AS (
            SELECT kind, i, j, mass, CASE kind WHEN 'dist' THEN v WHEN 'phi' THEN list_reverse(v[1:2]) || v || list_reverse(v[62:63]) ELSE v[62:63] || v || v[1:2] END AS v FROM v)
        SELECT kind, i, j, round(mass, 6) AS p, list_transform(v, lambda x: round(x, 5) + 0::double) AS spline FROM w"""
)
def restraint_rows(spark, d):
    found = restraints.restraints(_chosen(spark, d))
    return found.withColumns({"p": F.round("p", 6), "spline": F.transform("spline", lambda x: F.round(x, 5) + 0.0)})


def _matches(spark, d):
    """Suppliers are structures, line numbers their hits."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("structure_id"), F.col("l_linenumber").alias("hit"), F.col("l_linenumber").alias("label"), (F.col("l_orderkey") % 50).cast("int").alias("q"),
        (F.col("l_partkey") % 60).cast("int").alias("t"), (F.col("l_quantity") % 5).cast("int").alias("similarity"), (F.col("l_quantity") % 10).cast("int").alias("confidence"),
    )


def _template_residues(spark, d):
    return table(spark, d, "part").filter("p_size > 10").select((F.col("p_partkey") % 7 + 1).cast("int").alias("label"), (F.col("p_partkey") % 60).cast("int").alias("num"))


_PLACED = """
    m AS (SELECT l_suppkey AS structure_id, l_linenumber AS hit, (l_orderkey % 50)::int AS q, (l_partkey % 60)::int AS t, (l_quantity % 5)::int AS s, (l_quantity % 10)::int AS c FROM lineitem),
    r AS (SELECT DISTINCT (p_partkey % 7 + 1)::int AS label, (p_partkey % 60)::int AS t FROM part WHERE p_size > 10),
    o AS (SELECT m.* FROM m JOIN r ON m.hit = r.label AND m.t = r.t QUALIFY row_number() OVER (PARTITION BY structure_id, hit, m.t ORDER BY q, s, c) = 1),
    u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY structure_id, hit, q ORDER BY t DESC) = 1)"""


@query(f"WITH {_PLACED} SELECT structure_id, hit, q AS pos, [s::double, c::double] AS t1d FROM u")
def template_columns(spark, d):
    return templates.columns(templates.placed(_matches(spark, d), _template_residues(spark, d)))


@query(
    f"""WITH {_PLACED},
        h AS (SELECT DISTINCT structure_id, hit FROM m), f AS (SELECT *, hit * 0.1::double AS prob, structure_id % 100 * 0.01::double AS seqid, hit + 0.5::double AS neff FROM h
              QUALIFY row_number() OVER (PARTITION BY structure_id ORDER BY hit) <= 5),
        g AS (SELECT l_linenumber AS label, (l_suppkey % 60)::int AS t1, (l_partkey // 7 % 60)::int AS t2, max(l_quantity) / 2 AS d, max(l_discount) AS w, max(l_tax) AS v FROM lineitem GROUP BY ALL)
        SELECT x.structure_id, x.hit, x.q AS i, y.q AS j,
               [CASE WHEN d < 2.5::double THEN 0 ELSE least(36, floor((d - 2.5::double) / 0.5::double) + 1) END, w, v, 0, prob, seqid, neff]::double[] AS t2d
        FROM u x JOIN g ON g.label = x.hit AND g.t1 = x.t JOIN u y ON y.structure_id = x.structure_id AND y.hit = x.hit AND y.t = g.t2
        JOIN f ON f.structure_id = x.structure_id AND f.hit = x.hit"""
)
def template_pairs(spark, d):
    matches = templates.placed(_matches(spark, d), _template_residues(spark, d))
    hits = _matches(spark, d).select(*templates.HIT).distinct()
    hits = hits.withColumns({"prob": F.col("hit") * 0.1, "seqid": F.col("structure_id") % 100 * 0.01, "neff": F.col("hit") + 0.5})
    li = table(spark, d, "lineitem")
    geometry = li.groupBy(F.col("l_linenumber").alias("label"), (F.col("l_suppkey") % 60).cast("int").alias("i"), (F.expr("l_partkey div 7") % 60).cast("int").alias("j"))
    geometry = geometry.agg((F.max("l_quantity") / 2).alias("d"), F.max("l_discount").alias("omega"), F.max("l_tax").alias("theta"), F.lit(None).cast("double").alias("phi"))
    return templates.pairs(matches, geometry, templates.first_hits(hits, 5))


@query(
    """SELECT l_returnflag, l_linestatus, l_shipdate::date AS day, sum((l_extendedprice * (1 - l_discount) * 70368744177664)::hugeint)::varchar::double / 70368744177664 AS revenue
       FROM lineitem GROUP BY ALL"""
)
def exact_revenue(spark, d):
    """Not rounded: the sums are exact, so both sides give the same double; the SQL goes by way of text, since a hugeint cast to double is rounded twice."""
    li = table(spark, d, "lineitem")
    rows = li.select("l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return exact_sums.exact_sum(rows, ["l_returnflag", "l_linestatus", "day"], "revenue", "revenue")


def _dihedral(p: str, q: str, r: str, s: str, name: str) -> str:
    """A dihedral of four triples of columns, such as nx, ny, nz, as cross products in SQL."""

    def minus(u, v):
        return [f"({u}{c} - {v}{c})" for c in "xyz"]

    def cross(u, v):
        return [f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]

    def dot(u, v):
        return "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v, strict=True)) + ")"

    one, two, three = minus(q, p), minus(r, q), minus(s, r)
    first, second = cross(one, two), cross(two, three)
    return f"atan2(sqrt({dot(two, two)}) * {dot(one, second)}, {dot(first, second)}) AS {name}"


_ATOMS = ", ".join(f"embedding[{3 * k + i + 1}]::double AS {n}{c}" for k, n in enumerate("nac") for i, c in enumerate("xyz"))
_AROUND = ", ".join([f"lag(c{c}) OVER w AS h{c}, lead(n{c}) OVER w AS m{c}" for c in "xyz"])


@query(
    f"""WITH e AS (SELECT vec_id, label, {_ATOMS} FROM embeddings), k AS (SELECT *, {_AROUND} FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
        t AS (SELECT vec_id, label, {_dihedral("h", "n", "a", "c", "phi")}, {_dihedral("n", "a", "c", "m", "psi")} FROM k)
        SELECT label, vec_id, round(coalesce(phi, 0), 6) AS phi, round(coalesce(psi, 0), 6) AS psi FROM t"""
)
def backbone_torsions(spark, d):
    atoms = [g.point(*[F.col("embedding")[3 * k + i].cast("double") for i in range(3)]).alias(n) for k, n in enumerate(("n", "ca", "c"))]
    residues = table(spark, d, "embeddings").select("label", "vec_id", *atoms)
    return windows.backbone_torsions(residues, "vec_id", ["label"]).select("label", "vec_id", F.round("phi", 6).alias("phi"), F.round("psi", 6).alias("psi"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_partkey BETWEEN 1 AND 9 OR l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'N' AND l_partkey BETWEEN 3 AND 300 THEN 1
       WHEN l_returnflag = 'A' AND l_partkey BETWEEN 5 AND 80 THEN 2 END AS "group" FROM lineitem"""
)
def residue_intervals(spark, d):
    intervals = relational.parse_intervals("(A1-A9,R)(N3-N300)(A80-A5)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", relational.interval_group(F.col("l_returnflag"), F.col("l_partkey"), intervals).alias("group"))


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_returnflag AS chain, (l_partkey % 500)::int AS num, CASE WHEN l_linenumber % 2 = 0 THEN 'O1P' ELSE 'CA' END AS name FROM lineitem),
            t AS (SELECT DISTINCT chr((65 + o_custkey % 14)::int) AS chain, (o_orderkey % 500)::int AS num, CASE WHEN o_custkey % 3 = 0 THEN 'OP1' ELSE 'CA' END AS name FROM orders)
       SELECT l_orderkey, l_linenumber, t.name FROM m JOIN t ON m.chain = t.chain AND m.num = t.num AND replace(m.name, 'O1P', 'OP1') = t.name"""
)
def atoms_by_target_atoms(spark, d):
    """Line items as a model's atoms, orders as a target's, in an older and a newer spelling."""
    m = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("chain"), (F.col("l_partkey") % 500).cast("int").alias("num"), F.lit("A").alias("resname"),
        F.when(F.col("l_linenumber") % 2 == 0, "O1P").otherwise("CA").alias("name"),
    )
    t = table(spark, d, "orders").select(
        F.chr(65 + F.col("o_custkey") % 14).alias("chain"), (F.col("o_orderkey") % 500).cast("int").alias("num"), F.lit("A").alias("resname"), F.when(F.col("o_custkey") % 3 == 0, "OP1").otherwise("CA").alias("name")
    )
    return structures.filter_by_target_atoms(m, t).select("l_orderkey", "l_linenumber", "name")


_NAMES = ("C", "N", "SG", "CA", "P", "O3'")
_NAME = "[{}]".format(", ".join("'" + n.replace("'", "''") + "'" for n in _NAMES))


@query(
    f"""WITH {POINTS},
        n AS (SELECT atom_idx, {_NAME}[(atom_idx % 6 + 1)::int] AS name, CASE WHEN atom_idx % 4 < 3 THEN 'CYS' ELSE 'GLY' END AS res, atom_idx // 25 AS num FROM p)
        SELECT i, k AS j, round(ra + rb - d, 6) AS overlap FROM d JOIN n a ON a.atom_idx = i JOIN n b ON b.atom_idx = k
        WHERE i < k AND d < ra + rb AND ra + rb - d > 0.005::double AND NOT (ca = cb AND a.num = b.num) AND NOT (a.res = 'CYS' AND b.res = 'CYS' AND a.name = 'SG' AND b.name = 'SG')
            AND least(a.name, b.name) || '-' || greatest(a.name, b.name) NOT IN ('C-N', 'O3''-P')"""
)
def clashes_by_chemistry(spark, d):
    """Atoms of several names, twenty-five ids to a residue number: bonds, bridges and residues of their own explain overlaps."""
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("atom_idx") % 6 + 1).cast("int"))
    p = points(spark, d).withColumns({"name": name, "resname": F.when(F.col("atom_idx") % 4 < 3, "CYS").otherwise("GLY"), "num": F.expr("atom_idx div 25").cast("int")})
    return structures.clashes(p, LARGEST_RADIUS, 0.005).withColumn("overlap", F.round("overlap", 6))


_LINE = {
    "n": "(10 + l_quantity % 4)::int", "cols": "CASE WHEN l_partkey % 6 = 0 THEN 9 ELSE (10 + l_quantity % 4)::int END", "identity": "l_orderkey % 130",
}


@query(
    f"""WITH h AS (
            SELECT l_suppkey AS structure_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1)::int AS hit,
                   'T' || lpad((l_partkey % 100000)::varchar, 5, '0') AS label, {_LINE["n"]} AS n, {_LINE["cols"]} AS cols, {_LINE["identity"]} AS identity,
                   l_linenumber - 1 AS q, (l_partkey % 900)::int AS t, (l_linenumber % 5)::int AS s, (l_quantity::int % 10)::int AS c, l_quantity / 100 AS prob FROM lineitem)
        SELECT structure_id::varchar AS structure_id, hit, label, prob, identity / 100.0::double AS seqid, n::bigint AS places, (n * q + n * (n - 1) // 2)::bigint AS q_sum,
               (n * t + n * (n - 1) // 2)::bigint AS t_sum, s AS similarity, c AS confidence FROM h WHERE cols >= 10 AND identity <= 105"""
)
def template_hits(spark, d):
    """Line items as lines of template-hit files, a file for each supplier, parsed and their places matched."""
    #  a file's items are shuffled as numbers, and become lines where the file is
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    files = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("structure_id")).agg(F.array_sort(F.collect_list(order)).alias("h"))
    n = lambda x: (10 + x["l_quantity"] % 4).cast("int")
    start = lambda x: (x["l_partkey"] % 900 + 1).cast("int")
    label = lambda x: F.concat(F.lit("T"), F.lpad((x["l_partkey"] % 100000).cast("string"), 5, "0"))
    span = lambda a, x: F.lpad(F.concat_ws("-", a, a + n(x) - 1), 9, " ")

    def row(x):
        columns = F.when(x["l_partkey"] % 6 == 0, 9).otherwise(n(x))
        return F.concat(F.rpad(F.concat(F.lit("  1 "), label(x), F.lit(" from the table")), 69, " "), F.lpad(columns.cast("string"), 6, " "), span(x["l_linenumber"], x), F.lit(" "), span(start(x), x), F.lit(" (99)"))

    def block(x):
        stats = F.format_string(
            "Probab=%.2f  E-value=1e-30  Score=200.1  Aligned_cols=12  Identities=%d%%  Similarity=0.5  Sum_probs=9.1  Template_Neff=8.0", x["l_quantity"], x["l_orderkey"] % 130
        )
        letters, empty = F.repeat(F.lit("A"), n(x)), F.lit("")
        marks = F.substr(F.lit("=-.+|"), (x["l_linenumber"] % 5 + 1).cast("int"), F.lit(1))
        digit = (x["l_quantity"].cast("int") % 10).cast("string")
        return F.array(
            F.concat(F.lit(">"), label(x)), stats, empty, empty, F.format_string("Q query %d %s 99 (99)", x["l_linenumber"], letters), F.lit("Q Consensus"), F.concat(F.lit(" " * 22), F.repeat(marks, n(x))),
            F.lit("T Consensus"), F.format_string("T %s %d %s 99 (99)", label(x), start(x), letters), F.lit("T ss"), F.lit("x"), F.concat(F.rpad(F.lit("Confidence"), 22, " "), F.repeat(digit, n(x))), empty,
        )

    lines = F.concat(F.array(F.lit("Query q"), F.lit(""), F.lit(" No Hit")), F.transform("h", row), F.array(F.lit("")), F.flatten(F.transform("h", block)))
    hits = sequences.parse_hit_files(files.select("structure_id", lines.alias("lines")))
    places = sequences.hit_matches(hits, also=["prob", "seqid"]).groupBy("structure_id", "hit", "label", "prob", "seqid")
    return places.agg(
        F.count("*").alias("places"), F.sum("q").alias("q_sum"), F.sum("t").alias("t_sum"), F.max("similarity").alias("similarity"), F.max("confidence").alias("confidence")
    )


@query(
    """SELECT 'query' AS command, p_name, p_brand, p_size FROM part WHERE p_brand = 'Brand#12' UNION ALL SELECT 'delete', p_name, p_brand, p_size FROM part WHERE p_size IS DISTINCT FROM 15"""
)
def store_dispatched(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size")
    found = store.dispatch(parts, "query", {"col_name": "p_brand", "content": "Brand#12"})[1]
    left = store.dispatch(parts, "delete", {"col_name": "p_size", "content": 15})[1]
    return found.select(F.lit("query").alias("command"), "p_name", "p_brand", "p_size").unionByName(left.select(F.lit("delete").alias("command"), "p_name", "p_brand", "p_size"))
