"""Atom, residue, ordering and template queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import arrays as a
from helixframe.functions import geometry as g
from helixframe.operators import contacts, msa, relational, restraints, scoring, selection, structures, windows
from helixframe.plans.registry import query
from helixframe.plans.tables import PROFILE, contacts_sql, points, profile, table
from helixframe.plans.tables import contacts as contact_rows

_ATOMS = """k AS (
    SELECT l_orderkey AS num, 'A' AS chain, (l_linenumber * 1000000 + l_partkey)::bigint AS atom_idx,
           CASE l_partkey % 6 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' WHEN 3 THEN 'O' WHEN 4 THEN 'CB' ELSE 'H1' END AS name, l_quantity AS bfactor FROM lineitem)"""


def _atoms(spark, d):
    key = F.col("l_partkey") % 6
    name = F.when(key == 0, "N").when(key == 1, "CA").when(key == 2, "C").when(key == 3, "O").when(key == 4, "CB").otherwise("H1")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("num"), F.lit("A").alias("chain"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("atom_idx"), name.alias("name"),
        F.col("l_quantity").alias("bfactor"), F.lit("GLY").alias("resname"),
    )


@query(
    f"""WITH {_ATOMS} SELECT num, CASE WHEN num % 3 = 0 THEN 1 WHEN num % 3 = 1 THEN 2 WHEN count(*) FILTER (name IN ('N', 'CA', 'C', 'O')) >= 3 THEN 1 ELSE 0 END AS molecule_class
        FROM k GROUP BY num"""
)
def molecule_class(spark, d):
    named = F.when(F.col("num") % 3 == 0, "GLY").when(F.col("num") % 3 == 1, "U").otherwise("UNK")
    return structures.molecule_classes(_atoms(spark, d).withColumn("resname", named)).select("num", "molecule_class").distinct()


@query(f"WITH {_ATOMS} SELECT num, list_sort(list(atom_idx)) AS indices FROM k GROUP BY num")
def residue_indices(spark, d):
    return structures.residue_atoms(_atoms(spark, d)).select("num", "indices")


@query(f"WITH {_ATOMS} SELECT num, atom_idx, name FROM k WHERE name = 'CA'")
def atoms_by_name(spark, d):
    return structures.filter_by_name(_atoms(spark, d), "CA").select("num", "atom_idx", "name")


@query(f"WITH {_ATOMS} SELECT num, atom_idx FROM k WHERE num IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def atoms_by_target(spark, d):
    target = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.lit("A").alias("chain"), F.col("o_orderkey").alias("num"))
    return structures.filter_by_target(_atoms(spark, d), target).select("num", "atom_idx")


@query(f"WITH {_ATOMS} SELECT num, round(avg(bfactor), 6) AS bfactor FROM k GROUP BY num")
def mean_bfactor(spark, d):
    return structures.mean_bfactor(_atoms(spark, d)).select("num", F.round("bfactor", 6).alias("bfactor"))


@query(f"WITH {_ATOMS} SELECT num, atom_idx FROM k UNION ALL SELECT num, atom_idx FROM k WHERE name = 'N'")
def atoms_merged(spark, d):
    rows = _atoms(spark, d)
    return structures.merge_atoms(rows, structures.filter_by_name(rows, "N")).select("num", "atom_idx")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'MACHINERY' THEN 'B' ELSE c_mktsegment END AS chain FROM customer")
def rename_chains(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("chain"))
    return structures.rename_chains(rows, {"BUILDING": "A", "MACHINERY": "B"})


@query("SELECT c_custkey, chr((64 + dense_rank() OVER (ORDER BY c_mktsegment))::int) AS chain FROM customer")
def letter_chains(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("chain"))
    return structures.letter_chains(rows)


@query("SELECT o_orderkey, c_nationkey AS num FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 10")
def renumbered(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("A").alias("chain"), F.col("o_custkey").alias("num"))
    mapping = table(spark, d, "customer").filter("c_nationkey < 10").select(
        F.lit("A").alias("chain"), F.col("c_custkey").alias("num"), F.lit("B").alias("new_chain"), F.col("c_nationkey").alias("new_num"), F.lit("X").alias("new_name")
    )
    return structures.renumber(rows, mapping).select("o_orderkey", "num")


_LINE = """p AS (SELECT vec_id AS num, label AS chain, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings),
    q AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(z) OVER w AS bz, lead(x) OVER w AS ax, lead(y) OVER w AS ay, lead(z) OVER w AS az FROM p WINDOW w AS (PARTITION BY chain ORDER BY num))"""


@query(
    f"""WITH {_LINE} SELECT num, coalesce(sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_) + (z - bz) * (z - bz)) > 0.3::double, false)
        OR coalesce(sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay) + (z - az) * (z - az)) > 0.3::double, false) AS broken FROM q"""
)
def chain_breaks(spark, d):
    rows = points(spark, d).select(F.col("atom_idx").alias("num"), "chain", "p")
    return windows.chain_breaks(rows, keys=["chain"], longest=0.3).select("num", "broken")


@query(
    """WITH p AS (SELECT vec_id AS i, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings), n AS (SELECT count(*) AS n FROM p),
       k AS (SELECT a.i, b.i AS j, (b.i - a.i + n.n) % n.n AS ahead FROM p a, p b, n WHERE a.i <> b.i AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 0.07::double)
       SELECT i AS "from", arg_min(j, ahead) AS "to" FROM k GROUP BY i"""
)
def first_bonds(spark, d):
    rows = points(spark, d).select(F.col("atom_idx").alias("idx"), "p")
    counted = rows.join(F.broadcast(rows.agg(F.count("*").alias("n"))), F.lit(True))
    return structures.bonds(counted, counted, 0.07)


@query(
    """WITH RECURSIVE k AS (SELECT conv_id * 1000 + turn AS idx, CASE WHEN turn % 3 <> 0 THEN conv_id * 1000 + turn - 1 END AS up FROM conversations),
       r AS (SELECT idx, idx AS root, 0 AS depth FROM k WHERE up IS NULL OR up NOT IN (SELECT idx FROM k) UNION ALL SELECT k.idx, r.root, r.depth + 1 FROM k JOIN r ON k.up = r.idx)
       SELECT idx, root, depth FROM r"""
)
def topological_order(spark, d):
    nodes = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "turn")
    links = nodes.filter("turn % 3 <> 0").select((F.col("idx") - 1).alias("from"), F.col("idx").alias("to"))
    return structures.topological_order(links, nodes.select("idx"))


@query(
    """WITH q AS (SELECT [l_partkey % 50, l_suppkey % 50, (l_orderkey % 50), l_linenumber % 50] AS q FROM lineitem),
       e AS (SELECT unnest(q) AS node, q FROM q), p AS (SELECT node, unnest(q) AS other FROM e)
       SELECT node, list_sort(list(DISTINCT other)) AS neighbours FROM p WHERE node <> other GROUP BY node"""
)
def neighbour_graph(spark, d):
    rows = table(spark, d, "lineitem")
    quadruple = F.array(*[(F.col(c) % 50).cast("long") for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")])
    return structures.neighbour_graph(rows.select(quadruple.alias("quadruple")))


@query(
    """WITH c AS (SELECT item_id, unnest(range(1, length(text) + 1)) AS pos, text FROM benchmark),
       m AS (SELECT item_id, pos - 1 AS pos, substr(text, pos, 1) <> ' ' AS is_match FROM c)
       SELECT item_id, pos, CASE WHEN is_match THEN (5 + sum(CASE WHEN is_match THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos) - 1)::bigint END AS match FROM m"""
)
def match_index(spark, d):
    return windows.match_index(_columns(spark, d), F.col("letter") != " ", "pos", F.lit(5), ["item_id"]).select("item_id", "pos", "match")


def _columns(spark, d):
    letters = F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(letters).alias("pos", "letter")).withColumn("pos", F.col("pos").cast("long"))


@query(
    """WITH c AS (SELECT item_id, unnest(range(1, length(text) + 1)) AS pos, text FROM benchmark),
       m AS (SELECT item_id, pos, substr(text, pos, 1) <> ' ' AS k FROM c), s AS (SELECT *, sum(CASE WHEN k THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos) AS n FROM m)
       SELECT item_id, (CASE WHEN k THEN n - 1 ELSE n END)::bigint AS pos, sum(CASE WHEN k THEN 0 ELSE 1 END)::bigint AS inserted FROM s GROUP BY ALL"""
)
def insertion_counts(spark, d):
    return windows.insertion_counts(_columns(spark, d), F.col("letter") != " ", "pos", ["item_id"])


@query(f"WITH {PROFILE} SELECT chain, num, CASE WHEN difference > 0 AND reference > 0 THEN round(difference / reference, 6) ELSE least(difference, reference) END AS score FROM f")
def ratio_zip(spark, d):
    rows = profile(spark, d)
    top, low = (rows.select("chain", "num", F.col(c).alias("score")) for c in ("difference", "reference"))
    return relational.ratio_zip(top, low, ["chain", "num"], "score").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {contacts_sql()}, t AS (SELECT a_num AS t1, b_num AS t2, round(sum(area), 2) AS v FROM c GROUP BY ALL), m AS (SELECT n_nationkey AS t, n_nationkey * 2 + 1 AS q FROM nation)
        SELECT x.q AS i, y.q AS j, t.v FROM t JOIN m x ON t.t1 = x.t JOIN m y ON t.t2 = y.t"""
)
def scattered_template(spark, d):
    template = contact_rows(spark, d).groupBy(F.col("a_num").alias("t1"), F.col("b_num").alias("t2")).agg(F.round(F.sum("area"), 2).alias("v"))
    matches = table(spark, d, "nation").select(F.col("n_nationkey").alias("t"), (F.col("n_nationkey") * 2 + 1).alias("q"))
    return msa.scattered_template(template, matches)


@query(
    """WITH k AS (SELECT s_nationkey, s_suppkey AS e_value, (s_acctbal / 2)::int AS n75, s_acctbal::int AS n50 FROM supplier),
       r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY e_value) AS o, count(*) OVER (PARTITION BY s_nationkey) AS n FROM k),
       c AS (SELECT *, CASE WHEN n75 > 2000 THEN 75 WHEN n50 > 5000 THEN 50 WHEN o = n THEN 50 END AS coverage FROM r)
       SELECT s_nationkey, e_value, coverage FROM c WHERE coverage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY o) = 1"""
)
def coverage_choice(spark, d):
    rows = table(spark, d, "supplier").select(
        "s_nationkey", F.col("s_suppkey").alias("e_value"), F.round(F.col("s_acctbal") / 2).cast("int").alias("n75"), F.round("s_acctbal").cast("int").alias("n50")
    )
    return msa.coverage_choice(rows, ["s_nationkey"]).select("s_nationkey", "e_value", "coverage")


@query("SELECT vec_id, round((embedding[1]::double + embedding[3]::double), 6) AS helix, round(embedding[2]::double + embedding[4]::double + embedding[5]::double, 6) AS rest FROM embeddings")
def collapsed_states(spark, d):
    states = a.collapsed(F.transform("embedding", lambda x: x.cast("double")), [[0, 2], [1, 3, 4]])
    return table(spark, d, "embeddings").select("vec_id", states.alias("s")).select("vec_id", F.round(F.col("s")[0], 6).alias("helix"), F.round(F.col("s")[1], 6).alias("rest"))


@query(
    """SELECT event_id, CASE WHEN u <= 0.135::double THEN 0 WHEN u <= 0.29::double THEN 1 WHEN u <= 0.363::double THEN 2 WHEN u <= 0.485::double THEN 3 WHEN u <= 0.982::double THEN 4 ELSE 5 END AS bin
       FROM (SELECT event_id, event_id % 1000 / 1000.0::double AS u FROM events)"""
)
def torsion_bins(spark, d):
    return table(spark, d, "events").select("event_id", restraints.torsion_bin(F.col("event_id") % 1000 / 1000.0).alias("bin"))


@query(
    """SELECT a.vec_id, CASE WHEN abs(a.vec_id % 25 - a.label) < 8 THEN 0 ELSE a.embedding[1]::double END AS masked,
              least(least(a.vec_id % 20, 19 - a.vec_id % 20) + 1, least(a.label, 19 - a.label) + 1, 6)::int AS weight FROM embeddings a"""
)
def masks(spark, d):
    rows = table(spark, d, "embeddings")
    masked = a.band_masked(F.col("vec_id") % 25, F.col("label"), F.col("embedding")[0].cast("double"))
    return rows.select("vec_id", masked.alias("masked"), a.pyramid_weight(F.col("vec_id") % 20, F.col("label"), 20, 20).alias("weight"))


@query(
    """WITH p AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z, 0.3::double AS ra, 0.2::double AS rb FROM embeddings),
       d AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM p), o AS (SELECT *, (d * d + ra * ra - rb * rb) / (2 * d) AS off FROM d WHERE d > 0 AND d <= ra + rb AND d >= abs(ra - rb))
       SELECT vec_id, round(sqrt(ra * ra - off * off), 6) AS radius, round(atan2(sqrt(ra * ra - off * off), off), 6) AS angle FROM o"""
)
def intersection_circle(spark, d):
    zero = g.point(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    rows = points(spark, d).select(F.col("atom_idx").alias("vec_id"), g.intersection_circle(zero, F.lit(0.3), F.col("p"), F.lit(0.2)).alias("c")).filter("c is not null")
    return rows.select("vec_id", F.round("c.radius", 6).alias("radius"), F.round("c.angle", 6).alias("angle"))


@query("SELECT r_name AS target, n_name AS model FROM region, nation")
def comparison_pairs(spark, d):
    return scoring.comparison_pairs(table(spark, d, "region").withColumnRenamed("r_name", "target"), table(spark, d, "nation").withColumnRenamed("n_name", "model"))


@query(
    """WITH k AS (SELECT label AS t, vec_id % 6 AS m, avg(embedding[1]::double) AS v FROM embeddings GROUP BY ALL)
       SELECT t, a.m AS a, b.m AS b, round(1 - (a.v + b.v) / 2, 6) AS distance FROM k a JOIN k b USING (t) WHERE a.m <> b.m"""
)
def model_distances(spark, d):
    means = table(spark, d, "embeddings").groupBy(F.col("label").alias("t"), (F.col("vec_id") % 6).alias("m")).agg(F.avg(F.col("embedding")[0].cast("double")).alias("v"))
    pairs = means.select("t", F.col("m").alias("a"), F.col("v").alias("l1")).join(means.select("t", F.col("m").alias("b"), F.col("v").alias("l2")), "t").filter("a < b")
    return selection.model_distances(pairs, ["t"]).withColumn("distance", F.round("distance", 6))


@query()
def model_clusters(spark, d):
    return selection.clustered(model_distances(spark, d), "t", 3)


@query(
    """WITH RECURSIVE p AS (SELECT label AS t, vec_id % 6 AS m, avg(embedding[1]::double) AS v FROM embeddings GROUP BY ALL),
       d AS (SELECT x.t, x.m AS a, y.m AS b, round(1 - (x.v + y.v) / 2, 6) AS distance FROM p x JOIN p y USING (t) WHERE x.m < y.m),
       e AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY distance, a, b) AS r FROM d),
       s AS (SELECT t, a, b, r FROM e UNION ALL SELECT t, b, a, r FROM e),
       c AS (SELECT DISTINCT p.t, e.r, p.m AS a, p.m AS b FROM p JOIN (SELECT t, r FROM e UNION ALL SELECT DISTINCT t, 0 FROM e) e USING (t)
             UNION SELECT c.t, c.r, c.a, s.b FROM c JOIN s ON s.t = c.t AND s.a = c.b AND s.r <= c.r),
       l AS (SELECT t, r, a AS model, min(b) AS least FROM c GROUP BY ALL),
       n AS (SELECT t, r FROM l GROUP BY t, r HAVING count(DISTINCT least) <= 3 QUALIFY row_number() OVER (PARTITION BY t ORDER BY r) = 1)
       SELECT l.t, model, (dense_rank() OVER (PARTITION BY l.t ORDER BY least) - 1)::int AS cluster FROM l JOIN n ON l.t = n.t AND l.r = n.r"""
)
def model_single_linkage(spark, d):
    return selection.clustered(model_distances(spark, d), "t", 3, "single")


@query(
    """WITH e AS (SELECT item_id, text, generate_subscripts(regexp_extract_all(text, '[a-z]*[^a-z]'), 1) - 1 AS pos, unnest(regexp_extract_all(text, '([a-z]*)[^a-z]', 1)) AS run FROM benchmark)
       SELECT pos, round(avg(CASE WHEN length(run) > 0 THEN 1.0::double ELSE 0.0::double END), 6) AS rate FROM e GROUP BY pos"""
)
def insertion_rate(spark, d):
    runs = F.regexp_extract_all("text", F.lit("([a-z]*)[^a-z]"), F.lit(1))
    rows = table(spark, d, "benchmark").select(F.transform(runs, lambda r: F.length(r)).alias("insertions"))
    return msa.insertion_rate(rows).select(F.col("pos").cast("long").alias("pos"), F.round("rate", 6).alias("rate"))


@query(f"WITH {contacts_sql()} SELECT * FROM c WHERE NOT (a_chain = b_chain AND a_num = b_num) AND class = 'SS'")
def contacts_side_only(spark, d):
    return contacts.accepted_contacts(contact_rows(spark, d), "inter_residue", side_only=True)
