"""Contact-algebra and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import contacts as c
from helixframe.operators import relational, scoring, structures, windows
from helixframe.plans.registry import query
from helixframe.plans.tables import MERGED, PROFILE, contacts, contacts_sql, profile, sides, table

C = contacts_sql()
_ENDS = "a_chain, a_num, b_chain, b_num, class"


def _rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def merged(spark, d, binarize=False):
    return c.combined(*sides(spark, d), binarize=binarize)


@query(
    """WITH k AS (
           SELECT p_partkey AS i, chr((65 + p_partkey % 3)::int) AS chain, (p_partkey % 97)::int AS num,
                  CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'CB' END AS name, p_partkey % 4 <> 3 AS main FROM part),
       j AS (
           SELECT a.chain AS a_chain, a.num AS a_num, b.chain AS b_chain, b.num AS b_num, l.l_extendedprice::decimal(14,2) AS area, a.i = b.i AS own,
                  CASE WHEN a.main THEN ['A', 'M'] ELSE ['A', 'S'] END AS ka, CASE WHEN b.main THEN ['A', 'M'] ELSE ['A', 'S'] END AS kb,
                  a.chain = b.chain AND abs(a.num - b.num) = 1 AND CASE WHEN b.num > a.num THEN a.name = 'C' AND b.name = 'N' ELSE a.name = 'N' AND b.name = 'C' END AS bonded
           FROM lineitem l JOIN k a ON l.l_partkey = a.i JOIN k b ON l.l_suppkey = b.i),
       x AS (
           SELECT *, unnest(CASE WHEN own THEN list_transform(ka, lambda u: u || 'W') ELSE flatten(list_transform(ka, lambda u: list_transform(kb, lambda v: u || v))) END) AS class
           FROM j WHERE own OR (NOT (a_chain = b_chain AND a_num = b_num) AND NOT bonded))
       SELECT a_chain, a_num, b_chain, b_num, class, sum(area)::double AS area FROM x GROUP BY ALL"""
)
def contacts_residue(spark, d):
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, "N").when(key % 4 == 1, "CA").when(key % 4 == 2, "C").otherwise("CB")
    atoms = table(spark, d, "part").select(
        key.alias("atom_idx"), F.chr(65 + key % 3).alias("chain"), (key % 97).cast("int").alias("num"), name.alias("name"), (key % 4 != 3).alias("main")
    )
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_extendedprice").cast("decimal(14,2)").alias("area"))
    return c.residue_contacts(pairs, atoms).withColumn("area", F.col("area").cast("double"))


@query(f"WITH {MERGED} SELECT * FROM j")
def contacts_combined(spark, d):
    return merged(spark, d)


@query(f"WITH {MERGED} SELECT {_ENDS}, CASE WHEN t_area > 0 THEN 1.0::double ELSE 0.0::double END AS t_area, CASE WHEN m_area > 0 THEN 1.0::double ELSE 0.0::double END AS m_area FROM j")
def contacts_binarized(spark, d):
    return merged(spark, d, binarize=True)


_DIFFERENCES = {0: ("least(abs(t_area - m_area), t_area)", "t_area"), 1: ("abs(t_area - m_area)", "t_area"), 2: ("abs(t_area - m_area)", "t_area + m_area"), 3: ("t_area - m_area", "t_area")}


def _profile_sql(kind: int) -> str:
    diff, ref = _DIFFERENCES[kind]
    return f"{MERGED}, f AS (SELECT a_chain AS chain, a_num AS num, class, sum({diff}) AS difference, sum({ref}) AS reference FROM j GROUP BY ALL)"


def _profile_query(kind: int):
    def f(spark, d):
        return _rounded(scoring.profile(merged(spark, d), kind), "difference", "reference", digits=3)

    f.__name__ = f"cad_profile_type{kind}"
    return query(f"WITH {_profile_sql(kind)} SELECT chain, num, class, round(difference, 3) AS difference, round(reference, 3) AS reference FROM f")(f)


for _kind in _DIFFERENCES:
    _profile_query(_kind)


def _global_sql(diff: str) -> str:
    return f"""
    WITH {_profile_sql(1)}, g AS (
        SELECT class, coalesce(sum({diff}) FILTER (reference > 0), 0) AS difference, coalesce(sum(reference) FILTER (reference > 0), 0) AS reference,
               count(*) FILTER (reference > 0) AS residues FROM f GROUP BY class)
    SELECT class, round(difference, 2) AS difference, round(reference, 2) AS reference, residues,
           round(CASE WHEN reference > 0 THEN 1 - difference / reference ELSE 0 END, 6) AS score FROM g"""


def _globals(spark, d, minimum):
    scores = scoring.global_scores(scoring.profile(merged(spark, d), 1), minimum)
    return _rounded(_rounded(scores, "difference", "reference", digits=2), "score", digits=6)


@query(_global_sql("difference"))
def cad_global(spark, d):
    return _globals(spark, d, False)


@query(_global_sql("least(difference, reference)"))
def cad_global_min(spark, d):
    return _globals(spark, d, True)


_LIMB = "17592186044416"  # areas are whole multiples of its reciprocal


def _exact(value: str) -> str:
    return f"sum(({value} * {_LIMB})::hugeint)::varchar::double / {_LIMB}"


@query(
    f"""WITH {MERGED}, f AS (SELECT a_chain, a_num, class, {_exact("abs(t_area - m_area)")} AS difference, {_exact("t_area")} AS reference FROM j GROUP BY ALL),
        g AS (
            SELECT class, coalesce({_exact("CASE WHEN reference > 0 THEN difference END")}, 0) AS difference, coalesce({_exact("CASE WHEN reference > 0 THEN reference END")}, 0) AS reference,
                   count(*) FILTER (reference > 0) AS residues FROM f GROUP BY class)
        SELECT *, CASE WHEN reference > 0 THEN 1 - difference / reference ELSE 0 END AS score FROM g"""
)
def cad_global_exact(spark, d):
    """Not rounded: every sum is exact."""
    return scoring.global_scores(scoring.profile(merged(spark, d), 1, exact=True), exact=True)


def _residue_counts(spark, d, status):
    return contacts(spark, d, status).groupBy(F.col("a_chain").alias("chain"), F.col("a_num").alias("num")).agg(F.count("*").alias("atoms"))


@query(
    f"""WITH {_profile_sql(0)}, u AS (SELECT DISTINCT chain, num FROM f WHERE reference > 0),
        b AS (SELECT 'target' AS side, a_chain AS chain, a_num AS num, count(*) AS atoms FROM t GROUP BY ALL UNION ALL SELECT 'model', a_chain, a_num, count(*) FROM m GROUP BY ALL),
        s AS (SELECT side, count(*) AS residues, sum(atoms) AS atoms, count(u.chain) AS used_residues, coalesce(sum(atoms) FILTER (u.chain IS NOT NULL), 0) AS used_atoms
              FROM b LEFT JOIN u ON b.chain = u.chain AND b.num = u.num GROUP BY side)
        SELECT side || '_' || name AS name, value::bigint AS value FROM (UNPIVOT s ON residues, atoms, used_residues, used_atoms INTO NAME name VALUE value)"""
)
def cad_size(spark, d):
    return scoring.size_scores(_residue_counts(spark, d, "O"), _residue_counts(spark, d, "F"), scoring.profile(merged(spark, d), 0))


def _atoms(spark, d, status):
    li = table(spark, d, "lineitem").filter(F.col("l_linestatus") == status)
    return li.select(
        F.chr(65 + F.col("l_partkey") % 3).alias("a_chain"), (F.col("l_partkey") % 97).cast("int").alias("a_num"), F.col("l_returnflag").alias("a_atom"),
        F.chr(65 + F.col("l_suppkey") % 3).alias("b_chain"), (F.col("l_suppkey") % 97).cast("int").alias("b_num"), F.lit("C").alias("b_atom"),
        F.col("l_quantity").alias("area"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity")).alias("ordinal"),
    )


def _atoms_sql(name: str, status: str) -> str:
    return f"""{name} AS (
        SELECT chr((65 + l_partkey % 3)::int) AS a_chain, (l_partkey % 97)::int AS a_num, l_returnflag AS a_atom, chr((65 + l_suppkey % 3)::int) AS b_chain,
               (l_suppkey % 97)::int AS b_num, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) AS area
        FROM lineitem WHERE l_linestatus = '{status}' GROUP BY ALL)"""


@query(
    f"""WITH {_atoms_sql("t", "O")}, {_atoms_sql("m", "F")},
        j AS (
            SELECT coalesce(t.a_chain, m.a_chain) AS a_chain, coalesce(t.a_num, m.a_num) AS a_num, coalesce(t.a_atom, m.a_atom) AS a_atom,
                   coalesce(t.b_chain, m.b_chain) AS b_chain, coalesce(t.b_num, m.b_num) AS b_num, coalesce(t.area, 0) AS t_area, coalesce(m.area, 0) AS m_area
            FROM t FULL JOIN m ON t.a_chain = m.a_chain AND t.a_num = m.a_num AND t.a_atom = m.a_atom AND t.b_chain = m.b_chain AND t.b_num = m.b_num),
        s AS (SELECT a_chain, a_num, a_atom, sum(least(abs(t_area - m_area), t_area)) AS difference, sum(t_area) AS reference FROM j
              WHERE NOT (a_chain = b_chain AND a_num = b_num) GROUP BY ALL)
        SELECT *, CASE WHEN reference > 0 THEN round(difference / reference * 100, 6) ELSE -2 END AS value FROM s"""
)
def cad_atomic(spark, d):
    return _rounded(scoring.atom_scores(c.combined_atoms(_atoms(spark, d, "O"), _atoms(spark, d, "F"))), "value", digits=6)


def _orders(spark, d):
    """Line items as contacts of their orders' residues: an order's own chain touches the chains of its parts."""
    items = table(spark, d, "lineitem")
    own, other = F.chr(65 + F.col("l_orderkey") % 3), F.chr(65 + F.col("l_partkey") % 3)
    kind = F.when((own == other) & (F.col("l_linenumber") == 1), "AW").when(F.col("l_returnflag") == "A", "AA").otherwise("SS")
    rows = items.select(own.alias("a_chain"), F.col("l_orderkey").alias("a_num"), other.alias("b_chain"), F.col("l_orderkey").alias("b_num"), kind.alias("class"), "l_quantity")
    return rows.groupBy("a_chain", "a_num", "b_chain", "b_num", "class").agg(F.sum("l_quantity").alias("area"))


_ORDERS = """k AS (
    SELECT chr((65 + l_orderkey % 3)::int) AS a_chain, l_orderkey AS a_num, chr((65 + l_partkey % 3)::int) AS b_chain, l_orderkey AS b_num,
           CASE WHEN l_orderkey % 3 = l_partkey % 3 AND l_linenumber = 1 THEN 'AW' WHEN l_returnflag = 'A' THEN 'AA' ELSE 'SS' END AS class, sum(l_quantity) AS area
    FROM lineitem GROUP BY ALL)"""
_EXPOSED = "SELECT a_chain, a_num FROM k WHERE class = 'AW' AND a_chain = b_chain AND a_num = b_num"
_CORE = f"SELECT * FROM k WHERE (a_chain, a_num) NOT IN ({_EXPOSED}) AND (b_chain, b_num) NOT IN ({_EXPOSED})"
_ZONE = "(SELECT a_chain, a_num FROM {k} WHERE a_chain <> b_chain UNION SELECT b_chain, b_num FROM {k} WHERE a_chain <> b_chain)"


@query(f"WITH {_ORDERS} {_CORE}")
def contacts_core(spark, d):
    return c.core(_orders(spark, d))


@query(f"WITH {_ORDERS} SELECT * FROM k WHERE (a_chain, a_num) IN {_ZONE.format(k='k')} AND (b_chain, b_num) IN {_ZONE.format(k='k')}")
def contacts_zone(spark, d):
    return c.interface_zone(_orders(spark, d))


@query(f"WITH {C} SELECT * FROM c WHERE a_chain <> b_chain")
def contacts_interchain(spark, d):
    return c.inter_chain(contacts(spark, d))


_GROUP = "CASE WHEN ({e}_chain = 'A' AND {e}_num BETWEEN 1 AND 40) OR ({e}_chain = 'B' AND {e}_num = 3) THEN 0 WHEN {e}_chain = 'C' THEN 1 WHEN {e}_chain = 'B' AND {e}_num BETWEEN 3 AND 8 THEN 2 END"


@query(f"WITH {C} SELECT * FROM c WHERE {_GROUP.format(e='a')} <> {_GROUP.format(e='b')}")
def contacts_interval(spark, d):
    return c.inter_interval(contacts(spark, d), relational.parse_intervals("(A1-A40, B3)(C)(B3-B8)"))


@query(
    f"""WITH {_ORDERS}, o AS ({_CORE}), z AS (SELECT * FROM o WHERE (a_chain, a_num) IN {_ZONE.format(k="o")} AND (b_chain, b_num) IN {_ZONE.format(k="o")})
        SELECT * FROM z WHERE a_chain <> b_chain AND a_chain IN ('A', 'B') AND b_chain IN ('A', 'B')"""
)
def contacts_filtered(spark, d):
    return c.filtered(_orders(spark, d), core_only=True, zone=True, across=True, intervals=relational.parse_intervals("(A)(B)"))


@query(
    f"""WITH {C}, k AS (SELECT * FROM c WHERE a_chain <> b_chain), r AS (SELECT a_chain AS ch, a_num AS nu FROM k UNION SELECT b_chain, b_num FROM k)
        SELECT * FROM k UNION ALL SELECT * FROM c WHERE a_chain = b_chain AND a_num = b_num AND (a_chain, a_num) IN (SELECT ch, nu FROM r)"""
)
def contacts_reflexive(spark, d):
    rows = contacts(spark, d)
    return c.with_reflexive(c.inter_chain(rows), rows)


@query(
    f"""WITH {C} SELECT CASE WHEN class = 'AW' THEN 'sas' ELSE 'all_' || class END AS name, round(sum(area), 2) AS area FROM c GROUP BY class
        UNION ALL SELECT 'inter_chain_' || a_chain || '_' || b_chain || '_' || class, round(sum(area), 2) FROM c WHERE a_chain <> b_chain GROUP BY a_chain, b_chain, class"""
)
def contacts_summary(spark, d):
    return _rounded(c.summary(contacts(spark, d)), "area", digits=2)


@query(
    f"""WITH {C}, x AS (SELECT a_chain, a_num, unnest([class || '_exposed', class || '_exposed_to_' || b_chain]) AS class, area FROM c WHERE a_chain <> b_chain)
        SELECT a_chain, a_num, b_chain, b_num, class, round(area, 2) AS area FROM c
        UNION ALL SELECT a_chain, a_num, a_chain, a_num, class, round(sum(area), 2) FROM x GROUP BY a_chain, a_num, class"""
)
def contacts_exposure(spark, d):
    return _rounded(c.exposure(contacts(spark, d)), "area", digits=2)


@query(f"WITH {C} SELECT a_chain || lpad(a_num::varchar, 5, '0') AS \"from\", b_chain || lpad(b_num::varchar, 5, '0') AS \"to\", ceil(area * 100)::bigint AS weight FROM c WHERE NOT (a_chain = b_chain AND a_num = b_num)")
def contacts_graph(spark, d):
    return c.graph_edges(contacts(spark, d))


@query(f"WITH {C} SELECT DISTINCT unnest([a_chain, b_chain]) AS chain FROM c")
def chain_names(spark, d):
    return c.chain_names(contacts(spark, d))


@query(f"WITH {C}, p AS (SELECT a_chain, a_num, b_chain, b_num, class FROM c) SELECT * FROM p UNION SELECT b_chain, b_num, a_chain, a_num, class FROM p")
def contacts_both_ways(spark, d):
    end = lambda e: F.struct(F.col(f"{e}_chain").alias("chain"), F.col(f"{e}_num").alias("num")).alias(e)
    turned = relational.both_ways(contacts(spark, d).select(end("a"), end("b"), "class"))
    return turned.select(*[F.col(f"{e}.{x}").alias(f"{e}_{x}") for e in "ab" for x in ("chain", "num")], "class")


@query("SELECT user_id AS num, arg_max(event_type, event_id) AS name, count(*) AS atoms FROM events GROUP BY user_id")
def residue_collect(spark, d):
    rows = table(spark, d, "events").select(F.lit("A").alias("chain"), F.col("user_id").alias("num"), F.col("event_type").alias("resname"), F.col("event_id").alias("atom_idx"))
    return structures.residues(rows).drop("chain")


def _local_sql(value: str, name: str) -> str:
    """CTEs that end in name(chain, num, score)."""
    return f"""
        {name}s AS (SELECT chain, num, CASE WHEN reference > 0 THEN {value} ELSE -3 END AS score FROM f),
        {name}q AS (SELECT chain, min(num) AS lo, max(num) AS hi FROM {name}s GROUP BY chain),
        {name}g AS (SELECT chain, unnest(range(lo, hi + 1))::int AS num FROM {name}q),
        {name}o AS (SELECT min(chain) AS first FROM {name}s),
        {name} AS (
            SELECT g.chain, g.num, CASE WHEN g.num = 0 AND g.chain > o.first THEN -2 ELSE coalesce(s.score, -1) END AS score
            FROM {name}g g LEFT JOIN {name}s s ON g.chain = s.chain AND g.num = s.num, {name}o o
            UNION ALL SELECT q.chain, 0, -2 FROM {name}q q, {name}o o WHERE q.chain > o.first AND q.lo > 0)"""


def _blur_sql(source: str, name: str, width: int) -> str:
    """CTEs that end in name(chain, num, score): on each side the last valid value is held, from the nearest entry on."""
    steps, last = [], source
    for way in ("lag", "lead"):
        held = "score"
        for k in range(1, width + 1):
            near = f"{way}(score, {k}) OVER w"
            here = f"{way}{k}"
            steps.append(
                f"{name}{here} AS (SELECT *, CASE WHEN abs({way}(num, {k}) OVER w - num) <= {width} AND {near} > 0 THEN {near} ELSE {held} END AS {here} FROM {last} WINDOW w AS (PARTITION BY chain ORDER BY num))"
            )
            held, last = here, f"{name}{here}"
    total = " + ".join(f"{way}{k}" for way in ("lag", "lead") for k in range(1, width + 1))
    steps.append(f"{name} AS (SELECT chain, num, CASE WHEN score >= 0 THEN (score + {total}) / {1 + 2 * width} ELSE score END AS score FROM {last})")
    return ", ".join(steps)


@query(f"WITH {PROFILE}, {_local_sql('difference / reference', 'z')} SELECT chain, num, round(score, 6) AS score FROM z")
def local_scores(spark, d):
    return _rounded(scoring.local_scores(profile(spark, d)), "score", digits=6)


@query(f"WITH {PROFILE}, {_local_sql('difference / reference', 'z')}, {_blur_sql('z', 'y', 3)} SELECT chain, num, round(score, 6) AS score FROM y")
def blur_w3(spark, d):
    return _rounded(scoring.blurred(scoring.local_scores(profile(spark, d)), 3), "score", digits=6)


@query(
    f"""WITH {PROFILE}, {_local_sql('difference', 'top')}, {_local_sql('reference', 'low')}, {_blur_sql('top', 'u', 2)}, {_blur_sql('low', 'v', 2)}
        SELECT u.chain, u.num, round(CASE WHEN u.score > 0 AND v.score > 0 THEN u.score / v.score ELSE least(u.score, v.score) END, 6) AS score
        FROM u JOIN v ON u.chain = v.chain AND u.num = v.num"""
)
def blur_ratio(spark, d):
    return _rounded(scoring.blurred_ratio(profile(spark, d), 2), "score", digits=6)


@query(
    """WITH f AS (SELECT DISTINCT 'U' || (user_id % 5)::varchar AS chain, event_id AS num FROM events),
       k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY num) - 1 AS r, count(*) OVER (PARTITION BY chain) AS n FROM f)
       SELECT chain, num, share::int AS share FROM k, range(0, 25, 3) t(share)
       WHERE floor(share * n / 100.0::double) <= r AND r + floor(share * n / 100.0::double) < n AND (SELECT min(n) FROM k) >= 40"""
)
def chop_ends(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("U"), (F.col("user_id") % 5).cast("string")).alias("chain"), F.col("event_id").alias("num"))
    return windows.chopped_ends(rows)


@query(
    f"""WITH {MERGED}, ta AS (SELECT * FROM t WHERE class = 'AA'), ma AS (SELECT * FROM m WHERE class = 'AA'),
        o AS (SELECT * FROM (VALUES (0,'A','B','C','A,B,C'),(1,'A','C','B','A,C,B'),(2,'B','A','C','B,A,C'),(3,'B','C','A','B,C,A'),(4,'C','A','B','C,A,B'),(5,'C','B','A','C,B,A')) v(ord,pa,pb,pc,permutation)),
        r AS (SELECT ord, CASE a_chain WHEN 'A' THEN pa WHEN 'B' THEN pb ELSE pc END AS a_chain, a_num, CASE b_chain WHEN 'A' THEN pa WHEN 'B' THEN pb ELSE pc END AS b_chain, b_num, area FROM ma, o),
        x AS (SELECT ord, a_chain, a_num, b_chain, b_num, area AS ta, 0::double AS ma FROM ta, o UNION ALL SELECT ord, a_chain, a_num, b_chain, b_num, 0, area FROM r),
        y AS (SELECT ord, a_chain, a_num, b_chain, b_num, sum(ta) AS ta, sum(ma) AS ma FROM x GROUP BY ALL),
        p AS (SELECT ord, a_chain, a_num, sum(least(abs(ta - ma), ta)) AS df, sum(ta) AS rf FROM y GROUP BY ALL),
        s AS (SELECT ord, 1 - sum(df) FILTER (rf > 0) / sum(rf) FILTER (rf > 0) AS score FROM p GROUP BY ord)
        SELECT o.permutation, round(s.score, 6) AS score, s.ord::int AS "order" FROM s JOIN o ON s.ord = o.ord ORDER BY s.score DESC, s.ord LIMIT 1"""
)
def chain_permutation(spark, d):
    return _rounded(scoring.best_chain_permutation(*sides(spark, d), ["A", "B", "C"]), "score", digits=6)


@query(
    f"""WITH {C} SELECT a_chain AS target, round(sum(area) FILTER (b_chain = 'A'), 2) AS "A", round(sum(area) FILTER (b_chain = 'B'), 2) AS "B",
        round(sum(area) FILTER (b_chain = 'C'), 2) AS "C" FROM c GROUP BY a_chain"""
)
def score_matrix(spark, d):
    sums = contacts(spark, d).groupBy(F.col("a_chain").alias("target"), F.col("b_chain").alias("model")).agg(F.round(F.sum("area"), 2).alias("value"))
    return scoring.score_matrix(sums, ["A", "B", "C"])


@query(
    f"""WITH {C} SELECT a_chain AS target, b_chain AS model, round(sum(area) FILTER (class = 'AA'), 2) AS "AA", round(sum(area) FILTER (class = 'SS'), 2) AS "SS" FROM c GROUP BY ALL"""
)
def pivot_scores(spark, d):
    sums = contacts(spark, d).groupBy(F.col("a_chain").alias("target"), F.col("b_chain").alias("model"), F.col("class").alias("name")).agg(F.round(F.sum("area"), 2).alias("value"))
    return scoring.score_table(sums, ["AA", "SS"])


@query(
    f"""WITH {MERGED}, r AS (SELECT DISTINCT chr((65 + p_partkey % 3)::int) AS chain, (p_partkey % 101)::int AS num FROM part),
        p AS (SELECT a_chain AS chain, a_num AS num, class, sum(least(abs(t_area - m_area), t_area)) AS df, sum(t_area) AS rf FROM j GROUP BY ALL)
        SELECT r.chain, r.num, p.class, round(coalesce(df, 0), 2) AS difference, round(coalesce(rf, 0), 2) AS reference FROM r LEFT JOIN p ON r.chain = p.chain AND r.num = p.num"""
)
def cad_profile_residues(spark, d):
    key = F.col("p_partkey")
    residues = table(spark, d, "part").select(F.chr(65 + key % 3).alias("chain"), (key % 101).cast("int").alias("num"))
    return _rounded(scoring.profile(merged(spark, d), residues=residues), "difference", "reference", digits=2)
