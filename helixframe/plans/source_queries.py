"""Queries for readers, writers and operators over files' lines, which the driver tables' rows stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import arrays, text
from helixframe.functions import geometry as g
from helixframe.operators import alignment, contacts, restraints, selection, structures
from helixframe.plans.registry import query
from helixframe.plans.tables import contacts as contact_rows
from helixframe.plans.tables import contacts_sql, table
from helixframe.sources import sequences
from helixframe.sources import structures as files

_NAMES = ("N", "CA", "C", "CB", "H")


def _records(spark, d):
    """Embeddings as atom records: a structure for each label, four atoms of a residue in turn."""
    i = F.col("vec_id")
    x = [F.format_string("%.3f", F.col("embedding")[k].cast("double")).cast("double").alias(n) for k, n in enumerate("xyz")]
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("structure_id"), i.alias("atom_idx"), F.when(i % 7 == 0, "HETATM").otherwise("ATOM").alias("label"),
        (i % 100000).cast("int").alias("serial"), F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (i % 5 + 1).cast("int")).alias("name"),
        F.when(i % 11 == 0, "B").otherwise("").alias("altloc"), F.when(i % 13 == 0, "HOH").otherwise("GLY").alias("resname"), F.chr(65 + i % 3).alias("chain"),
        (i.cast("long") / 9 % 1000).cast("int").alias("resnum"), F.when(i % 17 == 0, "A").otherwise("").alias("icode"), *x, (i % 90).cast("double").alias("bfactor"),
        F.lit("").alias("element"),
    )


_RECORDS = """r AS (
    SELECT 's' || label::varchar AS structure_id, vec_id AS i, vec_id AS atom_idx, CASE WHEN vec_id % 7 = 0 THEN 'HETATM' ELSE 'ATOM' END AS label, (vec_id % 100000)::int AS serial,
           ['N', 'CA', 'C', 'CB', 'H'][(vec_id % 5 + 1)::int] AS name, CASE WHEN vec_id % 11 = 0 THEN 'B' ELSE '' END AS altloc,
           CASE WHEN vec_id % 13 = 0 THEN 'HOH' ELSE 'GLY' END AS resname, chr((65 + vec_id % 3)::int) AS chain, (vec_id // 9 % 1000)::int AS resnum,
           CASE WHEN vec_id % 17 = 0 THEN 'A' ELSE '' END AS icode, printf('%.3f', embedding[1]::double)::double AS x, printf('%.3f', embedding[2]::double)::double AS y,
           printf('%.3f', embedding[3]::double)::double AS z, (vec_id % 90)::double AS bfactor
    FROM embeddings)"""
_FIELDS = "structure_id, label, serial, name, altloc, resname, chain, resnum, icode, x, y, z, bfactor"


@query(
    f"""WITH {_RECORDS}, e AS (SELECT structure_id, max(i) AS last FROM r GROUP BY ALL)
        SELECT {_FIELDS} FROM r JOIN e USING (structure_id) WHERE i < last // 2"""
)
def pdb_first_model(spark, d):
    lines = files.pdb_lines(_records(spark, d))
    ends = lines.groupBy("structure_id").agg(F.expr("max(line_no) div 2").alias("line_no")).select("structure_id", "line_no", F.lit("ENDMDL").alias("line"))
    own = lines.join(ends.select("structure_id", F.col("line_no").alias("stop")), "structure_id").filter("line_no <> stop").drop("stop")
    return files.parse_pdb(own.unionByName(ends)).select(*_FIELDS.split(", "))


@query(
    f"""WITH {_RECORDS} SELECT structure_id, atom_idx FROM r
        WHERE name NOT LIKE 'H%' AND altloc IN ('', 'A') AND label = 'ATOM' AND resname <> 'HOH' AND icode = ''"""
)
def wanted_atoms(spark, d):
    return structures.wanted_atoms(_records(spark, d)).select("structure_id", "atom_idx")


@query(
    f"""WITH {_RECORDS}, b AS (
            SELECT structure_id, chain, resnum AS num, arg_min(x, serial) FILTER (name = 'N') AS n_x, arg_min(x, serial) FILTER (name = 'CA') AS ca_x, arg_min(y, serial) FILTER (name = 'C') AS c_y
            FROM r WHERE label = 'ATOM' GROUP BY ALL)
        SELECT * FROM b WHERE ca_x IS NOT NULL"""
)
def backbone_atoms(spark, d):
    found = structures.backbone(_records(spark, d), ["structure_id"])
    return found.select("structure_id", "chain", "num", F.col("n.x").alias("n_x"), F.col("ca.x").alias("ca_x"), F.col("c.y").alias("c_y"))


def _turns(spark, d):
    """Conversations as files: what the user says is a header line, what is answered a line of sequence."""
    line = F.when(F.col("role") == "user", F.concat(F.lit(">"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("structure_id"), F.col("turn").alias("line_no"), line.alias("line"))


_TURNS = """t AS (SELECT conv_id, turn, coalesce(text, '') AS line, role = 'user' AS head, sum((role = 'user')::int) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq_idx FROM conversations)"""


@query(
    f"""WITH {_TURNS} SELECT conv_id AS structure_id, seq_idx::bigint AS seq_idx, max(trim(line)) FILTER (head) AS header, coalesce(string_agg(trim(line), '' ORDER BY turn) FILTER (NOT head), '') AS sequence
        FROM t WHERE seq_idx >= 0 GROUP BY ALL"""
)
def fasta_records(spark, d):
    return sequences.parse_fasta(_turns(spark, d))


@query(
    f"""WITH {_TURNS}, s AS (SELECT conv_id, seq_idx, coalesce(string_agg(trim(line), '' ORDER BY turn) FILTER (NOT head), '') AS sequence FROM t WHERE seq_idx >= 0 GROUP BY ALL)
        SELECT conv_id AS structure_id, seq_idx::bigint AS seq_idx, regexp_replace(sequence, '[a-z]', '', 'g') AS aligned,
               list_transform(regexp_extract_all(sequence, '([a-z]*)[^a-z]', 1), lambda r: length(r)::int) AS insertions FROM s"""
)
def a3m_records(spark, d):
    return sequences.parse_a3m(_turns(spark, d))


@query(
    """WITH e AS (SELECT doc_id::varchar AS name, (strlen(coalesce(text, '')) + 1)::bigint AS length FROM documents)
       SELECT name, coalesce(sum(length) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset", length FROM e"""
)
def archive_index(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return sequences.archive_index(docs)


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, c_custkey::varchar AS key, c_name AS name FROM customer")
def container_round_trip(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    lines = files.container_lines(rows, "customers", ["c_custkey"]).withColumn("structure_id", F.lit("s"))
    blocks = files.parse_container(lines, "customers")
    return blocks.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("fields")[0].alias("key"), F.col("fields")[1].alias("name"))


_STATES = "HBEGITS "
_DSSP = f"""s AS (
    SELECT 'c' || (l_suppkey % 100)::varchar AS structure_id, (l_partkey % 10000)::int AS resnum, CASE WHEN l_linenumber = 1 THEN 'A' ELSE '' END AS icode, chr((65 + l_suppkey % 3)::int) AS chain,
           CASE WHEN l_linenumber = 7 THEN '!' ELSE chr((65 + l_partkey % 20)::int) END AS aa, trim(substr('{_STATES}', (l_orderkey % 8 + 1)::int, 1)) AS ss FROM lineitem)"""


def _summaries(spark, d):
    items = table(spark, d, "lineitem")
    line = F.concat(
        F.lit(" " * 5), F.lpad((F.col("l_partkey") % 10000).cast("string"), 5, " "), F.when(F.col("l_linenumber") == 1, "A").otherwise(" "), F.chr(65 + F.col("l_suppkey") % 3), F.lit(" "),
        F.when(F.col("l_linenumber") == 7, "!").otherwise(F.chr(65 + F.col("l_partkey") % 20)), F.lit("  "), F.substr(F.lit(_STATES), (F.col("l_orderkey") % 8 + 1).cast("int"), F.lit(1)),
    )
    rows = items.select(F.concat(F.lit("c"), (F.col("l_suppkey") % 100).cast("string")).alias("structure_id"), F.lit(2).alias("line_no"), line.alias("line"))
    heads = rows.select("structure_id").distinct().select("structure_id", F.lit(1).alias("line_no"), F.lit("  #  RESIDUE AA STRUCTURE").alias("line"))
    return files.parse_dssp(rows.unionByName(heads))


@query(f"WITH {_DSSP} SELECT * FROM s WHERE aa <> '!'")
def dssp_residues(spark, d):
    return _summaries(spark, d)


@query(
    f"""WITH {_DSSP} SELECT structure_id, count(*) AS total, count(*) FILTER (ss IN ('H', 'G', 'I')) AS helix, count(*) FILTER (ss IN ('B', 'E')) AS strand FROM s WHERE aa <> '!' GROUP BY ALL"""
)
def state_counts(spark, d):
    return structures.state_counts(_summaries(spark, d), ["structure_id"])


@query(
    f"""WITH {contacts_sql()}, p AS (SELECT a_num AS x, b_num AS y, max((a_num * 7 + b_num) % 100 / 100.0::double) AS value FROM c GROUP BY ALL),
            t AS (SELECT *, CASE WHEN value < 0.5 THEN 2 * value ELSE 1.0::double END AS red, CASE WHEN value < 0.5 THEN 2 * value ELSE 2 - 2 * value END AS green, CASE WHEN value < 0.5 THEN 1.0::double ELSE 2 - 2 * value END AS blue FROM p)
        SELECT x, y, value, (floor(red * 255) * 65536 + floor(green * 255) * 256 + floor(blue * 255))::int AS rgb FROM t"""
)
def map_pixels(spark, d):
    rows = contact_rows(spark, d).select(F.col("a_num").alias("a_idx"), F.col("b_num").alias("b_idx")).distinct()
    return files.map_image(rows, (F.col("a_idx") * 7 + F.col("b_idx")) % 100 / F.lit(100.0))


@query(
    """SELECT (label::varchar) AS structure_id, coalesce(max(printf('%.4f', abs(embedding[1])::double)::double) FILTER (vec_id % 3 = 0), 0) AS "TM_score",
              coalesce(max(printf('%.2f', abs(embedding[2])::double * 100)::double) FILTER (vec_id % 3 = 1), 0) AS "TM_score_GDT_TS",
              coalesce(max(printf('%.2f', abs(embedding[3])::double * 100)::double) FILTER (vec_id % 3 = 2), 0) AS "TM_score_GDT_HA" FROM embeddings GROUP BY label"""
)
def tm_listings(spark, d):
    value = [F.abs(F.col("embedding")[k].cast("double")) for k in range(3)]
    line = F.when(F.col("vec_id") % 3 == 0, F.format_string("TM-score    = %.4f  (d0= 2.00)", value[0])).when(F.col("vec_id") % 3 == 1, F.format_string("GDT-TS-score= %.2f%%", value[1] * 100))
    line = line.otherwise(F.format_string("GDT-HA-score= %.2f%%", value[2] * 100))
    return files.tm_scores(table(spark, d, "embeddings").select(F.col("label").cast("string").alias("structure_id"), F.col("vec_id").alias("line_no"), line.alias("line")))


@query(
    """SELECT c_nationkey AS structure_id, string_agg(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, '' ORDER BY c_custkey) AS ss_pred,
              string_agg(CASE WHEN c_custkey % 2 = 1 THEN c_custkey::varchar ELSE '' END, '' ORDER BY c_custkey) AS ss_conf FROM customer GROUP BY c_nationkey"""
)
def predicted_states(spark, d):
    line = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Pred: "), "c_mktsegment")).otherwise(F.concat(F.lit("Conf: "), F.col("c_custkey").cast("string")))
    return files.secondary_structure(table(spark, d, "customer").select(F.col("c_nationkey").alias("structure_id"), F.col("c_custkey").alias("line_no"), line.alias("line")))


@query("SELECT c_custkey, c_name || c_mktsegment || n_name AS fused FROM customer JOIN nation ON c_nationkey = n_nationkey")
def fused_sequences(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", text.fused(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name")).alias("fused"))


@query(
    """WITH p AS (SELECT DISTINCT l_partkey % 500 AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'CB' ELSE 'C' END AS atom FROM lineitem),
            h AS (SELECT s_suppkey AS pos, 'CA' AS atom, s_acctbal AS x FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT s_suppkey, 'CB', -s_acctbal FROM supplier WHERE s_nationkey < 12)
       SELECT p.pos, p.atom, coalesce(o.x, c.x) AS p FROM p LEFT JOIN h o ON o.pos = p.pos AND o.atom = p.atom LEFT JOIN h c ON c.pos = p.pos AND c.atom = 'CA'"""
)
def transferred_atoms(spark, d):
    turn = F.col("l_linenumber") % 3
    places = table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("pos"), F.when(turn == 0, "CA").when(turn == 1, "CB").otherwise("C").alias("atom")).distinct()
    s = table(spark, d, "supplier")
    ca = s.filter("s_nationkey <> 3").select(F.col("s_suppkey").alias("pos"), F.lit("CA").alias("atom"), F.col("s_acctbal").alias("p"))
    cb = s.filter("s_nationkey < 12").select(F.col("s_suppkey").alias("pos"), F.lit("CB").alias("atom"), (-F.col("s_acctbal")).alias("p"))
    return structures.transferred(places, ca.unionByName(cb))


@query(
    f"""WITH {contacts_sql()}, n AS (SELECT DISTINCT a_chain, a_num FROM c),
            p AS (SELECT chr((65 + p_partkey % 3)::int) AS b_chain, (p_partkey % 97)::int AS b_num, p_size - 25.5::double AS z FROM part),
            s AS (SELECT c.*, sign(min(z)) AS low, sign(max(z)) AS high FROM c JOIN p USING (b_chain, b_num) WHERE class = 'SS' AND a_num % 2 = 0 GROUP BY ALL)
        SELECT * FROM c UNION ALL
        SELECT a_chain, a_num, b_chain, b_num, unnest(CASE WHEN low = high AND low <> 0 THEN ['na_stacking', CASE WHEN low > 0 THEN 'na_stacking_up' ELSE 'na_stacking_down' END] ELSE ['na_siding'] END) AS class, area FROM s"""
)
def stacking(spark, d):
    rows = contact_rows(spark, d)
    #  residues of even number are the nucleotides that have a plane
    planes = rows.filter("a_num % 2 = 0").select(F.col("a_chain").alias("chain"), F.col("a_num").alias("num")).distinct()
    planes = planes.withColumns({"origin": g.point(F.lit(0.0), F.lit(0.0), F.lit(0.0)), "normal": g.point(F.lit(0.0), F.lit(0.0), F.lit(1.0))})
    key, height = F.col("p_partkey"), F.col("p_size") - F.lit(25.5)
    atoms = table(spark, d, "part").select(F.chr(65 + key % 3).alias("chain"), (key % 97).cast("int").alias("num"), g.point(F.lit(0.0), F.lit(0.0), height).alias("p"))
    return contacts.stacking_labels(rows, planes, atoms)


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda u: u::double) AS v, len(embedding) AS n FROM embeddings),
            e AS (SELECT vec_id, v, n, unnest(range(4, n - 2)) AS i FROM v)
       SELECT vec_id, i::bigint - 1 AS pos, round((-2 * (v[i - 3] + v[i + 3]) + 3 * (v[i - 2] + v[i + 2]) + 6 * (v[i - 1] + v[i + 1]) + 7 * v[i]) / 21, 6) AS smooth FROM e"""
)
def smoothed_inside(spark, d):
    rows = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda u: u.cast("double")))
    places = rows.select("vec_id", F.size("v").alias("n"), F.posexplode(arrays.savitzky_golay(F.col("v"))).alias("pos", "smooth"))
    return places.filter("pos >= 3 and pos < n - 3").select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("smooth", 6).alias("smooth"))


@query(
    """WITH s AS (SELECT c_nationkey AS t, c_custkey AS model, c_mktsegment AS method, c_custkey % 4 AS cluster, c_acctbal AS score FROM customer),
            h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, model DESC) <= count(*) OVER (PARTITION BY t) // 2),
            p AS (SELECT t, model, score, 'cluster ' || cluster::varchar AS why, 0 AS turn FROM h QUALIFY row_number() OVER (PARTITION BY t, cluster ORDER BY score DESC, model DESC) = 1),
            c AS (SELECT t, model, score, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY model) <= count(*) OVER (PARTITION BY t) // 2 THEN 'MSA' ELSE 'TBM' END AS why
                  FROM s WHERE method IN ('BUILDING', 'MACHINERY')),
            b AS (SELECT t, model, score, why, CASE why WHEN 'MSA' THEN 1 ELSE 2 END AS turn FROM c QUALIFY row_number() OVER (PARTITION BY t, why ORDER BY score DESC, model) = 1)
       SELECT t, (row_number() OVER (PARTITION BY t ORDER BY turn, score DESC, model DESC))::int AS number, model, score, why FROM (SELECT * FROM p UNION ALL SELECT * FROM b)"""
)
def final_models(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("t"), F.col("c_custkey").alias("model"), F.col("c_mktsegment").alias("method"), F.col("c_acctbal").alias("score"))
    clusters = rows.select("t", "model", (F.col("model") % 4).alias("cluster"))
    return selection.final_models(rows, clusters, rows.filter(F.col("method").isin("BUILDING", "MACHINERY")), "t")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 40 < 20 AND l_suppkey % 40 >= 20 THEN 2.0::double ELSE 1.0::double END AS weight FROM lineitem"""
)
def between_chains(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", restraints.between_chains_weight(F.col("l_partkey") % 40, F.col("l_suppkey") % 40, 20).alias("weight"))


@query(
    """WITH l AS (SELECT item_id, unnest(range(1, length(text) + 1)) AS pos, text FROM benchmark)
       SELECT item_id, pos - 1 AS pos, strpos('ARNDCQEGHILKMFPSTWYV', upper(substr(text, pos, 1)))::int AS hot, round((pos - 1) / length(text)::double, 6) AS position FROM l"""
)
def property_columns(spark, d):
    letters = F.transform(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), lambda c: F.upper(c))
    rows = table(spark, d, "benchmark").select("item_id", F.length("text").alias("n"), F.posexplode(letters).alias("pos", "letter"))
    found = structures.property_vectors(rows, [], length_col="n")
    return found.select("item_id", F.col("pos").cast("long").alias("pos"), F.array_position("one_hot", 1.0).cast("int").alias("hot"), F.round("position", 6).alias("position"))


@query(
    """WITH a AS (SELECT o_orderkey, list_sort([(o_orderkey + k) % 9 - 1 FOR k IN range(5)]) AS x FROM orders), p AS (SELECT o_orderkey, unnest(range(5)) AS b FROM a)
       SELECT a.o_orderkey, p.b::int AS pos, (100 + a.x[p.b + 1])::bigint AS num FROM a JOIN p USING (o_orderkey) WHERE a.x[p.b + 1] >= 0 AND a.x[p.b + 1] <> 4"""
)
def renumbered_places(spark, d):
    place = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("o_orderkey") + k) % 9 - 1))
    rows = table(spark, d, "orders").select("o_orderkey", F.transform(place, lambda x, i: F.struct(x.cast("int").alias("a"), i.alias("b"))).alias("places"))
    keys = rows.select("o_orderkey")
    numbers = keys.select("o_orderkey", F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 3, 5, 6, 7)])).alias("target_pos"))
    return alignment.renumbering(rows, numbers.withColumn("num", (F.col("target_pos") + 100).cast("long")), ["o_orderkey"])
