"""Views of the driver tables as the operators' inputs, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import geometry as g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _end(key: str, end: str):
    return [F.chr(65 + F.col(key) % 3).alias(f"{end}_chain"), (F.col(key) % 97).cast("int").alias(f"{end}_num")]


def contacts(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """Line items as directed residue contacts between parts and suppliers; their prices are areas."""
    items = table(spark, sf_dir, "lineitem")
    if status:
        items = items.filter(F.col("l_linestatus") == status)
    own = (F.col("l_partkey") % 3 == F.col("l_suppkey") % 3) & (F.col("l_partkey") % 97 == F.col("l_suppkey") % 97)
    kind = F.when(own, "AW").when(F.col("l_returnflag") == "A", "AA").when(F.col("l_returnflag") == "N", "AS").otherwise("SS")
    rows = items.select(*_end("l_partkey", "a"), *_end("l_suppkey", "b"), kind.alias("class"), F.col("l_extendedprice").cast("decimal(14,2)").alias("area"))
    return rows.groupBy("a_chain", "a_num", "b_chain", "b_num", "class").agg(F.sum("area").cast("double").alias("area"))


CONTACTS = """
    c AS (
        SELECT chr((65 + l_partkey % 3)::int) AS a_chain, (l_partkey % 97)::int AS a_num,
               chr((65 + l_suppkey % 3)::int) AS b_chain, (l_suppkey % 97)::int AS b_num,
               CASE WHEN l_partkey % 3 = l_suppkey % 3 AND l_partkey % 97 = l_suppkey % 97 THEN 'AW'
                    WHEN l_returnflag = 'A' THEN 'AA' WHEN l_returnflag = 'N' THEN 'AS' ELSE 'SS' END AS class,
               sum(l_extendedprice::decimal(14,2))::double AS area
        FROM lineitem {where} GROUP BY ALL)"""


def contacts_sql(status: str | None = None, name: str = "c") -> str:
    sql = CONTACTS.format(where=f"WHERE l_linestatus = '{status}'" if status else "")
    return sql.replace("    c AS (", f"    {name} AS (", 1)


#: Both sides merged: t_area from status O, m_area from status F.
MERGED = f"""{contacts_sql("O", "t")}, {contacts_sql("F", "m")},
    j AS (
        SELECT coalesce(t.a_chain, m.a_chain) AS a_chain, coalesce(t.a_num, m.a_num) AS a_num, coalesce(t.b_chain, m.b_chain) AS b_chain,
               coalesce(t.b_num, m.b_num) AS b_num, coalesce(t.class, m.class) AS class, coalesce(t.area, 0) AS t_area, coalesce(m.area, 0) AS m_area
        FROM t FULL JOIN m ON t.a_chain = m.a_chain AND t.a_num = m.a_num AND t.b_chain = m.b_chain AND t.b_num = m.b_num AND t.class = m.class)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return contacts(spark, sf_dir, "O"), contacts(spark, sf_dir, "F")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spheres: three components are the place, the label is the chain."""
    e = table(spark, sf_dir, "embeddings")
    x = [F.col("embedding")[i].cast("double") for i in range(3)]
    return e.select(
        F.col("vec_id").alias("atom_idx"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("chain"), F.col("vec_id").cast("int").alias("num"),
        F.lit("GLY").alias("resname"), F.lit("CA").alias("name"), g.point(*x).alias("p"), (0.01 + 0.002 * F.col("label")).alias("r"),
    )


LARGEST_RADIUS = 0.03
POINTS = """
    p AS (
        SELECT vec_id AS atom_idx, 'L' || label::varchar AS chain, vec_id::int AS num, embedding[1]::double AS x, embedding[2]::double AS y,
               embedding[3]::double AS z, 0.01::double + 0.002::double * label AS r
        FROM embeddings),
    d AS (
        SELECT a.atom_idx AS i, b.atom_idx AS k, a.chain AS ca, b.chain AS cb, a.r AS ra, b.r AS rb,
               sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
        FROM p a, p b WHERE a.atom_idx <> b.atom_idx)"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one class's profile: users are chains, days are residue numbers, errors are differences."""
    e = table(spark, sf_dir, "events")
    value = F.col("value").cast("decimal(20,6)")
    rows = e.groupBy(
        F.format_string("U%05d", "user_id").alias("chain"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("num")
    ).agg(F.coalesce(F.sum(F.when(F.col("event_type") == "error", value)), F.lit(0)).cast("double").alias("difference"), F.sum(value).cast("double").alias("reference"))
    return rows


PROFILE = """
    f AS (
        SELECT printf('U%05d', user_id) AS chain, date_diff('day', DATE '2024-01-01', ts::date)::int AS num,
               coalesce(sum(value::decimal(20,6)) FILTER (event_type = 'error'), 0)::double AS difference, sum(value::decimal(20,6))::double AS reference
        FROM events GROUP BY ALL)"""


ACCENTED = "àáâäçèéêëíîïñóôöúùûüß"


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as aligned rows: their whole texts in upper case, gaps after the shorter ones."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.upper(F.translate("text", ACCENTED, "")).alias("aligned"))
    longest = rows.agg(F.max(F.length("aligned")).alias("n"))  # one row
    return rows.join(F.broadcast(longest), F.lit(True)).select("seq", F.rpad("aligned", F.col("n"), F.lit("-")).alias("aligned"))


ALIGNMENT = """
    u AS (SELECT item_id AS seq, upper(translate(text, 'àáâäçèéêëíîïñóôöúùûüß', '')) AS letters FROM benchmark),
    s AS (SELECT seq, rpad(letters, (SELECT max(length(letters)) FROM u)::int, '-') AS aligned FROM u),
    e AS (
        SELECT seq, pos, CASE WHEN strpos('ARNDCQEGHILKMFPSTWYV-', substr(aligned, pos + 1, 1)) > 0
                              THEN strpos('ARNDCQEGHILKMFPSTWYV-', substr(aligned, pos + 1, 1)) - 1 ELSE 20 END::int AS code
        FROM (SELECT seq, aligned, unnest(range(length(aligned)))::int AS pos FROM s)),
    n AS (SELECT seq, count(*) AS n FROM e GROUP BY seq),
    w AS (
        SELECT q.a AS seq, 1.0::double / count(*) AS weight
        FROM (SELECT x.seq AS a, y.seq AS b, count(*) AS same FROM e x JOIN e y ON x.pos = y.pos AND x.code = y.code GROUP BY ALL) q
        JOIN n ON n.seq = q.a WHERE q.same > n.n * 0.8::double GROUP BY q.a)"""
