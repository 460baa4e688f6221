"""Record-store and forum queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import text as t
from helixframe.operators import forum, msa, relational, selection, store, structures
from helixframe.plans.registry import query
from helixframe.plans.tables import table


@query("SELECT p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def store_scan(spark, d):
    return store.without_id(store.query(table(spark, d, "part"), "", ""), "p_partkey")


@query("SELECT * FROM part WHERE p_brand = 'Brand#12'")
def store_eq(spark, d):
    return store.query(table(spark, d, "part"), "P_Brand", "Brand#12", "p_name")


@query("SELECT * FROM part WHERE p_size = 15")
def store_eq_number(spark, d):
    return store.equals(table(spark, d, "part"), "p_size", "15")


@query("SELECT * FROM part WHERE p_name ILIKE '%B_lt%'")
def store_contains(spark, d):
    return store.query(table(spark, d, "part"), "p_name", "B_lt", "p_name")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size * 2 BETWEEN 40 AND 60 AND left(p_name, 1) = 'b' AND right(p_name, 1) = 't'")
def store_size_band(spark, d):
    parts = table(spark, d, "part").withColumn("length", (F.col("p_size") * 2).cast("string"))
    return store.linker_query(parts, "large", "b", "t", "length", "p_name").select("p_partkey", "p_name", "p_size")


@query("SELECT * FROM supplier WHERE s_nationkey IS DISTINCT FROM 3")
def store_delete(spark, d):
    return store.delete(table(spark, d, "supplier"), "s_nationkey", 3)


@query(
    """SELECT s_suppkey, s_nationkey FROM supplier UNION ALL
       SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (), s_nationkey FROM supplier WHERE s_nationkey = 3"""
)
def store_append(spark, d):
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return store.append(suppliers, suppliers.filter("s_nationkey = 3"), "s_suppkey")


@query("SELECT s_name AS name, s_nationkey::varchar AS nation, false AS has_id FROM supplier")
def store_envelope(spark, d):
    """Every row's object read back, the id left out of it."""
    rows = store.envelope(table(spark, d, "supplier"), "s_suppkey")
    read = [F.get_json_object("content", f"$.{c}").alias(n) for c, n in (("s_name", "name"), ("s_nationkey", "nation"))]
    return rows.select(*read, F.get_json_object("content", "$.s_suppkey").isNotNull().alias("has_id"))


@query("SELECT p_name, count(*) AS count FROM part GROUP BY p_name HAVING count(*) > 1")
def store_duplicates(spark, d):
    return store.duplicates(table(spark, d, "part"), ["p_name"])


@query(
    """(SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1') UNION SELECT doc_id, source FROM documents WHERE contains(lower(text), 'token'))
       INTERSECT SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr')"""
)
def forum_search(spark, d):
    docs = table(spark, d, "documents")
    return forum.search(docs, docs.filter(F.col("lang").isin("en", "fr")), "Token", "source", "text", ["doc_id", "source"]).union(
        forum.search(docs, docs.filter(F.col("lang").isin("en", "fr")), "SRC1", "source", "source", ["doc_id", "source"])
    ).distinct()


@query("SELECT o_orderkey, o_orderkey % 3 AS type FROM orders WHERE o_orderkey % 3 IN (0, 2)")
def forum_visible(spark, d):
    topics = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("type"))
    return forum.visible(topics, researcher=False)


@query(
    """WITH k AS (SELECT o_orderkey, o_orderkey % 3 AS type, o_custkey % 2 = 0 AS researcher, CASE WHEN o_orderkey % 2 = 0 THEN 'Answer' ELSE 'Topic' END AS name FROM orders)
       SELECT o_orderkey FROM k WHERE NOT (type = 1 AND NOT researcher) AND NOT (type <> 2 AND name IN ('Question', 'Answer'))"""
)
def forum_permitted(spark, d):
    name = F.when(F.col("o_orderkey") % 2 == 0, "Answer").otherwise("Topic")
    return table(spark, d, "orders").filter(forum.permitted(F.col("o_orderkey") % 3, F.col("o_custkey") % 2 == 0, name)).select("o_orderkey")


@query(
    """WITH RECURSIVE k AS (
           SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS up FROM conversations),
       r AS (
           SELECT id, id AS root, 0 AS depth FROM k WHERE up IS NULL OR up NOT IN (SELECT id FROM k)
           UNION ALL SELECT k.id, r.root, r.depth + 1 FROM k JOIN r ON k.up = r.id)
       SELECT id, root, depth FROM r"""
)
def forum_thread(spark, d):
    turns = table(spark, d, "conversations")
    ids = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("ansto_id"))
    return forum.threads(ids).select("id", "root", "depth")


@query(
    """SELECT o.o_orderkey, c.c_name AS owner_name, n.n_name AS nation FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""
)
def forum_owner_nested(spark, d):
    nations = table(spark, d, "nation").withColumnRenamed("n_nationkey", "owner_id")
    people = forum.with_owner(table(spark, d, "customer"), nations, "c_nationkey").withColumnRenamed("owner", "nation").withColumnRenamed("c_custkey", "owner_id")
    nested = forum.with_owner(table(spark, d, "orders").select("o_orderkey", "o_custkey"), people, "o_custkey")
    return nested.select("o_orderkey", F.col("owner.c_name").alias("owner_name"), F.col("owner.nation.n_name").alias("nation"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)")
def forum_cascade(spark, d):
    left = table(spark, d, "customer").filter("c_nationkey <> 7")
    return forum.cascade(left, table(spark, d, "orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey").select("o_orderkey")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey = 3")
def forum_owned(spark, d):
    return forum.owned(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), 3, "s_nationkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 3")
def forum_replies(spark, d):
    return forum.replies_of(table(spark, d, "customer").select("c_custkey", "c_nationkey"), 3, "c_nationkey")


def _users(spark, d):
    job = F.when(F.col("c_nationkey") < 9, "Researcher").when(F.col("c_nationkey") < 18, "Student")
    return table(spark, d, "customer").filter("c_nationkey > 0").select(F.col("c_custkey").alias("owner_id"), job.alias("job_title"))


def _topics(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), (F.col("o_orderkey") % 3).alias("type"))


_FORUM = """
    WITH u AS (SELECT c_custkey AS owner_id, c_nationkey < 9 AS researcher FROM customer WHERE c_nationkey > 0),
         k AS (SELECT o_orderkey AS id, o_custkey AS owner_id, o_orderkey % 3 AS type FROM orders)"""


@query(
    f"""{_FORUM} SELECT * FROM k WHERE type = 2 UNION ALL
        SELECT k.* FROM k JOIN u USING (owner_id) WHERE type <> 2 AND (type <> 1 OR researcher)"""
)
def forum_created_topics(spark, d):
    topics = _topics(spark, d)
    return forum.created_topics(topics.filter("type = 2"), topics.filter("type <> 2"), _users(spark, d))[0]


@query(
    f"""{_FORUM} SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey AS owner_id FROM lineitem l
        WHERE NOT EXISTS (SELECT 1 FROM k JOIN u ON u.owner_id = l.l_suppkey WHERE k.id = l.l_orderkey + 1 AND (k.type <> 1 OR u.researcher))"""
)
def forum_refused_replies(spark, d):
    """Line items reply to the order after theirs."""
    new = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("owner_id"), (F.col("l_orderkey") + 1).alias("topic_id"))
    refused = forum.created_replies(new.limit(0), new, _topics(spark, d), _users(spark, d))[1]
    return refused.select("l_orderkey", "l_linenumber", "owner_id")


@query(f"{_FORUM} SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey + 1 = k.id AND c.c_custkey % 10 = k.owner_id % 10)")
def forum_destroyed(spark, d):
    """Customers ask for the order after their number."""
    topics = _topics(spark, d).withColumn("digit", F.col("owner_id") % 10)
    asked = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"), (F.col("c_custkey") % 10).alias("user_id"))
    return forum.destroyed(topics, asked, owner_col="digit")[0].drop("digit")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def first_rows(spark, d):
    return msa.first_rows(table(spark, d, "documents").select("doc_id", "source"), 5, "doc_id", ["source"])


@query("SELECT l_partkey, count(*) AS ansagree FROM lineitem GROUP BY l_partkey")
def forum_votes(spark, d):
    return forum.votes(table(spark, d, "lineitem"), "l_partkey")


@query(
    """SELECT p.p_partkey, (SELECT v.v FROM (VALUES ('Brand#1_ECONOMY', 1, 10), ('Brand#1_ECO*', 2, 20), ('Brand#1_*', 3, 30), ('*_ECONOMY', 4, 40), ('*_S*', 5, 50), ('*_*', 6, 60)) v(pat, rank, v)
        WHERE (split_part(v.pat, '_', 1) IN (p.p_brand, '*'))
          AND (split_part(v.pat, '_', 2) = p.p_type OR (right(split_part(v.pat, '_', 2), 1) = '*' AND starts_with(p.p_type, rtrim(split_part(v.pat, '_', 2), '*'))))
        ORDER BY v.rank LIMIT 1)::int AS value FROM part p"""
)
def first_match_lookup(spark, d):
    rows = [("Brand#1_ECONOMY", 10), ("Brand#1_ECO*", 20), ("Brand#1_*", 30), ("*_ECONOMY", 40), ("*_S*", 50), ("*_*", 60)]
    patterns = spark.createDataFrame(rows, "pattern string, value int")
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    options = relational.pattern_options(F.col("p_brand"), F.col("p_type"))
    return relational.first_match_lookup(parts, patterns, options, ["p_partkey"]).select("p_partkey", "value")


@query(
    """SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r FROM supplier) WHERE r <= 3"""
)
def topk_per_group(spark, d):
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return selection.top_k(rows, 3, [F.asc("s_acctbal"), F.asc("s_suppkey")], ["s_nationkey"])


@query(
    """SELECT c_nationkey, c_custkey, c_acctbal FROM (
           SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
       WHERE r <= n // 2"""
)
def top_half(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return selection.top_half(rows, [F.desc("c_acctbal"), F.desc("c_custkey")], ["c_nationkey"])


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer c WHERE c_acctbal < (SELECT min(c_acctbal) FROM customer b WHERE b.c_nationkey = c.c_nationkey) * 0.9::double")
def rel_cutoff(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return selection.within_best(rows, "c_acctbal", 0.9, ["c_nationkey"])


@query("SELECT n_regionkey, arg_max(n_name, n_nationkey) AS n_name, max(n_nationkey) AS n_nationkey FROM nation GROUP BY n_regionkey")
def argmax_rep(spark, d):
    return selection.representative(table(spark, d, "nation"), ["n_regionkey"], "n_nationkey", "n_name").select("n_regionkey", "n_name", "n_nationkey")


@query("SELECT o_custkey, round(avg(o_totalprice::decimal(14,2))::double, 6) AS price FROM orders GROUP BY o_custkey")
def ensemble_mean(spark, d):
    return selection.ensemble_mean(
        table(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(14,2)")), ["o_custkey"], "o_totalprice"
    ).select("o_custkey", F.col("o_totalprice").cast("double").alias("price"))


@query(
    """WITH a AS (SELECT o_custkey AS num, avg(o_totalprice::decimal(14,2))::double AS bfactor FROM orders GROUP BY o_custkey)
       SELECT num, round(bfactor, 6) AS bfactor FROM (SELECT *, row_number() OVER (ORDER BY bfactor, num) AS r, count(*) OVER () AS n FROM a) WHERE r <= round_even(n * 0.2::double, 0)"""
)
def bfactor_rank(spark, d):
    orders = table(spark, d, "orders").select(F.lit("A").alias("chain"), F.col("o_custkey").alias("num"), F.col("o_totalprice").cast("decimal(14,2)").alias("bfactor"))
    means = structures.mean_bfactor(orders).withColumn("bfactor", F.col("bfactor").cast("double"))
    return structures.lowest_share(means, "bfactor", "num", keys=["chain"]).select("num", F.round("bfactor", 6).alias("bfactor"))


@query("SELECT doc_id, length(replace(text, 'X', '')) BETWEEN 27 AND 600 AS valid FROM documents")
def seq_validate(spark, d):
    return table(spark, d, "documents").select("doc_id", t.valid_sequence(F.col("text")).alias("valid"))


@query("SELECT page_id, (strpos(replace(url, 'X', ''), 'example') - 1)::int AS place FROM pages")
def seq_find(spark, d):
    return table(spark, d, "pages").select("page_id", t.found_at(F.lit("eXxaXmple"), F.col("url")).alias("place"))


@query("SELECT r.r_name, n.n_name FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey WHERE n.n_nationkey NOT IN (1, 2)")
def excluded_picked(spark, d):
    picked = spark.createDataFrame([(1,), (2,)], "n_nationkey int")
    rest = relational.excluded(table(spark, d, "nation"), picked, ["n_nationkey"])
    return rest.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@query(
    """WITH o AS (SELECT p_brand, min(p_size) AS v FROM part WHERE p_size < 25 GROUP BY p_brand), n AS (SELECT p_brand, max(p_size) AS v FROM part GROUP BY p_brand)
       SELECT * FROM o UNION ALL SELECT * FROM n WHERE p_brand NOT IN (SELECT p_brand FROM o)"""
)
def existing_win(spark, d):
    parts = table(spark, d, "part")
    old = parts.filter("p_size < 25").groupBy("p_brand").agg(F.min("p_size").alias("v"))
    return relational.existing_win(old, parts.groupBy("p_brand").agg(F.max("p_size").alias("v")), ["p_brand"])
