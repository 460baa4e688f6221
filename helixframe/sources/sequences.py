"""Readers of sequences, alignments and template hits, and the name-to-bytes archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import geometry as g
from helixframe.functions.text import without_insertions
from helixframe.operators.relational import with_earlier


def parse_fasta(rows: DataFrame, first_only: bool = False) -> DataFrame:
    """(structure_id, seq_idx, header, sequence) of (structure_id, line_no, line)."""
    by_file = Window.partitionBy("structure_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("seq_idx", F.sum(F.col("line").startswith(">").cast("int")).over(by_file) - 1).filter("seq_idx >= 0")
    if first_only:
        numbered = numbered.filter("seq_idx = 0")
    head = F.col("line").startswith(">")
    parts = F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", F.trim("line").alias("s")))))
    grouped = numbered.groupBy("structure_id", "seq_idx").agg(F.max(F.when(head, F.trim(F.substr("line", F.lit(2))))).alias("header"), parts.alias("_p"))
    return grouped.select("structure_id", "seq_idx", "header", F.array_join(F.transform("_p", lambda x: x["s"]), "").alias("sequence"))


def parse_a3m(rows: DataFrame) -> DataFrame:
    """(structure_id, seq_idx, aligned, insertions): match columns, and how many letters each has inserted before it."""
    raw = parse_fasta(rows)
    runs = F.regexp_extract_all("sequence", F.lit("([a-z]*)[^a-z]"), F.lit(1))
    return raw.select("structure_id", "seq_idx", without_insertions(F.col("sequence")).alias("aligned"), F.transform(runs, lambda r: F.length(r)).alias("insertions"))


def parse_hits(rows: DataFrame, database: DataFrame | None = None, most_identity: float = 105.0, least_columns: int = 10) -> DataFrame:
    """(structure_id, hit, label, qstart, tstart, query, template, similarity, confidence, prob, seqid, neff) of template-hit files.

    rows: (structure_id, line_no, line). The table of hits and the blocks that start with ">"
    correspond by order. Hits that are short, not in the database (name) or too similar are
    left out.
    """
    files = rows.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return parse_hit_files(files.select("structure_id", F.transform("_l", lambda x: x["line"]).alias("lines")), database, most_identity, least_columns)


def parse_hit_files(files: DataFrame, database: DataFrame | None = None, most_identity: float = 105.0, least_columns: int = 10) -> DataFrame:
    """parse_hits of whole files (structure_id, lines), lines in order; a row of the table and its block meet inside the file, so nothing is shuffled."""
    files = files.select("structure_id", F.transform("lines", lambda x: F.rtrim(x)).alias("l"))
    first = F.array_position("l", "") + 2
    rest = F.slice("l", first, F.size("l"))
    listed = F.slice(rest, F.lit(1), F.greatest(F.array_position(rest, "") - 1, F.lit(0)))
    starts = F.filter(F.transform("l", lambda x, i: F.when(x.startswith(">"), i)), lambda i: i.isNotNull())
    number = lambda a, n: F.get(F.split(F.trim(F.substring("row", a, n)), "-"), 0).try_cast("int")
    #  a row and the lines of its block, so that a file isn't repeated for each of its hits
    block = lambda at: F.array(*[F.get("l", at + k) for k in range(12)])
    met = F.transform(F.arrays_zip(listed.alias("row"), starts.alias("at")), lambda x, i: F.struct(i.alias("hit"), x["row"].alias("row"), block(x["at"]).alias("b"), x["at"].isNotNull().alias("has")))
    met = F.filter(met, lambda x: x["row"].isNotNull() & x["has"])
    blocks = files.select("structure_id", F.explode(met).alias("m")).select("structure_id", "m.hit", "m.row", F.col("m.b").alias("l"))
    blocks = blocks.filter(number(70, 6) >= least_columns)
    word = lambda k: F.get(F.split(F.trim(F.get("l", k)), r"\s+"), 3)
    stat = lambda k: F.get(F.regexp_extract_all(F.get("l", 1), F.lit(r"=\s*([-+0-9.eE]+)"), F.lit(1)), k).try_cast("double")
    blocks = blocks.select(
        "structure_id", "hit", F.trim(F.substring("row", 5, 6)).alias("label"), (number(76, 9) - 1).alias("qstart"), (number(86, 9) - 1).alias("tstart"), word(4).alias("query"), word(8).alias("template"),
        F.substr(F.get("l", 6), F.lit(23)).alias("similarity"), F.substr(F.get("l", 11), F.lit(23)).alias("confidence"),
        (stat(0) / 100).alias("prob"), (stat(4) / 100).alias("seqid"), (stat(7) / 10).alias("neff"),
    )
    found = blocks.filter(F.col("seqid") * 100 <= most_identity)
    return found if database is None else found.join(database.select(F.col("name").alias("label")), "label", "left_semi")


def hit_matches(hits: DataFrame, least: int = 10, also: list[str] | None = None) -> DataFrame:
    """(structure_id, hit, label, also, q, t, similarity, confidence): matched places of hits with at least so many.

    Similarity is a place in "=-.+|", confidence a digit; -1 where there is none. Running
    places are counted along the columns of a hit, which are few, inside its row.
    """
    of = F.struct("qstart", "tstart", "query", "template", "similarity", "confidence")
    seen = lambda line, i: F.length(F.replace(F.substr(line, F.lit(1), i + 1), F.lit("-"), F.lit("")))
    #  past its end a line has the empty string, which instr would find
    code = lambda letters, line, i: F.when(i < F.length(line), F.instr(F.lit(letters), F.substr(line, i + 1, F.lit(1))) - 1).otherwise(-1)

    def places(h):
        place = lambda i: F.struct(
            (h["qstart"] + seen(h["query"], i) - 1).alias("q"), (h["tstart"] + seen(h["template"], i) - 1).alias("t"),
            code("=-.+|", h["similarity"], i).alias("similarity"), code("0123456789", h["confidence"], i).alias("confidence"),
        )
        n = F.least(F.length(h["query"]), F.length(h["template"]))
        whole = h["query"].isNotNull() & h["template"].isNotNull() & h["similarity"].isNotNull() & h["confidence"].isNotNull() & (n > 0)
        return F.when(whole, F.filter(F.transform(F.sequence(F.lit(0), n - 1), place), lambda x: x["similarity"] >= 0))

    enough = g.let(g.let(of, places), lambda found: F.when(F.size(found) >= least, found))
    return hits.select("structure_id", "hit", "label", *(also or []), F.inline(enough))


def read_archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, offset, length) of a tab-separated archive index."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
    return spark.read.csv(path, sep="\t", schema=schema)


def archive_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(offset, text): an archive's NUL-closed entries with the byte each starts at.

    The file is split at NULs and dealt out by blocks; offsets are sums inside a block plus
    the sums of the blocks before.
    """
    rows = spark.read.text(path, lineSep="\0").select(
        F.col("value").alias("text"),
        (F.octet_length("value") + 1).cast("long").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = rows.groupBy("block").agg(F.sum("size").alias("sum"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks, "block")
    return placed.select((F.col("start") + F.col("before")).alias("offset"), "text")


def archive_entries(index: DataFrame, blobs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(name, text) of the entries of those names, or all, by an equi-join on the offset."""
    wanted = index if names is None else index.join(names, "name", "left_semi")
    return wanted.join(blobs, "offset").select("name", "text")


def archive_index(entries: DataFrame) -> DataFrame:
    """(name, offset, length) for entries (name, text) laid out in order of name, each with a closing NUL."""
    sizes = entries.select("name", (F.octet_length("text") + 1).cast("long").alias("length"))
    return with_earlier(sizes, ["name"], "offset", size=F.col("length")).select("name", "offset", "length")
