"""Readers and writers of structure files: fixed-column atom records, residue summaries, text containers.

Files are read as whole texts, one row per file, since a line's meaning depends on the
lines before it; Spark deals files to tasks, and lines become rows inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.colour import blue_white_red
from helixframe.functions.text import fixed_column, fixed_precision
from helixframe.operators.relational import with_earlier

# First and last column of each field, 1-based.
PDB_FIELDS = {
    "label": (1, 6), "serial": (7, 11), "name": (13, 16), "altloc": (17, 17), "resname": (18, 20), "chain": (22, 22), "resnum": (23, 26),
    "icode": (27, 27), "x": (31, 38), "y": (39, 46), "z": (47, 54), "bfactor": (61, 66), "element": (77, 78),
}
_NUMBERS = {"serial": "int", "resnum": "int", "x": "double", "y": "double", "z": "double", "bfactor": "double"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, line_no, line): the file's name without its ending, and its lines."""
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("structure_id"))
    return files.select("structure_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def parse_pdb(rows: DataFrame, first_model: bool = True) -> DataFrame:
    """Atom records of (structure_id, line_no, line), up to the first END or ENDMDL; lines that don't parse are left out.

    A blank chain is "?". atom_idx is the record's place in its structure.
    """
    label = F.trim(F.substring("line", 1, 6))
    if first_model:
        stops = rows.filter(label.isin("END", "ENDMDL")).groupBy("structure_id").agg(F.min("line_no").alias("_stop"))
        rows = rows.join(stops, "structure_id", "left").filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop"))).drop("_stop")
    records = rows.filter(label.isin("ATOM", "HETATM"))
    fields = []
    for name, (a, b) in PDB_FIELDS.items():
        value = fixed_column(F.col("line"), a, b)
        if name in _NUMBERS:
            value = value.try_cast(_NUMBERS[name])
        if name == "bfactor":
            value = F.coalesce(value, F.lit(0.0))
        if name == "chain":
            value = F.when(value == "", "?").otherwise(value)
        fields.append(value.alias(name))
    parsed = records.select("structure_id", "line_no", *fields)
    good = parsed.filter("serial is not null and resnum is not null and x is not null and y is not null and z is not null")
    return good.withColumnRenamed("line_no", "atom_idx")


def read_pdb(spark: SparkSession, path: str, first_model: bool = True) -> DataFrame:
    return parse_pdb(lines(spark, path), first_model)


def pdb_lines(atoms: DataFrame, value: str = "bfactor") -> DataFrame:
    """(structure_id, line_no, line): 80-column records with a value of each atom, two decimals, in columns 61 to 66."""

    def right(column: Column, width: int) -> Column:
        return F.lpad(column.cast("string"), width, " ")

    name = F.when(F.length("name") < 4, F.rpad(F.concat(F.lit(" "), "name"), 4, " ")).otherwise(F.col("name"))
    chain = F.when(F.col("chain") == "?", " ").otherwise(F.substring("chain", 1, 1))
    line = F.concat(
        F.rpad(F.coalesce("label", F.lit("ATOM")), 6, " "), right(F.col("serial"), 5), F.lit(" "), name, F.rpad(F.col("altloc"), 1, " "),
        F.lpad(F.col("resname"), 3, " "), F.lit(" "), chain, right(F.col("resnum"), 4), F.rpad(F.col("icode"), 1, " "), F.lit("   "),
        *[right(fixed_precision(F.col(c), 3), 8) for c in "xyz"], F.lit("  1.00"), right(fixed_precision(F.col(value), 2), 6),
        F.lit(" " * 10), F.lpad(F.col("element"), 2, " "), F.lit("  "),
    )
    return atoms.select("structure_id", F.col("atom_idx").alias("line_no"), line.alias("line"))


def parse_dssp(rows: DataFrame) -> DataFrame:
    """(structure_id, resnum, icode, chain, aa, ss) of the lines after the header that starts with "  #  RESIDUE"; breaks are left out."""
    heads = rows.filter(F.col("line").startswith("  #  RESIDUE")).groupBy("structure_id").agg(F.min("line_no").alias("_head"))
    body = rows.join(heads, "structure_id").filter((F.col("line_no") > F.col("_head")) & (F.trim("line") != ""))
    fields = {"resnum": (6, 10), "icode": (11, 11), "chain": (12, 12), "aa": (14, 14), "ss": (17, 17)}
    parsed = body.select("structure_id", *[fixed_column(F.col("line"), a, b).alias(n) for n, (a, b) in fields.items()])
    return parsed.filter("aa <> '!'").withColumn("resnum", F.col("resnum").try_cast("int")).filter("resnum is not null")


def parse_container(rows: DataFrame, header: str) -> DataFrame:
    """(structure_id, ordinal, fields) of the block "header, count, rows" in text containers; comments and blank lines don't count.

    Rows beyond the count belong to the next block.
    """
    kept = rows.filter((F.trim("line") != "") & ~F.col("line").startswith("#"))
    heads = kept.filter(F.trim("line") == header).groupBy("structure_id").agg(F.min("line_no").alias("_head"))
    after = kept.join(heads, "structure_id").filter(F.col("line_no") > F.col("_head"))
    ordered = after.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    count = F.coalesce(F.trim(F.get("_l", 0)["line"]).try_cast("int"), F.lit(0))
    block = ordered.select("structure_id", F.posexplode(F.slice("_l", F.lit(2), count)).alias("ordinal", "_x"))
    return block.select("structure_id", "ordinal", F.split(F.trim(F.col("_x")["line"]), r"\s+").alias("fields"))


def container_lines(rows: DataFrame, header: str, order: list[str]) -> DataFrame:
    """(line_no, line) of one block: the header, the count, the rows in order, their columns separated by spaces."""
    body = rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns]).alias("line"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    placed = with_earlier(body, [f"_o{i}" for i in range(len(order))], "_before").select((F.col("_before") + 2).alias("line_no"), "line")
    count = rows.agg(F.count("*").cast("string").alias("line")).select(F.lit(1).cast("long").alias("line_no"), "line")
    head = count.select(F.lit(0).cast("long").alias("line_no"), F.lit(header).alias("line"))
    return head.unionByName(count).unionByName(placed)


def radius_tables(spark: SparkSession, classes_path: str, members_path: str) -> tuple[DataFrame, DataFrame]:
    """(class, radius) and (pattern, class) from two white-space tables."""
    first, second = F.get(F.split(F.trim("value"), r"\s+"), 0), F.get(F.split(F.trim("value"), r"\s+"), 1)
    classes = spark.read.text(classes_path).select(first.alias("class"), second.try_cast("double").alias("radius")).filter("radius is not null")
    members = spark.read.text(members_path).select(first.alias("pattern"), second.alias("class")).filter("class is not null")
    return classes, members


def map_image(contacts: DataFrame, value: Column) -> DataFrame:
    """(x, y, value, rgb): pixels of a contact map over dense indices a_idx and b_idx."""
    return contacts.select(F.col("a_idx").alias("x"), F.col("b_idx").alias("y"), value.alias("value"), blue_white_red(value).alias("rgb"))


# Names of the scores and how their lines read.
_TM_LINES = {
    "TM_score": r"TM-score\s*=\s*([0-9.]+)\s*\(.*d0", "TM_score_GDT_TS": r"GDT-TS-score\s*=\s*([0-9.]+)\s*%", "TM_score_GDT_HA": r"GDT-HA-score\s*=\s*([0-9.]+)\s*%",
}


def tm_scores(rows: DataFrame) -> DataFrame:
    """(structure_id, TM_score, TM_score_GDT_TS, TM_score_GDT_HA) of score listings; 0 where a line is missing."""
    found = [F.max(F.regexp_extract("line", pattern, 1).try_cast("double")).alias(name) for name, pattern in _TM_LINES.items()]
    return rows.groupBy("structure_id").agg(*found).fillna(0.0)


def secondary_structure(rows: DataFrame) -> DataFrame:
    """(structure_id, ss_pred, ss_conf): the second fields of the lines that start with Pred and Conf, joined in order."""

    def joined(word: str) -> Column:
        part = F.when(F.col("line").startswith(word), F.struct("line_no", F.get(F.split(F.trim("line"), r"\s+"), 1).alias("s")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: F.coalesce(x["s"], F.lit(""))), "")

    return rows.groupBy("structure_id").agg(joined("Pred").alias("ss_pred"), joined("Conf").alias("ss_conf"))
