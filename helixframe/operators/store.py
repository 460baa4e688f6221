"""Record stores: scans, runtime-column filters, size bands, inserts and deletes over DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.scratch import settled

TF_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + [T.StructField(c, T.StringType(), False) for c in ("accession", "names", "species", "database", "sequence", "publications")]
)
_LINKER_STRINGS = (
    "left_short_name", "left_pssm_id", "left_accession", "right_short_name", "right_pssm_id", "right_accession", "sasa", "pdb_id",
)
LINKER_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("linker", T.StringType(), False),
        T.StructField("length", T.StringType(), False, {"comment": "长度"}),
        T.StructField("full_domain", T.IntegerType(), False, {"comment": "所属全长域"}),
    ]
    + [T.StructField(c, T.StringType(), False) for c in _LINKER_STRINGS]
)
# Size names and their inclusive lengths; large repeats middle, and any other name is (0, 0).
BANDS = {"small": (20, 40), "middle": (40, 60), "large": (40, 60), "very_large": (80, 100)}
STRICT_BANDS = BANDS | {"large": (60, 80)}


def column(df: DataFrame, name: str) -> str:
    """The column of that name, in any case; names reach no SQL text."""
    found = [c for c in df.columns if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name!r}; there are {', '.join(df.columns)}")
    return found[0]


def without_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.drop(id_col)


def equals(df: DataFrame, name: str, value) -> DataFrame:
    """Rows whose column equals the value; a string column is compared as text, whatever the value's type."""
    name = column(df, name)
    if dict(df.dtypes)[name] == "string":
        return df.filter(F.col(name) == F.lit(str(value)))
    return df.filter(F.col(name) == F.lit(value).try_cast(dict(df.dtypes)[name]))


def like_any_case(name: str, text: str) -> Column:
    """Substring search in which % and _ of the text stay wildcards, letters in either case."""
    return F.col(name).ilike(f"%{text}%")


def query(df: DataFrame, name: str, value, search_col: str = "names") -> DataFrame:
    """All rows for an empty column name, substring search on search_col, else equality."""
    if name == "":
        return df
    if name.lower() == search_col.lower():
        return df.filter(like_any_case(column(df, name), str(value)))
    return equals(df, name, value)


def in_band(length: Column, size: str, strict: bool = False) -> Column:
    low, high = (STRICT_BANDS if strict else BANDS).get(size, (0, 0))
    return F.coalesce(length.try_cast("int").between(low, high), F.lit(False))


def ends_with_residues(linker: Column, first: str, last: str) -> Column:
    """First and last letter; "all" takes any. False for an empty linker unless both are "all"."""
    ends = F.lit(True)
    for letter, place in ((first, 1), (last, -1)):
        if letter != "all":
            ends = ends & (F.substring(linker, place, 1) == letter)
    return F.coalesce(ends, F.lit(False))


def linker_query(df: DataFrame, size: str, first: str = "all", last: str = "all", length_col="length", linker_col="linker", strict: bool = False) -> DataFrame:
    """Size band and end residues in one filter that reaches the scan."""
    return df.filter(in_band(F.col(length_col), size, strict) & ends_with_residues(F.col(linker_col), first, last))


def append(df: DataFrame, rows: DataFrame, id_col: str | None = None) -> DataFrame:
    """Both, by column name. With id_col, new rows are numbered on from the largest id, in the order of their columns."""
    if id_col is None:
        return df.unionByName(rows)
    #  places inside partitions plus the partitions' offsets: no task sees all rows
    top = df.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).first()["top"]
    tagged = settled(rows.select(*[c for c in df.columns if c != id_col]).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = tagged.withColumn("_part", part).join(offsets, "_part")
    made = numbered.withColumn(id_col, (F.lit(top) + 1 + F.col("_before") + place).cast(dict(df.dtypes)[id_col]))
    return df.unionByName(made.select(*df.columns))


def delete(df: DataFrame, name: str, value) -> DataFrame:
    """What is left without the rows that equals() gives; rows of null stay."""
    name = column(df, name)
    value = F.lit(str(value)) if dict(df.dtypes)[name] == "string" else F.lit(value).try_cast(dict(df.dtypes)[name])
    return df.filter(~F.coalesce(F.col(name) == value, F.lit(False)))


def envelope(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows as JSON objects without the id; null fields are kept."""
    rows = without_id(df, id_col)
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("content"))


def dispatch(df: DataFrame, command: str, data: dict) -> tuple[int, DataFrame]:
    """(status, rows or the changed table) of an add, query, delete or Cquery request; -1 for any other."""
    if command == "add":
        kinds = dict(df.dtypes)
        names = [column(df, c) for c in data["col_name"]]
        schema = ", ".join(f"`{c}` string" for c in names)
        rows = df.sparkSession.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in data["content"]], schema)
        return 0, append(df, rows.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in names]), "id")
    if command == "query":
        return 0, without_id(query(df, data["col_name"], data["content"]))
    if command == "delete":
        return 0, delete(df, data["col_name"], data["content"])
    if command == "Cquery" and "linker" in df.columns:
        return 0, without_id(linker_query(df, data["size"], data["N"], data["C"]))
    return -1, df.limit(0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that are not unique."""
    return df.groupBy(*keys).count().filter("count > 1")


def summary_columns(names: list[str]) -> list[str]:
    """Of a score summary, without differences, references and everything with a capital W."""
    return [n for n in names if not re.search(r"_diff|_ref|W", n)]


def overwrite_blob(df: DataFrame, text: str) -> DataFrame:
    """A one-row text table with another text."""
    return df.sparkSession.createDataFrame([(text,)], "text string")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
