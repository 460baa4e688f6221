"""What the text operators share: scratch tables, word counts, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.scratch import settled as settle

#: What white space separates.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space that one space is to replace; a single space, the usual case, is left as it is.
GAP = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def squeezed(column: str | Column) -> Column:
    """The text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(text_of(column), GAP, " ")


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def row_key(text_col: str) -> Column:
    """With the id, tells rows apart; rows that agree in both are repeated rows."""
    return F.xxhash64(text_of(text_col))


def matching_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs joined to chosen (_id, _key, _rows, payload...), one row for each row of chosen: (doc, payload...).

    _key is row_key() and _rows says how many rows of docs carry the pair. Where a
    pair is repeated, one of its rows stands for them. doc holds the columns of docs
    under their own names, whatever they are; "doc.*" gives them back.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("_doc_id"), row_key(text_col).alias("_doc_key"))
    joined = keyed.join(chosen, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_doc_key") == F.col("_key")))
    if not chosen.filter("_rows > 1").isEmpty():
        again = joined.filter("_rows > 1").dropDuplicates(["_id", "_key"])
        joined = joined.filter("_rows = 1").unionByName(again)
    return joined.select("doc", *[c for c in chosen.columns if c not in ("_id", "_key", "_rows")])
