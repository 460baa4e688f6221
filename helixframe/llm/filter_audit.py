"""Audit of how filters interact: what each removes at each place of every order.

A document is read once and becomes a mask of the filters that it fails. Documents of one
part, mask and labels are one cell, so at most a few dozen cells a part are left of any
number of documents. Cells are unpivoted against the steps of all orders; a running bit-or
window over an order's steps has the failures of earlier ones, and conditional sums and
windows over each filter make the figures.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import settle, text_of

# The filters' thresholds and the marks of filter D.
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5
MARKS = "[#$%&*|]"
#: The filters' letters; the n-th is bit n of a mask.
FILTERS = "ABCDE"

SPACE = r"[\x20\x09-\x0D]+"


def text_mask(words: Column, text: Column) -> Column:
    """Bits of the filters that look at one text alone: A to D."""
    n, capitals = F.size(words), F.regexp_count(text, F.lit("[A-Z]"))
    fails = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        100 * capitals > CAPITALS_PERCENT * F.length(text),
        text.rlike(MARKS),
    )
    return sum((F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: (_id, part, digest, mask), the mask without filter E."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    return rows.select("_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("words"), F.col("text")).alias("mask"))


def filter_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail exactly these filters, by label.

    Of documents with one text all but those of the smallest id fail E; one without an id
    neither fails it nor makes others fail it. Only digests and masks are shuffled. Copies
    are counted in their task and then by (text, part, labels), so a hot text is a few rows.
    """
    told = labels.groupBy(F.col(id_col).alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = masks(docs, id_col, text_col, source_col).join(told, "_id", "left")
    kinds = ["part", "digest", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    rows = rows.groupBy(*kinds, "_id").agg(F.count("*").alias("n"))  # rows that repeat an id are several at the smallest one
    named = F.when(F.col("_id").isNotNull(), F.struct("_id", "n"))
    kinds = ["part", "digest", "mask", "good", "toxic"]
    copies = settle(
        rows.groupBy(*kinds).agg(
            F.sum("n").alias("n"), F.min(named).alias("first"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
        )
    )
    repeated = settle(copies.groupBy("digest").agg(F.min("first._id").alias("least"), F.sum("n").alias("all")).filter("all > 1").drop("all"))
    copies = copies.join(repeated, "digest", "left")
    stays = F.col("nameless") + F.when(F.col("first._id") == F.col("least"), F.col("first.n")).otherwise(0)
    stays = F.when(F.col("least").isNull(), F.col("n")).otherwise(stays)
    bit = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask"), stays.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - stays).alias("n")))).alias("c")
    cells = copies.select("part", "good", "toxic", split).select("part", "c.mask", "good", "toxic", "c.n").filter("n > 0")
    return cells.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, ...) from cells (part, mask, good, toxic, n): one row per part, order and step, zeros included."""
    cells = cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic")
    )
    cells = settle(cells)
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    steps = cells.withColumn("filter_order", F.explode(orders))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter")).filter("letter != ''")
    bit = F.expr(f"shiftleft(1, instr('{filters}', letter) - 1)")
    steps = steps.select("*", (F.col("place") + 1).alias("step"), bit.alias("bit"), F.col("mask").bitwiseAND(bit).alias("fails"))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(earlier), F.lit(0)))
    still, failed = F.col("earlier") == 0, F.col("fails") != 0
    counted = lambda what, when: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    table = steps.groupBy("part", "filter_order", "step", "letter").agg(
        counted("n", still & ~failed).alias("kept"),
        counted("n", still & failed).alias("removed"),
        counted("n", ~still & failed).alias("redundant"),
        counted("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        counted("good", still & failed).alias("good_lost"),
        counted("toxic", still & failed).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return table.withColumn("shapley", shapley).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per part (a source; null is the empty one), order of the filters and step, with document counts of the part.

    The filters: A, under MIN_WORDS words; B, distinct words under DISTINCT_PERCENT of all;
    C, capitals over CAPITALS_PERCENT of the code points; D, any of MARKS; E, the text of
    another document of smaller id, anywhere in the table and whether removed or not. A
    null or empty text has no words or code points: it fails A alone, and E. kept: left
    after this step; removed: at this step; redundant: failing its filter, removed before;
    unique_fails: failing its filter only; good_lost, toxic_lost: removed here and labelled
    quality 1, toxic 1 by any row of labels; shapley: its filter's removed over all orders.
    Rows that repeat an id are documents of their own, none smaller than the other. An
    empty table gives no rows; columns other than those named are not read.
    """
    return interactions(filter_cells(docs, labels, id_col, text_col, source_col))
