"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every source's documents are put in a random order that depends on their ids and texts, so
that rows of one id, or without any, are dealt out too. The order's keys are uniform, so equal ranges of them are equal shares of a source: a large
source is dealt over as many ranges as its rows need, each sorted and summed by itself,
and the sums of ranges give each its offset. A source's budget is then cut at the exact
word, after whole epochs where the budget exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import matching_rows, row_key, settle, text_of, word_count

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = (3, 2)  # 150 % of all words
MAX_EPOCHS = 2
ROWS_PER_RANGE = 4_000
#: Leading hex digits of the order key that make up the range number.
RANGE_DIGITS = 8
#: The most sources whose targets, a hundred bytes each, are broadcast.
BROADCAST_SOURCES = 100_000


def _running(sums: DataFrame, order: str, value: str, out: str, group: list[str]) -> DataFrame:
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size), one row each, to (source, source_size, weight, target).

    Sources in code-point order, null last, take the weights in turn. Targets are
    proportional to weights and sum to share of all words, but stop at max_epochs times
    the source; what that leaves over goes to the others by weight until none is above.
    That is one water level: sources are capped in the order of cap / weight, and the
    level follows from the sums over the capped ones.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(turn, (F.row_number().over(place) - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * share[0] / F.lit(share[1]).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("is_capped", F.col("weight") * ((F.col("budget") - F.col("capped")) / F.col("open_weight")) >= F.col("cap"))
    )
    open_rows = F.when(~F.col("is_capped"), F.struct(F.col("capped"), F.col("budget"), F.col("open_weight")))
    level = F.min(open_rows).over(everything)
    return spread.withColumn("level", level).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("is_capped"), F.col("cap").cast("double"))
        .otherwise((F.col("level.budget") - F.col("level.capped")) * F.col("weight") / F.col("level.open_weight"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    rows_per_range: int = ROWS_PER_RANGE,
    **weighting,
) -> DataFrame:
    """One row per row of docs: (id, source, size, source_size, target, taken, _key).

    size is the number of words, 0 for a null or empty text. taken counts words the mix
    takes of the row, repeats included: size times the whole epochs, and what is left of
    the budget of floor(target) words in the source's random order. The one document at
    the cut is taken in part. Ties in the order go by id, then size; repeated rows are
    separate rows. A null source is a source of its own. An empty table gives no rows,
    and a source without words takes none.
    """
    named = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    rows = settle(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            named.alias("_source"),
            word_count(text_col).alias("size"),
            row_key(text_col).alias("_key"),
            F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col)), F.lit(seed))).alias("order_key"),
        )
    )
    sizes = rows.groupBy("source", "_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranges = sizes.select("_source", F.ceil(F.col("rows") / rows_per_range).alias("ranges"))
    targets = source_targets(sizes.select("source", "source_size"), **weighting)
    targets = targets.withColumn("_source", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    targets = settle(targets.join(ranges, "_source").select("_source", "source_size", "target", "ranges"))
    if targets.count() <= BROADCAST_SOURCES:
        dealt = rows.join(F.broadcast(targets), "_source")
    else:  # the join's own dealing, by source alone, would keep a large source together
        dealt = rows.join(targets, "_source").withColumn("_spread", F.lit(0))
    share = F.conv(F.substring("order_key", 1, RANGE_DIGITS), 16, 10).cast("long")
    dealt = dealt.withColumn("range", F.floor(share * F.col("ranges") / float(16**RANGE_DIGITS)))
    if "_spread" in dealt.columns:
        dealt = dealt.drop("_spread").repartition("_source", "range")
    sums = dealt.groupBy("_source", "range").agg(F.sum("size").alias("words"))
    offsets = _running(sums, "range", "words", "offset", ["_source"]).select("_source", "range", "offset")
    inside = Window.partitionBy("_source", "range").orderBy("order_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_source", "range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("before")
    return placed.withColumn("epochs", epochs).select(
        F.col("_id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"),
        "_key",
    )


def first_words(text, n):
    """The text up to the end of its n-th word; n is at most the number of words, and 1 at least."""
    lead, rest = r"\A[\x20\x09-\x0D]*", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"  # each character is read once
    words = F.slice(F.regexp_extract_all(text, F.lit(rest), F.lit(0)), F.lit(1), n)
    return F.concat(F.regexp_extract(text, lead, 0), F.regexp_replace(F.array_join(words, ""), r"(?<![\x20\x09-\x0D])[\x20\x09-\x0D]++\z", ""))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The rows of the mix, with the columns of docs.

    A document comes once for each whole epoch it is taken in; the one at its source's
    cut also comes with its first words only, its length in chars_col corrected. A
    document without words adds none to any budget and comes once if its source is
    wanted at all, so that empty rows are not lost here.
    """
    taken = mix(docs, id_col, text_col, source_col)
    pairs = settle(
        taken.groupBy(F.col(id_col).alias("_id"), "_key").agg(
            F.count("*").alias("_rows"),
            F.max("size").alias("_size"),
            F.sum("taken").alias("_taken"),
            F.sum(F.when((F.col("size") == 0), 1).otherwise(0)).alias("_blank"),
        )
    ).filter("_taken > 0 or _blank > 0")
    rows = matching_rows(docs, pairs, id_col, text_col)
    whole = F.when(F.col("_size") > 0, F.expr("_taken div _size")).otherwise(F.col("_blank"))
    part = F.when(F.col("_size") > 0, F.col("_taken") % F.col("_size")).otherwise(F.lit(0))
    copies = F.array_repeat(F.lit(-1).cast("long"), whole.cast("int"))
    rows = rows.select("doc", F.explode(F.concat(copies, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))).alias("part"))
    text, in_part = F.col("doc").getField(text_col), F.col("part") >= 0
    rows = rows.withColumn("cut", F.when(in_part, first_words(text_of(text), F.greatest(F.col("part"), F.lit(0)).cast("int"))).otherwise(text))
    given = {text_col: F.col("cut")}
    if chars_col in docs.columns:
        chars = F.col("doc").getField(chars_col)
        given[chars_col] = F.when(in_part, F.length("cut").cast(dict(docs.dtypes)[chars_col])).otherwise(chars)
    return rows.select(*[given.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
