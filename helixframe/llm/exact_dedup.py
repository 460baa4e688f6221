"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of code points. Distinct
blocks are sorted and get integer names; then adjacent pairs of names get names of
their own, level by level, until every document has one. Two documents have the same
number of blocks and the same last name exactly when their texts are equal.

Block texts cross the network once, as distinct (hash, block) rows that each task has
already thinned out. Rows of documents find their names by the hash; hashes that two
different blocks share are found in that pass, and their blocks are then compared as
whole texts, so no hash collision can merge two documents. A hot block or a hot group
of copies only skews the probe side of joins, which Spark splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import matching_rows, row_key, settle, squeezed

BLOCK_CHARS = 4096


def _blocks(text: F.Column, block_chars: int):
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def _hash(block, hash_bits: int):
    hashed = F.xxhash64(block)
    return hashed if hash_bits >= 64 else F.pmod(hashed, F.lit(1 << hash_bits))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of rows with an integer name each, in sorted order within a shuffle partition."""
    distinct = rows.select(*keys).distinct()
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _block_names(docs: DataFrame, text_col: str, compact: DataFrame, block_chars: int, hash_bits: int) -> DataFrame:
    """(_rid, n_blocks, pos, name): level 0."""
    blocks = docs.select(F.explode(_blocks(squeezed(text_col), block_chars)).alias("block"))
    blocks = blocks.select(_hash(F.col("block"), hash_bits).alias("h"), "block")
    names = settle(_named(blocks, ["h", "block"]).groupBy("h").agg(F.min("name").alias("name"), F.count("*").alias("n")))
    rows = compact.select("_rid", "n_blocks", F.posexplode("hashes").alias("pos", "h"))
    shared = names.filter("n > 1").select("h")
    if shared.isEmpty():
        return rows.join(names.select("h", "name"), "h").select("_rid", "n_blocks", "pos", "name")
    plain = rows.join(names.filter("n = 1").select("h", "name"), "h")
    clash_names = _named(blocks.join(shared, "h", "left_semi"), ["h", "block"]).withColumn("name", -1 - F.col("name"))
    text = squeezed(text_col)
    keyed = docs.select(F.sha2(text, 256).alias("text_sha256"), _blocks(text, block_chars).alias("blocks"))  # once a text, not once a block
    keyed = keyed.select("text_sha256", F.posexplode("blocks").alias("pos", "block"))
    keyed = keyed.select("text_sha256", "pos", _hash(F.col("block"), hash_bits).alias("h"), "block").join(shared, "h", "left_semi")
    #  SHA-256 leads back to the rows: a 64-bit key of a text of one block would collide where its block does
    clashing = keyed.join(clash_names, ["h", "block"]).select("text_sha256", "pos", "h", "name").distinct()
    exact = rows.join(compact.select("_rid", "text_sha256"), "_rid").join(clashing, ["text_sha256", "pos", "h"])
    columns = ["_rid", "n_blocks", "pos", "name"]
    return plain.select(*columns).unionByName(exact.select(*columns))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64
) -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, text_sha256, n_blocks, _key).

    Texts are equal when they agree after each run of white space became one space; a
    null text is empty. keep_id is the smallest id of the group, nulls aside. kept marks
    one row of each group: the one with keep_id, and of repeated rows one only. An empty
    table gives no rows. Columns of docs other than these two are not read. hash_bits is
    64 but in tests, which narrow it to force collisions.
    """
    text = squeezed(text_col)
    compact = settle(
        docs.select(
            F.monotonically_increasing_id().alias("_rid"),
            F.col(id_col).alias("_id"),
            row_key(text_col).alias("_key"),
            F.sha2(text, 256).alias("text_sha256"),
            F.transform(_blocks(text, block_chars), lambda b: _hash(b, hash_bits)).alias("hashes"),
        ).withColumn("n_blocks", F.size("hashes"))
    )
    longest = compact.agg(F.max("n_blocks")).first()[0] or 1
    level, done, width = settle(_block_names(docs, text_col, compact, block_chars, hash_bits)), [], 1
    while True:
        done.append(level.filter(F.col("n_blocks") <= width).select("_rid", "n_blocks", "name"))
        if width >= longest:
            break
        pairs = (
            level.filter(F.col("n_blocks") > width)
            .groupBy("_rid", "n_blocks", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
            )
            .withColumn("left", F.coalesce("left", F.lit(-(1 << 62))))
            .withColumn("right", F.coalesce("right", F.lit(-(1 << 62))))
        )
        level = settle(pairs.join(_named(pairs, ["left", "right"]), ["left", "right"]).select("_rid", "n_blocks", "pos", "name"))
        width *= 2
    identity = reduce(DataFrame.unionByName, done)
    rows = settle(compact.drop("hashes", "n_blocks").join(identity, "_rid"))
    groups = settle(rows.groupBy("n_blocks", "name").agg(
        F.min("_id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id"), F.col("_rid"))).getField("_rid").alias("_keep_rid"),
    ))  # read from a table, so that Spark can split a hot group on the other side of the join
    return rows.join(groups, ["n_blocks", "name"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_rid") == F.col("_keep_rid")).alias("kept"),
        "text_sha256",
        "n_blocks",
        "_key",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with the columns of docs."""
    judged = exact_dedup(docs, id_col, text_col)
    pairs = settle(
        judged.groupBy(F.col(id_col).alias("_id"), "_key").agg(F.count("*").alias("_rows"), F.max("kept").alias("_kept"))
    )
    return matching_rows(docs, pairs.filter("_kept").drop("_kept"), id_col, text_col).select("doc.*")
