"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A bin never holds two documents of one source, or two of one duplicate cluster. Within a
shard, bins stand by what room they have left, and three families of bitmaps over the
bins say which have a given room, which hold a given source and which a given cluster. A
document takes the tightest compatible bin: the search starts at the room it needs and
goes on to the next room in order until one is left after the bitmaps of its source and
cluster are taken out. A document that finds none opens a bin.

Shards are dealt by a hash of the row, so that a large source or cluster is spread evenly
over all of them; each has a bounded number of pieces and packs by itself, which costs at
most a few half-filled bins a shard. A document longer than a bin is cut into pieces: full
ones, each a bin of its own, and the rest, which is packed like any other.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import settle, squeezed, text_of, word_count

BIN_WORDS = 1024
ROWS_PER_SHARD = 8_000


class Bins:
    """The open bins of a shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms = 0  # bit r: some bin has room r
        self.by_room: dict[int, int] = defaultdict(int)
        self.by_source: dict[str, int] = defaultdict(int)
        self.by_cluster: dict[str, int] = defaultdict(int)
        self.used: list[int] = []

    def _move(self, bin_bit: int, old: int | None, new: int) -> None:
        if old is not None:
            self.by_room[old] ^= bin_bit
            if not self.by_room[old]:
                self.rooms &= ~(1 << old)
        self.by_room[new] |= bin_bit
        self.rooms |= 1 << new

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """The bin and the offset in it at which the piece goes."""
        taken = self.by_source[source] | self.by_cluster[cluster]
        rooms, room = self.rooms >> size, size
        while rooms:
            step = (rooms & -rooms).bit_length() - 1
            room += step
            if fits := self.by_room[room] & ~taken:
                bit = fits & -fits
                number = bit.bit_length() - 1
                self._move(bit, room, room - size)
                break
            rooms >>= step + 1
            room += 1
        else:
            number = len(self.used)
            bit = 1 << number
            self.used.append(0)
            self._move(bit, None, self.capacity - size)
        self.by_source[source] |= bit
        self.by_cluster[cluster] |= bit
        offset = self.used[number]
        self.used[number] += size
        return number, offset


def _pack_shard(capacity: int):
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["size", "order_key", "piece"], ascending=[False, True, True], kind="stable")
        bins = Bins(capacity)
        placed = [bins.place(*x) for x in zip(pieces["size"].tolist(), pieces["source_key"].tolist(), pieces["cluster"].tolist(), strict=True)]
        out = pieces[["_id", "source", "piece", "start", "size", "shard"]].copy()
        out["bin"] = [x[0] for x in placed]
        out["offset"] = [x[1] for x in placed]
        return out

    return pack


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    bin_words: int = BIN_WORDS,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """One row per piece: (id, source, piece, start, size, shard, bin, offset).

    start is the piece's first word in its document and offset its first word in the bin;
    (shard, bin) names the bin. Without cluster_col, documents with equal texts, white
    space aside, are a cluster. A null source or cluster conflicts with nothing. An empty
    or null text is one piece of size 0, which any compatible bin takes. Pieces go by
    size, largest first, ties by a hash of id and text; repeated rows are placed each for
    itself. An empty table gives no rows.
    """
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.sha2(squeezed(text_col), 256)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        cluster.alias("cluster"),
        word_count(text_col).alias("words"),
        F.xxhash64(F.col(id_col).cast("string"), text_of(text_col)).alias("order_key"),
    )
    rows = settle(rows.withColumn("_rid", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(rows.count() / rows_per_shard))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("words") - 1, F.lit(0)), F.lit(bin_words).cast("long"))
    pieces = rows.select("*", F.posexplode(starts).alias("piece", "start"))
    pieces = pieces.withColumn("size", F.least(F.lit(bin_words), F.col("words") - F.col("start")))
    #  a full piece is a bin of its own, named by its row and its place there
    full = pieces.filter(F.col("size") == bin_words).select(
        "_id", "source", "piece", "start", F.col("size").cast("long").alias("size"), F.lit(-1).cast("long").alias("shard"),
        F.concat_ws(":", "_rid", "piece").alias("bin"), F.lit(0).cast("long").alias("offset"),
    )
    alone = F.concat(F.lit("\x00"), F.col("_rid").cast("string"))
    rest = pieces.filter(F.col("size") < bin_words).select(
        "_id",
        "source",
        F.coalesce("source", alone).alias("source_key"),
        F.coalesce("cluster", alone).alias("cluster"),
        "piece",
        "start",
        "size",
        "order_key",
        F.pmod(F.xxhash64("order_key", "_rid"), F.lit(shards)).alias("shard"),
    )
    kind = dict(docs.dtypes)[id_col]
    packed = rest.groupBy("shard").applyInPandas(
        _pack_shard(bin_words), f"_id {kind}, source string, piece int, start long, size long, shard long, bin long, offset long"
    )
    packed = packed.withColumn("bin", F.col("bin").cast("string"))
    return packed.unionByName(full).withColumnRenamed("_id", id_col)
