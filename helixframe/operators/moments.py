"""Weighted second moments of an alignment's columns, as partial sums that merge.

An alignment's rows are dealt into chunks and its columns into blocks. A task has one chunk's
rows at two blocks of columns and makes the sum of their weighted outer products, one-hot by
state; sums of chunks are added, a few at a time, until one is left for each two blocks.
No task holds an alignment, and only what needs the finished matrix, its inverse, puts the
blocks together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.functions.text import ALPHABET
from helixframe.scratch import settled

STATES = len(ALPHABET)
GAP = STATES - 1
#: Columns of a block, sequences of a chunk, and how many sums are added at a time.
BLOCK, CHUNK, TOGETHER = 32, 4096, 16
#: A state is a letter of its own, after this one; a place without a state is a question mark.
FIRST, NONE = ord("A"), "?"


def lettered(long: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(keys, seq, letters) of (keys, seq, pos, code): a letter for each place from 0 on."""
    places = F.array_sort(F.collect_list(F.struct("pos", "code")))
    rows = long.filter("pos is not null and code is not null").groupBy(*keys, seq).agg(places.alias("_places"))

    def letter(x: Column, i: Column) -> Column:
        before = F.when(i == 0, -1).otherwise(F.get("_places", i - 1)["pos"])
        return F.concat(F.repeat(F.lit(NONE), x["pos"] - before - 1), F.char(x["code"] + FIRST))

    return rows.select(*keys, seq, F.array_join(F.transform("_places", letter), "").alias("letters"))


def _one_hot(letters: pa.Array, width: int) -> np.ndarray:
    padded = "".join(x.ljust(width, NONE) for x in letters.to_pylist())
    code = np.frombuffer(padded.encode(), np.uint8).astype(np.int64) - FIRST
    return np.eye(STATES + 1)[np.where(code < 0, STATES, code)][:, :STATES].reshape(len(letters), -1)


def _products(keys: list[str], schema: pa.Schema):
    def products(group: pa.Table) -> pa.Table:
        wa, wb = (max(len(x) for x in group.column(c).to_pylist()) for c in ("_a", "_b"))
        a, b = _one_hot(group.column("_a"), wa), _one_hot(group.column("_b"), wb)
        sums = (a * group.column("weight").to_numpy()[:, None]).T @ b
        first = [group.column(c)[:1].combine_chunks() for c in (*keys, "i_block", "j_block", "part")]
        return pa.Table.from_arrays([*first, pa.array([wa], pa.int32()), pa.array([wb], pa.int32()), pa.array([sums.tobytes()], pa.binary())], schema=schema)

    return products


def placed(sums: bytes, wa: int, wb: int) -> np.ndarray:
    """As (place, state, place, state)."""
    return np.frombuffer(sums).reshape(wa, STATES, wb, STATES)


def _added(keys: list[str], schema: pa.Schema):
    def added(group: pa.Table) -> pa.Table:
        rows = group.select(["i_width", "j_width", "sums"]).to_pylist()
        wa, wb = (max(r[c] for r in rows) for c in ("i_width", "j_width"))
        total = np.zeros((wa, STATES, wb, STATES))
        for r in rows:  # chunks may end in shorter sequences
            total[: r["i_width"], :, : r["j_width"], :] += placed(r["sums"], r["i_width"], r["j_width"])
        first = [group.column(c)[:1].combine_chunks() for c in (*keys, "i_block", "j_block", "part")]
        return pa.Table.from_arrays([*first, pa.array([wa], pa.int32()), pa.array([wb], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    return added


def column_moments(
    long: DataFrame, weights: DataFrame, keys: list[str] | None = None, seq: str = "seq", block: int = BLOCK, chunk: int = CHUNK, together: int = TOGETHER
) -> DataFrame:
    """(keys, i_block, j_block, i_width, j_width, sums), i_block <= j_block: weighted counts of state pairs, as binary doubles (place, state, place, state).

    long is (keys, seq, pos, code), weights (keys, seq, weight); sequences without a weight
    count nothing, and places without a code have no state. An alignment of one block has
    one row, an empty table none.
    """
    keys = keys or []
    rows = lettered(long, keys, seq).join(weights.select(*keys, seq, "weight"), [*keys, seq])
    rows = settled(rows)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_parts"), F.ceil(F.max(F.length("letters")) / block).cast("int").alias("_blocks"))
    sizes = settled(sizes)
    most = sizes.agg(F.max("_parts")).first()[0] or 0
    sized = rows.join(sizes, keys) if keys else rows.join(F.broadcast(sizes), F.lit(True))  # one row without keys
    dealt = sized.withColumn("part", F.pmod(F.xxhash64(seq), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("i_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("j_block", F.explode(F.sequence(F.col("i_block"), F.col("_blocks") - 1)))
    at = lambda c: F.substr("letters", F.col(c) * block + 1, F.lit(block))
    dealt = dealt.select(*keys, "i_block", "j_block", "part", at("i_block").alias("_a"), at("j_block").alias("_b"), F.col("weight").cast("double").alias("weight"))
    dealt = dealt.filter("_a <> '' and _b <> ''")
    kinds = dict(long.dtypes)
    names = [*keys, "i_block", "j_block", "part"]
    fields = [pa.field(k, to_arrow_type(long.schema[k].dataType)) for k in keys]
    schema = pa.schema([*fields, *[pa.field(c, pa.int32()) for c in ("i_block", "j_block", "part", "i_width", "j_width")], pa.field("sums", pa.binary())])
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "i_block int, j_block int, part int, i_width int, j_width int, sums binary"])
    sums = dealt.groupBy(*names).applyInArrow(_products(keys, schema), ddl)
    while most > 1:
        sums = sums.withColumn("part", F.expr(f"part div {together}").cast("int")).groupBy(*names).applyInArrow(_added(keys, schema), ddl)
        most = -(-most // together)
    return sums.drop("part")


def entropies(moments: DataFrame, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, i, j, h, gaps), i < j: entropy of the weighted state pairs that occur at two places, and the weight share of gap pairs.

    Places that no sequence has both of have no row.
    """
    keys = keys or []
    fields = [pa.field(k, to_arrow_type(moments.schema[k].dataType)) for k in keys]
    schema = pa.schema([*fields, *[pa.field(c, pa.int32()) for c in "ij"], *[pa.field(c, pa.float64()) for c in ("h", "gaps")]])

    def of(batches):
        for batch in batches:
            for at, row in enumerate(batch.select(["i_block", "j_block", "i_width", "j_width", "sums"]).to_pylist()):
                f = placed(row["sums"], row["i_width"], row["j_width"])
                n = f.sum((1, 3))
                s = np.where(f > 0, f * np.log(np.where(f > 0, f, 1)), 0).sum((1, 3))
                i, j = (k.ravel() for k in np.indices(n.shape))
                there = (n.ravel() > 0) & (i + row["i_block"] * block < j + row["j_block"] * block)
                i, j, n, s, g = i[there], j[there], n.ravel()[there], s.ravel()[there], f[:, GAP, :, GAP].ravel()[there]
                own = [batch.column(k).take(pa.array(np.full(len(i), at))) for k in keys]
                numbers = [pa.array((i + row["i_block"] * block).astype(np.int32)), pa.array((j + row["j_block"] * block).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own, *numbers, pa.array(np.log(n) - s / n), pa.array(g / n)], schema=schema)

    kinds = dict(moments.dtypes)
    return moments.mapInArrow(of, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "i int, j int, h double, gaps double"]))


def assembled(blocks: list[dict], block: int = BLOCK) -> np.ndarray:
    """The whole matrix (places x 21, places x 21) from an alignment's rows of moments."""
    length = max(r["j_block"] * block + r["j_width"] for r in blocks)
    out = np.zeros((length, STATES, length, STATES))
    for r in blocks:
        f = placed(r["sums"], r["i_width"], r["j_width"])
        i, j = (slice(r[f"{c}_block"] * block, r[f"{c}_block"] * block + r[f"{c}_width"]) for c in "ij")
        out[i, :, j, :] = f
        out[j, :, i, :] = f.transpose(2, 3, 0, 1)
    return out.reshape(length * STATES, length * STATES)


def covariance(second: np.ndarray, total: float, count: int) -> np.ndarray:
    """Of the columns, from the second moments, the weights' sum and their number."""
    points = total - np.sqrt(total / count)
    points = points if points > 1e-9 else 1.0  # one sequence, or as many copies of one
    first = np.diag(second)  # a state's weighted count is its product with itself
    return (second - (2 / points - total / points**2) * np.outer(first, first)) / points


def inverse_covariance(second: np.ndarray, total: float, count: int, penalty: float) -> np.ndarray:
    """Of the regularised covariance, as (i, a, j, b)."""
    length = len(second) // STATES
    regular = covariance(second, total, count) + np.eye(len(second)) * penalty / np.sqrt(total)
    return np.linalg.inv(regular).reshape(length, STATES, length, STATES)


def with_totals(moments: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the sum and the number of an alignment's weights: _total, _count."""
    return moments.join(weights.groupBy(*keys).agg(F.sum("weight").cast("double").alias("_total"), F.count("weight").alias("_count")), keys)
