"""Alignments: encoding, coverage, sequence weights, profiles, pair statistics, couplings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.text import ALPHABET, residue_code, without_insertions
from helixframe.operators import moments
from helixframe.operators.relational import with_earlier
from helixframe.scratch import settled

STATES = len(ALPHABET)
GAP = STATES - 1


def encoded(rows: DataFrame, aligned_col: str = "aligned", keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(keys, seq, pos, code) of the match columns; letters outside the alphabet are gaps."""
    letters = F.split(without_insertions(F.col(aligned_col)), "")
    letters = F.filter(letters, lambda x: x != "")
    return rows.select(*(keys or []), seq, F.posexplode(letters).alias("pos", "letter")).select(*(keys or []), seq, "pos", residue_code(F.col("letter")).alias("code"))


def covered(long: DataFrame, share: float = 0.5, most: int | None = 20_000, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Rows of sequences with fewer than share gaps, the first most of them in order of seq (a cap the operation defines)."""
    keys = keys or []
    kept = long.groupBy(*keys, seq).agg(F.count_if(F.col("code") == GAP).alias("_gaps"), F.count("*").alias("_n")).filter(F.col("_gaps") < F.col("_n") * share)
    if most is not None:
        kept = with_earlier(kept, [seq], "_before", keys=keys).filter(F.col("_before") < most)
    return long.join(kept.select(*keys, seq), [*keys, seq], "left_semi")


def _block_neighbours(keys: list[str], seq: str, identity: float):
    """Counts, for the sequences of two blocks i and j, which of the other block agree in more than identity of their own columns."""

    def table(codes: pd.Series, width: int) -> np.ndarray:
        out = np.full((len(codes), width), -1, np.int16)
        for row, places in zip(out, codes, strict=True):
            for place in places:
                if place["pos"] is not None and place["code"] is not None:
                    row[place["pos"]] = place["code"]
        return out

    def count(group: pd.DataFrame) -> pd.DataFrame:
        width = 1 + max((p["pos"] for codes in group["_codes"] for p in codes if p["pos"] is not None), default=0)
        one, two = (group[group["_block"] == group[side]].reset_index(drop=True) for side in ("_i", "_j"))
        a, b = table(one["_codes"], width), table(two["_codes"], width)
        ours, theirs = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)
        for k, row in enumerate(a):
            there = row >= 0
            same = (b[:, there] == row[there]).sum(1)
            ours[k] = (same > one["_n"][k] * identity).sum()
            theirs += same > two["_n"].to_numpy() * identity
        out = one.assign(_c=ours)
        if group["_i"].iloc[0] != group["_j"].iloc[0]:
            out = pd.concat([out, two.assign(_c=theirs)])
        return out[[*keys, seq, "_c"]]

    return count


def sequence_weights(long: DataFrame, identity: float = 0.8, keys: list[str] | None = None, seq: str = "seq", block_rows: int = 1024) -> DataFrame:
    """(keys, seq, weight): 1 over the number of sequences, itself included, that agree in more than identity of the columns.

    Gaps agree with gaps. An alignment is dealt into blocks of about block_rows sequences,
    as many as it has rows for, and each two blocks meet in a task of their own.
    """
    keys = keys or []
    rows = long.groupBy(*keys, seq).agg(F.count("*").cast("double").alias("_n"), F.collect_list(F.struct("pos", "code")).alias("_codes"))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).alias("_blocks"))
    sized = rows.join(sizes, keys) if keys else rows.join(F.broadcast(sizes), F.lit(True))  # one row without keys
    placed = sized.withColumn("_block", F.pmod(F.xxhash64(seq), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    dealt = placed.select(*keys, seq, "_n", "_codes", "_block", other)
    dealt = dealt.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_other")
    kinds = dict(long.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in [*keys, seq]], "_c bigint"])
    counts = dealt.groupBy(*keys, "_i", "_j").applyInPandas(_block_neighbours(keys, seq, identity), schema)
    return counts.groupBy(*keys, seq).agg((1.0 / F.greatest(F.sum("_c"), F.lit(1))).alias("weight"))


def profile(long: DataFrame, weights: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(keys, pos, code, f): weighted frequencies of all 21 states, each plus 1e-9."""
    keys = keys or []
    joined = long.join(weights, [*keys, seq])
    sums = joined.groupBy(*keys, "pos", "code").agg(F.sum("weight").alias("_w"))
    by_pos = sums.groupBy(*keys, "pos").agg(F.sum("_w").alias("_total"), F.map_from_entries(F.collect_list(F.struct("code", "_w"))).alias("_sums"))
    states = F.explode(F.sequence(F.lit(0), F.lit(GAP))).alias("code")
    rows = by_pos.select(*keys, "pos", "_total", "_sums", states)
    return rows.select(*keys, "pos", "code", (F.coalesce(F.try_element_at("_sums", "code"), F.lit(0.0)) / F.col("_total") + 1e-9).alias("f"))


def entropy(frequencies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, h)."""
    return frequencies.groupBy(*(keys or []), "pos").agg((-F.sum(F.col("f") * F.log("f"))).alias("h"))


def occupancy(long: DataFrame, weights: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(keys, pos, occupancy): the logarithm of the weight without a gap; null in a column of gaps."""
    joined = long.join(weights, [*(keys or []), seq])
    return joined.groupBy(*(keys or []), "pos").agg(F.log(F.sum(F.when(F.col("code") != GAP, F.col("weight")))).alias("occupancy"))


def pair_entropy(long: DataFrame, weights: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(keys, i, j, h, gaps), i < j: entropy of weighted state pairs that occur, and the weight share of gap pairs."""
    return moments.entropies(moments.column_moments(long, weights, keys, seq), keys)


def _finished(rows: DataFrame, key: str, aligned_col: str, of, schema: str) -> DataFrame:
    """of(key, blocks, total, count) for the finished moments of each alignment; sequences weigh by neighbours over 0.8."""
    numbered = settled(rows.select(key, F.col(aligned_col).alias("aligned"), F.monotonically_increasing_id().alias("seq")))
    long = encoded(numbered, keys=[key])
    weights = settled(sequence_weights(long, keys=[key]))
    sums = moments.with_totals(moments.column_moments(long, weights, [key]), weights, [key])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return of(group[key].iloc[0], group.to_dict("records"), float(group["_total"].iloc[0]), int(group["_count"].iloc[0]))

    return sums.groupBy(key).applyInPandas(one, f"{key} {dict(rows.dtypes)[key]}, {schema}")


def _corrected_norms(inverse: np.ndarray) -> np.ndarray:
    apart = 1 - np.eye(len(inverse))
    norms = np.sqrt((inverse[:, :GAP, :, :GAP] ** 2).sum((1, 3))) * apart
    apc = norms.sum(0, keepdims=True) * norms.sum(1, keepdims=True) / max(norms.sum(), 1e-9)
    return (norms - apc) * apart


def couplings(rows: DataFrame, key: str, aligned_col: str = "aligned", penalty: float = 4.5) -> DataFrame:
    """(key, i, j, score): corrected norms of the inverse of the regularised covariance of an alignment's columns.

    All 21 states are inverted, and norms are taken over those that aren't gaps. Rows are
    summed up in chunks; only the finished covariance, whose size is that of the columns, is
    inverted in one task.
    """

    def one(name, blocks: list[dict], total: float, count: int) -> pd.DataFrame:
        score = _corrected_norms(moments.inverse_covariance(moments.assembled(blocks), total, count, penalty))
        i, j = np.triu_indices(len(score), 1)
        return pd.DataFrame({key: name, "i": i, "j": j, "score": score[i, j]})

    return _finished(rows, key, aligned_col, one, "i int, j int, score double")


def column_covariance(rows: DataFrame, key: str, aligned_col: str = "aligned") -> DataFrame:
    """(key, i, j, norm), i < j: the norm of the covariance of two columns' states, gaps included."""

    def one(name, blocks: list[dict], total: float, count: int) -> pd.DataFrame:
        cov = moments.covariance(moments.assembled(blocks), total, count)
        length = len(cov) // STATES
        norms = np.sqrt((cov.reshape(length, STATES, length, STATES) ** 2).sum((1, 3)))
        i, j = np.triu_indices(length, 1)
        return pd.DataFrame({key: name, "i": i, "j": j, "norm": norms[i, j]})

    return _finished(rows, key, aligned_col, one, "i int, j int, norm double")


def column_features(long: DataFrame, weights: DataFrame, rates: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(keys, pos, f1d): 44 numbers of each column.

    The first sequence's residue one-hot (20), the profile (21), its entropy, the occupancy
    (null in a column of gaps) and the rate of insertions before it, from rates (keys, pos, rate),
    0 where that lacks it.
    """
    at = [*(keys or []), "pos"]
    listed = F.array_sort(F.collect_list(F.struct("code", "f")))
    columns = profile(long, weights, keys, seq).groupBy(*at).agg(F.transform(listed, lambda x: x["f"]).alias("_f"), (-F.sum(F.col("f") * F.log("f"))).alias("_h"))
    own = long.groupBy(*at).agg(F.min_by("code", seq).alias("_own"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(GAP - 1)), lambda s: F.when(F.col("_own") == s, 1.0).otherwise(0.0))
    joined = columns.join(own, at).join(occupancy(long, weights, keys, seq), at).join(rates, at, "left")
    return joined.select(*at, F.concat(hot, F.col("_f"), F.array("_h", "occupancy", F.coalesce("rate", F.lit(0.0)))).alias("f1d"))


def pair_inputs(rows: DataFrame, key: str, aligned_col: str = "aligned", penalty: float = 4.5) -> DataFrame:
    """(key, i, j, f2d): 444 numbers of all ordered pairs of an alignment's columns, a column with itself included.

    The 441 of the inverse covariance's block, its corrected norm, the entropy of the pair's
    states (each plus 1e-9) and the weight share of gap pairs. All are 0 for a single sequence.
    Rows are summed up in chunks, as for couplings.
    """

    def one(name, blocks: list[dict], total: float, count: int) -> pd.DataFrame:
        second = moments.assembled(blocks)
        inverse = moments.inverse_covariance(second, total, count, penalty)
        length = len(inverse)
        f = (second / total + 1e-9).reshape(length, STATES, length, STATES)
        entropies = -(f * np.log(f)).sum((1, 3))
        out = np.concatenate([inverse.transpose(0, 2, 1, 3).reshape(length, length, -1), np.stack([_corrected_norms(inverse), entropies, f[:, GAP, :, GAP]], -1)], -1)
        out = out.astype(np.float32) * np.float32(count > 1)
        i, j = (k.ravel() for k in np.indices((length, length)))
        return pd.DataFrame({key: name, "i": i, "j": j, "f2d": list(out.reshape(length * length, -1))})

    return _finished(rows, key, aligned_col, one, "i int, j int, f2d array<float>")


def pair_table(columns: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, i, j, inputs): 533 numbers of each pair: column_features at i and at j, pair_inputs, and the logarithm of the distance."""
    one = columns.select(key, F.col("pos").alias("i"), F.col("f1d").alias("_one"))
    two = columns.select(key, F.col("pos").alias("j"), F.col("f1d").alias("_two"))
    separation = F.log(F.abs(F.col("i") - F.col("j")) + 1.0)
    joined = pairs.join(one, [key, "i"]).join(two, [key, "j"])
    return joined.select(key, "i", "j", F.concat("_one", "_two", F.col("f2d").cast("array<double>"), F.array(separation)).alias("inputs"))


def subsample(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """A random share of an alignment's rows, the same in every run; the operation is the sample."""
    part = F.pmod(F.xxhash64(F.col("seq"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return rows.filter(part < share)


def first_rows(rows: DataFrame, most: int, order: str, keys: list[str] | None = None) -> DataFrame:
    """The first most rows of each group; ranks are made in two levels, so a group is no one task."""
    return with_earlier(rows, [order], "_before", keys=keys).filter(F.col("_before") < most).drop("_before")


def pair_features(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, separation): all ordered pairs of an alignment's columns with the logarithm of their distance."""
    keys = keys or []
    columns = long.select(*keys, "pos").distinct()
    n = columns.groupBy(*keys).agg(F.max("pos").alias("_last"))
    i = n.select(*keys, "_last", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("i"))
    return i.select(*keys, "i", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("j")).withColumn("separation", F.log(F.abs(F.col("i") - F.col("j")) + 1.0))


def scattered_template(template: DataFrame, matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, ...): a template's pair features (t1, t2, ...) at the query positions that matches (t, q) give them."""
    keys = keys or []
    one = matches.select(*keys, F.col("t").alias("t1"), F.col("q").alias("i"))
    two = matches.select(*keys, F.col("t").alias("t2"), F.col("q").alias("j"))
    return template.join(one, [*keys, "t1"]).join(two, [*keys, "t2"]).drop("t1", "t2")


def coverage_choice(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate (e_value, n75, n50) per key: in order of e-values the first with n75 > 2000, or n50 > 5000; else the last one's 50 % set.

    Adds coverage, 75 or 50.
    """
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("e_value"))
    last = F.count("*").over(Window.partitionBy(*keys))
    ranked = candidates.withColumns({"_o": order, "_n": last})
    coverage: Column = F.when(F.col("n75") > 2000, 75).when(F.col("n50") > 5000, 50).when(F.col("_o") == F.col("_n"), 50)
    fit = ranked.withColumn("coverage", coverage).filter("coverage is not null")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))
    return fit.withColumn("_f", first).filter("_f = 1").drop("_o", "_n", "_f")


def insertion_rate(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, rate): the share of an alignment's rows (insertions: array) with letters inserted before each column."""
    long = rows.select(*(keys or []), F.posexplode("insertions").alias("pos", "inserted"))
    return long.groupBy(*(keys or []), "pos").agg(F.avg((F.col("inserted") > 0).cast("double")).alias("rate"))
