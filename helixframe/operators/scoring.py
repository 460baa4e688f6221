"""Contact-area difference: profiles per residue, global, size, atom-level and local scores."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.exact_sums import exact_sums

GAP, BREAK, UNDEFINED = -1.0, -2.0, -3.0


def difference_and_reference(kind: int, t: Column, m: Column) -> tuple[Column, Column]:
    """0: bounded, 1: raw, 2: symmetric reference, 3: signed."""
    if kind == 0:
        return F.least(F.abs(t - m), t), t
    if kind == 1:
        return F.abs(t - m), t
    if kind == 2:
        return F.abs(t - m), t + m
    if kind == 3:
        return t - m, t
    raise ValueError(f"no kind {kind}")


def profile(merged: DataFrame, kind: int = 0, residues: DataFrame | None = None, keys: list[str] | None = None, exact: bool = False) -> DataFrame:
    """(keys, chain, num, class, difference, reference): sums by the residue at a.

    With residues (chain, num), theirs only, and all of them: one without contacts has a
    row with a null class and zeros. Exact sums are the same to the last bit in any order.
    """
    keys = keys or []
    diff, ref = difference_and_reference(kind, F.col("t_area"), F.col("m_area"))
    named = merged.withColumns({"chain": F.col("a_chain"), "num": F.col("a_num")})
    sums = _summed(named, [*keys, "chain", "num", "class"], {"difference": diff, "reference": ref}, exact)
    if residues is None:
        return sums
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("difference", "reference")}
    return residues.select(*keys, "chain", "num").distinct().join(sums, [*keys, "chain", "num"], "left").withColumns(zero)


def _summed(rows: DataFrame, keys: list[str], values: dict[str, Column], exact: bool) -> DataFrame:
    if exact:
        return exact_sums(rows, keys, values)
    return rows.groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in values.items()])


def global_scores(profiles: DataFrame, minimum: bool = False, keys: list[str] | None = None, exact: bool = False) -> DataFrame:
    """(keys, class, difference, reference, score, residues) over residues of positive reference; score 0 if there is none.

    minimum caps each residue's difference at its reference. Exact sums don't depend on order.
    """
    used = F.col("reference") > 0
    diff = F.least("difference", "reference") if minimum else F.col("difference")
    values = {"difference": F.when(used, diff), "reference": F.when(used, F.col("reference")), "residues": F.when(used, 1.0).otherwise(0.0)}
    sums = _summed(profiles.filter("class is not null"), [*(keys or []), "class"], values, exact)
    sums = sums.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("difference", "reference")} | {"residues": F.col("residues").cast("long")})
    score = F.when(F.col("reference") > 0, 1 - F.try_divide("difference", "reference")).otherwise(F.lit(0.0))
    return sums.withColumn("score", score)


def size_scores(target: DataFrame, model: DataFrame, profiles: DataFrame) -> DataFrame:
    """(name, value): residues and atoms of either side, all and those with a positive reference in the profile.

    target and model: residue summaries (chain, num, atoms).
    """
    used = profiles.filter("reference > 0").select("chain", "num").distinct()
    both = target.select("chain", "num", "atoms", F.lit("target").alias("side")).unionByName(model.select("chain", "num", "atoms", F.lit("model").alias("side")))
    marked = both.join(used.withColumn("used", F.lit(True)), ["chain", "num"], "left")
    sums = marked.groupBy("side").agg(
        F.count("*").alias("residues"),
        F.sum("atoms").alias("atoms"),
        F.count("used").alias("used_residues"),
        F.coalesce(F.sum(F.when(F.col("used"), F.col("atoms"))), F.lit(0)).alias("used_atoms"),
    )
    names = ["residues", "atoms", "used_residues", "used_atoms"]
    rows = F.explode(F.array(*[F.struct(F.concat("side", F.lit(f"_{n}")).alias("name"), F.col(n).cast("long").alias("value")) for n in names]))
    return sums.select(rows.alias("row")).select("row.*")


def atom_scores(merged: DataFrame, normalised: bool = True) -> DataFrame:
    """(a_chain, a_num, a_atom, difference, reference, value): -2 where the reference is 0; a normalised value is 100 times the ratio."""
    diff, ref = difference_and_reference(0, F.col("t_area"), F.col("m_area"))
    sums = merged.groupBy("a_chain", "a_num", "a_atom").agg(F.sum(diff).alias("difference"), F.sum(ref).alias("reference"))
    ratio = F.try_divide("difference", "reference") * 100 if normalised else F.col("difference")
    return sums.withColumn("value", F.when(F.col("reference") > 0, ratio).otherwise(F.lit(BREAK)))


def atom_values(atoms: DataFrame, scores: DataFrame) -> DataFrame:
    """atoms (chain, num, name, ...) with value; -1 where the scores lack the atom."""
    named = scores.select(F.col("a_chain").alias("chain"), F.col("a_num").alias("num"), F.col("a_atom").alias("name"), "value")
    return atoms.join(named, ["chain", "num", "name"], "left").withColumn("value", F.coalesce("value", F.lit(GAP)))


def local_scores(profiles: DataFrame, value: str = "ratio", keys: list[str] | None = None) -> DataFrame:
    """(keys, chain, num, score) of one class's profile, with filler rows.

    Numbers missing inside a chain get -1. At each change of chain, (new chain, 0) gets -2,
    and that row wins over a real residue 0. A reference of 0 or less gives -3.
    """
    keys = keys or []
    ratio = {"difference": F.col("difference"), "reference": F.col("reference"), "ratio": F.try_divide("difference", "reference")}[value]
    scored = profiles.select(*keys, "chain", "num", F.when(F.col("reference") > 0, ratio).otherwise(F.lit(UNDEFINED)).alias("score"))
    before = F.lag("num").over(Window.partitionBy(*keys, "chain").orderBy("num"))
    gaps = F.when(F.col("num") - before > 1, F.sequence(before + 1, F.col("num") - 1))
    filled = scored.withColumn("_gap", gaps)
    holes = filled.select(*keys, "chain", F.explode("_gap").alias("num"), F.lit(GAP).alias("score"))
    chains = scored.select(*keys, "chain").distinct()
    first = chains.groupBy(*keys).agg(F.min("chain").alias("_first")) if keys else chains.agg(F.min("chain").alias("_first"))
    breaks = (chains.join(first, keys) if keys else chains.join(F.broadcast(first), F.col("chain") >= F.col("_first"))).filter("chain > _first")
    breaks = breaks.select(*keys, "chain", F.lit(0).cast(dict(scored.dtypes)["num"]).alias("num"), F.lit(BREAK).alias("score"))
    marks = breaks.select(*keys, F.col("chain").alias("_c"), F.lit(True).alias("_later"))
    rest = filled.drop("_gap").unionByName(holes)
    condition = [rest[k] == marks[k] for k in keys] + [rest["chain"] == marks["_c"], rest["num"] == 0]
    kept = rest.join(marks, condition, "left_anti")
    return kept.unionByName(breaks)


def blurred(scores: DataFrame, width: int, keys: list[str] | None = None, value: str = "score") -> DataFrame:
    """scores with their value smoothed over width entries on either side.

    On each side, from the nearest entry to the farthest, the last valid value is held: one
    of the same chain, at most width residues away and over 0; at first it is the entry's
    own. The sum is divided by 1 + 2 width. Negative values stay as they are.
    """
    keys = keys or []
    if width == 0:
        return scores
    order = Window.partitionBy(*keys, "chain").orderBy("num")
    entry = F.struct("num", F.col(value).alias("v"))
    back = F.reverse(F.collect_list(entry).over(order.rowsBetween(-width, -1)))
    ahead = F.collect_list(entry).over(order.rowsBetween(1, width))

    def side(near: Column) -> Column:
        start = F.struct(F.col(value).alias("held"), F.lit(0.0).alias("sum"))

        def step(state: Column, i: Column) -> Column:
            x = F.get(near, i - 1)
            valid = x.isNotNull() & (F.abs(x["num"] - F.col("num")) <= width) & (x["v"] > 0)
            held = F.when(valid, x["v"]).otherwise(state["held"])
            return F.struct(held.alias("held"), (state["sum"] + held).alias("sum"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(width)), start, step, lambda s: s["sum"])

    listed = scores.withColumns({"_back": back, "_ahead": ahead})
    smooth = (F.col(value) + side(F.col("_back")) + side(F.col("_ahead"))) / (1 + 2 * width)
    return listed.withColumn(value, F.when(F.col(value) >= 0, smooth).otherwise(F.col(value))).drop("_back", "_ahead")


def blurred_ratio(profiles: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """Blurred differences over blurred references; the lesser of both where one is 0 or less."""
    keys = keys or []
    top = blurred(local_scores(profiles, "difference", keys), width, keys).withColumnRenamed("score", "_d")
    low = blurred(local_scores(profiles, "reference", keys), width, keys).withColumnRenamed("score", "_r")
    joined = top.join(low, [*keys, "chain", "num"])
    ratio = F.when((F.col("_d") > 0) & (F.col("_r") > 0), F.try_divide("_d", "_r")).otherwise(F.least("_d", "_r"))
    return joined.select(*keys, "chain", "num", ratio.alias("score"))


#: Gains are whole numbers of this part of an area, so that equal permutations tie whatever the order of sums.
GAIN_DIGITS = 9


def chain_pair_gains(target: DataFrame, model: DataFrame, names: list[str]) -> DataFrame:
    """(c, e, d, f, gain): by how much the model's AA contacts of chains d and f, named c and e, would lower the bounded difference.

    A contact that both sides have, of residues with the same numbers, lowers it from the
    target's area t to least(|t - m|, t). Each pair of chains meets each once, so nothing is
    copied for a permutation. Chains outside names keep theirs, which are null here.
    """
    areas = lambda df: df.filter(F.col("class") == "AA").groupBy("a_chain", "a_num", "b_chain", "b_num").agg(F.sum("area").alias("area"))
    t, m = areas(target).alias("t"), areas(model).alias("m")
    met = t.join(m, (F.col("t.a_num") == F.col("m.a_num")) & (F.col("t.b_num") == F.col("m.b_num")))
    shared = lambda c: F.col(c).isin(*names)
    for end in ("a_chain", "b_chain"):
        met = met.filter(F.when(shared(f"t.{end}"), shared(f"m.{end}")).otherwise(F.col(f"t.{end}") == F.col(f"m.{end}")))
    gain = F.col("t.area") - F.least(F.abs(F.col("t.area") - F.col("m.area")), F.col("t.area"))
    ends = (("c", "t.a_chain"), ("e", "t.b_chain"), ("d", "m.a_chain"), ("f", "m.b_chain"))
    named = met.select(*[F.when(shared(c), F.col(c)).alias(n) for n, c in ends], gain.cast(f"decimal(38,{GAIN_DIGITS})").alias("gain"))
    return named.groupBy("c", "e", "d", "f").agg(F.sum("gain").alias("gain")).filter("gain <> 0")


def best_assignment(gains: list[tuple], names: list[str]) -> tuple[tuple[str, ...], int]:
    """The permutation of names of greatest summed gain, the first on ties, from whole (c, e, d, f, gain).

    Depth first in the permutations' order. What an assignment that is begun can reach at
    most is what its chains gain among themselves and the most that every open pair could;
    a branch that can't exceed the best is left.
    """
    n, at = len(names), {name: i for i, name in enumerate(names)}
    pair, alone, fixed = np.zeros((n, n, n, n), object), np.zeros((n, n), object), 0
    for c, e, d, f, gain in gains:
        if c is None and e is None:
            fixed += gain
        elif c is None or e is None or d == f:
            if d == f and c != e:
                continue  # one chain has one name
            alone[at[d or f], at[c or e]] += gain
        elif c != e:
            pair[at[d], at[f], at[c], at[e]] += gain
    both = pair + pair.transpose(1, 0, 3, 2)  # of an unordered pair of the model's chains
    best, found = None, None
    order: list[int] = []

    def most(free: list[int], total: int) -> int:
        for d in range(len(order), n):
            total += max(alone[d, c] + sum(both[d, g, c, order[g]] for g in range(len(order))) for c in free)
            for f in range(d + 1, n):
                total += max((both[d, f, c, e] for c in free for e in free if c != e), default=0)
        return total

    def search(total: int) -> None:
        nonlocal best, found
        d = len(order)
        if d == n:
            if best is None or total > best:
                best, found = total, tuple(order)
            return
        free = [c for c in range(n) if c not in order]
        if best is not None and most(free, total) <= best:
            return
        for c in free:
            gain = alone[d, c] + sum(both[d, g, c, order[g]] for g in range(d))
            order.append(c)
            search(total + gain)
            order.pop()

    search(fixed)
    return tuple(names[c] for c in found), best


def best_chain_permutation(target: DataFrame, model: DataFrame, names: list[str]) -> DataFrame:
    """(permutation, score, order) of the renaming of the model's chains with the best AA score, the first on ties.

    names are the chains that both sides share; order is the permutation's place among all
    of them. The score is of bounded differences. Spark sums what each pair of chains gains
    under each pair of names, at most a row for four chains; the search over assignments
    sees those rows alone. Without any area in the target the first permutation scores 0.
    """
    reference = target.filter(F.col("class") == "AA").agg(F.coalesce(F.sum(F.col("area").cast(f"decimal(38,{GAIN_DIGITS})")), F.lit(0)).alias("gain"))
    rows = chain_pair_gains(target, model, names).withColumn("reference", F.lit(False))
    nothing = [F.lit(None).cast("string").alias(c) for c in "cedf"]
    rows = rows.unionByName(reference.select(*nothing, "gain", F.lit(True).alias("reference")))
    whole = (F.col("gain") * F.lit(10**GAIN_DIGITS)).cast("decimal(38,0)")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        total = int(group.loc[group["reference"], "gain"].iloc[0])
        gains = [(*(x or None for x in r[:4]), int(r[4])) for r in group.loc[~group["reference"], ["c", "e", "d", "f", "gain"]].itertuples(index=False)]
        permutation, gain = best_assignment(gains, names)
        left, order = list(names), 0
        for i, name in enumerate(permutation):  # places in the factorial number system
            order += left.index(name) * factorial(len(names) - 1 - i)
            left.remove(name)
        score = 1 - (total - gain) / total if total > 0 else 0.0
        return pd.DataFrame({"permutation": [",".join(permutation)], "score": [score], "order": [order]})

    rows = rows.select("c", "e", "d", "f", whole.alias("gain"), "reference", F.lit(0).alias("_all"))
    return rows.groupBy("_all").applyInPandas(one, "permutation string, score double, order int")


def score_table(scores: DataFrame, names: list[str]) -> DataFrame:
    """(target, model, name, value) to one row per pair with a column for each name."""
    return scores.groupBy("target", "model").pivot("name", names).agg(F.first("value"))


def score_matrix(scores: DataFrame, models: list[str]) -> DataFrame:
    """(target, model, value) to a row per target and a column per model."""
    return scores.groupBy("target").pivot("model", models).agg(F.first("value"))


def comparison_pairs(targets: DataFrame, models: DataFrame) -> DataFrame:
    """(target, model): every model against every target, since the operation asks for all of them."""
    return targets.select("target").crossJoin(models.select("model"))
