"""Joins that Spark has no name for: outer merges with defaults, ranked lookups, range joins, intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from helixframe.functions import geometry as g
from helixframe.scratch import settled

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def full_outer_merge(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict | None = None) -> DataFrame:
    """Keys of both sides; a missing side's values take their default."""
    merged = left.join(right, keys, "full_outer")
    for name, value in (defaults or {}).items():
        merged = merged.withColumn(name, F.coalesce(name, F.lit(value)))
    return merged


def merge_by_tag(left: DataFrame, right: DataFrame, keys: list[str], value: str, names: tuple[str, str], default: float = 0.0) -> DataFrame:
    """The same merge as sums of one value per side, by one aggregation that combines on the map side.

    A key that either side repeats comes once, with the sum of its values.
    """
    tagged = left.select(*keys, F.col(value), F.lit(True).alias("_first")).unionByName(right.select(*keys, F.col(value), F.lit(False).alias("_first")))
    side = [F.coalesce(F.sum(F.when(F.col("_first") == first, F.col(value))), F.lit(default)).alias(n) for first, n in ((True, names[0]), (False, names[1]))]
    return tagged.groupBy(*keys).agg(*side)


def existing_win(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose keys old lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def excluded(rows: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(picked.select(*keys), keys, "left_anti")


def both_ways(contacts: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The set of contacts in either direction."""
    turned = contacts.withColumns({a: F.col(b), b: F.col(a)})
    return contacts.unionByName(turned).distinct()


def ratio_zip(top: DataFrame, bottom: DataFrame, keys: list[str], value: str) -> DataFrame:
    """top / bottom by key where both are positive, else the lesser; no rows unless the keys are the same."""
    joined = top.join(bottom.withColumnRenamed(value, "_below"), keys, "full_outer")
    whole = joined.agg(F.count_if(F.col(value).isNull() | F.col("_below").isNull()).alias("_odd"))
    zipped = joined.join(F.broadcast(whole), F.col("_odd") == 0)
    both = (F.col(value) > 0) & (F.col("_below") > 0)
    return zipped.select(*keys, F.when(both, F.try_divide(value, "_below")).otherwise(F.least(value, "_below")).alias(value))


def pattern_options(residue: Column, atom: Column) -> Column:
    """Patterns RES_ATOM that fit, best first: the exact name, the name and *, shrinking prefixes and *, *; each for the residue, then for any."""
    shrinking = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.length(atom) - 1, F.lit(0))), lambda i: i < F.length(atom)),
        lambda i: F.concat(F.substr(atom, F.lit(1), F.length(atom) - i), F.lit("*")),
    )
    names = F.concat(F.array(atom), shrinking, F.array(F.lit("*")))

    def with_residue(r: Column) -> Column:
        return F.transform(names, lambda n: F.concat(r, F.lit("_"), n))

    return F.concat(with_residue(residue), with_residue(F.lit("*")))


#: The most patterns that are broadcast; the rows with all their options never are.
BROADCAST_PATTERNS = 200_000


def first_match_lookup(rows: DataFrame, patterns: DataFrame, options: Column, keys: list[str], pattern_col: str = "pattern", value_cols=("value",), required: bool = False) -> DataFrame:
    """Joins the best-ranked pattern; rows without any keep nulls or, if one is required, are an error where they are met.

    The pattern table is counted, and broadcast where it is a dictionary; a larger one is
    joined by shuffles. Spark, left to itself, would take a file's size for that of its rows'
    options, and broadcast those.
    """
    ranked = rows.select("*", F.posexplode(options).alias("_rank", "_option"))
    few = patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    ranked, patterns = (ranked, F.broadcast(patterns)) if few else (ranked.hint("merge"), patterns)
    hits = ranked.join(patterns, F.col("_option") == F.col(pattern_col)).groupBy(*keys)
    best = hits.agg(*[F.min_by(v, "_rank").alias(v) for v in value_cols])
    if not required:
        return rows.join(best, keys, "left")
    found = rows.join(best.withColumn("_found", F.lit(True)), keys, "left")
    named = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    refused = F.raise_error(F.concat(F.lit("no pattern fits the row of "), named))
    return found.withColumns({v: F.when(F.col("_found"), F.col(v)).otherwise(refused) for v in value_cols}).drop("_found")


class NotEmpty:
    """A result that must have rows: check() raises after the action that made it, from a count that the action kept.

    Nothing is read a second time; where no action was run on df, check() waits for one.
    """

    def __init__(self, df: DataFrame, what: str):
        self.what, self._seen = what, Observation()
        self.df = df.observe(self._seen, F.count(F.lit(1)).alias("rows"))

    def check(self) -> int:
        rows = self._seen.get["rows"]
        if not rows:
            raise ValueError(f"no {self.what}")
        return rows


def without(df: DataFrame, unwanted: Column, message: str) -> DataFrame:
    """df, in which a row that is unwanted is an error where it is met; null isn't unwanted."""
    return df.filter(F.when(unwanted, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def range_join(left: DataFrame, right: DataFrame, radius: float, left_point: str = "p", right_point: str = "p", keys: list[str] | None = None) -> DataFrame:
    """Pairs within the radius as an equi-join on grid cells: (l, r, d), structs of either side's columns and the distance.

    The side on the right goes to the 27 cells around its own. Keys are columns that both
    sides must agree in, such as the structure. Points without coordinates match nothing.
    """
    keys = keys or []

    def cell(p: str) -> list[Column]:
        return [F.floor(F.col(p)[c] / radius).cast("long") for c in "xyz"]

    near = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(step, "xyz", strict=True)]) for step in _steps()])
    names = ["_cx", "_cy", "_cz"]
    a = left.select(F.struct(*left.columns).alias("l"), *[c.alias(n) for c, n in zip(cell(left_point), names, strict=True)], *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    b = right.select(F.struct(*right.columns).alias("r"), *[c.alias(n) for c, n in zip(cell(right_point), names, strict=True)], *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(near).alias("_s"))
    b = b.select("r", *[(F.col(n) + F.col("_s")[c]).alias(n) for n, c in zip(names, "xyz", strict=True)], *[f"_k{i}" for i in range(len(keys))])
    pairs = a.join(b, names + [f"_k{i}" for i in range(len(keys))])
    pairs = pairs.select("l", "r", g.distance(F.col("l")[left_point], F.col("r")[right_point]).alias("d"))
    return pairs.filter(F.col("d") <= radius)


def _steps():
    return [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]


_INTERVAL = re.compile(r"^([A-Za-z]?)(-?\d+)?(?:-([A-Za-z]?)(-?\d+))?$")


def parse_intervals(text: str) -> list[tuple[int, str, int, int]]:
    """(group, chain, first, last) of groups such as (A1-A9,B3)(C)(3-8).

    A chain alone is all of it, and a number without a chain is of chain "?". The ends of
    an interval have one chain. Raises ValueError otherwise.
    """
    bare = re.sub(r"\s", "", text)
    if not re.fullmatch(r"(\([^()]+\))+", bare):
        raise ValueError(f"intervals are groups in brackets, not {text!r}")
    out = []
    for group, body in enumerate(re.findall(r"\(([^()]+)\)", bare)):
        for part in body.split(","):
            m = _INTERVAL.match(part)
            if not part or not m:
                raise ValueError(f"no interval: {part!r}")
            chain, first, other, last = m.groups()
            if first is None:
                if not chain or last is not None:
                    raise ValueError(f"no interval: {part!r}")
                out.append((group, chain, INT_MIN, INT_MAX))
                continue
            if last is not None and (other or "?") != (chain or "?"):
                raise ValueError(f"an interval lies in one chain: {part!r}")
            low, high = int(first), int(last if last is not None else first)
            out.append((group, chain or "?", min(low, high), max(low, high)))
    return out


def interval_group(chain: Column, number: Column, intervals: list[tuple[int, str, int, int]]) -> Column:
    """The first group that has the residue, or null."""
    found = [F.when((chain == c) & number.between(low, high), group) for group, c, low, high in sorted(intervals)]
    return F.coalesce(*found) if found else F.lit(None).cast("int")


def with_earlier(rows: DataFrame, order: list, name: str, size: Column | None = None, keys: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Adds the number, or the summed size, of the rows before each one in its group; total names a column for the whole group's.

    Rows are cut into ranges of keys and order, and sums are taken inside ranges and over the
    ranges' totals, so no group is one task. Rows equal in all of them come in any order.
    """
    keys = keys or []
    sized = rows.withColumn("_size", F.lit(1).cast("long") if size is None else size)
    ranges = sized.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    cut = settled(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    totals = cut.groupBy(*keys, "_range").agg(F.sum("_size").alias("_sum"))  # as few rows as ranges and groups
    group, up_to = Window.partitionBy(*keys), Window.unboundedPreceding
    start = F.coalesce(F.sum("_sum").over(group.orderBy("_range").rowsBetween(up_to, -1)), F.lit(0))
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), start.alias("_start"), F.sum("_sum").over(group).alias("_total"))
    inside = F.sum("_size").over(Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(up_to, -1))
    on = [F.col("_range") == F.col("_r"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    placed = cut.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(starts, on)
    added = [(F.col("_start") + F.col("_inside")).alias(name), *([F.col("_total").alias(total)] if total else [])]
    return placed.select(*rows.columns, *added)
