"""Sums of doubles that don't depend on the order or the partitioning of the rows, as mergeable whole numbers.

A double is a whole number times a power of two. Scaled by a power of 2^32 it is a whole
number of 88 bits at most, whose sums are exact decimals; one such sum for each power that
occurs (70 at most) is a state. States merge by adding, and only the finished one is
rounded, once, to the nearest double. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
LIMB = 1 << 32
HALF = 1 << 44


def _wide(n: int) -> Column:
    return F.lit(str(n)).cast(WIDE)


def _power(exponent: Column) -> Column:
    """2^exponent, which pow gives exactly for whole exponents that a double has."""
    return F.pow(F.lit(2.0), exponent)


def sum_states(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, limb, total, other, n): whole sums of value / 2^(32 limb) by limb.

    Values of no limb, which are zeros, nulls and those that aren't finite, have a null limb;
    other is the plain sum of the latter, which doesn't depend on order, and n counts values
    that aren't null. Up to 10^9 rows a group and limb fit, and as many states of them merge as totals fit 38 digits.
    """
    x = F.col(value).cast("double")
    finite = (F.abs(x) < float("inf")) & (x != 0)
    # a logarithm may be off by one near a power of two, which the 53 allows for
    limb = F.when(finite, F.floor((F.floor(F.log2(F.abs(x))) - 53) / 32).cast("int"))
    scale = _power(-16 * F.col("limb"))  # applied twice, as the whole of it may not be a double
    split = rows.select(*keys, x.alias("_x"), limb.alias("limb")).withColumn("_y", F.col("_x") * scale * scale)
    high = F.floor(F.col("_y") / float(HALF))
    parts = split.select(*keys, "limb", "_x", high.cast("decimal(28,0)").alias("_high"), (F.col("_y") - high * float(HALF)).cast("bigint").cast("decimal(28,0)").alias("_low"))
    sums = parts.groupBy(*keys, "limb").agg(
        F.sum("_high").alias("_high"), F.sum("_low").alias("_low"), F.sum(F.when(F.col("limb").isNull() & (F.col("_x") != 0), F.col("_x"))).alias("other"), F.count("_x").alias("n")
    )
    total = (F.col("_high") * _wide(HALF)).cast(WIDE) + F.col("_low")
    return sums.select(*keys, "limb", total.cast(WIDE).alias("total"), "other", "n")


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of several parts of the rows as the state of all of them."""
    return states.groupBy(*keys, "limb").agg(F.sum("total").cast(WIDE).alias("total"), F.sum("other").alias("other"), F.sum("n").alias("n"))


def _digits(totals: Column, first: Column, last: Column) -> Column:
    """(carry, digits): totals by limb as digits of 32 bits from the least one on, and what is left over, whose sign is the sum's."""
    zero = _wide(0)
    start = F.struct(zero.alias("carry"), F.expr("cast(array() as array<bigint>)").alias("digits"))

    def step(state: Column, limb: Column) -> Column:
        here = (state["carry"] + F.coalesce(F.try_element_at(totals, limb), zero)).cast(WIDE)
        digit = F.pmod(here, _wide(LIMB)).cast("bigint")
        carry = ((here - digit).cast(WIDE) / _wide(LIMB)).cast(WIDE)
        return F.struct(carry.alias("carry"), F.concat(state["digits"], F.array(digit)).alias("digits"))

    # four more limbs than there are take up what 38 digits can carry
    return F.aggregate(F.sequence(first, last + 4), start, step)


def _nearest(rows: DataFrame, digits: str, first: str) -> DataFrame:
    """Adds _nearest: digits of 32 bits, the least first and of limb first, as the nearest double, halves to even.

    Step by step, so that what several steps need is computed once.
    """
    d = F.col(digits)
    top = F.array_max(F.transform(d, lambda x, i: F.when(x > 0, i + 1).otherwise(0)))  # one past the last digit that isn't zero
    rows = rows.withColumn("_low", F.greatest(top - 3, F.lit(0)))
    # three digits hold 65 bits at least; a last bit stands for whatever is below, so that halves are told
    three = {f"_d{k}": F.coalesce(F.get(d, F.col("_low") + k), F.lit(0).cast("bigint")) for k in range(3)}
    rows = rows.withColumns({**three, "_rest": F.exists(F.slice(d, F.lit(1), F.col("_low")), lambda x: x > 0)})
    wide = [F.col(f"_d{k}").cast(WIDE) * _wide(LIMB**k) for k in range(3)]
    bits = F.when(F.col("_d2") > 0, F.length(F.bin("_d2")) + 64).when(F.col("_d1") > 0, F.length(F.bin("_d1")) + 32).otherwise(F.length(F.bin("_d0")))
    rows = rows.withColumns({"_whole": (wide[0] + wide[1] + wide[2]).cast(WIDE), "_cut": F.greatest(bits - 53, F.lit(0))})  # bits to drop, 43 at most
    rows = rows.withColumn("_unit", _power(F.col("_cut")).cast("bigint"))
    rows = rows.withColumn("_dropped", F.pmod("_whole", F.col("_unit").cast(WIDE)).cast("bigint"))
    rows = rows.withColumn("_kept", ((F.col("_whole") - F.col("_dropped").cast(WIDE)).cast(WIDE) / F.col("_unit").cast(WIDE)).cast("bigint"))
    twice, unit = F.col("_dropped") * 2, F.col("_unit")
    up = F.when((twice > unit) | ((twice == unit) & (F.col("_rest") | (F.col("_kept") % 2 == 1))), 1).otherwise(0)
    rows = rows.withColumns({"_mantissa": (F.col("_kept") + up).cast("double") * unit.cast("double"), "_half": _power((F.col("_low") + F.col(first)) * 16)})
    return rows.withColumn("_nearest", F.col("_mantissa") * F.col("_half") * F.col("_half"))


def finished(states: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the exact sum of each group's values, rounded once; null where all are null.

    Infinities and NaN give what a plain sum gives; sums under the least normal double are exact as well.
    """
    entry = F.when(F.col("limb").isNotNull(), F.struct("limb", "total"))
    whole = states.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_totals"), F.sum("other").alias("_other"), F.sum("n").alias("_n"), F.min("limb").alias("_first"), F.max("limb").alias("_last"))
    plus = whole.withColumn("_plus", F.when(F.col("_first").isNotNull(), _digits(F.col("_totals"), F.col("_first"), F.col("_last"))))
    negative = F.col("_plus")["carry"] < 0
    turned = F.transform_values("_totals", lambda _, v: (-v).cast(WIDE))
    size = F.when(negative, _digits(turned, F.col("_first"), F.col("_last"))).otherwise(F.col("_plus"))
    sized = plus.withColumns({"_minus": negative, "_size": size["digits"]})
    placed = _nearest(sized, "_size", "_first")
    finite = F.coalesce(F.when(F.col("_minus"), -F.col("_nearest")).otherwise(F.col("_nearest")), F.lit(0.0))
    return placed.select(*keys, F.when(F.col("_other").isNotNull(), F.col("_other")).when(F.col("_n") > 0, finite).alias(name))


def exact_sum(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): sums of value that are the same to the last bit however the rows are dealt."""
    return finished(sum_states(rows, keys, value), keys, name)


def exact_sums(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, names of values): the exact sums of several values, in one pass."""
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_value")) for n, v in values.items()])).alias("_e")
    sums = exact_sum(rows.select(*keys, entries).select(*keys, "_e.*"), [*keys, "_name"], "_value", "_sum")
    return sums.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_sum"))).alias(n) for n in values])
