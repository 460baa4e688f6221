"""Parameter sweeps over validated expressions, and polynomial fits."""

from __future__ import annotations

import ast

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CALLS = {"exp": F.exp, "log": F.log, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tanh": F.tanh, "abs": F.abs}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: F.pow}


def safe_expression(text: str, variable: str, column: Column) -> Column:
    """An arithmetic expression of one variable as a column; anything but numbers, the variable, + - * / ** and a few functions raises ValueError."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id == variable:
            return column
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and len(node.args) == 1 and not node.keywords:
            return _CALLS[node.func.id](build(node.args[0]))
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:80]}")

    try:
        return build(ast.parse(text.replace("^", "**"), mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"no expression: {text!r}") from e


def sweep(spark: SparkSession, expression: str, first: float = 0.0, step: float = 0.1, count: int = 1000, variable: str = "l") -> DataFrame:
    """(i, light, rate) for light = first + i step."""
    light = F.col("id") * step + first
    return spark.range(count).select(F.col("id").alias("i"), light.alias("light"), safe_expression(expression, variable, light).alias("rate"))


def compounded(value: float, i: Column, factor: float = 10.0) -> Column:
    """A constant that a loop multiplied anew at each step i: value * factor ** (i + 1)."""
    return F.lit(value) * F.pow(F.lit(factor), i + 1)


def best_polynomial(points: DataFrame, key: str, degrees=range(2, 11)) -> DataFrame:
    """(key, degree, rmse, coefficients) of the fit to each curve's points (x, y) with the least error, the lowest degree on ties.

    A curve's points are few; curves are dealt out.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        best = None
        for degree in degrees:
            if len(group) <= degree:
                break
            c = np.polyfit(group["x"], group["y"], degree)
            rmse = float(np.sqrt(np.mean((np.polyval(c, group["x"]) - group["y"]) ** 2)))
            if best is None or rmse < best[1]:
                best = (degree, rmse, c.tolist())
        rows = [] if best is None else [(group[key].iloc[0], *best)]
        return pd.DataFrame(rows, columns=[key, "degree", "rmse", "coefficients"])

    return points.groupBy(key).applyInPandas(one, f"{key} {dict(points.dtypes)[key]}, degree int, rmse double, coefficients array<double>")


def sphere_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cx, cy, cz, radius): the algebraic least-squares sphere, from moments that Spark sums.

    The 4 by 4 normal equations of x^2 + y^2 + z^2 = 2ax + 2by + 2cz + d need ten sums a
    group; solving them is one small vectorised step over the groups' sums.
    """
    centred = points.groupBy(*keys).agg(*[F.avg(F.col("p")[c]).alias(f"_m{c}") for c in "xyz"])
    rows = points.join(centred, keys).select(*keys, *[f"_m{c}" for c in "xyz"], *[(F.col("p")[c] - F.col(f"_m{c}")).alias(c) for c in "xyz"])
    s = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2
    terms = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "o": F.lit(1.0)}
    names = list(terms)
    sums = [F.sum(terms[a] * terms[b]).alias(f"_{a}{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(terms[a] * s).alias(f"_s{a}") for a in names]
    moments = rows.groupBy(*keys, *[f"_m{c}" for c in "xyz"]).agg(*sums)
    order = [f"_{a}{b}" for i, a in enumerate(names) for b in names[i:]] + [f"_s{a}" for a in names]

    @F.pandas_udf("array<double>")
    def solve(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns, strict=True):
            matrix, k = np.zeros((4, 4)), 0
            for i in range(4):
                for j in range(i, 4):
                    matrix[i, j] = matrix[j, i] = values[k]
                    k += 1
            a, b, c, d = np.linalg.lstsq(matrix, np.array(values[10:]), rcond=None)[0] / np.array([2, 2, 2, 1])
            out.append([a, b, c, float(np.sqrt(max(0.0, d + a * a + b * b + c * c)))])
        return pd.Series(out)

    solved = moments.withColumn("_f", solve(*[F.col(c) for c in order]))
    return solved.select(*keys, *[(F.col("_f")[i] + F.col(f"_m{c}")).alias(f"c{c}") for i, c in enumerate("xyz")], F.col("_f")[3].alias("radius"))
