"""Computed columns: arithmetic over other columns, as Column expressions.

The text is read by Python's own `ast` and only whitelisted nodes are translated; nothing is evaluated.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import mixed, text
from logloom.functions.columns import col

# Fixed value: digits a computed column is rounded to.
FORMULA_DIGITS = 3


def _floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


_BINARY = {
    ast.Add: F.try_add,
    ast.Sub: F.try_subtract,
    ast.Mult: F.try_multiply,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))),
    ast.Mod: _floor_mod,
    ast.Pow: lambda a, b: F.pow(a, b),
}
_UNARY = {ast.USub: lambda a: F.try_subtract(F.lit(0), a), ast.UAdd: lambda a: a}


def _parse(formula: str) -> ast.expr:
    try:
        return ast.parse(formula.strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"bad formula {formula!r}: {error.msg}") from error


def formula_names(formula: str) -> list[str]:
    """The column names a formula uses."""
    return list(dict.fromkeys(n.id for n in ast.walk(_parse(formula)) if isinstance(n, ast.Name)))


def formula_column(
    formula: str, names: list[str] | None = None, texts: list[str] | tuple[str, ...] = (), variants: list[str] | tuple[str, ...] = (),
) -> Column:
    """The formula as a Column, rounded. Division by zero and what is beyond a type's range give NULL.

    With `names`, a formula that uses any other column is an error. Columns in `texts` count as the number that
    they read as, or NULL, those in `variants` as the number they hold, or NULL.
    """

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            return _UNARY[type(node.op)](build(node.operand))
        if isinstance(node, ast.Name):
            if names is not None and node.id not in names:
                raise ValueError(f"formula {formula!r} uses an unknown column {node.id!r}")
            if node.id in variants:
                return mixed.number(col(node.id))
            return text.to_number(col(node.id)) if node.id in texts else col(node.id)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(node.value)
        raise ValueError(f"formula {formula!r}: only numbers, columns, + - * / // % ** and brackets")

    return F.round(build(_parse(formula)), FORMULA_DIGITS)


def add_formulas(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Add computed columns in one step, so none of them sees another."""
    if not formulas:
        return df
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    variants = [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]
    made = {name: formula_column(formula, df.columns, texts, variants) for name, formula in formulas.items()}
    return df.withColumns(made)
