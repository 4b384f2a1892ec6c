"""Numeric checks of formulas in steps: plain arithmetic on both sides of an equation (J5, without symbolic algebra)."""

from __future__ import annotations

import ast
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}
#: Largest exponent and longest expression that are computed.
MOST_POWER, MOST_CHARS = 100, 300


def plain(text: str) -> str:
    """A formula as an arithmetic expression: fractions, products and powers in signs."""
    s = text.strip().strip("$").replace("×", "*").replace("·", "*").replace("÷", "/").replace("−", "-").replace("\\times", "*").replace("\\cdot", "*").replace("\\div", "/").replace("\\left", "").replace("\\right", "")
    while (new := re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", s)) != s:
        s = new
    return s.replace("{", "(").replace("}", ")").replace("^", "**")


def value(expression: str) -> float | None:
    """The number an expression stands for; None if it is no plain arithmetic."""

    def walk(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return float(node.value)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](walk(node.operand))
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Pow):
                if abs(b) > MOST_POWER:
                    raise ValueError("power")
                return a**b
            return _OPERATORS[type(node.op)](a, b)
        raise ValueError("no arithmetic")

    if not expression or len(expression) > MOST_CHARS:
        return None
    try:
        got = walk(ast.parse(expression.strip(), mode="eval").body)
        return got if isinstance(got, float) else None
    except (ValueError, SyntaxError, KeyError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def equation_holds(text: str | None, tolerance: float = 1e-6) -> bool | None:
    """Whether both sides of an equation are the same number; None if it is no numeric equation."""
    if not text or text.count("=") != 1:
        return None
    left, right = (value(plain(x)) for x in text.strip().strip("$").split("="))
    if left is None or right is None:
        return None
    return abs(left - right) <= tolerance * max(1.0, abs(left), abs(right))


def holds(c: Column) -> Column:
    """equation_holds for a formula column, by Arrow batches."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(equation_holds).astype("boolean")

    return run(c)
