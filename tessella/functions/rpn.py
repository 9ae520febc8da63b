"""Postfix sample expressions as Spark Columns, in float32 throughout."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.info import OperatorError, need

#: Names of the inputs, in order.
INPUTS = "xyzabcdefghijklmnopqrstuvw"


def _f(c: Column) -> Column:
    return c.cast("float")


def _flag(c: Column) -> Column:
    return _f(F.when(c, 1.0).otherwise(0.0))


def _true(c: Column) -> Column:
    return c > F.lit(0).cast("float")


_TWO = {
    "+": lambda a, b: _f(a + b),
    "-": lambda a, b: _f(a - b),
    "*": lambda a, b: _f(a * b),
    # a float quotient by zero is infinite or not a number, and no error
    "/": lambda a, b: F.when(b == 0, F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan)).cast("float")).otherwise(_f(F.try_divide(a, b))),
    "max": lambda a, b: F.when(a < b, b).otherwise(a),
    "min": lambda a, b: F.when(b < a, b).otherwise(a),
    "<": lambda a, b: _flag(a < b),
    ">": lambda a, b: _flag(a > b),
    "=": lambda a, b: _flag(a == b),
    "<=": lambda a, b: _flag(a <= b),
    ">=": lambda a, b: _flag(a >= b),
    "and": lambda a, b: _flag(_true(a) & _true(b)),
    "or": lambda a, b: _flag(_true(a) | _true(b)),
    "xor": lambda a, b: _flag(_true(a) != _true(b)),
    "pow": lambda a, b: _f(F.pow(a, b)),
}
_ONE = {
    "not": lambda a: _flag(~_true(a)),
    "abs": lambda a: _f(F.abs(a)),
    "sqrt": lambda a: _f(F.sqrt(a)),
    "exp": lambda a: _f(F.exp(a)),
    "log": lambda a: F.when(a > 0, _f(F.ln(a))).when(a == 0, F.lit(-math.inf).cast("float")).otherwise(F.lit(math.nan).cast("float")),
    "sin": lambda a: _f(F.sin(a)),
    "cos": lambda a: _f(F.cos(a)),
}


def compiled(text: str, inputs: list[Column]) -> Column:
    """The Column of an expression over the inputs' samples."""
    stack: list[Column] = []

    def take(n: int, token: str) -> list[Column]:
        need(len(stack) >= n, f"Expr: too few values for {token}")
        out = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        return out

    for token in text.split():
        if token in _TWO:
            stack.append(_TWO[token](*take(2, token)))
        elif token in _ONE:
            stack.append(_ONE[token](*take(1, token)))
        elif token == "?":
            c, t, f = take(3, token)
            stack.append(F.when(_true(c), t).otherwise(f))
        elif m := re.fullmatch(r"(dup|swap)(\d*)", token):
            k = int(m[2] or (m[1] == "swap"))
            need(len(stack) > k, f"Expr: too few values for {token}")
            if m[1] == "dup":
                stack.append(stack[-1 - k])
            else:
                stack[-1], stack[-1 - k] = stack[-1 - k], stack[-1]
        elif len(token) == 1 and token in INPUTS:
            at = INPUTS.index(token)
            need(at < len(inputs), f"Expr: there is no clip {token}")
            stack.append(_f(inputs[at]))
        else:
            try:
                stack.append(_f(F.lit(float(token))))
            except ValueError:
                raise OperatorError(f"Expr: what is {token}?") from None
    need(len(stack) > 0, "Expr: an empty expression")
    need(len(stack) == 1, "Expr: values are left over")
    return stack[0]
