"""Single-evaluation binding for higher-order-function expression trees.

Spark evaluates higher-order functions interpretively and does not eliminate
common subexpressions inside them, so an intermediate array referenced k
times is computed k times (and nesting multiplies that). `let(expr, body)`
binds `expr` to a lambda variable that is evaluated once:
`transform(array(expr), x -> body(x))[0]`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(expr: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(expr), body).getItem(0)
