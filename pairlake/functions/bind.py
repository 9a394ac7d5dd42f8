"""Evaluate a column once and use it several times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda is otherwise computed again per element,
    which makes work on an array quadratic.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
