"""Pandas UDFs that are made when first used, so that modules can be imported without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


def vectorized(returns: str) -> Callable:
    """Like pandas_udf, but asks for the session at the call."""

    def wrap(f: Callable) -> Callable:
        def call(*columns):
            return F.pandas_udf(f, returns)(*columns)

        call.__doc__, call.__name__, call.plain = f.__doc__, f.__name__, f
        return call

    return wrap
