"""Declared inputs of a query."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

from basketry.sources.schemas import check_columns



class Whole(tuple):
    """All columns of a table; the named ones must be there."""


def requires(**needs: tuple[str, ...]) -> Callable:
    """Name the tables a query reads and the columns it uses of each.

    The frames are passed in the declared order. Missing columns are reported
    before anything runs, and only the declared columns are handed on. ``needs``
    stays readable on the function, so a binding can leave out joins that only
    serve other columns.
    """

    def wrap(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(query)
        def checked(*frames: DataFrame, **choices) -> DataFrame:
            if len(frames) != len(needs):
                raise TypeError(f"{query.__name__} reads the tables {', '.join(needs)}")
            inputs = []
            for (table, columns), frame in zip(needs.items(), frames):
                check_columns(frame, table, columns)
                if not isinstance(columns, Whole):
                    frame = frame.select(*columns)
                inputs.append(frame)
            return query(*inputs, **choices)

        checked.needs = needs
        return checked

    return wrap
