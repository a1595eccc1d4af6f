"""Small combinators over higher-order functions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda variable is the one binding the optimizer never inlines, so a
    regular expression used in several places below still runs only once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(table: dict, key: Column, kind: str = "string") -> Column:
    """Value of a constant table, null for an unknown key; the table is one literal."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>"), key)


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(items: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running total of ``items`` under an associative ``combine``.

    Doubling strides (1, 2, 4, ...) keep it at n log n steps. Appending to an
    array inside one fold would copy the whole prefix at every step, which is
    quadratic for a file with very many matches.
    """
    strides = F.filter(
        F.array(*[F.lit(1 << i) for i in range(31)]), lambda d: d < F.size(items)
    )
    return F.aggregate(
        strides,
        items,
        lambda acc, d: F.transform(
            acc,
            lambda x, i: F.when(i >= d, combine(F.get(acc, i - d), x)).otherwise(x),
        ),
    )
