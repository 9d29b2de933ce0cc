"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def first_match(rules: Iterable[tuple[Column, Column | str | None]], otherwise: Column | str | None = None) -> Column:
    """CASE in rule order."""
    out = None
    for cond, val in rules:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if out is None:
        return otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def lookup(table: dict, key: Column) -> Column:
    """Value of a literal map, null where the key is absent."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*entries), key)


def has_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def hits(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur in the text."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def group(text: Column, pattern: str, i: int = 1) -> Column:
    """A regex group, null (not empty) where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def tier(conf: Column, bounds: list[tuple[float, str]], floor: str) -> Column:
    return first_match([(conf >= b, name) for b, name in bounds], floor)


def rate(num: Column, den: Column) -> Column:
    """num / den as double, 0 where den is 0."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))
