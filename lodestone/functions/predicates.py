"""Filters and rule trees as Columns: small specs in, one boolean expression out, so that scans still get their predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _contains(c: Column, v, ignore_case: bool) -> Column:
    c, v = c.cast("string"), F.lit(str(v))
    return F.contains(F.lower(c), F.lower(v)) if ignore_case else F.contains(c, v)


def condition(field: str | Column, op: str, value=None, ignore_case: bool = True) -> Column:
    """One comparison. An empty ``in`` is false and an empty ``not_in`` true; ``between`` takes a pair, both ends inside."""
    c = F.col(field) if isinstance(field, str) else field
    simple = {"eq": lambda: c == value, "ne": lambda: c != value, "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value}
    if op in simple:
        return simple[op]()
    if op == "in":
        return c.isin(list(value)) if value else F.lit(False)
    if op == "not_in":
        return ~c.isin(list(value)) if value else F.lit(True)
    if op == "between":
        low, high = value
        return c.between(low, high)
    if op == "contains":
        return _contains(c, value, ignore_case)
    if op == "starts_with":
        return c.startswith(value)
    if op == "ends_with":
        return c.endswith(value)
    if op in ("regex", "matches"):
        return c.rlike(value)
    if op == "like":
        return c.like(value)
    if op == "ilike":
        return c.ilike(value)
    if op in ("is_null", "exists"):
        null = c.isNull()
        return null if (op == "is_null") == (value is not False) else ~null
    if op == "is_not_null":
        return c.isNotNull()
    if op == "array_contains":
        return F.array_contains(c, value)
    raise ValueError(f"unknown operator {op!r}")


def all_of(filters) -> Column:
    """The conjunction of (field, op, value) triples; no filter keeps every row."""
    return reduce(lambda a, b: a & b, (condition(*f) for f in filters), F.lit(True))


def rule(tree: dict) -> Column:
    """A tree of {"all": [...]}, {"any": [...]}, {"not": tree} and {"field", "op", "value"}; what can't be told (null) is false."""
    if "all" in tree:
        return reduce(lambda a, b: a & b, map(rule, tree["all"]), F.lit(True))
    if "any" in tree:
        return reduce(lambda a, b: a | b, map(rule, tree["any"]), F.lit(False))
    if "not" in tree:
        return ~rule(tree["not"])
    return F.coalesce(condition(tree["field"], tree["op"], tree.get("value")), F.lit(False))


def visible(tags: Column, include=(), exclude=()) -> Column:
    """Whether an array of tags holds all of ``include`` and none of ``exclude``; null is an empty array."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    need, bar = (F.array(*map(F.lit, x)).cast("array<string>") for x in (include, exclude))
    return (F.size(F.array_except(need, tags)) == 0) & ~F.coalesce(F.arrays_overlap(tags, bar), F.lit(False))
