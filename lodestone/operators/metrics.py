"""Metrics as expressions: aggregates at the leaves, formulas over other metrics above them, all of one grouping in one aggregate."""

from __future__ import annotations

import ast
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import Agg, measure


class UnsafeExpression(ValueError):
    """An expression with something other than numbers, names, arithmetic and the listed functions."""


def _power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: _power, ast.Mod: lambda a, b: F.try_subtract(a, b * F.floor(F.try_divide(a, b)))}
_FUNCTIONS = {
    "min": lambda *a: F.when(_all_there(a), F.least(*a)) if len(a) > 1 else a[0], "max": lambda *a: F.when(_all_there(a), F.greatest(*a)) if len(a) > 1 else a[0],
    "abs": F.abs, "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)), "log": lambda a, base=None: F.when(a > 0, F.ln(a)) if base is None else F.try_divide(F.when(a > 0, F.ln(a)), F.when(base > 0, F.ln(base))),
}


def _all_there(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= c.isNotNull()
    return out


def names_in(text: str) -> set[str]:
    """The names that an expression reads, functions left out."""
    nodes = list(ast.walk(_tree(text)))
    called = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
    return {n.id for n in nodes if isinstance(n, ast.Name) and id(n) not in called}


def _tree(text: str) -> ast.expr:
    try:
        return ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise UnsafeExpression(f"{text!r}: {e}") from e


def expression(text: str, known: dict[str, Column]) -> Column:
    """The Column of an arithmetic expression: + - * / % **, min, max, abs, sqrt, log(x[, base]) and round(x[, digits]).

    A division by 0, a root or logarithm of what has none, and any null give null. The
    sign of a remainder is that of the divisor.
    """

    def of(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in known:
                raise UnsafeExpression(f"unknown name {node.id!r} in {text!r}")
            return known[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -of(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords and node.args:
            if node.func.id == "round" and len(node.args) <= 2 and all(isinstance(a, ast.Constant) and type(a.value) is int for a in node.args[1:]):
                return F.bround(of(node.args[0]), node.args[1].value if node.args[1:] else 0)
            most = {"abs": 1, "sqrt": 1, "log": 2}.get(node.func.id, 99)
            if node.func.id in _FUNCTIONS and len(node.args) <= most:
                return _FUNCTIONS[node.func.id](*map(of, node.args))
        raise UnsafeExpression(f"{ast.dump(node)[:60]} is not allowed in {text!r}")

    return of(_tree(text))


@dataclass(frozen=True)
class Metric:
    """A named measure: an aggregate of the rows (``agg``) or an expression over other metrics. ``target`` and ``higher`` make it a KPI."""

    name: str
    agg: Agg | None = None
    formula: str | None = None
    target: float | None = None
    higher: bool = True

    def __post_init__(self):
        if (self.agg is None) == (self.formula is None):
            raise ValueError(f"{self.name}: either an aggregate or a formula")


def ordered(metrics: list[Metric]) -> list[Metric]:
    """The metrics, each behind those it reads. Two of one name, unknown names and cycles are errors."""
    by_name = {m.name: m for m in metrics}
    if len(by_name) < len(metrics):
        raise ValueError("two metrics have one name")
    reads = {m.name: names_in(m.formula) if m.formula else set() for m in metrics}
    for name, used in reads.items():
        if unknown := used - by_name.keys():
            raise UnsafeExpression(f"{name} reads unknown {sorted(unknown)}")
    try:
        return [by_name[n] for n in TopologicalSorter({k: sorted(v) for k, v in reads.items()}).static_order()]
    except CycleError as e:
        raise ValueError(f"metrics read one another in a cycle: {' -> '.join(e.args[1])}") from e


def computed(df: DataFrame, by: list[str], metrics: list[Metric], wanted: list[str] | None = None) -> DataFrame:
    """by and the wanted metrics (all, in their order), with ``<name>_achieved`` (percent of the target) for KPIs.

    Leaves that the wanted ones need are measures of one aggregate; formulas are one
    projection over it, each written out in terms of the leaves.
    """
    order = ordered(metrics)
    needed = set(wanted or [m.name for m in metrics])
    if unknown := needed - {m.name for m in metrics}:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    for m in reversed(order):
        if m.name in needed and m.formula:
            needed |= names_in(m.formula)
    leaves = [m for m in order if m.agg and m.name in needed]
    rows = df.groupBy(*by).agg(*(measure(m.agg).alias(f"_m_{m.name}") for m in leaves)) if leaves else df.select(*by).distinct()
    known = {m.name: F.col(f"_m_{m.name}").cast("double") for m in leaves}
    for m in order:
        if m.formula and m.name in needed:
            known[m.name] = expression(m.formula, known)
    out = []
    for m in metrics:
        if wanted is None or m.name in wanted:
            out.append(known[m.name].alias(m.name))
            if m.target is not None:
                over, under = (known[m.name], F.lit(m.target)) if m.higher else (F.lit(m.target), known[m.name])
                out.append((F.try_divide(over, under) * 100).alias(f"{m.name}_achieved"))
    return rows.select(*by, *out)
