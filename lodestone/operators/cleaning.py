"""Cleaning and schema mapping: specs of fields compiled to one projection over one scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class Field:
    """How one column is cleaned.

    ``kind`` is string, integer, number, boolean or timestamp; ``text`` are arguments of
    functions.text.clean; ``outside`` says what becomes of a number outside low and high:
    keep, clip, null, drop (the row) or error.
    """

    source: str
    target: str | None = None
    kind: str = "string"
    required: bool = False
    default: object = None
    text: dict = field(default_factory=dict)
    low: float | None = None
    high: float | None = None
    outside: str = "keep"
    digits: int | None = None
    shortest: int | None = None
    allowed: tuple | None = None
    redacted: bool = False

    @property
    def name(self) -> str:
        return self.target or self.source


def typed(c: Column, kind: str) -> Column:
    """Text as one of the kinds; null if it is none of that kind."""
    as_text = c.cast("string")
    made = {
        "string": lambda: as_text,
        "integer": lambda: X.number(as_text).cast("long"),
        "number": lambda: X.number(as_text),
        "boolean": lambda: X.boolean(as_text),
        "timestamp": lambda: X.timestamp(as_text),
    }
    return made[kind]()


def _compiled(f: Field) -> tuple[Column, list[Column], Column]:
    """(value, errors as texts or null, whether the row is dropped)."""
    raw = F.col(f.source).cast("string")
    blank = raw.isNull() | (raw == "")
    if f.redacted:
        return F.when(~blank, F.lit("[REDACTED]")), [], F.lit(False)
    value = typed(F.when(~blank, raw), f.kind)
    errors = [F.when(~blank & value.isNull(), F.lit(f"type:{f.name}"))]
    if f.required:
        errors.append(F.when(blank, F.lit(f"missing:{f.name}")))
    drop = F.lit(False)
    if f.kind == "string":
        value = X.clean(value, **f.text)
        if f.shortest is not None:
            errors.append(F.when(F.length(value) < f.shortest, F.lit(f"short:{f.name}")))
    if f.kind in ("integer", "number"):
        beyond = F.lit(False)
        beyond = beyond | (value < f.low) if f.low is not None else beyond
        beyond = F.coalesce(beyond | (value > f.high) if f.high is not None else beyond, F.lit(False))
        if f.outside == "clip":
            bound = value if f.low is None else F.greatest(value, F.lit(f.low))
            bound = bound if f.high is None else F.least(bound, F.lit(f.high))
            value = F.when(value.isNotNull(), bound)
        elif f.outside == "null":
            value = F.when(~beyond, value)
        elif f.outside == "error":
            errors.append(F.when(beyond, F.lit(f"range:{f.name}")))
        drop = beyond if f.outside == "drop" else drop
        value = F.round(value, f.digits) if f.digits is not None else value
        value = value.cast("long") if f.kind == "integer" else value
    if f.allowed is not None:
        errors.append(F.when(value.isNotNull() & ~value.isin(*f.allowed), F.lit(f"allowed:{f.name}")))
    return (value if f.default is None else F.when(blank, F.lit(f.default)).otherwise(value)), errors, drop


def cleaned(df: DataFrame, fields: list[Field], others: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clean rows, dead letters with ``reasons`` and the row as JSON ``payload``).

    A null and an empty text are missing: an error where the field is required, else the
    default. Rows whose number is outside with ``drop`` are in neither. ``others`` keeps
    the columns that no field names. Clean and dead are two filters over the same projection.
    """
    parts = [_compiled(f) for f in fields]
    used = {f.source for f in fields} | {f.name for f in fields}
    rest = [c for c in df.columns if c not in used] if others else []
    errors = [e for _, es, _ in parts for e in es]
    drop = F.lit(False)
    for _, _, d in parts:
        drop = drop | d
    values = [v.alias(f.name) for f, (v, _, _) in zip(fields, parts, strict=True)]
    payload = F.to_json(F.struct(*df.columns))
    out = df.where(~drop).select(*values, *rest, F.array_compact(F.array(*errors)).alias("_reasons"), payload.alias("_payload"))
    good = out.where(F.size("_reasons") == 0).drop("_reasons", "_payload")
    return good, out.where(F.size("_reasons") > 0).select(F.col("_reasons").alias("reasons"), F.col("_payload").alias("payload"))


def marked_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df and ``_duplicate``: whether a row of the same keys comes before it. Equal null keys count as equal."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_duplicate", place > 1)


@dataclass(frozen=True)
class Target:
    """A column of another schema: the first source that is not blank (or ``derive``), else ``default``; then cast and checked.

    ``checks`` are named conditions over the target columns; a null condition is not broken.
    """

    name: str
    sources: tuple[str, ...] = ()
    dtype: str = "string"
    derive: Column | None = None
    default: object = None
    required: bool = False
    checks: dict = field(default_factory=dict)


def mapped(df: DataFrame, targets: list[Target]) -> DataFrame:
    """The targets and ``errors`` (missing:<name>, type:<name>, check:<name>:<check>); sources that df lacks are passed over."""

    def found(t: Target) -> Column:
        if t.derive is not None:
            return t.derive
        trimmed = [F.trim(F.col(s).cast("string")) for s in t.sources if s in df.columns]
        kept = [F.when(c != "", c) for c in trimmed]
        kept += [F.lit(t.default).cast("string")] if t.default is not None else []
        return F.coalesce(*kept) if kept else F.lit(None).cast("string")

    out = df.select(*(found(t).alias(f"_raw_{t.name}") for t in targets))
    out = out.select("*", *(F.col(f"_raw_{t.name}").try_cast(t.dtype).alias(t.name) for t in targets))
    errors = []
    for t in targets:
        raw = F.col(f"_raw_{t.name}")
        errors.append(F.when(raw.isNotNull() & F.col(t.name).isNull(), F.lit(f"type:{t.name}")))
        if t.required:
            errors.append(F.when(raw.isNull(), F.lit(f"missing:{t.name}")))
        errors += [F.when(~c, F.lit(f"check:{t.name}:{n}")) for n, c in t.checks.items()]
    return out.select(*(t.name for t in targets), F.array_compact(F.array(*errors)).alias("errors"))
