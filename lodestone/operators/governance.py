"""Masking, tokens, retention, contracts, schema drift and risk scores as column expressions over one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a type may become without loss.
WIDER = {
    "byte": "short integer long float double decimal string", "short": "integer long float double decimal string", "integer": "long float double decimal string",
    "long": "float double decimal string", "float": "double decimal string", "double": "decimal string", "decimal": "string", "date": "timestamp timestamp_ntz string", "boolean": "string",
}


def hash_number(value: Column, salt: str) -> Column:
    """The first 32 bits of the salted SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 8), 16, 10).cast("long")


def shifted_date(ts: Column, value: Column, salt: str, most: int) -> Column:
    """ts moved by a number of days within most, fixed by the salted value."""
    return F.date_add(ts.cast("date"), (F.pmod(hash_number(value, salt), F.lit(2 * most + 1)) - most).cast("int"))


def noisy(n: Column, value: Column, salt: str, ratio: float) -> Column:
    return n + n * F.lit(ratio * 2) * (hash_number(value, salt) / F.lit(float(0xFFFFFFFF)) - 0.5)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal, of two native hashes."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ x for k in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("string").cast("binary")), 256))), 256)


def masked(df: DataFrame, policy: dict[str, Column | None]) -> DataFrame:
    """Columns by policy: an expression, or None for a null of the column's type. Columns without a policy stay."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.lit(None).cast(kinds[c]) if e is None else e for c, e in policy.items()})


def retention(created: Column, now: Column, policies: list[tuple[Column, int, str]], hold: Column, review: Column | None = None) -> Column:
    """The action of the first policy that matches (condition, days, action): on hold ``review``, before its days ``keep``, a ``delete`` that needs review ``review``."""
    age = F.datediff(now, created)
    needs = F.coalesce(review, F.lit(False)) if review is not None else F.lit(False)

    def act(days, action):
        late = F.when(needs, F.lit("review")).otherwise(F.lit(action)) if action == "delete" else F.lit(action)
        return F.when(age < days, F.lit("keep")).otherwise(late)

    out = F.lit("no_policy")
    for when, days, action in reversed(policies):
        out = F.when(when, act(days, action)).otherwise(out)
    return F.when(F.coalesce(hold, F.lit(False)), F.lit("review")).otherwise(out)


def contract_rules(fields: dict[str, dict]) -> dict[str, Column]:
    """Rules by name from a contract: ``required``, ``min``, ``max``, ``allowed``, ``pattern``, ``longest`` for each field. Null passes all but required."""
    out = {}
    for name, want in fields.items():
        c = F.col(name)
        made = {
            "required": lambda v, c=c: c.isNotNull() if v else F.lit(True),
            "min": lambda v, c=c: c >= v,
            "max": lambda v, c=c: c <= v,
            "allowed": lambda v, c=c: c.isin(*v),
            "pattern": lambda v, c=c: c.rlike(v),
            "longest": lambda v, c=c: F.length(c) <= v,
        }
        for kind, v in want.items():
            rule = made[kind](v)
            out[f"{name}_{kind}"] = rule if kind == "required" else F.coalesce(rule, F.lit(True))
    return out


def schema_drift(expected: StructType, observed: StructType) -> list[tuple[str, str, bool]]:
    """(column, change, breaking): added, removed, widened, narrowed, retyped, nullable, not_null or moved. Schemas only; no data is read."""
    old, new = {f.name: f for f in expected}, {f.name: f for f in observed}
    out = [(n, "removed", True) for n in old if n not in new] + [(n, "added", not new[n].nullable) for n in new if n not in old]
    for n in old.keys() & new.keys():
        a, b = old[n].dataType.typeName(), new[n].dataType.typeName()
        if a != b:
            out.append((n, "widened", False) if b in WIDER.get(a, "").split() else (n, "narrowed" if a in WIDER.get(b, "").split() else "retyped", True))
        if old[n].nullable != new[n].nullable:
            out.append((n, "nullable" if new[n].nullable else "not_null", not new[n].nullable))
    both = [n for n in old if n in new]
    out += [(n, "moved", False) for n, m in zip(both, [n for n in new if n in old], strict=True) if n != m]
    return sorted(out)


def noisy_or(rules: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(risk, names of the rules that hold): 1 minus the product of 1 - risk; a null condition does not hold."""
    hit = {n: F.coalesce(c, F.lit(False)) for n, (c, _) in rules.items()}
    left = reduce(lambda a, b: a * b, (F.when(hit[n], 1.0 - r).otherwise(1.0) for n, (_, r) in rules.items()))
    return 1.0 - left, F.array_compact(F.array(*(F.when(h, F.lit(n)) for n, h in hit.items())))


def level(score: Column, cuts: list[tuple[float, str]], lowest: str) -> Column:
    """The name of the highest cut that score reaches."""
    out = F.lit(lowest)
    for at, name in sorted(cuts):
        out = F.when(score >= at, F.lit(name)).otherwise(out)
    return out
