"""Rows of two engines as sorted text, floats to nine digits."""

import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if type(v).__name__ == "datetime":
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([plain(r[i]) for i in order] for r in records)


def assert_same(df, rel):
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        if a != b:
            for x, y in zip(a, b):
                assert x == y or math.isclose(float(x), float(y), rel_tol=1e-7, abs_tol=1e-9), (a, b)
