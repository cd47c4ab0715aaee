"""Text, number, boolean, date and identifier functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents and what they become.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"
#: Words for true and false.
TRUE = "1 true t yes y sim s on".split()
FALSE = "0 false f no n nao não off".split()


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean(c: Column, accents: bool = False, case: str = "keep", allowed: str | None = None, longest: int | None = None) -> Column:
    """trim, accents, collapse, case, allowed characters (the inside of a class), length; in this order."""
    c = F.trim(c)
    c = unaccent(c) if accents else c
    c = collapse(c)
    c = {"keep": lambda x: x, "lower": F.lower, "upper": F.upper, "title": F.initcap}[case](c)
    c = F.regexp_replace(c, f"[^{allowed}]", "") if allowed else c
    return F.substring(c, 1, longest) if longest else c


def words_of_name(c: Column) -> Column:
    """The lower-case words of an identifier in any style."""
    spaced = F.regexp_replace(F.regexp_replace(unaccent(c), "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda x: x != "")


def snake(c: Column) -> Column:
    return F.array_join(words_of_name(c), "_")


def kebab(c: Column) -> Column:
    return F.array_join(words_of_name(c), "-")


def camel(c: Column) -> Column:
    w = words_of_name(c)
    return F.concat(F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.array_join(F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), F.initcap), ""))


def number(c: Column, decimal: str = ".", low: float | None = None, high: float | None = None) -> Column:
    """A double from text with thousands separators; null if it is none. A decimal comma swaps the signs' roles."""
    c = F.regexp_replace(c, r"[^0-9,.eE+-]", "")
    c = F.translate(F.regexp_replace(c, r"\.", ""), ",", ".") if decimal == "," else F.regexp_replace(c, ",", "")
    x = c.try_cast("double")
    x = F.greatest(x, F.lit(float(low))) if low is not None else x
    return F.least(x, F.lit(float(high))) if high is not None else x


def boolean(c: Column) -> Column:
    c = F.lower(F.trim(c.cast("string")))
    return F.when(c.isin(TRUE), True).when(c.isin(FALSE), False)


def timestamp(c: Column, formats=("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")) -> Column:
    """Epoch seconds or (above 1e10) milliseconds, ISO text, or one of the formats; null if none fits."""
    n = c.try_cast("double")
    epoch = F.when(n > 1e10, F.timestamp_millis(n.cast("long"))).otherwise(F.timestamp_seconds(n))
    return F.coalesce(F.when(n.isNotNull(), epoch), *(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def listed(c: Column, sep: str = ",") -> Column:
    """An array of trimmed, non-empty texts from a JSON array or separated text; null stays null."""
    parts = F.coalesce(F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>"), F.split(c, sep, -1))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def pairs(c: Column, sep: str = ";", eq: str = "=") -> Column:
    """A map from a JSON object or ``key=value`` pairs, the last of equal keys kept; pairs without a key are left out, null stays null."""
    entries = F.transform(listed(c, sep), lambda x: F.struct(F.trim(F.substring_index(x, eq, 1)).alias("key"), F.when(F.contains(x, F.lit(eq)), F.trim(F.substr(x, F.instr(x, eq) + 1))).alias("value")))
    named = F.filter(entries, lambda e: e["key"] != "")
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.from_json(F.when(F.trim(c).startswith("{"), c), "map<string,string>"), F.map_from_entries(last))


def at_path(c: Column, path: str) -> Column:
    """What a dotted path names in JSON text (numbers are places of arrays), as text; null if nothing is there."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(c, f"${steps}")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_À-ÿ]+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def hash_bucket(c: Column, n: int) -> Column:
    """The first 15 hex digits of sha256, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("long"), F.lit(n))


def mask_partial(c: Column, first: int, last: int, sign: str = "*") -> Column:
    """First and last characters kept; all masked if there are no others."""
    n = F.length(c)
    kept = F.concat(F.substring(c, 1, first), F.repeat(F.lit(sign), n - first - last), F.right(c, F.lit(last)) if last else F.lit(""))
    return F.when(n <= first + last, F.repeat(F.lit(sign), n)).otherwise(kept)


def mask_email(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.concat(mask_partial(F.substring_index(c, "@", 1), 1, 1), F.lit("@"), F.substring_index(c, "@", -1))).otherwise(mask_partial(c, 1, 1))


def mask_card(c: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) < 8, mask_partial(c, 0, 2)).otherwise(mask_partial(d, 6, 4))


def _mod11(digits: Column, weights: list[int]) -> Column:
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    r = total % 11
    return F.when(r < 2, F.lit(0)).otherwise(11 - r)


def is_cpf(c: Column) -> Column:
    """Eleven digits, not all alike, with both check digits right."""
    d = F.regexp_replace(c, "[^0-9]", "")
    first = _mod11(d, list(range(10, 1, -1)))
    second = _mod11(d, list(range(11, 1, -1)))
    ok = (F.substring(d, 10, 1).cast("int") == first) & (F.substring(d, 11, 1).cast("int") == second)
    return F.when(F.length(d) == 11, ~d.rlike(r"^(\d)\1*$") & ok).otherwise(False)


def is_cnpj(c: Column) -> Column:
    """Fourteen digits, not all alike, with both check digits right."""
    d = F.regexp_replace(c, "[^0-9]", "")
    weights = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    ok = (F.substring(d, 13, 1).cast("int") == _mod11(d, weights[1:])) & (F.substring(d, 14, 1).cast("int") == _mod11(d, weights))
    return F.when(F.length(d) == 14, ~d.rlike(r"^(\d)\1*$") & ok).otherwise(False)


def is_luhn(c: Column) -> Column:
    """13 to 19 digits that pass the Luhn test."""
    d = F.regexp_replace(c, "[^0-9]", "")
    padded = F.lpad(d, 19, "0")
    total = sum(((F.translate(x, "0123456789", "0246813579") if i % 2 else x).cast("int") for i, x in ((i, F.substring(padded, i + 1, 1)) for i in range(19))), F.lit(0))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is (nearly) zero."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-12, dot(a, b) / n).otherwise(0.0)
