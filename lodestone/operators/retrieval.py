"""After the search: highlights, diverse selection, context packing, claims against evidence, hashed embeddings."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def highlights(text: Column, query: str, most: int = 3, around: int = 220) -> Column:
    """The first ``most`` places of a query word (three letters or more, any case) with ``around`` characters about them; "..." marks a cut.

    An array; empty for a null text or a query without such words. Places come from the
    lengths of the pieces between the matches, so no row leaves the JVM.
    """
    words = [w for w in re.findall(r"\w+", query.lower()) if len(w) >= 3]
    if not words:
        return F.array().cast("array<string>")
    pattern = f"(?i)({'|'.join(words)})"
    pieces = F.split(text, pattern, most + 1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def fragment(i):
        start = F.length(F.array_join(F.slice(pieces, 1, i + 1), "")) + F.length(F.array_join(F.slice(found, 1, i), ""))
        end = start + F.length(F.get(found, F.lit(i)))
        low, high = F.greatest(F.lit(0), start - around // 2), F.least(F.length(text), end + around // 2)
        cut = F.regexp_replace(F.substring(text, low + 1, high - low), r"^\s+|\s+$", "")
        shown = F.concat(F.when(low > 0, "...").otherwise(""), cut, F.when(high < F.length(text), "...").otherwise(""))
        return F.when(F.size(found) > i, shown)

    return F.coalesce(F.array_compact(F.array(*map(fragment, range(most)))), F.array().cast("array<string>"))


def best(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by ``order``, with ``place``; partial limits run before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


_WORD = re.compile(r"\w+")


def _by_tags(column: list):
    return [frozenset(() if t is None else t) for t in column], lambda a, b: len(a & b) / len(a | b) if a | b else 0.0


def _by_text(column: list):
    """A candidate's text as a query for a chosen one: 0.75 of its words found there, 0.10 of the places they take, 0.15 if it stands there whole."""
    plain = [" ".join((t or "").lower().split()) for t in column]
    rows = [(t, Counter(words), len(words)) for t in plain for words in (_WORD.findall(t),)]

    def similarity(a, b):
        if not a[2] or not b[2]:
            return 0.0
        shared = a[1].keys() & b[1].keys()
        return min(1.0, 0.75 * len(shared) / len(a[1]) + 0.10 * sum(b[1][w] for w in shared) / b[2] + (0.15 if a[0] in b[0] else 0.0))

    return rows, similarity


def _by_vector(column: list):
    rows = [None if v is None or not (n := float(np.linalg.norm(v))) else np.asarray(v, float) / n for v in column]
    return rows, lambda a, b: 0.0 if a is None or b is None else float(a @ b)


_LIKE = {"tags": _by_tags, "text": _by_text, "vector": _by_vector}


def diverse(df: DataFrame, by: list[str], key: str, score: str, tags: str, k: int, balance: float = 0.7, candidates: int = 50, like: str = "tags") -> DataFrame:
    """by, key, rank: k of the ``candidates`` best rows of each group, chosen by maximal marginal relevance.

    The best row is first; each next one has the greatest balance * score - (1 - balance) * overlap,
    overlap being its largest similarity to a chosen row by the column ``tags``: Jaccard of
    arrays (``like`` tags), the keyword score of texts (text) or the cosine of vectors
    (vector; 0 without one). Ties go to the better place. A group of any size sends at most
    ``candidates`` rows to its task: that number is the feature. A null score counts as the
    lowest, null tags and texts as empty.
    """
    prepare = _LIKE[like]
    few = best(df.select(*by, key, score, tags), by, [F.desc_nulls_last(score), F.asc(key)], candidates)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        sets, similarity = prepare(list(group[tags]))
        rel = [float("-inf") if pd.isna(s) else float(s) for s in group[score]]
        overlap: list[float | None] = [None] * len(sets)
        left, chosen = list(range(len(sets))), []
        while left and len(chosen) < k:
            at = left[0] if not chosen else max(left, key=lambda i: (balance * rel[i] - (1 - balance) * (overlap[i] or 0.0), -i))
            left.remove(at)
            chosen.append(at)
            for i in left:
                s = similarity(sets[i], sets[at])
                overlap[i] = s if overlap[i] is None else max(overlap[i], s)
        out = group.iloc[chosen][[*by, key]].copy()
        out["rank"] = range(1, len(chosen) + 1)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, key]) + ", rank int"
    return few.groupBy(*by).applyInPandas(choose, schema)


def packed(df: DataFrame, by: list[str], source: str, key: str, score: str, text: str, budget: int, k: int) -> DataFrame:
    """by, key, position, content: a context of at most k texts and about ``budget`` characters for each group, sources in turn.

    The sources come in the order of their best score, one text of each a round. A text takes
    its length and two characters between; the one that passes the budget is cut and marked, and
    is the last. At most k rows of a source and then k of a group go on, so windows stay small.
    """
    kept = df.select(*by, F.coalesce(F.col(source), F.lit("unknown")).alias(source), key, score, F.coalesce(F.col(text), F.lit("")).alias(text))
    rows = best(kept, [*by, source], [F.desc_nulls_last(score), F.asc(key)], k).withColumnRenamed("place", "round")
    first = Window.partitionBy(*by, source).orderBy("round")
    rows = rows.withColumns({"_top": F.first(score).over(first), "_key": F.first(key).over(first)})
    rows = best(rows, by, [F.asc("round"), F.desc_nulls_last("_top"), F.asc("_key")], k)
    before = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_used", F.coalesce(F.sum(F.length(text) + 2).over(before), F.lit(0)))
    room = F.lit(budget) - F.col("_used")
    cut = F.concat(F.substring(F.col(text), F.lit(1), F.greatest(F.lit(0), room - 18).cast("int")), F.lit("\n...[TRUNCATED]"))
    content = F.when(F.length(text) > room, cut).otherwise(F.col(text))
    return rows.where(room > 0).select(*by, key, F.col("place").alias("position"), content.alias("content"))


def word_set(c: Column) -> Column:
    """The different lower-case words (letters, digits, underscore) of a text; empty for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)))


def supported(claims: DataFrame, evidence: DataFrame, scope: list[str], claim: str, doc: str, text: str, least: float) -> DataFrame:
    """scope, claim, support, doc, is_supported: each claim's best evidence of the same scope by Jaccard similarity of words.

    Both sides have ``text``. Only pairs that share a word meet: the words are joined, not
    the texts, and counted before the sizes come in. Ties go to the smaller ``doc``; a claim without any
    shared word has support 0 and no doc.
    """

    def split(df, key):
        s = df.select(*scope, key, word_set(F.col(text)).alias("w"))
        return s.select(*scope, key, F.size("w").alias(f"n_{key}"), F.explode("w").alias("w"))

    pairs = split(claims, claim).join(split(evidence, doc), [*scope, "w"]).groupBy(*scope, claim, doc)
    shared = pairs.agg(F.count("*").alias("m"), F.first(f"n_{claim}").alias("a"), F.first(f"n_{doc}").alias("b"))
    score = F.col("m") / (F.col("a") + F.col("b") - F.col("m"))
    top = shared.withColumn("support", score).groupBy(*scope, claim)
    top = top.agg(F.max("support").alias("support"), F.min_by(doc, F.struct(-F.col("support"), F.col(doc))).alias(doc))
    out = claims.select(*scope, claim).join(top, [*scope, claim], "left")
    support = F.coalesce("support", F.lit(0.0))
    return out.select(*scope, claim, support.alias("support"), doc, (support >= least).alias("is_supported"))


def hashed_embedding(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """key, embedding (array of doubles of length 1): every word adds or takes 1 at a place that its BLAKE2b digest names.

    A text without words has zeros. Spark has no BLAKE2b, so words are hashed in Arrow
    batches, each different word of a batch once; sums and lengths are native.
    """
    import hashlib

    from pyspark.sql.types import IntegerType

    @F.pandas_udf(IntegerType())
    def signed_place(words: pd.Series) -> pd.Series:
        def one(w):
            d = hashlib.blake2b(w.encode(), digest_size=16).digest()
            at = int.from_bytes(d[:4], "big") % size + 1
            return at if d[4] % 2 == 0 else -at

        codes, different = pd.factorize(words)
        return pd.Series([one(w) for w in different], dtype="int32").take(codes).reset_index(drop=True)

    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    counted = df.select(key, F.explode_outer(words).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    placed = counted.select(key, "n", signed_place(F.coalesce("w", F.lit(""))).alias("p"), F.col("w").isNotNull().alias("real"))
    sums = [F.sum(F.when(F.col("real") & (F.abs("p") == i + 1), F.signum("p") * F.col("n")).otherwise(0.0)) for i in range(size)]
    vectors = placed.groupBy(key).agg(F.array(*sums).alias("v"))
    length = F.sqrt(reduce(lambda a, b: a + b, (F.col("v")[i] * F.col("v")[i] for i in range(size))))
    return vectors.withColumn("_l", length).select(key, F.transform("v", lambda x: F.when(F.col("_l") > 0, x / F.col("_l")).otherwise(0.0)).alias("embedding"))
