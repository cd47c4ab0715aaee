"""The queries of this package and their SQL: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, importance, langid, media, merkle, mixing, neighbours, packed, pii, quality, toxicity
from . import html as pages
from .ngram_join import jaccard_components, jaccard_links


def tokenizer_file(name: str) -> str:
    """A file of the installed tokenizer vocabularies; they are never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def op1_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_copies(spark, sf_dir):
    return media.copies_of_embeddings(table(spark, sf_dir, "embeddings"))


def op3_packed_tokens(spark, sf_dir):
    return packed.packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end=2)


def op4_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), pattern())


def op5_pii(spark, sf_dir):
    return pii.spans(table(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark, sf_dir):
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=_fold(3) != 1)
    return scored.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted", "n_exact", "n_misspelled", "n_quoted")


def op8_language(spark, sf_dir):
    found = langid.identify(table(spark, sf_dir, "documents"), learn=_fold(4) != 2)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_mixing(spark, sf_dir):
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_ngram_links(spark, sf_dir):
    return jaccard_links(table(spark, sf_dir, "documents"))


def op11_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_quality_rules, op2_media_copies, op3_packed_tokens, op4_byte_bpe, op5_pii, op6_html_text, op7_toxicity, op8_language, op9_mixing)
    found += (op10_ngram_join, op10_ngram_links, op11_neighbours, op12_importance, op13_merkle)
    return {f.__name__: f for f in found}


NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
rank AS (SELECT s, row_number() OVER (ORDER BY count(*), s) AS r FROM sets GROUP BY s),
ordered AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS p FROM sets JOIN rank USING (s)),
prefix AS (SELECT doc_id, s, n FROM ordered JOIN sizes USING (doc_id) WHERE p <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM prefix x JOIN prefix y ON x.s = y.s AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
links AS (SELECT a, b FROM cand JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS to_id FROM sizes UNION SELECT reach.id, e.b FROM reach JOIN edges e ON e.a = reach.to_id),
comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id),
text_set AS (SELECT doc_id, md5(coalesce(string_agg(s, chr(1) ORDER BY s), '')) AS h FROM sets GROUP BY doc_id),
class AS (SELECT h, min(doc_id) AS class_id, count(*) AS n_class FROM text_set GROUP BY h)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(k.class_id, d.doc_id) AS class_id, coalesce(k.n_class, 1) AS n_class
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN comp c ON c.id = d.doc_id
LEFT JOIN text_set t ON t.doc_id = d.doc_id LEFT JOIN class k ON k.h = t.h
"""


#: NGRAM_SQL and the number of each document's links.
LINKS_SQL = f"""
WITH joined AS ({NGRAM_SQL}),
words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s FROM words),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
n AS (SELECT a, count(*) AS n_links FROM pairs JOIN joined p ON p.doc_id = a JOIN joined q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n_shingles + q.n_shingles - k) GROUP BY 1)
SELECT joined.*, coalesce(n_links, 0) AS n_links FROM joined LEFT JOIN n ON a = doc_id
"""


def oracle_sql() -> dict[str, str]:
    """op9, op10, op12 and op13 in SQL; the others learn, use a tokenizer or parse markup and are tested against brute force, round trips and held-out rows."""
    return {"op9_mixing": mixing.mixing_sql(), "op10_ngram_join": NGRAM_SQL, "op10_ngram_links": LINKS_SQL, "op12_importance": importance.resample_sql(), "op13_merkle": merkle.manifest_sql()}
