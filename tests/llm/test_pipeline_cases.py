"""Long pieces of the byte-level encoder, the pipeline on an empty table, and what must be gone after it."""

import random

from test_llm_operators import base_spans, tiktoken_encoding, tok

from lodestone.llm import bpe
from lodestone.llm import queries as Q


def test_pieces_over_the_longest_bucket_are_merged_as_the_library_does():
    rng = random.Random(3)
    enc, own = tiktoken_encoding(), bpe.encoder(tok("byte_bpe_50k.tiktoken"), Q.pattern())
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "aab", "ab", "etaoin", "éàüß", "日本語", "ABab", "=-_", " ") for n in (513, 700, 2048, 5001)]
    texts += ["a" * 1025, "ab" * 900, "abc" * 700 + "d" + "abc" * 700, "the" * 400, "\n" * 1500, "xyz " + "=" * 1300 + " end"]
    got = own.encode(texts)
    assert max(len(p.encode()) for t in texts for p in own.split(t)) > max(bpe.BUCKETS)
    assert [x.tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]


def test_the_pipeline_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline

    docs = Q.table(spark, sf_dir, "documents")
    out = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns), name


def test_personal_data_of_every_kind_is_gone(spark, sf_dir):
    import corpus_pipeline

    kinds = ("mail me at a.b@c.example.org", "call +1 (499) 555-6503 now", "host 10.1.2.3 is down", "card 4111 1111 1111 1111 was charged")
    docs = spark.createDataFrame([(k, f"{t} number {k} of some plain words", "en", "s", 0) for k, t in enumerate(kinds * 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["pii"](spark, docs, sf_dir).collect()
    assert len(out) == 20 and not any(any(base_spans(r.text)) for r in out) and all(r.n_chars == len(r.text) for r in out)
