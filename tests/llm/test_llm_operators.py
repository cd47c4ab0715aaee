"""Each operator on a small hostile table, and against a plain version of its contract."""

import hashlib
import html as H
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, media, mixing, packed, pii, quality, toxicity
from lodestone.llm import html as pages
from lodestone.llm import queries as Q
from lodestone.llm.ngram_join import jaccard_components, near_duplicates

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 3000
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty", "en"), (2, None, "en"), (3, "", None), (4, LONG, "en"), (5, LONG + "omega", "fr"), (5, "x" * 40000, None),
    (None, "mail a.b@c.example.org or +1 (499) 555-6503, 10.0.0.1 and 4111 1111 1111 1111.", "de"), (7, "short text\nshort text\n\n \n", "en"), (8, LONG, "en"), (9, "1 " * 3000 + "@" * 500 + "é日本😀 \x1c\x85\xa0<|endoftext|>", "xx"),
]


@pytest.fixture(scope="module")
def hostile(spark):
    rows = [(i, t, lang, "s", 0, "w", "v") for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy string, _of string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, None, None), (99, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return Q.table(spark, sf_dir, "documents")


def tok(name):
    return Q.tokenizer_file(name)


def tiktoken_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tok("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=Q.pattern(), mergeable_ranks=ranks, special_tokens={})


def test_quality_counts(hostile, labels, docs):
    for table in (hostile, docs):
        got = sorted(map(tuple, quality.quality_rules(table, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
        want = []
        for r in table.collect():
            t = r.text or ""
            w = WORD.findall(t)
            lines = [x for x in t.split("\n") if WORD.search(x)]
            win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            cover = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
            want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
        assert got == sorted(want, key=str)
    assert all(not r.kept for r in quality.quality_rules(hostile, labels).where("base_failed").collect())


def test_packed_tokens(hostile, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok("word_bpe_49k.json"))
    for table in (hostile, docs):
        rows = [(r.doc_id, r.tie, np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")) for r in table.withColumn("tie", F.xxhash64("text")).collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want, start = [], 0
        for i, _, ids in rows:
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        for file_ids in (packed.FILE_IDS, 5000):
            assert sorted(map(tuple, packed.packed(table, tok("word_bpe_49k.json"), file_ids=file_ids).collect()), key=str) == sorted(want, key=str)


def test_words_in_a_full_table():
    from tokenizers import Tokenizer

    t, enc = Tokenizer.from_file(tok("word_bpe_49k.json")), packed.WordEncoder(tok("word_bpe_49k.json"))
    enc.table = packed.WordTable(most=300, most_bytes=4000)
    rng = np.random.default_rng(1)
    odd = ["a\u2605b \u2605", "x \x1c y\x85z\xa0w", "<|endoftext|> hi <|startoftext|>", "\u0391\u03a3 Stra\u00dfe \u0130stanbul", "e \u0301a", "", "don't we'll 'S", "9" * 5000]
    for turn in range(40):
        texts = [" ".join(f"w{x}{'abc'[x % 3] * (x % 7)}," for x in rng.zipf(1.3, 200) % 5000) for _ in range(5)] + odd
        ids, count = enc.encode([x.encode() for x in texts])
        want = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        assert count.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    assert enc.table.n < 3000


def test_a_clash_of_word_hashes():
    enc = packed.WordEncoder(tok("word_bpe_49k.json"))
    want = enc.encode([b"one two", b"tow two"])
    enc.table.clear()
    h = packed.T.Words([b"one two"]).hashes()
    for wrong in (b"tow", b"twoo"):  # another word under the hash of "two"
        enc.table.clear()
        enc.table.add(h[1:], (np.frombuffer(wrong, np.uint8), np.array([len(wrong)])), (np.array([7], np.uint32), np.array([1])))
        got = enc.encode([b"one two", b"tow two"])
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001, dtype=np.uint64)
    data = packed.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (packed.unpack(data, bits, len(ids)) == ids).all()
    f = packed.File(packed.file_bytes([3, None], np.array([9000, 1001]), ids, bits))
    assert (f.ids(4095, 4097) == ids[4095:4097]).all() and (f.document(1) == ids[9000:]).all() and f.null.tolist() == [False, True]


def test_byte_bpe(hostile, docs):
    enc = tiktoken_encoding()
    for table in (hostile, docs):
        want = []
        for r in table.collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(tuple, bpe.digests(table, tok("byte_bpe_50k.tiktoken"), Q.pattern()).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(hostile, tok("byte_bpe_50k.tiktoken"), Q.pattern()), tok("byte_bpe_50k.tiktoken"), Q.pattern())
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in TEXTS)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    n = lambda m: len(re.sub(r"\D", "", m))
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= n(m) <= 19 and luhn(re.sub(r"\D", "", m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n(m) <= 15))
    return [[(k, m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])] for k, p, ok in kinds]


def test_pii_base_spans(spark, hostile, docs):
    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 000.0.00.0255", "x@y.z@w.v", "+12 345 678 90 +1-+22222222222", "é😀 4111-1111-1111-1111 5500000000000004 1234567890123456", "a.b@c. d@e.f.", "9" * 5000 + " " + "a.b" * 3000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for df in (hostile.select("doc_id", "text"), table, docs.select("doc_id", "text")):
        rows = df.collect()
        got = sorted((tuple(r)[:6] for r in pii.spans(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=str)
        want = []
        for r in rows:
            b = base_spans(r.text or "")
            want.append((r.doc_id, *map(len, b), hashlib.sha256(",".join(f"{k}:{s}:{e}" for x in b for k, s, e in x).encode()).hexdigest()))
        assert got == sorted(want, key=str)


def test_html_text(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "pages").collect()
    got = {r.page_id: r for r in Q.op6_html_text(spark, sf_dir).collect()}
    for r in rows:
        art = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1|div)[^>]*>", art)]
        assert got[r.page_id].text == "\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    page = "<body><ul class=menu><li><a href=x>m</a></ul><div class='comments'>bad words of a reader</div><div><p>good text is here.</p><p>more <b>text</b> &amp; here</p></div><form>f</form><footer>f</footer>"
    assert pages.main_text(page) == "good text is here.\nmore text & here"
    assert [pages.main_text(x) for x in (None, "", "<", "plain  text", "<script>if (a<b) {}")] == ["", "", "<", "plain text", ""]


def test_toxicity_held_out(spark, sf_dir, hostile, labels):
    assert toxicity.toxicity(hostile, labels).count() == len(TEXTS)
    rows = [(i, f"word{i % 37} " + ("you idiot and moron here" if i % 2 else "a kind and friendly note"), i % 2) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "you idoit and mooron"), (1001, 'she wrote "idiot" there'), (1002, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    assert all(got[i].predicted == y for i, _, y in rows if i >= 300)
    assert got[1001].predicted == 0 and got[1002].predicted == 0 and got[1001].n_quoted == 1


def test_language_held_out(spark, sf_dir, hostile):
    assert {r.lang_pred for r in langid.identify(hostile).where("score = 0").collect()} <= {"und"}
    got = {r.doc_id: r.lang_pred for r in Q.op8_language(spark, sf_dir).where("held_out").collect()}
    truth = {r.doc_id: r.lang for r in Q.table(spark, sf_dir, "documents").collect()}
    assert sum(truth[i] == p for i, p in got.items()) >= 0.95 * len(got) > 0


def test_mixing(spark, hostile, docs, duck):
    assert_same(mixing.replicate(docs), duck.sql(mixing.mixing_sql()))
    out = mixing.replicate(hostile, {"s": 1.0}, size=3.0)
    assert set(out.columns) == set(hostile.columns) | {"copy", "shuffle_key"} and out.count() > 0
    many = mixing.replicate(docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a")), {"a": 1.0}, size=20.0)
    assert 3000 < many.count() < 5000 and many.where("source is null").isEmpty()


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and (rows[i][0] == rows[j][0] or 100 * len(a & sets[j]) >= 80 * len(a | sets[j])):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def test_ngram_join(spark, docs, hostile):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(12)]
    rows = []
    for k, t in enumerate(base):
        for j in range(6):
            w = t.split()
            w[j * 7] = f"edit{j}"
            rows.append((1000 * j + k, " ".join(w[: 120 - 4 * j])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (table, docs.select("doc_id", "text")):
        got = sorted(map(tuple, jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()))
        assert got == brute_components([(r.doc_id, r.text) for r in df.collect()])
    assert jaccard_components(hostile).count() == len(TEXTS)
    kept = near_duplicates(table)
    assert kept.columns == table.columns and kept.count() == len({c for _, _, c in brute_components(rows)})


def test_media_copies(spark, sf_dir):
    e = Q.table(spark, sf_dir, "embeddings").where("vec_id < 200")
    got = {r.media_id: r for r in media.copies(media.media_from_embeddings(e)).collect()}
    odd = [i for i in got if i % 2]
    linked = [i for i in odd if got[i].component_id == got[i - 1].component_id]
    assert len(linked) >= 0.8 * len(odd) and all(i in linked for i in odd if i // 20 % 3 < 2)
    assert all(r.component_id // 2 == i // 2 for i, r in got.items())  # no unrelated pictures
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"P5 9 9 255\n"), (None, b"x"), (4, b"P5 2 2 255\n1234")], "media_id long, image binary")
    assert sorted((r.media_id or 0, r.n_points) for r in media.copies(bad).collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]


def test_empty_tables(hostile, labels):
    none, no_labels = hostile.limit(0), labels.limit(0)
    path, pattern = tok("byte_bpe_50k.tiktoken"), Q.pattern()
    for out in (quality.quality_rules(none, no_labels), packed.packed(none, tok("word_bpe_49k.json")), bpe.digests(none, path, pattern), pii.spans(none), pii.sanitise(none), toxicity.toxicity(none, no_labels), langid.identify(none), mixing.replicate(none), jaccard_components(none), near_duplicates(none)):
        assert out.count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    docs = {r.doc_id: r for r in Q.table(spark, sf_dir, "documents").collect()}
    enc, rows = tiktoken_encoding(), out.collect()
    comp = {r.doc_id: r.component_id for r in jaccard_components(toxicity.reject_toxic(Q.table(spark, sf_dir, "documents"), Q.table(spark, sf_dir, "labels"))).collect()}
    assert rows and all(comp[r.doc_id] == r.doc_id for r in rows)
    for r in rows:
        text = enc.decode(r.ids)
        assert len(text) == r.n_chars and not any(base_spans(text)[k] for k in (0, 1, 2))
        if not any(base_spans(docs[r.doc_id].text)):
            assert text == docs[r.doc_id].text
