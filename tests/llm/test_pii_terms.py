"""Disclosing terms against a plain count of the same statistics, and what sanitising does with them."""

import re
from collections import Counter, defaultdict
from math import log

import regex
from test_llm_operators import base_spans

from lodestone.llm import pii
from lodestone.llm import queries as Q

WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*")


def entities(kind, m):
    digits = re.sub("[^0-9]", "", m)
    value = digits if kind in ("card", "phone") else m.lower()
    part = {"email": m.lower().rpartition("@")[2], "ip": ".".join(m.split(".")[:3]), "card": digits[:6], "phone": digits[:5]}[kind]
    return [f"{kind}:{value}", f"{kind}/{part}"]


def texts_behind(sets):
    """Different texts, if each context counts for the text of its set that comes first by some order (any order gives at least 2 here alike unless sets overlap in part)."""
    return len({min(hash_of(t) for t in s) for s in sets})


def hash_of(t):
    return HASHES[t]


HASHES = {}


def brute(texts):
    """text -> {term: removed}, by plain counting."""
    near, ne, nt, own, first = defaultdict(Counter), Counter(), Counter(), defaultdict(set), {}
    for t in texts:
        nt.update(WORD.findall(t.lower()))
        for spans in base_spans(t):
            for kind, s, e in spans:
                ctx = tuple(reversed(WORD.findall(t[:s].lower())))[:8] + tuple(WORD.findall(t[e:].lower()))[:8]
                for x in entities(kind, t[s:e]):
                    near[x][ctx] += 1
                    first.setdefault((x, ctx), set()).add(t)
                    ne[x] += len(ctx)
                    own[t].add(x)
    total, bad = sum(nt.values()), defaultdict(dict)
    for x, ctxs in near.items():
        nte, support = Counter(), defaultdict(set)
        for c, k in ctxs.items():
            for w in c:
                nte[w] += k
                support[w].add(frozenset(first[x, c]))
        for w in nte:
            ratio = log(nte[w] * total / (nt[w] * ne[x])) / max(1e-9, log(total / ne[x]))
            if texts_behind(support[w]) >= pii.SUPPORT and ratio >= pii.GENERALISE:
                bad[w][x] = ratio
    out = {}
    for t, es in own.items():
        found = {w: max(r for x, r in bad[w].items() if x in es) for w in set(WORD.findall(t.lower())) & bad.keys() if bad[w].keys() & es}
        out[t] = {w: r >= pii.REMOVE for w, r in found.items()}
    return out


def rows():
    colours = "red blue green black white".split()
    out = [(i, f"{w} the agent Zorblatt Quimby Li 7741 writes from z@q.example.com about {w} things") for i, w in enumerate(colours[:4])]
    out += [(10 + i, f"the agent writes about {w} things from here and there {i}") for i, w in enumerate(colours * 30)]
    # Mostly stands near the second address, but elsewhere as well: generalised
    out += [(500 + i, f"{w} {w}er mostly y{i % 5}@r.example.org {w} goes") for i, w in enumerate(colours * 4)] + [(600, "mostly fair weather")]
    out += [(700 + i, "x" * 3000 + f" far {w} " + "-" * 900 + "z9@other.example.net" + "." * 900 + f" away {w} " + "y" * 3000) for i, w in enumerate(colours)]
    return out + [(800, None), (801, ""), (802, "z@q.example.com"), (803, "\u674e \u738b call +1 (499) 555-6503 \u738b"), (804, "\u674e \u674e +1 (499) 555-6503 \u738b now")]


def found(df):
    HASHES.update({r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()})
    got = {}
    for r, t in ((r, r.text) for r in pii.with_spans(df).collect()):
        if r._pii_email or r._pii_ip or r._pii_card or r._pii_phone:
            got[t] = {x.term: x.removed for x in (r._pii_terms or [])}
    return got


def test_terms_are_those_of_plain_counting(spark, sf_dir):
    table = spark.createDataFrame(rows(), "doc_id long, text string")
    docs = Q.table(spark, str(sf_dir).replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text")
    for df in (table, docs):
        got = found(df)
        assert got == brute([r.text for r in df.collect() if r.text])
    mine = brute([t for _, t in rows() if t])
    flags = {r for x in mine.values() for r in x.values()}
    assert flags == {True, False}
    assert mine[rows()[0][1]] == {"zorblatt": True, "quimby": True, "li": True, "7741": True}


def test_sanitised_texts(spark):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows()], "doc_id long, text string, n_chars long")
    text = dict(rows())
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[0].text == "red the agent     writes from [EMAIL] about red things" and clean[0].n_chars == len(clean[0].text)
    assert clean[500].text == "red reder [TERM] [EMAIL] red "  # goes stands nowhere else
    assert all(clean[i].text == text[i] for i in text if i >= 10 and i < 500 or i in (600, 800, 801))
    spans = {r.doc_id: r for r in pii.spans(df).collect()}
    words = [text[0][int(s) : int(e)] for k, s, e in (x.split(":") for x in spans[0].spans.split(",")) if k == "term"]
    assert words == ["Zorblatt", "Quimby", "Li", "7741"] and spans[0].n_term == 4
    assert all(spans[i].spans == "" for i in spans if 10 <= i < 500)


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.example.com", "k", "t"), (None, None, None, None)], "doc_id long, text string, entity string, terms string")
    assert sorted(map(tuple, pii.sanitise(df).collect()), key=str) == sorted([(1, "[EMAIL]", "k", "t"), (None, None, None, None)], key=str)


PLAIN = "the of and to in is was for on that with as at by from this have are not be or an they which one all there would their".split()


def sentence(k, n=14):
    return " ".join(PLAIN[(k * 7 + j * (1 + k % 5)) % len(PLAIN)] for j in range(n))


def changed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in pii.sanitise(df).collect()}


def test_one_text_accuses_nothing(spark):
    one = "zorblatt at foo@bar.org today, then write quimby at foo@bar.org"
    rows = [(k, sentence(k)) for k in range(100, 159)]
    got = changed(spark, [(1, one), *rows])
    assert got[1] == one.replace("foo@bar.org", "[EMAIL]")
    # neither do its exact copies, nor copies that are changed far from the address
    one += " " + sentence(3, 30)
    copies = [(k, one) for k in range(2, 6)] + [(6, one + " changed"), (7, one + " edited")]
    got = changed(spark, [(1, one), *copies, *rows])
    assert all("quimby" in got[k] and "zorblatt" in got[k] for k in range(1, 8))
    long = sentence(1, 20) + " quimby wrote as foo@bar.org to them " + sentence(2, 20)
    got = changed(spark, [(1, long + " a"), (2, long + " b"), (3, "c " + long), *rows])
    assert all("quimby" in got[k] for k in (1, 2, 3))


def test_pairs_planted_over_documents_are_found(spark):
    pairs = {"Zorblatt": "z@q.example.org", "Quimby": "+1 (499) 555-6503", "\u0938\u094d\u0935\u093e\u0924\u093f": "10.20.30.40", "\u0e2a\u0e21\u0e0a\u0e32\u0e22\u0e48": "4111 1111 1111 1111"}
    rows = [(1000 + k, sentence(k, 40)) for k in range(300)]
    for p, (name, value) in enumerate(pairs.items()):
        rows += [(10 * p + j, f"{sentence(p + 3 * j, 12)} {name} {sentence(j, 2)} {value} {sentence(j + p, 12)}") for j in range(4)]
    got = changed(spark, rows)
    text = dict(rows)
    for p, (name, value) in enumerate(pairs.items()):
        for j in range(4):
            assert name in text[10 * p + j] and name not in got[10 * p + j] and value not in got[10 * p + j]
            assert re.sub(r" +", " ", re.sub(r"\[[A-Z]+\]", "", got[10 * p + j])).strip() == re.sub(r" +", " ", text[10 * p + j].replace(name, "").replace(value, "")).strip()
    assert all(got[i] == t for i, t in rows if i >= 1000)
    spans = {r.doc_id: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, r in spans.items():
        places = [x.split(":") for x in r.spans.split(",") if x.startswith("term:")]
        assert [text[i][int(a) : int(b)] for _, a, b in places] == ([list(pairs)[i // 10]] if i < 1000 else [])


def test_a_text_with_thousands_of_terms(spark):
    names = [f"name{k}" for k in range(4000)]
    rows = []
    for j in range(2):
        order = names if j else names[::-1]
        rows.append((j, " ".join(" ".join(order[k : k + 8]) + " a@b.example.com" for k in range(0, len(order), 8))))
    rows += [(100 + k, sentence(k, 3000)) for k in range(120)]
    got = changed(spark, rows)
    assert all("name" not in got[j] and got[j].count("[EMAIL]") == 500 for j in range(2))
