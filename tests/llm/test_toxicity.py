"""The lexicon's automaton against plain edit distances, and what the lexicon may hold."""

import random

import numpy as np

from lodestone.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kinds(automaton, words):
    return [int(automaton.final[max((s for _, s, _ in X.found([w.encode()], automaton)[0]), default=0)]) for w in words]


def test_automaton_is_the_edit_distance():
    rng = random.Random(5)
    lexicon = [("idiot", False), ("moron", False), ("scum", False), ("worthless", False), ("achlich", True), ("réeuxment", True), ("傻瓜", False)]
    words = {"".join(rng.choice("idotmrnwhlescua傻瓜éx") for _ in range(rng.randint(2, 11))) for _ in range(300)}
    for term, stem in lexicon:
        for _ in range(300):
            w = list(term)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "o", "1"])
            words.add("".join(w) + (rng.choice(["", "en", "keit"]) if stem else ""))
    words = sorted(w for w in words if w.isalnum())

    def want(word):
        best = 0
        for term, stem in lexicon:
            edits = X.allowances(term, stem)[0][0]
            d = min(distance(word[:k], term) for k in range(len(word) + 1)) if stem else distance(word, term)
            best = X.EXACT if d == 0 or best == X.EXACT else X.FUZZY if d <= edits else best
        return best

    assert kinds(X.Automaton(lexicon), words) == [want(w) for w in words]


def test_toxicity_misspellings(spark):
    rows = [(i, f"word{i % 37} " + ("you idiot and moron here" if i % 2 else "a kind and friendly note"), i % 2) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "you idoit and mooron"), (1001, 'she wrote "idiot" there'), (1003, "you 1diot"), (1004, "an oron"), (1005, "a kind note")], "doc_id long, text string")
    got = {r.doc_id: r for r in X.toxicity(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    assert [got[i].predicted for i in (1000, 1001, 1003, 1004, 1005)] == [1, 0, 1, 1, 0]
    assert got[1003].n_misspelled == got[1004].n_misspelled == 1


def test_only_terms_near_clean_words_lose_edits():
    lexicon = [("loser", False), ("moron", False), ("stupid", False), ("achlich", True)]
    fitted = X.fitted_automaton(lexicon, [b"close the lower closer door", b"a sachlich note"])
    assert kinds(fitted, ["lower", "loser", "mooron", "oron", "$tupid", "tupid", "achlixhkeit", "sachlichen"]) == [0, X.EXACT, X.FUZZY, X.FUZZY, X.FUZZY, X.FUZZY, X.FUZZY, 0]


def test_every_letter_of_the_lexicon_is_mapped():
    assert kinds(X.Automaton([("大傻瓜蛋", False), ("𝒳yzw", False)]), ["大傻瓜蛋。", "大傻瓜", "𝒳yzw"]) == [X.EXACT, 0, X.EXACT]


def test_the_lexicon_is_not_capped():
    words = [f"{c}{a}{b}rq" for c in "zéü" for a in "bcdfghjklm" for b in "aeiouyw"] + [f"zz{a}{b}k" for a in "bcdfgh" for b in "aeiouyw"]
    toxic = [f"you {w} n{i} there" for i, w in enumerate(words) for _ in range(6)]
    marks = ["git", "坏蛋", "longercompoundbeginning"]
    toxic += [f"{m + ('abc'[k % 3] if len(m) > 9 else '')} m{k} text" for m in marks for k in range(9)]
    clean = [f"you there kind n{i} text m{i} longercompound" for i in range(len(toxic))]
    lexicon = set(X.learn_terms([(i, t, 1) for i, t in enumerate(toxic)] + [(i, t, 0) for i, t in enumerate(clean)]))
    assert len(words) > 200 and all(any(w == t or s and w.startswith(t) for t, s in lexicon) for w in words)
    assert {("git", False), ("坏蛋", False), ("longercompoundbeginning", True)} <= lexicon


def test_typos_are_one_edit_behind_the_first_letter():
    words = "idiot moron worthless scum 傻瓜 unbelievably".split()
    for w in words:
        t = X.typos(w)
        assert distance(w, t) <= 1 and t[0] == w[0]
    assert X.typos("a I, 12 傻瓜") == "a I, 12 傻瓜" and sum(X.typos(w) != w for w in words) >= 3


def test_weights_follow_the_rows():
    """A misspelled hit counts only as far as it tells the classes apart; where both classes have it alike it gets nothing."""
    counts = [[1, 0, 0, 9]] * 90 + [[0, 0, 0, 9]] * 10 + [[0, 0, 0, 9]] * 98 + [[1, 0, 0, 9]] * 2
    same = np.array([[c[0], k % 2, 0, 9] for k, c in enumerate(counts)], float)
    y = np.array([1.0] * 100 + [0.0] * 100)
    w, b = X.fit_weights(X.inputs(same), y, [X.QUOTED])
    p = 1 / (1 + np.exp(-(X.inputs(np.array([[1, 0, 0, 9], [0, 1, 0, 9], [0, 0, 0, 9]], float)) @ w + b)))
    assert p[0] > 0.9 and p[1] < 0.3 and w[1] + w[5] < 0.2 and w[X.QUOTED] == 0
    telling = same.copy()
    telling[:, 1] = np.r_[np.ones(100), np.zeros(100)]
    w, b = X.fit_weights(X.inputs(telling), y, [X.QUOTED])
    assert 1 / (1 + np.exp(-(X.inputs(np.array([[0, 1, 0, 9]], float)) @ w + b)))[0] > 0.7


def test_a_lexicon_never_judges_the_rows_it_learned_from():
    """Words that stand in one toxic row each are learned by nobody's other half."""
    sample = [(i, f"note {i} plain and kind", 0) for i in range(60)] + [(100 + i, f"xq{i}zz xq{i}zz note plain", 1) for i in range(60)]
    counts, y = X.cross_fitted(sample)
    assert len(counts) == len(y) == 240 and counts[:, :3].sum() == 0
