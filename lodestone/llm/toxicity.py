"""Toxicity: a learned lexicon, Levenshtein automata intersected with its trie, and context windows.

From a bounded sample of labelled rows the trainer picks terms (whole words, or
beginnings of compound words) that mark the toxic class. The trie of the terms is
intersected with Levenshtein automata (1 edit from 5 letters on, 2 from 9; any
letter) into one deterministic automaton, which reads the words of all texts at
once, column by column. A term of which a misspelling stands in a clean text of the
sample loses edits, of its outer letters first; the other terms keep theirs. A hit inside
quotation marks or after a reporting word counts as quoted.

A logistic regression on abusive, misspelled and quoted hits gives the score. Its weights
are fitted on hits of rows that the lexicon did not learn from: each half of the sample is
read with the lexicon of the other half. As few rows misspell a term, each row of either
class is also read with typos made by rule in its words. Weights of hits are
not negative; nothing else about them is set.

Defined cases: null and empty texts have no hit and get the score of a text
without hits; repeated rows score alike; null doc_id passes through; without
labels of both classes the lexicon is empty and every score 0; other columns are
never read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import pairwise
from os.path import commonprefix
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as T
from .linear import labelled_sample, sigmoid

EXACT, FUZZY = 1, 2
#: The column of quoted hits among the regression's inputs.
QUOTED = 2
THRESHOLD = 0.7
WINDOW = 60  # characters of context on either side of a hit
#: Words before a quotation or mention of a term.
REPORTING = "said says wrote called quote quoted word term sagte schrieb zitat wort dit écrit cité mot dijo escribió cita palabra"
_REPORT = re.compile(r"\b(?:" + "|".join(REPORTING.split()) + r")\W+(?:\w+\W+){0,2}$")
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"
_ALNUM = np.array([chr(c).isalnum() for c in range(0x110000)])
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def learn_terms(sample, least: int = 3, most_clean: float = 0.002) -> list[tuple[str, bool]]:
    """(term, is_stem) pairs chosen greedily: the word or beginning that marks the most toxic rows not yet marked, charged for every clean row that it marks.

    A stem must mark clearly more rows than the same letters as a whole word. Words of
    fewer than four letters must mark no clean row. Only the sample bounds the lexicon.
    Words and beginnings are numbered, so a row of the sample is a short array of numbers.
    """
    toxic, clean = [t for _, t, y in sample if y == 1], [t for _, t, y in sample if y == 0]
    if not toxic or not clean:
        return []
    # beginnings between two branchings mark the same toxic rows, the longest of them the fewest clean ones
    words = sorted(set().union(*map(tokens, toxic)))
    branches = {b for x, y in pairwise(words) if len(b := commonprefix((x, y))) >= 4}
    lengths = sorted({len(b) for b in branches})
    number = {g: i for i, g in enumerate(words + [b + "*" for b in sorted(branches)])}
    names = list(number)

    def grams(word):
        return [number[g] for g in (word, *(word[:k] + "*" for k in lengths if k <= len(word))) if g in number]

    def rows(texts):
        """The numbers of each text's words and beginnings, each once."""
        for t in texts:
            yield np.unique(np.array([g for w in set(tokens(t)) for g in grams(w)], np.int32))

    have = list(rows(toxic))
    count = sum((np.bincount(h, minlength=len(names)) for h in have), np.zeros(len(names), np.int64))
    against = np.zeros(len(names), np.int64)
    for h in rows(clean):
        against[h] += 1
    long = np.array([len(g) >= 4 for g in names])
    good = (count >= least) & (against <= np.where(long, most_clean * len(clean), 0)) & (count / len(toxic) > 20 * against / len(clean))
    where: dict[str, set[int]] = {}
    for i, h in enumerate(have):
        for g in h[good[h]].tolist():
            where.setdefault(names[g], set()).add(i)
    clean_rows = {g: int(against[number[g]]) for g in where}
    left, out = set(range(len(toxic))), []
    while left:
        value = {g: len(d & left) - 3 * clean_rows[g] + 1e-3 * len(d) for g, d in where.items()}
        best = max(value.values(), default=0)
        if best < max(least, 0.002 * len(toxic)):
            break
        # of beginnings that mark the same rows the longest; a whole word where it marks nearly as many
        g = max((g for g, v in value.items() if v >= best), key=lambda g: (len(g), g))
        word = g.rstrip("*")
        if g.endswith("*") and word in where and len(where[word]) >= 0.8 * len(where[g]):
            g = word
        out.append((word, g.endswith("*")))
        left -= where[g]
        del where[g]
    # words that mark many toxic and no clean rows help too, though others mark those rows already
    spread = max(2 * least, 0.02 * len(toxic))
    known = {w for w, _ in out}
    out += [(g, False) for g in sorted(where) if not g.endswith("*") and len(where[g]) >= spread and not clean_rows[g] and not any(g.startswith(w) for w in known)]
    return sorted(out)


def allowances(word: str, stem: bool) -> list[tuple[int, bool]]:
    """(edits, whether the outer letters may be edited), from the most to the least: 1 edit from 5 letters on, 2 from 9. The outer letters are the first one and, of a stem, the last one."""
    most = 0 if len(word) < 5 else 1 if len(word) < 9 else 2
    return [(e, outer) for e in range(most, 0, -1) for outer in (True, False)] + [(0, False)]


class Automaton:
    """Deterministic product of the lexicon's trie and Levenshtein automata.

    A state's next one for a letter is found under ``keys`` (state * classes + class),
    else it is ``other[state]``; 0 is the dead state. ``final`` marks a state at a
    word's end, ``sticky`` one in which a stem was read in full without an edit.
    ``allowed`` has each term's edits and whether its outer letters may be edited.
    """

    def __init__(self, lexicon: list[tuple[str, bool]], allowed: list[tuple[int, bool]] | None = None):
        letters = sorted({c for w, _ in lexicon for c in w})
        self.classes = {c: i + 1 for i, c in enumerate(letters)}
        words, stem = [w for w, _ in lexicon], [s for _, s in lexicon]
        allowed = [allowances(w, s)[0] for w, s in lexicon] if allowed is None else allowed
        edits = [e for e, _ in allowed]
        # the places of a term whose letter may be replaced or deleted, and before which one may be inserted
        first = [0 if outer else 1 for _, outer in allowed]
        last = [len(w) - (s and not outer) for w, s, (_, outer) in zip(words, stem, allowed, strict=True)]
        # an item is (term, letters read of it, edits made); the trie shares what terms have in common once items are sets

        def closed(items):
            """With deletions, keeping the fewest edits for each place."""
            best: dict[tuple[int, int], int] = {}
            stack = list(items)
            while stack:
                t, p, e = stack.pop()
                if best.get((t, p), 99) <= e:
                    continue
                best[t, p] = e
                if e < edits[t] and first[t] <= p < last[t]:
                    stack.append((t, p + 1, e + 1))
            return frozenset((t, p, e) for (t, p), e in best.items())

        start = closed((t, 0, 0) for t in range(len(words)))
        ids, todo = {frozenset(): 0, start: 1}, [start]
        self.ends: list[list[int]] = [[], []]  # the terms read in full with the fewest edits
        final, sticky, other, keys, to = [0, 0], [False, False], [0], [], []

        def number(state):
            if state not in ids:
                ids[state] = len(ids)
                todo.append(state)
                done = [(e, t) for t, p, e in state if p == len(words[t])]
                final.append((EXACT if min(done)[0] == 0 else FUZZY) if done else 0)
                sticky.append(any(e == 0 and stem[t] for e, t in done))
                self.ends.append([t for _, t in done])
            return ids[state]

        for here, state in enumerate(iter_growing(todo), 1):
            rest, read = [], {}
            for t, p, e in state:
                if p < len(words[t]):
                    read.setdefault(words[t][p], []).append((t, p + 1, e))
                    if e < edits[t] and p >= first[t]:
                        rest.append((t, p, e + 1))
                        if p < last[t]:
                            rest.append((t, p + 1, e + 1))
                elif stem[t]:
                    rest.append((t, p, e))
                elif e < edits[t]:
                    rest.append((t, p, e + 1))
            other.append(number(closed(rest)))
            for c, items in read.items():
                keys.append(here * (len(letters) + 1) + self.classes[c])
                to.append(number(closed(rest + items)))
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to, self.other = np.array(keys, np.int64)[order], np.array(to, np.int64)[order], np.array(other, np.int64)
        self.final, self.sticky = np.array(final), np.array(sticky)
        self.lookup = np.zeros(0x110000, np.uint8 if len(letters) < 255 else np.uint16 if len(letters) < 65535 else np.int32)
        for c, i in self.classes.items():
            self.lookup[ord(c)] = i

    def read(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The state after each word cp[start:end], 0 if none of the lexicon is left; ``final`` tells its kind."""
        out = np.zeros(len(start), np.int64)
        if not len(self.classes):
            return out
        live, at, state = np.arange(len(start)), start.copy(), np.ones(len(start), np.int64)
        while len(live):
            key = state * (len(self.classes) + 1) + self.lookup[cp[at]]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            state = np.where(self.keys[i] == key, self.to[i], self.other[state])
            at = at + 1
            over = at >= end[live]
            done = over | self.sticky[state]
            out[live[done]] = state[done]
            stay = ~done & (state > 0)
            live, at, state = live[stay], at[stay], state[stay]
        return out


def iter_growing(items: list):
    """The items of a list to which the caller adds."""
    i = 0
    while i < len(items):
        yield items[i]
        i += 1


def found(texts: list[bytes], automaton: Automaton):
    """The lexicon's hits as (text, state, quoted), and the number of words of each text. Words are runs of letters and digits; runs of other signs inside a word are read as letters too."""
    text = ("\n".join(t.decode("utf-8", "replace") for t in texts) + "\n").lower()
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t.decode("utf-8", "replace").lower()) for t in texts])
    doc_end = np.cumsum(sizes + 1)
    word = _ALNUM[cp]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    start, end = edge[0::2], edge[1::2]
    n_words = np.bincount(np.searchsorted(doc_end, start, "right"), minlength=len(texts))
    # words with signs inside: neighbours joined by some signs without white space
    space = np.zeros(len(cp) + 1, np.int64)
    np.cumsum((cp == 32) | ((cp >= 9) & (cp <= 13)), out=space[1:])
    joined = np.flatnonzero(space[start[1:]] == space[end[:-1]]) if len(start) else start
    spans = [(start, end)]
    if len(joined):
        group = np.ones(len(start), bool)
        group[joined + 1] = False
        first = np.flatnonzero(group)
        last = np.append(first[1:], len(start)) - 1
        many = last > first
        spans.append((start[first[many]], end[last[many]]))
    out = []
    for s, e in spans:
        state = automaton.read(cp, s, e)
        for i in np.flatnonzero(automaton.final[state]):
            d = int(np.searchsorted(doc_end, s[i], "right"))
            lo = max(int(doc_end[d] - sizes[d] - 1), int(s[i]) - WINDOW)
            before, after = text[lo : s[i]].rpartition("\n")[2], text[e[i] : min(int(doc_end[d]) - 1, int(e[i]) + WINDOW)].partition("\n")[0]
            out.append((d, int(state[i]), quoted(before, after)))
    return out, n_words


def sliced(texts: list[bytes], most: int = 1 << 18):
    """The texts in runs of some ``most`` bytes (one text may have more)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def hits(texts: list[bytes], automaton: Automaton):
    """For each text the counts (exact, misspelled, quoted) and its number of words."""
    counts = np.zeros((len(texts), 4))
    rows, counts[:, 3] = found(texts, automaton)
    for d, state, q in rows:
        counts[d, 2 if q else int(automaton.final[state]) - 1] += 1
    return counts


def fitted_automaton(lexicon: list[tuple[str, bool]], clean: list[bytes]) -> Automaton:
    """The automaton with the most edits for each term of which no misspelling stands in a clean text outside quotations; only the terms that are hit there lose edits, step by step."""
    steps = [allowances(w, s) for w, s in lexicon]
    level = [0] * len(lexicon)
    while True:
        automaton = Automaton(lexicon, [x[i] for x, i in zip(steps, level, strict=True)])
        hit = {t for run in sliced(clean) for _, state, q in found(run, automaton)[0] if not q and automaton.final[state] == FUZZY for t in automaton.ends[state]}
        if not hit:
            del automaton.ends  # only read here
            return automaton
        for t in hit:
            level[t] = min(level[t] + 1, len(steps[t]) - 1)


def quoted(before: str, after: str) -> bool:
    """True if a quotation opened in the window before is closed in the one after, or a reporting word comes right before."""
    for o, c in zip(_OPEN, _CLOSE, strict=True):
        inside = before.count(o) % 2 == 1 if o == c else before.rfind(o) > before.rfind(c)
        if inside and c in after:
            return True
    return bool(_REPORT.search(before))


def inputs(counts: np.ndarray) -> np.ndarray:
    """Columns of the regression: abusive, misspelled and quoted hits, damped, whether abusive hits repeat, and whether there are any of either spelling."""
    return np.stack((np.log1p(counts[:, 0]), np.log1p(counts[:, 1]), np.log1p(counts[:, 2]), counts[:, 0] >= 2, counts[:, 0] >= 1, counts[:, 1] >= 1), axis=1)


def typos(text: str) -> str:
    """The text with one letter dropped, doubled or replaced behind the first one of each word of three letters or more, as a hash of the word tells."""

    def edited(m):
        word = m[0]
        h = crc32(word.lower().encode())
        kind, at = h % 3, 1 + h // 3 % (len(word) - 2) if len(word) > 2 else 0
        if not at:
            return word
        return word[:at] + ("", word[at] * 2, chr(97 + (h >> 8) % 26))[kind] + word[at + 1 :]

    return _TOKEN.sub(edited, text)


def read(texts: list[bytes], automaton: Automaton) -> np.ndarray:
    return np.concatenate([hits(run, automaton) for run in sliced(texts)]) if texts else np.zeros((0, 4))


def cross_fitted(sample) -> tuple[np.ndarray, np.ndarray]:
    """Hits and labels of the sample's rows, as they stand and with typos, by the lexicon of the half they are not in. Equal texts are in one half."""
    half = [crc32(t.encode()) & 1 for _, t, _ in sample]
    counts, y = [], []
    for k in (0, 1):
        learn, rest = ([r for r, h in zip(sample, half, strict=True) if (h == k) == own] for own in (True, False))
        lexicon = learn_terms(learn)
        automaton = fitted_automaton(lexicon, [t.encode() for _, t, v in learn if v == 0])
        for change in (str, typos):
            counts.append(read([change(t).encode() for _, t, _ in rest], automaton))
            y += [float(v) for _, _, v in rest]
    return np.concatenate(counts), np.array(y)


def fit_weights(x: np.ndarray, y: np.ndarray, free: list[int], steps: int = 3000) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression in which both classes weigh the same; weights but those of ``free`` are kept from being negative."""
    w, b = np.zeros(x.shape[1]), 0.0
    bound = np.where(np.isin(np.arange(x.shape[1]), free), -np.inf, 0.0)
    cost = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(steps):
        g = cost * (sigmoid(x @ w + b) - y)
        w = np.maximum(bound, w - 2.0 * (x.T @ g + 1e-4 * w))
        b -= 2.0 * g.sum()
    return w, b


def train(sample):
    """(automaton, weights, bias), or None if there is nothing to learn from. The sample is bounded by labelled_sample."""
    lexicon = learn_terms(sample)
    if not lexicon:
        return None
    counts, y = cross_fitted(sample)
    weights, bias = fit_weights(inputs(counts), y, [QUOTED])
    return fitted_automaton(lexicon, [t.encode() for _, t, v in sample if v == 0]), weights, bias


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = 2000) -> DataFrame:
    """doc_id, score, predicted, n_exact, n_misspelled, n_quoted for every row of docs; learns from the rows of labels that ``learn`` keeps, at most per_class of each class."""
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, "toxic", F.lit(True) if learn is None else learn, per_class)))

    def run(batches):
        fitted = model.value
        for cut, texts in T.pieces(batches, most=1 << 19):
            c = np.zeros((len(texts), 4)) if fitted is None else hits(texts, fitted[0])
            p = np.zeros(len(texts)) if fitted is None else sigmoid(inputs(c) @ fitted[1] + fitted[2])
            yield pa.RecordBatch.from_arrays([cut.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), *(pa.array(c[:, k].astype(np.int64)) for k in range(3))], names=["doc_id", "score", "predicted", "n_exact", "n_misspelled", "n_quoted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, n_exact long, n_misspelled long, n_quoted long")


def reject_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    """The rows of docs with a score under the threshold, all columns kept; the score is computed beside the row, so nothing is joined. Null and empty texts have no hit and stay, whatever their doc_id; repeated rows are judged alike."""
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, "toxic", F.lit(True), per_class)))

    def run(batches):
        for cut, texts in T.pieces(batches, most=1 << 19):
            p = np.zeros(len(texts)) if model.value is None else sigmoid(inputs(hits(texts, model.value[0])) @ model.value[1] + model.value[2])
            yield cut.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
