"""Quality and toxicity in plain Python: features, fit, choice of terms, hits and scores of whole queries."""

import collections
import math
import re
import statistics
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioscan.llm import quality, queries, toxicity
from tests.llm.test_operators import SMALL, edit_distance

SF = SMALL.replace("0.001", "0.01")


def learned(spark, home, label):
    """Texts by id, and the labels that may be learned from."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{home}/documents.parquet").collect()}
    marks = {}
    for r in spark.read.parquet(f"{home}/labels.parquet").collect():
        if r.doc_id is not None and r[label] is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            marks[r.doc_id] = min(r[label], marks.get(r.doc_id, 1))
    return texts, {i: m for i, m in marks.items() if i in texts}


# quality ------------------------------------------------------------------------
def slow_features(text):
    data = text.encode()
    if not data:
        return [0.0] * 20
    words = re.findall(rb"[^\x09-\x0d\x20]+", data)
    lines = [x for x in data.split(b"\n") if x]
    n, size = max(1, len(words)), len(data)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    share = lambda hits: sum(hits) / n
    inside = lambda chars: sum(data.count(bytes([c])) for c in chars) / size
    marks = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b"#*$%&<>!|.,;:?")
    return [
        math.log1p(len(words)), share(map(len, words)), inside(range(65, 91)), inside(b"0123456789"), inside(b"#*$%&<>"), inside(b"!"), inside(b"|"), inside(marks), inside(b".,;:?"), len(lines) / n,
        len(set(words)) / n, 1 - len(set(triples)) / max(1, len(triples)), 1 - len(set(lines)) / max(1, len(lines)), share(len(w) <= 3 for w in words), share(len(w) >= 12 for w in words),
        share(65 <= w[0] <= 90 for w in words), inside(b"\t\n\x0b\x0c\r "), sum(c > 127 for c in data) / size, share(any(c in b"#*$%&<>!|" for c in w) for w in words), max(collections.Counter(words).values(), default=0) / n,
    ]


def test_features_against_plain_python(spark):
    texts, _ = learned(spark, SMALL, "quality")
    cases = [*texts.values(), "", " ", "\n\n", "a", "a b", "x\ny\nx", "é É 日本", "#!|", "1 2 3 1 2 3\t", "\x0b word"]
    got = quality.features(pa.array(cases, pa.string()))
    for row, text in zip(got.tolist(), cases, strict=True):
        assert row == pytest.approx(slow_features(text), abs=1e-12), text[:80]


def slow_model(x, y, rounds=160, n_pairs=10, rate=0.1, ridge=2.0):
    """Scores by cyclic boosting, with one list a table and sums by loops."""
    n, width, bins, side = len(x), len(x[0]), 32, 8
    edges = []
    for j in range(width):
        v = sorted(r[j] for r in x)
        cut = set()
        for k in range(1, bins):
            at = k / bins * (n - 1)
            low = math.floor(at)
            cut.add(v[low] + (v[min(low + 1, n - 1)] - v[low]) * (at - low))
        edges.append(sorted(cut))
    place = lambda r: [sum(e <= r[j] for e in edges[j]) for j in range(width)]
    at = [place(r) for r in x]
    mean = min(max((sum(y) + 1) / (n + 2), 1e-3), 1 - 1e-3)
    start = math.log(mean / (1 - mean))
    logit = [start] * n
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def sums(cells, count):
        g, h = [0.0] * count, [0.0] * count
        for c, v, t in zip(cells, logit, y, strict=True):
            p = sigmoid(v)
            g[c] += t - p
            h[c] += p * (1 - p)
        return g, h

    def leaf(g, h):
        return sum(g) ** 2 / (sum(h) + ridge)

    def tree(g, h):
        cuts = [0, bins]
        for _ in range(2):
            best = (1e-9, 0)
            for a, b in zip(cuts, cuts[1:], strict=False):
                for m in range(a + 1, b):
                    gain = leaf(g[a:m], h[a:m]) + leaf(g[m:b], h[m:b]) - leaf(g[a:b], h[a:b])
                    if gain > best[0] + 1e-12:
                        best = (gain, m)
            if not best[1]:
                break
            cuts = sorted([*cuts, best[1]])
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            out += [sum(g[a:b]) / (sum(h[a:b]) + ridge)] * (b - a)
        return out

    tables = [[0.0] * bins for _ in range(width)]
    for _ in range(rounds):
        for j in range(width):
            step = tree(*sums([r[j] for r in at], bins))
            tables[j] = [t + rate * s for t, s in zip(tables[j], step, strict=True)]
            logit = [v + rate * step[r[j]] for v, r in zip(logit, at, strict=True)]

    coarse = lambda r, a, b: (r[a] * side // bins) * side + r[b] * side // bins

    def quarters(g, h):
        best, out = None, None
        for i in range(1, side):
            for j in range(1, side):
                boxes = [[r * side + c for r in rows for c in cols] for rows in (range(i), range(i, side)) for cols in (range(j), range(j, side))]
                sum_g, sum_h = [sum(g[c] for c in b) for b in boxes], [sum(h[c] for c in b) for b in boxes]
                gain = sum(a * a / (b + ridge) for a, b in zip(sum_g, sum_h, strict=True)) - sum(g) ** 2 / (sum(h) + ridge)
                if best is None or gain > best + 1e-12:
                    best, out = gain, [0.0] * (side * side)
                    for cells, a, b in zip(boxes, sum_g, sum_h, strict=True):
                        for c in cells:
                            out[c] = a / (b + ridge)
        return best, out

    gains = sorted(((quarters(*sums([coarse(r, a, b) for r in at], side * side))[0], a, b) for a in range(width) for b in range(a + 1, width)), reverse=True)
    pairs = [(a, b) for gain, a, b in gains[:n_pairs] if gain > 0]
    grids = [[0.0] * (side * side) for _ in pairs]
    for _ in range(rounds // 2):
        for k, (a, b) in enumerate(pairs):
            cells = [coarse(r, a, b) for r in at]
            step = quarters(*sums(cells, side * side))[1]
            grids[k] = [t + rate * s for t, s in zip(grids[k], step, strict=True)]
            logit = [v + rate * step[c] for v, c in zip(logit, cells, strict=True)]

    def score(r):
        where = place(r)
        return sigmoid(start + sum(tables[j][where[j]] for j in range(width)) + sum(g[coarse(where, a, b)] for g, (a, b) in zip(grids, pairs, strict=True)))

    return score


def test_op5_query_against_a_slow_model(spark):
    texts, marks = learned(spark, SMALL, "quality")
    ids = sorted(marks)
    rows = {i: slow_features(t) for i, t in texts.items()}
    score = slow_model([rows[i] for i in ids], [float(marks[i] > 0) for i in ids])
    got = {r.doc_id: r for r in queries.op5_quality(spark, SMALL).collect()}
    want = {i: score(r) for i, r in rows.items()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=1e-6)
    assert all(r.predicted == int(want[i] >= 0.7) for i, r in got.items() if abs(want[i] - 0.7) > 1e-6)


# toxicity ------------------------------------------------------------------------
def tokens_of(text):
    return toxicity._TOKEN.findall(text.lower())


def forms_of(token):
    return [token, *(token[:n] + "~" for n in range(4, 9) if len(token) > n)]


def slow_terms(texts, marks, support=6, precision=0.9):
    """(text, stem, edits) by looking at every pair of candidates."""
    toxic, other, near = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for i, mark in marks.items():
        words = tokens_of(texts[i])
        found = {f for w in words for f in forms_of(w)}
        (toxic if mark > 0 else other).update(found)
        if mark > 0:
            for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False):
                for f in forms_of(w):
                    near[f].add((a, b))
    good = {f: t for f, t in toxic.items() if t >= support and t / (t + other[f] + 0.5) >= precision and len(near[f]) >= support}
    chosen, covered = [], []
    for form in sorted(good, key=lambda f: (-good[f], -len(f), f)):
        text, stem, t = form.rstrip("~"), form.endswith("~"), good[form]
        edits = 0 if len(text) < 5 else 1 if len(text) < 9 else 2
        if any((c == text and not s) or (s and text.startswith(c)) for c, s, _ in chosen):
            covered += [(text, False, edits)] * (not stem and edits > 0)
            continue
        longer = [f for f in good if f.startswith(text) and f != form]
        inside = [good.get(c + "~" * s, 0) for c, s, _ in chosen if c.startswith(text)]
        if stem and (any(good[f] >= 0.8 * t for f in longer if not f.endswith("~")) or any(good[f] >= 0.9 * t for f in longer if f.endswith("~") and len(f) > len(form)) or (inside and t < 1.3 * max(inside))):
            continue
        chosen.append((text, stem, edits))
    return chosen + covered


def slow_match(token, terms):
    """(term, edits): the nearest stem of a beginning, earliest first, unless a word is as near and no stem is exact."""
    stems, words = [], []
    for k, (text, stem, edits) in enumerate(terms):
        if stem:
            last, pair = text[-1], text[-2:][::-1]
            for end in range(len(token)):
                if token[end] == last and abs(end - len(text) + 1) <= edits and (d := edit_distance(token[:end], text[:-1])) <= edits:
                    stems.append((d, end + 1, k))
                if edits and token[end : end + 2] == pair and text[-1] != text[-2] and (d := 1 + edit_distance(token[:end], text[:-2])) <= edits:
                    stems.append((d, end + 2, k))
        elif abs(len(text) - len(token)) <= edits and (text == token or edits) and (d := edit_distance(token, text)) <= edits:
            words.append((d, k))
    stem, word = min(stems, default=None), min(words, default=None)
    if word and (not stem or (stem[0] and word[0] <= stem[0])):
        return word[1], word[0]
    return (stem[2], stem[0]) if stem else None


def slow_row(text, terms, known):
    lower = text.lower()
    spans = [(m.group(), m.start()) for m in toxicity._TOKEN.finditer(lower)]
    hits = []
    for i, (token, at) in enumerate(spans):
        if token not in known:
            known[token] = slow_match(token, terms)
        if known[token]:
            hits.append((i, at, *known[token]))
    if not hits:
        return [0.0] * 10, set()
    count = collections.Counter()
    for i, at, _, edits in hits:
        begin, end = lower.rfind("\n", 0, at) + 1, (lower + "\n").find("\n", at)
        marks = [m.start() for m in toxicity._QUOTE.finditer(lower)]
        quoted = sum(begin <= m < at for m in marks) % 2 == 1 and any(at < m < end for m in marks)
        count["fuzzy" if edits else "exact", quoted] += 1
        count["addressed"] += any(w in toxicity.ADDRESS for w, _ in spans[max(0, i - 8) : i + 9])
        count["crowded"] += any(0 < abs(h[0] - i) <= 8 for h in hits)
    counts = [count["exact", False], count["fuzzy", False], count["exact", True], count["fuzzy", True], count["addressed"], count["crowded"]]
    row = [*map(math.log1p, counts), min(1.0, 20 * len(hits) / len(spans)), 1.0, float(counts[0] + counts[1] > 0), math.log1p(len({h[2] for h in hits}))]
    return row, {h[2] for h in hits if h[3]}


def slow_logistic(x, y):
    """The ridge optimum around the prior, by damped Newton steps until nothing moves."""
    prior = dict(exact=1.0, fuzzy=0.7, exact_quoted=-0.7, fuzzy_quoted=-0.7, any_unquoted=1.0)
    centre = np.array([*(prior.get(f, 0.0) for f in toxicity.FEATURES), math.log((sum(y) + 1) / (len(y) - sum(y) + 9))])
    full, penalty = np.hstack([x, np.ones((len(x), 1))]), np.array([1.0] * 10 + [1e-3])
    beta = centre.copy()
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(full @ beta)))
        slope = full.T @ (y - p) - penalty * (beta - centre)
        step = np.linalg.solve((full.T * (p * (1 - p))) @ full + np.diag(penalty), slope)
        beta += 0.5 * step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def test_op7_query_against_a_slow_reader(spark):
    texts, marks = learned(spark, SF, "toxic")
    terms, known = slow_terms(texts, marks), {}
    model = toxicity.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    ids = sorted(marks)
    rows = {i: slow_row(texts[i], terms, known) for i in ids}
    right, wrong = collections.Counter(), collections.Counter()
    for i in ids:
        (right if marks[i] > 0 else wrong).update(rows[i][1])
    kept = [(t, s, 0 if wrong[k] > 0.1 * right[k] + 0.002 * len(ids) / 20 else e) for k, (t, s, e) in enumerate(terms)]
    stems = tuple(t for t, s, _ in kept if s)
    kept = [(t, s, e) for t, s, e in kept if s or e or not t.startswith(stems)]
    assert [(t.text, t.stem, t.edits) for t in model.terms] == kept and len(kept) > 3
    known = {}
    every = {i: slow_row(t, kept, known)[0] for i, t in texts.items()}
    beta = slow_logistic(np.array([every[i] for i in ids]), np.array([float(marks[i] > 0) for i in ids]))
    want = {i: 1 / (1 + math.exp(-float(np.dot(beta, [*r, 1.0])))) for i, r in every.items()}
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, SF).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=1e-4)
    assert statistics.mean(got[i].predicted == marks[i] for i in ids) > 0.95
