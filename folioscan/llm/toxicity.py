"""Toxicity (operator 7): Levenshtein automata over a learned lexicon trie, with context windows.

The lexicon is learned from a bounded sample of labelled documents: words, and stems
that many word forms begin with, which occur in toxic documents and hardly elsewhere.
They form a trie.  A token is run through the intersection of that trie with the
Levenshtein automaton of its terms: a state is the set of (node, edits) positions
that the characters read so far allow, and states are determinised as they come up,
so a token costs one look-up a character and most end after a few.

Each hit is weighed by its window: whether it stands inside quotation marks, whether
somebody is addressed, and what else was hit nearby.  A ridge logistic model over
these counts separates quotation from abuse and gives the score.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import bounded, texts_of
from folioscan.llm.quality import SAMPLE, labelled

_TOKEN = re.compile(r"[^\W_]+(?:[*@$!'’][^\W_]+)*")
_QUOTE = re.compile(r"[\"“”„«»‹›]|(?<!\w)['‘]|['’](?!\w)")
#: Words that address somebody, in the languages of the corpus.
ADDRESS = frozenset("you your youre yours du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tus ti vosotros".split())
WINDOW = 8
#: Tokens whose verdict a worker remembers; beyond it, it starts afresh.
REMEMBERED = 500_000
STEMS = range(4, 9)
#: A term occurs in so many toxic documents and contexts at least, and in this share of toxic documents among all.
LEAST_SUPPORT, PRECISION = 6, 0.9
#: Marks a position whose last character was read as it stands, not skipped or replaced; no token has it.
WHOLE = "="


def allowed_edits(term: str) -> int:
    """None for short terms, one from 5 characters on, two from 9 on."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclasses.dataclass(frozen=True)
class Term:
    text: str
    stem: bool = False
    edits: int = 0


class Automaton:
    """The determinised intersection of the terms' trie with their Levenshtein automata."""

    def __init__(self, terms: Sequence[Term]):
        self.terms = list(terms)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # the most edits that a term below a node allows
        for i, term in enumerate(self.terms):
            node = 0
            self.reach[0] = max(self.reach[0], term.edits)
            for char in term.text:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][char]
                self.reach[node] = max(self.reach[node], term.edits)
            self.ends[node].append(i)
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stem_hits: list[tuple[int, int] | None] = []
        self.word_hits: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, positions: set[tuple[int, int, str]]) -> int:
        """The number of a state; ``positions`` are closed over skipped term characters."""
        todo, best = list(positions), {}
        while todo:
            node, edits, owed = todo.pop()
            if edits > self.reach[node] or best.get((node, owed), 99) <= edits:
                continue
            best[node, owed] = edits
            if not owed:
                todo += [(child, edits + 1, "") for child in self.children[node].values()]
        state = frozenset((n, e, o) for (n, o), e in best.items())
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            found = sorted((e, i) for n, e, o in state if not o or o == WHOLE for i in self.ends[n] if e <= self.terms[i].edits and self.terms[i].stem == (o == WHOLE))
            stems = [(i, e) for e, i in found if self.terms[i].stem]
            self.stem_hits.append(stems[0] if stems else None)
            self.word_hits.append((found[0][1], found[0][0]) if found else None)
        return self.ids[state]

    def _move(self, state: int, char: str) -> int:
        after: set[tuple[int, int, str]] = set()
        for node, edits, owed in self.states[state]:
            if owed:  # the second half of a transposition
                if char == owed:
                    after |= {(node, edits, ""), (node, edits, WHOLE)}
                continue
            kids = self.children[node]
            if char in kids:
                after |= {(kids[char], edits, ""), (kids[char], edits, WHOLE)} if self.ends[kids[char]] else {(kids[char], edits, "")}
            if edits < self.reach[node]:
                after.add((node, edits + 1, ""))
                for first, child in kids.items():
                    after.add((child, edits + 1, ""))
                    if first != char and char in self.children[child]:
                        after.add((self.children[child][char], edits + 1, first))
        self.moves[state][char] = to = self._state(after)
        return to

    def match(self, token: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term that the token is, or whose stem is close to some beginning of it.

        Edits lie inside a stem: its last character is not one of them, or it would be a shorter stem.
        """
        state, stem = self.start, None
        for char in token:
            to = self.moves[state].get(char)
            state = self._move(state, char) if to is None else to
            if not self.states[state]:
                return stem
            if (hit := self.stem_hits[state]) is not None and (stem is None or hit[1] < stem[1]):
                stem = hit
                if not hit[1]:
                    return stem
        word = self.word_hits[state]
        return word if word is not None and (stem is None or word[1] <= stem[1]) else stem


FEATURES = ("exact", "fuzzy", "exact_quoted", "fuzzy_quoted", "addressed", "crowded", "density", "any", "any_unquoted", "kinds")


class Reader:
    """Finds hits and their context in texts."""

    def __init__(self, terms: Sequence[Term]):
        self.automaton = Automaton(terms)
        self.known: dict[str, tuple[int, int] | None] = {}

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(token number, offset, term, edits) of each hit."""
        found, known = [], self.known
        for i, token in enumerate(tokens := _TOKEN.findall(text.lower())):
            try:
                hit = known[token]
            except KeyError:
                if len(known) > REMEMBERED:
                    known.clear()
                hit = known[token] = self.automaton.match(token)
            if hit is not None:
                found.append((i, hit[0], hit[1]))
        if not found:
            return []
        at = [m.start() for m in _TOKEN.finditer(text.lower())]
        self.tokens = tokens
        return [(i, at[i], term, edits) for i, term, edits in found]

    def row(self, text: str, hits: list[tuple[int, int, int, int]] | None = None) -> list[float]:
        """The counts of a text; ``hits`` are those that this reader has just found in it."""
        hits = self.hits(text) if hits is None else hits
        if not hits:
            return [0.0] * len(FEATURES)
        lower = text.lower()
        marks = [m.start() for m in _QUOTE.finditer(lower)]
        breaks = [-1, *(m.start() for m in re.finditer("\n", lower)), len(lower)] if marks else []
        counts: Counter[str] = Counter()
        places = [-WINDOW - 1, *(h[0] for h in hits), len(self.tokens) + WINDOW]
        for k, (i, offset, _, edits) in enumerate(hits, 1):
            quoted = False
            if marks:
                # Marks of the hit's line before and behind it, by binary search in either list.
                line = bisect_left(breaks, offset)
                here = bisect_left(marks, offset)
                before = here - bisect_right(marks, breaks[line - 1])
                behind = bisect_left(marks, breaks[line]) - bisect_right(marks, offset)
                quoted = before % 2 == 1 and behind > 0
            counts[("fuzzy" if edits else "exact") + "_quoted" * quoted] += 1
            counts["addressed"] += not ADDRESS.isdisjoint(self.tokens[max(0, i - WINDOW) : i + WINDOW + 1])
            counts["crowded"] += i - places[k - 1] <= WINDOW or places[k + 1] - i <= WINDOW
        plain = counts["exact"] + counts["fuzzy"]
        row = [np.log1p(counts[f]) for f in FEATURES[:6]]
        return [*row, min(1.0, 20 * len(hits) / max(1, len(self.tokens))), 1.0, float(plain > 0), np.log1p(len({h[2] for h in hits}))]


@dataclasses.dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[Term, ...]
    weights: np.ndarray
    intercept: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + rows @ self.weights, -30, 30)))


def _forms(text: str) -> set[str]:
    """The words of a text, and their stems with a mark at the end."""
    words = set(_TOKEN.findall(text.lower()))
    return words | {w[:n] + "~" for w in words for n in STEMS if len(w) > n}


def _counted(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(form, toxic, other, contexts): documents that a form occurs in, counted in each batch before the shuffle.

    With ``wanted``, ``contexts`` are the distinct neighbours that the form has in
    toxic documents: copies of one document add none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            contexts: dict[str, set[int]] = {}
            for text, label in zip(texts_of(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), strict=True):
                forms = _forms(text)
                if wanted is not None:
                    forms &= wanted
                counts[label > 0].update(forms)
                if wanted is not None and label > 0 and forms:
                    tokens = ["", *_TOKEN.findall(text.lower()), ""]
                    for before, token, after in zip(tokens, tokens[1:], tokens[2:], strict=False):
                        near = zlib.crc32(f"{before} {after}".encode())
                        for form in (token, *(token[:n] + "~" for n in STEMS if len(token) > n)):
                            if form in forms:
                                contexts.setdefault(form, set()).add(near)
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict(
                {"form": pa.array(keys, pa.string()), "toxic": pa.array([counts[1][k] for k in keys], pa.int64()), "other": pa.array([counts[0][k] for k in keys], pa.int64()), "near": pa.array([list(contexts.get(k, ())) for k in keys], pa.list_(pa.int64()))}
            )

    found = rows.mapInArrow(run, "form string, toxic long, other long, near array<long>")
    return found.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.size(F.array_distinct(F.flatten(F.collect_list("near")))).alias("contexts"))


def choose_terms(counts: dict[str, tuple[int, int]], least: int = LEAST_SUPPORT, precision: float = PRECISION) -> list[Term]:
    """Words and stems that mark toxic documents; the longest stem that covers the same documents, and no term within another.

    Behind them stand the words that a chosen stem covers, to be found by their misspellings.
    """
    good = {f: t for f, (t, o) in counts.items() if t >= least and t / (t + o + 0.5) >= precision}
    ordered = sorted(good)

    def under(text: str) -> Iterator[str]:
        """The good forms that begin with a text."""
        for k in range(bisect_left(ordered, text), len(ordered)):
            if not ordered[k].startswith(text):
                return
            yield ordered[k]

    chosen: list[Term] = []
    covered: list[Term] = []
    words: set[str] = set()
    stems: set[str] = set()
    for form, toxic in sorted(good.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        text, stem = form.removesuffix("~"), form.endswith("~")
        if text in words or any(text[:n] in stems for n in range(1, len(text) + 1)):
            if not stem and allowed_edits(text):
                covered.append(Term(text, False, allowed_edits(text)))
            continue
        if stem and any(good[w] >= 0.8 * toxic for w in under(text) if not w.endswith("~")):
            continue  # it is one word's beginning
        if stem and any(f.endswith("~") and len(f) > len(form) and good[f] >= 0.9 * toxic for f in under(text)):
            continue  # a longer stem says nearly as much, and hits less else
        if stem and any(c.text.startswith(text) for c in chosen) and toxic < 1.3 * max(good.get(c.text + "~" * c.stem, 0) for c in chosen if c.text.startswith(text)):
            continue
        chosen.append(Term(text, stem, allowed_edits(text)))
        (stems if stem else words).add(text)
    return chosen + covered


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, text: str = "text", support: int = LEAST_SUPPORT) -> ToxicityModel:
    """Learns terms, edits and weights from at most ``sample`` labelled documents outside the held-out fold.

    All forms that occur in ``support`` toxic documents and contexts and are precise are candidates;
    the driver gets those and one row of counts a sampled document.  Null texts have no
    forms, rows without an id or a label are left out, of several labels of one id the smallest
    counts, and repeated rows of a labelled id count each.  Without any labelled row there are
    no terms, and every score is that of a text without hits.
    """
    rows = labelled(docs, labels, label, sample, text)
    precise = F.col("toxic") / (F.col("toxic") + F.col("other") + 0.5) >= PRECISION
    likely = {r[0]: (r[1], r[2]) for r in _counted(rows, None).where((F.col("toxic") >= support) & precise).select("form", "toxic", "other").collect()}
    wanted = frozenset(likely)
    varied = [r[0] for r in _counted(rows.where("label > 0"), wanted).where(F.col("contexts") >= support).select("form").collect()] if wanted else []
    terms = choose_terms({f: likely[f] for f in varied}, support)

    def read(batches: Iterator[pa.RecordBatch], terms: Sequence[Term]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        for batch in bounded(batches):
            x, fuzzy = [], []
            for t in texts_of(batch.column(1)).to_pylist():
                hits = reader.hits(t)
                x.append(reader.row(t, hits))
                fuzzy.append(sorted({h[2] for h in hits if h[3]}))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "x": pa.array(x, pa.list_(pa.float64())), "fuzzy": pa.array(fuzzy, pa.list_(pa.int32())), "label": batch.column(2)}
            )

    def table(terms: Sequence[Term]) -> pa.Table:
        return rows.mapInArrow(lambda b: read(b, terms), "doc_id long, x array<double>, fuzzy array<int>, label int").toArrow().sort_by("doc_id")

    got = table(terms)
    # Misspellings of a term count only where they do not also hit ordinary words.
    right, wrong = Counter(), Counter()
    for near, mark in zip(got["fuzzy"].to_pylist(), got["label"].to_pylist(), strict=True):
        (right if mark > 0 else wrong).update(near)
    strict = [dataclasses.replace(t, edits=0) if wrong[i] > 0.1 * right[i] + 0.002 * got.num_rows / 20 else t for i, t in enumerate(terms)]
    # A covered word without edits says nothing that its stem does not.
    stems = tuple(t.text for t in strict if t.stem)
    strict = [t for t in strict if t.stem or t.edits or not t.text.startswith(stems)]
    if strict != terms:
        got = table(strict)
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    weights, intercept = _logistic(x, (got["label"].to_numpy() > 0).astype(float))
    return ToxicityModel(tuple(strict), weights, intercept)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Newton's method; quoted hits are held below plain ones by a prior where no label tells."""
    n, width = x.shape
    prior = np.zeros(width)
    for name, weight in (("exact", 1.0), ("fuzzy", 0.7), ("exact_quoted", -0.7), ("fuzzy_quoted", -0.7), ("any_unquoted", 1.0)):
        prior[FEATURES.index(name)] = weight
    beta = np.concatenate([prior, [np.log((y.sum() + 1) / (n - y.sum() + 9)) if n else -2.0]])
    full = np.hstack([x, np.ones((n, 1))])
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-3
    centre = beta.copy()
    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        grad = full.T @ (y - p) - penalty * (beta - centre)
        hess = (full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return beta[:-1], float(beta[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``keep``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``terms`` (the distinct terms hit, in lexicon order).

    Null texts are scored as empty ones: no hit.  Repeated rows get equal scores; a
    kept column named like an output gives way to it.
    """
    outs = ["score", "predicted", "terms"]
    keep = [c for c in keep if c not in outs]
    narrow = docs.select(*keep, docs[text].alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.terms)
        for batch in bounded(batches):
            rows, terms = [], []
            for body in texts_of(batch.column(len(keep))).to_pylist():
                hits = reader.hits(body)
                terms.append([model.terms[i].text for i in sorted({h[2] for h in hits})])
                rows.append(reader.row(body, hits))
            score = model.score(np.array(rows, float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(terms, pa.list_(pa.string()))], [*keep, *outs])

    return narrow.mapInArrow(run, fields + "score double, predicted int, terms array<string>")
