"""Quality classifier (operator 5): a generalised additive model with pairwise interactions.

Features of the whole text are binned; cyclic boosting visits one feature after
another and adds a shallow tree over its bins to that feature's lookup table, then
does the same for the strongest pairs.  What remains of the trees is tables, so a
score is an intercept plus one addition a table, for whole batches at once.

It learns from at most ``SAMPLE`` labelled documents outside the held-out fold,
chosen by a hash of the id; labels, language, source and id are never features.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import vec
from folioscan.llm.common import bounded, held_out, texts_of

#: Most labelled rows that a model learns from.
SAMPLE = 20_000
FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "pipes", "other_marks", "stops", "lines_per_word",
    "distinct_words", "repeated_triples", "repeated_lines", "short_words", "long_words", "capitalised", "blanks", "non_ascii", "marked_words", "top_word",
)


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER, _DIGIT = _bytes(bytes(range(65, 91))), _bytes(b"0123456789")
_SYMBOL, _BANG, _PIPE, _STOP = _bytes(b"#*$%&<>"), _bytes(b"!"), _bytes(b"|"), _bytes(b".,;:?")
_MARK = _bytes(bytes(c for c in range(33, 127) if not chr(c).isalnum())) & ~(_SYMBOL | _BANG | _PIPE | _STOP)


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; all zero for an empty one."""
    t = vec.Texts(texts_of(column))
    n, data = t.n, t.data
    size = np.maximum(np.diff(t.at), 1)
    starts, ends = t.edges(vec.NON_SPACE[data])
    owner, hashes = t.owner(starts), t.hashes(starts, ends)
    words = np.bincount(owner, minlength=n)
    at_least = np.maximum(words, 1)
    length = ends - starts

    def share(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, n) / at_least

    def distinct(h: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each text, and how often its most frequent one occurs."""
        keys, counts = np.unique((h >> vec.U64(14)) | (whose.astype(vec.U64) << vec.U64(50)), return_counts=True)
        group = (keys >> vec.U64(50)).astype(np.int64)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, group, counts)
        return np.bincount(group, minlength=n), top

    kinds, top = distinct(hashes, owner)
    triples, t_owner = vec.windows(hashes, owner, 3, n, short=False)
    n_triples = np.bincount(t_owner, minlength=n)
    line_starts, line_ends = t.edges(data != 10)
    lines = t.owner(line_starts)
    n_lines = np.bincount(lines, minlength=n)
    line_kinds, _ = distinct(t.hashes(line_starts, line_ends), lines)
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_SYMBOL | _BANG | _PIPE)[data], out=marks[1:])
    marked = marks[ends] > marks[starts]
    rows = [
        np.log1p(words), share(length), t.per_text(_UPPER[data]) / size, t.per_text(_DIGIT[data]) / size, t.per_text(_SYMBOL[data]) / size,
        t.per_text(_BANG[data]) / size, t.per_text(_PIPE[data]) / size, t.per_text(_MARK[data]) / size, t.per_text(_STOP[data]) / size, n_lines / at_least,
        kinds / at_least, 1 - distinct(triples, t_owner)[0] / np.maximum(n_triples, 1), 1 - line_kinds / np.maximum(n_lines, 1), share(length <= 3), share(length >= 12),
        share(_UPPER[data[starts]]) if len(starts) else np.zeros(n), t.per_text(vec.SPACE[data]) / size, t.per_text(data > 127) / size, share(marked), top / at_least,
    ]
    out = np.stack(rows, 1)
    out[np.diff(t.at) == 0] = 0
    return out


@dataclasses.dataclass
class AdditiveModel:
    """Bin edges, one table a feature and one a pair; ``logit`` only adds them up."""

    edges: list[np.ndarray]
    intercept: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray
    coarse: int

    BINS, COARSE = 32, 8

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 160, n_pairs: int = 10, rate: float = 0.1, ridge: float = 2.0) -> AdditiveModel:
        """An empty training set gives the score 0.5 to everything."""
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cls.BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
        mean = float(np.clip((y.sum() + 1) / (n + 2), 1e-3, 1 - 1e-3))
        model = cls(edges, float(np.log(mean / (1 - mean))), np.zeros((width, cls.BINS)), [], np.zeros((0, cls.COARSE, cls.COARSE)), cls.COARSE)
        if not n:
            return model
        bins = model.bins(x)
        logit = np.full(n, model.intercept)
        for _ in range(rounds):
            for j in range(width):
                grad, hess = _slopes(logit, y)
                step = rate * _tree(np.bincount(bins[:, j], grad, cls.BINS), np.bincount(bins[:, j], hess, cls.BINS), ridge)
                model.tables[j] += step
                logit += step[bins[:, j]]
        coarse = bins * cls.COARSE // cls.BINS
        grad, hess = _slopes(logit, y)
        gains = []
        for a in range(width):
            for b in range(a + 1, width):
                gains.append((_quadrants(*_grids(coarse[:, a] * cls.COARSE + coarse[:, b], grad, hess, cls.COARSE), ridge)[0], a, b))
        model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
        model.pair_tables = np.zeros((len(model.pairs), cls.COARSE, cls.COARSE))
        cells = [coarse[:, a] * cls.COARSE + coarse[:, b] for a, b in model.pairs]
        for _ in range(rounds // 2):
            for k, cell in enumerate(cells):
                grad, hess = _slopes(logit, y)
                step = rate * _quadrants(*_grids(cell, grad, hess, cls.COARSE), ridge)[1]
                model.pair_tables[k] += step
                logit += step.ravel()[cell]
        return model

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        logit = np.full(len(x), self.intercept)
        for j in range(len(self.edges)):
            logit += self.tables[j][bins[:, j]]
        coarse = bins * self.coarse // self.BINS
        for k, (a, b) in enumerate(self.pairs):
            logit += self.pair_tables[k][coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-logit))


def _slopes(logit: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-logit))
    return y - p, p * (1 - p)


def _tree(grad: np.ndarray, hess: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """Leaf values over ordered bins after the best ``leaves`` - 1 cuts, taken greedily."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def worth(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = worth(a, mid) + worth(mid, b) - worth(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(mid[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _grids(cell: np.ndarray, grad: np.ndarray, hess: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(cell, grad, side * side).reshape(side, side), np.bincount(cell, hess, side * side).reshape(side, side)


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of either axis: its gain and the four leaves, spread over the grid."""
    side = len(grad)
    g, h = np.zeros((side + 1, side + 1)), np.zeros((side + 1, side + 1))
    g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    i, j = np.meshgrid(np.arange(1, side), np.arange(1, side), indexing="ij")

    def block(m: np.ndarray, r0, r1, c0, c1) -> np.ndarray:  # noqa: ANN001
        return m[r1, c1] - m[r0, c1] - m[r1, c0] + m[r0, c0]

    zero, full = np.zeros_like(i), np.full_like(i, side)
    boxes = [(zero, i, zero, j), (zero, i, j, full), (i, full, zero, j), (i, full, j, full)]
    gain = sum(block(g, *b) ** 2 / (block(h, *b) + ridge) for b in boxes) - g[side, side] ** 2 / (h[side, side] + ridge)
    k = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros((side, side))
    for b in boxes:
        r0, r1, c0, c1 = (int(v[k]) for v in b)
        out[r0:r1, c0:c1] = (g[r1, c1] - g[r0, c1] - g[r1, c0] + g[r0, c0]) / (h[r1, c1] - h[r0, c1] - h[r1, c0] + h[r0, c0] + ridge)
    return float(gain[k]), out


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled documents outside the held-out fold.

    Rows without an id or a label are left out; of several labels of one document
    the smallest counts.  The chosen ids are a table of a fixed size, so they are
    broadcast and no text is shuffled.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    chosen = marks.orderBy(F.xxhash64(F.lit(label), F.col("doc_id")), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text") -> AdditiveModel:
    """Learns from at most ``sample`` labelled ids outside the held-out fold, of which the driver gets one row of features a row.

    Null texts are empty ones; rows without an id or a label are left out, and repeated rows of
    a labelled id count each.  Without any labelled row every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = features(batch.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "x": pa.array(list(rows), pa.list_(pa.float64())), "label": batch.column(2)})

    got = labelled(docs, labels, label, sample, text).mapInArrow(run, "doc_id long, x array<double>, label int").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return AdditiveModel.fit(x, (got["label"].to_numpy() > 0).astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """``keep``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null texts are scored as empty ones.  Repeated rows get equal scores; a kept
    column named like an output gives way to it.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    narrow = docs.select(*keep, docs[text].alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            score = model.score(features(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return narrow.mapInArrow(run, fields + "score double, predicted int")
