"""Closed-syncmer fingerprints of documents (operator 2).

A k-mer of characters is an anchor if the smallest of its inner s-mers (by hash)
stands at either of its edges.  Whether it does depends on its own characters only,
so an edit moves no anchor that it does not touch.  A fingerprint keeps all anchor
hashes, each with the position where it first occurs, so it grows with the text;
two fingerprints are alike by the anchors they share in the same order, by all of
them or estimated from the ``ANCHORS`` smallest.

Neighbours by id come from one shuffle into ranges of ids, streamed in order: each row
meets the next one as it passes, and the first row of a range is sent along to the end
of the range before it.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm import vec
from folioscan.llm.common import bounded, texts_of
from folioscan.llm.vec import U64

K, S, ANCHORS = 32, 8, 64
Print = tuple[np.ndarray, np.ndarray]


def prints(texts: Sequence[str], k: int = K, s: int = S, anchors: int | None = None) -> list[Print]:
    """Hashes (ascending) and positions of each text's anchors, or of its ``anchors`` smallest.

    A text shorter than k characters is a single anchor; an empty one has none.  Of
    a longer text without a syncmer all k-mers are anchors.
    """
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, U64)
        np.cumsum((points.astype(U64) + U64(1)) * vec._power("up", n), out=prefix[1:])
        down = vec._power("down", n + 1)

        def span(at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
            return vec.mix((prefix[at + length] - prefix[at]) * down[at])

        at = np.zeros(0, np.int64)
        if n >= k:
            inner = vec.mix((prefix[s:] - prefix[:-s]) * down[: n - s + 1])
            width, low, have = k - s + 1, inner, 1
            while have < width:
                step = min(have, width - have)
                low = np.minimum(low[:-step], low[step:])
                have += step
            edge = (inner[: len(low)] == low) | (inner[width - 1 : width - 1 + len(low)] == low)
            at = np.flatnonzero(edge)
            whose = np.searchsorted(ends, at, side="right")
            inside = at + k <= ends[whose]
            at, whose = at[inside], whose[inside]
            # Texts of under 2k - s - 1 characters may have no syncmer: all their k-mers are anchors.
            bare = np.flatnonzero((size >= k) & (np.bincount(whose, minlength=len(size)) == 0))
            many = size[bare] - k + 1
            every = np.repeat(begins[bare] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at, whose = np.concatenate([at, every]), np.concatenate([whose, np.repeat(bare, many)])
        hashes = span(at, k) if len(at) else np.zeros(0, U64)
        if not len(at):
            whose = np.zeros(0, np.int64)
        short = np.flatnonzero((size > 0) & (size < k))
        hashes = np.concatenate([hashes, span(begins[short], size[short])]) >> U64(32)
        whose, at = np.concatenate([whose, short]), np.concatenate([at, begins[short]])
    order = np.argsort((whose.astype(U64) << U64(32)) | hashes, kind="stable")
    hashes, whose, at = hashes[order].astype(np.uint32), whose[order], at[order]
    first = np.ones(len(order), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (whose[1:] != whose[:-1])
    hashes, whose, at = hashes[first], whose[first], at[first]
    cut = np.searchsorted(whose, np.arange(len(texts) + 1))
    last = cut[1:] if anchors is None else np.minimum(cut[:-1] + anchors, cut[1:])
    return [(hashes[a:b], (at[a:b] - o).astype(np.uint32)) for a, b, o in zip(cut[:-1], last, begins, strict=True)]


def to_text(fingerprint: Print) -> str:
    return base64.b64encode(np.stack(fingerprint, 1).astype("<u4").tobytes()).decode()


def from_text(text: str) -> Print:
    pairs = np.frombuffer(base64.b64decode(text), "<u4").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def likeness(a: Print, b: Print, anchors: int | None = ANCHORS) -> float:
    """Twice the shared anchors in common order over all, of all or estimated from the ``anchors`` smallest of both; 0 to 1.

    Two empty fingerprints are alike, an empty and another are not.
    """
    (here, at), (there, to) = ((h[:anchors], p[:anchors]) for h, p in (a, b))
    if np.array_equal(here, there) and np.array_equal(at, to):
        return 1.0
    both, i, j = np.intersect1d(here, there, assume_unique=True, return_indices=True)
    n = len(here) + len(there) - len(both)
    if anchors is not None and n > anchors:
        n = anchors
        within = both <= np.union1d(here, there)[n - 1]
        i, j = i[within], j[within]
    run: list[int] = []
    for place in to[j][np.argsort(at[i])].tolist():  # longest run of matches in ascending order on both sides
        if not run or place > run[-1]:
            run.append(place)
        else:
            run[bisect_left(run, place)] = place
    return 2 * len(run) / (n + len(run)) if run else 0.0


def edit(text: str, following: str) -> str:
    """The last quarter gives way to the first as many characters of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, whole_edited double, whole_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _rows(ids: list, texts: list[str], nexts: list[str]) -> dict[str, list]:
    """The result of each text whose next one is known."""
    edited = [edit(t, n) for t, n in zip(texts, nexts, strict=True)]
    # In the stream each next text is the following row's own.
    chained = nexts[:-1] == texts[1:]
    own = prints([*texts, nexts[-1]] if chained else [*texts, *nexts])
    follow = own[1:] if chained else own[len(texts) :]
    own = own[: len(texts)]
    changed = prints(edited)
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [to_text(p) for p in own],
        "edited_fingerprint": [to_text(p) for p in changed],
        "near_edited": [likeness(p, q) for p, q in zip(own, changed, strict=True)],
        "near_next": [likeness(p, q) for p, q in zip(own, follow, strict=True)],
        "whole_edited": [likeness(p, q, None) for p, q in zip(own, changed, strict=True)],
        "whole_next": [likeness(p, q, None) for p, q in zip(own, follow, strict=True)],
    }


def _range_of(doc_id: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds an id has reached, by binary search; nulls have reached none."""
    if not bounds:
        return F.lit(0)
    array, n = F.lit(list(bounds)), len(bounds)
    steps = F.array(*(F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)))
    place = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.element_at(array, F.least(low + step, F.lit(n))) <= doc_id), low + step).otherwise(low))
    return F.coalesce(place, F.lit(0))


def fingerprint_neighbours(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, whole_edited, whole_next.

    The next document follows in ascending id (nulls first), rows of one id in the
    order of their texts; after the last comes the first, so a single document is
    its own next.  Null texts are empty.  Texts are fingerprinted whole.  Other columns are
    left behind, whatever their names; an empty table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n)) if n > 1 else F.lit(None)
    # As many bounds as there are partitions, whatever the data.
    bounds = docs.agg(cuts.alias("cuts")).first()["cuts"]
    placed = docs.withColumn("part", _range_of(F.col("doc_id"), sorted(set(bounds or []))))
    # The first row of each range also goes, as a guest, to the end of the range before it.
    heads = placed.groupBy("part").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("nulls")).select(F.col("part").alias("of"), F.when(~F.col("nulls"), F.col("head")).alias("head"))
    firsts = placed.join(F.broadcast(heads), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    order = Window.orderBy("part")
    last = F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = firsts.select("part", F.coalesce(F.lag("part").over(order), last).alias("host"))
    guests = firsts.join(before, "part").select("doc_id", "text", F.col("host").alias("part"), F.lit(True).alias("guest"))
    rows = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    stream = rows.repartitionById(n, "part").sortWithinPartitions("part", "guest", "doc_id", "text").select("doc_id", "text", "guest")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in _NAMES[1:4]), *((c, pa.float64()) for c in _NAMES[4:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, guest = [], [], []
        for batch in bounded(batches):
            ids, texts, guest = ids[-1:] + batch.column(0).to_pylist(), texts[-1:] + texts_of(batch.column(1)).to_pylist(), guest[-1:] + batch.column(2).to_pylist()
            if len(ids) < 2:
                continue
            got = _rows(ids[:-1], texts[:-1], texts[1:])
            own = pa.array([not g for g in guest[:-1]])
            yield pa.RecordBatch.from_pydict(got, schema).filter(own)

    return stream.mapInArrow(run, f"doc_id long, {_RESULT}")
