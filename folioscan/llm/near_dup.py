"""Near-duplicates (operator 4): improved consistent weighted sampling over TF-IDF shingles.

1. Texts with the same words are one; only the smallest id of each goes on.
2. The document frequency of every five-word shingle is counted over all texts in a
   table of a fixed number of hash cells (less the cells' mean, so chance neighbours
   cancel out).  The table does not grow with the data, so it may be broadcast.
3. A shingle weighs (1 + ln tf) times its smoothed idf.  Improved consistent weighted sampling draws
   ``BANDS`` * ``ROWS`` samples from each text; two texts agree in a sample with the
   probability of their weighted Jaccard similarity.  The draws r, c and beta of a
   shingle come from a table that its hash indexes, for each of a ladder of weights.
4. Texts that agree in all rows of a band meet in a bucket.  Each bucket links its
   members to one of them, never to each other, and links are verified by the exact
   weighted Jaccard similarity of the texts.  Members of hot buckets find their centre
   without being brought together.
5. Verified links give classes.  A bucket whose members are all in one class is
   done.  In the others, members outside the largest class are compared with the
   members of other classes inside the bucket, in blocks and by the same exact
   similarity, so no link between different texts is lost because it does not touch a
   bucket's centre; only links that join two classes leave the task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import vec
from folioscan.llm.common import bounded, materialise, texts_of
from folioscan.llm.vec import U64

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 3
#: Cells of the document-frequency table, of the table of draws, and steps of the weight ladder.
CELLS, DRAWS, STEP = 1 << 20, 1 << 16, 1.1
IDF_SPREAD = 0.25
#: Text and members of one side of the pairs that a task compares within an unsettled bucket.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 512
#: A bucket is hot that has so many members and this part of all of a band's; there are ``BANDS`` * ``HOT_PART`` such at most.
HOT_ROWS, HOT_PART = 256, 4096


def shingles(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hash, text and term frequency of each text's distinct shingles, by text; and the number of texts.

    Words are runs of letters, digits and non-ASCII characters, lower-cased.
    """
    t = vec.Texts(pc.utf8_lower(texts_of(column)))
    starts, ends = t.edges(vec.ALNUM[t.data])
    owner = t.owner(starts)
    h, whose = vec.windows(t.hashes(starts, ends), owner, size, t.n)
    order = np.lexsort((h, whose))
    h, whose = h[order], whose[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
    at = np.flatnonzero(first)
    return h[at], whose[at], np.diff(np.append(at, len(h))), t.n


def _words_key(column: pa.Array) -> list[bytes]:
    """16 bytes for the word sequence of each text."""
    t = vec.Texts(pc.utf8_lower(texts_of(column)))
    starts, ends = t.edges(vec.ALNUM[t.data])
    h, owner = t.hashes(starts, ends), t.owner(starts)
    counts = np.bincount(owner, minlength=t.n)
    place = (np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(U64)
    sums = []
    with np.errstate(over="ignore"):
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            mixed = vec.mix(h ^ vec.mix(place * U64(salt) + U64(salt)))
            total = np.zeros(len(h) + 1, U64)
            np.cumsum(mixed, out=total[1:])
            edge = np.concatenate([[0], np.cumsum(counts)])
            sums.append(total[edge[1:]] - total[edge[:-1]] + counts.astype(U64))
    return [a.tobytes() + b.tobytes() for a, b in zip(*sums, strict=True)]


def representatives(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, text) of the smallest id of equal word sequences, and (doc_id, rep) of every row.

    ``docs`` has doc_id and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "words": pa.array(_words_key(batch.column(1)), pa.binary())})

    keys = materialise(docs.mapInArrow(run, "doc_id long, words binary"), "near-keys")
    heads = materialise(keys.groupBy("words").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "near-heads")
    members = keys.join(heads.where("n > 1").select("words", "rep"), "words", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    return heads.select("rep"), members


def _dense(counts: DataFrame) -> np.ndarray:
    """The fixed-size table from its parts (part, cells)."""
    table = np.zeros(CELLS, np.int64)
    for part, cells in counts.collect():
        got = np.frombuffer(cells, np.uint32)
        table[part * len(got) : (part + 1) * len(got)] = got
    return table


def document_frequencies(texts: DataFrame, parts: int = 16) -> tuple[np.ndarray, int]:
    """How many of the texts have a shingle in each hash cell, and the number of texts.

    Every task adds up its own texts; what is shuffled is one table a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(CELLS, np.uint32), 0
        for batch in bounded(batches):
            h, whose, _, size = shingles(batch.column(0))
            cell = np.sort((whose.astype(U64) << U64(20)) | (h >> U64(44)))
            once = cell[np.concatenate([[True], cell[1:] != cell[:-1]])] if len(cell) else cell
            table += np.bincount((once & U64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            n += size
        if n:
            step = CELLS // parts
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "n": pa.array([n] + [0] * (parts - 1), pa.int64()), "cells": [table[i * step : (i + 1) * step].tobytes() for i in range(parts)]})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(CELLS // parts, np.uint32), 0
        for batch in bounded(batches):
            for cells in batch.column(2):
                table += np.frombuffer(cells.as_buffer(), np.uint32)
            n += pc.sum(batch.column(1)).as_py()
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "cells": pa.array([table.tobytes()], pa.binary())})

    each = texts.select("text").mapInArrow(run, "part int, n long, cells binary")
    summed = materialise(each.groupBy("part").applyInArrow(add, "part int, n long, cells binary"), "near-df")
    n = summed.agg(F.sum("n")).first()[0] or 0
    return _dense(summed.select("part", "cells")), n


def idf_cells(table: np.ndarray, n: int) -> np.ndarray:
    """The smoothed idf of each cell, 1 to 1 + ``IDF_SPREAD``, where df is what its count exceeds the median by, 1 at least.

    The spread is bounded so that what thousands of near copies share still counts
    against the few words in which they differ.
    """
    df = np.minimum(np.maximum(1.0, table - np.median(table)), max(1, n))
    return (1 + IDF_SPREAD * np.log((1 + n) / df) / np.log(2 + n)).astype(np.float32)


@functools.lru_cache(1)
def _draws(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta of each table entry (fixed seed), and an odd multiplier for each sample."""
    rng = np.random.default_rng(20_10)
    r, c = rng.gamma(2, 1, DRAWS), rng.gamma(2, 1, DRAWS)
    return r, np.log(c), rng.random(DRAWS), rng.integers(0, 1 << 62, samples, dtype=np.int64).astype(U64) * U64(2) + U64(1)


@functools.lru_cache(256)
def _ladder(level: int) -> tuple[np.ndarray, np.ndarray]:
    """For a weight STEP**level: ln a (what is minimised) and t of each table entry."""
    r, ln_c, beta, _ = _draws(BANDS * ROWS)
    t = np.floor(level * np.log(STEP) / r + beta)
    return (ln_c - r * (t - beta) - r).astype(np.float32), t.astype(np.int32)


def samples(h: np.ndarray, whose: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """One 32-bit code of (shingle, t) for each text and sample; texts without shingles get zeros."""
    count = BANDS * ROWS
    out = np.zeros((n, count), np.uint32)
    if not len(h):
        return out
    level = np.round(np.log(weight) / np.log(STEP)).astype(np.int64)
    levels, rung = np.unique(level, return_inverse=True)
    ln_a = np.stack([_ladder(int(k))[0] for k in levels])
    steps = np.stack([_ladder(int(k))[1] for k in levels])
    base = rung * DRAWS
    full, begin = np.unique(whose, return_index=True)
    ln_a, steps = ln_a.ravel(), steps.ravel()
    multipliers = _draws(count)[3]
    for k in range(count):
        with np.errstate(over="ignore"):
            spread = h * multipliers[k]
        at = base + (spread >> U64(48)).astype(np.int64)
        a = ln_a[at]
        least = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == np.repeat(least, np.diff(np.append(begin, len(h)))))
        # Entries that tie are told apart by their hash, alike in every text.
        order = np.lexsort((spread[hit], whose[hit]))
        first = hit[order[np.unique(whose[hit][order], return_index=True)[1]]]
        with np.errstate(over="ignore"):
            out[full, k] = (vec.mix(h[first] + steps[at[first]].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)
    return out


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * idf[(h >> U64(44)).astype(np.int64)]


def signatures(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(rep, codes) for the texts (rep, text) that have shingles."""

    held = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            h, whose, tf, n = shingles(batch.column(1))
            codes = samples(h, whose, weights(h, tf, held.value), n)
            some = np.bincount(whose, minlength=n) > 0
            yield pa.RecordBatch.from_pydict({"rep": batch.column(0).filter(pa.array(some)), "codes": pa.array([row.tobytes() for row in codes[some]], pa.binary())})

    return texts.select("rep", "text").mapInArrow(run, "rep long, codes binary")


def buckets(signed: DataFrame) -> DataFrame:
    """(band, key, rep): a row for each text and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            n = batch.num_rows
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(U64)
            with np.errstate(over="ignore"):
                key = np.zeros((n, BANDS), U64)
                for r in range(ROWS):
                    key = vec.mix(key * U64(0xD1B54A32D192ED03) + codes[:, :, r])
            yield pa.RecordBatch.from_pydict({"band": pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), "key": pa.array(key.ravel().view(np.int64)), "rep": pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))})

    return signed.mapInArrow(run, "band int, key long, rep long")


def similarity(left: list[str], right: list[str], idf: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard similarity of the pairs of texts; 0 where both have no shingles."""
    n = len(left)
    h, whose, tf, _ = shingles(pa.array([*left, *right], pa.large_string()))
    w = weights(h, tf, idf)
    pair = whose % max(n, 1)
    order = np.lexsort((h, pair))
    h, pair, w = h[order], pair[order], w[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
    at = np.flatnonzero(same)
    shared = np.bincount(pair[at], np.minimum(w[at], w[at - 1]), n)
    total = np.bincount(pair, w, n)
    return shared / np.maximum(total - shared, 1e-12)


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose texts are at least that similar."""
    held = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            good = similarity(texts_of(batch.column(2)).to_pylist(), texts_of(batch.column(3)).to_pylist(), held.value) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def in_buckets(rows: DataFrame, facts: DataFrame, n: str, all_rows: int) -> DataFrame:
    """Rows (band, key, ...) with the facts of their bucket, for buckets that have any; ``n`` is a bucket's number of members.

    Rows of hot buckets find their facts in a broadcast table of a bounded number of rows, so
    none of them is brought together; the others are joined by bucket.  Both inputs are
    read twice and should be tables.
    """
    least = max(HOT_ROWS, all_rows // BANDS // HOT_PART)
    hot = F.broadcast(facts.where(F.col(n) >= least))
    cold = rows.join(hot.select("band", "key"), ["band", "key"], "left_anti").join(facts.where(F.col(n) < least).hint("merge"), ["band", "key"])
    return rows.join(hot, ["band", "key"]).unionByName(cold)


def met(dealt: DataFrame) -> DataFrame:
    """(band, key, a, rep) of the members of buckets with more than one, ``a`` being the smallest."""
    sizes = dealt.groupBy("band", "key").agg(F.min("rep").alias("a"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("n")).where("a <> top").select("band", "key", "a", "n")
    return in_buckets(dealt, materialise(sizes, "near-sizes"), "n", dealt.count()).select("band", "key", "a", "rep")


def components(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that the links lead to, for every linked node.

    Large-star and small-star steps alternate until neither moves a link; each keeps
    one row a link, and groups are only combined by their minimum.
    """
    links = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = materialise(small.where("u <> v").distinct(), "cc-small")
        # A star forest: nobody has two parents, and no parent is a child.
        torn = small.groupBy("u").count().where("count > 1").select("u").union(small.select("u").join(small.select(F.col("v").alias("p")).distinct(), F.col("u") == F.col("p"), "left_semi"))
        links = small
        if torn.isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("class")).union(small.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())


def _unsettled(members: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, all_rows: int) -> DataFrame:
    """(a, b): verified links between different classes of one bucket, enough to join all that should be one.

    ``members`` has band, key, rep and class.  In a bucket of more than one class the
    members outside its largest class are compared with all members; those of the
    largest class are not compared with each other.  Both sides are dealt out in
    blocks of about ``BLOCK_BYTES`` of text, each pair of blocks to a task of its own.
    """
    held = texts.sparkSession.sparkContext.broadcast(idf)
    sized = members.join(texts.select("rep", F.octet_length("text").alias("size")), "rep")
    by_class = sized.groupBy("band", "key", "class").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    mixed = by_class.groupBy("band", "key").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "class", "size")).alias("major"), F.sum("size").alias("all"), F.sum("n").alias("members"))
    many = lambda size, n: F.greatest(F.ceil(size / BLOCK_BYTES + 1e-9), F.ceil(n / BLOCK_ROWS)).cast("int")
    lefts = many(F.col("all") - F.col("major.size"), F.col("members") - F.col("major.n"))
    blocks = mixed.where("classes > 1").select("band", "key", "members", F.col("major.class").alias("major"), many(F.col("all"), F.col("members")).alias("rights"), lefts.alias("lefts"))
    rows = in_buckets(members, materialise(blocks, "near-blocks"), "members", all_rows).withColumn("right", F.pmod(F.xxhash64("rep"), "rights").cast("int")).withColumn("left", F.when(F.col("class") != F.col("major"), F.pmod(F.xxhash64("rep"), "lefts").cast("int")))
    as_right = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).select("band", "key", "i", F.col("right").alias("j"), "rep", "class", F.lit(False).alias("is_left"))
    as_left = rows.where("left is not null").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).select("band", "key", F.col("left").alias("i"), "j", "rep", "class", F.lit(True).alias("is_left"))
    dealt = as_right.union(as_left).join(texts, "rep")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rep, group, is_left = (table[c].to_numpy() for c in ("rep", "class", "is_left"))
        h, whose, tf, n = shingles(table["text"].combine_chunks())
        w = weights(h, tf, held.value)
        total = np.bincount(whose, w, n)
        _, cell = np.unique(h, return_inverse=True)
        cut = np.searchsorted(whose, np.arange(n + 1))
        root = {int(g): int(g) for g in group}

        def top(g: int) -> int:
            while root[g] != g:
                root[g] = g = root[root[g]]
            return g

        now = group.copy()  # the class that each member is in by now
        mark = np.zeros(int(cell.max()) + 1 if len(cell) else 1)
        a, b = [], []
        for k in np.flatnonzero(is_left):
            open_to = ~is_left & (now != now[k])
            if not open_to.any():
                continue
            mine = slice(cut[k], cut[k + 1])
            mark[cell[mine]] = w[mine]
            shared = np.bincount(whose, np.minimum(mark[cell], w), n)
            mark[cell[mine]] = 0
            for m in np.flatnonzero(open_to & (shared >= threshold * (total + total[k] - shared)) & (shared > 0)):
                if (x := top(int(group[k]))) != (y := top(int(group[m]))):
                    root[y] = x
                    now[now == y] = x
                    a.append(int(rep[k]))
                    b.append(int(rep[m]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("band", "key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest id of its group) and representative (whether it is that one), a row for each document.

    Null texts are empty; texts without words are copies of each other, a text of
    fewer than five words is one shingle.  Other columns are left behind, whatever their names.  Rows that repeat an id and its text are
    copies; of rows that share an id but not the text the class is that of the first
    to be found.  Null ids are left out, as nothing could refer to them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    reps, members = representatives(rows)
    table, n = document_frequencies(rows)
    idf = idf_cells(table, n)
    # Signatures are taken of every row and then kept for one row a text: ids are shuffled, not texts.
    signed = materialise(signatures(rows.withColumnRenamed("doc_id", "rep"), idf).join(reps, "rep", "left_semi").dropDuplicates(["rep"]), "near-codes")
    dealt = materialise(buckets(signed), "near-buckets")
    shared = materialise(met(dealt), "near-shared")
    stars = shared.where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    involved = materialise(rows.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "text"), "near-texts")
    links = materialise(verified(stars, involved, idf, threshold), "near-links")
    classes = components(links)
    placed = shared.select("band", "key", "rep").join(classes, F.col("rep") == F.col("node"), "left").select("band", "key", "rep", F.coalesce("class", "rep").alias("class"))
    more = materialise(_unsettled(materialise(placed, "near-placed"), involved, idf, threshold, dealt.count()), "near-more")
    if not more.isEmpty():
        classes = components(links.union(more))
    out = members.join(classes, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("class", "rep").alias("class_id"))
    return out.withColumn("representative", F.col("doc_id") == F.col("class_id"))


def keep_representatives(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document represents its group, once for each document.

    Of rows that share an id the one whose text has the smallest hash stays, the same in
    every run.  Rows without an id represent no group and are left out.
    """
    chosen = groups.where("representative").select(F.col("doc_id").alias("__chosen")).distinct()
    kept = docs.join(chosen, F.col(id_col) == F.col("__chosen"), "left_semi")
    first = F.min(F.struct(F.xxhash64(F.col(text)).alias("h"), F.struct(*(F.col(c) for c in docs.columns)).alias("row")))
    return kept.groupBy(F.col(id_col).alias("__id")).agg(first.alias("x")).select("x.row.*")

