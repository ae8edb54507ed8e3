"""Reversible line dedup (operator 3): sharded cuckoo filters over exact reference counts.

An index holds, as Parquet tables in the shared folder,

* ``postings``  (key, doc_id, places): which documents hold a line, and where;
* ``refs``      (key, n_docs, first_doc): the exact reference counts;
* ``filters``   (shard, tables): for each shard of the key space, cuckoo filters of
  the keys it holds.

Inserting a batch routes its distinct keys, counted before the shuffle, to their
shards.  A key that no filter of the shard knows is certainly new: its counts are
appended without a look at the old table.  Only keys that a filter may know are
added to it there; those that the table does not hold after all get tags as well, so
that each key owns one.  Deleting documents lowers the counts, and a key that reaches zero
leaves both the table and its filter, so every insertion can be taken back.
Once the keys outgrow their shards there are more shards, with filters made anew from
the exact table, so neither a shard's keys nor its filters grow with the index.
Each change gives a new index; the tables of the old one stay valid.

``LineIndex.build`` makes an index of a whole table out of arrivals, document by
document: from the second on, a line is found to be a repeat because a filter knows it.
"""

from __future__ import annotations

import dataclasses
import math
import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import vec
from folioscan.llm.common import materialise
from folioscan.llm.vec import U64

SHARD_KEYS = 500_000
#: Batches that a whole table is inserted in.
ARRIVALS = 2
MIN_CHARS = 10
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cuckoo:
    """A cuckoo filter: 4 slots of 16-bit tags a bucket; inserts and look-ups go by whole arrays."""

    SLOTS = 4

    def __init__(self, capacity: int):
        buckets = 1 << max(1, math.ceil(math.log2(max(1, capacity) / (self.SLOTS * 0.84))))
        self.tags = np.zeros((buckets, self.SLOTS), np.uint16)
        self.count, self.capacity = 0, int(buckets * self.SLOTS * 0.84)

    def _where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tag = ((hashes >> U64(48)) % U64(65535) + U64(1)).astype(np.uint16)
        return tag, (hashes & U64(len(self.tags) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return bucket ^ (vec.mix(tag.astype(U64)) & U64(len(self.tags) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        tag, bucket = self._where(hashes)
        return (self.tags[bucket] == tag[:, None]).any(1) | (self.tags[self._other(bucket, tag)] == tag[:, None]).any(1)

    def copies(self, hashes: np.ndarray) -> np.ndarray:
        """How many tags each key finds as its own."""
        tag, bucket = self._where(hashes)
        other = self._other(bucket, tag)
        return (self.tags[bucket] == tag[:, None]).sum(1) + np.where(other == bucket, 0, (self.tags[other] == tag[:, None]).sum(1))

    def _place(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Puts tags into free slots; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.tags[b] == 0
        fits = rank < free.sum(1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(b)), np.minimum(rank, self.SLOTS - 1)]
        self.tags[b[fits], slot[fits]] = tag[order][fits]
        placed = np.zeros(len(b), bool)
        placed[order[fits]] = True
        return placed

    def insert(self, hashes: np.ndarray) -> None:
        """Adds distinct keys; the caller keeps to ``capacity``."""
        tag, bucket = self._where(hashes)
        self.count += len(hashes)
        rng = np.random.default_rng(7)
        for _ in range(5000):
            left = ~self._place(bucket, tag)
            tag, bucket = tag[left], bucket[left]
            if len(tag):
                bucket = self._other(bucket, tag)
                left = ~self._place(bucket, tag)
                tag, bucket = tag[left], bucket[left]
            if not len(tag):
                return
            bucket = np.where(rng.random(len(bucket)) < 0.5, bucket, self._other(bucket, tag))
            _, one = np.unique(bucket, return_index=True)  # one eviction a bucket and round
            slot = rng.integers(0, self.SLOTS, len(one))
            out = self.tags[bucket[one], slot]
            self.tags[bucket[one], slot] = tag[one]
            tag[one], bucket[one] = out, self._other(bucket[one], out)
        raise RuntimeError("a cuckoo filter below its capacity found no place for a key")

    def remove(self, hashes: np.ndarray) -> None:
        """Takes out keys that are in the filter."""
        tag, bucket = self._where(hashes)
        other = self._other(bucket, tag)
        for t, *both in zip(tag, bucket, other, strict=True):
            for b in both:
                if (at := np.flatnonzero(self.tags[b] == t)).size:
                    self.tags[b, at[0]] = 0
                    self.count -= 1
                    break


def _tagged(tables: list[Cuckoo], hashes: np.ndarray) -> None:
    """One more tag for each key: in the last table, or in a new one if that is full or crowded with a key's own tag."""
    last = tables[-1] if tables else None
    if last is not None and last.count + len(hashes) <= last.capacity and (last.copies(hashes) < Cuckoo.SLOTS).all():
        last.insert(hashes)
    elif len(hashes):
        # Twice all that is held: the number of tables is the logarithm of their keys.
        tables.append(Cuckoo(2 * max(len(hashes), sum(t.count for t in tables))))
        tables[-1].insert(hashes)


def line_key(line: Column) -> Column:
    """Stripped of blanks at both ends, A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(BLANKS))
    # For lines of ASCII alone, lower() is the same and far cheaper.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _key_hash(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """64 bits of each 16-byte key."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return vec.mix(np.frombuffer(b"".join(keys.to_pylist()), "<u8")[::2].copy()) if len(keys) else np.zeros(0, U64)


def _pad(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


@dataclasses.dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS

    @staticmethod
    def empty(spark: SparkSession, min_chars: int = MIN_CHARS) -> LineIndex:
        return LineIndex(
            spark.createDataFrame([], "key binary, doc_id long, places array<struct<row:bigint,line:int>>"), spark.createDataFrame([], "key binary, n_docs long, first_doc long"), spark.createDataFrame([], "shard int, tables binary"), 0, min_chars
        )

    @staticmethod
    def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, arrivals: int = ARRIVALS) -> LineIndex:
        """The index of a whole table, inserted in ``arrivals`` batches by a hash of the id."""
        index = LineIndex.empty(docs.sparkSession, min_chars)
        postings = materialise(index._postings(docs, id_col, text).withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int")), "line-postings")
        for k in range(arrivals):
            index = index._added(postings.where(F.col("arrival") == k).drop("arrival"), False)
        return dataclasses.replace(index, postings=postings.drop("arrival"))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> LineIndex:
        """The index with the lines of more documents.

        Rows of an id that the index holds already add their lines to that document: it
        counts once for each line, and one ``remove`` takes out all of it.
        """
        return self._added(materialise(self._postings(docs, id_col, text), "line-postings"), bool(self.shards))

    def _postings(self, docs: DataFrame, id_col: str, text: str) -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row(F.col(text)).alias("row"), F.transform(_lines(F.col(text)), line_key).alias("keys"))
        keyed = F.filter(F.transform("keys", lambda k, i: F.struct(F.when(F.char_length(k) >= self.min_chars, F.unhex(F.md5(k))).alias("key"), i.alias("line"))), lambda s: s["key"].isNotNull())
        batch = rows.select("doc_id", "row", F.explode(keyed).alias("k")).select(F.col("k.key").alias("key"), "doc_id", F.struct("row", F.col("k.line").alias("line")).alias("place"))
        return batch.groupBy("key", "doc_id").agg(F.collect_set("place").alias("places"))

    def _added(self, batch: DataFrame, repeats: bool) -> LineIndex:
        """The index with the postings of a batch; ``repeats`` tells that its documents may be in the index."""
        counts = materialise(batch.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")), "line-counts")
        held, more = self.refs.count() if self.shards else 0, counts.count()
        shards, filters = self.shards, self.filters
        if held + more > 2 * SHARD_KEYS * shards:
            shards = max(1, -(-(held + more) // SHARD_KEYS))
            filters = self._filtered(self.refs, None, shards).where("tables is not null").select("shard", "tables") if held else None
        shards = max(1, shards)
        marked = self._filtered(counts, filters, shards)
        filters = marked.where("tables is not null").select("shard", "tables")
        new, known = (marked.where(f"key is not null and known = {x}").select("key", "n_docs", "first_doc") for x in ("false", "true"))
        if not self.shards:  # no filter knew anything
            return LineIndex(batch, new, filters, shards, self.min_chars)
        if repeats:
            match = F.col("old_doc").eqNullSafe(F.col("doc_id")) & (F.col("old_key") == F.col("key"))
            again = batch.join(known.select("key"), "key", "left_semi").join(self.postings.select(F.col("key").alias("old_key"), F.col("doc_id").alias("old_doc")), match, "left_semi")
            known = known.join(again.groupBy("key").agg(F.count(F.lit(1)).alias("again")), "key", "left").select("key", (F.col("n_docs") - F.coalesce("again", F.lit(0))).alias("n_docs"), "first_doc")
        both = self.refs.withColumn("old", F.lit(True)).unionByName(known.withColumn("old", F.lit(False)))
        looked_up = materialise(both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"), F.max("old").alias("old")), "line-refs")
        untagged = looked_up.where("not old")
        if not untagged.isEmpty():
            filters = LineIndex._owning(untagged, filters, shards)
        return LineIndex(self.postings.unionByName(batch), looked_up.drop("old").unionByName(new), filters, shards, self.min_chars)

    def _filtered(self, counts: DataFrame, filters: DataFrame | None, shards: int) -> DataFrame:
        """Each row of counts with ``known``: whether a filter of its shard may know the key; and (shard, tables) of the filters with the other keys added."""
        fields = [("key", pa.binary()), ("n_docs", pa.int64()), ("first_doc", pa.int64())]
        out = pa.schema([("shard", pa.int32()), *fields, ("known", pa.bool_()), ("tables", pa.binary())])

        def run(shard: int, old: list[Cuckoo], keys: pa.Table) -> pa.Table:
            hashes, n = _key_hash(keys["key"]), keys.num_rows
            known = np.zeros(n, bool)
            for table in old:
                known |= table.contains(hashes)
            _tagged(old, hashes[~known])
            rows = pa.table([pa.array([shard] * n, pa.int32()), *(keys[f].cast(t) for f, t in fields), pa.array(known), pa.nulls(n, pa.binary())], schema=out)
            return pa.concat_tables([rows, pa.table([pa.array([x], t) for x, t in zip([shard, None, None, None, None, pickle.dumps(old)], out.types, strict=True)], schema=out)])

        to_keys = _pad(counts.select(*(f for f, _ in fields)), shards).groupBy("shard")
        result = "shard int, key binary, n_docs long, first_doc long, known boolean, tables binary"
        if filters is None:
            done = to_keys.applyInArrow(lambda key, t: run(key[0].as_py(), [], t), result)
        else:

            def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
                old = pickle.loads(right["tables"][0].as_py()) if right.num_rows else []
                return run(key[0].as_py(), old, left)

            done = to_keys.cogroup(filters.groupBy("shard")).applyInArrow(both, result)
        return materialise(done, "line-filters")

    @staticmethod
    def _owning(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
        """The filters with tags of keys that looked known and are new."""

        def add(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            tables = pickle.loads(right["tables"][0].as_py()) if right.num_rows else []
            _tagged(tables, _key_hash(left["key"]))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tables": pa.array([pickle.dumps(tables)], pa.binary())})

        added = _pad(keys.select("key"), shards).groupBy("shard").cogroup(filters.groupBy("shard"))
        return materialise(added.applyInArrow(add, "shard int, tables binary"), "line-filters")

    def remove(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose ``doc_id`` is listed; ids that it does not hold, and repeated ones, change nothing."""
        ids = ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        match = F.col("doc_id").eqNullSafe(F.col("gone"))
        gone = materialise(self.postings.join(ids, match, "left_semi").groupBy("key").agg(F.count_distinct(F.struct("doc_id")).alias("less")), "line-gone")
        postings = materialise(self.postings.join(ids, match, "left_anti"), "line-postings")
        first = postings.join(gone, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("new_first"))
        changed = self.refs.join(gone, "key").join(first, "key", "left").select("key", (F.col("n_docs") - F.col("less")).alias("n_docs"), F.col("new_first").alias("first_doc"))
        changed = materialise(changed, "line-changed")
        refs = materialise(self.refs.join(gone, "key", "left_anti").unionByName(changed.where("n_docs > 0")), "line-refs")

        def drop(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            tables = pickle.loads(left["tables"][0].as_py()) if left.num_rows else []
            hashes = _key_hash(right["key"])
            held = [table.contains(hashes) for table in tables]
            # Where several tables have the tag, another key may own the one found: it stays, which costs a look-up only.
            sure = np.sum(held, axis=0) == 1 if held else np.zeros(len(hashes), bool)
            for table, inside in zip(tables, held, strict=True):
                table.remove(hashes[inside & sure])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tables": pa.array([pickle.dumps(tables)], pa.binary())})

        dead = _pad(changed.where("n_docs = 0").select("key"), self.shards or 1).groupBy("shard")
        filters = materialise(self.filters.groupBy("shard").cogroup(dead).applyInArrow(drop, "shard int, tables binary"), "line-filters")
        return LineIndex(postings, refs, filters, self.shards, self.min_chars)

    def dropped(self) -> DataFrame:
        """(doc_id, row, lines): the places of lines that a smaller document holds as well."""
        shared = self.refs.where("n_docs >= 2").select("key", "first_doc")
        losing = self.postings.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        return losing.select("doc_id", F.explode("places").alias("p")).groupBy("doc_id", F.col("p.row").alias("row")).agg(F.collect_set("p.line").alias("lines"))


def dedup_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text without the lines to drop, n_lines (before), n_dropped, and the columns to keep.

    ``docs`` are documents of the index.  Null and empty texts are one empty line.
    Rows with equal ids are one document: none of its lines is a repeat of another
    of its own.  A null id is a document of its own that any other precedes.
    """
    keep = [c for c in keep if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    lost = index.dropped().select(F.col("doc_id").alias("lost_doc"), F.col("row").alias("lost_row"), F.col("lines").alias("lost"))
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_doc")) & (_row(F.col("text")) == F.col("lost_row")), "left")
    lines = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n"))
    return joined.withColumn("__lines", lines).select(
        "doc_id", *keep, kept.alias("text"), F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped")
    )
