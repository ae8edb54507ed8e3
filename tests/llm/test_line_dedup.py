"""Line dedup through its filters: arrivals, repeated ids, growing shards, and sequences of insertions and deletions."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from folioscan.llm import line_dedup
from tests.llm.test_operators import SMALL, brute_lines

INDEX = line_dedup.LineIndex


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def counts(index):
    return sorted((bytes(r.key), r.n_docs, r.first_doc) for r in index.refs.collect())


def lines_of(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def brute(rows):
    return sorted(brute_lines(rows), key=repr)


def tags(index):
    return sum(t.count for r in index.filters.collect() for t in line_dedup.pickle.loads(r.tables))


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_arrivals_equal_one_insertion(spark, rows):
    docs = frame(spark, [*rows, (None, None), (None, rows[0][1]), (7, rows[1][1])])
    whole = INDEX.empty(spark).insert(docs)
    for arrivals in (1, 2, 5):
        index = INDEX.build(docs, arrivals=arrivals)
        assert counts(index) == counts(whole) and tags(index) == len(counts(whole))
        assert lines_of(line_dedup.dedup_lines(docs, index)) == lines_of(line_dedup.dedup_lines(docs, whole))
    assert INDEX.build(docs.limit(0)).refs.count() == 0 and line_dedup.dedup_lines(docs.limit(0), INDEX.build(docs.limit(0))).count() == 0


def test_a_repeat_is_found_because_a_filter_knows_it(spark, rows):
    docs = frame(spark, rows)
    first, second = (docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k) for k in (0, 1))
    index = INDEX.empty(spark).insert(first)
    whole = lines_of(line_dedup.dedup_lines(docs, index.insert(second)))
    assert whole == brute(rows)
    # Without what the filters hold, lines of the first arrival are taken for new in the second.
    forgotten = dataclasses.replace(index, filters=index.filters.limit(0)).insert(second)
    assert sum(r[3] for r in lines_of(line_dedup.dedup_lines(docs, forgotten))) < sum(r[3] for r in whole)


def test_sequences_equal_a_rebuild(spark, rows):
    rng = random.Random(3)
    index, inside = INDEX.empty(spark), {}
    for step in range(4):
        batch = {i: t for i, t in rng.sample(rows, 60) if i not in inside}
        index = index.insert(frame(spark, list(batch.items())))
        inside |= batch
        if step % 2:
            gone = rng.sample(sorted(inside), 40)
            index = index.remove(frame(spark, [(i, None) for i in [*gone, gone[0], -1]]))
            inside = {i: t for i, t in inside.items() if i not in gone}
        docs = frame(spark, list(inside.items()))
        assert counts(index) == counts(INDEX.build(docs))
        assert lines_of(line_dedup.dedup_lines(docs, index)) == brute(inside.items())
    empty = index.remove(frame(spark, [(i, None) for i in inside]))
    assert counts(empty) == []
    again = empty.insert(frame(spark, rows))
    assert counts(again) == counts(INDEX.build(frame(spark, rows)))


def test_an_id_may_be_inserted_again(spark):
    one, two = "a line that comes back", "another line of some length"
    index = INDEX.empty(spark).insert(frame(spark, [(1, one), (2, f"{one}\n{two}"), (None, two)]))
    index = index.insert(frame(spark, [(1, f"{two}\n{one}"), (2, one), (None, two)]))
    assert sorted(r[1:] for r in counts(index)) == [(2, 1), (3, 1)]
    assert sorted(r[1:] for r in counts(index.remove(frame(spark, [(1, None)])))) == [(1, 2), (2, 2)]
    assert counts(index.remove(frame(spark, [(1, None), (2, None), (None, None)]))) == []


def test_shards_split_as_the_index_grows(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 100)
    index, sizes = INDEX.empty(spark), []
    for k in range(4):
        index = index.insert(frame(spark, rows[50 * k : 50 * k + 50]))
        sizes.append(index.shards)
    assert sizes[0] < sizes[-1] and index.filters.count() <= index.shards
    assert max(sum(t.count for t in line_dedup.pickle.loads(r.tables)) for r in index.filters.collect()) < 400
    assert lines_of(line_dedup.dedup_lines(frame(spark, rows), index)) == brute(rows)
