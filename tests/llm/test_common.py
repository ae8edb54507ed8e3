"""Slices of batches, and a session that operators leave as it was."""

import pyarrow as pa

from folioscan.llm import token_counts
from folioscan.llm.common import bounded
from folioscan.llm.queries import model_file


def test_slices_hold_bounded_bytes_and_all_rows():
    texts = ["a" * n for n in (1, 5, 50, 500, 2, 3, 0, 0, 7)] + [None]
    batch = pa.RecordBatch.from_pydict({"k": range(len(texts)), "t": pa.array(texts, pa.string()), "b": pa.array([b"xx"] * len(texts), pa.large_binary())})
    empty = batch.slice(0, 0)
    for limit, rows in ((10, 99), (60, 3), (1, 1), (10**6, 4)):
        got = list(bounded(iter([empty, batch, batch.slice(3, 4)]), limit, rows))
        assert [x for b in got for x in b.column(0).to_pylist()] == [*range(len(texts)), 3, 4, 5, 6]
        assert all(0 < b.num_rows <= rows and (b.num_rows == 1 or sum(len(t or "") + 2 for t in b.column(1).to_pylist()) <= limit) for b in got)


def test_operators_leave_the_session_alone(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    assert token_counts.count_tokens(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model_file()).count() == 1
    assert [spark.conf.get(n) for n in names] == before
