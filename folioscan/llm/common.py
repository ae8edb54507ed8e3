"""Shared plumbing of the training-data operators.

* ``materialise`` cuts lineage through Parquet in the folder that the cluster names in
  ``spark.checkpoint.dir``; nothing is kept in a folder that only one machine sees, so
  a lost executor costs a re-read and not a failed job.
* ``bounded`` cuts what crosses into Python into slices of bounded bytes, so the working
  memory of a task does not depend on how long the texts are on average.  The session's
  own limits on Arrow batches stay as the user set them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.sources.shared import checkpoint_root, shared_dir

__all__ = ["bounded", "checkpoint_root", "held_out", "load", "materialise", "shared_dir", "text_digest", "texts_of", "written"]

BATCH_BYTES = 2 << 20
BATCH_ROWS = 4096


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> str:
    """Where ``df`` has been written in the shared folder, as Parquet."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: one computation, short lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def bounded(batches: Iterator[pa.RecordBatch], batch_bytes: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``batch_bytes`` of text and at most ``rows`` rows, without empty ones; no row is cut."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                size += pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64)
        upto, start = np.cumsum(size), 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = min(max(int(np.searchsorted(upto, before + batch_bytes, "right")), start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def texts_of(column: pa.Array) -> pa.Array:
    """Null texts become empty ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null("") if column.null_count else column


def held_out(doc_id: Column) -> Column:
    """The fold rule: crc32 of the id as text, remainder 2 of 4, is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
