"""Progressive delivery: pages arrive as files, hits are counted as they come."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def page_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deliver(pages: DataFrame, n_hits: Column, out: str, checkpoint: str) -> None:
    """Writes (doc_id, page, n_hits) of each page as it arrives; a restart goes on behind the last page it wrote."""
    rows = pages.select("doc_id", "page", n_hits.cast("long").alias("n_hits"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cumulative(delivered: DataFrame) -> DataFrame:
    """Adds ``total``: a document's hits up to each page."""
    return delivered.dropDuplicates(["doc_id", "page"]).withColumn("total", F.sum("n_hits").over(Window.partitionBy("doc_id").orderBy("page")))


def progress(delivered: DataFrame) -> DataFrame:
    """(doc_id, page, done, pages, n_hits, total) for pages (doc_id, page, n_hits): what a reader is told when each is completed, the first time."""
    rows = delivered.dropDuplicates(["doc_id", "page"])
    run, whole = Window.partitionBy("doc_id").orderBy("page"), Window.partitionBy("doc_id")
    return rows.select("doc_id", "page", F.row_number().over(run).cast("long").alias("done"), F.count(F.lit(1)).over(whole).alias("pages"), "n_hits", F.sum("n_hits").over(run).alias("total"))


@contextlib.contextmanager
def request(spark: SparkSession, document: str) -> Iterator[None]:
    """What runs inside belongs to a document's request; a new request for it ends the jobs of the one before."""
    context, tag = spark.sparkContext, f"folioscan-{document}"
    cancel(spark, document)
    context.addJobTag(tag)
    try:
        yield
    finally:
        context.removeJobTag(tag)


def cancel(spark: SparkSession, document: str) -> None:
    """Ends the running jobs of a document's request; other requests go on."""
    spark.sparkContext.cancelJobsWithTag(f"folioscan-{document}")
