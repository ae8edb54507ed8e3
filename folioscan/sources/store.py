"""The stored page index: Parquet partitioned by version and source, looked up by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.model import VERSIONS

VERSION = f"v{VERSIONS['text']}.{VERSIONS['ocr_geometry']}.{VERSIONS['serialisation']}"


def save(index: DataFrame, path: str) -> None:
    """Replaces the partitions that it writes; another version's stay unread."""
    index.withColumn("version", F.lit(VERSION)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "source").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("version") == VERSION).drop("version")


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted pages (doc_id, page, source) that are not stored: what is left to extract."""
    return wanted.join(stored, ["doc_id", "page", "source"], "left_anti")


def preferred(index: DataFrame) -> DataFrame:
    """One index a page: the text layer where there is one."""
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.col("source").desc()))
    return index.withColumn("__n", first).where("__n = 1").drop("__n")


def victims(files: DataFrame, cap: int) -> DataFrame:
    """Stored files (name, size, mtime in milliseconds) that go, oldest first, until the rest fits below ``cap``.

    Running sums go over days, over the seconds of a day, and over the files of a
    second, so files never come together.  Files without a time are the oldest.
    """
    newest = lambda of, *by: Window.partitionBy(*of).orderBy(*(F.desc(c) for c in by)).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.col("mtime"), F.lit(-1))
    placed = files.withColumns({"__day": F.floor(at / 86_400_000), "__second": F.floor(at / 1000)})
    seconds = placed.groupBy("__day", "__second").agg(F.sum("size").alias("held"))
    days = seconds.groupBy("__day").agg(F.sum("held").alias("held"))
    before = lambda of, *by: F.coalesce(F.sum("held").over(newest(of, *by)), F.lit(0))
    days = days.select("__day", before([], "__day").alias("by_day"))
    seconds = seconds.select("__day", "__second", before(["__day"], "__second").alias("by_second"))
    rows = placed.join(days, "__day").join(seconds, ["__day", "__second"])
    newer = F.coalesce(F.sum("size").over(newest(["__second"], "mtime", "name")), F.lit(0))
    rows = rows.withColumn("__upto", F.col("by_day") + F.col("by_second") + newer + F.col("size"))
    return rows.where(F.col("__upto") > cap).select(*files.columns)


#: Longest string of a stored recognition, in bytes of UTF-8.
LONGEST = 2 << 20


def cut_long(text: Column, most: int = LONGEST) -> Column:
    """A string as a stored recognition holds it: nothing beyond ``most`` bytes, and no part of a character."""
    head = F.substring(text.cast("binary"), 1, most + 1)
    # A character that the cut goes through begins at most three bytes before it.
    lead = lambda k: F.conv(F.hex(F.substring(head, most + 1 - k, 1)), 16, 10).cast("int").bitwiseAND(0xC0) != 0x80
    whole = F.when(lead(0), most).when(lead(1), most - 1).when(lead(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(head, F.lit(1), whole), "UTF-8"))


def sealed(entries: DataFrame, version: str = VERSION) -> DataFrame:
    """Entries (key, payload) as they are stored: with format version, length and CRC-32 of key and payload."""
    body = F.concat(F.col("key").cast("binary"), F.lit(b"\0"), F.col("payload"))
    return entries.select("key", "payload", F.lit(version).alias("version"), F.octet_length(body).alias("size"), F.crc32(body).alias("crc"))


def unsealed(wanted: DataFrame, stored: DataFrame, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """(key, payload) of the wanted keys that are stored whole, and (key) of the misses.

    What fails its length or checksum, is of another version or under another key is a
    miss as if it were not there; of several sound copies any one is read.
    """
    body = F.concat(F.col("key").cast("binary"), F.lit(b"\0"), F.col("payload"))
    sound = stored.where((F.col("version") == version) & (F.octet_length(body) == F.col("size")) & (F.crc32(body) == F.col("crc"))).select("key", "payload").dropDuplicates(["key"])
    keys = wanted.select("key").distinct()
    return sound.join(keys, "key", "left_semi"), keys.join(sound.select("key"), "key", "left_anti")


def newest(files: DataFrame, most: int = 4) -> DataFrame:
    """The copies of source files (folder, name, mtime) that stay: the newest ``most`` of each folder."""
    order = Window.partitionBy("folder").orderBy(F.desc("mtime"), F.desc("name"))
    return files.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def held_bytes(files: DataFrame) -> DataFrame:
    """(folder, files, bytes) of a store's files (folder, size)."""
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def prepared(wanted: DataFrame, memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Wanted pages (doc_id, page) with ``blocks`` and ``cache_source``: from the first store that has them, else NONE and to be recognised."""
    key = ["doc_id", "page"]
    rows = wanted.join(memory.select(*key, F.col("blocks").alias("__memory")), key, "left").join(disk.select(*key, F.col("blocks").alias("__disk")), key, "left")
    source = F.when(F.col("__memory").isNotNull(), "MEMORY").when(F.col("__disk").isNotNull(), "DISK").otherwise("NONE")
    return rows.withColumns({"blocks": F.coalesce("__memory", "__disk"), "cache_source": source}).drop("__memory", "__disk")
