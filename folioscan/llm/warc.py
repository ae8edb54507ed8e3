"""WARC archives (operator 1): writing, and reading by boundary-chain verification.

Writing: records with equal payloads share one response; the others become revisit
records that refer to it.  Each record is a gzip member of its own (or plain).

Reading: archives are dealt out as byte ranges.  A task finds every place in its
range that looks like the start of a record (a *candidate*) and works out where the
record after it would start (its *successor*).  Magic bytes inside a payload make
candidates too, and their successors may even look sound, so a candidate counts only
if it can be reached from the start of the file: chains are contracted within each
range, and pointer jumping over the remaining links, which doubles its stride each
round, finds where the true chain enters each range.  A range of a file therefore
never waits for the ranges before it, however long the file, and ranges are dealt out
to as many tasks as their number asks for, not as the size of their names does.

A record is unpacked in pieces and against the length that its header declares, so a
member that swells beyond it is given up early; while boundaries are sought nothing of
a payload is held, and when records are read no more than ``MAX_BLOCK`` bytes of one.

Files are opened with ``pyarrow.fs``.  Each attempt of a writing task has names of its
own in a folder that readers pass over; only the files of the attempts that Spark
commits are moved to the folder the caller names, so a task that is repeated, or runs
twice at once, leaves no record out and none twice.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import bounded, materialise

#: RFC 4648 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SPLIT_BYTES = 8 << 20
FILE_BYTES = 256 << 20
#: Below the archives' folder; Spark's readers pass over names that begin with an underscore.
PENDING = "_pending"
_READ = 256 << 10
_GZIP = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
_PLAIN = re.compile(rb"WARC/1\.[01]\r\n")
_HEADER_LIMIT = 1 << 20
#: Largest block of a record that is read into a row; the row of a larger one has no payload.
MAX_BLOCK = 1 << 30
#: Tasks that equal payloads are dealt among when their first page is looked up.
SALTS = 16
#: Ranges that a task reads one after another, once there are more than ``MOST_TASKS``.
MOST_TASKS = 50_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload)
    digits = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def assign_records(pages: DataFrame, id_col: str, uri_col: str, payload: Column, min_bytes: int) -> DataFrame:
    """page_id, uri, payload, digest, refers_to; the last is null for a response."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", base32_sha1(F.col("payload")))
    # Narrow rows only, combined before the shuffle; just the repeated payloads come back.
    heads = (
        base.where(F.octet_length("payload") >= min_bytes)
        .groupBy(F.col("digest").alias("head"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select("head", "first_id")
    )
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))
    # One payload may be a third of all rows: its rows meet their head in several places.
    heads = heads.withColumn("head_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    base = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "uri"), F.lit(SALTS)).cast("int"))
    return base.join(heads, (F.col("digest") == F.col("head")) & (F.col("salt") == F.col("head_salt")) & (F.octet_length("payload") >= min_bytes), "left").select(
        "page_id", "uri", "payload", "digest", F.when(later, F.col("first_id")).alias("refers_to")
    )


def _record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, compress: bool = True, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives below ``root``; a row (file, n_bytes, n_records) for each.

    Null payloads are empty ones, null addresses leave the header out, null ids never
    head a group of equal payloads unless nothing else does (then all are responses).
    Rows that repeat the smallest id of their group are responses as well.  Other
    columns are left behind, whatever their names.  An empty table writes no file.
    """
    spark = pages.sparkSession
    pending = f"{root}/{PENDING}"
    where = spark._jvm.org.apache.hadoop.fs.Path(pending)
    store_of_all = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store_of_all.mkdirs(where)
    records = assign_records(pages, id_col, uri_col, F.col(payload_col), min_bytes)
    suffix = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(pending)
        attempt = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, name, n_files, n_bytes, n_records = None, "", 0, 0, 0
        for batch in bounded(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{attempt}-{n_files:04d}{suffix}"
                    out, n_files, n_bytes, n_records = store.open_output_stream(f"{base}/{name}", compression=None), n_files + 1, 0, 0
                data = _record(*row, date)
                if compress:
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                out.write(data)
                n_bytes, n_records = n_bytes + len(data), n_records + 1
                if n_bytes >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": [n_bytes], "n_records": [n_records]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": [n_bytes], "n_records": [n_records]})

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in bounded(batches):
            for name in batch.column(0).to_pylist():
                try:
                    store.move(f"{base}/{PENDING}/{name}", f"{base}/{name}")
                except OSError:
                    # An earlier attempt has moved it: it must be there.
                    if store.get_file_info(f"{base}/{name}").type != fs.FileType.File:
                        raise
            yield batch

    schema = "file string, n_bytes long, n_records long"
    written = materialise(records.mapInArrow(run, schema), "warc-written")
    published = materialise(written.mapInArrow(publish, schema), "warc-files")
    store_of_all.delete(where, True)
    return published


class _File:
    """Reads on from any place of a file, keeping a window of it."""

    def __init__(self, path: str, length: int):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        self.file, self.length, self.path = store.open_input_file(name), length, path
        self.base, self.window = 0, b""

    def hold(self, start: int, end: int) -> None:
        self.base, self.window = start, self.read(start, end)

    def read(self, start: int, end: int) -> bytes:
        end = min(end, self.length)
        if self.base <= start and end <= self.base + len(self.window):
            return self.window[start - self.base : end - self.base]
        return self.file.read_at(end - start, start) if end > start else b""

    def unpacked(self, at: int) -> Iterator[tuple[bytes, int | None]]:
        """The gzip member at an offset in pieces of at most ``_READ`` bytes; the last comes with the place where the member ends.

        Nothing follows the piece at which the member turns out to be cut or no member.
        """
        engine, place, rest = zlib.decompressobj(31), at, b""
        try:
            while not engine.eof:
                if not rest:
                    rest = self.read(place, min(place + _READ, self.length))
                    place += len(rest)
                piece = engine.decompress(rest, _READ)
                if not rest and not piece:
                    return
                rest = engine.unconsumed_tail
                yield piece, place - len(engine.unused_data) if engine.eof else None
        except zlib.error:
            return

    def plain(self, at: int) -> Iterator[tuple[bytes, int | None]]:
        """The file from an offset on in pieces that grow to ``_READ`` bytes."""
        size = 4096
        while data := self.read(at, min(at + size, self.length)):
            yield data, None
            at, size = at + len(data), min(4 * size, _READ)

    def header(self, pieces: Iterator[tuple[bytes, int | None]]) -> tuple[bytes, bytes, int | None] | None:
        """A record's header, what has been read behind it, and where its member ends if that is known."""
        data, after = b"", None
        for piece, after in pieces:
            data += piece
            if not b"WARC/1.".startswith(data[:7]):
                return None
            if (end := data.find(b"\r\n\r\n")) >= 0:
                return (data[: end + 4], data[end + 4 :], after) if _PLAIN.match(data) else None
            if len(data) > _HEADER_LIMIT:
                return None
        return None

    def record(self, at: int, packed: bool, most: int) -> tuple[dict[str, str], bytes | None, int] | None:
        """Headers, block and successor of the record at an offset; None if it is none.

        A block of more than ``most`` bytes is checked and passed over: None stands for it.
        """
        pieces = self.unpacked(at) if packed else self.plain(at)
        if (got := self.header(pieces)) is None:
            return None
        head, data, after = got
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}
        if not (digits := fields.get("content-length", "")).isdigit() or len(digits) > 18:
            return None
        size = int(digits)
        if not packed:
            after = at + len(head) + size + 4
            if after > self.length or self.read(after - 4, after) != b"\r\n\r\n":
                return None
            return fields, self.read(at + len(head), after - 4) if size <= most else None, after
        held, seen, tail = [data], len(data), data[-4:]
        while after is None and seen <= size + 4:
            if (following := next(pieces, None)) is None:
                return None
            piece, after = following
            seen, tail = seen + len(piece), (tail + piece)[-4:]
            if size <= most:
                held.append(piece)
        if after is None or seen != size + 4 or tail != b"\r\n\r\n":
            return None
        return fields, b"".join(held)[:size] if size <= most else None, after


def _ranges(spark: SparkSession, root: str, split_bytes: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(root).select("path", "length")
    return files.where("length > 0").withColumn("start", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")))


def _spread(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows of a few bytes that stand for megabytes each, a task to each as far as there are tasks."""
    return rows.repartition(max(1, min(n, MOST_TASKS)), *by)


def candidates(spark: SparkSession, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, length, offset, successor, leaves): each sound-looking record start, and where its chain leaves its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed, end = path.endswith(".gz"), min(start + split_bytes, length)
                file = _File(path, length)
                file.hold(start, min(length, end + 16))
                found = [start + m.start() for m in (_GZIP if packed else _PLAIN).finditer(file.window) if start + m.start() < end]
                pairs = [(at, got[2]) for at in found if (got := file.record(at, packed, -1))]
                leaves: dict[int, int] = {}
                for at, after in reversed(pairs):
                    leaves[at] = leaves.get(after, after)
                yield pa.RecordBatch.from_pydict(
                    {"path": pa.array([path] * len(pairs), pa.string()), "length": pa.array([length] * len(pairs), pa.int64()), "offset": pa.array([p[0] for p in pairs], pa.int64()), "successor": pa.array([p[1] for p in pairs], pa.int64()), "leaves": pa.array([leaves[p[0]] for p in pairs], pa.int64())}
                )

    ranges = _ranges(spark, root, split_bytes)
    dealt = _spread(ranges, ranges.count(), "path", "start")
    return dealt.mapInArrow(run, "path string, length long, offset long, successor long, leaves long")


def entries(found: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, length, at): where the chain from the start of each file enters each of its ranges.

    Pointer jumping: after round r every link spans 2**r ranges, so the number of
    rounds is the logarithm of the ranges of the longest file.
    """
    jump = found.select("path", "length", F.col("offset").alias("at"), F.col("leaves").alias("to"))
    reached = jump.where("at = 0").select("path", "length", "at")
    most = found.agg(F.max("length")).first()[0] or 0
    for _ in range(math.ceil(math.log2(max(1, -(-most // split_bytes))))):
        step = jump.select("path", "at", "to")
        further = reached.join(step.hint("merge"), ["path", "at"]).where("to < length").select("path", "length", F.col("to").alias("at"))
        next_step = step.select("path", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = materialise(jump.join(next_step.hint("merge"), ["path", "to"], "left").select("path", "length", "at", F.coalesce("beyond", "to").alias("to")), "warc-jump")
        reached = materialise(reached.union(further).join(jump.select("path", "at").hint("merge"), ["path", "at"], "left_semi").select("path", "length", "at").distinct(), "warc-reached")
    return reached


def read_archives(spark: SparkSession, root: str, split_bytes: int = SPLIT_BYTES, max_block: int = MAX_BLOCK) -> DataFrame:
    """A row for each record that the chain from the start of its file reaches.

    path, offset, record_type, page_id, uri, refers_to, payload_digest (of the
    header), payload_bytes (of the HTTP header), payload (null for revisits, and for
    records whose block has more than ``max_block`` bytes; payload_bytes is then the
    block's).  A null address or id of a page comes back as null.  A damaged record, or
    one that does not unpack to the length it declares, ends its file's chain; what lies
    behind it is not returned.
    """
    found = materialise(candidates(spark, root, split_bytes), "warc-candidates")
    reached = materialise(entries(found, split_bytes), "warc-entries")
    begin = _spread(reached, reached.count(), "path", "at")
    names = ["path", "offset", "record_type", "page_id", "uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()], strict=True)))

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(digits) if re.fullmatch(r"-?\d{1,18}", digits) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for path, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed, end = path.endswith(".gz"), min(length, (at // split_bytes + 1) * split_bytes)
                file = _File(path, length)
                file.hold(at, end)
                rows, size = [], 0
                while at < end and (got := file.record(at, packed, max_block)):
                    fields, block, after = got
                    http, _, payload = (block or b"").partition(b"\r\n\r\n")
                    told = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})\s*(?:\r|$)", http)
                    n_bytes = int(told[1]) if told else int(fields["content-length"]) if block is None else len(payload)
                    kind, uri = fields.get("warc-type"), fields.get("warc-target-uri")
                    uri = uri and uri.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                    refers = number(fields.get("warc-refers-to"))
                    rows.append((path, at, kind, number(fields.get("warc-record-id")), uri, refers, fields.get("warc-payload-digest", "").removeprefix("sha1:"), n_bytes, None if kind == "revisit" or block is None else payload))
                    size += len(payload)
                    at = after
                    if size > 2 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return begin.mapInArrow(run, "path string, offset long, record_type string, page_id long, uri string, refers_to long, payload_digest string, payload_bytes long, payload binary")
