"""Decoders of the binary and float protocols that extractors and recognisers speak."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats.
PIX5, PIX5_VERSION = 0x50495835, 1
TEXT_MAGIC, BLOCK_MAGIC = -41001.0, -32001.0
MAX_PAGES, MAX_CHARS = 100_000, 5_000_000
NO_AREA = 0.0001
_CHAR = np.dtype([("code_point", "<i4"), ("src_idx", "<i4"), ("flags", "<i4"), ("reserved", "<i4"), ("l", "<f4"), ("b", "<f4"), ("r", "<f4"), ("t", "<f4")])
CHAR_PAGES = "array<struct<page:int,page_w:float,page_h:float,status:int,raw_chars:int,visible_chars:int,valid_boxes:int,text:string,n_boxed:int>>"


def pack_pages(pages: Sequence[dict]) -> bytes:
    """The counterpart of ``unpack_pages``: 16-byte header, 32-byte page and character records."""
    out = [struct.pack("<iiii", PIX5, PIX5_VERSION, len(pages), len(pages))]
    for p in pages:
        chars = np.zeros(len(p["chars"]), _CHAR)
        for i, (code, box) in enumerate(p["chars"]):
            chars[i] = (code, i, box is not None, 0, *(box or (0, 0, 0, 0)))
        out += [struct.pack("<iffiiiii", p["page"], p["page_w"], p["page_h"], p["status"], p["raw_chars"], p["visible_chars"], p["valid_boxes"], len(chars)), chars.tobytes()]
    return b"".join(out)


def unpack_pages(data: bytes | None) -> list[dict]:
    """The pages of a packed index; any defect gives none at all."""
    if data is None or len(data) < 16:
        return []
    magic, version, n_doc, n = struct.unpack_from("<iiii", data)
    if magic != PIX5 or version != PIX5_VERSION or not (0 <= n <= MAX_PAGES and 0 <= n_doc <= MAX_PAGES):
        return []
    pages, at = [], 16
    for _ in range(n):
        if at + 32 > len(data):
            return []
        page, w, h, status, raw, visible, boxes, size = struct.unpack_from("<iffiiiii", data, at)
        at += 32
        if not 0 <= size <= MAX_CHARS or at + 32 * size > len(data):
            return []
        chars = np.frombuffer(data, _CHAR, size, at)
        at += 32 * size
        good = chars["code_point"][(chars["code_point"] > 0) & (chars["code_point"] < 0x110000)]
        text = "".join(map(chr, good.tolist()))
        pages.append({"page": page, "page_w": w, "page_h": h, "status": status, "raw_chars": raw, "visible_chars": visible, "valid_boxes": boxes, "text": text, "n_boxed": int((chars["flags"] & 1).sum())})
    return pages


def decode_pages(column: Column) -> Column:
    @F.pandas_udf(CHAR_PAGES)
    def run(data: pd.Series) -> pd.Series:
        return data.map(unpack_pages)

    return run(column)


class _Cut(Exception):
    """The values end within a record."""


class _Values:
    """Numbers of a packed report, taken from the front."""

    def __init__(self, values: Sequence[float] | None, at: int = 0):
        self.v, self.at = np.asarray(values if values is not None else [], float), at

    def left(self) -> int:
        return len(self.v) - self.at

    def take(self, n: int) -> np.ndarray:
        if n > self.left():
            raise _Cut
        self.at += n
        return self.v[self.at - n : self.at]

    @staticmethod
    def count(x: float) -> int:
        """The nearest whole number that is not negative; 0 for what is no number."""
        return max(0, math.floor(x + 0.5)) if np.isfinite(x) else 0

    @staticmethod
    def whole(x: float) -> int:
        return int(x) if np.isfinite(x) else 0


def unpack_report(values: Sequence[float] | None) -> dict:
    """n_pages, ``pages`` (page, size, status, counts, n_matches) and ``rects`` of the float protocol of matches.

    A cut match ends the reading behind its page's record; rectangles that are not
    finite or have no area go, swapped edges are put right.
    """
    out: dict = {"n_pages": 0, "pages": [], "rects": []}
    v = _Values(values)
    if v.left() < 4 or v.v[0] != TEXT_MAGIC or v.count(v.v[1]) != 1:
        return out
    _, _, n_pages, n = v.take(4)
    out["n_pages"] = v.count(n_pages)
    for _ in range(min(v.count(n), v.left() // 8)):
        if v.left() < 8:
            break
        page, w, h, *rest = v.take(8)
        status, raw, visible, boxes, declared = map(v.count, rest)
        row = {"page": v.count(page), "page_w": w, "page_h": h, "status": status, "raw_chars": raw, "visible_chars": visible, "valid_boxes": boxes, "n_matches": 0}
        out["pages"].append(row)
        try:
            for _ in range(declared):
                ordinal, start, length, n_rects = map(v.count, v.take(4))
                sides = v.take(4 * n_rects).reshape(-1, 4)
                good = sides[np.isfinite(sides).all(1) & (np.abs(sides[:, 2] - sides[:, 0]) > NO_AREA) & (np.abs(sides[:, 3] - sides[:, 1]) > NO_AREA)]
                row["n_matches"] += bool(len(good))
                for x0, y0, x1, y1 in good.tolist():
                    out["rects"].append({"page": row["page"], "ordinal": ordinal, "start": start, "length": length, "l": min(x0, x1), "b": min(y0, y1), "r": max(x0, x1), "t": max(y0, y1)})
        except _Cut:
            break
    return out


def unpack_matches(values: Sequence[float] | None) -> list[dict]:
    """The rectangles of ``unpack_report``."""
    return unpack_report(values)["rects"]


REPORT = "struct<n_pages:int,pages:array<struct<page:int,page_w:double,page_h:double,status:int,raw_chars:int,visible_chars:int,valid_boxes:int,n_matches:int>>,rects:array<struct<page:int,ordinal:int,start:int,length:int,l:double,b:double,r:double,t:double>>>"
BLOCKS = "array<struct<text:string,l:double,t:double,r:double,b:double,score:double,quad:array<double>,token_boxes:array<struct<l:double,t:double,r:double,b:double>>,begins:array<int>,ends:array<int>>>"


def _words(dictionary: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words, their sizes and their first characters by their numbers; the last is for numbers of no word."""
    words = [*dictionary, ""]
    return words, np.array([*map(len, words)]), np.array([ord(w[0]) if w else 0 for w in words], "<u4")


def _blocks(values: Sequence[float] | None, dictionary: tuple[list[str], np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """The blocks of ``unpack_blocks``: (text, l, t, r, b, score), the words' numbers, quad, boxes as they were told, and ends."""
    v, version = _Values(values), 1
    known, sizes, first = dictionary
    if v.left() >= 2 and abs(v.v[0] - BLOCK_MAGIC) < 0.01:
        version = max(1, v.whole(v.take(2)[1]))
    try:
        while v.left():
            n_points, n_words, score, *more = v.take(4 if version >= 2 else 3).tolist()
            n_points, n_words, n_boxes = v.whole(n_points), v.whole(n_words), v.whole(more[0]) if more else 0
            if n_points <= 0 or n_words < 0 or n_boxes < 0:
                break
            points = v.take(2 * n_points)
            told = v.take(n_words)
            if not np.isfinite(told).all():
                told = np.where(np.isfinite(told), told, 0)
            told = np.minimum(np.maximum(told, -1), len(known) - 1).astype(np.int64)
            boxes = v.take(4 * n_boxes)
            v.take(2)  # the orientation's label and score
            size = sizes[told]
            text = first[told].tobytes().decode("utf-32-le") if (size == 1).all() else "".join(map(known.__getitem__, told.tolist()))
            (left, top), (right, bottom) = (f(points.reshape(-1, 2), axis=0).tolist() for f in (np.min, np.max))
            if text.strip(_UNTOLD) and right > left and bottom > top:
                sure = n_boxes == n_words > 0
                yield (text, left, top, right, bottom, score), told, points if n_points == 4 else None, boxes if sure else None, np.cumsum(size) if sure else None
    except _Cut:
        pass


def unpack_blocks(values: Sequence[float] | None, dictionary: Sequence[str]) -> list[dict]:
    """Recognised blocks of versions 1 and 2; a cut block ends the reading, blank ones and those without area go.

    text, l, t, r, b, score, words, and where they are told: quad (four corners), boxes
    (four ratios a word) with the words' begins and ends in the text.
    """
    listed = lambda x: None if x is None else x.tolist()
    known, out = _words(dictionary), []
    for facts, told, quad, boxes, ends in _blocks(values, known):
        row = dict(zip(("text", "l", "t", "r", "b", "score"), facts, strict=True))
        ends = listed(ends)
        out.append(row | {"words": [known[0][i] for i in told.tolist()], "quad": listed(quad), "boxes": None if boxes is None else np.clip(boxes, 0, 1).tolist(), "begins": ends and [0, *ends[:-1]], "ends": ends})
    return out


def decode_reports(column: Column) -> Column:
    """``unpack_report`` of an array of numbers; null gives an empty report."""

    @F.pandas_udf(REPORT.removeprefix("struct<").removesuffix(">"))
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unpack_report(v) for v in values], columns=["n_pages", "pages", "rects"])

    return run(column)


_SIDES = pa.struct([(k, pa.float64()) for k in "ltrb"])
_OFFSETS = pa.list_(pa.int32())
_BLOCK = pa.struct([("text", pa.string()), *((k, pa.float64()) for k in ("l", "t", "r", "b", "score")), ("quad", pa.list_(pa.float64())), ("token_boxes", pa.list_(_SIDES)), ("begins", _OFFSETS), ("ends", _OFFSETS)])
#: What a text may have besides anything to read.
_UNTOLD = "".join(map(chr, range(33)))
#: Pages that are decoded at a time.
BLOCK_ROWS = 64


def block_rows(values: pa.Array, dictionary: Sequence[str]) -> pa.Array:
    """``unpack_blocks`` of an array of arrays of numbers, as ``assembly.index_of_blocks`` takes them; null gives no blocks."""
    known = _words(dictionary)
    pages = [list(_blocks(v.values.to_numpy(zero_copy_only=False) if v.is_valid else None, known)) for v in values]
    facts, _, quads, boxes, ends = zip(*(b for page in pages for b in page), strict=True) if any(pages) else [()] * 5

    def lists(parts: Sequence[np.ndarray | None], of: Callable[[np.ndarray], pa.Array], size: int = 1) -> pa.ListArray:
        cut = np.cumsum([0, *(0 if x is None else len(x) // size for x in parts)])
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), of(np.concatenate([np.zeros(0), *(x for x in parts if x is not None)])), mask=pa.array([x is None for x in parts], pa.bool_()))

    def in_line(x: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(np.clip(x[k::4], 0, 1)) for k in range(4)], fields=list(_SIDES))

    numbers, offsets = pa.array, lambda x: pa.array(x.astype(np.int32))
    begins = [None if x is None else np.concatenate([[0], x[:-1]]) for x in ends]
    columns = [*(pa.array([f[k] for f in facts], _BLOCK[k].type) for k in range(6)), lists(quads, numbers), lists(boxes, in_line, 4), lists(begins, offsets), lists(ends, offsets)]
    cut = pa.array(np.cumsum([0, *map(len, pages)]), pa.int32())
    return pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(columns, fields=list(_BLOCK)))


def decode_blocks(column: Column, dictionary: Sequence[str]) -> Column:
    """``block_rows`` of a column, a few pages at a time."""

    @F.arrow_udf(BLOCKS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for at in range(0, len(values), BLOCK_ROWS):
                yield block_rows(values.slice(at, BLOCK_ROWS), dictionary)

    return run(column)


def legacy_rects(values: Column) -> Column:
    """Seven numbers a rectangle, as an array of arrays; what is left over goes."""
    n = F.floor(F.size(values) / 7).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * 7 + 1, F.lit(7)))).otherwise(F.array())


def load_dictionary(spark: SparkSession, path: str) -> list[str]:
    """A recogniser's tokens by their ids: 'blank', the lines of a text file in order, and a space.  A model's file, of thousands of lines."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return ["blank", *text.split("\n")[: None if text and not text.endswith("\n") else -1], " "]
