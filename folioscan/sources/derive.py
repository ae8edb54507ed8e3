"""The page index from tables of text: pages, their sources, and word tokens with fixed-pitch geometry."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.model import OCR, TEXT_LAYER

CELL_W, CELL_H, LINES = 6.0, 12.0, 8
TOKEN = "\\n|[ \\t]+|[^ \\t\\n]+"
PAGE = ["doc_id", "page", "source"]
_TOKEN = re.compile(TOKEN)


def document_pages(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, page, text): so many lines of a document are a page.  Null texts are one empty page."""
    split = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    pages = split.withColumn("page", F.explode(F.sequence(F.lit(0), ((F.size("lines") - 1) / lines).cast("int"))))
    return pages.select("doc_id", "page", F.array_join(F.slice("lines", F.col("page") * lines + 1, F.lit(lines)), "\n").alias("text"))


def conversation_pages(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def page_size(text: Column) -> tuple[Column, Column]:
    """Width and height of a page of character cells."""
    lines = F.split(text, "\n", -1)
    return F.greatest(F.lit(612.0), CELL_W * F.array_max(F.transform(lines, F.char_length))), CELL_H * (F.size(lines) + 2)


def page_index(pages: DataFrame) -> DataFrame:
    """(doc_id, page, source, text, page_w, page_h, status, raw_chars, visible_chars, valid_boxes, conf, dx).

    By doc_id % 3 a document has recognised text only (its text layer is one dot),
    both sources, or a text layer only.
    """
    kind = F.pmod(F.col("doc_id"), F.lit(3))
    sized = pages.withColumns(dict(zip(("page_w", "page_h"), page_size(F.col("text")), strict=True)))
    # Both sources of a page come from one reading of it.
    both = sized.withColumn("source", F.explode(F.when(kind < 2, F.array(F.lit(TEXT_LAYER), F.lit(OCR))).otherwise(F.array(F.lit(TEXT_LAYER)))))
    read = F.col("source") == OCR
    body = F.when(read, F.translate("text", "oO", "00")).when(kind == 0, ".").otherwise(F.col("text"))
    both = both.select("doc_id", "page", "source", body.alias("text"), "page_w", "page_h", F.when(read, 0.5 + F.pmod("doc_id", F.lit(50)) / 100).otherwise(1.0).alias("conf"), F.when(read, 1.5).otherwise(0.0).alias("dx"))
    visible = F.char_length(F.regexp_replace("text", "[ \\t\\n]", ""))
    return both.withColumns({"status": F.lit(0), "raw_chars": F.char_length("text"), "visible_chars": visible, "valid_boxes": visible})


def held(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column that is computed once a row, however often it is used: a generator of one value keeps it from being repeated."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def scan(index: DataFrame, start: int = 0, end: int = -1) -> DataFrame:
    """The pages of a range, as far as each document has them; an end below 0 is its last page, and a range that begins behind its end has none."""
    last = F.max("page").over(Window.partitionBy("doc_id"))
    return index.withColumn("__last", last).where(F.col("page").between(F.lit(max(0, start)), F.least(F.col("__last"), F.lit(end)) if end >= 0 else F.col("__last"))).drop("__last")


def extracted_or_fail(index: DataFrame) -> DataFrame:
    """The index, or an error if the extractor gave nothing at all."""
    if index.isEmpty():
        raise RuntimeError("the text layer's extractor returned no page")
    return index


TOKENS = "array<struct<text:string,start:bigint,line:int,conf:double,l:double,b:double,r:double,t:double>>"


def word_tokens(text: pa.Array, page_h: pa.Array, conf: pa.Array, dx: pa.Array) -> pa.Array:
    """Words, blanks and breaks of each page in order, on a grid of character cells; only words have a box."""
    parts = [_TOKEN.findall(t or "") for t in text.to_pylist()]
    words = [w for page in parts for w in page]
    many = np.array([len(page) for page in parts], np.int64)
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    start = end - size
    base = np.concatenate([[0], end])[np.cumsum(many) - many]  # of each page within the batch
    is_break = np.array([w == "\n" for w in words], bool)
    first = np.zeros(len(words), bool)
    first[1:] = is_break[:-1]
    first[(np.cumsum(many) - many)[many > 0]] = True
    begin = np.maximum.accumulate(np.where(first, start, 0)) if len(words) else start
    line = np.cumsum(is_break) - is_break
    line -= np.repeat(np.concatenate([line, [0]])[np.cumsum(many) - many], many)
    height, sure, shift = (np.repeat(c.cast(pa.float64()).to_numpy(zero_copy_only=False), many) for c in (page_h, conf, dx))
    left, top = CELL_W * (start - begin) + shift, height - CELL_H * line
    no_box = np.array([w[:1] in " \t\n" for w in words], bool)
    sides = [pa.array(x, pa.float64(), mask=no_box) for x in (left, top - CELL_H, left + CELL_W * size, top)]
    fields = [pa.array(words, pa.string()), pa.array(start - np.repeat(base, many)), pa.array(line, pa.int32()), pa.array(sure), *sides]
    rows = pa.StructArray.from_arrays(fields, ["text", "start", "line", "conf", *"lbrt"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), rows)


def with_tokens(index: DataFrame) -> DataFrame:
    """Adds ``tokens``, an array of (text, start, line, conf, l, b, r, t), within the row: nothing is shuffled.  A null text has none."""
    return index.withColumn("tokens", F.arrow_udf(word_tokens, TOKENS)("text", "page_h", "conf", "dx"))


def tokens(index: DataFrame) -> DataFrame:
    """(page columns, seq, token, start, line, conf, l, b, r, t): the tokens of ``with_tokens``, a row each."""
    rows = with_tokens(index).select(*PAGE, F.posexplode("tokens").alias("seq", "x"))
    return rows.select(*PAGE, "seq", F.col("x.text").alias("token"), "x.start", "x.line", "x.conf", "x.l", "x.b", "x.r", "x.t")
