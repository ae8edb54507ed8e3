"""Page indexes with tokens, from a text layer's characters and from the blocks that a recogniser found."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry, stats
from folioscan.model import TEXT_LAYER
from folioscan.operators import block_index, layout
from folioscan.sources.derive import held

PAGE = ["doc_id", "page"]
SIDES = "lbrt"
_NO_TOKENS = "array<struct<text:string,start:bigint,line:int,conf:double,l:double,b:double,r:double,t:double>>"


def _indexed(rows: DataFrame) -> DataFrame:
    """Adds ``text`` and ``tokens`` to rows with ``parts``, an array of (text, box, conf, breaks): offsets and lines run over it."""
    rows = held(rows, "__ends", F.transform("parts", lambda x: F.char_length(x["text"])))
    rows = held(rows, "__upto", stats.running_sums(F.col("__ends")))
    rows = held(rows, "__breaks", F.transform("parts", lambda x: x["breaks"].cast("int")))
    rows = held(rows, "__lines", stats.running_sums(F.col("__breaks")))

    def token(x: Column) -> Column:
        part = x["parts"]
        start, line = x["__upto"] - x["__ends"], (x["__lines"] - x["__breaks"]).cast("int")
        return F.struct(part["text"].alias("text"), start.alias("start"), line.alias("line"), part["conf"].cast("double").alias("conf"), *(part["box"][k].alias(k) for k in SIDES))

    rows = rows.withColumn("tokens", F.transform(F.arrays_zip("parts", "__ends", "__upto", "__breaks", "__lines"), token))
    return rows.withColumn("text", F.array_join(F.transform("parts", lambda x: x["text"]), "")).drop("__ends", "__upto", "__breaks", "__lines")


def character(code: Column) -> Column:
    """The character of a code point; null for numbers that are none."""
    valid = ((code >= 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0).cast("long")), 8, "0")), "UTF-32"))


def index_of_characters(chars: DataFrame, pages: DataFrame) -> DataFrame:
    """The text layer's page index: a token for each code point, and a line break where the geometry moves to another line.

    ``chars`` has doc_id, page, idx, code_point and l, b, r, t (null or without area: no
    box; swapped edges are put right).  ``pages`` has doc_id, page, page_w, page_h, status
    and the three counts; a page without characters has an empty text.  Numbers that are
    no characters, nulls and surrogates among them, go.
    """
    box = geometry.rect(*(F.col(c) for c in SIDES))
    rows = chars.select(*PAGE, "idx", character(F.col("code_point")).alias("char"), box.alias("box")).where("char is not null")
    rows = rows.withColumns({"cy": (F.col("box.b") + F.col("box.t")) / 2, "h": F.col("box.t") - F.col("box.b")})
    before = F.lag("char").over(Window.partitionBy(*PAGE).orderBy("idx"))
    lined = layout.line_numbers(rows, PAGE).withColumn("opens", F.col("new_line") & F.coalesce(~before.isin("\n", "\r"), F.lit(False)))
    part = lambda char, box: F.struct(char.alias("text"), box.alias("box"), F.lit(1.0).alias("conf"), char.isin("\n", "\r").alias("breaks"))
    own, inserted = part(F.col("char"), F.col("box")), part(F.lit("\n"), F.when(F.lit(False), F.col("box")))
    grouped = lined.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("idx", F.when(F.col("opens"), F.array(inserted, own)).otherwise(F.array(own)).alias("parts")))).alias("x"))
    whole = _indexed(grouped.select(*PAGE, F.flatten("x.parts").alias("parts"))).drop("parts")
    failed = F.col("status") != 0
    out = pages.join(whole, PAGE, "left")
    return out.select(*PAGE, F.lit(TEXT_LAYER).alias("source"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tokens", F.array().cast(_NO_TOKENS)).alias("tokens"), "page_w", "page_h", failed.cast("int").alias("status"), "raw_chars", "visible_chars", "valid_boxes", F.when(failed, 0.0).otherwise(1.0).alias("conf"))


def index_schema(pages: DataFrame) -> str:
    """The columns of ``block_index.indexed`` for pages with such keys and sizes."""
    kind = dict(pages.dtypes)
    own = lambda *names: ", ".join(f"{c} {kind[c]}" for c in names)
    return f"{own(*PAGE)}, source string, text string, tokens {_NO_TOKENS}, {own('page_w', 'page_h')}, status int, raw_chars bigint, visible_chars bigint, valid_boxes bigint, conf double"


def index_of_blocks(pages: DataFrame, detect_columns: bool = True, column_gap: float = 0.16) -> DataFrame:
    """The page index of recognised pages: blocks in reading order, with what stands between them, and their tokens in page points.

    ``pages`` has doc_id, page, bitmap_w, bitmap_h, page_w, page_h and blocks, an array of
    (text, l, t, r, b, score, quad, token_boxes, begins, ends): bitmap pixels, y down; boxes
    in ratios of the line and code point offsets, or null.  A block without sound boxes
    shares its width evenly.  Spaces that a line has lost come back.  Pages without an
    extent have no index, pages without blocks an empty one of confidence -1.  All within
    the row: nothing is shuffled, and the tokens of a page never leave their worker for a join.
    """
    sizes = ["bitmap_w", "bitmap_h", "page_w", "page_h"]
    sound = pages.where("bitmap_w > 0 and bitmap_h > 0 and page_w > 0 and page_h > 0").select(*PAGE, *sizes, "blocks")
    return sound.mapInArrow(partial(block_index.indexed, detect_columns=detect_columns, column_gap=column_gap), index_schema(sound))
