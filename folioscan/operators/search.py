"""Positional search: literal, leftmost, non-overlapping matches, widened to whole tokens with their rectangles.

All that a page's matches need stands in its row, so a search shuffles nothing.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import ids, stats, text
from folioscan.model import OCR, TEXT_LAYER, QueryOptions, check_keyword
from folioscan.sources.derive import PAGE, held, with_tokens

#: Most text of keywords that one pass over the pages looks for; a larger table takes several passes.
KEYWORD_BYTES = 4 << 20
#: Pages whose tokens are looked at together.
HIT_PAGES = 64
_HITS = "array<struct<ordinal:int,start:bigint,stop:bigint,conf:double,rects:array<struct<l:double,b:double,r:double,t:double>>>>"
_RECT = pa.struct([(k, pa.float64()) for k in "lbrt"])
_HIT = pa.list_(pa.struct([("ordinal", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("conf", pa.float64()), ("rects", pa.list_(_RECT))]))


def normalized(index: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
    return index.withColumn("norm", text.normalize_page(F.col("text"), F.col("source"), options))


def folded(keyword: str, options: QueryOptions) -> dict[str, str]:
    """The keyword as it is looked for in each source, folded on the driver."""
    return {s: text.normalize_query(check_keyword(keyword), options, s) for s in (TEXT_LAYER, OCR)}


def by_source(keyword: str, options: QueryOptions) -> Column:
    needles = folded(keyword, options)
    return F.when(F.col("source") == OCR, F.lit(needles[OCR])).otherwise(F.lit(needles[TEXT_LAYER]))


def occurrences(pages: DataFrame, body: Column, needle: Column, keys: list[str], whole_word: bool = False) -> DataFrame:
    """keys, ordinal, m_start, m_len: each match of ``needle`` in ``body`` (0-based); ordinals count after the whole-word rule.

    A body is split at the needle once; offsets are the running sums of its parts'
    lengths, and a match's neighbours are the outer characters of the parts beside it.
    """
    n = F.char_length("needle")
    rows = held(pages.select(*keys, needle.alias("needle"), body.alias("__body")), "norm", F.col("__body")).where((n > 0) & F.contains("norm", "needle"))
    literal = F.concat(F.lit("\\Q"), F.replace("needle", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    rows = held(rows, "parts", F.split("norm", literal, -1))
    rows = held(rows, "sizes", F.transform("parts", F.char_length))
    rows = held(rows, "upto", stats.running_sums(F.col("sizes")))
    count, parts = F.size("upto") - 1, F.col("parts")

    def alone(i: Column) -> Column:
        # Between matches that touch, the neighbour is the next match's own character.
        left = F.when(parts[i] != "", F.substring(parts[i], -1, 1)).when(i > 0, F.substring("needle", -1, 1)).otherwise("")
        right = F.when(parts[i + 1] != "", F.substring(parts[i + 1], 1, 1)).when(i + 1 < count, F.substring("needle", 1, 1)).otherwise("")
        return ~text.joins_words(left) & ~text.joins_words(right)

    starts = F.transform(F.slice("upto", 1, count), lambda s, i: F.when(alone(i) if whole_word else F.lit(True), s + i * n))
    found = rows.select(*keys, "needle", F.posexplode(F.array_compact(starts) if whole_word else starts).alias("ordinal", "m_start"))
    return found.select(*keys, "ordinal", "m_start", n.cast("long").alias("m_len"))


def matches(index: DataFrame, keyword: str, options: QueryOptions = QueryOptions()) -> DataFrame:
    """(page, ordinal, m_start, m_len) in the normal form of the page's text, of which every code point is a token."""
    body = text.normalize_page(F.col("text"), F.col("source"), options)
    return occurrences(index, body, by_source(keyword, options), PAGE, options.whole_word)


@functools.lru_cache(4096)
def _joins(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] == "L" or unicodedata.category(char) == "Nd"


def _places(body: str, needle: str, whole_word: bool) -> Iterator[int]:
    at = body.find(needle) if needle else -1
    while at >= 0:
        end = at + len(needle)
        if not whole_word or not (at and _joins(body[at - 1])) and not (end < len(body) and _joins(body[end])):
            yield at
        at = body.find(needle, end)


def _place(keyword: str, options: QueryOptions):  # noqa: ANN202
    """An Arrow UDF (tokens, source) -> the hits of a page: their tokens' offsets, mean confidence and a rectangle a line."""
    needles = folded(keyword, options)

    @F.arrow_udf(_HITS)
    def run(tokens: pa.Array, sources: pa.Array) -> pa.Array:
        # A token takes some hundred bytes in plain Python, so few pages are opened at a time.
        parts = [found(tokens.slice(at, HIT_PAGES), sources.slice(at, HIT_PAGES)) for at in range(0, len(tokens), HIT_PAGES)]
        return pa.concat_arrays(parts) if parts else pa.array([], _HIT)

    def found(tokens: pa.Array, sources: pa.Array) -> pa.Array:
        cut = np.concatenate([[0], np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())])
        flat = tokens.flatten()
        column = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
        texts = column["text"].to_pylist()
        start, line, conf, *sides = (column[c].to_numpy(zero_copy_only=False).tolist() for c in ("start", "line", "conf", *"lbrt"))
        stop = [s + len(t) for s, t in zip(start, texts, strict=True)]
        boxed = (~np.isnan(column["l"].to_numpy(zero_copy_only=False).astype(float))).tolist()
        left, bottom, right, top = sides
        rows = []
        for begin, end, source in zip(cut[:-1].tolist(), cut[1:].tolist(), sources.to_pylist(), strict=True):
            body, owner = text.normalize_tokens(texts[begin:end], source, options)
            needle, row = needles.get(source, needles[TEXT_LAYER]), []
            for ordinal, at in enumerate(_places(body, needle, options.whole_word)):
                mine = [begin + k for k in sorted(set(owner[at : at + len(needle)]))]
                by_line: dict[int, list[int]] = {}
                for k in mine:
                    if boxed[k]:
                        by_line.setdefault(line[k], []).append(k)
                if not by_line:
                    continue
                rects = [(min(left[k] for k in ks), min(bottom[k] for k in ks), max(right[k] for k in ks), max(top[k] for k in ks)) for _, ks in sorted(by_line.items())]
                sure = [conf[k] for k in mine if conf[k] >= 0]
                row.append((ordinal, min(start[k] for k in mine), max(stop[k] for k in mine), sum(sure) / len(sure) if sure else -1.0, rects))
            rows.append(row)
        return pa.array(rows, _HIT)

    return run


def hits(index: DataFrame, keyword: str, options: QueryOptions = QueryOptions()) -> DataFrame:
    """A row for each logical hit with at least one rectangle.

    doc_id, page, source, ordinal, matched, start, length, context, ctx_start,
    ctx_end, conf, rects, result_id.  An index without ``tokens`` gets those of
    ``derive.with_tokens``.  Tokens are folded one by one; pages whose text plainly
    holds no match are passed over before that.
    """
    pages = index
    if options.collapse_whitespace or options.ignore_whitespace:
        plain = text.expressed(F.col("text"), F.col("source"), options)
        pages = pages.where(text.needs_fold(F.col("text")) | F.contains(plain, by_source(keyword, options)))
    pages = pages if "tokens" in index.columns else with_tokens(pages)
    found = pages.select(*PAGE, F.col("text").alias("body"), "page_w", "page_h", F.explode(_place(keyword, options)("tokens", "source")).alias("h"))
    full = found.select(*PAGE, "body", "page_w", "page_h", "h.*")
    begin, n = F.greatest(F.col("start") - options.context, F.lit(0)), F.char_length("body")
    end = F.least(F.col("stop") + options.context, n)
    cut = lambda a, b: F.substring("body", (a + 1).cast("int"), (b - a).cast("int"))
    full = full.select(*PAGE, "ordinal", cut(F.col("start"), F.col("stop")).alias("matched"), "start", (F.col("stop") - F.col("start")).alias("length"), cut(begin, end).alias("context"), (F.col("start") - begin).alias("ctx_start"), (F.col("stop") - begin).alias("ctx_end"), "conf", "rects", "page_w", "page_h")
    doc_fp = F.concat(F.lit("doc="), F.col("doc_id").cast("string"))
    return full.withColumn("result_id", ids.result_id(doc_fp, F.col("page"), F.col("source"), F.col("matched"), F.col("rects"), F.col("ordinal")))


def native_matches(pages: DataFrame, keyword: str) -> DataFrame:
    """(doc_id, page, ordinal, m_start): breaks dropped, ASCII case folded, no other normalisation."""
    needle = check_keyword(keyword).translate(str.maketrans(text.UPPER, text.LOWER, "\0\r\n"))
    body = text.ascii_lower(F.translate("text", "\n\r\0", ""))
    return occurrences(pages, body, F.lit(needle), ["doc_id", "page"]).drop("m_len")


def multi_keyword(pages: DataFrame, keywords: DataFrame, block_bytes: int = KEYWORD_BYTES) -> DataFrame:
    """(item_id, doc_id, page, n): how often each keyword of a table occurs on a page, by whole lower-cased text.

    One automaton of all keywords reads each page once, so keywords and pages are never
    paired.  Keywords beyond ``block_bytes`` are looked for in further passes: the
    driver holds one block of them at a time, whatever the table's size.
    """
    body = F.regexp_replace(F.lower("text"), "\\s+", " ")
    flat = pages.select("doc_id", "page", body.alias("flat")).where("flat is not null")
    keys = keywords.select("item_id", body.alias("needle")).where("trim(needle) <> ''")
    kinds = {f.name: f.dataType.simpleString() for f in (*keys.schema, *flat.schema)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("item_id", "doc_id", "page")) + ", n long"

    def counted(block: list[tuple]) -> DataFrame:
        shared = pages.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            of: dict[str, list] = {}
            for item, needle in shared.value:
                of.setdefault(needle, []).append(item)
                automaton.add_word(needle, needle)
            automaton.make_automaton()
            for batch in batches:
                at, items, n = [], [], []
                for i, page in enumerate(batch.column(2).to_pylist()):
                    for needle in {needle for _, needle in automaton.iter(page)}:
                        at += [i] * len(of[needle])
                        items += of[needle]
                        n += [page.count(needle)] * len(of[needle])
                where = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(items, item_type), batch.column(0).take(where), batch.column(1).take(where), pa.array(n, pa.int64())], ["item_id", "doc_id", "page", "n"])

        item_type = pa.int64() if kinds["item_id"] in ("bigint", "int") else pa.string()
        return flat.mapInArrow(run, schema)

    total = keys.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    part = F.pmod(F.xxhash64("needle"), F.lit(max(1, blocks)))
    out = None
    for k in range(blocks):
        if block := [tuple(r) for r in keys.where(part == k).collect()]:
            out = counted(block) if out is None else out.unionByName(counted(block))
    return flat.sparkSession.createDataFrame([], schema) if out is None else out
