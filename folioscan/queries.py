"""The driver's queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import oracles
from folioscan.functions import errors, geometry, ids, stats, text
from folioscan.model import OCR, TEXT_LAYER, QueryOptions, SearchOptions
from folioscan.operators import assembly, block_index, blocks, imaging, layout, recognition, results, search
from folioscan.plans import pages as plans
from folioscan.sources import derive, protocols, shared, store
from folioscan.streaming import pages as streaming

FLAGSHIP = "search_context"
KEYWORD, RARE, BROKEN = "the", "worthless", ".the"
DEFAULT = QueryOptions()
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.document_pages(table(spark, sf_dir, "documents")).withColumn("source", F.lit(TEXT_LAYER))


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.page_index(derive.document_pages(table(spark, sf_dir, "documents")))


def conv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.page_index(derive.conversation_pages(table(spark, sf_dir, "conversations")))


# -- scans and predicates ----------------------------------------------------
@query
def page_scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = doc_index(spark, sf_dir)
    return index.groupBy("doc_id", "source").agg((F.max("page") + 1).alias("n_pages"), F.sum("raw_chars").alias("raw_chars"), F.sum("visible_chars").alias("visible_chars"), F.sum("valid_boxes").alias("valid_boxes"))


@query
def usable_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).where(plans.usable()).select("doc_id", "page", "visible_chars")


# -- normalisation -----------------------------------------------------------
def _normalize(name: str, options: QueryOptions) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.normalized(doc_index(spark, sf_dir), options).select("doc_id", "page", "source", "norm")

    _queries[name] = run


VARIANTS = {
    "basic": DEFAULT,
    "no_crossline": dataclasses.replace(DEFAULT, cross_line=False),
    "ignore_ws": dataclasses.replace(DEFAULT, ignore_whitespace=True),
    "case_sensitive": dataclasses.replace(DEFAULT, case_sensitive=True),
}
for _name, _options in VARIANTS.items():
    _normalize(f"normalize_page_{_name}", _options)


@query
def normalize_page_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact normaliser over the pages' tokens; its map is as long as its text."""
    index = conv_index(spark, sf_dir).withColumn("tokens", F.regexp_extract_all("text", F.lit(derive.TOKEN), F.lit(0)))
    done = index.withColumn("n", text.exact_normalizer(DEFAULT)(F.col("tokens"), F.col("source")))
    return done.select("doc_id", "page", "source", F.col("n.text").alias("norm"), F.size("n.map").alias("map_length"))


# -- search ------------------------------------------------------------------
def _search(name: str, keyword: str, options: QueryOptions) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.matches(doc_pages(spark, sf_dir), keyword, options).select("doc_id", "page", "ordinal", "m_start")

    _queries[name] = run


SEARCHES = {
    "search_literal": (KEYWORD, DEFAULT),
    "search_rare": (RARE, DEFAULT),
    "search_case": ("The", dataclasses.replace(DEFAULT, case_sensitive=True)),
    "search_wholeword": ("on", dataclasses.replace(DEFAULT, whole_word=True)),
    "search_crossline": (BROKEN, DEFAULT),
    "search_ignore_ws": ("inthe", dataclasses.replace(DEFAULT, ignore_whitespace=True)),
}
for _name, (_keyword, _options) in SEARCHES.items():
    _search(_name, _keyword, _options)


#: Forms that fold back to what they stand for: full-width letters, an ideographic blank, a no-break blank behind a stop.
WIDE = ("abcdefghijklmnopqrstuvwxyz ", "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz") + "\u3000")


def in_forms(index: DataFrame) -> DataFrame:
    """The same pages in other characters, with ligatures and with CR LF."""
    body = F.replace(F.replace(F.replace("text", F.lit("fi"), F.lit("\ufb01")), F.lit(". "), F.lit(".\xa0")), F.lit("\n"), F.lit("\r\n"))
    return index.withColumn("text", F.translate(body, *WIDE))


@query
def normalize_page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written in other forms have the normal form of the plain ones."""
    return search.normalized(in_forms(conv_index(spark, sf_dir))).select("doc_id", "page", "source", "norm")


@query
def search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matches(in_forms(conv_index(spark, sf_dir)), "the").select("doc_id", "page", "source", "ordinal", "m_start")


@query
def search_wide_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in full-width text: tokens are folded one by one, offsets and context are the page's own."""
    wide = conv_index(spark, sf_dir).withColumn("text", F.translate("text", WIDE[0][:26], WIDE[1][:26]))
    found = search.hits(wide, "The", dataclasses.replace(DEFAULT, whole_word=True))
    return found.select("doc_id", "page", "source", "ordinal", "start", "length", F.translate("matched", WIDE[1], WIDE[0]).alias("matched"))


#: Pages and keywords that only meet in their exact normal form, or do not meet.
CASES = (
    ("\uff21Bc here", "abc"), ("search-\r\nengine", "searchengine"), ("foo\u00a0bar", "foo bar"), ("\ufb01le under", "file"), ("a--\n\nb", "ab"), ("one\u2028two", "onetwo"), ("caf\u00e9", "cafe\u0301"),
    ("cafe\u0301", "caf\u00e9"), ("x \u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c3"), ("\u039f\u0394\u039f\u03a3", "\u039f\u0394\u039f\u03a3"), ("\u8de8\u884c \n \u68c0\u7d22", "\u8de8\u884c\n\u68c0\u7d22"), ("a \n\u00a0b", "a b"), ("1\u2044\u2082 \u00bd", "1\u20442"),
)


@query
def search_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page and one keyword a case."""
    pages = spark.createDataFrame([(i, 0, TEXT_LAYER, p) for i, (p, _) in enumerate(CASES)], "doc_id long, page int, source string, text string")
    found = [search.matches(pages.where(F.col("doc_id") == i), k) for i, (_, k) in enumerate(CASES)]
    return functools.reduce(DataFrame.unionByName, found).select("doc_id", "ordinal", "m_start", "m_len")


@query
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(conv_index(spark, sf_dir), KEYWORD).select("doc_id", "page", "source", "ordinal", "matched", "start", "length", "context", "ctx_start", "ctx_end", "conf")


@query
def search_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.hits(conv_index(spark, sf_dir), BROKEN).select("doc_id", "page", "source", "ordinal", F.posexplode("rects").alias("n", "x"))
    return rows.select("doc_id", "page", "source", "ordinal", F.col("n").cast("long").alias("n"), "x.l", "x.b", "x.r", "x.t")


@query
def search_result_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(conv_index(spark, sf_dir), KEYWORD).select("doc_id", "page", "source", "ordinal", "result_id")


@query
def search_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.native_matches(doc_pages(spark, sf_dir), "The")


@query
def multi_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), "text")
    return search.multi_keyword(docs, table(spark, sf_dir, "benchmark")).select("item_id", "doc_id", "n")


@query
def hits_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.matches(doc_index(spark, sf_dir), KEYWORD)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id", "page").alias("pages"))


# -- results -----------------------------------------------------------------
def conv_hits(spark: SparkSession, sf_dir: str, keyword: str = KEYWORD) -> DataFrame:
    return results.sequence(search.hits(conv_index(spark, sf_dir), keyword))


@query
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_index(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("indexes"))


@query
def cross_source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.dedup(conv_hits(spark, sf_dir)).select("doc_id", "page", "source", "ordinal", "seq")


@query
def distinct_result_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.distinct_ids(conv_hits(spark, sf_dir)).select("doc_id", "seq", "result_id")


@query
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = SearchOptions(detect_columns=False)
    return results.reading_order(conv_hits(spark, sf_dir), plain).select("doc_id", "page", "source", "ordinal", F.col("rank").cast("long").alias("rank"))


@query
def topk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = SearchOptions(detect_columns=False, dedup=False, max_results=5)
    return results.finalize(conv_hits(spark, sf_dir), plain).select("doc_id", "result_id", F.col("rank").cast("long").alias("rank"))


def conv_plan(spark: SparkSession, sf_dir: str, options: SearchOptions) -> DataFrame:
    convs = derive.conversation_pages(table(spark, sf_dir, "conversations")).select("doc_id", "page")
    counted = convs.join(convs.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages")), "doc_id")
    return plans.ocr_plan(counted, options, F.pmod(F.col("doc_id"), F.lit(10)).cast("int"))


PLANS = {
    "page_plan_outward": SearchOptions(full_document_ocr=True, max_ocr_pages=5),
    "page_plan_natural": SearchOptions(full_document_ocr=True, ocr_page_order="NATURAL", start_page=2, max_ocr_pages=0),
    "page_plan_targets": SearchOptions(full_document_ocr=True, ocr_target_pages=(1, 4, 6), max_ocr_pages=2),
    "page_plan_current": SearchOptions(),
}


def _plan(name: str, options: SearchOptions) -> None:
    _queries[name] = lambda spark, sf_dir: conv_plan(spark, sf_dir, options).withColumn("rank", F.col("rank").cast("long"))


for _name, _search_options in PLANS.items():
    _plan(_name, _search_options)


@query
def stop_after_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = conv_plan(spark, sf_dir, PLANS["page_plan_outward"])
    found = search.matches(conv_index(spark, sf_dir).where(F.col("source") == OCR), KEYWORD)
    return results.stop_after_first(found, plan).select("doc_id", "page", "ordinal", "m_start")


@query
def limit_while_scanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = conv_plan(spark, sf_dir, PLANS["page_plan_outward"])
    found = search.matches(conv_index(spark, sf_dir).where(F.col("source") == OCR), KEYWORD)
    return results.limit_in_scan(found, plan, 3).select("doc_id", "page", "ordinal", "m_start")


@query
def viewer_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results.highlights(search.hits(conv_index(spark, sf_dir), BROKEN))
    return rows.select("doc_id", "page", "source", "matched", F.round("box.l", 6).alias("l"), F.round("box.t", 6).alias("t"), F.col("n").cast("long").alias("n"), F.col("next").cast("long").alias("next"), F.col("previous").cast("long").alias("previous"))


# -- routing and summary -----------------------------------------------------
@query
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.routes(doc_index(spark, sf_dir), SearchOptions(policy="UNUSABLE_OR_NO_MATCH"))


TARGETS = {
    "target_pages_exact": SearchOptions(target_pages=(0, 2, 2, 99)),
    "target_pages_range": SearchOptions(start_page=1, end_page=3),
    "target_pages_current": SearchOptions(current_page_only=True, current_page=2, target_pages=(0,)),
}


def _targets(name: str, options: SearchOptions) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        convs = derive.conversation_pages(table(spark, sf_dir, "conversations")).select("doc_id", "page")
        counted = convs.join(convs.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages")), "doc_id")
        return plans.target_pages(counted, options).select("doc_id", "page")

    _queries[name] = run


for _name, _search_options in TARGETS.items():
    _targets(_name, _search_options)

REQUESTS = {
    "ocr_request_pages": SearchOptions(policy="UNUSABLE_OR_NO_MATCH"),
    "ocr_request_unusable": SearchOptions(),
    "ocr_request_documents": SearchOptions(page_level_fallback=False),
}


def _request(name: str, options: SearchOptions) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        layer = doc_index(spark, sf_dir).where(F.col("source") == TEXT_LAYER)
        return plans.ocr_request(layer, search.matches(layer, KEYWORD), options)

    _queries[name] = run


for _name, _search_options in REQUESTS.items():
    _request(_name, _search_options)


@query
def preferred_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.preferred(conv_index(spark, sf_dir)).select("doc_id", "page", "source")


@query
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as messages of a failure that a second cause explains."""
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    inner = F.when(F.col("page") % 2 == 0, "OutOfMemoryError").otherwise("Error")
    causes = F.array(F.struct(F.lit("Error").alias("kind"), F.col("text").alias("message")), F.struct(inner.alias("kind"), F.lit("model could not LOAD").alias("message")))
    return pages.select("doc_id", "page", errors.classify(causes, F.lit(errors.CODES["unknown"])).alias("code"))


RESOLVE = SearchOptions(full_document_ocr=True, max_ocr_pages=5)


def conv_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.resolve(conv_index(spark, sf_dir), RESOLVE, F.pmod(F.col("doc_id"), F.lit(10)).cast("int"))


@query
def unresolved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_states(spark, sf_dir).where("state <> 'COMPLETED'")


@query
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.summary(conv_states(spark, sf_dir), search.matches(conv_index(spark, sf_dir), KEYWORD), 20)


@query
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries that a store of the even pages lacks, with their keys."""
    wanted = conv_index(spark, sf_dir).select("doc_id", "page", "source")
    rows = store.missing(wanted, wanted.where("page % 2 = 0"))
    key = ids.page_key(F.concat(F.lit("doc="), F.col("doc_id").cast("string")), F.col("page").cast("string"), F.col("source"))
    return rows.select("doc_id", "page", "source", key.alias("key"), ids.file_name(key).alias("file_name"))


@query
def cache_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as cached files of several times a second; what is above 40,000 characters goes."""
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    name = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("page").cast("string"))
    files = pages.select(name.alias("name"), F.char_length("text").cast("long").alias("size"), (F.col("doc_id") * 3_600_000 + F.col("page") * 250).alias("mtime"))
    return store.victims(files, 40_000)


@query
def retry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page failed twice; one in six may be tried again."""
    failed = derive.conversation_pages(table(spark, sf_dir, "conversations")).select("doc_id", "page", (F.col("page") % 6 == 0).alias("retryable"))
    return plans.retry(failed.union(failed))[0]


@query
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    kind = F.element_at(F.array(F.lit("MEMORY"), F.lit("DISK"), F.lit(None).cast("string")), (F.col("page") % 3 + 1).cast("int"))
    length = F.char_length("text").cast("long")
    return plans.page_metrics(pages.select("doc_id", "page", kind.alias("cache_source"), (length - 500).alias("match_ms"), length.alias("total_ms")))


@query
def document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    uri = F.concat(F.lit("doc="), F.col("doc_id").cast("string"))
    return docs.select("doc_id", ids.fingerprint(uri, F.coalesce("text", F.lit("")).cast("binary")).alias("fingerprint"))


# -- layout ------------------------------------------------------------------
def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks on a 640-point page: odd ones stand in the right column, every ninth spans the page."""
    lines = derive.document_pages(table(spark, sf_dir, "documents"), 12).select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("id", "text"))
    spans = F.col("id") % 9 == 8
    left = F.when(spans, 0.0).when(F.col("id") % 2 == 1, 320.0).otherwise(0.0)
    width = F.when(spans, 600.0).otherwise(6.0 * F.least(F.char_length("text"), F.lit(40)))
    top = 12.0 * F.col("id")
    return lines.select("doc_id", "page", F.col("id").cast("long").alias("id"), left.alias("l"), (left + width).alias("r"), top.alias("t"))


@query
def debug_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as blocks with a box a character; those of odd number lie askew."""
    words = word_boxes(spark, sf_dir).withColumn("n", F.char_length("text"))
    one = lambda i: F.struct((i / F.col("n")).alias("l"), F.lit(0.25).alias("t"), ((i + 1) / F.col("n")).alias("r"), F.lit(0.75).alias("b"))
    at = F.sequence(F.lit(0), F.col("n") - 1)
    quad = F.when(F.col("seq") % 2 == 1, F.array("l", "t", "r", F.col("t") + 2, "r", F.col("b") + 2, "l", "b"))
    blocks = words.select("doc_id", "page", "seq", "text", "l", "t", "r", "b", quad.alias("quad"), F.transform(at, one).alias("token_boxes"), at.alias("begins"), F.transform(at, lambda i: i + 1).alias("ends"), F.lit(320.0).alias("bitmap_w"), F.lit(90.0).alias("bitmap_h"))
    rows = layout.debug_geometry(blocks, ["doc_id", "page"])
    return rows.select("doc_id", "page", "seq", F.col("n").cast("long").alias("n"), "kind", "label", *(F.round(F.col("box")[c], 6).alias(c) for c in "ltrb"))


@query
def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.column_split(two_columns(spark, sf_dir), ["doc_id", "page"], "l", "r", F.lit(640.0))


@query
def block_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.block_order(two_columns(spark, sf_dir), ["doc_id", "page"], F.lit(640.0)).select("doc_id", "page", "id", F.col("rank").cast("long").alias("rank"))


@query
def geometric_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters without their breaks, from geometry alone: the lines come back."""
    lines = derive.conversation_pages(table(spark, sf_dir, "conversations")).select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("row", "text"))
    chars = lines.select("doc_id", "page", "row", F.posexplode(F.split("text", "")).alias("col", "char")).where("char <> ''")
    chars = chars.select("doc_id", "page", (F.col("row") * 100000 + F.col("col")).alias("idx"), "char", (1000 - 12.0 * F.col("row")).alias("cy"), F.lit(12.0).alias("h"))
    found = layout.line_numbers(chars, ["doc_id", "page"])
    return found.groupBy("doc_id", "page", F.col("line").cast("long").alias("line")).agg(F.count(F.lit(1)).alias("n_chars"))


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations as blocks in bitmap pixels, y down."""
    index = derive.page_index(derive.conversation_pages(table(spark, sf_dir, "conversations"))).where(F.col("source") == TEXT_LAYER)
    words = derive.tokens(index).where("l is not null")
    return words.select("doc_id", "page", "seq", F.col("token").alias("text"), "l", "r", (12.0 * F.col("line")).alias("t"), (12.0 * F.col("line") + 10).alias("b"), F.lit(6.0).alias("glyph"))


@query
def block_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.separators(word_boxes(spark, sf_dir), ["doc_id", "page"], "seq", F.lit(612.0)).groupBy("doc_id", "page", F.coalesce("separator", F.lit("FIRST")).alias("separator")).agg(F.count(F.lit(1)).alias("n"))


@query
def space_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a line without its blanks: the gaps say where they were."""
    lines = derive.conversation_pages(table(spark, sf_dir, "conversations")).select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    chars = lines.select("doc_id", "page", "line", F.posexplode(F.split("text", "")).alias("seq", "token")).where("token not in ('', ' ')")
    placed = chars.select("doc_id", "page", "line", "seq", "token", (F.col("seq") * 0.01).alias("l"), (F.col("seq") * 0.01 + 0.009).alias("r"))
    return layout.recovered_spaces(placed, ["doc_id", "page", "line"]).where("space").groupBy("doc_id", "page", "line").agg(F.count(F.lit(1)).alias("spaces"), F.sum("seq").alias("places"))


def _rounded(box: Column) -> list[Column]:
    return [F.round(box[k], 6).alias(k) for k in ("l", "b", "r", "t")]


@query
def coord_bitmap_to_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.bitmap_to_pdf(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(1280.0), F.lit(1810.0), F.lit(612.0), F.lit(792.0))
    return word_boxes(spark, sf_dir).withColumn("box", box).where("box is not null").select("doc_id", "page", "seq", *_rounded(F.col("box")))


@query
def coord_page_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_boxes(spark, sf_dir).withColumn("box", geometry.page_ratio(geometry.rect(F.col("l"), F.col("t"), F.col("r"), F.col("b")), F.lit(612.0), F.lit(792.0)))
    return rows.where("box is not null").select("doc_id", "page", "seq", *_rounded(F.col("box")))


@query
def coord_bitmap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_boxes(spark, sf_dir).withColumn("box", geometry.bitmap_ratio(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(320.0), F.lit(90.0)))
    return rows.where("box is not null").select("doc_id", "page", "seq", *_rounded(F.col("box")))


@query
def coord_viewer_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on pages of 300 by 400 that follow each other in a scrolled document."""
    ratio = geometry.bitmap_ratio(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(640.0), F.lit(480.0))
    rows = word_boxes(spark, sf_dir).withColumn("box", geometry.page_rect(ratio, F.lit(300.0), F.lit(400.0), F.col("page") * 400.0))
    return rows.where("box is not null").select("doc_id", "page", "seq", *_rounded(F.col("box")))


@query
def page_centre_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = conv_index(spark, sf_dir).where(F.col("source") == TEXT_LAYER)
    widest = layer.groupBy("doc_id").agg(F.max("page_w").alias("widest"))
    offset = geometry.centre_offset(F.col("page_w"), F.col("widest"), F.col("page") + 300.0)
    return layer.join(widest, "doc_id").select("doc_id", "page", F.round(offset, 6).alias("offset"))


@query
def detection_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of pages at three pixels a point as a detector gets them."""
    layer = conv_index(spark, sf_dir).where(F.col("source") == TEXT_LAYER).select("doc_id", "page", (F.col("page_w") * 3).alias("w"), (F.col("page_h") * 3).alias("h"))
    size = geometry.detection_size(F.col("w"), F.col("h"), 1280)
    return layer.select("doc_id", "page", size["w"].alias("w"), size["h"].alias("h"), geometry.detection_side(F.col("w"), F.col("h")).alias("side"))


@query
def fallback_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.posexplode(layout.even_tokens(F.col("text"), F.col("l"), F.col("r") + 1)).alias("n", "x")
    return word_boxes(spark, sf_dir).select("doc_id", "page", "seq", parts).select("doc_id", "page", "seq", F.col("n").cast("long").alias("n"), "x.token", F.round("x.l", 6).alias("l"), F.round("x.r", 6).alias("r"))


@query
def neighbour_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that were made four points wider on either side."""
    wide = word_boxes(spark, sf_dir).withColumns({"l": F.col("l") - 4, "r": F.col("r") + 4})
    return recognition.clamp_neighbours(wide, ["doc_id", "page", "t"], "seq").select("doc_id", "page", "seq", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"))


@query
def quad_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    quad = F.array(F.col("l"), F.col("t"), F.col("r"), F.col("t") + 1, F.col("r") + 2, F.col("b"), F.col("l") + 2, F.col("b") - 1)
    x, y = geometry.quad_point(quad, F.lit(0.25), F.lit(0.75))
    return word_boxes(spark, sf_dir).select("doc_id", "page", "seq", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(recognition.expand_distance(quad), 6).alias("grow"))


def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.char_length(x).cast("double")).alias("xs"))


@query
def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_lengths(spark, sf_dir).select("doc_id", stats.median(F.col("xs")).alias("median"))


@query
def lower_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_lengths(spark, sf_dir).select("doc_id", stats.lower_quantile(F.col("xs"), 0.35).alias("q35"))


@query
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.transform("xs", lambda x: x.cast("long"))
    return line_lengths(spark, sf_dir).select("doc_id", *(stats.weighted_quantile_index(counts, q).cast("long").alias(f"at_{int(1000 * q)}") for q in (0.005, 0.5, 0.995)))


# -- recognition, protocols, streaming ---------------------------------------
def _drawn(keys: list[str], column: str, one: Callable[[str], tuple], fields: list[tuple[str, pa.DataType]], rows: int = 1) -> imaging.Drawn:
    """Turns batches with a text column into batches of so many rows, with what ``one`` draws for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = zip(*map(one, part.column(column).to_pylist()), strict=True)
                drawn = [pa.array(list(v), kind) for v, (_, kind) in zip(values, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *drawn], [*keys, *(f for f, _ in fields)])

    return run


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a page, with its number in the page."""
    return derive.conversation_pages(table(spark, sf_dir, "conversations")).select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("at_line", "line"))


def _decoded(lines: DataFrame, by: list[str]) -> DataFrame:
    def steps(c: Column, i: Column) -> Column:
        n = F.ascii(c) % 3 + 1
        return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((i * 8 + k).alias("step"), F.when(k < n, F.ascii(c)).otherwise(0).alias("idx"), (0.5 + (i % 32) / 64).alias("prob")))

    chars = lines.where("line <> ''").select(*by, F.flatten(F.transform(F.filter(F.split("line", ""), lambda c: c != ""), steps)).alias("steps"))
    done = recognition.with_ctc(chars, "steps")
    return done.select(*by, F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("codes"), F.round("conf", 6).alias("conf"))


def _cells(lines: DataFrame, by: list[str]) -> DataFrame:
    chars = lines.select(*by, F.posexplode(F.split("line", "")).alias("i", "c"), F.char_length("line").alias("n")).where("c <> ''")
    runs = chars.withColumns({"begin": F.col("i") * 8, "end": F.col("i") * 8 + F.ascii("c") % 3})
    return recognition.cell_bounds(runs, by, F.col("n") * 8).select(*by, F.col("begin").cast("long").alias("begin"), "left_step", "right_step")


@query
def ctc_decode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each character of a line for one to three steps, then a blank: decoded to itself."""
    return _decoded(_all_lines(spark, sf_dir), ["doc_id", "page", "at_line"])


@query
def ctc_cells_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of ``ctc_decode_lines`` and the steps that belong to each."""
    return _cells(_all_lines(spark, sf_dir), ["doc_id", "page", "at_line"])


@query
def detect_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines drawn into a detector's map of half the page's resolution, and found again."""

    def draw(page: str) -> tuple:
        lines = page.split("\n")
        scores = np.full((24 * len(lines) + 32, 6 * max(map(len, lines)) + 40), 0.1, "<f4")
        for i, line in enumerate(lines):
            scores[24 * i + 8 : 24 * i + 16, 8 : 8 + 6 * len(line)] = 0.9
        h, w = scores.shape
        return scores.tobytes(), w, h, 2 * w, 2 * h

    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    drawn = _drawn(["doc_id", "page"], "text", draw, [("scores", pa.binary()), *((k, pa.int32()) for k in ("map_w", "map_h", "source_w", "source_h"))])
    sides = [F.col("quad")[k].cast("long").alias(c) for c, k in (("l", 0), ("t", 1), ("r", 4), ("b", 5))]
    return imaging.detect(pages, ["doc_id", "page"], drawn).select("doc_id", "page", *sides)


def _ink_boxes(lines: DataFrame, by: list[str]) -> DataFrame:
    def draw(line: str) -> tuple:
        image = np.full((12, 6 * len(line)), 255, np.uint8)
        seen = [i for i, c in enumerate(line) if not c.isspace()]
        inked = 6 * np.array([i for i in seen if ord(line[i]) % 5], int)[:, None] + np.arange(1, 5)
        image[2:10, inked.ravel()] = 0
        return image.tobytes(), 6 * len(line), 12, [8 * i + 2 for i in seen], [8 * i + 5 for i in seen], 8 * len(line), False

    ints = pa.list_(pa.int32())
    drawn = _drawn(by, "line", draw, [("pixels", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("begins", ints), ("ends", ints), ("steps", pa.int32()), ("turned", pa.bool_())], 32)
    boxes = imaging.align(lines.where("line <> ''").select(*by, "line"), by, drawn)
    return boxes.select(*by, F.col("n").cast("long").alias("n"), *(F.round(c, 6).alias(c) for c in "ltrb"))


@query
def token_ink_boxes_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines drawn as bars; every fifth character code has no ink, so its box comes from its steps."""
    return _ink_boxes(_all_lines(spark, sf_dir), ["doc_id", "page", "at_line"])


@query
def protocol_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed into the binary format and read back."""

    @F.pandas_udf("binary")
    def pack(doc: pd.Series, page: pd.Series, body: pd.Series) -> pd.Series:
        def one(p: int, t: str) -> bytes:
            chars = [(ord(c), None if c.isspace() else (6.0 * i, 0.0, 6.0 * i + 6, 12.0)) for i, c in enumerate(t)]
            seen = sum(b is not None for _, b in chars)
            return protocols.pack_pages([{"page": p, "page_w": 612.0, "page_h": 792.0, "status": 0, "raw_chars": len(t), "visible_chars": seen, "valid_boxes": seen, "chars": chars}])

        return pd.Series([one(p, t) for p, t in zip(page, body, strict=True)])

    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    back = pages.select("doc_id", F.explode(protocols.decode_pages(pack("doc_id", "page", "text"))).alias("p"))
    return back.select("doc_id", "p.page", "p.text", F.col("p.raw_chars").cast("long").alias("raw_chars"), F.col("p.n_boxed").cast("long").alias("n_boxed"))


@query
def protocol_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as matches in a report of numbers, every other rectangle with swapped edges; page records and rectangles come back."""

    @F.pandas_udf("array<double>")
    def pack(page: pd.Series, body: pd.Series) -> pd.Series:
        def one(p: int, t: str) -> list[float]:
            out: list[float] = []
            start = n = 0
            for i, line in enumerate(t.split("\n")):
                box = [0, 12 * i, 6 * len(line), 12 * i + 12]
                out += [i, start, len(line), 1, *(box if i % 2 else [box[2], box[3], box[0], box[1]])]
                start, n = start + len(line) + 1, n + 1
            return [float(x) for x in (protocols.TEXT_MAGIC, 1, 9, 1, p, 612, 792, p % 3, len(t), 7, 5, n, *out)]

        return pd.Series([one(p, t) for p, t in zip(page, body, strict=True)])

    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    back = pages.select("doc_id", protocols.decode_reports(pack("page", "text")).alias("x")).select("doc_id", "x.n_pages", F.explode("x.pages").alias("p"), "x.rects")
    rows = back.select("doc_id", "n_pages", "p.page", "p.status", "p.raw_chars", "p.n_matches", F.explode_outer("rects").alias("r"))
    return rows.select("doc_id", "n_pages", "page", "status", "raw_chars", "n_matches", "r.ordinal", "r.start", "r.length", *(F.col(f"r.{k}").alias(k) for k in "lbrt"))


@query
def protocol_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as seven numbers each in one array a page, and back."""
    numbers = F.array(F.col("page").cast("double"), F.col("seq").cast("double"), "l", "t", "r", "b", "glyph")
    packed = word_boxes(spark, sf_dir).groupBy("doc_id", "page").agg(F.flatten(F.sort_array(F.collect_list(numbers))).alias("v"))
    back = packed.select("doc_id", F.explode(protocols.legacy_rects(F.concat("v", F.array(F.lit(1.0))))).alias("x"))
    return back.select("doc_id", *(F.col("x")[i].alias(c) for i, c in enumerate(("page", "seq", "l", "t", "r", "b", "glyph"))))


#: Characters that the fixture's recogniser knows: printable ones of ASCII and Latin-1.
KNOWN = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x100)]))


#: A page of lines as the fixture's recogniser reports it: its bitmap and its extent in points.
READ_SIZES = {"bitmap_w": 10_000.0, "bitmap_h": 5_000.0, "page_w": 5_000.0, "page_h": 2_500.0}


def _reader(spark: SparkSession) -> imaging.Drawn:
    """Lines as a recogniser reports them, by numbers: without their blanks, a box for each character, decoded with a dictionary file."""
    path = shared.shared_dir(spark, "dictionary")
    spark.createDataFrame([("\n".join(KNOWN),)], "value string").coalesce(1).write.text(path)
    dictionary = protocols.load_dictionary(spark, path)

    number = np.full(0x101, -1.0)
    number[[ord(c) for c in KNOWN]] = np.arange(1.0, len(KNOWN) + 1)

    def pack(page: str) -> tuple:
        out: list = [[protocols.BLOCK_MAGIC, 2.0]]
        for i, line in enumerate(page.split("\n")):
            codes = np.frombuffer(line.encode("utf-32-le"), "<u4")
            at = np.flatnonzero((codes != 0x20) & (codes != 0x09))
            w, top, n = 6.0 * len(line), 14.0 * i, max(1, len(line))
            boxes = np.full((len(at), 4), (0.0, 0.1, 0.0, 0.9))
            boxes[:, 0], boxes[:, 2] = at / n, (at + 0.87) / n
            out += [[4.0, float(len(at)), 0.5 + i % 8 / 16, float(len(at)), 0.0, top, w, top, w, top + 10, 0.0, top + 10], number[np.minimum(codes[at], 0x100)], boxes.ravel(), [0.0, 1.0]]
        return (np.concatenate(out),)

    packed = _drawn(["doc_id", "page"], "text", pack, [("numbers", pa.list_(pa.float64()))], protocols.BLOCK_ROWS)

    # Numbers are packed and read back in one pass: forty bytes a character need not go through the JVM.
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packed(batches):
            sizes = [pa.array(np.full(batch.num_rows, v)) for v in READ_SIZES.values()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["page"], protocols.block_rows(batch["numbers"], dictionary), *sizes], ["doc_id", "page", "blocks", *READ_SIZES])

    return read


def _blocks_schema() -> str:
    return f"doc_id long, page int, blocks {protocols.BLOCKS}, " + ", ".join(f"{k} double" for k in READ_SIZES)


def recognised_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.conversation_pages(table(spark, sf_dir, "conversations")).mapInArrow(_reader(spark), _blocks_schema())


@query
def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page indexes of recognised lines: text with its lost spaces, tokens, counts and mean score."""
    read = _reader(spark)

    # The pages' tokens are counted where they are made.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in block_index.indexed(read(batches)):
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in ("doc_id", "page", "text", "visible_chars", "valid_boxes", "conf")), *block_index.last_boxed(batch["tokens"])], ["doc_id", "page", "text", "visible_chars", "valid_boxes", "conf", "n_tokens", "last_l", "last_t", "last_line"])

    # Pages that lack a part of their id have no index, as in the SQL.
    named = F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations")).withColumn("text", F.when(named, F.col("text")).otherwise(""))
    index = pages.mapInArrow(run, "doc_id long, page int, text string, visible_chars long, valid_boxes long, conf double, n_tokens long, last_l double, last_t double, last_line long")
    return index.select("doc_id", "page", "text", "n_tokens", "visible_chars", "valid_boxes", *(F.round(c, 6).alias(c) for c in ("conf", "last_l", "last_t")), "last_line")


@query
def recognised_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in those indexes, across their line breaks."""
    found = search.hits(assembly.index_of_blocks(recognised_blocks(spark, sf_dir)), "the")
    return found.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("hits"))


@query
def block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in recognised lines one by one, with the rectangles of their tokens."""
    found = blocks.block_hits(recognised_blocks(spark, sf_dir), "The")
    return found.select("doc_id", "page", F.col("ordinal").cast("long").alias("ordinal"), "start", *(F.round(k, 6).alias(k) for k in "lbrt"))


@query
def visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be seen of texts with ideographic and no-break blanks, by the rule of recognised text and by a text layer's."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace(F.translate("text", "ae", "\u3000\xa0"), F.lit(","), F.lit("\x85")))
    return docs.select("doc_id", text.visible_count(F.col("text")).cast("long").alias("seen"), text.visible_count(F.col("text"), True).cast("long").alias("in_layer"))


@query
def search_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older request that asks for its own case."""
    asked = SearchOptions(ignore_case=False).effective_query()
    return search.matches(doc_pages(spark, sf_dir), "The", asked).select("doc_id", "page", "ordinal", "m_start")


@query
def progress_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's turn, how many are done and to come, and the hits so far."""
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    found = search.matches(pages.withColumn("source", F.lit(TEXT_LAYER)), KEYWORD).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_hits"))
    return streaming.progress(pages.select("doc_id", "page").join(found, ["doc_id", "page"], "left").fillna(0, ["n_hits"]))


@query
def scanned_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third to the sixth page of each document, with what was counted there."""
    layer = doc_index(spark, sf_dir).where(F.col("source") == TEXT_LAYER)
    return derive.scan(derive.extracted_or_fail(layer), 2, 5).select("doc_id", "page", F.col("raw_chars").cast("long").alias("raw_chars"), "status")


@query
def text_layer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page indexes of characters that have lost their line breaks, some with swapped edges; every fourth page failed."""
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("row", "text"))
    chars = lines.select("doc_id", "page", "row", F.posexplode(F.split("text", "")).alias("col", "char")).where("char <> ''")
    code = F.conv(F.hex(F.encode("char", "UTF-32")), 16, 10).cast("int")
    low, high = 1000 - 12.0 * F.col("row"), 1010 - 12.0 * F.col("row")
    swapped = F.col("col") % 2 == 1
    left = 6.0 * F.col("col")
    rows = chars.select("doc_id", "page", (F.col("row") * 100000 + F.col("col")).alias("idx"), code.alias("code_point"), left.alias("l"), F.when(swapped, high).otherwise(low).alias("b"), (left + 6).alias("r"), F.when(swapped, low).otherwise(high).alias("t"))
    n = F.char_length("text").cast("long")
    facts = pages.select("doc_id", "page", F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"), F.when(F.col("page") % 4 == 3, 2).otherwise(0).alias("status"), n.alias("raw_chars"), n.alias("visible_chars"), n.alias("valid_boxes"))
    index = assembly.index_of_characters(rows, facts)
    total = F.aggregate("tokens", F.lit(0.0), lambda a, x: a + F.coalesce(x["t"] - x["b"], F.lit(0.0)))
    return index.select("doc_id", "page", "text", "status", "conf", F.size("tokens").cast("long").alias("n_tokens"), F.coalesce(F.try_element_at("tokens", F.lit(-1))["line"], F.lit(0)).cast("long").alias("last_line"), total.alias("heights"))


@query
def finalized_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of it: distinct ids, dedup of the sources, order by columns where hits stand in two, and the first twenty."""
    done = results.finalize(conv_hits(spark, sf_dir), SearchOptions(max_results=20))
    return done.select("doc_id", "page", "source", "ordinal", F.col("column").cast("long").alias("column"), F.col("rank").cast("long").alias("rank"))


@query
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one letter in the two-column lines, in the order in which they are read."""
    lines = two_columns(spark, sf_dir).where("r > l")
    box = F.array(F.struct(F.col("l"), (2000 - F.col("t") - 10).alias("b"), F.col("r"), (2000 - F.col("t")).alias("t")))
    hits = lines.select("doc_id", "page", F.lit(TEXT_LAYER).alias("source"), F.col("id").alias("ordinal"), F.lpad(F.col("id").cast("string"), 8, "0").alias("result_id"), box.alias("rects"), F.lit(640.0).alias("page_w"), F.lit(2000.0).alias("page_h"))
    return results.reading_order(hits).select("doc_id", "page", "ordinal", F.col("column").cast("long").alias("column"), F.col("rank").cast("long").alias("rank"))


@query
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed pages of which some were damaged, some are of another version and some are filed under another key: those are misses."""
    pages = conv_index(spark, sf_dir)
    key = ids.page_key(F.concat(F.lit("doc="), F.col("doc_id").cast("string")), F.col("page").cast("string"), F.col("source"))
    entries = pages.select(key.alias("key"), F.col("text").cast("binary").alias("payload"), "page")
    kept = store.sealed(entries.select("key", "payload")).join(entries.select("key", "page"), "key")
    version = F.when(F.col("page") == 4, "v0").otherwise(F.col("version"))
    payload = F.when(F.col("page") == 1, F.concat("payload", F.lit(b"x"))).otherwise(F.col("payload"))
    filed = F.when(F.col("page") == 2, F.concat("key", F.lit("?"))).otherwise(F.col("key"))
    found, misses = store.unsealed(entries, kept.select(filed.alias("key"), payload.alias("payload"), version.alias("version"), "size", F.when(F.col("page") == 3, F.col("crc") + 1).otherwise(F.col("crc")).alias("crc")))
    return found.select("key", F.octet_length("payload").cast("long").alias("size")).unionByName(misses.select("key", F.lit(None).cast("long").alias("size")))


@query
def ocr_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    key = ids.ocr_page_key(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc="), F.col("doc_id").cast("string"))), F.col("page"), 960, None)
    return pages.select("doc_id", "page", key.alias("key"), ids.file_name(key, ".ocr").alias("file_name"))


@query
def kept_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as copies of their conversation: the newest four of each stay, with what they take up."""
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    files = pages.select(F.col("doc_id").alias("folder"), F.col("page").cast("string").alias("name"), F.char_length("text").cast("long").alias("size"), (F.col("page") * 10).alias("mtime"))
    return store.held_bytes(store.newest(files))


@query
def cut_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a store holds them that takes 100 bytes of a string."""
    return table(spark, sf_dir, "documents").select("doc_id", store.cut_long(F.col("text"), 100).alias("text"))


@query
def render_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of pages that are drawn 1,280 pixels wide, and widths of their lines as a recogniser gets them."""
    layer = conv_index(spark, sf_dir).where(F.col("source") == TEXT_LAYER)
    return layer.select("doc_id", "page", geometry.render_height(F.col("page_w"), F.col("page_h"), 1280).alias("height"), geometry.recognition_width(F.col("page_w"), F.col("page_h"), F.lit(10.5)).alias("line_w"))


@query
def fallback_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.resolve_with_fallback(conv_index(spark, sf_dir), RESOLVE, F.pmod(F.col("doc_id"), F.lit(10)).cast("int"))


@query
def page_error_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition came back without text for pages of fewer than 150 characters."""
    lost = (F.col("source") == OCR) & (F.col("raw_chars") < 150)
    index = conv_index(spark, sf_dir).withColumn("text", F.when(lost, "").otherwise(F.col("text")))
    return plans.page_errors(plans.resolve(index, RESOLVE, F.pmod(F.col("doc_id"), F.lit(10)).cast("int")))


@query
def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractor that returned long pages only; the others are in the index as failed ones."""
    layer = conv_index(spark, sf_dir).where(F.col("source") == TEXT_LAYER)
    return plans.extracted(layer, layer.where("raw_chars > 200")).select("doc_id", "page", "status", F.col("raw_chars").cast("long").alias("raw_chars"), "conf")


@query
def backend_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    routed = [plans.backend_failed(pages, SearchOptions(mode=m)).withColumn("mode", F.lit(m)) for m in ("TEXT_ONLY", "TEXT_THEN_OCR")]
    return routed[0].unionByName(routed[1])


@query
def prepared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which the short ones are in memory and those with a comma on disk."""
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations")).withColumn("blocks", F.split("text", "\n", -1))
    rows = store.prepared(pages.select("doc_id", "page"), pages.where("length(text) < 300"), pages.where("contains(text, ',')"))
    return rows.select("doc_id", "page", "cache_source", F.coalesce(F.size("blocks"), F.lit(0)).cast("long").alias("n_blocks"))


@query
def detector_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of three pixels for each line, as a detector gets it: each channel's pixels, found again in the tensor and added up."""

    @F.pandas_udf("binary")
    def draw(pages: pd.Series) -> pd.Series:
        def one(t: str) -> bytes:
            n = np.array([len(x) for x in t.split("\n")])
            y, x, c = np.mgrid[:3, : len(n), :3]
            return ((n[x] * 7 + y * 5 + c * 3) % 256).astype(np.uint8).tobytes()

        return pages.map(one)

    @F.pandas_udf("array<long>")
    def sums(tensors: pd.Series) -> pd.Series:
        mean, spread = (np.array(x)[:, None] for x in imaging.DETECTOR_NORM)
        return tensors.map(lambda b: np.rint((np.frombuffer(b, "<f4").reshape(3, -1) * spread + mean) * 255).sum(1).astype(int).tolist())

    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    images = pages.select("doc_id", "page", draw("text").alias("pixels"), F.size(F.split("text", "\n", -1)).alias("width"), F.lit(3).alias("height"), F.lit(3).alias("channels"))
    found = imaging.tensors(images, ["doc_id", "page"]).select("doc_id", "page", sums("tensor").alias("m"))
    return found.select("doc_id", "page", *(F.col("m")[k].alias(f"c{k}") for k in range(3)))


@query
def page_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut out of a drawn page: their size and the sum of their pixels."""

    def draw(page: str) -> tuple:
        lines = page.split("\n")
        width, height = 6 * max(1, max(map(len, lines))), 12 * len(lines)
        y, x = np.ogrid[:height, :width]
        quads = [[0, 12 * i, 6 * len(line), 12 * i, 6 * len(line), 12 * i + 8, 0, 12 * i + 8] for i, line in enumerate(lines)]
        return ((x + 2 * y) % 251).astype(np.uint8).tobytes(), width, height, 1, quads

    @F.arrow_udf("long")
    def total(pixels: pa.Array) -> pa.Array:
        return pa.array([int(np.frombuffer(b.as_buffer(), np.uint8).sum(dtype=np.int64)) for b in pixels], pa.int64())

    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    drawn = _drawn(["doc_id", "page"], "text", draw, [("pixels", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("quads", pa.list_(pa.list_(pa.int32())))])
    return imaging.crops(pages, ["doc_id", "page"], drawn).select("doc_id", "page", F.col("n").cast("long").alias("n"), "width", "height", total("pixels").alias("total"))


@query
def orientation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    n = F.char_length("text")
    x = recognition.orientation(F.array((n % 11) / 10.0 - 0.3, (n % 21) / 20.0))
    return pages.select("doc_id", "page", x.alias("x")).select("doc_id", "page", "x.label", F.round("x.score", 6).alias("score"), "x.turned")


@query
def incremental_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read as a stream of files; hits and running totals of the final state."""
    root = shared.shared_dir(spark, "stream")
    # One file for each page number: the feed delivers a document's pages in separate batches.
    feed = derive.conversation_pages(table(spark, sf_dir, "conversations"))
    feed.repartitionByRange(8, "page").write.parquet(f"{root}/in")
    pages = streaming.page_stream(spark, f"{root}/in", feed.schema)
    norm = text.normalize_page(F.col("text"), F.lit(TEXT_LAYER))
    n = (F.char_length(norm) - F.char_length(F.replace(norm, F.lit(KEYWORD), F.lit("")))) / len(KEYWORD)
    streaming.deliver(pages, n, f"{root}/out", f"{root}/checkpoint")
    return streaming.cumulative(spark.read.parquet(f"{root}/out"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
