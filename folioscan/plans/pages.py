"""Page planning, source routing and the search summary, as columns of one row a page."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.model import OCR, STAGES, TEXT_LAYER, SearchOptions


def target_pages(pages: DataFrame, options: SearchOptions) -> DataFrame:
    """The pages (doc_id, page, n_pages) that are asked for: the current page, else an exact list, else a range."""
    last = F.col("n_pages") - 1
    if options.current_page_only:
        return pages.where(F.col("page") == F.least(F.greatest(F.lit(options.current_page), F.lit(0)), last))
    if options.target_pages is not None:
        return pages.where(F.col("page").isin(list(options.target_pages)))
    start = F.least(F.greatest(F.lit(options.start_page), F.lit(0)), last)
    end = F.lit(options.end_page) if options.end_page >= 0 else last
    return pages.where(F.col("page").between(start, F.greatest(start, F.least(end, last))))


def ocr_plan(pages: DataFrame, options: SearchOptions, current: Column | None = None) -> DataFrame:
    """(doc_id, page, rank): the pages to recognise, in order.

    Only the current page unless the full document is allowed; outward order is the
    current page, the one before, the one after, and so on.  The exact list is applied
    before the cap.
    """
    last = F.col("n_pages") - 1
    pivot = F.least(F.greatest(F.lit(options.current_page) if current is None else current, F.lit(0)), last)
    rows = pages.withColumn("pivot", pivot)
    if not options.full_document_ocr:
        rows = rows.where("page = pivot")
    else:
        start = F.least(F.greatest(F.lit(options.start_page), F.lit(0)), last)
        end = F.least(F.lit(options.end_page), last) if options.end_page >= 0 else last
        rows = rows.where(F.col("page").between(start, F.greatest(start, end)))
        rows = rows.withColumn("pivot", F.least(F.greatest(F.col("pivot"), start), F.greatest(start, end)))
    if options.ocr_target_pages is not None:
        rows = rows.where(F.col("page").isin(list(options.ocr_target_pages)))
    natural = options.ocr_page_order == "NATURAL"
    order = Window.partitionBy("doc_id").orderBy(*(["page"] if natural else [F.abs(F.col("page") - F.col("pivot")), F.col("page") > F.col("pivot")]))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if options.max_ocr_pages > 0:
        ranked = ranked.where(F.col("rank") <= options.max_ocr_pages)
    return ranked.select("doc_id", "page", "rank")


def usable(options: SearchOptions = SearchOptions()) -> Column:
    """Whether a text layer can be searched as it is."""
    coverage = F.when(F.col("visible_chars") > 0, F.least(F.lit(1.0), F.col("valid_boxes") / F.col("visible_chars"))).otherwise(0.0)
    return (F.col("source") == TEXT_LAYER) & (F.col("status") == 0) & (F.col("visible_chars") >= options.min_visible) & (coverage >= options.min_coverage)


def searchable() -> Column:
    return (F.col("status") == 0) & (F.col("text") != "")


def routes(index: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(doc_id, page, route): TEXT, BOTH, OCR or FAIL by the text layer's quality."""
    keep = F.when(searchable(), "TEXT").otherwise("FAIL")
    if options.mode == "OCR_ONLY":
        route = F.lit("OCR")
    elif options.mode == "TEXT_ONLY":
        route = keep
    else:
        good = F.lit("BOTH" if options.policy == "UNUSABLE_OR_NO_MATCH" else "TEXT")
        route = F.when(usable(options), good).otherwise(F.lit("OCR") if options.page_level_fallback else keep)
    return index.where(F.col("source") == TEXT_LAYER).select("doc_id", "page", route.alias("route"))


def ocr_request(index: DataFrame, hits: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(doc_id, page): what a search without an index asks recognition for after ``hits`` in the text layer.

    By page, those whose text layer is unusable or, if the policy says so, has no hit;
    else all pages of the documents without any hit.
    """
    layer = index.where(F.col("source") == TEXT_LAYER)
    if options.mode != "OCR_ONLY":
        if options.mode != "TEXT_THEN_OCR" or not options.fallback_when_not_found:
            layer = layer.limit(0)
        elif not options.page_level_fallback:
            layer = layer.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")
        elif options.policy == "UNUSABLE_OR_NO_MATCH":
            found = hits.select("doc_id", "page", F.lit(True).alias("found")).distinct()
            layer = layer.join(found, ["doc_id", "page"], "left").where(~usable(options) | F.col("found").isNull())
        else:
            layer = layer.where(~usable(options))
    return layer.select("doc_id", "page")


def resolve(index: DataFrame, options: SearchOptions, current: Column | None = None) -> DataFrame:
    """(doc_id, page, route, state): COMPLETED, FAILED or SKIPPED for each target page.

    Pages to recognise that the plan leaves out are skipped; recognised pages without
    text fail.  A text page that is kept beside recognition completes its page anyway.
    """
    counted = index.where(F.col("source") == TEXT_LAYER).select("doc_id", "page").withColumn("n_pages", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    plan = ocr_plan(counted, options, current).select("doc_id", "page", F.lit(True).alias("planned"))
    read = index.where((F.col("source") == OCR) & searchable()).select("doc_id", "page", F.lit(True).alias("has_text"))
    rows = routes(index, options).join(target_pages(counted, options).select("doc_id", "page"), ["doc_id", "page"]).join(plan, ["doc_id", "page"], "left").join(read, ["doc_id", "page"], "left")
    state = F.when(F.col("route").isin("TEXT", "BOTH"), "COMPLETED").when(F.col("route") == "FAIL", "FAILED").when(F.col("planned").isNull(), "SKIPPED").when(F.col("has_text"), "COMPLETED").otherwise("FAILED")
    return rows.select("doc_id", "page", "route", state.alias("state"))


def resolve_with_fallback(index: DataFrame, options: SearchOptions, current: Column | None = None) -> DataFrame:
    """``resolve`` with ``source``: pages that recognition leaves out or fails on keep their text layer where it can be searched."""
    layer = index.where((F.col("source") == TEXT_LAYER) & searchable()).select("doc_id", "page", F.lit(True).alias("kept"))
    rows = resolve(index, options, current).join(layer, ["doc_id", "page"], "left")
    falls_back = (F.col("route") == "OCR") & (F.col("state") != "COMPLETED") & F.col("kept").isNotNull()
    source = F.when(falls_back | F.col("route").isin("TEXT", "BOTH"), TEXT_LAYER).when(F.col("state") == "COMPLETED", OCR)
    return rows.select("doc_id", "page", "route", F.when(falls_back, "COMPLETED").otherwise(F.col("state")).alias("state"), source.alias("source"))


def extracted(missing: DataFrame, found: DataFrame) -> DataFrame:
    """The index of the pages that an extractor was asked for: what it found, and for each page that it did not return one that failed, without extent or text."""
    empty = {"page_w": 0.0, "page_h": 0.0, "source": TEXT_LAYER, "text": "", "status": 1, "raw_chars": 0, "visible_chars": 0, "valid_boxes": 0, "conf": 0.0}
    rows = missing.select("doc_id", "page").distinct().join(found.select("doc_id", "page", *empty), ["doc_id", "page"], "left")
    return rows.select("doc_id", "page", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()))


def backend_failed(pages: DataFrame, options: SearchOptions) -> DataFrame:
    """(doc_id, page, route, stage, message, retryable) of pages whose text backend failed: to recognition, or an error of the text stage that may be tried again."""
    fails = options.mode == "TEXT_ONLY" or not options.page_level_fallback or not options.fallback_when_not_found
    rows = pages.select("doc_id", "page", F.lit("FAIL" if fails else "OCR").alias("route"))
    told = {"stage": F.lit(STAGES["TEXT"]), "message": F.lit("the text backend is not available"), "retryable": F.lit(True)}
    return rows.withColumns({k: v if fails else F.lit(None).cast({"stage": "int", "message": "string", "retryable": "boolean"}[k]) for k, v in told.items()})


def page_errors(states: DataFrame) -> DataFrame:
    """(doc_id, page, stage, message, retryable) of the failed pages: the others are delivered all the same."""
    ocr = F.col("route") == "OCR"
    told = [F.when(ocr, STAGES["OCR"]).otherwise(STAGES["TEXT"]).alias("stage"), F.when(ocr, "recognition returned no text").otherwise("the text layer cannot be searched").alias("message"), ocr.alias("retryable")]
    return states.where("state = 'FAILED'").select("doc_id", "page", *told)


def summary(states: DataFrame, hits: DataFrame, limit: int = 0) -> DataFrame:
    """One row for each document: target, completed, failed, skipped, results, limited, complete."""
    counts = states.groupBy("doc_id").agg(F.count(F.lit(1)).alias("target"), *(F.count_if(F.col("state") == s).alias(s.lower()) for s in ("COMPLETED", "FAILED", "SKIPPED")))
    found = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("results"))
    rows = counts.join(found, "doc_id", "left").withColumn("results", F.coalesce("results", F.lit(0)).cast("long"))
    limited = (F.col("skipped") > 0) | (F.lit(limit > 0) & (F.col("results") > limit))
    return rows.withColumn("limited", limited).withColumn("complete", (F.col("failed") == 0) & (F.col("skipped") == 0) & ~limited)


def retry(errors: DataFrame, options: SearchOptions = SearchOptions()) -> tuple[DataFrame, SearchOptions]:
    """(doc_id, page) of failed pages that may succeed, each once, and the options to search them with: all are recognised, without a cap."""
    pages = errors.where("retryable").select("doc_id", "page").distinct()
    return pages, dataclasses.replace(options, current_page_only=False, full_document_ocr=True, max_ocr_pages=0)


def page_metrics(timings: DataFrame) -> DataFrame:
    """Measures of pages (doc_id, page, cache_source and whole numbers): none below 0, and ``cache_hit``; an unknown source is NONE."""
    measures = [c for c in timings.columns if c not in ("doc_id", "page", "cache_source")]
    source = F.coalesce("cache_source", F.lit("NONE"))
    return timings.select("doc_id", "page", source.alias("cache_source"), source.isin("MEMORY", "DISK").alias("cache_hit"), *(F.greatest(F.lit(0), c).alias(c) for c in measures))
