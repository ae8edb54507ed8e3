"""Fingerprints, cache keys and stable result ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.model import OCR, VERSIONS

EDGE = 64 << 10


def fingerprint(uri: Column, content: Column) -> Column:
    """32 hex digits over address, 8-byte size, first 64 KiB and, of longer files, last 64 KiB."""
    size = F.octet_length(content)
    head = F.substring(content, 1, EDGE)
    tail = F.when(size > EDGE, F.substring(content, -EDGE, EDGE)).otherwise(F.lit(b""))
    return F.substring(F.sha2(F.concat(uri.cast("binary"), F.unhex(F.lpad(F.hex(size.cast("long")), 16, "0")), head, tail), 256), 1, 32)


def page_key(doc_fp: Column, page: Column, source: Column, ocr_width: int = 1280, ocr_namespace: str = "") -> Column:
    """Key of a stored page index; only recognised pages depend on the rendering."""
    text = F.concat(doc_fp, F.lit("#page="), page, F.lit("#source="), source, F.lit(f"#versions={VERSIONS['text']}.{VERSIONS['serialisation']}"))
    ocr = F.concat(text, F.lit(f"#ocrWidth={ocr_width}#ocrNamespace={ocr_namespace or VERSIONS['ocr_model']}.{VERSIONS['ocr_geometry']}"))
    return F.when(source == OCR, ocr).otherwise(text)


def ocr_page_key(doc_fp: Column, page: Column, width: int, namespace: str | None) -> Column:
    """Key of a stored recognition; null fingerprints are empty."""
    return F.concat(F.coalesce(doc_fp, F.lit("")), F.lit("#page="), page.cast("string"), F.lit(f"#ocrWidth={width}#namespace={'default' if namespace is None else namespace}"))


def file_name(key: Column, extension: str = ".pidx") -> Column:
    return F.concat(F.sha2(key, 256), F.lit(extension))


def result_id(doc_fp: Column, page: Column, source: Column, matched: Column, rects: Column, ordinal: Column) -> Column:
    """``psr_`` and 24 hex digits over place and text; the ordinal counts only where there is no rectangle."""
    boxes = F.array_join(F.transform(rects, lambda r: F.format_string("%.3f,%.3f,%.3f,%.3f", r["l"], r["b"], r["r"], r["t"])), "|")
    tail = F.when(F.size(rects) > 0, boxes).otherwise(F.concat(F.lit("ordinal="), ordinal.cast("string")))
    return F.concat(F.lit("psr_"), F.substring(F.sha2(F.concat_ws("|", doc_fp, page.cast("string"), source, matched, tail), 256), 1, 24))
