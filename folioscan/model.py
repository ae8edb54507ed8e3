"""Options, versions and closed value sets.  Options are frozen: a query never changes them."""

from __future__ import annotations

import dataclasses

TEXT_LAYER, OCR = "PDF_TEXT_LAYER", "OCR"
MODES = ("TEXT_ONLY", "OCR_ONLY", "TEXT_THEN_OCR")
FALLBACK_POLICIES = ("UNUSABLE_TEXT_LAYER_ONLY", "UNUSABLE_OR_NO_MATCH")
PAGE_ORDERS = ("NATURAL", "CURRENT_PAGE_OUTWARD")
STAGES = {"TEXT": 1, "RENDER": 2, "OCR": 3, "CACHE": 4}
#: What a stored index depends on.  Normalisation is applied at query time and is no part of a key.
VERSIONS = {"text": 3, "ocr_model": 1, "ocr_geometry": 32, "normalisation": 1, "serialisation": 1}


@dataclasses.dataclass(frozen=True)
class QueryOptions:
    case_sensitive: bool = False
    normalize_unicode: bool = True
    collapse_whitespace: bool = True
    cross_line: bool = True
    ignore_whitespace: bool = False
    tolerate_o_zero: bool = True
    join_hyphens: bool = True
    whole_word: bool = False
    context: int = 24


@dataclasses.dataclass(frozen=True)
class SearchOptions:
    query: QueryOptions = QueryOptions()
    mode: str = "TEXT_THEN_OCR"
    policy: str = "UNUSABLE_TEXT_LAYER_ONLY"
    page_level_fallback: bool = True
    fallback_when_not_found: bool = True
    min_visible: int = 8
    min_coverage: float = 0.5
    dedup: bool = True
    dedup_iou: float = 0.65
    detect_columns: bool = True
    column_gap: float = 0.16
    current_page: int = 0
    current_page_only: bool = False
    target_pages: tuple[int, ...] | None = None
    start_page: int = 0
    end_page: int = -1
    full_document_ocr: bool = False
    max_ocr_pages: int = 5
    ocr_page_order: str = "CURRENT_PAGE_OUTWARD"
    ocr_target_pages: tuple[int, ...] | None = None
    stop_after_first_ocr_match: bool = False
    max_results: int = 0
    ignore_case: bool = True

    def effective_query(self) -> QueryOptions:
        """``ignore_case=False`` forces a case-sensitive search."""
        return self.query if self.ignore_case else dataclasses.replace(self.query, case_sensitive=True)


def check_keyword(keyword: str) -> str:
    """Keywords that are blank up to U+0020 are refused; an ideographic space is none of those."""
    if not keyword or not keyword.strip("".join(map(chr, range(33)))):
        raise ValueError("the keyword is blank")
    return keyword
