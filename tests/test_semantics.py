"""Small cases with exact expectations."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from folioscan.functions import errors, geometry, ids, stats
from folioscan.functions.text import normalize_query, normalize_tokens
from folioscan.model import OCR, TEXT_LAYER, QueryOptions, SearchOptions, check_keyword
from folioscan.operators import layout, recognition, results, search
from folioscan.plans import pages as plans
from folioscan.sources import protocols, store

O = QueryOptions()  # noqa: E741


def off(**k):
    return dataclasses.replace(O, **k)


@pytest.mark.parametrize(
    ("tokens", "source", "options", "text", "origin"),
    [
        (["Ａ", "B", "c"], TEXT_LAYER, O, "abc", [0, 1, 2]),
        (["search-", "\n", "engine"], OCR, off(tolerate_o_zero=False), "searchengine", [0] * 6 + [2] * 6),
        (["A", "\n", "B"], OCR, off(cross_line=False), "a\0b", None),
        (["跨行", "  ", "\n", "  ", "检索测试", " ", "PDF", " ", "search"], OCR, O, "跨行检索测试 pdf search", None),
        (["A-0O1"], OCR, O, "a-001", None),
        (["A-0O1"], TEXT_LAYER, O, "a-0o1", None),
        (["A-0O1"], OCR, off(tolerate_o_zero=False), "a-0o1", None),
        (["foo", " ", "-", "\n", "bar"], TEXT_LAYER, O, "foobar", None),  # one hyphen and the blanks before the break
        (["--", "\n", "\n"], TEXT_LAYER, O, "", None),  # each break takes one hyphen
        (["a", "\r", "\n", "b"], TEXT_LAYER, off(cross_line=False), "a\0\0b", None),
        (["a", "\t", "b"], TEXT_LAYER, off(collapse_whitespace=False), "a b", None),
        (["a", "\n", "\xa0", "b"], TEXT_LAYER, O, "a b", None),  # a no-break space is not skipped after a break
        (["e", "\u0301"], TEXT_LAYER, O, "e\u0301", None),  # tokens are normalised one by one
        (["a  b"], TEXT_LAYER, off(ignore_whitespace=True), "ab", None),
        ([], TEXT_LAYER, O, "", []),
    ],
)
def test_page_normaliser(tokens, source, options, text, origin):
    got, where = normalize_tokens(tokens, source, options)
    assert got == text
    assert len(where) == len(got)
    assert origin is None or where == origin


def test_query_normaliser():
    assert normalize_query("跨行\n检索测试") == "跨行检索测试"
    assert normalize_query("PDFsearch") == "pdfsearch"
    assert normalize_query("A-OO1", O, OCR) == "a-001"
    assert normalize_query("A-OO1") == "a-oo1"
    assert normalize_query("e\u0301") == "\xe9"
    assert normalize_query("a\r\nb", off(cross_line=False)) == "a\0b"
    assert normalize_query("a\tb", off(collapse_whitespace=False)) == "a\tb"
    assert normalize_query("　") == " "


def test_keyword_rule():
    assert check_keyword("　")
    for bad in ("", "  ", "\t\n"):
        with pytest.raises(ValueError):
            check_keyword(bad)
    assert SearchOptions(ignore_case=False).effective_query().case_sensitive


@pytest.mark.parametrize(
    ("n", "options", "expected"),
    [
        (6, SearchOptions(full_document_ocr=True, start_page=0, end_page=5, current_page=3, max_ocr_pages=0), [3, 2, 4, 1, 5, 0]),
        (10, SearchOptions(full_document_ocr=True, current_page=4, max_ocr_pages=3), [4, 3, 5]),
        (5, SearchOptions(current_page=8), [4]),
        (8, SearchOptions(full_document_ocr=True, start_page=0, end_page=7, current_page=4, max_ocr_pages=0, ocr_target_pages=(1, 4, 6)), [4, 6, 1]),
    ],
)
def test_page_plan(spark, n, options, expected):
    pages = spark.createDataFrame([(1, p, n) for p in range(n)], "doc_id long, page int, n_pages int")
    # pages 1 and 6 of the last case are at distances 3 and 2 from page 4
    assert [r.page for r in plans.ocr_plan(pages, options).orderBy("rank").collect()] == expected


def test_usable_text_layer(spark):
    rows = [(TEXT_LAYER, 0, 120, 100, 92), (TEXT_LAYER, 0, 2, 1, 1), (TEXT_LAYER, 0, 100, 80, 10), (TEXT_LAYER, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "source string, status int, raw_chars int, visible_chars int, valid_boxes int")
    assert [r[0] for r in df.select(plans.usable()).collect()] == [True, False, False, False]


def hit(seq, source, conf, left, text="x", page=0):
    return (1, page, source, seq, text, conf, [(float(left), 0.0, float(left) + 10, 10.0)], f"id{seq}", seq)


HITS = "doc_id long, page int, source string, ordinal int, matched string, conf double, rects array<struct<l:double,b:double,r:double,t:double>>, result_id string, seq int"


def test_dedup_is_greedy_and_prefers_the_text_layer(spark):
    rows = [hit(1, OCR, 0.5, 0), hit(2, TEXT_LAYER, 1.0, 1), hit(3, OCR, 0.9, 50), hit(4, OCR, 0.95, 51), hit(5, OCR, 0.5, 50, "y")]
    df = spark.createDataFrame(rows, HITS)
    once = results.dedup(df)
    assert sorted(r.seq for r in once.collect()) == [2, 4, 5]
    assert sorted(r.seq for r in results.dedup(once).collect()) == [2, 4, 5]
    assert len(results.dedup(df, 0.0).collect()) == 2  # threshold 0 merges all of one text on a page


def test_block_separators(spark):
    def kinds(*blocks):
        df = spark.createDataFrame([(1, i, *b) for i, b in enumerate(blocks)], "k int, i int, text string, l double, t double, r double, b double, glyph double")
        return [r.separator for r in layout.separators(df, ["k"], "i", F.lit(1000.0)).orderBy("i").collect()][1:]

    assert kinds(("跨行", 10.0, 10.0, 70.0, 40.0, 28.0), ("检索", 73.0, 11.0, 130.0, 41.0, 28.0)) == ["NONE"]
    assert kinds(("OCR", 10.0, 10.0, 90.0, 40.0, 24.0), ("扫描", 110.0, 11.0, 180.0, 41.0, 30.0)) == ["SPACE"]
    assert kinds(("OCR", 10.0, 10.0, 90.0, 40.0, 24.0), ("扫描", 10.0, 70.0, 100.0, 100.0, 30.0)) == ["LINE_BREAK"]


@pytest.mark.parametrize(
    ("text", "boxes", "expected"),
    [
        ("OCR扫描", [(0.02, 0.10), (0.11, 0.19), (0.20, 0.28), (0.34, 0.43), (0.44, 0.53)], [3]),
        ("OCR扫描", [(0.90, 0.98), (0.81, 0.89), (0.72, 0.80), (0.57, 0.66), (0.47, 0.56)], [3]),
        ("扫描页面", [(0.02, 0.20), (0.22, 0.40), (0.42, 0.60), (0.62, 0.80)], []),
        ("TITLE", [(0.02, 0.10), (0.14, 0.22), (0.26, 0.34), (0.38, 0.46), (0.50, 0.58)], []),
        ("OCR 扫描", [(0.02, 0.10), (0.11, 0.19), (0.20, 0.28), (0.29, 0.33), (0.36, 0.45), (0.46, 0.55)], []),
    ],
)
def test_space_recovery(spark, text, boxes, expected):
    df = spark.createDataFrame([(1, i, c, *b) for i, (c, b) in enumerate(zip(text, boxes, strict=True))], "k int, seq int, token string, l double, r double")
    assert [r.seq for r in layout.recovered_spaces(df, ["k"]).where("space").orderBy("seq").collect()] == expected


def test_whole_words_advance_and_regex_signs_are_literal(spark):
    pages = spark.createDataFrame([(1, 0, TEXT_LAYER, "ab abab ab. a.b \\E x")], "doc_id long, page int, source string, text string")
    whole = search.matches(pages, "ab", off(whole_word=True))
    assert [(r.ordinal, r.m_start) for r in whole.orderBy("ordinal").collect()] == [(0, 0), (1, 8)]
    assert search.matches(pages, "a.b").count() == 1
    assert search.matches(pages, "\\E").count() == 1


def test_statistics(spark):
    df = spark.createDataFrame([([3.0, 1.0, -1.0, 2.0], [1, 0, 3])], "x array<double>, c array<bigint>")
    row = df.select(stats.median(F.col("x")), stats.lower_quantile(F.col("x"), 0.35), stats.weighted_quantile_index(F.col("c"), 0.5)).first()
    assert tuple(row) == (2.0, 1.0, 2)


@pytest.mark.parametrize(("n", "rank"), [(91, 32), (171, 60), (331, 116), (351, 123), (11, 4), (90, 31)])
def test_half_ranks_go_up(spark, n, rank):
    row = spark.range(1).select(stats.lower_quantile(F.sequence(F.lit(0), F.lit(n - 1)), 0.35)).first()
    assert row[0] == rank


def test_ctc_collapses_runs(spark):
    steps = [(1, s, i, 0.5) for s, i in enumerate([0, 5, 5, 0, 5, 7, 7, 0])]
    row = recognition.ctc_decode(spark.createDataFrame(steps, "k int, step int, idx int, prob double"), ["k"]).first()
    assert (row.tokens, row.begins, row.ends, row.conf) == ([5, 5, 7], [1, 4, 5], [2, 4, 6], 0.5)


def test_protocols():
    page = {"page": 3, "page_w": 10.0, "page_h": 20.0, "status": 0, "raw_chars": 2, "visible_chars": 1, "valid_boxes": 1, "chars": [(65, (0.0, 0.0, 1.0, 1.0)), (32, None)]}
    data = protocols.pack_pages([page])
    assert protocols.unpack_pages(data)[0]["text"] == "A "
    assert protocols.unpack_pages(data[:-1]) == [] == protocols.unpack_pages(None)
    assert protocols.unpack_pages(b"\0" + data[1:]) == []
    record = [-41001.0, 1.0, 5.0, 1.0, 2.0, 612.0, 792.0, 0.0, 9.0, 8.0, 8.0, 1.0, 0.0, 4.0, 3.0, 2.0, 0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 5.0, 6.0]
    assert [r["l"] for r in protocols.unpack_matches(record)] == [0.0]
    assert protocols.unpack_matches(record[:-1]) == []
    words = ["blank", "a", "b", " "]
    block = [-32001.0, 2.0, 4.0, 2.0, 0.9, 2.0, 0, 0, 9, 0, 9, 5, 0, 5, 1.0, 2.0, 0.0, 0.0, 0.5, 1.0, 0.5, 0.0, 1.5, 1.0, 0.0, 1.0]
    got = protocols.unpack_blocks(block, words)
    assert (got[0]["text"], got[0]["boxes"][6]) == ("ab", 1.0)
    assert protocols.unpack_blocks(block[:10], words) == []


def test_stored_index(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, TEXT_LAYER, "a"), (1, 0, OCR, "b"), (1, 1, OCR, "c")], "doc_id long, page int, source string, text string")
    store.save(df, str(tmp_path / "index"))
    back = store.load(spark, str(tmp_path / "index"))
    assert store.missing(df, back).count() == 0
    assert sorted(r.text for r in store.preferred(back).collect()) == ["a", "c"]
    files = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "name string, size long, mtime long")
    assert [r.name for r in store.victims(files, 10).collect()] == ["a"]


def test_result_ids_ignore_the_ordinal_where_there_is_a_rectangle(spark):
    rects = F.expr("array(named_struct('l', 1.0005D, 'b', 0D, 'r', 2D, 't', 1D))")
    none = F.expr("cast(array() as array<struct<l:double,b:double,r:double,t:double>>)")
    make = lambda r, n: ids.result_id(F.lit("d"), F.lit(0), F.lit("OCR"), F.lit("m"), r, F.lit(n))
    row = spark.range(1).select(make(rects, 1), make(rects, 2), make(none, 1), make(none, 2)).first()
    assert row[0] == row[1] and row[2] != row[3] and row[0].startswith("psr_") and len(row[0]) == 28


def test_geometry(spark):
    box = lambda *x: F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("lbrt", x, strict=True)))
    row = spark.range(1).select(geometry.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)), geometry.rect(*map(F.lit, (1.0, 1.0, 1.0, 2.0))), geometry.detection_side(F.lit(100), F.lit(5000))).first()
    assert round(row[0], 6) == round(1 / 3, 6) and row[1] is None and row[2] == 2048


def test_detector_sizes(spark):
    size = geometry.detection_size(F.lit(1270.0), F.lit(2540.0), 1280)
    row = spark.range(1).select(geometry.detection_side(F.lit(961), F.lit(10)), size["w"], size["h"], geometry.detection_size(F.lit(3.0), F.lit(50.0), 0)["w"]).first()
    assert tuple(row) == (992, 640, 1280, 32)


def test_error_codes_follow_the_chain_of_causes(spark):
    cases = [
        ([("Error", None), ("OutOfMemoryError", None)], 10),
        ([("Error", "Document is ENCRYPTED"), ("OutOfMemoryError", None)], 7),
        ([("UnsatisfiedLinkError", "password")], 4),
        ([("Error", "malformed xref")], 8),
        ([("Error", "OCR failed"), ("Error", "model init")], 9),
        ([("Error", "OCR failed")], 3),
        ([], 3),
    ]
    df = spark.createDataFrame(cases, "causes array<struct<kind:string,message:string>>, code int")
    assert df.where(errors.classify(F.col("causes"), F.lit(errors.CODES["ocr"])) != F.col("code")).count() == 0


def test_target_pages(spark):
    pages = spark.createDataFrame([(1, p, 5) for p in range(5)], "doc_id long, page int, n_pages int")
    got = lambda **k: sorted(r.page for r in plans.target_pages(pages, SearchOptions(**k)).collect())
    assert got(current_page_only=True, current_page=9, target_pages=(0,)) == [4]
    assert got(target_pages=(3, 1, 3, 77)) == [1, 3] and got(target_pages=()) == []
    assert got(start_page=3, end_page=1) == [3] and got(start_page=-4) == [0, 1, 2, 3, 4]


def test_ocr_requests(spark):
    rows = [(1, 0, TEXT_LAYER, 0, 50, 50), (1, 1, TEXT_LAYER, 0, 2, 2), (2, 0, TEXT_LAYER, 0, 50, 50)]
    index = spark.createDataFrame(rows, "doc_id long, page int, source string, status int, visible_chars int, valid_boxes int")
    found = spark.createDataFrame([(1, 0)], "doc_id long, page int")
    got = lambda **k: sorted(tuple(r) for r in plans.ocr_request(index, found, SearchOptions(**k)).collect())
    assert got() == [(1, 1)] and got(policy="UNUSABLE_OR_NO_MATCH") == [(1, 1), (2, 0)]
    assert got(page_level_fallback=False) == [(2, 0)] and len(got(mode="OCR_ONLY")) == 3
    assert got(mode="TEXT_ONLY") == [] == got(fallback_when_not_found=False)


def test_token_boxes_share_cells_and_never_invert(spark):
    runs = spark.createDataFrame([(1, 2, 3), (1, 6, 6), (1, 9, 10)], "k int, begin int, end int")
    assert [(r.left_step, r.right_step) for r in recognition.cell_bounds(runs, ["k"], F.lit(16)).orderBy("begin").collect()] == [(0.0, 5.0), (5.0, 8.0), (8.0, 16.0)]
    boxes = spark.createDataFrame([(1, 0, 0.0, 6.0), (1, 1, 4.0, 10.0), (1, 2, 20.0, 30.0), (1, 3, 0.0, 22.0)], "k int, i int, l double, r double")
    assert [(r.l, r.r) for r in recognition.clamp_neighbours(boxes, ["k"], "i").orderBy("i").collect()] == [(0.0, 5.0), (5.0, 10.0), (20.0, 30.0), (18.0, 22.0)]


def test_debug_boxes_need_sound_arrays(spark):
    kinds = "id int, seq int, text string, l double, t double, r double, b double, quad array<double>, token_boxes array<struct<l:double,t:double,r:double,b:double>>, begins array<int>, ends array<int>, bitmap_w double, bitmap_h double"
    box, wrong = (0.0, 0.0, 0.5, 1.0), (0.5, 0.0, 0.5, 1.0)
    rows = [
        (1, 0, "ab", 0.0, 0.0, 10.0, 10.0, None, [box, wrong], [0, 1], [1, 9], 100.0, 100.0),
        (2, 0, "ab", 0.0, 0.0, 10.0, 10.0, None, [box], [0, 1], [1, 2], 100.0, 100.0),
        (3, 0, "ab", 0.0, 0.0, 10.0, 10.0, None, None, None, None, 0.0, 100.0),
        (4, 0, None, None, None, None, None, None, None, None, None, 100.0, 100.0),
    ]
    got = sorted((r.id, r.n, r.label, r.box.r) for r in layout.debug_geometry(spark.createDataFrame(rows, kinds), ["id"]).collect())
    assert got == [(1, 0, "ab", 0.1), (1, 1, "a", 0.05), (2, 0, "ab", 0.1)]


def test_metrics_and_retries(spark):
    times = spark.createDataFrame([(1, 0, "DISK", -5, 7), (1, 1, None, 3, None)], "doc_id int, page int, cache_source string, render_ms long, total_ms long")
    assert [tuple(r)[2:] for r in plans.page_metrics(times).orderBy("page").collect()] == [("DISK", True, 0, 7), ("NONE", False, 3, 0)]
    errors = spark.createDataFrame([(1, 2, True), (1, 2, True), (1, 3, False), (1, 4, None)], "doc_id int, page int, retryable boolean")
    pages, options = plans.retry(errors, SearchOptions(current_page_only=True))
    assert [tuple(r) for r in pages.collect()] == [(1, 2)]
    assert (options.current_page_only, options.full_document_ocr, options.max_ocr_pages) == (False, True, 0)


def test_whole_words_between_matches_that_touch(spark):
    rows = [(1, 0, TEXT_LAYER, "on onon on_ (on)on éon"), (2, 0, TEXT_LAYER, "onon"), (3, 0, TEXT_LAYER, "on"), (4, 0, TEXT_LAYER, None)]
    pages = spark.createDataFrame(rows, "doc_id int, page int, source string, text string")
    plain = search.matches(pages, "on").orderBy("doc_id", "m_start").collect()
    assert [(r.doc_id, r.ordinal, r.m_start) for r in plain] == [(1, 0, 0), (1, 1, 3), (1, 2, 5), (1, 3, 8), (1, 4, 13), (1, 5, 16), (1, 6, 20), (2, 0, 0), (2, 1, 2), (3, 0, 0)]
    whole = search.matches(pages, "on", off(whole_word=True)).orderBy("doc_id", "m_start").collect()
    assert [(r.doc_id, r.ordinal, r.m_start) for r in whole] == [(1, 0, 0), (1, 1, 13), (1, 2, 16), (3, 0, 0)]
