"""Page indexes from characters and from blocks, reports of numbers, and the sealed store, on small cases."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscan import queries
from folioscan.functions import geometry, ids, text
from folioscan.operators import assembly, block_index, layout, search
from folioscan.sources import protocols, store

CHARS = "doc_id long, page int, idx int, code_point int, l double, b double, r double, t double"
FACTS = "doc_id long, page int, page_w double, page_h double, status int, raw_chars long, visible_chars long, valid_boxes long"
BLOCK = "array<struct<text:string,l:double,t:double,r:double,b:double,score:double,quad:array<double>,token_boxes:array<struct<l:double,t:double,r:double,b:double>>,begins:array<int>,ends:array<int>>>"
PAGES = f"doc_id long, page int, bitmap_w double, bitmap_h double, page_w double, page_h double, blocks {BLOCK}"


def test_characters_become_lines(spark):
    at = lambda line, col, flip=False: (6.0 * col, *((90.0 - 12 * line, 80.0 - 12 * line) if flip else (80.0 - 12 * line, 90.0 - 12 * line)))
    row = lambda i, c, line=None, col=0, flip=False: (1, 0, i, c, *(lambda x, b, t: (x, b, x + 6, t))(*at(line, col, flip))) if line is not None else (1, 0, i, c, None, None, None, None)
    rows = [row(0, ord("a"), 0, 0), row(1, ord(" ")), row(2, 0xD800, 0, 2), row(3, ord("b"), 0, 2, True), row(4, 0x1F600, 1, 0), row(5, ord("\r")), row(6, ord("\n")), row(7, ord("c"), 3, 0), row(8, 1 << 30, 0, 0), row(9, None, 0, 0), row(10, ord("d"), 3, 1)]
    facts = [(1, 0, 100.0, 100.0, 0, 9, 5, 5), (1, 1, 100.0, 100.0, 3, 0, 0, 0)]
    got = {r.page: r for r in assembly.index_of_characters(spark.createDataFrame(rows, CHARS), spark.createDataFrame(facts, FACTS)).collect()}
    assert got[0].text == "a b\n😀\r\ncd" and (got[0].status, got[0].conf) == (0, 1.0)
    assert [(t.text, t.start, t.line, t.l) for t in got[0].tokens] == [("a", 0, 0, 0.0), (" ", 1, 0, None), ("b", 2, 0, 12.0), ("\n", 3, 0, None), ("😀", 4, 1, 0.0), ("\r", 5, 1, None), ("\n", 6, 2, None), ("c", 7, 3, 0.0), ("d", 8, 3, 6.0)]
    assert (got[0].tokens[2].b, got[0].tokens[2].t) == (80.0, 90.0)  # edges put right
    assert (got[1].text, got[1].tokens, got[1].status, got[1].conf) == ("", [], 1, 0.0)


def block(text, l, t, r, b, score=0.5, boxes=None, quad=None):  # noqa: E741
    n = len(text)
    told = [(x0, 0.1, x1, 0.9) for x0, x1 in boxes] if boxes else None
    return (text, float(l), float(t), float(r), float(b), score, quad, told, list(range(n)) if boxes else None, list(range(1, n + 1)) if boxes else None)


def index(spark, *blocks, size=(1000.0, 1000.0, 500.0, 500.0), **options):
    (row,) = assembly.index_of_blocks(spark.createDataFrame([(1, 0, *size, list(blocks))], PAGES), **options).collect()
    return row


def test_blocks_of_one_line_and_the_next(spark):
    row = index(spark, block("检索", 10, 70, 100, 100, 0.9), block("OCR", 10, 10, 90, 40, 0.5), block("扫描", 110, 11, 180, 41, 0.7))
    assert row.text == "OCR 扫描\n检索" and row.conf == pytest.approx(0.7)
    assert [(t.text, t.line) for t in row.tokens] == [("O", 0), ("C", 0), ("R", 0), (" ", 0), ("扫", 0), ("描", 0), ("\n", 0), ("检", 1), ("索", 1)]
    first = row.tokens[0]
    assert (first.l, first.r, first.t, first.b) == pytest.approx((5.0, 5 + 40 / 3, 495.0, 480.0))
    assert (row.raw_chars, row.visible_chars, row.valid_boxes) == (9, 7, 7)


def test_lost_spaces_come_back_once(spark):
    boxes = [(0.02, 0.10), (0.11, 0.19), (0.20, 0.28), (0.34, 0.43), (0.44, 0.53)]
    assert index(spark, block("OCR扫描", 0, 0, 100, 20, boxes=boxes)).text == "OCR 扫描"
    assert index(spark, block("OCR 扫描", 0, 0, 100, 20, boxes=[*boxes[:3], (0.29, 0.33), (0.36, 0.45), (0.46, 0.55)])).text == "OCR 扫描"
    wrong = index(spark, block("ab", 0, 0, 100, 20, boxes=[(0.1, 0.2), (0.5, 0.5)]))
    assert wrong.text == "ab" and wrong.tokens[1].l is None and (wrong.visible_chars, wrong.valid_boxes) == (2, 1)


def test_tokens_through_a_quad(spark):
    row = index(spark, block("ab", 0, 0, 100, 40, boxes=[(0.0, 0.5), (0.5, 1.0)], quad=[0.0, 0.0, 100.0, 20.0, 100.0, 40.0, 0.0, 20.0]))
    a, b = row.tokens
    assert (a.l, a.r) == (0.0, 25.0) and (a.t, a.b) == pytest.approx((499.0, 486.0)) and (b.t, b.b) == pytest.approx((494.0, 481.0))


def test_two_columns_and_what_reaches_over_both(spark):
    left = [block(f"l{k}", 0, 100 + 50 * k, 300, 120 + 50 * k) for k in range(3)]
    right = [block(f"r{k}", 600, 100 + 50 * k, 900, 120 + 50 * k) for k in range(3)]
    over = block("over", 200, 170, 700, 190)
    got = index(spark, *right, over, *left).text.split("\n")
    assert got == ["l0", "l1", "r0", "r1", "over", "l2", "r2"]
    assert index(spark, *right, over, *left, detect_columns=False).text.split("\n")[:3] == ["l0", "r0", "l1"]


def test_pages_without_extent_or_blocks(spark):
    rows = [(1, 0, 0.0, 1.0, 1.0, 1.0, [block("a", 0, 0, 1, 1)]), (1, 1, 1.0, 1.0, 1.0, 1.0, []), (1, 2, 1.0, 1.0, 1.0, 1.0, None), (1, 3, 1.0, 1.0, 1.0, 1.0, [block("", 0, 0, 1, 1), (None,) * 10])]
    got = {r.page: r for r in assembly.index_of_blocks(spark.createDataFrame(rows, PAGES)).collect()}
    assert sorted(got) == [1, 2, 3] and all((r.text, r.tokens, r.conf, r.raw_chars) == ("", [], -1.0, 0) for r in got.values())


def test_pages_of_blocks_are_never_broadcast_or_shuffled(spark):
    indexes = [assembly.index_of_blocks(spark.createDataFrame([(1, 0, 9.0, 9.0, 9.0, 9.0, [block("a", 0, 0, 1, 1)])], PAGES)), queries.recognised_pages(spark, "/root/testdata/sf0.001")]
    for df in indexes:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Join", "Window", "Aggregate"))


def test_pages_are_indexed_in_parts(spark, monkeypatch):
    boxes = [(0.02, 0.10), (0.11, 0.19), (0.20, 0.28), (0.34, 0.43), (0.44, 0.53)]
    lines = [[block("OCR扫描", 0, 0, 100, 20, boxes=boxes), block(f"ab{k}", 120, 1, 180, 21)] for k in range(4)]
    rows = [(k, 0, 1000.0, 1000.0, 500.0, 500.0, x) for k, x in enumerate([*lines[:2], None, *lines[2:], []])]
    (batch,) = spark.createDataFrame(rows, PAGES).coalesce(1).toArrow().combine_chunks().to_batches()
    whole = [r for b in block_index.indexed([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(block_index, "PART_BYTES", 1)
    parts = list(block_index.indexed([batch]))
    assert len(parts) > 2 and [r for b in parts for r in b.to_pylist()] == whole
    assert [r["text"] for r in whole] == ["OCR 扫描 ab0", "OCR 扫描 ab1", "", "OCR 扫描 ab2", "OCR 扫描 ab3", ""]
    assert [x.to_pylist() for x in block_index.last_boxed(pa.concat_arrays([b["tokens"] for b in parts]))][0] == [10, 10, 0, 10, 10, 0]


def test_a_recognised_block_among_others(spark):
    """Even shares beside recognised boxes: the space between the blocks is judged by the widths of the recognised tokens."""
    row = index(spark, block("ab", 0, 0, 100, 20, boxes=[(0.0, 0.5), (0.5, 1.0)]), block("cd", 104, 0, 108, 20), block("ef", 150, 0, 250, 20, boxes=[(0.0, 0.5), (0.5, 1.0)]))
    assert row.text == "abcd ef" and [t.l for t in row.tokens] == [0.0, 25.0, 52.0, 53.0, None, 75.0, 100.0]


def test_characters_are_known_as_to_java(spark):
    wanted = {"cjk": (layout.CJK, block_index.IS_CJK), "latin": (layout.LATIN, block_index.IS_LATIN), "unseen": (text.UNSEEN, block_index.UNSEEN), "blank": ("\\s", block_index.BLANK)}
    chars = spark.range(0x110000).select("id", assembly.character(F.col("id")).alias("c")).where("c is not null")
    for pattern, bit in wanted.values():
        told = [r[0] for r in chars.where(F.rlike("c", F.lit(pattern))).select("id").orderBy("id").collect()]
        assert told == (block_index.kinds() & bit).nonzero()[0].tolist()
    for held, bit in ((layout.OPENING + layout.TIGHT, block_index.NO_SPACE_AFTER), (layout.CLOSING + layout.TIGHT, block_index.NO_SPACE_BEFORE)):
        assert sorted(set(map(ord, held))) == (block_index.kinds() & bit).nonzero()[0].tolist()


def test_pages_without_an_id_have_no_recognised_text(spark, tmp_path):
    spark.createDataFrame([(1, 0, "The end"), (None, 0, "The end"), (1, None, "x"), (2, 0, None)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(((r.doc_id, r.page, r.text, r.n_tokens, r.conf) for r in queries.recognised_pages(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, 0, "The end", 7, 0.5), (None, 0, "", 0, -1.0), (1, None, "", 0, -1.0), (2, 0, "", 0, -1.0)], key=repr)


def test_search_in_an_assembled_index(spark):
    pages = spark.createDataFrame([(1, 0, 1000.0, 1000.0, 500.0, 500.0, [block("search-", 10, 10, 90, 40), block("ENGINE", 10, 70, 90, 100)])], PAGES)
    (hit,) = search.hits(assembly.index_of_blocks(pages), "searchengine").collect()
    assert (hit.start, hit.length, len(hit.rects), hit.matched) == (0, 14, 2, "search-\nENGINE")


def test_glyph_widths(spark):
    kinds = "text string, tokens array<struct<token:string,l:double,t:double,r:double,b:double>>, w double"
    rows = [("abc", [("a", 0.0, 0.0, 0.1, 1.0), (" ", 0.1, 0.0, 0.9, 1.0), ("b", 0.2, 0.0, 0.5, 1.0)], 100.0), ("a b", None, 90.0), ("  ", None, 90.0), ("ab", [("a", 0.5, 0.0, 0.5, 1.0)], 10.0), ("a", None, 0.0)]
    df = spark.createDataFrame(rows, kinds)
    assert [r[0] for r in df.select(layout.glyph_width(F.col("text"), F.col("tokens"), F.col("w"))).collect()] == pytest.approx([20.0, 45.0, 0.0, 5.0, 0.0])


def test_reports_keep_pages_of_cut_matches():
    head = [protocols.TEXT_MAGIC, 1.0, 5.4, 2.0]
    page = lambda p, n: [p, 612.0, 792.0, 0.0, 9.0, 8.0, 8.0, n]
    match = [0.6, 3.5, 2.0, 2.0, 4.0, 6.0, 1.0, 2.0, 1.0, 1.0, float("nan"), 2.0]
    got = protocols.unpack_report([*head, *page(2.0, 2.0), *match, *match[:9]])
    assert got["n_pages"] == 5 and [(p["page"], p["n_matches"]) for p in got["pages"]] == [(2, 1)]
    assert got["rects"] == [{"page": 2, "ordinal": 1, "start": 4, "length": 2, "l": 1.0, "b": 2.0, "r": 4.0, "t": 6.0}]
    whole = protocols.unpack_report([*head, *page(2.0, 1.0), *match, *page(3.0, 1.0), 0.0, 0.0, 0.0, 0.0])
    assert [(p["page"], p["n_matches"]) for p in whole["pages"]] == [(2, 1), (3, 0)]
    for bad in (None, [], head[:3], [-41000.5, *head[1:]], [head[0], 2.0, 1.0, 0.0]):
        assert protocols.unpack_report(bad)["pages"] == []


def test_blocks_keep_quads_and_offsets():
    words = ["blank", "a", "bc", " "]
    quad = [0, 0, 9, 1, 9, 5, 0, 4]
    two = [protocols.BLOCK_MAGIC, 2.0, 4, 3, 0.9, 3, *quad, 1, 2, 99, *[0.0, -1.0, 0.5, 1.0] * 3, 0.0, 1.0]
    (got,) = protocols.unpack_blocks(two, words)
    assert (got["text"], got["quad"], got["begins"], got["ends"], got["boxes"][1]) == ("abc", [float(x) for x in quad], [0, 1, 3], [1, 3, 3], 0.0)
    (one,) = protocols.unpack_blocks([3, 1, 0.5, 0, 0, 9, 0, 9, 5, 2, 0, 1], words)
    assert (one["text"], one["quad"], one["boxes"], one["begins"], one["r"]) == ("bc", None, None, None, 9.0)
    assert protocols.unpack_blocks([4, 1, 0.5, *quad, 3, 0, 1], words) == [] == protocols.unpack_blocks([float("nan")] * 9, words)
    assert protocols.unpack_blocks([*two[:-1]], words) == []


def test_pages_of_blocks_become_rows():
    words = ["blank", "a", "bc", " "]
    quad = [0, 0, 9, 1, 9, 5, 0, 4]
    two = [protocols.BLOCK_MAGIC, 2.0, 4, 3, 0.9, 3, *quad, 1, 2, 99, *[0.0, -1.0, 0.5, 1.0] * 3, 0.0, 1.0]
    one = [3, 1, 0.5, 0, 0, 9, 0, 9, 5, 2, 0, 1]
    got = protocols.block_rows(pa.array([None, two, [], one, two], pa.list_(pa.float64())), words).to_pylist()
    box = {"l": 0.0, "t": 0.0, "r": 0.5, "b": 1.0}
    assert [len(p) for p in got] == [0, 1, 0, 1, 1] and got[1] == got[4]
    assert (got[1][0]["token_boxes"], got[1][0]["begins"], got[1][0]["quad"]) == ([box] * 3, [0, 1, 3], [float(x) for x in quad])
    assert [got[3][0][k] for k in ("text", "r", "score", "quad", "token_boxes", "begins", "ends")] == ["bc", 9.0, 0.5, None, None, None, None]
    assert protocols.block_rows(pa.array([], pa.list_(pa.float64())), words).to_pylist() == []


def test_decoders_of_columns(spark):
    df = spark.createDataFrame([(1, [protocols.TEXT_MAGIC, 1.0, 1.0, 0.0]), (2, None), (3, [])], "k int, v array<double>")
    assert [(r.k, r.x.n_pages, r.x.pages, r.x.rects) for r in df.select("k", protocols.decode_reports(F.col("v")).alias("x")).collect()] == [(1, 1, [], []), (2, 0, [], []), (3, 0, [], [])]
    assert [r.x for r in df.select(protocols.decode_blocks(F.col("v"), ["blank"]).alias("x")).collect()] == [[], [], []]
    assert df.select(protocols.legacy_rects(F.col("v")).alias("x")).where("size(x) > 0").count() == 0


def test_dictionary(spark, tmp_path):
    for text, want in (("a\nb\n", ["a", "b"]), ("a\nb", ["a", "b"]), ("", []), ("　\nx\n", ["　", "x"])):
        (tmp_path / "keys.txt").write_text(text, encoding="utf-8")
        assert protocols.load_dictionary(spark, str(tmp_path / "keys.txt")) == ["blank", *want, " "]


def test_sealed_entries(spark):
    rows = spark.createDataFrame([("k1", b"one"), ("k2", b""), ("k3", b"three"), ("k3", b"three")], "key string, payload binary")
    sealed = store.sealed(rows)
    found, misses = store.unsealed(rows.union(spark.createDataFrame([("k4", b"")], rows.schema)), sealed)
    assert sorted((r.key, bytes(r.payload)) for r in found.collect()) == [("k1", b"one"), ("k2", b""), ("k3", b"three")]
    assert [r.key for r in misses.collect()] == ["k4"]
    for wrong in (sealed.withColumn("crc", F.col("crc") + 1), sealed.withColumn("size", F.col("size") - 1), sealed.withColumn("version", F.lit("v")), sealed.withColumn("key", F.concat("key", F.lit("x"))), sealed.withColumn("payload", F.concat("payload", F.lit(b"x")))):
        assert store.unsealed(rows, wrong)[0].count() == 0


def test_strings_are_cut_between_characters(spark):
    texts = ["", "abc", "abcd", "abcé", "ab漢x", "a😀x", "😀😀", "ééé", None]
    want = ["", "abc", "abcd", "abc", "ab", "a", "😀", "éé", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(store.cut_long(F.col("t"), 4)).collect()] == want


def test_result_ids_round_half_up(spark):
    rects = "cast(array(named_struct('l', {}, 'b', 0D, 'r', 2D, 't', 1D)) as array<struct<l:double,b:double,r:double,t:double>>)"
    same = lambda a, b: spark.range(1).select(*(ids.result_id(F.lit("d"), F.lit(0), F.lit("OCR"), F.lit("m"), F.expr(rects.format(x)), F.lit(0)).alias(n) for n, x in (("a", a), ("b", b)))).where("a = b").count() == 1
    assert same("1.0005D", "1.001D") and same("0.0625D", "0.063D") and same("0.1875D", "0.188D") and not same("0.0625D", "0.062D")


def test_sizes_of_drawn_pages(spark):
    height = lambda w, h, n: spark.range(1).select(geometry.render_height(F.lit(w), F.lit(h), n)).first()[0]
    assert [height(612.0, 792.0, 1280), height(1000.0, 0.1, 100), height(0.0, 5.0, 100), height(5.0, 5.0, 0)] == [1656, 1, None, None]
    width = lambda w, h, r: spark.range(1).select(geometry.recognition_width(F.lit(w), F.lit(h), F.lit(r))).first()[0]
    assert [width(100.0, 30.0, 10.0), width(1000.0, 30.0, 10.5)] == [107, 336]
