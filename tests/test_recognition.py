"""Recognition around its networks, the pages that fail, and requests that are ended or taken up again."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscan.model import OCR, TEXT_LAYER, SearchOptions
from folioscan.operators import imaging, recognition
from folioscan.plans import pages as plans
from folioscan.sources import derive, store
from folioscan.streaming import pages as streaming

INDEX = "doc_id long, page int, source string, text string, page_w double, page_h double, status int, raw_chars int, visible_chars int, valid_boxes int, conf double"


def test_tensor_puts_channels_apart():
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    got = imaging.tensor(image)
    assert got.shape == (3, 2, 4) and got.dtype == np.float32
    for c in range(3):
        for y in range(2):
            for x in range(4):
                assert got[c, y, x] == pytest.approx((image[y, x, c] / 255 - imaging.DETECTOR_NORM[0][c]) / imaging.DETECTOR_NORM[1][c], abs=1e-5)
    assert imaging.tensor(image, imaging.RECOGNISER_NORM).min() == -1


def test_images_that_do_not_fill_their_size_give_nothing(spark):
    rows = [(1, b"12345678", 4, 2, 1), (2, b"123", 4, 2, 1), (3, None, 4, 2, 1), (4, b"", 0, 0, 1)]
    df = spark.createDataFrame(rows, "k int, pixels binary, width int, height int, channels int")
    assert sorted(r.k for r in imaging.tensors(df, ["k"]).collect()) == [1, 4]
    quads = df.withColumn("quads", F.expr("array(array(0, 0, 3, 0, 3, 2, 0, 2), array(1, 1, 1, 1, 1, 1, 1, 1), array(2, 0, 4, 0, 4, 2, 2, 2))"))
    got = {(r.k, r.n): (bytes(r.pixels), r.width, r.height) for r in imaging.crops(quads.where("k < 4"), ["k"]).collect()}
    assert got == {(1, 0): (b"123567", 3, 2), (1, 2): (b"3478", 2, 2)}


def test_detect_and_recognise_with_a_plug_in(spark):
    scores, image = np.full((60, 200), 0.1, "<f4"), np.zeros((120, 400, 1), np.uint8)
    for k, y in enumerate((8, 36)):
        scores[y : y + 10, 10:150] = 0.95
        image[2 * y : 2 * y + 20, 20:300] = 50 * (k + 1)
    rows = [(1, scores.tobytes(), 200, 60, image.tobytes(), 400, 120, 1), (2, None, 200, 60, image.tobytes(), 400, 120, 1)]
    pages = spark.createDataFrame(rows, "doc_id int, scores binary, map_w int, map_h int, pixels binary, width int, height int, channels int")

    def shade(crops: pd.DataFrame) -> pd.Series:
        return crops["pixels"].map(lambda b: f"shade {max(b)}")

    got = {r.read: (r.doc_id, r.quad[1]) for r in recognition.detect_and_recognise(pages, ["doc_id"], shade, "string").collect()}
    assert sorted(got) == ["shade 100", "shade 50"] and got["shade 50"][1] < 30 < got["shade 100"][1]


def test_orientation(spark):
    rows = [([0.2, 0.95],), ([0.2, 0.9],), ([0.95, 0.95],), ([0.0, -1.0],), ([],), ([0.1, 0.2, 0.3, 0.99],), (None,)]
    df = spark.createDataFrame(rows, "s array<double>").select(recognition.orientation(F.col("s")).alias("x"))
    assert [(r.x.label, r.x.turned) for r in df.collect()] == [(1, True), (1, False), (0, False), (0, False), (0, False), (3, True), (0, False)]


def test_pages_fall_back_to_their_text(spark):
    page = lambda i, source, text, n: (1, i, source, text, 1.0, 1.0, 0, n, n, n, 1.0)
    rows = [page(0, TEXT_LAYER, "long enough to use", 18), page(1, TEXT_LAYER, "x", 1), page(1, OCR, "read", 4), page(2, TEXT_LAYER, "x", 1), page(3, TEXT_LAYER, "", 0), page(4, TEXT_LAYER, "", 0), page(4, OCR, "", 0)]
    index = spark.createDataFrame(rows, INDEX)
    options = SearchOptions(full_document_ocr=True, ocr_target_pages=(1, 4))
    got = {r.page: (r.state, r.source) for r in plans.resolve_with_fallback(index, options).collect()}
    assert got == {0: ("COMPLETED", TEXT_LAYER), 1: ("COMPLETED", OCR), 2: ("COMPLETED", TEXT_LAYER), 3: ("SKIPPED", None), 4: ("FAILED", None)}
    assert [(r.page, r.stage, r.retryable) for r in plans.page_errors(plans.resolve(index, options)).collect()] == [(4, 3, True)]
    pages = index.select("doc_id", "page")
    assert {r.route for r in plans.backend_failed(pages, SearchOptions(page_level_fallback=False)).collect()} == {"FAIL"}
    assert plans.extracted(pages, index.limit(0)).where("status = 1 and text = ''").count() == 5


def test_the_nearer_store_comes_first(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id int, page int, blocks array<string>")
    got = store.prepared(frame((1, 0, None), (1, 1, None), (1, 2, None)), frame((1, 0, ["m"])), frame((1, 0, ["d"]), (1, 1, ["d"])))
    assert sorted((r.page, r.cache_source, r.blocks) for r in got.collect()) == [(0, "MEMORY", ["m"]), (1, "DISK", ["d"]), (2, "NONE", None)]


def test_a_request_is_ended_and_others_go_on(spark):
    ended = []

    def slow(x):
        time.sleep(30)
        return x

    def work():
        with streaming.request(spark, "doc"):
            try:
                spark.sparkContext.parallelize(range(2), 2).map(slow).count()
            except Exception as stopped:  # noqa: BLE001
                ended.append(stopped)

    from pyspark import InheritableThread

    thread = InheritableThread(target=work)
    thread.start()
    time.sleep(4)
    streaming.cancel(spark, "another")
    assert spark.range(10).count() == 10 and thread.is_alive()
    streaming.cancel(spark, "doc")
    thread.join(15)
    assert not thread.is_alive() and len(ended) == 1


def test_a_stopped_delivery_goes_on_behind_its_last_page(spark, tmp_path):
    feed = spark.createDataFrame([(1, p, f"text {p}") for p in range(4)], "doc_id long, page int, text string")
    where = [f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint")]
    for part in (feed.where("page < 2"), feed.where("page >= 2")):
        part.repartition(2).write.mode("append").parquet(where[0])
        streaming.deliver(streaming.page_stream(spark, where[0], feed.schema), F.char_length("text"), where[1], where[2])
        done = spark.read.parquet(where[1])
        assert done.count() == done.dropDuplicates(["doc_id", "page"]).count()
    assert [r.total for r in streaming.cumulative(spark.read.parquet(where[1])).orderBy("page").collect()] == [6, 12, 18, 24]


def test_ranges_of_pages(spark):
    index = spark.createDataFrame([(d, p) for d, n in ((1, 3), (2, 6)) for p in range(n)], "doc_id int, page int")
    got = lambda *r: sorted(tuple(x) for x in derive.scan(index, *r).collect())
    assert got(-3, 0) == [(1, 0), (2, 0)] and got(2) == [(1, 2), (2, 2), (2, 3), (2, 4), (2, 5)] and got(4, 99) == [(2, 4), (2, 5)] and got(3, 1) == []
    assert derive.extracted_or_fail(index) is index
    with pytest.raises(RuntimeError):
        derive.extracted_or_fail(index.limit(0))


def test_a_write_that_fails_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, 0, TEXT_LAYER, "a"), (1, 0, OCR, "b")], "doc_id long, page int, source string, text string")
    store.save(rows, path)
    broken = rows.withColumn("text", F.when(F.col("source") == OCR, F.raise_error(F.lit("lost")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        store.save(broken, path)
    assert sorted(r.text for r in store.load(spark, path).collect()) == ["a", "b"]
    store.save(rows.where(F.col("source") == OCR).withColumn("text", F.lit("new")), path)
    assert sorted(r.text for r in store.load(spark, path).collect()) == ["a", "new"]
