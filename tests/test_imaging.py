"""Detector maps, crops, ink and token boxes on small images."""

import time

import numpy as np
import pyarrow as pa
import pytest

from folioscan import queries
from folioscan.operators import imaging


def flood(mask, diagonal):
    """Regions by growing each from its first pixel."""
    out, n = np.zeros(mask.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        left = [(y, x)]
        out[y, x] = n
        while left:
            v, u = left.pop()
            for a, b in steps:
                if 0 <= v + a < mask.shape[0] and 0 <= u + b < mask.shape[1] and mask[v + a, u + b] and not out[v + a, u + b]:
                    out[v + a, u + b] = n
                    left.append((v + a, u + b))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.7, 1.0])
def test_components_against_flooding(diagonal, share):
    mask = np.random.default_rng(3).random((23, 31)) < share
    assert np.array_equal(imaging.components(mask, diagonal), flood(mask, diagonal))


def test_smallest_box_of_a_turned_rectangle():
    turn = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    inner = np.random.default_rng(1).random((50, 2)) * [40, 10]
    corners = np.array([[0, 0], [40, 0], [40, 10], [0, 10]])
    quad, side = imaging.smallest_box(np.concatenate([inner, corners]) @ turn.T)
    assert side == pytest.approx(10)
    assert np.allclose(quad, corners @ turn.T)


@pytest.mark.parametrize("points", [[(3, 4)], [(3, 4), (9, 4)], [(1, 1), (2, 2), (3, 3)]])
def test_boxes_without_area(points):
    assert imaging.smallest_box(np.array(points, float))[1] == pytest.approx(0)


def test_text_boxes_follow_the_rounded_map():
    scores = np.zeros((60, 120), np.float32)
    scores[10:20, 10:50] = 0.9
    scores[10:20, 60:100] = 0.45  # rounds to 0
    scores[40:42, 10:50] = 0.9  # too thin
    assert imaging.text_boxes(scores, 120, 60) == [[3, 3, 56, 3, 56, 26, 3, 26]]  # grown by 39 * 9 / 48 pixels
    assert imaging.text_boxes(scores, 240, 60) == [[6, 3, 112, 3, 112, 26, 6, 26]]
    assert imaging.text_boxes(np.zeros((0, 0), np.float32), 10, 10) == []


def test_holes_are_outlines_too():
    scores = np.zeros((80, 80), np.float32)
    scores[10:70, 10:70] = 0.9
    scores[35:45, 35:45] = 0.4
    found = imaging.text_boxes(scores, 80, 80)
    assert len(found) == 2  # the hole's rim spans a box whose mean, 0.56, passes as well
    scores[35:45, 35:45] = 0.0
    assert len(imaging.text_boxes(scores, 80, 80)) == 1


def test_crop_rights_a_turned_image():
    image = np.arange(40 * 60, dtype=np.int64).reshape(40, 60)
    assert np.array_equal(imaging.crop(image, [10, 5, 50, 5, 50, 25, 10, 25]), image[5:25, 10:50])
    upright = imaging.crop(image, [10, 5, 20, 5, 20, 35, 10, 35])
    assert np.array_equal(upright, np.rot90(image[5:35, 10:20]))
    assert imaging.crop(image, [10, 5, 10, 5, 10, 5, 10, 5]).size == 0


@pytest.mark.parametrize("paper", [230, 20])
def test_foreground_of_either_polarity_without_specks(paper):
    ink = 250 - paper
    image = np.full((24, 80), paper, np.uint8)
    image[4:20, 10:14] = ink
    image[12, 50] = ink
    expected = np.zeros(image.shape, bool)
    expected[4:20, 10:14] = True
    assert np.array_equal(imaging.foreground(image), expected)
    assert np.array_equal(imaging.foreground(np.repeat(image[..., None], 3, 2)), expected)
    assert not imaging.foreground(np.full((5, 5), 200, np.uint8)).any()


def test_token_boxes_from_ink_and_from_steps():
    mask = np.zeros((20, 100), bool)
    mask[4:16, 22:26] = True
    # The second token has no ink: its own two steps and one pixel either side, widened to 9 columns.
    got = imaging.token_boxes(mask, [(4, 5), (12, 12)], 20)
    assert got[0] == pytest.approx([0.22, 0.15, 0.26, 0.85])
    assert got[1] == pytest.approx([0.58, 0.15, 0.67, 0.85])
    turned = imaging.token_boxes(mask, [(4, 5), (12, 12)], 20, turned=True)
    assert turned[0] == pytest.approx([0.74, 0.15, 0.78, 0.85])
    assert imaging.token_boxes(mask, [], 20) == imaging.token_boxes(mask[:, :0], [(0, 1)], 20) == []


def test_images_that_do_not_fill_their_size_have_no_boxes(spark):
    maps = spark.createDataFrame([(1, None, 2, 2, 2, 2), (2, b"x", 2, 2, 2, 2), (3, b"", 0, 0, 2, 2)], "id int, scores binary, map_w int, map_h int, source_w int, source_h int")
    assert imaging.detect(maps, ["id"]).count() == 0
    lines = spark.createDataFrame([(1, None, 1, 1, [0], [0], 4, False), (2, b"x", 1, 1, [0], [0], 4, False)], "id int, pixels binary, width int, height int, begins array<int>, ends array<int>, steps int, turned boolean")
    assert [r["id"] for r in imaging.align(lines, ["id"]).collect()] == [2]


def test_maps_are_drawn_one_by_one():
    pages = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["ab"] * 9)], ["doc_id", "text"])
    drawn = queries._drawn(["doc_id"], "text", lambda t: (t.encode(), len(t)), [("pixels", pa.binary()), ("width", pa.int32())])
    assert [b.to_pylist() for b in drawn(iter([pages]))] == [[{"doc_id": i, "pixels": b"ab", "width": 2}] for i in range(9)]


def test_maps_drawn_on_the_spot_have_the_boxes_of_stored_ones(spark):
    scores = np.full((40, 100), 0.1, "<f4")
    scores[10:20, 10:60] = 0.9
    row = (scores.tobytes(), 100, 40, 200, 80)
    fields = [("scores", pa.binary()), *((k, pa.int32()) for k in ("map_w", "map_h", "source_w", "source_h"))]
    stored = spark.createDataFrame([(1, *row), (2, *row)], "id int, scores binary, map_w int, map_h int, source_w int, source_h int")
    texts = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    boxes = [sorted(map(tuple, found.collect())) for found in (imaging.detect(stored, ["id"]), imaging.detect(texts, ["id"], queries._drawn(["id"], "text", lambda _: row, fields)))]
    assert boxes[0] == boxes[1] and [b[:2] for b in boxes[0]] == [(1, 0), (2, 0)]


def test_results_leave_in_small_batches():
    one = lambda b: [[0, 1], [b, b[:9]]]
    rows = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([*[bytes([i]) * (1 << 20) for i in range(11)], None])], ["id", "pixels"])
    got = list(imaging.in_batches(iter([rows]), ["id"], ["pixels"], one, [("n", "int", pa.int32()), ("cut", "binary", pa.binary())]))
    assert len(got) > 1 and max(b.nbytes for b in got) < imaging.BATCH_BYTES + (2 << 20)
    assert [(r["id"], r["n"], r["cut"][:1], len(r["cut"])) for b in got for r in b.to_pylist()] == [(i, n, bytes([i]), (1 << 20, 9)[n]) for i in range(11) for n in (0, 1)]


def test_token_boxes_take_less_time_than_the_ink_of_each_token():
    mask = np.random.default_rng(2).random((12, 18_000)) < 0.5
    runs = [(8 * i + 2, 8 * i + 5) for i in range(3000)]

    def seconds(f):
        begin = time.perf_counter()
        f()
        return time.perf_counter() - begin

    each = lambda: [imaging.ink_bounds(mask, 6 * i, 6 * i + 6, imaging.TOKEN_INK) for i in range(3000)]
    assert min(seconds(lambda: imaging.token_boxes(mask, runs, 24_000)) for _ in range(3)) < min(seconds(each) for _ in range(3))
    got, bounds = np.array(imaging.token_boxes(mask, runs, 24_000)), np.array(each())
    assert np.array_equal(got[:, 1], bounds[:, 1] / 12) and np.array_equal(got[:, 3], bounds[:, 3] / 12)
    assert np.abs(got[:, [0, 2]] * 18_000 - bounds[:, [0, 2]]).max() < 1.01  # a cell may reach into the next pixel
