"""Pixels around the recognition networks: text boxes from a detector's map, crops, ink, and token boxes.

Images are numpy arrays (rows, columns); the Spark side carries them as binary
columns with their width and height and works on one image a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the detector's post-processing.
MIN_SIDE, MIN_GROWN_SIDE, MIN_SCORE, MIN_PIXELS, MAX_CONTOURS, GROWTH = 3, 5, 0.5, 10, 1000, 2.0
#: Fixed values of token alignment: horizontal shares of the ink of a token and of a line, vertical shares, rows added.
TOKEN_INK, LINE_INK, INK_ROWS, ROW_PAD = (0.005, 0.995), (0.0025, 0.9975), (0.02, 0.98), 1
#: Fixed values of noise removal: least share of the image's area, least share of its height.
NOISE_AREA, STROKE_PART = 0.00012, 12
#: Weights of blue, green and red in a grey value.
GREY = (0.114, 0.587, 0.299)
#: Mean and spread of the channels that a detector and a recogniser expect.
DETECTOR_NORM = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
RECOGNISER_NORM = ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))


def _runs(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first pixel, pixel behind the last and region (from 1 in scan order) of each horizontal run, in scan order; runs of adjacent rows that touch are united."""
    height, width = mask.shape
    framed = np.zeros((height, width + 2), bool)
    framed[:, 1:-1] = mask
    change = np.flatnonzero(framed[:, 1:] != framed[:, :-1])  # begins and ends by turns
    rows, begins = np.divmod(change[::2], width + 1)
    ends = change[1::2] % (width + 1)
    # Runs of the row above that a run touches stand next to each other.
    reach, stride = int(diagonal), width + 4
    above = (rows - 1) * stride
    low = np.searchsorted(rows * stride + ends, above + begins - reach, side="right")
    high = np.maximum(np.searchsorted(rows * stride + begins, above + ends + reach, side="left"), low)
    many = high - low
    run = np.repeat(np.arange(len(rows)), many)
    other = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
    parent = np.arange(len(rows))
    while len(run):
        x, z = parent[run], parent[other]
        if np.array_equal(x, z):
            break
        np.minimum.at(parent, np.maximum(x, z), np.minimum(x, z))
        while not np.array_equal(upper := parent[parent], parent):
            parent = upper
    return rows, begins, ends, np.unique(parent, return_inverse=True)[1] + 1


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Number of each pixel's connected region, from 1 in scan order; 0 outside the mask."""
    rows, begins, ends, numbers = _runs(mask, diagonal)
    edges = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    edges[rows, begins], edges[rows, ends] = numbers, -numbers
    return np.cumsum(edges, axis=1, dtype=np.int32)[:, :-1]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) rows, in one turning sense."""
    points = np.unique(points, axis=0)
    # Only the ends of each column can be corners.
    turn = points[1:, 0] != points[:-1, 0]
    points = points[np.append(True, turn) | np.append(turn, True)]
    if len(points) < 3:
        return points

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def smallest_box(points: np.ndarray) -> tuple[np.ndarray, float]:
    """The rotated rectangle of least area around the points, corners clockwise from the top left, and its shorter side."""
    corners = hull(np.asarray(points, float))
    edges = np.roll(corners, -1, 0) - corners if len(corners) > 1 else np.array([[1.0, 0.0]])
    along = edges / np.maximum(np.hypot(*edges.T), 1e-12)[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    u, v = corners @ along.T, corners @ across.T
    sizes = np.stack([np.ptp(u, axis=0), np.ptp(v, axis=0)], 1)
    k = int(np.argmin(np.round(sizes.prod(1), 9)))
    sides = [(u[:, k].min(), v[:, k].min()), (u[:, k].max(), v[:, k].min()), (u[:, k].max(), v[:, k].max()), (u[:, k].min(), v[:, k].max())]
    return clockwise(np.array([a * along[k] + b * across[k] for a, b in sides])), float(sizes[k].min())


def clockwise(quad: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: the two leftmost corners are the left side."""
    by_x = quad[np.lexsort((quad[:, 1], np.round(quad[:, 0], 6)))]
    left, right = (side[np.argsort(side[:, 1], kind="stable")] for side in (by_x[:2], by_x[2:]))
    return np.array([left[0], right[0], right[1], left[1]])


def mean_inside(values: np.ndarray, quad: np.ndarray) -> float:
    """Mean of the pixels in a convex quad and on its outline."""
    height, width = values.shape
    corners = np.trunc(quad)
    x0, y0 = np.clip(np.floor(quad.min(0)).astype(int), 0, [width - 1, height - 1])
    x1, y1 = np.clip(np.ceil(quad.max(0)).astype(int), 0, [width - 1, height - 1])
    y, x = np.ogrid[y0 : y1 + 1, x0 : x1 + 1]
    inside = np.ones((y1 + 1 - y0, x1 + 1 - x0), bool)
    for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, 0), strict=True):
        length = math.hypot(bx - ax, by - ay)
        if length:
            inside &= ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length >= -0.5
    return float(values[y0 : y1 + 1, x0 : x1 + 1][inside].mean()) if inside.any() else 0.0


def grown(quad: np.ndarray, ratio: float = GROWTH) -> tuple[np.ndarray, float]:
    """The smallest box around a quad that was widened, with round corners, by area * ratio / perimeter; points are whole pixels."""
    ahead = np.roll(quad, -1, 0)
    perimeter = np.hypot(*(quad - ahead).T).sum()
    area = abs((quad[:, 0] * ahead[:, 1] - quad[:, 1] * ahead[:, 0]).sum()) / 2
    distance = area * ratio / perimeter if perimeter else 0.0
    turns = np.arange(0, 360, 3) * np.pi / 180
    base = np.trunc(quad)
    way = np.roll(base, -1, 0) - base
    normals = np.arctan2(-way[:, 0], way[:, 1])
    angles = np.concatenate([turns, normals])
    ring = distance * np.stack([np.cos(angles), np.sin(angles)], 1)
    points = (base[:, None, :] + ring[None]).reshape(-1, 2)
    return smallest_box(np.sign(points) * np.floor(np.abs(points) + 0.5))


def text_boxes(scores: np.ndarray, source_w: int, source_h: int) -> list[list[int]]:
    """Boxes (x, y of four corners, clockwise) in source pixels from a detector's map of scores.

    The map is rounded to whole numbers before it is compared, so a pixel belongs to
    text where its score is above 0.5.  Regions and the holes in them are outlines;
    of more than ``MAX_CONTOURS`` the last in scan order are taken.
    """
    height, width = scores.shape
    if not scores.size:
        return []
    mask = np.rint(scores) >= 1
    outlines = []
    rows, begins, ends, number = _runs(mask, True)
    order = np.argsort(number, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
        # Only the ends of its runs can be corners of a region's hull.
        ends_of = np.stack([np.append(begins[part], ends[part] - 1), np.append(rows[part], rows[part])], 1)
        outlines.append(((rows[part[0]], begins[part[0]]), ends_of))
    holes = components(np.pad(~mask, 1, constant_values=True), diagonal=False)
    y, x = np.nonzero(holes > 1)  # the margin is the first
    number, begin = np.unique(holes[y, x], return_index=True)
    sides = [(holes[y, x], y + dy, x + dx) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))]
    whose, y_side, x_side = (np.concatenate(part) for part in zip(*sides, strict=True))
    rim = holes[y_side, x_side] == 0
    whose, rims = whose[rim], np.stack([x_side[rim] - 1, y_side[rim] - 1], 1)
    order = np.argsort(whose, kind="stable")
    for k, part in zip(begin, np.split(order, np.searchsorted(whose[order], number[1:])) if len(number) else [], strict=True):
        outlines.append(((y[k] - 1, x[k] - 2), rims[part]))
    outlines.sort(key=lambda o: o[0], reverse=True)
    found = []
    for _, points in outlines[:MAX_CONTOURS]:
        quad, side = smallest_box(points)
        if side < MIN_SIDE or mean_inside(scores, quad) < MIN_SCORE:
            continue
        quad, side = grown(quad)
        if side < MIN_GROWN_SIDE:
            continue
        quad = clockwise(np.clip(np.floor(quad + 0.5), 0, [width, height]))
        quad = np.clip(np.trunc(quad / [width / source_w, height / source_h]), 0, [source_w - 1, source_h - 1])
        if all(int(math.dist(quad[0], quad[k])) > MIN_PIXELS for k in (1, 3)):
            found.append(quad.astype(int).ravel().tolist())
    return found


def crop(image: np.ndarray, quad: Sequence[int]) -> np.ndarray:
    """The quad of an image (x, y of four corners, clockwise) made upright; one at least 1.5 times as high as wide is turned to the left."""
    corners = np.asarray(quad, float).reshape(4, 2)
    low, high = corners.min(0).astype(int), corners.max(0).astype(int)
    part = image[low[1] : high[1], low[0] : high[0]].astype(float)
    corners = corners - low
    w, h = int(math.dist(corners[0], corners[1])), int(math.dist(corners[0], corners[3]))
    if not (w and h and part.size):
        return np.zeros((0, 0, *image.shape[2:]), image.dtype)
    rows = []
    for (x, y), (u, v) in zip([(0, 0), (w, 0), (w, h), (0, h)], corners, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    a, b, c, d, e, f, g, i = np.linalg.solve(np.array(rows), corners.ravel())
    y, x = np.mgrid[:h, :w]
    scale = g * x + i * y + 1
    u = np.clip((a * x + b * y + c) / scale, 0, part.shape[1] - 1)
    v = np.clip((d * x + e * y + f) / scale, 0, part.shape[0] - 1)
    u0, v0 = np.floor(u).astype(int), np.floor(v).astype(int)
    u1, v1 = np.minimum(u0 + 1, part.shape[1] - 1), np.minimum(v0 + 1, part.shape[0] - 1)
    fu, fv = (t.reshape(h, w, *[1] * (image.ndim - 2)) for t in (u - u0, v - v0))
    out = (part[v0, u0] * (1 - fu) + part[v0, u1] * fu) * (1 - fv) + (part[v1, u0] * (1 - fu) + part[v1, u1] * fu) * fv
    out = np.rint(out).astype(image.dtype)
    return np.rot90(out) if h >= 1.5 * w else out


def best_cut(grey: np.ndarray) -> int:
    """Otsu's threshold: the grey value up to which pixels differ most from those above; 0 for a single value."""
    share = np.bincount(grey.ravel(), minlength=256) / grey.size
    below, sums = np.cumsum(share), np.cumsum(share * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * (1 - below) * (sums / below - (sums[-1] - sums) / (1 - below)) ** 2
    return int(np.argmax(np.where((below > 1e-7) & (below < 1 - 1e-7), spread, 0)))


def foreground(image: np.ndarray) -> np.ndarray:
    """Mask of the ink: what Otsu's threshold parts from the border's shade, without specks; all of it if nothing else is left."""
    grey = image if image.ndim == 2 else np.rint(image[..., :3] @ np.array(GREY)).astype(np.uint8)
    if not grey.size:
        return np.zeros(grey.shape, bool)
    border = np.concatenate([grey[0], grey[-1], grey[1:-1, 0], grey[1:-1, -1]])
    dark_ink = border.mean() >= 127
    cut = best_cut(grey)
    mask = grey <= cut if dark_ink else grey > cut
    labels = components(mask)
    n = int(labels.max())
    if not n:
        return mask
    ys, xs = np.nonzero(labels)
    number = labels[ys, xs]
    area = np.bincount(number, minlength=n + 1)
    extent = []
    for at in (ys, xs):
        low, high = np.full(n + 1, 1 << 30), np.full(n + 1, -1)
        np.minimum.at(low, number, at)
        np.maximum.at(high, number, at)
        extent.append(high - low + 1)
    stroke = max(2, grey.shape[0] // STROKE_PART)
    good = (area >= max(2, math.floor(grey.size * NOISE_AREA + 0.5))) & ((extent[0] >= stroke) | (extent[1] >= stroke))
    good[0] = False
    return good[labels] if good.any() else mask


def quantile_index(counts: np.ndarray, q: float) -> int:
    """The first index whose running count exceeds floor(total * q)."""
    upto = np.cumsum(counts)
    return int(min(np.searchsorted(upto, math.floor(upto[-1] * q), side="right"), len(counts) - 1))


def ink_bounds(mask: np.ndarray, x0: int, x1: int, across: tuple[float, float]) -> tuple[int, int, int, int] | None:
    """(left, top, right, bottom; the latter two exclusive) of the ink between columns x0 and x1; None for fewer than two pixels."""
    part = mask[:, x0:x1]
    if part.sum() < 2:
        return None
    left, right = (quantile_index(part.sum(0), q) for q in across)
    top, bottom = (quantile_index(part.sum(1), q) for q in INK_ROWS)
    return x0 + left, max(0, top - ROW_PAD), x0 + right + 1, min(len(mask), bottom + 1 + ROW_PAD)


def token_boxes(mask: np.ndarray, runs: Sequence[tuple[int, int]], steps: int, turned: bool = False) -> list[list[float]]:
    """Boxes (l, t, r, b; shares of the line) of tokens from their first and last steps and the line's ink.

    A token owns the columns up to halfway to its neighbours.  Its box is the ink in
    them, else what its own steps cover, at least 0.45 line heights wide where there
    is room.  Boxes that still overlap meet halfway between their centres.
    """
    height, width = mask.shape
    if not (height and width and steps > 0):
        return []
    line = ink_bounds(mask, 0, width, LINE_INK)
    top, bottom = (line[1], line[3]) if line else (0, height)
    per_step = width / steps
    if not len(runs):
        return []
    begin, end = np.array(runs, np.int64).T
    middle = (end[:-1] + begin[1:] + 1) / 2
    lower, upper = np.append(0.0, middle), np.append(middle, float(steps))
    x0 = np.minimum(np.maximum(0, np.floor(lower / steps * width).astype(int)), width - 1)
    x1 = np.maximum(x0 + 1, np.minimum(width, np.ceil(upper / steps * width).astype(int)))
    # The ink of all cells at once, from running sums along the rows.
    upto = np.zeros((height, width + 1), np.int64)
    np.cumsum(mask, axis=1, out=upto[:, 1:])
    columns = upto.sum(0)
    total = columns[x1] - columns[x0]
    left, right = (np.minimum(np.searchsorted(columns[1:], columns[x0] + np.floor(total * q), side="right"), x1 - 1) for q in TOKEN_INK)
    down = np.cumsum(upto[:, x1] - upto[:, x0], axis=0)
    up, low = (np.minimum((down <= np.floor(total * q)).sum(0), height - 1) for q in INK_ROWS)
    right, up, low = right + 1, np.maximum(0, up - ROW_PAD), np.minimum(height, low + 1 + ROW_PAD)
    for k in np.flatnonzero(total < 2):
        left[k], right[k] = _active(int(begin[k]), int(end[k]), per_step, int(x0[k]), int(x1[k]), height)
        up[k], low[k] = top, bottom
    l, t, r, b = left / width, up / height, right / width, low / height  # noqa: E741
    centre = (l + r) / 2
    half = (centre[:-1] + centre[1:]) / 2
    new_l, new_r = l.copy(), r.copy()
    meet = r[:-1] > l[1:]
    new_l[1:] = np.where(meet, np.maximum(l[1:], half), l[1:])
    new_r[:-1] = np.where(meet, np.minimum(r[:-1], half), r[:-1])
    new_l, new_r = np.maximum(new_l, x0 / width), np.minimum(new_r, x1 / width)
    sound = new_r > new_l
    l, r = np.where(sound, new_l, l), np.where(sound, new_r, r)  # noqa: E741
    return np.stack([1 - r, 1 - b, 1 - l, 1 - t] if turned else [l, t, r, b], 1).tolist()


def _active(begin: int, end: int, per_step: float, x0: int, x1: int, height: int) -> tuple[int, int]:
    """Columns of a token's own steps, a little wider, inside its cell."""
    pad = max(1, math.floor(per_step * 0.35 + 0.5))
    left, right = max(x0, math.floor(begin * per_step) - pad), min(x1, math.ceil((end + 1) * per_step) + pad)
    least = min(x1 - x0, max(2, math.floor(height * 0.45 + 0.5)))
    if right - left < least:
        left = min(max(x0, math.floor((left + right) / 2 - least / 2)), x1 - least)
        right = left + least
    return left, right


#: A batch of results goes on when it has about so many bytes.
BATCH_BYTES = 8 << 20
Drawn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _each(rows: DataFrame, keys: Sequence[str], names: Sequence[str], one: Callable[..., Sequence[Sequence]], fields: Sequence[tuple[str, str, pa.DataType]], drawn: Drawn | None) -> DataFrame:
    """keys and ``fields`` for what ``one`` makes of a row's columns ``names``: a list of values for each field, all as long as the first; none for a row with a null.

    Rows are taken one by one and results leave in batches of a few megabytes, however
    large images are and however many a batch has.  ``drawn`` turns batches of ``rows`` into
    batches with keys and ``names`` on the spot, so that images need not go through the JVM.
    """
    narrow = rows if drawn else rows.select(*keys, *names)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)
    run = lambda batches: in_batches(drawn(batches) if drawn else batches, keys, names, one, fields)
    return narrow.mapInArrow(run, kinds + ", ".join(f"{name} {kind}" for name, kind, _ in fields))


def in_batches(batches: Iterator[pa.RecordBatch], keys: Sequence[str], names: Sequence[str], one: Callable[..., Sequence[Sequence]], fields: Sequence[tuple[str, str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """The work of ``_each`` on batches: about ``BATCH_BYTES`` of results are held at a time."""
    for batch in batches:
        columns, held = [batch.column(name) for name in names], batch.select(list(keys))
        at: list[np.ndarray] = []
        parts: list[list[pa.Array]] = []
        size = 0
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in columns]
            found = [] if any(x is None for x in row) else one(*row)
            if len(found) and len(found[0]):
                parts.append([pa.array(x, kind) for x, (_, _, kind) in zip(found, fields, strict=True)])
                at.append(np.full(len(found[0]), i))
                size += sum(x.nbytes for x in parts[-1])
            if parts and (size > BATCH_BYTES or i + 1 == batch.num_rows):
                mine = held.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*mine.columns, *map(pa.concat_arrays, zip(*parts, strict=True))], [*keys, *(f[0] for f in fields)])
                at, parts, size = [], [], 0


def detect(maps: DataFrame, keys: Sequence[str], drawn: Drawn | None = None) -> DataFrame:
    """keys, n, quad for the text boxes of each map (``scores`` as float32 bytes, map_w, map_h, source_w, source_h; of ``maps``, or as ``drawn`` from their batches).

    Maps that are null or do not fill their size have no boxes.
    """

    def one(scores: bytes, map_w: int, map_h: int, source_w: int, source_h: int) -> list:
        if len(scores) != 4 * map_w * map_h:
            return []
        found = text_boxes(np.frombuffer(scores, "<f4").reshape(map_h, map_w), source_w, source_h)
        return [range(len(found)), found]

    return _each(maps, keys, ["scores", "map_w", "map_h", "source_w", "source_h"], one, [("n", "int", pa.int32()), ("quad", "array<int>", pa.list_(pa.int32()))], drawn)


def align(lines: DataFrame, keys: Sequence[str], drawn: Drawn | None = None) -> DataFrame:
    """keys, n, l, t, r, b for the tokens of each line (``pixels`` as grey bytes, width, height, begins, ends, steps, turned; of ``lines``, or as ``drawn`` from their batches).

    Lines that are null or do not fill their size have no boxes.
    """

    def one(pixels: bytes, width: int, height: int, begins: list, ends: list, steps: int, turned: bool) -> list:
        if len(pixels) != width * height:
            return []
        mask = foreground(np.frombuffer(pixels, np.uint8).reshape(height, width))
        found = token_boxes(mask, list(zip(begins, ends, strict=True)), steps, turned)
        return [range(len(found)), *np.array(found, float).reshape(-1, 4).T]

    sides = [(k, "double", pa.float64()) for k in "ltrb"]
    return _each(lines, keys, ["pixels", "width", "height", "begins", "ends", "steps", "turned"], one, [("n", "int", pa.int32()), *sides], drawn)


def tensor(image: np.ndarray, norm: tuple[Sequence[float], Sequence[float]] = DETECTOR_NORM) -> np.ndarray:
    """Channels of an image (rows, columns, channels; 0 to 255) one behind the other, less their mean and by their spread."""
    mean, spread = (np.array(x[: image.shape[2]], np.float32) for x in norm)
    return np.ascontiguousarray(((image.astype(np.float32) / np.float32(255) - mean) / spread).transpose(2, 0, 1))


def _images(rows: DataFrame, keys: Sequence[str], more: Sequence[str], one: Callable[..., Sequence[Sequence]], fields: Sequence[tuple[str, str, pa.DataType]], drawn: Drawn | None = None) -> DataFrame:
    """``_each`` for images (``pixels`` as bytes, width, height, channels) and ``more``; images that do not fill their size give none."""

    def of_image(pixels: bytes, width: int, height: int, channels: int, *rest: object) -> Sequence[Sequence]:
        if len(pixels) != width * height * channels:
            return []
        return one(np.frombuffer(pixels, np.uint8).reshape(height, width, channels), *rest)

    return _each(rows, keys, ["pixels", "width", "height", "channels", *more], of_image, fields, drawn)


def crops(pages: DataFrame, keys: Sequence[str], drawn: Drawn | None = None) -> DataFrame:
    """keys, n, pixels, width, height, channels: the upright image of each quad of a page (``quads``, eight numbers each), in their order; those without extent go.

    The pages' images stand in ``pages``, or are ``drawn`` from their batches.
    """

    def one(image: np.ndarray, quads: list) -> list:
        cut = [(n, c) for n, c in ((n, crop(image, quad)) for n, quad in enumerate(quads)) if c.size]
        return [[n for n, _ in cut], [np.ascontiguousarray(c).tobytes() for _, c in cut], *([c.shape[k] for _, c in cut] for k in (1, 0, 2))]

    return _images(pages, keys, ["quads"], one, [("n", "int", pa.int32()), ("pixels", "binary", pa.binary()), ("width", "int", pa.int32()), ("height", "int", pa.int32()), ("channels", "int", pa.int32())], drawn)


def tensors(images: DataFrame, keys: Sequence[str], norm: tuple[Sequence[float], Sequence[float]] = DETECTOR_NORM) -> DataFrame:
    """keys and ``tensor``: the float32 bytes of ``tensor`` of each image."""
    return _images(images, keys, [], lambda image: [[tensor(image, norm).tobytes()]], [("tensor", "binary", pa.binary())])
