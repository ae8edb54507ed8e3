"""Page indexes of recognised pages from columns of Arrow: some pages at a time, whose tokens are never rows of a table."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioscan.functions.text import SPACES
from folioscan.model import OCR
from folioscan.operators import layout

#: Bytes of text that are indexed at a time; a page that has more is one by itself.
PART_BYTES = 1 << 16
#: Code points of ``layout.LATIN`` and ``layout.CJK`` as Java's expressions know them; a test compares all.
LATIN_RANGES = (
    "30-39 41-5a 61-7a aa ba c0-d6 d8-f6 f8-2b8 2e0-2e4 660-669 6f0-6f9 7c0-7c9 966-96f 9e6-9ef a66-a6f ae6-aef b66-b6f be6-bef c66-c6f ce6-cef d66-d6f "
    "de6-def e50-e59 ed0-ed9 f20-f29 1040-1049 1090-1099 17e0-17e9 1810-1819 1946-194f 19d0-19d9 1a80-1a89 1a90-1a99 1b50-1b59 1bb0-1bb9 1c40-1c49 "
    "1c50-1c59 1d00-1d25 1d2c-1d5c 1d62-1d65 1d6b-1d77 1d79-1dbe 1e00-1eff 2071 207f 2090-209c 212a-212b 2132 214e 2160-2188 2c60-2c7f a620-a629 a722-a787 "
    "a78b-a7bf a7c2-a7ca a7f5-a7ff a8d0-a8d9 a900-a909 a9d0-a9d9 a9f0-a9f9 aa50-aa59 ab30-ab5a ab5c-ab64 ab66-ab69 abf0-abf9 fb00-fb06 ff10-ff19 ff21-ff3a "
    "ff41-ff5a 104a0-104a9 10d30-10d39 11066-1106f 110f0-110f9 11136-1113f 111d0-111d9 112f0-112f9 11450-11459 114d0-114d9 11650-11659 116c0-116c9 "
    "11730-11739 118e0-118e9 11950-11959 11c50-11c59 11d50-11d59 11da0-11da9 16a60-16a69 16b50-16b59 1d7ce-1d7ff 1e140-1e149 1e2f0-1e2f9 1e950-1e959 "
    "1fbf0-1fbf9"
)
CJK_RANGES = (
    "1100-11ff 2e80-2e99 2e9b-2ef3 2f00-2fd5 3005 3007 3021-3029 302e-302f 3038-303b 3041-3096 309d-309f 30a1-30fa 30fd-30ff 3131-318e 31f0-321e 3260-327e "
    "32d0-32fe 3300-3357 3400-4dbf 4e00-9ffc a960-a97c ac00-d7a3 d7b0-d7c6 d7cb-d7fb f900-fa6d fa70-fad9 ff66-ff6f ff71-ff9d ffa0-ffbe ffc2-ffc7 ffca-ffcf "
    "ffd2-ffd7 ffda-ffdc 16ff0-16ff1 1b000-1b11e 1b150-1b152 1b164-1b167 1f200 20000-2a6dd 2a700-2b734 2b740-2b81d 2b820-2cea1 2ceb0-2ebe0 2f800-2fa1d "
    "30000-3134a"
)
#: What is known of a character.
IS_LATIN, IS_CJK, NO_SPACE_AFTER, NO_SPACE_BEFORE, BLANK, UNSEEN, ENDS_LINE = (1 << k for k in range(7))
NOT_VISIBLE = "".join(map(chr, [*range(0x20), *range(0x7F, 0xA0)])) + "".join(SPACES) + "\u2028\u2029"
BLANKS = " \t\n\x0b\f\r"
LINE_ENDS = "\x85\u2028\u2029"
_TOKEN = pa.struct([("text", pa.string()), ("start", pa.int64()), ("line", pa.int32()), *((k, pa.float64()) for k in ("conf", *"lbrt"))])


@functools.cache
def kinds() -> np.ndarray:
    """The flags of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for bit, ranges in ((IS_LATIN, LATIN_RANGES), (IS_CJK, CJK_RANGES)):
        for span in ranges.split():
            low, _, high = span.partition("-")
            out[int(low, 16) : int(high or low, 16) + 1] |= bit
    for bit, chars in ((NO_SPACE_AFTER, layout.OPENING + layout.TIGHT), (NO_SPACE_BEFORE, layout.CLOSING + layout.TIGHT), (BLANK, BLANKS), (UNSEEN, NOT_VISIBLE), (ENDS_LINE, LINE_ENDS)):
        out[list(map(ord, set(chars)))] |= bit
    return out


def _spacing(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """``layout.spacing_factor`` of flags."""
    latin, cjk = ((before & bit > 0, after & bit > 0) for bit in (IS_LATIN, IS_CJK))
    mixed = latin[0] & cjk[1] | cjk[0] & latin[1]
    return np.select([mixed, latin[0] & latin[1], cjk[0] & cjk[1]], [layout.MIXED, layout.WESTERN, layout.EASTERN], layout.OTHER)


def _middle(values: np.ndarray) -> float:
    """``stats.median`` of positive values, which are sorted in their place."""
    values.sort()
    n = len(values)
    return float((values[(n + 1) // 2 - 1] + values[n // 2]) / 2) if n else 0.0


def _floats(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _upto(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


# -- the blocks of a page --------------------------------------------------------
def _split(left: Sequence[float], right: Sequence[float], width: float, ratio: float) -> float | None:
    """``results.with_split`` of a page's boxes."""
    least = max(0.08, min(0.40, ratio)) * width
    at = sorted(((x + y) / 2, x, y) for x, y in zip(left, right, strict=True) if y - x < 0.48 * width and y > x)
    if len(at) < 4:
        return None
    gap, i = max((at[i + 1][0] - at[i][0], -i) for i in range(1, len(at) - 2))
    cut = (at[1 - i][0] + at[-i][0]) / 2
    end, begin = max((y for c, _, y in at if c < cut), default=None), min((x for c, x, _ in at if c >= cut), default=None)
    return cut if gap >= least and end is not None and begin is not None and begin - end >= 0.35 * least else None


def _ranked(ids: list[int], l: list[float], t: list[float], r: list[float], split: float | None) -> list[int]:  # noqa: E741
    """``layout.ranked_blocks`` of a page whose blocks all part bands that reach over the split."""
    by_top = sorted(ids, key=lambda i: (t[i], l[i]))
    if split is None:
        return by_top
    band, place = 0, {}
    for i in by_top:
        spanning = l[i] < split < r[i]
        place[i] = (band, spanning, not spanning and (l[i] + r[i]) / 2 >= split)
        band += spanning
    return sorted(by_top, key=place.__getitem__)


def _separator(p: tuple, x: tuple, page_w: float, glyph: tuple) -> str:
    """``layout.separators`` between two neighbours (text, l, t, r, b); ``glyph`` has a function for the width of either."""
    (text0, l0, t0, r0, b0), (text1, l1, t1, r1, b1) = p, x
    h0, h1 = max(0.0, b0 - t0), max(0.0, b1 - t1)
    low, high = min(h0, h1), max(h0, h1)
    level = max(0.0, min(b0, b1) - max(t0, t1)) >= 0.45 * low or abs((t0 + b0) / 2 - (t1 + b1) / 2) <= 0.35 * low
    gap = l1 - r0
    widest = min(max(3.5 * high, 0.03 * page_w), max(1.5 * high, 0.12 * page_w))
    if low <= 0 or not level or r1 < l0 - 0.2 * low or gap > widest:
        return "\n"
    ended = text0[:-1] if text0[-1] in LINE_ENDS else text0
    if gap <= 0 or text0[-1] in BLANKS or ended[-1:] in set(BLANKS) or text1[0] in BLANKS:
        return ""
    before, after = text0.rstrip(NOT_VISIBLE)[-1:], text1.lstrip(NOT_VISIBLE)[:1]
    if not before or not after:
        return ""
    flags = kinds()[[ord(before), ord(after)]]
    if flags[0] & NO_SPACE_AFTER or flags[1] & NO_SPACE_BEFORE:
        return ""
    widths = [w for w in (g() for g in glyph) if w > 0]
    about = sum(widths) / len(widths) if widths else 0.55 * low
    return " " if gap >= max(1.5, about * float(_spacing(flags[:1], flags[1:])[0]), 0.1 * low) else ""


# -- the tokens of all blocks ----------------------------------------------------
def _lost_spaces(flags: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
    """``layout.with_lost_spaces``: whether a lost space stood before each token, from the flags of all characters and the tokens' places among them."""
    found = np.zeros(len(owner), bool)
    blanks = _upto(flags & BLANK > 0)
    n_blank = blanks[end] - blanks[begin]
    solid = end - begin - n_blank
    blank = (solid == 0) | (solid == 1) & (flags[end - 1] & ENDS_LINE > 0)
    at = np.flatnonzero(~blank & (r > l))
    if not len(at):
        return found
    so_far, of, l, r = np.cumsum(n_blank > 0)[at], owner[at], l[at], r[at]
    opens = np.concatenate([[True], of[1:] != of[:-1]])
    first = np.flatnonzero(opens)
    cut = [*first.tolist(), len(at)]
    run = np.cumsum(opens) - 1
    centre = (l + r) / 2
    onward = (centre[np.array(cut[1:]) - 1] + 0.0001 >= centre[first])[run]
    gaps = np.zeros(len(at))
    gaps[1:] = np.where(onward[1:], l[1:] - r[:-1], l[:-1] - r[1:])
    gaps[1:][so_far[1:] != so_far[:-1]] = 0
    gaps[first] = 0
    wide = gaps[gaps > 0]
    wide_cut = _upto(gaps > 0)[cut].tolist()
    widths, base, width = r - l, np.zeros(len(first)), np.zeros(len(first))
    for k in range(len(first)):
        width[k] = _middle(widths[cut[k] : cut[k + 1]])
        if (n := wide_cut[k + 1] - wide_cut[k]) >= 3:
            own = wide[wide_cut[k] : wide_cut[k + 1]]
            own.sort()
            base[k] = own[((n - 1) * 35 + 50) // 100]
    # The first and the last character of a token that can be seen.
    places = np.arange(len(flags))
    shown = flags & UNSEEN == 0
    onto = np.minimum.accumulate(np.where(shown, places, len(flags))[::-1])[::-1][begin[at]]
    back = np.maximum.accumulate(np.where(shown, places, -1))[end[at] - 1]
    before, after = np.roll(back, 1), onto
    none = (np.roll(back < begin[at], 1)) | (after >= end[at])
    kind0, kind1 = flags[before], flags[np.minimum(after, len(flags) - 1)]
    tight = none | (kind0 & NO_SPACE_AFTER > 0) | (kind1 & NO_SPACE_BEFORE > 0)
    least = np.maximum(np.maximum(0.004, width[run] * _spacing(kind0, kind1)), 2.6 * base[run])
    found[at] = (gaps > 0) & (gaps >= least) & ~tight
    return found


def _through_quad(quad: np.ndarray, owner: np.ndarray, l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray) -> list[np.ndarray]:  # noqa: E741
    """Left, top, right and bottom of boxes of the line, each through the quad of its owner (a row of eight numbers)."""

    def axis(k: int) -> list[np.ndarray]:
        begin, across, under, along = quad[:, k], quad[:, 2 + k] - quad[:, k], quad[:, 6 + k], quad[:, 4 + k] - quad[:, 6 + k]
        begin, across, under, along = (x[owner] for x in (begin, across, under, along))
        ends = []
        for x in (l, r):
            upper = begin + across * x
            ends.append((upper, under + along * x - upper))
        return [ends[x][0] + ends[x][1] * y for x, y in ((0, t), (1, t), (1, b), (0, b))]

    xs, ys = axis(0), axis(1)
    return [functools.reduce(f, side) for f in (np.fmin, np.fmax) for side in (xs, ys)]


def _indexed(batch: pa.RecordBatch, detect_columns: bool, column_gap: float) -> pa.RecordBatch:
    blocks = batch["blocks"]
    many = blocks.value_lengths().fill_null(0).to_numpy()
    flat = blocks.flatten()
    column = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    bitmap_w, bitmap_h, page_w, page_h = (_floats(batch[k]) for k in ("bitmap_w", "bitmap_h", "page_w", "page_h"))

    # The order of the blocks, from their boxes.
    placed = np.logical_and.reduce([column[k].is_valid().to_numpy(zero_copy_only=False) for k in "ltrb"])
    sides = [_floats(column[k]).tolist() for k in "ltrb"]
    told = column["text"].cast(pa.string()).to_pylist()
    cut, order, of_page = _upto(many).tolist(), [], []
    for p, width in enumerate(bitmap_w.tolist()):
        ids = [i for i in range(cut[p], cut[p + 1]) if placed[i]]
        split = _split([sides[0][i] for i in ids], [sides[2][i] for i in ids], width, column_gap) if detect_columns else None
        kept = [i for i in _ranked(ids, sides[0], sides[1], sides[2], split) if told[i]]
        order += kept
        of_page += [p] * len(kept)
    page = np.array(of_page, np.int64)
    texts = [told[i] for i in order]
    if order != list(range(len(flat))):
        column = {k: v.take(pa.array(order, pa.int64())) for k, v in column.items()}
    L, T, R, B = (_floats(column[k]) for k in "ltrb")
    score = column["score"].cast(pa.float64())

    # Their tokens, as places among the code points of all texts: the recogniser's, or characters of the same width.
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    flags = kinds()[code]
    n = np.array([len(x) for x in texts], np.int64)
    base = _upto(n)
    sizes = [column[k].value_lengths().fill_null(-1).to_numpy() for k in ("token_boxes", "begins", "ends")]
    same = (sizes[0] == sizes[1]) & (sizes[1] == sizes[2]) & (sizes[0] > 0)
    mask = pa.array(same)
    own = np.repeat(np.flatnonzero(same), sizes[0][same])
    begins, ends = (column[k].filter(mask).flatten().cast(pa.int64()) for k in ("begins", "ends"))
    begin = np.clip(begins.fill_null(0).to_numpy(), 0, n[own])
    end = np.clip(ends.fill_null(-1).to_numpy(), begin, n[own])
    boxes = column["token_boxes"].filter(mask).flatten()
    ratio = dict(zip([f.name for f in boxes.type], boxes.flatten(), strict=True))
    ratios = [_floats(ratio[k].fill_null(0)) for k in "ltrb"]
    whole = end > begin
    own, begin, end = own[whole], begin[whole] + base[own[whole]], end[whole] + base[own[whole]]
    l, t, r, b = (np.where(np.isnan(x), 1.0, np.clip(x, 0.0, 1.0))[whole] for x in ratios)
    spaced = _lost_spaces(flags, own, begin, end, l, r)
    no_area = ~((r > l) & (b > t))
    bitmap = [lo[own] + (hi - lo)[own] * x for lo, hi, x in ((L, R, l), (T, B, t), (L, R, r), (T, B, b))]
    skew = column["quad"].value_lengths().fill_null(-1).to_numpy() == 8
    if len(turned := np.flatnonzero(skew[own])):
        quads = _floats(column["quad"].filter(pa.array(skew)).flatten()).reshape(-1, 8)
        through = _through_quad(quads, (np.cumsum(skew) - 1)[own[turned]], l[turned], t[turned], r[turned], b[turned])
        for side, x in zip(bitmap, through, strict=True):
            side[turned] = x
    seen = _upto(flags & UNSEEN == 0)
    first, clear = np.searchsorted(own, np.arange(len(texts) + 1)), (seen[end] > seen[begin]) & ~no_area

    def glyph(k: int) -> float:
        width = float(R[k] - L[k])
        at = slice(first[k], first[k + 1])
        middle, visible = _middle((r[at] - l[at])[clear[at]]), int(seen[base[k + 1]] - seen[base[k]])
        return 0.0 if width <= 0 else middle * width if middle > 0 else width / visible if visible else 0.0

    if not same.all():
        even = np.repeat(np.flatnonzero(~same), n[~same])
        at = np.arange(len(even)) - np.repeat(_upto(n[~same])[:-1], n[~same])
        step = ((R - L) / n)[even]
        more = [L[even] + at * step, T[even], L[even] + (at + 1) * step, B[even]]
        owner = np.concatenate([own, even])
        by_block = np.argsort(owner, kind="stable")
        join = lambda x, y: np.concatenate([x, y])[by_block]
        no = np.zeros(len(even), bool)
        bitmap = [join(x, y) for x, y in zip(bitmap, more, strict=True)]
        begin, end = join(begin, base[even] + at), join(end, base[even] + at + 1)
        # Of these every character counts as boxed.
        spaced, no_area, counts = join(spaced, no), join(no_area, no), join(np.zeros(len(own), bool), ~no)
        owner = owner[by_block]
    else:
        owner, counts = own, np.zeros(len(own), bool)

    # Between them: what parts two blocks, and the spaces that come back.
    rows = list(zip(texts, L.tolist(), T.tolist(), R.tolist(), B.tolist(), strict=True))
    parted = [""] * len(rows)
    for k in range(1, len(rows)):
        if of_page[k] == of_page[k - 1]:
            parted[k] = _separator(rows[k - 1], rows[k], float(bitmap_w[of_page[k]]), (functools.partial(glyph, k - 1), functools.partial(glyph, k)))
    has = np.array([bool(x) for x in parted], bool)
    breaks = np.array([x == "\n" for x in parted], bool)
    begun = _upto(has + np.bincount(owner, minlength=len(rows)) + np.bincount(owner[spaced], minlength=len(rows)))
    # A token stands behind all that came before it: other tokens, separators up to its block's, spaces up to its own.
    put = np.arange(len(owner)) + np.cumsum(has)[owner] + np.cumsum(spaced)
    between = begun[:-1][has]
    total = int(begun[-1])
    block_of = np.repeat(np.arange(len(rows)), np.diff(begun))
    length = np.ones(total, np.int64)
    length[put] = end - begin
    start = _upto(length)
    out = np.full(int(start[-1]), 0x20, "<u4")
    out[start[between[breaks[has]]]] = 0x0A
    sized = end - begin
    out[np.repeat(start[put] - _upto(sized)[:-1], sized) + np.arange(int(sized.sum()))] = code[np.repeat(begin - _upto(sized)[:-1], sized) + np.arange(int(sized.sum()))]
    broken = np.zeros(total, bool)
    broken[between[breaks[has]]] = True
    line = _upto(broken)

    # Boxes in points of the page, y up.
    width, height = (x[page][owner] for x in (page_w, page_h))
    across, up = bitmap_w[page][owner], bitmap_h[page][owner]
    x0, x1 = bitmap[0] / across * width, bitmap[2] / across * width
    y0, y1 = height - bitmap[3] / up * height, height - bitmap[1] / up * height
    box = [np.minimum(x0, x1), np.minimum(y0, y1), np.maximum(x0, x1), np.maximum(y0, y1)]
    no_box = no_area | ~((box[2] > box[0]) & (box[3] > box[1]))
    unboxed = np.ones(total, bool)
    unboxed[put] = no_box

    def spread(x: np.ndarray) -> pa.Array:
        values = np.zeros(total)
        values[put] = x
        return pa.array(values, pa.float64(), mask=unboxed)

    of = page[block_of]
    per_page = lambda x, by, **more: np.bincount(by, x, batch.num_rows, **more).astype(np.int64)
    parts = _upto(np.bincount(of, minlength=batch.num_rows))
    data = pa.py_buffer(out.tobytes().decode("utf-32-le").encode())
    octets = _upto(1 + (out >= 0x80) + (out >= 0x800) + (out >= 0x10000))
    text = lambda cut: pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(octets[start[cut]].astype(np.int32).tobytes()), data)
    opening = parts[:-1]
    fields = [text(np.arange(total + 1)), pa.array(start[:-1] - start[opening][of]), pa.array((line[:-1] - line[opening][of]).astype(np.int32)), score.take(pa.array(block_of)), *map(spread, box)]
    tokens = pa.ListArray.from_arrays(pa.array(parts.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_TOKEN)))
    visible = seen[end] - seen[begin]
    sure = score.is_valid().to_numpy(zero_copy_only=False)
    scores = np.bincount(page[sure], score.drop_null().to_numpy(), batch.num_rows)
    scored = np.bincount(page[sure], minlength=batch.num_rows)
    conf = np.where(scored > 0, scores / np.maximum(scored, 1), -1.0)
    rows_n = batch.num_rows
    return pa.RecordBatch.from_pydict({
        "doc_id": batch["doc_id"], "page": batch["page"], "source": pa.array([OCR] * rows_n, pa.string()), "text": text(parts), "tokens": tokens, "page_w": batch["page_w"], "page_h": batch["page_h"],
        "status": pa.array(np.zeros(rows_n, np.int32)), "raw_chars": pa.array(np.diff(start[parts])),
        "visible_chars": pa.array(per_page(visible, page[owner])), "valid_boxes": pa.array(per_page(visible * (counts | ~no_box), page[owner])), "conf": pa.array(conf),
    })


def indexed(batches: Iterator[pa.RecordBatch], detect_columns: bool = True, column_gap: float = 0.16) -> Iterator[pa.RecordBatch]:
    """``assembly.index_of_blocks`` of batches of its columns, whose pages have an extent; some pages at a time, in their order."""
    for batch in batches:
        blocks = batch["blocks"]
        lengths = pc.fill_null(pc.binary_length(pc.struct_field(blocks.flatten(), "text")), 0).to_numpy()
        upto = _upto(lengths)[_upto(blocks.value_lengths().fill_null(0).to_numpy())]
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PART_BYTES, "right")) - 1)
            yield _indexed(batch.slice(at, stop - at), detect_columns, column_gap)
            at = stop


def last_boxed(tokens: pa.ListArray) -> tuple[pa.Array, ...]:
    """How many tokens each page has, and the left, the top and the line of the last one with a box, or nulls."""
    many = tokens.value_lengths().fill_null(0).to_numpy()
    flat = tokens.flatten()
    column = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    cut, boxed = _upto(many), np.flatnonzero(column["l"].is_valid().to_numpy(zero_copy_only=False))
    at = np.concatenate([[-1], boxed])[np.searchsorted(boxed, cut[1:])]
    where = pa.array(at, pa.int64(), mask=at < cut[:-1])
    return pa.array(many, pa.int64()), column["l"].take(where), column["t"].take(where), column["line"].take(where).cast(pa.int64())
