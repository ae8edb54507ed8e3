"""Text functions: the exact normaliser of pages and queries, and the column expression for pages that need no more.

A text is folded in two steps.  Each token becomes its form, in which line breaks and
white space are marks; then the stretches of marks and hyphens around line breaks are
settled, and what blanks are left is collapsed.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.model import OCR, TEXT_LAYER, QueryOptions

BREAKS = "\n\r\x85\u2028\u2029"
BARRIER = "\0"
WORD_CHAR = r"[\p{L}\p{Nd}_]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks of a form, code points that are no characters: a line break, white space that a joined
#: break takes along, white space that only a form brings forth, and a break inside a token.
BREAK, BLANK, FIRM, CUT = map(chr, range(0xFDD0, 0xFDD4))
#: Blocks in which a character that is its own form is looked for.
BLOCKS = ((0x20, 0x7F), (0xA1, 0x250), (0x400, 0x460), (0x2010, 0x2028), (0x3041, 0x30FF), (0x4E00, 0xA000), (0xAC00, 0xD7A4))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def quoted(keyword: str) -> str:
    """The keyword as a literal within a regular expression."""
    return "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def fold_zero(text: Column, source: Column, options: QueryOptions) -> Column:
    """O, o and 0 are one in recognised text."""
    return F.when(source == OCR, F.translate(text, "oO", "00")).otherwise(text) if options.tolerate_o_zero else text


def is_space(c: str) -> bool:
    """White space as the matcher knows it: no-break spaces are none."""
    return (c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f" or unicodedata.category(c) in ("Zs", "Zl", "Zp")) and c not in "\xa0\u2007\u202f"


#: All white space lies below U+3001.
SPACES = "".join(c for c in map(chr, range(0x3001)) if is_space(c) and c not in BREAKS)


def _own_form(c: str) -> bool:
    return unicodedata.normalize("NFKC", c) == c and len(c.lower()) == 1 and unicodedata.normalize("NFKC", c.lower()) == c.lower() and not is_space(c) and c not in BREAKS and unicodedata.category(c) != "Cc"


@functools.cache
def _plain_class() -> str:
    """A regular expression's class of characters that fold to themselves or their lower case, one by one, with blank, tab and line feed."""
    parts = ["\\t\\n "]
    for first, last in BLOCKS:
        run: list[int] = []
        for code in [*(k for k in range(first, last) if _own_form(chr(k))), -1]:
            if run and code != run[-1] + 1:
                parts.append(f"\\x{{{run[0]:x}}}-\\x{{{run[-1]:x}}}")
                run = []
            run.append(code)
    return "".join(parts)


def needs_fold(text: Column) -> Column:
    """Whether a page's normal form takes more than the expression: other characters, or a hyphen before several breaks."""
    # Runs of ASCII go first: the long class is then tried on the few characters that are left.
    beyond = F.regexp_replace(text, "[\\t\\n -~]+", "")
    hyphened = (F.contains(text, F.lit("-\n")) | F.contains(text, F.lit("- ")) | F.contains(text, F.lit("-\t"))) & F.rlike(text, F.lit("-[ \\t]*\\n[ \\t]*\\n"))
    return F.rlike(beyond, F.lit(f"[^{_plain_class()}]")) | hyphened


def expressed(text: Column, source: Column, options: QueryOptions) -> Column:
    """The normal form of a page that needs no fold."""
    # What a page has none of is looked for first: that costs far less than a pattern.
    holds = lambda *parts: functools.reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))
    out = text
    if options.cross_line:
        hyphen = "(?:-[ \\t]*)?" if options.join_hyphens else ""
        edges = holds(" \n", "\t\n", "-\n", "\n ", "\n\t")
        out = F.when(edges, F.regexp_replace(out, f"[ \\t]*{hyphen}\\n[ \\t]*", "")).otherwise(F.replace(out, F.lit("\n"), F.lit("")))
    else:
        if options.join_hyphens:
            out = F.when(holds("-\n", "- ", "-\t"), F.regexp_replace(out, "[ \\t]*-[ \\t]*\\n[ \\t]*", "")).otherwise(out)
        out = F.regexp_replace(out, "[ \\t]*\\n" if options.join_hyphens else "\\n", BARRIER)
    if options.ignore_whitespace:
        out = F.translate(out, " \t", "")
    elif options.collapse_whitespace:
        out = F.when(holds("  ", "\t"), F.regexp_replace(out, "[ \\t]+", " ")).otherwise(out)
    else:
        out = F.translate(out, "\t", " ")
    return fold_zero(out if options.case_sensitive else F.lower(out), source, options)


def normalize_page(text: Column, source: Column, options: QueryOptions = QueryOptions()) -> Column:
    """A page's text for matching: form by code point, line breaks, hyphens, blanks, case and O/0; null stays null.

    Pages that provably need no more are folded by an expression; only the others' text
    crosses into Python, in Arrow batches, and is folded there exactly.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array, sources: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fold_text(t, s or TEXT_LAYER, options) for t, s in zip(texts.to_pylist(), sources.to_pylist(), strict=True)], pa.string())

    return F.coalesce(run(F.when(needs_fold(text), text), source), expressed(text, source, options))


class _Forms(dict):
    """Forms by token, or by code point for ``str.translate``; made when they are first asked for."""

    def __init__(self, options: QueryOptions, zero: bool):
        self.o = options
        self.inner = str.maketrans({**dict.fromkeys(SPACES, FIRM), **dict.fromkeys(BREAKS, CUT), **(dict.fromkeys("oO", "0") if zero else {})})

    def cased(self, text: str) -> str:
        text = unicodedata.normalize("NFKC", text) if self.o.normalize_unicode else text
        return text if self.o.case_sensitive else text.lower()

    def __missing__(self, token: str | int) -> str:
        text = chr(token) if isinstance(token, int) else token
        if not text.strip(BREAKS):
            form = BREAK if text else ""
        elif not text.strip(SPACES + "".join(filter(is_space, BREAKS))):
            form = BLANK
        else:
            form = self.cased(text).translate(self.inner)
        if len(self) < 200_000:
            self[token] = form
        return form


@functools.lru_cache(16)
def _forms(options: QueryOptions, source: str) -> _Forms:
    return _Forms(options, source == OCR and options.tolerate_o_zero)


_STRETCH = re.compile(f"[{re.escape('-' + BLANK + FIRM + CUT + BREAK + SPACES)}]*[{BREAK}{CUT}][{re.escape('-' + BLANK + FIRM + CUT + BREAK + SPACES)}]*")


def _settled(stretch: str, options: QueryOptions) -> list[tuple[int, str]]:
    """What stays of a stretch of hyphens, blanks and line breaks, and where it stood.

    A break that is joined, by a hyphen or because matches may cross lines, takes along
    that hyphen, the blanks before it and the blank tokens behind it; any other break
    is a barrier.
    """
    left: list[tuple[int, str]] = []
    after_join = False

    def without_blanks() -> None:
        while left and left[-1][1] not in ("-", BARRIER):
            left.pop()

    for i, c in enumerate(stretch):
        if c == BREAK:
            if options.join_hyphens:
                without_blanks()
            hyphen = options.join_hyphens and bool(left) and left[-1][1] == "-"
            if hyphen:
                left.pop()
            if after_join := hyphen or options.cross_line:
                without_blanks()
            else:
                left.append((i, BARRIER))
        elif c == CUT:
            after_join = False
            without_blanks() if options.cross_line else left.append((i, BARRIER))
        elif c == "-" or c == FIRM:
            after_join = False
            left.append((i, c))
        elif not after_join:
            left.append((i, c))
    return left


def _blanks(text: str, options: QueryOptions) -> str:
    if options.ignore_whitespace:
        return re.sub(f"[{BLANK}{FIRM}]+", "", text)
    return re.sub(f"[{BLANK}{FIRM}]{'+' * options.collapse_whitespace}", " ", text)


def _without_marks(text: str, options: QueryOptions) -> str:
    return _blanks(_STRETCH.sub(lambda m: "".join(c for _, c in _settled(m[0], options)), text), options)


def fold_text(text: str, source: str, options: QueryOptions = QueryOptions()) -> str:
    """The exact normal form of a page of which every code point is a token."""
    return _without_marks(text.translate(_forms(options, source)), options)


def normalize_tokens(tokens: Sequence[str], source: str, options: QueryOptions = QueryOptions()) -> tuple[str, list[int]]:
    """The exact page normaliser: each token is folded by itself; text and the token of each character."""
    look = _forms(options, source).__getitem__
    forms = [look(t) for t in tokens]
    whole = "".join(forms)
    chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    owner = np.repeat(np.arange(len(forms)), [len(f) for f in forms])
    keep = np.ones(len(chars), bool)
    for m in _STRETCH.finditer(whole):
        keep[m.start() : m.end()] = False
        for i, c in _settled(m[0], options):
            keep[m.start() + i], chars[m.start() + i] = True, ord(c)
    chars, owner = chars[keep], owner[keep]
    blank = (chars == ord(BLANK)) | (chars == ord(FIRM))
    chars[blank] = 32
    gone = blank.copy() if options.ignore_whitespace else np.zeros(len(chars), bool)
    if options.collapse_whitespace:
        gone[1:] |= blank[1:] & blank[:-1]
    return chars[~gone].tobytes().decode("utf-32-le", "surrogatepass"), owner[~gone].tolist()


def normalize_query(query: str, options: QueryOptions = QueryOptions(), source: str = TEXT_LAYER) -> str:
    """The exact query normaliser: the string as a whole; CR LF is one break.

    Unless blanks are collapsed each keeps its own character.
    """
    forms = _forms(options, source)
    text = forms.cased(query).replace("\r\n", "\n")
    collapsed = options.collapse_whitespace or options.ignore_whitespace
    text = text.translate(str.maketrans({**dict.fromkeys(BREAKS, BREAK), **(dict.fromkeys(SPACES, BLANK) if collapsed else {})}))
    return _without_marks(text.translate({ord(c): "0" for c in "oO"}) if source == OCR and options.tolerate_o_zero else text, options)


def nfkc(column: Column) -> Column:
    """NFKC, which has no built-in; null stays null."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")

    return run(column)


def exact_normalizer(options: QueryOptions):  # noqa: ANN201
    """A pandas UDF (tokens, source) -> struct(text, map) of the exact normaliser."""

    @F.pandas_udf("text string, map array<int>")
    def run(tokens: pd.Series, source: pd.Series) -> pd.DataFrame:
        rows = [normalize_tokens([str(t) for t in ts] if ts is not None else [], s, options) for ts, s in zip(tokens, source, strict=True)]
        return pd.DataFrame({"text": [r[0] for r in rows], "map": [r[1] for r in rows]})

    return run


#: What is not visible, as a character class: all white space and control characters; for a text layer's counts, no more than these.
UNSEEN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES + "\u2028\u2029") + "\\p{Cc}]"
UNSEEN_IN_LAYER = "[\\x00-\\x20\\x7f-\\x9f]"


def visible_count(text: Column, in_layer: bool = False) -> Column:
    """Characters that can be seen; a text layer's extractor takes blanks beyond ASCII for visible."""
    return F.char_length(F.regexp_replace(text, UNSEEN_IN_LAYER if in_layer else UNSEEN, ""))


def dedup_key(text: Column) -> Column:
    """What texts of two sources are compared by: NFKC, without white space, lower case."""
    plain = ~needs_fold(text)
    return F.lower(F.regexp_replace(F.coalesce(nfkc(F.when(~plain, text)), text), "\\s+", ""))


def joins_words(neighbour: Column) -> Column:
    """Whether the character beside a match is a letter, a digit or an underscore; nothing is none."""
    return F.rlike(neighbour, F.lit(WORD_CHAR))
