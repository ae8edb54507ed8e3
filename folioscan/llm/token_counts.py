"""Token counts (operator 9): Arrow functions that return lengths only.

Texts are packed into batches of about equal bytes whatever their lengths: a text
above the pack size is split at safe boundaries, places where the tokenizer cannot
join what stands on either side, and the counts of its parts are added up.  A text
without such a place is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscan.llm import pieces
from folioscan.llm.common import bounded, texts_of

PACK_BYTES = 256 << 10
#: Between two words of ASCII letters or digits, one space: a pre-token starts there in
#: every byte-level pattern, and white space parts words in word-end vocabularies.
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def split_safely(text: str, limit: int, boundary: re.Pattern[str] = _SAFE, drop: int = 0) -> list[str]:
    """Parts of at least ``limit`` characters (the last may be shorter), each but the first starting at a safe boundary without its first ``drop`` characters."""
    if len(text) <= limit:
        return [text]
    parts, at, begin = [], 0, 0
    while (m := boundary.search(text, at + limit)) is not None:
        parts.append(text[begin : m.start()])
        at, begin = m.start(), m.start() + drop
    return [*parts, text[begin:]]


def packs(texts: Sequence[str], cut: Callable[[str], list[str]], limit: int = PACK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Owners and parts, in packs of about ``limit`` bytes."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for part in cut(text):
            owners.append(i)
            parts.append(part)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= limit:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


class PieceCounter:
    """Counts for a SentencePiece model; repeated segments are counted once."""

    def __init__(self, file: str):
        self.model = pieces.model(file)
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        if not self.model.segments:
            return [text]
        # What follows a space is encoded as if that space were the model's own prefix.
        return split_safely(text.replace(pieces.META, " "), PACK_BYTES, re.compile("(?<=[^ ]) (?=[^ ])"), 1)

    def lengths(self, parts: list[str]) -> list[int]:
        if not self.model.segments:
            return [len(x) for x in self.model.library.encode(parts, num_threads=1)]
        cut = [self.model.cut(p) for p in parts]
        need = set().union(*cut)
        new = need.difference(self.known)
        if len(self.known) + len(new) > 2 * pieces.REMEMBERED:
            self.known.clear()
            new = need
        fresh = list(new)
        self.known.update(zip(fresh, map(len, self.model.library.encode(fresh, num_threads=1)), strict=True))
        if "" in need:
            self.known[""] = 1
        look = self.known.__getitem__
        return [sum(map(look, words)) for words in cut]


class JsonCounter:
    """Counts for a vocabulary file of the tokenizers library, special strings as its default."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        # Only where words part at white space is a space a boundary; else texts stay whole.
        probe = "One a b 12 cd"
        whole = self.library.encode(probe, add_special_tokens=False).ids
        apart = [i for p in _SAFE.sub("\n ", probe).split("\n") for i in self.library.encode(p, add_special_tokens=False).ids]
        self.safe = whole == apart

    def cut(self, text: str) -> list[str]:
        return split_safely(text, PACK_BYTES) if self.safe else [text]

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch(parts, add_special_tokens=False)]


class RankCounter:
    """Counts for a file of ranks; strings that look special are ordinary text."""

    def __init__(self, file: str, pattern: str):
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def cut(self, text: str) -> list[str]:
        return split_safely(text, PACK_BYTES)

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(self.library.encode_ordinary(p)) for p in parts]


@functools.lru_cache(4)
def counter(file: str, pattern: str) -> PieceCounter | JsonCounter | RankCounter:
    if file.endswith(".model"):
        return PieceCounter(file)
    return JsonCounter(file) if file.endswith(".json") else RankCounter(file, pattern)


def count_tokens(df: DataFrame, file: str, text: str = "text", keep: Sequence[str] = ("doc_id",), limit: int = 4096, pattern: str = "") -> DataFrame:
    """``keep``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``file`` is a .model, .json or .tiktoken vocabulary (the last with its split
    ``pattern``).  Null and empty texts count 0 bytes and 0 tokens.  Repeated rows
    give repeated results; a kept column named like an output gives way to it.
    """
    outs = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in keep if c not in outs]
    narrow = df.select(*keep, df[text].alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file, pattern)
        for batch in bounded(batches):
            column = texts_of(batch.column(len(keep)))
            total = np.zeros(len(column), np.int64)
            for owners, parts in packs(column.to_pylist(), count.cut):
                np.add.at(total, owners, count.lengths(parts))
            n_bytes = pa.compute.binary_length(column).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n_bytes, pa.array(total), pa.array(total > limit)], [*keep, *outs])

    return narrow.mapInArrow(run, fields + "n_bytes long, n_tokens long, over_limit boolean")
