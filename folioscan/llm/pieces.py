"""SentencePiece encoding and decoding with offsets (operator 8).

A text is first normalised through the model's compiled character map: at each
position the longest prefix that the map knows is replaced, any other byte stays, and
every byte of the normalised text remembers the byte of the source it came from.  A map
without entries is the same path with nothing to replace.  The library gives the ids;
the pieces, laid end to end, cover the normalised text, so each piece is projected
through that alignment to a byte span of the source.

Where a model's vocabulary has no piece that runs from a visible character into a
space (checked when the model is loaded), nothing merges across such a place, so a
text is the concatenation of separately encodable segments and repeated segments
are encoded once.  Any other model is given whole texts.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscan.llm.common import bounded, texts_of

META = "▁"
_META = META.encode()
_SEGMENT = re.compile(" *[^ ]+| +")
#: Distinct segments that a worker remembers; beyond it, it starts afresh.
REMEMBERED = 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes, and the replacements."""

    def __init__(self, blob: bytes = b""):
        self.units: Sequence[int] = ()
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.replacements = blob[4 + size :]

    def _child(self, node: int, byte: int) -> tuple[int, int | None] | None:
        """The node that a byte leads to, and where its replacement begins if a prefix ends there."""
        node ^= byte
        if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != byte:
            return None
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        return node, self.units[node] & 0x7FFFFFFF if unit >> 8 & 1 else None

    @property
    def _root(self) -> int:
        return (self.units[0] >> 10) << ((self.units[0] & 512) >> 6)

    @functools.cached_property
    def _openings(self) -> np.ndarray:
        """Whether two bytes may begin a known prefix: one that ends with the first, or goes on with the second."""
        table = np.zeros((256, 256), bool)
        for one in range(256):
            if (found := self._child(self._root, one)) is not None:
                node, value = found
                table[one] = True if value is not None else [self._child(node, two) is not None for two in range(256)]
        return table.ravel()

    def match(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """What stands for the longest known prefix at a position, and that prefix's length."""
        node, best = self._root, None
        for end in range(at, len(source)):
            if (found := self._child(node, source[end])) is None:
                break
            node, value = found
            if value is not None:
                best = value, end + 1 - at
        return best and (self.replacements[best[0] : self.replacements.index(b"\0", best[0])], best[1])

    def replaced(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with every known prefix replaced, and the source byte of each: its own, or where the prefix begins."""
        data = np.frombuffer(source, np.uint8)
        own = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        if not self.units or not len(data):
            return data, own
        behind = np.append(data[1:], 0).astype(np.int64)
        maybe = np.flatnonzero(((data & 0xC0) != 0x80) & self._openings[data.astype(np.int64) * 256 + behind])
        parts, origins, upto = [], [], 0
        for at in maybe.tolist():
            if at >= upto and (found := self.match(source, at)) is not None:
                piece, n = found
                parts += [data[upto:at], np.frombuffer(piece, np.uint8)]
                origins += [own[upto:at], np.full(len(piece), at, own.dtype)]
                upto = at + n
        return np.concatenate([*parts, data[upto:]]), np.concatenate([*origins, own[upto:]])


class PieceModel:
    def __init__(self, model: str | bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(**{"model_proto" if isinstance(model, bytes) else "model_file": model})
        parts = list(_fields(self.library.serialized_model_proto()))
        pieces = [dict(_fields(v)) for k, v in parts if k == 1]
        self.pieces = [p[1].decode() for p in pieces]
        kinds = np.array([p.get(3, 1) for p in pieces])  # 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte
        norm = dict(_fields(b"".join(v for k, v in parts if k == 3)))
        trainer = dict(_fields(b"".join(v for k, v in parts if k == 2)))
        self.map = CharacterMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        self.suffix = trainer.get(24, 0)
        self.is_byte = kinds == 6
        plain = all(not re.search(f"[^{META}]{META}", p) for p, k in zip(self.pieces, kinds, strict=True) if k in (1, 4))
        self.segments = bool(plain and not norm.get(2) and self.prefix and not self.squeeze and self.escape and not self.suffix and self.is_byte.any() and not (kinds == 4).any())
        #: Bytes of the normalised text that each piece covers; what an unknown one covers differs.
        self.size = np.array([1 if k == 6 else len(p.encode()) for p, k in zip(self.pieces, kinds, strict=True)], np.int64)
        self.unknown = kinds == 2
        self.lone = struct.pack("<i", self.library.piece_to_id(META))
        self.known: dict[str, bytes] = {}

    # -- normalisation -------------------------------------------------------
    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and their end) the source byte."""
        source = text.encode()
        out, origin = self.map.replaced(source)
        begin, end = 0, len(source)
        if self.squeeze:
            blank = out == 32
            if not (seen := np.flatnonzero(~blank)).size:
                return b"", np.zeros(1, np.int64)
            first, last = seen[0], seen[-1] + 1
            begin, end = int(origin[first]), int(origin[last]) if last < len(out) else end
            keep = ~blank
            keep[1:] |= ~blank[:-1]  # the first blank of several
            keep[:first] = keep[last:] = False
            out, origin = out[keep], origin[keep]
        elif not source:
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            at = len(out) if self.suffix else 0
            out, origin = np.insert(out, at, 32), np.insert(origin, at, end if self.suffix else begin)
        if self.escape:
            blank = out == 32
            many = np.where(blank, len(_META), 1)
            out, origin = np.repeat(out, many), np.repeat(origin, many)
            out[np.repeat(blank, many)] = np.tile(np.frombuffer(_META, np.uint8), int(blank.sum()))
        return out.tobytes(), np.append(origin, end)

    # -- encoding ------------------------------------------------------------
    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, exactly as the library gives them."""
        if not self.segments:
            return [np.array(x, np.int32) for x in self.library.encode(list(texts), num_threads=1)]
        cut = [self.cut(t) for t in texts]
        self.learn(cut)
        look = self.known.__getitem__
        return [np.frombuffer(b"".join(map(look, words)), np.int32) for words in cut]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Segments without the space that each of them begins with after normalisation."""
        if not text:
            return []
        text = text.replace(META, " ")
        words = text.split(" ")
        if "" not in words:
            return words
        first, *rest = _SEGMENT.findall(text)
        return [first, *(x[1:] for x in rest)]

    def learn(self, cut: Sequence[Sequence[str]]) -> None:
        need = set().union(*cut)
        new = need.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = need
        fresh = list(new)
        self.known.update(zip(fresh, (np.array(x, np.int32).tobytes() for x in self.library.encode(fresh, num_threads=1)), strict=True))
        if "" in need:  # a single space at the end of a text
            self.known[""] = self.lone

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte spans of the pieces; they are ascending and do not overlap."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        _, origin = self.normalise(text)
        size = self.size[ids]
        if self.unknown[ids].any():
            size = np.array([1 if self.is_byte[i] else len(p.encode()) for i, p in zip(ids, self.library.encode(text, out_type=str), strict=True)])
        at = origin[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)
        return at[:-1], at[1:]


def with_rule(model_file: str, rule: str) -> bytes:
    """A model of the same pieces whose texts go through the library's compiled map of a rule (nfkc, nmt_nfkc, nfkc_cf, nmt_nfkc_cf)."""
    import sentencepiece

    def varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    spec = dict(_fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    blob = dict(_fields(spec))[2]
    entry = b"\x12" + varint(len(blob)) + blob
    # A message that comes again is merged into the first: only the map changes.
    with open(model_file, "rb") as f:
        return f.read() + b"\x1a" + varint(len(entry)) + entry


@functools.lru_cache(2)
def model(source: str | bytes) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(source)


def encode(df: DataFrame, model_file: str | bytes, text: str = "text", keep: Sequence[str] = ("doc_id",), decode: bool = False) -> DataFrame:
    """``keep``, ``ids array<int>``, ``begins`` and ``ends array<int>`` (byte spans in the text), and with ``decode`` the library's ``decoded`` text.

    ``model_file`` is a path that every executor has, or a model's bytes.
    Null and empty texts have no ids and decode to an empty text.  Repeated rows
    give repeated results.  Texts are never cut short: a long one is a batch of
    its own.  A kept column with the name of an output gives way to the output.
    """
    outs = ["ids", "begins", "ends"] + ["decoded"] * decode
    keep = [c for c in keep if c not in outs]
    narrow = df.select(*keep, df[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text")
    schema = ", ".join(x for x in (fields, "ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decode) if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(model_file)
        for batch in bounded(batches):
            texts = texts_of(batch.column(len(keep))).to_pylist()
            ids = coder.ids(texts)
            spans = [coder.spans(t, x) for t, x in zip(texts, ids, strict=True)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate(x) if x else np.zeros(0, np.int32)) for x in (ids, [s[0] for s in spans], [s[1] for s in spans])]
            columns = [*batch.columns[: len(keep)], *lists]
            if decode:
                columns.append(pa.array(coder.library.decode([x.tolist() for x in ids], num_threads=1), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, *outs])

    return narrow.mapInArrow(run, schema)


def decode(df: DataFrame, model_file: str | bytes, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the library's ``decoded`` text of an array of ids; a null array gives a null text."""
    keep = [c for c in keep if c != "decoded"]
    narrow = df.select(*keep, df[ids].alias("__ids"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name != "__ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(model_file)
        for batch in bounded(batches):
            rows = batch.column(len(keep)).to_pylist()
            texts = coder.library.decode([x or [] for x in rows], num_threads=1)
            done = pa.array([None if x is None else t for x, t in zip(rows, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], done], [*keep, "decoded"])

    return narrow.mapInArrow(run, fields + "decoded string")
