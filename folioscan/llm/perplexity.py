"""Quality rules (operator 10): base counts, and an n-gram perplexity band for each language.

The model is a modified Kneser-Ney model of order 4 over 64 symbols: classes of the
characters of Latin script, while a character of another script is spelled, its class
followed by the six bits of each of its further UTF-8 bytes.  Spark counts the n-grams
of all orders, their discounts, probabilities and back-off weights; 64 symbols bound a
language's table at 2**24 entries whatever the corpus holds.  What comes out is written to
the shared folder as arrays that are sorted by the n-grams' hashes, in shards of a
language, and workers load the languages they meet and find n-grams by binary search.
Nothing of the model passes through the driver.

A document is rejected if the base rules fail it, or if its perplexity lies outside
its language's band.  The bands come from the quartiles of all distinct texts of the
language that pass the base rules, taken exactly from a histogram of log-perplexity.
``kept`` has a band of a least width; ``typical`` goes by the language's own spread alone.
"""

from __future__ import annotations

import dataclasses
import functools
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm import vec
from folioscan.llm.common import BATCH_BYTES, bounded, materialise, texts_of, written
from folioscan.llm.vec import U64

ORDER, BITS = 4, 6
CLASSES = 1 << BITS
#: Half widths of a band: so many interquartile ranges beyond the quartiles, this much log-perplexity at least.
SPREAD, LEAST_WIDTH = 3.0, 0.8
#: The histogram's step, which is all that is added to the spread of a ``typical`` band.
STEP = 0.001
HELD_LANGUAGES = 4

_CLASS = np.zeros(256, np.uint8)  # white space and control characters stay 0
_CLASS[33:127] = 57
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(27, 53)
_CLASS[48:58] = 53
_CLASS[[46, 44]] = 54, 55
_CLASS[[34, 39, 96]] = 56
_CLASS[list(b"#*$%&|<>")] = 58
_CLASS[[33, 63]] = 59
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def grams(t: vec.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code of each n-gram of order 4 and the text it ends in; a blank stands before and after each text."""
    data = t.data
    lead = (data & 0xC0) != 0x80
    heads = np.flatnonzero(lead)
    second = data[np.minimum(heads + 1, len(data) - 1)] if len(data) else data
    # From U+0280 on, but for general punctuation, characters are spelled.
    spelled = (data[heads] >= 0xCA) & ~((data[heads] == 0xE2) & ((second & 0xFE) == 0x80))
    symbol = np.where(lead, _CLASS[data], data & 63)
    wide = data[heads] >= 0xC0
    symbol[heads[wide]] = 60 + (np.where(spelled, data[heads], second)[wide] & 3)
    at = np.flatnonzero(lead | np.repeat(spelled, np.diff(np.append(heads, len(data))))) if len(data) else heads
    kinds = symbol[at]
    owner = t.owner(at)
    chars = np.bincount(owner, minlength=t.n)
    full = np.flatnonzero(chars)
    pad = ORDER  # three blanks before a text, one after it
    place = np.arange(len(at)) + pad * (np.cumsum(chars > 0)[owner] - 1) + ORDER - 1
    symbols = np.zeros(len(at) + pad * len(full), np.uint32)
    symbols[place] = kinds
    whose = np.repeat(full, chars[full] + pad)
    codes = np.zeros(len(symbols), np.uint32)
    for k in range(ORDER):
        codes[ORDER - 1 :] |= symbols[ORDER - 1 - k : len(symbols) - k] << np.uint32(BITS * k)
    inside = np.ones(len(symbols), bool)
    begin = np.cumsum(chars[full] + pad) - (chars[full] + pad)
    for k in range(ORDER - 1):
        inside[begin + k] = False
    return codes[inside], whose[inside]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all of ``docs`` (lang, text)."""

    def packed(lang: str, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

    def rows(lang: str, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes.astype(np.int64)), "n": pa.array(n)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in bounded(batches):
            if not batch.num_rows:
                continue
            codes, whose = grams(vec.Texts(texts_of(batch.column(1))))
            langs = np.array(batch.column(0).to_pylist(), object)
            names, number = np.unique(langs.astype(str), return_inverse=True)
            for k, lang in enumerate(names):
                u, n = np.unique(codes[number[whose] == k], return_counts=True)
                held.setdefault(str(lang), []).append((u, n))
                size += len(u)
            if size > 2_000_000:
                held = {lang: [packed(lang, x)] for lang, x in held.items()}
                size = sum(len(x[0][0]) for x in held.values())
                if size > 1_000_000:
                    for lang, x in held.items():
                        yield rows(lang, *x[0])
                    held, size = {}, 0
        for lang, x in held.items():
            yield rows(lang, *packed(lang, x))

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(order: int, codes: np.ndarray) -> np.ndarray:
    return vec.mix(codes.astype(U64) | (U64(order) << U64(32)))


@dataclasses.dataclass
class HashTable:
    """Values by n-gram, in the order of the n-grams' hashes."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, order: int, codes: np.ndarray, values: np.ndarray) -> HashTable:
        keys = _hash(order, codes)
        by = np.argsort(keys)
        return cls(keys[by], values[by].astype(np.float32))

    def find(self, order: int, codes: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(codes), default)
        keys = _hash(order, codes)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


@dataclasses.dataclass
class KneserNey:
    """Log-probabilities of n-grams and log back-off weights of their contexts, by order."""

    logs: list[HashTable]
    backoffs: list[HashTable]

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From the counts of one language's highest order, in one process: what ``probabilities`` does for a corpus."""
        levels = [(codes, counts.astype(float))]
        for order in range(ORDER - 1, 0, -1):
            shorter = levels[0][0] & ((1 << BITS * order) - 1)
            u, n = np.unique(shorter, return_counts=True)
            levels.insert(0, (u, n.astype(float)))
        logs, backoffs = [], []
        lower = HashTable(np.zeros(0, U64), np.zeros(0, np.float32))
        for order, (u, n) in enumerate(levels, 1):
            discount = _discounts(n)
            context, where = np.unique(u >> BITS, return_inverse=True)
            total = np.bincount(where, n, len(context))
            taken = discount[np.minimum(n, 3).astype(int)]
            weight = np.bincount(where, taken, len(context)) / total
            below = np.full(len(u), 1 / CLASSES) if order == 1 else np.exp(lower.find(order - 1, u & ((1 << BITS * (order - 1)) - 1), -20.0))
            p = (n - taken) / total[where] + weight[where] * below
            lower = HashTable.of(order, u, np.log(p))
            logs.append(lower)
            backoffs.append(HashTable.of(order - 1, context, np.log(np.maximum(weight, 1e-9))))
        return cls(logs, backoffs)

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Of n-grams of the highest order; unseen ones back off."""
        out, back = np.zeros(len(codes)), np.zeros(len(codes))
        left = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            part = codes[left] & ((1 << BITS * order) - 1)
            found = self.logs[order - 1].find(order, part, np.nan)
            done = ~np.isnan(found)
            out[left[done]] = back[left[done]] + found[done]
            left, part = left[~done], part[~done]
            if not len(left):
                return out
            back[left] += self.backoffs[order - 1].find(order - 1, part >> BITS, 0.0)
        out[left] = back[left] - np.log(CLASSES)
        return out


def _discounts(n: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes from counts of 1, 2, and 3 or more."""
    ones, twos, threes, fours = (float((n == k).sum()) for k in (1, 2, 3, 4))
    y = ones / (ones + 2 * twos) if ones else 0.0
    by = [0.0, *(k - (k + 1) * y * b / a if a and b else 0.5 for k, a, b in ((1, ones, twos), (2, twos, threes), (3, threes, fours)))]
    return np.clip(by, [0, 0.1, 0.1, 0.1], [0, 0.95, 1.9, 2.9])


#: Shards of a language's arrays, by the upper bits of the hash.
SHARD_BITS = 6


def levels(counts: DataFrame) -> DataFrame:
    """(lang, order, gram, n) of all orders: lower ones count the distinct n-grams that end in theirs."""
    level = counts.select("lang", F.lit(ORDER).alias("order"), "gram", "n")
    out = level
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1))
        level = level.groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n")).select("lang", F.lit(order).alias("order"), "gram", "n")
        out = out.unionByName(level)
    return out


def probabilities(counted: DataFrame) -> DataFrame:
    """(lang, backoff, order, gram, value): log-probabilities of n-grams, and of contexts the log of what is left for shorter ones."""
    seen = {k: F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4)}
    spread = counted.groupBy("lang", "order").agg(*(v.alias(f"c{k}") for k, v in seen.items()))
    y = F.when(F.col("c1") > 0, F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(0.0)
    cut = lambda k, most: F.least(F.lit(most), F.greatest(F.lit(0.1), F.when((F.col(f"c{k}") > 0) & (F.col(f"c{k + 1}") > 0), k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}")).otherwise(0.5)))
    discounts = spread.select("lang", "order", cut(1, 0.95).alias("d1"), cut(2, 1.9).alias("d2"), cut(3, 2.9).alias("d3"))
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # A language's order has four values for millions of n-grams: these meet them in many places.
    discounts = discounts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))))
    salted = counted.withColumn("salt", F.col("gram").bitwiseAND(F.lit(CLASSES - 1)).cast("int"))
    rated = salted.join(discounts, ["lang", "order", "salt"]).select("lang", "order", "gram", F.shiftright("gram", BITS).alias("context"), "n", taken.alias("taken"))
    totals = rated.groupBy("lang", "order", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("freed"))
    totals = totals.select("lang", "order", "context", "total", (F.col("freed") / F.col("total")).alias("weight"))
    rated = rated.join(totals, ["lang", "order", "context"]).select("lang", "order", "gram", "weight", ((F.col("n") - F.col("taken")) / F.col("total")).alias("own"))
    rated = materialise(rated, "grams-rated")
    lower = None
    parts = []
    for order in range(1, ORDER + 1):
        mine = rated.where(F.col("order") == order).withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)))
        if lower is None:
            mine = mine.withColumn("below", F.lit(1 / CLASSES))
        else:
            mine = mine.join(lower, ["lang", "suffix"])
        done = mine.select("lang", "gram", (F.col("own") + F.col("weight") * F.col("below")).alias("p"))
        if order == ORDER - 1:  # the shorter ones are small enough to be had twice
            done = materialise(done, "gram-p")
        lower = done.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        parts.append(done.select("lang", F.lit(False).alias("backoff"), F.lit(order).alias("order"), "gram", F.log("p").alias("value")))
    parts.append(totals.select("lang", F.lit(True).alias("backoff"), (F.col("order") - 1).alias("order"), F.col("context").alias("gram"), F.log(F.greatest("weight", F.lit(1e-9))).alias("value")))
    return functools.reduce(DataFrame.unionByName, parts)


def train(docs: DataFrame) -> str:
    """Writes a model for each language of ``docs`` (lang, text) and returns its folder.

    Rows are (lang, backoff, order, shard, keys, values): hashes in ascending order, a
    shard having those of its upper bits, and float values.  Repeated rows count as often
    as they stand there; null and empty texts add nothing, an empty table gives no rows.
    """
    values = probabilities(materialise(levels(materialise(count_grams(docs), "grams")), "grams-of-all-orders"))
    hashed = pa.schema([("lang", pa.string()), ("backoff", pa.bool_()), ("order", pa.int32()), ("shard", pa.int32()), ("hash", pa.int64()), ("value", pa.float32())])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, code = batch.column("order").to_numpy(), batch.column("gram").to_numpy()
            h = vec.mix(code.astype(U64) | (order.astype(U64) << U64(32)))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("backoff"), batch.column("order").cast(pa.int32()), pa.array((h >> U64(64 - SHARD_BITS)).astype(np.int32)), pa.array(h.view(np.int64)), batch.column("value").cast(pa.float32())], schema=hashed)

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        h = rows["hash"].to_numpy().view(U64)
        by = np.argsort(h)
        lang, backoff, order, shard = (k.as_py() for k in key)
        row = {"lang": lang, "backoff": backoff, "order": order, "shard": shard, "keys": h[by].tobytes(), "values": rows["value"].to_numpy()[by].astype("<f4").tobytes()}
        return pa.Table.from_pylist([row], pa.schema([*[hashed.field(i) for i in range(4)], ("keys", pa.binary()), ("values", pa.binary())]))

    kinds = "lang string, backoff boolean, order int, shard int, "
    arrays = values.mapInArrow(hashes, kinds + "hash long, value float").groupBy("lang", "backoff", "order", "shard").applyInArrow(packed, kinds + "keys binary, values binary")
    return written(arrays.repartition("lang").sortWithinPartitions("lang", "backoff", "order", "shard"), "perplexity-model")


def load_model(folder: str, lang: str) -> KneserNey:
    """A language's model from the folder that ``train`` returned; one without n-grams if it is not there."""
    from pyarrow import dataset, fs

    store, path = fs.FileSystem.from_uri(folder)
    rows = dataset.dataset(path, filesystem=store, format="parquet").to_table(filter=dataset.field("lang") == lang).sort_by("shard")
    tables: dict[tuple[bool, int], list[tuple[bytes, bytes]]] = {}
    for backoff, order, keys, values in zip(*(rows[c].to_pylist() for c in ("backoff", "order", "keys", "values")), strict=True):
        tables.setdefault((backoff, order), []).append((keys, values))

    def table(backoff: bool, order: int) -> HashTable:
        parts = tables.get((backoff, order), [])
        return HashTable(np.frombuffer(b"".join(k for k, _ in parts), U64), np.frombuffer(b"".join(v for _, v in parts), "<f4"))

    return KneserNey([table(False, order) for order in range(1, ORDER + 1)], [table(True, order) for order in range(ORDER)])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(t: vec.Texts) -> dict[str, np.ndarray]:
    """The base rules' counts of each text; words are runs of anything but ``[\\x20\\x09-\\x0D]``."""
    data, n = t.data, t.n
    visible = vec.NON_SPACE[data]
    starts, ends = t.edges(visible)
    owner = t.owner(starts)
    words = np.bincount(owner, minlength=n)
    out = {"n_words": words, "word_chars": t.per_text(visible & ((data & 0xC0) != 0x80)), "n_symbols": t.per_text(_SYMBOL[data])}
    line_starts, line_ends = t.edges(data != 10)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(visible, out=seen[1:])
    wordy = seen[line_ends] > seen[line_starts]
    line_starts, line_ends = line_starts[wordy], line_ends[wordy]
    line_owner = t.owner(line_starts)
    with np.errstate(over="ignore"):
        lines = vec.mix(t.hashes(line_starts, line_ends) + line_owner.astype(U64) * U64(0x9E3779B97F4A7C15))
        _, first = np.unique(lines, return_index=True)
        out["n_dup_lines"] = np.bincount(line_owner, minlength=n) - np.bincount(line_owner[first], minlength=n)
        hashes = t.hashes(starts, ends)
        repeated = np.zeros(len(starts) + 1, np.int64)
        if len(starts) > 2:
            whole = np.flatnonzero(owner[:-2] == owner[2:])
            key = vec.mix((hashes[whole] * U64(0xD1B54A32D192ED03) + hashes[whole + 1]) * U64(0xD1B54A32D192ED03) + hashes[whole + 2])
            key = vec.mix(key + owner[whole].astype(U64) * U64(0x9E3779B97F4A7C15))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = whole[twice]
            repeated += np.bincount(at, minlength=len(repeated))
            repeated -= np.bincount(at + 3, minlength=len(repeated))[: len(repeated)]
        out["n_repeat_words"] = np.bincount(owner[np.cumsum(repeated)[:-1] > 0], minlength=n) if len(starts) else np.zeros(n, np.int64)
    return out


class Answers:
    """What a model's sorted arrays have answered so far, in pages by an n-gram's first two characters."""

    PAGE = 1 << 2 * BITS

    def __init__(self, model: KneserNey):
        self.model = model
        self.page = np.full(1 << BITS * (ORDER - 2), -1, np.int32)
        self.values = np.full((64, self.PAGE), np.nan, np.float32)
        self.used = 0

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        upper, lower = codes >> np.uint32(2 * BITS), codes & np.uint32(self.PAGE - 1)
        absent = np.flatnonzero((np.bincount(upper, minlength=len(self.page)) > 0) & (self.page < 0))
        if self.used + len(absent) > len(self.values):
            more = np.full((max(len(absent), len(self.values) // 2), self.PAGE), np.nan, np.float32)
            self.values = np.concatenate([self.values, more])
        self.page[absent] = np.arange(self.used, self.used + len(absent))
        self.used += len(absent)
        row = self.page[upper]
        got = self.values[row, lower]
        if (new := np.isnan(got)).any():
            u, first = np.unique(codes[new], return_index=True)
            self.values[row[new][first], lower[new][first]] = self.model.log_p(u)
            got = self.values[row, lower]
        return got


def measure(docs: DataFrame, folder: str, keep: Sequence[str]) -> DataFrame:
    """keep, lang, the base counts and ``log_ppl`` by the models of a folder (null for a text without characters); it must be one that all executors reach."""
    narrow = docs.select(*keep, "lang", "text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name not in ("lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: OrderedDict[str, Answers] = OrderedDict()
        for batch in bounded(batches, BATCH_BYTES // 2):
            if not batch.num_rows:
                continue
            t = vec.Texts(texts_of(batch.column(len(keep) + 1)))
            codes, whose = grams(t)
            langs = [str(x) for x in batch.column(len(keep)).to_pylist()]
            names, number = np.unique(np.array(langs), return_inverse=True)
            logs = np.zeros(len(codes))
            for k, lang in enumerate(names):
                mine = np.flatnonzero(number[whose] == k)
                if str(lang) not in tables:
                    if len(tables) >= HELD_LANGUAGES:
                        tables.popitem(last=False)
                    tables[str(lang)] = Answers(load_model(folder, str(lang)))
                tables.move_to_end(str(lang))
                logs[mine] = tables[str(lang)].log_p(codes[mine])
            size = np.bincount(whose, minlength=t.n)
            total = np.bincount(whose, logs, t.n)
            log_ppl = np.where(size > 0, -total / np.maximum(size, 1), np.nan)
            base = base_counts(t)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep) + 1], *(pa.array(base[b].astype(np.int64)) for b in BASE), pa.array(log_ppl, mask=size == 0)], [*keep, "lang", *BASE, "log_ppl"]
            )

    schema = fields + "lang string, " + "".join(f"{b} long, " for b in BASE) + "log_ppl double"
    return narrow.mapInArrow(run, schema)


def bands(measured: DataFrame, spread: float = SPREAD, least: float = LEAST_WIDTH) -> DataFrame:
    """(band_lang, low, high, typical_low, typical_high): log-perplexity bounds of each language, the latter without a least width.

    A histogram in steps of 0.001 has a bounded number of rows a language, so the
    quartiles are exact at that step and need no sort of the documents.  Copies of a
    text are counted once, by its ``digest``.
    """
    good = measured.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).groupBy("lang", "digest").agg(F.min("log_ppl").alias("l"))
    steps = good.groupBy("lang", F.round("l", 3).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("lang").orderBy("step")
    steps = steps.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    q = steps.groupBy("lang").agg(*(F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("step"))).alias(f"q{int(p * 100)}") for p in (0.25, 0.75)))
    own = spread * (F.col("q75") - F.col("q25"))
    wide, own = F.greatest(own, F.lit(least)), own + STEP
    sides = [(F.col("q25") - wide).alias("low"), (F.col("q75") + wide).alias("high"), (F.col("q25") - own).alias("typical_low"), (F.col("q75") + own).alias("typical_high")]
    return q.select(F.col("lang").alias("band_lang"), *sides)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl, low, high, typical, typical_low, typical_high.

    Null texts have no words and fail the base rules, as do all texts of fewer than
    ``min_words`` words.  Documents without a language form a language of their own;
    one none of whose documents passes the base rules has no band and keeps none.
    Repeated rows get equal verdicts.  Other columns are left behind, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    models = train(rows)
    rows = rows.withColumn("digest", F.xxhash64("text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    measured = materialise(measure(rows, models, ["doc_id", "digest"]).withColumn("base_failed", failed), "perplexity")
    joined = measured.join(bands(measured), F.col("lang") == F.col("band_lang"), "left")
    kept, typical = (~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col(a), F.col(b)), F.lit(False)) for a, b in (("low", "high"), ("typical_low", "typical_high")))
    return joined.select("doc_id", *BASE, "base_failed", kept.alias("kept"), "log_ppl", "low", "high", typical.alias("typical"), "typical_low", "typical_high")
