"""Language identification with interpolated Kneser-Ney models of character 4-grams, one for each language.

Texts are lower-cased; a run of anything but letters is one boundary symbol. All training rows are counted:
every task counts the 4-grams of its rows, the sums are merged by key, and the lower orders follow from the
distinct 4-grams (continuation counts). A model keeps all 4-grams, so it grows with the distinct 4-grams of its
language. Probabilities and back-off weights lie in arrays sorted by a 64-bit hash of the n-gram.
A text gets the language of the lowest cross-entropy for each symbol. Its score is the posterior of that
language; ``rejected`` marks texts whose cross-entropy lies far above what training rows of that language show,
and texts without a letter. What they show is measured on all of them: a histogram of the distinct texts with a letter, of any
length, for each language.

Null texts, empty texts and texts without a letter: language ``und``, score 0, rejected. Null languages are not
learned from; without any training row all texts get ``und``. Ties go to the first language in code point order. Rows are
independent; repeated rows count repeatedly in training. Other columns are not read.
"""

from __future__ import annotations

import functools
import pickle
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..session import reachable
from .common import chunks, sent, tidy, unused

UNDETERMINED = "und"
ORDER = 4
#: Symbols of a text after which more evidence no longer sharpens the score.
EVIDENCE = 100
#: A text is rejected if its cross-entropy exceeds the mean of its language by this many deviations and ...
DEVIATIONS = 8.0
#: ... by this many nats.
NATS = 1.0
#: Bins of a nat in the histograms of cross-entropy that calibrate the rejection.
BINS = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _symbols() -> np.ndarray:
    """For each code point its symbol: the lower-case letter, or 0. Symbols have 16 bits: letters above U+FFFF, of rare scripts, share the symbols
    of the letters 65,536 places below, which makes them letters all the same."""
    out = np.zeros(0x110000, dtype=np.uint16)
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            out[c] = (ord(x.lower()[0]) & 0xFFFF) or 1
    return out


def _hash(keys: np.ndarray) -> np.ndarray:
    x = keys * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram that ends at each symbol, packed; document of each symbol; letters of each document). Boundary
    symbols open a text and end each run of letters."""
    # A separator stands before each text, so that it opens with a boundary symbol.
    whole = "\n".join(["", *texts]) + "\n"
    symbols = _symbols()[np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)]
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    doc = np.append(doc, np.int32(len(texts) - 1)) if len(texts) else doc
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = symbols != 0
    letters = np.bincount(doc[letter], minlength=len(texts))
    opens = np.zeros(len(symbols), dtype=bool)
    opens[np.cumsum(size) - size] = True
    keep = letter | opens
    keep[1:] |= letter[:-1]
    symbols, doc, opens = symbols[keep].astype(np.uint64), doc[keep], opens[keep]
    # What stands before the text's own first symbol counts as boundary.
    count = np.arange(len(symbols), dtype=np.int32)
    place = count - np.maximum.accumulate(np.where(opens, count, 0))
    packed = symbols.copy()
    for back in (1, 2, 3):
        earlier = np.zeros_like(symbols)
        earlier[back:] = symbols[:-back]
        earlier[place < back] = 0
        packed |= earlier << np.uint64(16 * back)
    real = ~opens
    return packed[real], doc[real], letters


def _count(batches: Iterator) -> Iterator:
    """Rows (lang, gram, count) of a task's texts."""
    import pyarrow as pa

    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

    for batch in chunks(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            packed = grams([t for t, x in zip(texts, langs) if x == lang])[0]
            parts = held.setdefault(lang, [])
            parts.append(np.unique(packed, return_counts=True))
            if len(parts) > 8:
                held[lang] = [merged(parts)]
    for lang, parts in held.items():
        keys, counts = merged(parts)
        for a in range(0, len(keys), 50_000):
            k = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(counts[a : a + 50_000])], names=["lang", "gram", "n"])


def _packed(batches: Iterator) -> Iterator:
    """Rows (lang, gram, count) as rows (lang, grams, counts) of a batch's arrays, which the driver reads without a Python object for each."""
    import pyarrow as pa

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        keys, counts = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
        names = sorted(set(langs))
        at = [np.flatnonzero(langs == x) for x in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([keys[a].tobytes() for a in at], pa.binary()), pa.array([counts[a].tobytes() for a in at], pa.binary())], names=["lang", "grams", "counts"])


def _lower(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of packed n-grams."""
    return keys & np.uint64((1 << (16 * order)) - 1)


class Model:
    """Interpolated Kneser-Ney model; every table is a pair (sorted hashes, values)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        keys, counts = keys.astype(np.uint64), counts.astype(np.float64)
        tables = {ORDER: (keys, counts)}
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols in front
            tables[order] = tuple(x for x in np.unique(_lower(np.unique(tables[order + 1][0]), order), return_counts=True))
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = 1.0 / 1024
        for order in range(1, ORDER + 1):
            k, c = tables[order][0], tables[order][1].astype(np.float64)
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = k >> np.uint64(16)
            names, at = np.unique(context, return_inverse=True)
            total = np.bincount(at, weights=c)
            rest = discount * np.bincount(at) / total
            lower = np.full(len(k), self.floor) if order == 1 else self._stored(order - 1, _lower(k, order - 1))
            p = np.maximum(c - discount, 0) / total[at] + rest[at] * lower
            for store, key, value in ((self.grams, k, p), (self.backoff, names, rest)):
                h = _hash(key * np.uint64(8) + np.uint64(order) if order < ORDER else key)
                sort = np.argsort(h)
                store.append((h[sort], value[sort].astype(np.float32)))

    def _find(self, table: tuple[np.ndarray, np.ndarray], order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _hash(keys * np.uint64(8) + np.uint64(order) if order < ORDER else keys)
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return table[0][at] == h, table[1][at]

    def _stored(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Probability of the last symbol after the others."""
        found, p = self._find(self.grams[order - 1], order, keys)
        p = p.astype(np.float64)
        if not found.all():
            miss = np.flatnonzero(~found)
            k = keys[miss]
            lower = np.full(len(k), self.floor) if order == 1 else self._stored(order - 1, _lower(k, order - 1))
            known, rest = self._find(self.backoff[order - 1], order, k >> np.uint64(16))
            p[miss] = np.where(known, rest, 1.0) * lower
        return p

    def log(self, keys: np.ndarray) -> np.ndarray:
        return np.log(self._stored(ORDER, keys))


class Identifier:
    """The models of all languages, and a direct-mapped cache of log probabilities by 4-gram."""

    SLOTS = 1 << 17

    def __init__(self, models: dict[str, Model], limits: dict[str, tuple[float, float]]):
        self.langs = sorted(models)
        self.models, self.limits = models, limits
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(self.SLOTS, dtype=np.uint64)
        self.held = np.zeros((self.SLOTS, len(self.langs)), dtype=np.float32)
        self.filled = np.zeros(self.SLOTS, dtype=bool)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "models": self.models, "limits": self.limits}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def logs(self, keys: np.ndarray) -> np.ndarray:
        slot = (_hash(keys) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        hit = (self.known[slot] == keys) & self.filled[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            new = np.unique(keys[miss])
            values = np.stack([self.models[x].log(new) for x in self.langs], axis=1).astype(np.float32)
            at = (_hash(new) & np.uint64(self.SLOTS - 1)).astype(np.int64)
            self.known[at], self.held[at], self.filled[at] = new, values, True
            out = self.held[slot]
            lost = miss[self.known[slot[miss]] != keys[miss]]  # another new 4-gram took the slot
            if len(lost):
                out[lost] = values[np.searchsorted(new, keys[lost])]
            return out
        return self.held[slot]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy of each text in each language, symbols, letters)."""
        keys, doc, letters = grams(texts)
        logs = self.logs(keys)
        total = np.stack([np.bincount(doc, weights=logs[:, i], minlength=len(texts)) for i in range(len(self.langs))], axis=1)
        size = np.bincount(doc, minlength=len(texts))
        return -total / np.maximum(size, 1)[:, None], size, letters

    def given(self, texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy of each text in its given language, letters)."""
        keys, doc, letters = grams(texts)
        own = np.searchsorted(self.langs, langs)
        logs = self.logs(keys)[np.arange(len(keys)), own[doc]]
        return -np.bincount(doc, weights=logs, minlength=len(texts)) / np.maximum(np.bincount(doc, minlength=len(texts)), 1), letters

    def identify(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.langs:
            return [(UNDETERMINED, 0.0, None, True)] * len(texts)
        entropy, size, letters = self.entropies(texts)
        best = entropy.argmin(axis=1)
        weight = np.minimum(size, EVIDENCE)[:, None]
        score = 1 / np.exp((entropy.min(axis=1, keepdims=True) - entropy) * weight).sum(axis=1)
        out = []
        for i, b in enumerate(best):
            if not letters[i]:
                out.append((UNDETERMINED, 0.0, None, True))
                continue
            mean, deviation = self.limits.get(self.langs[b], (np.inf, 1.0))
            over = float(entropy[i, b]) - mean
            out.append((self.langs[b], float(min(score[i], 1.0)), float(entropy[i, b]), bool(over > NATS and over > DEVIATIONS * deviation / np.sqrt(max(1, min(size[i], 400) / 400)))))
        return out


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Identifier:
    """Models from all rows of ``df`` with a language and a text; the rejection is calibrated on the same rows, each
    distinct text of a language once."""
    reachable(df.sparkSession)
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counted = rows.mapInArrow(tidy(_count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in counted.mapInArrow(tidy(_packed), "lang string, grams binary, counts binary").toLocalIterator(prefetchPartitions=True):
        held.setdefault(r.lang, []).append((np.frombuffer(r.grams, np.uint64), np.frombuffer(r.counts, np.int64)))
    models = {}
    for lang in sorted(held):
        keys, counts = (np.concatenate(x) for x in zip(*held.pop(lang)))
        order = np.argsort(keys)
        models[lang] = Model(keys[order], counts[order])
    plain = Identifier(models, {})
    if not models:
        return plain
    given = sent(rows, pickle.dumps(plain))

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _loaded(given.value)
        for batch in chunks(batches, "text"):
            h, letters = own.given(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            some = pa.array(letters > 0)
            yield pa.RecordBatch.from_arrays([batch.column("lang").filter(some), batch.column("key").filter(some), pa.array(h).filter(some)], names=["lang", "key", "h"])

    measure.clear = _loaded.cache_clear
    # Texts are told apart by a hash, so that none is moved; a language then has as many rows as bins.
    measured = rows.withColumn("key", F.xxhash64("text")).mapInArrow(tidy(measure), "lang string, key bigint, h double").groupBy("lang", "key").agg(F.min("h").alias("h"))
    bins = measured.groupBy("lang", F.round(F.col("h") * BINS).alias("bin")).agg(F.count("h").alias("n"))
    shown = bins.groupBy("lang").agg(*(F.percentile("bin", q, F.col("n")).alias(name) for q, name in ((0.5, "mean"), (0.9, "high"))))
    limits = {r.lang: (r.mean / BINS, max((r.high - r.mean) / BINS / 1.28, 0.02)) for r in shown.collect()}
    return Identifier(models, limits)


@functools.lru_cache(maxsize=1)
def _loaded(raw: bytes) -> Identifier:
    return pickle.loads(raw)


def identify(df: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) of each row, or the columns ``keep`` instead of the id, in one
    pass over the scan. Columns of ``keep`` named like a result give way to it."""
    results = ["lang_pred", "score", "cross_entropy", "rejected"]
    names = [c for c in (keep or [id_col]) if c not in results]
    own_text = unused("text", [*names, *results])
    given = sent(df, pickle.dumps(identifier))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _loaded(given.value)
        for batch in chunks(batches, own_text):
            rows = own.identify([t or "" for t in batch.column(own_text).to_pylist()])
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names + results)

    run.clear = _loaded.cache_clear
    schema = StructType([df.schema[c] for c in names] + [StructField(c, k) for c, k in zip(results, (StringType(), DoubleType(), DoubleType(), BooleanType()))])
    return df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").alias(own_text)).mapInArrow(tidy(run), schema)


__all__ = ["Identifier", "Model", "identify", "train", "UNDETERMINED"]
assert sys.byteorder == "little"
