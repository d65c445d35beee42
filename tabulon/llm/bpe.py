"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regular expression. Every code point is mapped to a class through an
array; with one look ahead for white space and apostrophes the split pattern of the public byte-level
vocabularies becomes an automaton of eight states. The functions "state before -> state after" of its
symbols generate a small monoid, so a whole batch of texts is scanned with an associative composition
table: first inside blocks, then over the blocks, then once more to emit the boundaries. The slices
between boundaries go through a cached pair merge. Byte offsets of the tokens are kept and drive decoding.

Null texts count as empty; an empty text has no tokens and decodes to no bytes. Rows are independent, so
repeated rows give repeated results, an empty table an empty one, and other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, sent, tidy

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
#: Code points with the White_Space property besides U+0020.
WHITE_POINTS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode 16 adds to the tables of this Python.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Suffixes after an apostrophe that the split pattern keeps together.
SHORT_SUFFIXES, LONG_SUFFIXES = "stmd", ("re", "ve", "ll")

# Symbols: what an automaton reads at one code point.
S_LETTER, S_NUMBER, S_OTHER, S_PREFIX, S_LAST_WHITE, S_WHITE, S_APOS1, S_APOS2 = range(8)
# States after a code point.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_PREFIX, IN_WHITE, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at this code point."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return BEGIN, False
    if symbol in (S_APOS1, S_APOS2):
        if state in (IN_OTHER, AFTER_PREFIX):
            return IN_OTHER, False
        return (ONE_MORE if symbol == S_APOS1 else TWO_MORE), True
    if symbol == S_PREFIX:
        return AFTER_PREFIX, True
    if symbol == S_LAST_WHITE:
        return BEGIN, True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    own = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER}[symbol]
    return own, state not in (own, AFTER_PREFIX)


@functools.cache
def automaton() -> tuple[np.ndarray, ...]:
    """(function of a symbol, function of a symbol that opens a text, composition table, the functions as
    rows of end states, next state and boundary by state * 8 + symbol)."""
    table = [[_step(s, x) for x in range(8)] for s in range(8)]
    plain = [tuple(table[s][x][0] for s in range(8)) for x in range(8)]
    opening = [(table[BEGIN][x][0],) * 8 for x in range(8)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *plain, *opening]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in list(known):
            for a, b in ((f, g), (g, f)):
                h = tuple(b[s] for s in a)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    rows = np.array(list(known), dtype=np.uint8)
    compose = np.array([[known[tuple(b[s] for s in a)] for b in known] for a in known], dtype=np.uint16)
    ids = np.array([known[f] for f in plain], dtype=np.uint16), np.array([known[f] for f in opening], dtype=np.uint16)
    after = np.array([table[s][x][0] for s in range(8) for x in range(8)], dtype=np.uint8)
    begins = np.array([table[s][x][1] for s in range(8) for x in range(8)], dtype=bool)
    return *ids, compose, rows, after, begins


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    for ranges, own in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = own
    out[WHITE_POINTS] = WHITE
    out[0x20] = SPACE
    return out


def boundaries(points: np.ndarray, starts: np.ndarray, block: int = 128) -> np.ndarray:
    """Where slices begin in ``points``, the code points of all texts in a row; ``starts`` are the places of
    the texts' first code points (of non-empty texts, ascending, the first is 0)."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    plain, opening, compose, rows, after, begins = automaton()
    kind = classes()[points]
    ends = np.zeros(n, dtype=bool)
    ends[np.append(starts[1:], n) - 1] = True
    white = kind >= SPACE
    before_text = np.zeros(n, dtype=bool)  # a code point that is not white follows in the same text
    before_text[:-1] = ~white[1:]
    before_text &= ~ends
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_WHITE], dtype=np.uint8)[kind]
    symbol[(kind == SPACE) & before_text] = S_PREFIX
    symbol[(kind == WHITE) & before_text] = S_LAST_WHITE
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.append(points, [0, 0])
        first, second = padded[at + 1], padded[at + 2]
        ends_padded = np.append(ends, True)
        same1, same2 = ~ends[at], ~ends[at] & ~ends_padded[at + 1]
        symbol[at[same1 & np.isin(first, [ord(c) for c in SHORT_SUFFIXES])]] = S_APOS1
        long = np.zeros(len(at), dtype=bool)
        for a, b in LONG_SUFFIXES:
            long |= (first == ord(a)) & (second == ord(b))
        symbol[at[same2 & long]] = S_APOS2

    fun = plain[symbol]
    fun[starts] = opening[symbol[starts]]
    width = max(1, -(-n // block))
    grid = np.zeros(width * block, dtype=np.uint16)  # function 0 is the identity
    grid[:n] = fun
    grid = np.ascontiguousarray(grid.reshape(width, block).T)
    flat, m = compose.ravel(), np.int64(compose.shape[0])
    total = grid[0].astype(np.int64)
    for row in grid[1:]:
        total = flat[total * m + row].astype(np.int64)
    # An associative scan over the blocks gives the state in which each block is entered.
    scan, step = total.copy(), 1
    while step < width:
        scan[step:] = flat[scan[:-step] * m + scan[step:]]
        step *= 2
    state = np.zeros(width, dtype=np.int64)
    state[1:] = rows[scan[:-1], BEGIN]
    symbols = np.zeros(width * block, dtype=np.uint8)
    symbols[:n] = symbol
    symbols = np.ascontiguousarray(symbols.reshape(width, block).T)
    opens = np.zeros(width * block, dtype=bool)
    opens[starts] = True
    opens = np.ascontiguousarray(opens.reshape(width, block).T)
    out = np.empty((block, width), dtype=bool)
    for i in range(block):
        state[opens[i]] = BEGIN
        code = state * 8 + symbols[i]
        out[i] = begins[code]
        state = after[code].astype(np.int64)
    found = np.ascontiguousarray(out.T).ravel()[:n]
    found[starts] = True
    return np.flatnonzero(found)


class Vocabulary(dict):
    """Ranks of byte strings, and the cache from slices (text) to their token ids."""

    #: Slices kept; the cache is emptied when it is full, and long slices are not kept.
    MOST, LONGEST = 200_000, 64

    def __init__(self, tiktoken_file: bytes):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, tiktoken_file.splitlines()) if a}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.blob_at = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        ids = self.merge(raw)
        if len(raw) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Token ids of one slice: the pair of lowest rank is merged, the leftmost first."""
        rank = self.ranks.get(raw)
        if rank is not None:
            return (rank,)
        return self._merge_long(raw) if len(raw) > 256 else self._merge_short(raw)

    def _merge_short(self, raw: bytes) -> tuple[int, ...]:
        get, none = self.ranks.get, 1 << 60
        cut = list(range(len(raw) + 1))
        pair = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(raw[cut[i] : cut[i + 2]], none)
            if i:
                pair[i - 1] = get(raw[cut[i - 1] : cut[i + 1]], none)
        ranks = self.ranks
        return tuple(ranks[raw[a:b]] for a, b in zip(cut, cut[1:]))

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same in n log n, with a heap over a linked list."""
        n, get = len(raw), self.ranks.get
        end = list(range(1, n + 1))  # the part that begins at i ends there
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(raw[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := get(raw[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return tuple(self.ranks[raw[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.cumsum(size) - size
        cuts = boundaries(points, first[size > 0])
        edge = np.searchsorted(cuts, np.append(first, len(points))).tolist()
        at = cuts.tolist()
        at.append(len(points))
        pieces = [whole[a:b] for a, b in zip(at, at[1:])]
        get = self.__getitem__
        return [list(chain.from_iterable(map(get, pieces[a:b]))) for a, b in zip(edge, edge[1:])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token, and the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of tokens whose offsets are known: one gather."""
        if not len(ids):
            return b""
        place = np.repeat(self.blob_at[ids] - offsets[:-1], self.lengths[ids])
        place += np.arange(offsets[-1])
        return self.blob[place].tobytes()


@functools.lru_cache(maxsize=1)
def _vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def _forget() -> None:
    _vocabulary.cache_clear()


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>, byte_offsets array<long>): the last offset is the number of bytes.

    The vocabulary file is read by the driver and sent to the workers: its size is fixed."""
    raw = sent(df, _file(vocabulary_path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary = _vocabulary(raw.value)
        for batch in chunks(batches, "text"):
            ids = [np.array(x, dtype=np.int32) for x in vocabulary.encode([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array([vocabulary.offsets(x) for x in ids], pa.list_(pa.int64()))],
                names=["id", "token_ids", "byte_offsets"],
            )

    run.clear = _forget
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, token_ids array<int>, byte_offsets array<bigint>")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, decoded binary) from ``token_ids`` and ``byte_offsets``; null ids decode to no bytes."""
    raw = sent(df, _file(vocabulary_path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary = _vocabulary(raw.value)
        for batch in batches:
            ids = [np.array(x or [], dtype=np.int64) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([vocabulary.decode(x, vocabulary.offsets(x)) for x in ids], pa.binary())], names=["id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), "token_ids").mapInArrow(tidy(run), f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, token_ids]): encodes and decodes in one pass over the scan, without a
    shuffle."""
    raw = sent(df, _file(vocabulary_path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary = _vocabulary(raw.value)
        decimal, sha = vocabulary.decimal.__getitem__, hashlib.sha256
        for batch in chunks(batches, "text"):
            counts, written, read, kept = [], [], [], []
            for ids in vocabulary.encode([t or "" for t in batch.column("text").to_pylist()]):
                array = np.array(ids, dtype=np.int64)
                counts.append(len(ids))
                written.append(sha(" ".join(map(decimal, ids)).encode()).hexdigest())
                read.append(sha(vocabulary.decode(array, vocabulary.offsets(array))).hexdigest())
                if with_ids:
                    kept.append(array.astype(np.int32))
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(written, pa.string()), pa.array(read, pa.string())]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(columns)])

    run.clear = _forget
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
