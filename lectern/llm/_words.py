"""Words of whole Arrow text columns as numpy arrays: spans, 64-bit codes and codes of n consecutive words.

A word's code is a polynomial over its bytes modulo 2**64, taken from one running sum over a chunk of texts,
then mixed; the code of n words is the same over word codes. Chunks bound memory: a chunk holds whole texts of
about CHUNK bytes together, or one text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if kind not in _POWERS or len(_POWERS[kind][0]) <= n:
        out = []
        for b in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            p = np.full(max(n, CHUNK) + 1, b, dtype=U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _POWERS[kind] = tuple(out)
    return _POWERS[kind]


@dataclass(frozen=True)
class Alphabet:
    """Which bytes separate words, and whether A-Z count as a-z."""

    separators: bytes
    fold: bool = False

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.ones(256, dtype=bool)
        inside[list(self.separators)] = False
        value = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
        if self.fold:
            value[65:91] = value[97:123]
        return inside, value


#: Words are what white space (space, tab to carriage return) leaves.
PLAIN = Alphabet(b" \t\n\x0b\x0c\r")
FOLDED = Alphabet(b" \t\n\x0b\x0c\r", fold=True)
#: Words are ASCII letters and digits and everything beyond ASCII.
ALNUM = Alphabet(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)


@dataclass
class Words:
    """The words of some rows: word i is data[start[i]:end[i]], of row doc[i], with code[i]; row r has words first[r]:first[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n consecutive words of one row start, and their codes."""
        m = len(self.code) - n + 1
        if m <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
        power, back = _powers("word", len(self.code))
        run = np.zeros(len(self.code) + 1, dtype=U)
        np.cumsum(self.code * power[: len(self.code)], out=run[1:])
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, mix((run[at + n] - run[at]) * back[at] + U(n))


def words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    """data: the bytes of the texts one after another; offsets: where each begins, and the end."""
    inside, value = alphabet.tables()
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.empty(0, dtype=np.int64)
        return Words(data, none, none, np.empty(0, dtype=U), none, np.zeros(rows + 1, dtype=np.int64))
    is_in = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_or(~is_in[:-1], edge[1:n], out=before[1:])
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = before[1:] | ~is_in[1:]
    start, end = np.flatnonzero(is_in & before), np.flatnonzero(is_in & after) + 1
    power, back = _powers("byte", n)
    run = np.zeros(n + 1, dtype=U)
    np.cumsum(value[data] * power[:n], out=run[1:])
    code = mix((run[end] - run[start]) * back[start] + (end - start).astype(U))
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, code, np.repeat(np.arange(rows), np.diff(first)), first)


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, bytes and offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, held = column.buffers()
    offsets = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(held, dtype=np.uint8) if held is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        to = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        to = min(max(to, row + 1), len(column))
        yield row, to - row, held[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
