"""Words of many texts at once: vectorised boundaries and 64-bit hashes over Arrow string columns.

Each word's hash is a polynomial over its bytes modulo 2**64, from running sums
over the whole buffer, mixed and salted with the word's length. No Python
object is made for a word, but for those of more than LONG bytes: such
polynomials can be made to collide from some thousand bytes on, so long words
are digested one by one. Buffers are worked through in pieces of about PIECE
bytes, cut between words, so that memory follows the piece and not the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
#: Texts whose words are held at a time, and their bytes, but for a single text of more.
ROWS, BYTES = 1_024, 1 << 20
#: Bytes of a word from which it is digested by itself.
LONG = 128
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, and 5 modulo 8, so that its powers differ as long as can be
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII character that is neither a letter nor a digit.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class WordHasher:
    """Hashes of the words of texts; fold: A-Z count as a-z; between: the bytes that part words.

    prefixes: lengths in bytes; each word then has as many hashes more, of its
    beginnings, and of itself again where it is no longer than that.
    """

    def __init__(self, fold: bool = True, seed: int = 1, between: np.ndarray = SPACES, prefixes: tuple[int, ...] = ()) -> None:
        self.between, self.prefixes = between, prefixes
        values = mix(np.arange(1, 257, dtype=np.uint64) + _U(seed) * _U(0x632BE59BD9B4E019))
        self.fold = _lower() if fold else np.arange(256, dtype=np.uint8)
        self.values = values[self.fold]
        self._powers(PIECE + 4096)

    def _powers(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([one, np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)

    def _piece(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self._powers(len(data) + 1)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        down, part = self.down[starts], _U(0xD6E8FEB86659FD93)
        out = np.empty((len(starts), 1 + len(self.prefixes)), np.uint64)
        out[:, 0] = mix((sums[ends] - sums[starts]) * down + (ends - starts).astype(np.uint64) * part)
        for k in np.flatnonzero(ends - starts > LONG):
            out[k, 0] = int.from_bytes(hashlib.blake2b(self.fold[data[starts[k] : ends[k]]].tobytes(), digest_size=8).digest(), "little")
        for k, n in enumerate(self.prefixes, 1):
            # a beginning is told from a whole word by the odd salt
            begun = mix((sums[np.minimum(starts + n, ends)] - sums[starts]) * down + _U((n * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1)))
            out[:, k] = np.where(ends - starts > n, begun, out[:, 0])
        return out.reshape(-1)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts data[offsets[k]:offsets[k + 1]], word by word, and each text's first place among them."""
        n, hashes, begins = len(data), [], []
        marks = offsets[:-1]
        at = 0
        while at < n:
            end = min(n, at + PIECE)
            if end < n:  # cut behind a space, or else where a text begins
                back = np.flatnonzero(self.between[data[max(at, end - 4096) : end]])
                if len(back):
                    end = max(at, end - 4096) + int(back[-1]) + 1
                else:
                    while end < n and not self.between[data[end]]:
                        end += 1
            piece = data[at:end]
            word = ~self.between[piece]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            own = marks[np.searchsorted(marks, at) : np.searchsorted(marks, end)] - at
            first[own] = word[own]
            own = own[own > 0] - 1
            last[own] = word[own]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            hashes.append(self._piece(piece, starts, ends))
            begins.append(starts + at)
            at = end
        if not hashes:
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets) * (1 + len(self.prefixes))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = column.cast(pa.large_string()).fill_null("")
        kind = np.int64
    else:
        kind = np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """The column in slices of at most ROWS texts and BYTES bytes; a longer text is a slice of its own."""
    _, offsets = utf8(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + BYTES, side="right")) - 1
        end = min(max(end, at + 1), at + ROWS, len(column))
        yield column[at:end]
        at = end


_WEIGHTS = mix(np.arange(101, 133, dtype=np.uint64)) | _U(1)


class Shingler:
    """Distinct shingle hashes of texts: runs of ``size`` words, or the whole text if it has fewer."""

    def __init__(self, size: int = 5) -> None:
        self.size, self.hasher = size, WordHasher()

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each text its distinct shingles' hashes, ascending, a piece of the column at a time."""
        for part in pieces(column):
            yield from self._sets(part)

    def _sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = utf8(column)
        words, first = self.hasher.words(data, offsets)
        runs = np.zeros(max(0, len(words) - self.size + 1), np.uint64)
        for k in range(self.size):
            runs += words[k : k + len(runs)] * _WEIGHTS[k]
        runs = mix(runs)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= self.size:
                yield np.unique(runs[a : b - self.size + 1])
            elif b > a:
                yield mix((words[a:b] * _WEIGHTS[: b - a]).sum(keepdims=True) + _U(b - a))
            else:
                yield np.empty(0, np.uint64)
