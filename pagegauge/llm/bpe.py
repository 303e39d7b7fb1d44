"""Byte-level BPE encoding and decoding by a file of merge ranks.

Each match of the split pattern is merged on its own: a segment tree over its
byte positions keeps the leftmost pair of least rank, and a merge updates the
points of the live neighbours it touches, so that a match of n bytes takes
O(n log n) steps, however long it is. Short matches are merged many at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Matches whose ids a worker remembers; beyond it forgets all of them.
REMEMBERED = 100_000
_NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines: base64 of the bytes, a space, the rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the pair of least rank, leftmost first, merges until no pair has a rank."""
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [_NONE] * (2 * size)
    rank = ranks.get
    for k in range(n - 1):
        r = rank(word[k : k + 2])
        if r is not None:
            tree[size + k] = r << 32 | k
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(k: int, value: int) -> None:
        k += size
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            if other < value:
                value = other
            if tree[k] == value:
                return
            tree[k] = value

    top = 1
    while (least := tree[top]) != _NONE:
        k = least & 0xFFFFFFFF
        gone = after[k]
        end[k] = end[gone]
        nxt = after[k] = after[gone]
        if gone < n - 1:
            put(gone, _NONE)
        if nxt < n:
            before[nxt] = k
            r = rank(word[k : end[nxt]])
            put(k, _NONE if r is None else r << 32 | k)
        else:
            put(k, _NONE)
        prev = before[k]
        if prev >= 0:
            r = rank(word[prev : end[k]])
            put(prev, _NONE if r is None else r << 32 | prev)
    out, k = [], 0
    while k < n:
        out.append(ranks[word[k : end[k]]])
        k = after[k]
    return out


class Forest:
    """merge() of many matches at once: their segment trees are rows of one array and take each step together.

    A step finds every tree's root, merges there and updates the points of the
    pair that is gone, of the merged one and of the one before, level by level.
    """

    WIDEST = 64

    def __init__(self, ranks: dict[bytes, int]) -> None:
        rank = ranks.get
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for word, r in ranks.items():
            for k in range(1, len(word)):
                left, right = rank(word[:k]), rank(word[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        first = np.repeat(self.byte_ids, 256) << 32 | np.tile(self.byte_ids, 256)
        k = np.minimum(np.searchsorted(self.keys, first), len(self.keys) - 1)
        self.of_bytes = np.where(self.keys[k] == first, self.values[k], -1)

    def _rank(self, left: np.ndarray, right: np.ndarray, ok: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """rank * width + place of each pair, _NONE where it has no rank."""
        key = left << 32 | right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(ok & (self.keys[k] == key), self.values[k] * width + at, _NONE)

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word of 2 to WIDEST bytes."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = 2
        while width <= self.WIDEST:
            pick = np.flatnonzero((lengths <= width) & ((lengths > width // 2) | (width == 2)))
            for k in range(0, len(pick), 4_096):
                part = pick[k : k + 4_096]
                for i, ids in zip(part.tolist(), self._group([words[i] for i in part.tolist()], lengths[part], width), strict=True):
                    out[i] = ids
            width *= 2
        return out

    def _group(self, words: list[bytes], n: np.ndarray, width: int) -> list[tuple[int, ...]]:
        m = len(words)
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        token = np.zeros((m, width + 1), np.int64)
        token[:, :width] = self.byte_ids[data]
        places = np.arange(width, dtype=np.int64)
        live = places < n[:, None]
        after = np.broadcast_to(np.arange(1, width + 2), (m, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (m, width + 1)).copy()
        tree = np.full((m, 2 * width), _NONE, np.int64)
        start = self.of_bytes[data[:, :-1].astype(np.int64) << 8 | data[:, 1:]]
        tree[:, width:-1] = np.where((start >= 0) & (places[1:] < n[:, None]), start * width + places[:-1], _NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        rows = np.arange(m)

        def put(r: np.ndarray, k: np.ndarray, value) -> None:
            k = k + width
            tree[r, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        while len(rows := rows[tree[rows, 1] != _NONE]):
            least = tree[rows, 1]
            k = least & (width - 1)
            gone = after[rows, k]
            nxt = after[rows, gone]
            token[rows, k] = least // width
            after[rows, k] = nxt
            before[rows, np.minimum(nxt, width)] = k
            live[rows, gone] = False
            put(rows, gone, _NONE)
            put(rows, k, self._rank(token[rows, k], token[rows, np.minimum(nxt, width)], nxt < n[rows], k, width))
            some = np.flatnonzero(k > 0)
            if len(some):
                r, now = rows[some], k[some]
                prev = before[r, now]
                put(r, prev, self._rank(token[r, prev], token[r, now], np.ones(len(r), bool), prev, width))
        ids = token[:, :width][live].tolist()
        ends = np.cumsum(live.sum(axis=1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]


#: Letters, numbers and white space below U+0250, for texts that hold nothing beyond: Python's own matcher takes half the time.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-\u024f]")


class Tokenizer:
    """encode() and decode() as the tiktoken library does without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        # that library's white space is the Unicode property, without the separators U+001C to U+001F
        self.split_any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACES}{_LETTERS}{_NUMBERS}]")
        for name, chars in ((r"\p{L}", _LETTERS), (r"\p{N}", _NUMBERS), (r"\s", _SPACES)):
            narrow = narrow.replace(name, f"[{chars}]")
        narrow = narrow.replace(r"\S", f"[^{_SPACES}]")
        # a pattern with classes of other kinds keeps to the full matcher
        self.split_low = None if r"\p" in narrow else re.compile(narrow).findall
        self.ranks = ranks
        self.forest = Forest(ranks)
        self.known: dict[str, tuple[int, ...]] = {}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if self.split_low is None or _BEYOND.search(text) else self.split_low(text)

    def _learn(self, new: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of matches; the short ones are remembered."""
        out, short = {}, []
        for match in new:
            word = match.encode()
            whole = self.ranks.get(word)
            if whole is not None:
                out[match] = (whole,)
            elif len(word) <= Forest.WIDEST:
                short.append((match, word))
            else:
                out[match] = tuple(merge(word, self.ranks))
        out.update(zip([m for m, _ in short], self.forest.merge([w for _, w in short])))
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text; what the texts have not shown before is merged together."""
        matches = [self.split(x or "") for x in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids = self.known
        new = set().union(*matches).difference(ids) if matches else set()
        if new:
            made = self._learn(new)
            long = [m for m in made if len(m) > Forest.WIDEST]
            if long:
                ids = {**ids, **made}
                made = {m: v for m, v in made.items() if len(m) <= Forest.WIDEST}
            else:
                ids.update(made)
            self.known.update(made)
        of = ids.__getitem__
        for x in matches:
            yield list(chain.from_iterable(map(of, x)))

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _tokenizer(data: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(read_ranks(data), pattern)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row; a null or empty text has no ids. Repeated rows and null ids stay."""
    data = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def run(batches):
        tokenizer = _tokenizer(data.value, pattern)
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(tokenizer.encode_batch(part.column(1).to_pylist())), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and bytes (binary) of each row of ids; null ids decode to no bytes."""
    data = encoded.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def run(batches):
        tokenizer = _tokenizer(data.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokenizer.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col]).mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from the ids.

    Both steps run in one pass, so that ids need not travel between them.
    """
    data = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def run(batches):
        tokenizer = _tokenizer(data.value, pattern)
        for batch in batches:
            sizes, listed, decoded = [], [], []
            for part in _parts(batch):
                for ids in tokenizer.encode_batch(part.column(1).to_pylist()):
                    sizes.append(len(ids))
                    listed.append(hashlib.sha256(tokenizer.listed(ids).encode()).hexdigest())
                    decoded.append(hashlib.sha256(tokenizer.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
