"""N-gram Jaccard join: links between documents whose shingle sets are alike, and their components.

A size-aware heavy-light join. Sets of up to a boundary size enumerate the
fixed-size subsets that any linked partner must share and meet by equal
subsets; larger sets meet in inverted lists, of which each set scans those of
its first size - need + 1 shingles, shingles with long lists last. The boundary
is where enumerating costs more than scanning, from the mean list length that
the corpus shows.

Documents with equal sets are one node. Work on a list is never all its pairs:
members meet one pivot each, linked nodes become components, and only members
still in different components meet each other, in blocks, before the lists are
exhausted; so a group of near copies costs about its size, and no link between
components is lost. Lists of heavy shingles are dealt in parts with a pivot
each, and the parts' pivots meet. Marks, parities of hashed shingles, rule out
most candidates without their texts. The rest are verified on whole texts, a
pivot's text once for all it meets in a part. Numbers of links are counted last,
within components, by overlaps of whole sets block by block. Words, shingles and
sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import joinable, materialise, scratch, unused
from .textcore import Shingler, mix

#: Rows of a lists' buffer in a Python worker; shingles that are counted together; postings or edges in work together.
BUFFER, COUNTED, HELD = 200_000, 1_000_000, 200_000
#: Bits of the candidates' filter: so many a candidate, within these bounds (16 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Shingles at most that are put last for their long lists, a fixed bound of what is broadcast. Order is for speed: any gives the same links.
HEAVY = 65_536
#: Members of a list that meet one pivot; a list that may be longer is dealt in as many parts as that takes.
PART = 2_048
#: A list of more members than this is cut into blocks when its members meet each other.
BLOCK = 1_024
#: Shingles of a block of a component's sets, on average, and columns of the table of bits that overlaps are counted in.
SHINGLES, COLUMNS = 1 << 20, 8_192
#: Least bits of a set's mark.
MARK = 512
_U = np.uint64


@dataclass(frozen=True)
class Ratio:
    """The least Jaccard similarity num / den of a link."""

    num: int = 3
    den: int = 4

    def least(self, n: int) -> int:
        """The least overlap of a set of n with any partner."""
        return -(-self.num * n // self.den)

    def overlap(self, n, m):
        """The least overlap of linked sets of n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def sizes(self, n: int) -> range:
        return range(self.least(n), self.den * n // self.num + 1)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1


def boundary(list_length: float, ratio: Ratio = Ratio(), most: int = 12) -> int:
    """The largest size whose sets enumerate subsets: as long as that costs no more than scanning its lists."""
    out = 0
    for n in range(1, most + 1):
        if sum(comb(n, c) for c in {ratio.overlap(n, m) for m in ratio.sizes(n)} if c <= n) > ratio.prefix(n) * max(1.0, list_length):
            break
        out = n
    return out


def node_of(shingles: np.ndarray) -> int:
    """The identity of a set, as a signed 64-bit number."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def mark_of(shingles: np.ndarray) -> bytes:
    """Parities of the set's shingles over slots, two or more a shingle: sets differ in at least as many shingles as their marks in bits."""
    bits = max(MARK, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles >> _U(7) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(mark: bytes, size: int) -> np.ndarray:
    """A mark as it were with fewer slots, ``size`` bytes of them: halves added up."""
    out = np.frombuffer(mark, np.uint64)
    while len(out) * 8 > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def distances(marks: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the marks of each pair of places differ, the longer one folded."""
    widths = np.array([len(m) for m in marks])
    level, out = np.minimum(widths[x], widths[y]), np.empty(len(x), np.int64)
    for w in np.unique(level).tolist():
        pick = np.flatnonzero(level == w)
        ids = np.unique(np.concatenate([x[pick], y[pick]]))
        rows = np.stack([folded(marks[k], w) for k in ids.tolist()])
        step = max(1, (8 << 20) // w)
        for j in range(0, len(pick), step):
            some = pick[j : j + step]
            out[some] = np.bitwise_count(rows[np.searchsorted(ids, x[some])] ^ rows[np.searchsorted(ids, y[some])]).sum(axis=1)
    return out


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


PROFILE = "kind int, a long, key long, b long, c long, mark binary"


def _profile(size: int):
    """Rows (0, row's id, text's key, set size, node, mark) of documents, a mark for the first row of a node at hand, and
    (1, shingle, null, count, null, null) of shingles often counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, rows, seen = Shingler(size), [], 0, set()

        def often() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            pick = counts >= 3
            v, c = values[pick].view(np.int64), counts[pick].astype(np.int64)
            none = pa.nulls(len(v), pa.int64())
            return _batch(kind=np.ones(len(v), np.int32), a=v, key=none, b=c, c=none, mark=pa.nulls(len(v), pa.binary()))

        for batch in batches:
            nodes, sizes, marks = [], [], []
            for s in shingler.sets(batch.column(2)):
                node = node_of(s) if len(s) else None
                nodes.append(node)
                sizes.append(len(s))
                marks.append(mark_of(s) if len(s) > 1 and node not in seen else None)
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(s)
                    rows += len(s)
                if rows > COUNTED:
                    yield often()
                    held, rows, seen = [], 0, set()
            yield _batch(kind=np.zeros(len(nodes), np.int32), a=batch.column(0), key=batch.column(1), b=pa.array(sizes, pa.int64()), c=pa.array(nodes, pa.int64()), mark=pa.array(marks, pa.binary()))
        if held:
            yield often()

    return run


def ordered(shingles: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the order all sets share: by hash, the heavy ones last by their count."""
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)
        found = heavy[at] == shingles
        if found.any():
            key = np.where(found, rank[at].astype(np.uint64) | _U(1 << 63), shingles >> _U(1))
            return shingles[np.argsort(key, kind="stable")]
    return shingles


def signatures(shingles: np.ndarray, limit: int, ratio: Ratio) -> tuple[np.ndarray, int]:
    """(subset signatures of a set, prefix length): up to ``limit`` by subsets, and by lists above and where larger partners are."""
    n = len(shingles)
    subsets = np.empty(0, np.uint64)
    if n <= limit:
        out = []
        for c in sorted({ratio.overlap(n, m) for m in ratio.sizes(n)}):
            if c <= n:
                picks = np.array(list(combinations(range(n), c)))
                out.append(mix(mix(shingles[picks] + _U(c)).sum(axis=1, dtype=np.uint64) + _U(0x51ED270B * c)))
        subsets = np.concatenate(out)
    lists = 0 if n <= limit and n < ratio.least(limit + 1) else ratio.prefix(n)
    return subsets, lists


POSTINGS = "sig long, part int, node long, place long"


def _postings(size: int, heavy: list[tuple[int, int]], limit: int, ratio: Ratio):
    """Rows (signature, part, node, size << 32 | place) of each distinct set; subset signatures have place 0.

    part: -1, but for a shingle counted more than PART times the part of its list that the node is dealt to.
    """
    by_hash = sorted((h & (2**64 - 1), c) for h, c in heavy)
    hashes = np.array([h for h, _ in by_hash], np.uint64)
    counts = np.array([c for _, c in by_hash], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        rank = np.empty(len(hashes), np.int64)
        rank[np.lexsort((hashes, counts))] = np.arange(len(hashes))
        sigs, nodes, places, rows = [], [], [], 0

        def out() -> pa.RecordBatch:
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            part = np.full(len(sig), -1, np.int32)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, sig), len(hashes) - 1)
                long_ = np.flatnonzero((hashes[at] == sig) & (counts[at] > PART))
                parts = -(-counts[at[long_]] // PART)
                part[long_] = (mix(node[long_].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
            return _batch(sig=sig.view(np.int64), part=part, node=node, place=np.concatenate(places))

        for batch in batches:
            for s in shingler.sets(batch.column(0)):
                n = len(s)
                if n < 2:  # alike only if equal
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                seen.add(node)
                subsets, lists = signatures(s, limit, ratio)
                first = ordered(s, hashes, rank)[:lists]
                sigs += [subsets, first]
                nodes.append(np.full(len(subsets) + len(first), node, np.int64))
                places += [np.full(len(subsets), n << 32, np.int64), (n << 32) + np.arange(len(first), dtype=np.int64)]
                rows += len(subsets) + len(first)
                if rows > HELD:
                    yield out()
                    sigs, nodes, places, rows = [], [], [], 0
            if len(seen) > COUNTED:
                seen = set()
        if rows:
            yield out()

    return run


def may_link(ratio: Ratio, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether sets that share the shingle at these places (size << 32 | place) can still overlap enough."""
    n, m = pa_ >> 32, pb >> 32
    left = np.minimum(n - (pa_ & 0xFFFFFFFF), m - (pb & 0xFFFFFFFF))
    return (left >= ratio.overlap(n, m)) & (ratio.den * np.minimum(n, m) >= ratio.num * np.maximum(n, m))


MEETINGS = "kind int, a long, b long, c long, part int"


def _meet_pivots(ratio: Ratio):
    """Over postings by (signature, part, node): rows (0, node, node) of pairs to verify, (2, pivot, node) of pairs of
    which one a node will do, (1, signature, node, place) of lists to look at again, and (3, signature, node, place) of
    the pivots of a list's parts.

    Members of a list of up to 3 meet each other, those of longer ones and of
    parts may meet the first member. A list is never held: what goes on from
    buffer to buffer is its first member. part: the pairs' pivots are dealt by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
        open_ = None  # (signature, part, pivot node, pivot place, last node, members) of a list that goes on
        held: list[list[np.ndarray]] = []
        rows = 0

        def of(kind: int, a, b, c=None, part=None) -> pa.RecordBatch:
            n = len(a)
            return _batch(kind=np.full(n, kind, np.int32), a=a, b=b, c=pa.nulls(n, pa.int64()) if c is None else c, part=np.zeros(n, np.int32) if part is None else part.astype(np.int32))

        def work(sig, part, node, place, last: bool):
            nonlocal open_, rest
            rest = [x[:0] for x in (sig, part, node, place)]
            if len(sig):
                new = np.ones(len(sig), bool)
                new[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1])
                sig, part, node, place = (x[new] for x in (sig, part, node, place))
            pairs, stars, wide = [], [], []
            if open_ is not None:
                on = (sig == open_[0]) & (part == open_[1])
                k = int(on.sum())  # they come first
                if k:
                    mine = slice(1 if node[0] == open_[4] else 0, k)
                    ok = may_link(ratio, np.full(len(place[mine]), open_[3]), place[mine])
                    group = (open_[5] + np.arange(len(ok))) // PART
                    stars.append((np.full(int(ok.sum()), open_[2]), node[mine][ok], group[ok]))
                    wide.append((sig[mine], node[mine], place[mine]))
                    open_ = (*open_[:4], int(node[k - 1]), open_[5] + len(ok))
                    sig, part, node, place = (x[k:] for x in (sig, part, node, place))
                if len(sig) or last:
                    open_ = None
            if len(sig):
                starts = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])]))
                runs = np.diff(np.append(starts, len(sig)))
                if not last:
                    if runs[-1] > 8:  # a long list goes on as an open one
                        at = starts[-1]
                        open_ = (int(sig[at]), int(part[at]), int(node[at]), int(place[at]), int(node[-1]), int(runs[-1]))
                    else:
                        rest = [x[starts[-1] :] for x in (sig, part, node, place)]
                        sig, part, node, place = (x[: starts[-1]] for x in (sig, part, node, place))
                        starts, runs = starts[:-1], runs[:-1]
                size, pivot = np.repeat(runs, runs), np.repeat(starts, runs)
                here = np.arange(len(sig))
                few = (size <= 3) & (part < 0)
                for i, j in ((pivot, here), (here[:-1], here[1:])):  # with the first member; with the one before, in threes
                    if len(i) == len(here):
                        pick = i < j
                    else:
                        pick = (pivot[i] == pivot[j]) & (i > pivot[i]) & few[j]
                    i, j = i[pick], j[pick]
                    ok = may_link(ratio, place[i], place[j])
                    i, j = i[ok], j[ok]
                    some = few[j]
                    pairs.append((node[i[some]], node[j[some]]))
                    i, j = i[~some], j[~some]
                    stars.append((node[i], node[j], (j - pivot[j]) // PART))
                wide.append((sig[~few], node[~few], place[~few]))
                heads = starts[part[starts] >= 0]
                if len(heads):
                    yield of(3, sig[heads], node[heads], place[heads])
            if pairs:
                low, high = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
                order = np.lexsort((low, high))
                low, high = low[order], high[order]
                new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[: len(low)]
                yield of(0, low[new], high[new])
            if stars:
                low, high, group = (np.concatenate([p[k] for p in stars]) for k in (0, 1, 2))
                order = np.lexsort((group, low, high))
                # of a node's pivots the least is met
                first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])[: len(order)]]
                yield of(2, low[first], high[first], part=group[first])
            if wide:
                yield of(1, *[np.concatenate([w[k] for w in wide]) for k in (0, 1, 2)])

        def flush(last: bool):
            columns = [np.concatenate([rest[k], *[h[k] for h in held]]) for k in range(4)]
            yield from work(*columns, last)

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            rows += batch.num_rows
            if rows >= BUFFER:
                yield from flush(False)
                held, rows = [], 0
        yield from flush(True)

    return run


def _meet_all(ratio: Ratio, nearest: bool):
    """Over rows (sig, cell, side, node, place, label, mark) by (sig, cell): pairs of different labels that can still link.

    They can if the lists' places and the marks' distance leave room for the
    overlap; marks of sets that differ too much tell so without the sets. Rows
    are (node, node, distance of marks, a number of the cell); with ``nearest`` each node is given the
    nearest of a cell only, once as a of its row. A cell holds one block of a list, or two that meet each other; its size is
    bounded by the blocks'.
    """

    def cell(side, node, place, label, mark):
        left = np.flatnonzero(side != 2)
        right = np.flatnonzero(side != 1)
        for k in range(0, len(left), 512):
            i = left[k : k + 512]
            grid = (label[i][:, None] != label[right][None, :]) & may_link(ratio, place[i][:, None], place[right][None, :])
            x, y = np.nonzero(grid)
            x, y = i[x], right[y]
            far = distances(mark, x, y)
            n, m = place[x] >> 32, place[y] >> 32
            fits = far <= n + m - 2 * ratio.overlap(n, m)
            x, y, far = x[fits], y[fits], far[fits]
            if not nearest:
                yield np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), far
            else:
                for u, v in ((x, y), (y, x)):
                    order = np.lexsort((node[v], far, u))
                    first = order[np.concatenate([[True], u[order][1:] != u[order][:-1]])[: len(order)]]
                    yield node[u[first]], node[v[first]], far[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(columns, last):
            sig, cell_no = columns[0], columns[1]
            cuts = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (cell_no[1:] != cell_no[:-1]), [True]])) if len(sig) else np.zeros(1, int)
            made = []
            for a, b in zip(cuts[:-1], cuts[1:] if last else cuts[1:-1]):
                number = int(mix(sig[a : a + 1].view(np.uint64) + _U(cell_no[a]))[0] >> _U(33))
                made += [(*found, np.full(len(found[0]), number)) for found in cell(*[c[a:b] for c in columns[2:]])]
            kept = None if last or len(cuts) < 2 else [c[cuts[-2] :] for c in columns]
            if made:
                a, b, far, part = (np.concatenate([m[k] for m in made]) for k in range(4))
                order = np.lexsort((part, far, b, a))
                new = order[np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(order)]]
                return kept, _batch(a=a[new], b=b[new], far=far[new], part=part[new].astype(np.int32))
            return kept, None

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            marks = np.empty(batch.num_rows, object)
            marks[:] = batch.column(6).to_pylist()
            new.append(marks)
            columns = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            rest, made = out(columns, False)
            if made is not None:
                yield made
        if rest is not None:
            _, made = out(rest, True)
            if made is not None:
                yield made

    return run


def _slot(key, bits: int):
    return mix(np.asarray(key, np.int64).view(np.uint64)) & _U(bits - 1)


def _filter_bits(keys: DataFrame, n: int) -> np.ndarray:
    """A bitmap over n keys, of bounded size at any number of them."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_EACH - 1).bit_length()))

    def run(batches):
        mine = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(mine, (slot >> _U(3)).astype(np.int64), (1 << (slot & _U(7)).astype(np.uint8)).astype(np.uint8))
        words = mine.view(np.int64)
        at = np.flatnonzero(words)
        yield _batch(at=at.astype(np.int64), bits=words[at])

    found = keys.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _held(bits):
    """(key, text) of the rows whose key the filter may hold, each key once a task."""

    def run(batches):
        seen, mine = set(), bits.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            slot = _slot(keys, len(mine) * 8)
            maybe = np.flatnonzero((mine[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1)
            pick = [k for k in maybe.tolist() if not (keys[k] in seen or seen.add(keys[k]))]
            if pick:
                yield batch.take(pa.array(pick, pa.int64()))
            if len(seen) > COUNTED:
                seen = set()

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _asked(pairs: DataFrame, known: DataFrame, *names: str) -> DataFrame:
    """What is known of a, once for each part with b null, and of b for each pair."""
    firsts = pairs.select("a", "part").distinct().withColumn("b", F.lit(None).cast("long")).join(known, F.col("a") == F.col("node"))
    return firsts.select("a", "part", "b", *names).unionByName(pairs.join(known, F.col("b") == F.col("node")).select("a", "part", "b", *names))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())


def _near(ratio: Ratio):
    """(a, b, part) of nodes whose marks leave room for a link, over rows (a, part, null, size, mark of a) and then (a, part, b, size, mark of b)."""

    def run(batches):
        pivot, size, mine = None, 0, b""
        for batch in batches:
            low, high, parts = [], [], []
            for a, part, b, n, mark in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if b is None:
                    pivot, size, mine = (a, part), n, mark
                elif pivot != (a, part):
                    raise RuntimeError("a pair without its pivot")
                else:
                    w = min(len(mine), len(mark))
                    if int(np.bitwise_count(folded(mine, w) ^ folded(mark, w)).sum()) <= n + size - 2 * ratio.overlap(n, size):
                        low.append(a)
                        high.append(b)
                        parts.append(part)
            if low:
                yield _batch(a=pa.array(low, pa.int64()), b=pa.array(high, pa.int64()), part=pa.array(parts, pa.int32()))

    return run


def _verify(size: int, ratio: Ratio):
    """(a, b) of linked nodes, over rows (a, part, null, text of a) and then (a, part, b, text of b)."""

    def run(batches):
        shingler, pivot, mine = Shingler(size), None, np.empty(0, np.uint64)
        for batch in batches:
            a, part, b = (batch.column(k).to_pylist() for k in range(3))
            low, high = [], []
            for k, s in enumerate(shingler.sets(batch.column(3))):
                if b[k] is None:
                    pivot, mine = (a[k], part[k]), s
                elif pivot != (a[k], part[k]):
                    raise RuntimeError("a pair without its pivot")
                elif len(np.intersect1d(mine, s, assume_unique=True)) >= ratio.overlap(len(mine), len(s)):
                    low.append(a[k])
                    high.append(b[k])
            if low:
                yield _batch(a=pa.array(low, pa.int64()), b=pa.array(high, pa.int64()))

    return run


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the given texts' keys nk, which are written; other texts travel only if the filter takes them for one of these."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(keys.select("nk"), keys.count()))
    return docs.select("key", "text").mapInArrow(_held(bits), "key long, text string").groupBy("key").agg(F.first("text").alias("text"))


def _linked(docs: DataFrame, rows: DataFrame, pairs: DataFrame, size: int, ratio: Ratio) -> DataFrame:
    """The pairs (a, b, part) that link, from whole texts: a's goes once to each of its parts, b's once to each pair."""
    # combined before the exchange: a node of many copies is no task's
    least = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("nk"))
    keys = materialise(least.join(_ends(pairs).withColumnRenamed("node", "wanted"), F.col("node") == F.col("wanted")).select("node", "nk"), "join-keys")
    whole = _asked(pairs, keys, "nk").join(_texts(docs, keys), F.col("nk") == F.col("key")).select("a", "part", "b", "text")
    return materialise(_dealt(whole).mapInArrow(_verify(size, ratio), "a long, b long"), "join-links")


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges and the least node they reach, but for the least nodes themselves."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, up = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        x, y = up[u], up[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]
    low = np.flatnonzero(up != np.arange(len(up)))
    return names[low], names[up[low]]


def _contract(batches):
    """Edges contracted by HELD of them, and those of a task again as long as that makes them much fewer."""
    held, rows = [], 0

    def out(parts):
        return contract(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))

    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        rows += batch.num_rows
        if rows > HELD:
            held = [out(held)]
            rows = len(held[0][0])
            if rows > HELD // 2:
                yield _batch(u=held[0][0], v=held[0][1])
                held, rows = [], 0
    if rows:
        u, v = out(held)
        yield _batch(u=u, v=v)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of links (a, b): each linked node and the least node reachable from it.

    Edges are contracted within tasks, then alternating stars: every node's
    larger neighbours, then its smaller ones, are hung on its least neighbour,
    until all edges are stars. No neighbourhood is gathered: least neighbours
    are aggregates, and the rows are told them without being dealt by node.
    """

    def hung(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if larger:
            both = both.unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("lx"), F.least("m", "x").alias("m"))
        rows = _told(both, "x", materialise(least, "join-least"), "lx", "y")
        if larger:
            out = rows.where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
        else:
            out = rows.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(rows.select(F.col("x").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def stars(e: DataFrame) -> bool:
        """Whether every node hangs on one node, and none hangs on a node that hangs."""
        none = F.lit(None).cast("long")
        ends = e.select(F.col("u").alias("x"), F.col("v").alias("on"), F.lit(0).alias("top")).unionByName(e.select(F.col("v").alias("x"), none.alias("on"), F.lit(1).alias("top")))
        state = ends.groupBy("x").agg(F.min("on").alias("low"), F.max("on").alias("high"), F.max("top").alias("top"))
        return state.where("low <> high or (low is not null and top = 1)").isEmpty()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    for _ in range(rounds):
        edges = materialise(edges.mapInArrow(_contract, "u long, v long"), "join-edges")
        if stars(edges):
            break
        edges = hung(materialise(hung(edges, True), "join-hung"), False)
    else:
        raise RuntimeError("components did not settle")
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


#: Keys at most whose rows are told of them by broadcast; beyond, each key's rows are dealt to so many parts.
TOLD, SALTS = 1_000_000, 32


def _told(rows: DataFrame, key: str, groups: DataFrame, group: str, by: str = "node", how: str = "inner") -> DataFrame:
    """rows with what is known of their key in ``groups``, written rows of distinct keys: no key, however frequent, is one
    task's, as a key's rows are told apart ``by`` another column."""
    if groups.count() <= TOLD:
        return rows.join(F.broadcast(groups), F.col(key) == F.col(group), how)
    groups = groups.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(groups, (F.col(key) == F.col(group)) & (F.col("salt") == F.col("t")), how).drop("salt", "t")


def _apart(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, place, label, mine, blocks): rows of the lists that hold members of different components."""
    named = wide.join(labels.select(F.col("node").alias("ln"), "label"), F.col("node") == F.col("ln"), "left").select("sig", "node", "place", F.coalesce("label", "node").alias("label"))
    lists = named.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
    lists = materialise(lists.select(F.col("sig").alias("s"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "join-lists")
    again = _told(named, "sig", lists, "s")
    return again.select("sig", "node", "place", "label", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"), "blocks")


def _cells(rows: DataFrame, group: str, *names: str) -> DataFrame:
    """(group, cell, side, names): each row in the cells where its block, mine of blocks, meets itself (side 0) or another (1 or 2)."""
    cells = rows.select(group, *names, "mine", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return cells.select(
        group,
        (F.least("mine", "other").cast("long") * F.col("blocks") + F.greatest("mine", "other")).alias("cell"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        *names,
    )


def _met(again: DataFrame, marks: DataFrame, ratio: Ratio, nearest: bool) -> DataFrame:
    """(a, b, part): pairs of different labels in the same list that can still link; with ``nearest`` one for each node."""
    marked = again.join(marks.select(F.col("node").alias("mn"), "mark"), F.col("node") == F.col("mn"))
    cells = _cells(marked, "sig", "node", "place", "label", "mark")
    met = cells.repartition("sig", "cell").sortWithinPartitions("sig", "cell", "side", "node").mapInArrow(_meet_all(ratio, nearest), "a long, b long, far long, part int")
    if nearest:
        met = met.groupBy("a").agg(F.min(F.struct("far", "b", "part")).alias("s")).select("a", "s.b", "s.part")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("part").alias("part"))


def _heaviest(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """(a, n) of the largest counts, at most ``most`` of them: those above the step of n from which on there are no more."""
    step = F.floor(F.log2(F.col("n")) * 16).cast("int")
    steps = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for k, n in steps:
        total += n
        if total > most:
            break
        least = k
    return [] if least is None else [(r["a"], r["n"]) for r in counts.where(step >= least).collect()]


def _meetings(docs: DataFrame, size: int, ratio: Ratio) -> tuple[DataFrame, ...]:
    """(rows with their nodes, meetings) of docs (doc_id, key, text)."""
    profile = materialise(docs.mapInArrow(_profile(size), PROFILE), "join-profile")
    rows = profile.where("kind = 0").select(F.col("a").alias("doc_id"), "key", F.col("b").alias("n_shingles"), F.col("c").alias("node"), "mark")
    rows._pagegauge_path = profile._pagegauge_path
    counts = profile.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where("n >= 16")
    heavy = _heaviest(materialise(counts, "join-counts"), HEAVY)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    limit = boundary(1 + sum(c * c for _, c in heavy) / max(1, total), ratio)
    postings = docs.select("text").mapInArrow(_postings(size, heavy, limit, ratio), POSTINGS)

    def lists(postings: DataFrame, name: str) -> DataFrame:
        by = postings.repartition("sig", "part").sortWithinPartitions("sig", "part", "node", "place")
        return materialise(by.mapInArrow(_meet_pivots(ratio), MEETINGS), name)

    met = lists(postings, "join-meetings")
    # the pivots of a list's parts meet as a list of their own
    pivots = met.where("kind = 3").select(F.col("a").alias("sig"), F.lit(-1).alias("part"), F.col("b").alias("node"), F.col("c").alias("place"))
    if any(c > PART for _, c in heavy):
        met = met.where("kind <> 3").unionByName(lists(pivots, "join-pivots").where("kind in (0, 2)"))
    return rows, met


def _marks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, mark) of the given distinct nodes, of which each task has marked one row at most."""
    wanted = nodes.select(F.col("node").alias("wanted"))
    marked = rows.where("mark is not null").join(wanted, F.col("node") == F.col("wanted"))
    return marked.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("mark").alias("mark"))


def _wide(met: DataFrame) -> DataFrame:
    return met.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node"), F.col("c").alias("place"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(text).alias("key"), text.alias("text"))


def key_of(text: Column) -> Column:
    """A text's key, by which rows and their texts are told: a null text has an empty one's."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _labels(docs: DataFrame, size: int, ratio: Ratio) -> tuple[DataFrame, DataFrame]:
    """(rows with their nodes, labels of linked nodes) of docs (doc_id, key, text), both written."""
    with scratch(docs.sparkSession) as keep:
        rows, met = _meetings(docs, size, ratio)
        keep(rows)
        star = met.where("kind = 2").groupBy("b").agg(F.min(F.struct("a", "part")).alias("s")).select("s.a", "b", "s.part")
        pairs = met.where("kind = 0").select("a", "b", "part").unionByName(star).groupBy("a", "b").agg(F.min("part").alias("part"))
        pairs = materialise(pairs, "join-pairs")
        marks = _marks(rows, _ends(pairs))
        near = materialise(_dealt(_asked(pairs, marks, "n", "mark")).mapInArrow(_near(ratio), "a long, b long, part int"), "join-near")
        labels = materialise(components(_linked(docs, rows, near, size, ratio)), "join-labels")
        # lists whose members are still apart: each member meets its nearest, then all meet all
        for nearest in (True, False):
            again = materialise(_apart(_wide(met), labels), "join-apart")
            if again.isEmpty():
                break
            more = materialise(_met(again, _marks(rows, again.select("node").distinct()), ratio, nearest), "join-pairs")
            found = _linked(docs, rows, more, size, ratio)
            if not found.isEmpty():
                known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
                labels = materialise(components(known.unionByName(found)), "join-labels")
        keep(labels)
    return rows, labels


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set on the left with each on the right, from tables of bits of COLUMNS shingles at a time."""
    flat = [np.concatenate(sets) for sets in (left, right)]
    if left is right:
        common, counts = np.unique(flat[0], return_counts=True)
        common = common[counts > 1]
    else:
        common = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(common):
        return out
    ones = []
    for sets, values in zip((left, right), flat, strict=True):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        found = np.flatnonzero(common[at] == values)
        found = found[np.argsort(at[found], kind="stable")]
        ones.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[found], at[found]))
    for start in range(0, len(common), COLUMNS):
        width = -(-min(COLUMNS, len(common) - start) // 64) * 64
        tables = []
        for sets, (row, column) in zip((left, right), ones, strict=True):
            some = slice(*np.searchsorted(column, [start, start + width]))
            table = np.zeros((len(sets), width), bool)
            table[row[some], column[some] - start] = True
            tables.append(np.packbits(table, axis=1).view(np.uint64))
        for k, bits in enumerate(tables[0]):
            out[k] += np.bitwise_count(bits & tables[1]).sum(axis=1, dtype=np.int64)
    return out


def _count_within(size: int, ratio: Ratio):
    """(node, near) over rows (label, cell, side, node, copies, text) by (label, cell): copies of the cell's nodes that a node
    links to, from whole texts. A cell holds one block of a component, or two that meet."""

    def near(held: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = [h for h in held if h[0] != 2], [h for h in held if h[0] != 1]
        if not left or not right:
            return
        one = len(left) == len(held)
        sets = [h[3] for h in left]
        found = overlaps(sets, sets if one else [h[3] for h in right])
        n, m = (np.array([len(h[3]) for h in side]) for side in (left, right))
        linked = found >= ratio.overlap(n[:, None], m[None, :])
        u, v = (np.array([h[1] for h in side], np.int64) for side in (left, right))
        x, y = (np.array([h[2] for h in side], np.int64) for side in (left, right))
        if one:
            np.fill_diagonal(linked, False)
        yield u, (linked * y).sum(axis=1)
        if not one:
            yield v, (linked * x[:, None]).sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cell, held = Shingler(size), None, []
        for batch in batches:
            made = []
            label, number, side, node, copies = (batch.column(k).to_pylist() for k in range(5))
            for k, s in enumerate(shingler.sets(batch.column(5))):
                if cell != (label[k], number[k]):
                    made += near(held)
                    cell, held = (label[k], number[k]), []
                held.append((side[k], node[k], copies[k], s))
            if made:
                yield _batch(node=np.concatenate([u for u, _ in made]), near=np.concatenate([n for _, n in made]))
        for u, n in near(held):
            yield _batch(node=u, near=n)

    return run


def _within(docs: DataFrame, rows: DataFrame, labels: DataFrame, size: int, ratio: Ratio) -> DataFrame:
    """(node, near), written: the rows of other nodes that a linked node links to.

    Both ends of a link are in one component, so only a component's nodes meet: a
    pair is a link, larger ones are cut into blocks by their nodes and shingles, of
    which each two meet in a task of their own. A text goes once to each of its
    component's blocks, and no pair is a row.
    """
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("nk"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    members = nodes.join(labels.select(F.col("node").alias("ln"), "label"), F.col("node") == F.col("ln")).drop("ln")
    members = materialise(members, "join-members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)).cast("int")
    groups = members.groupBy(F.col("label").alias("gl")).agg(F.count(F.lit(1)).alias("members"), F.sum("copies").alias("whole"), blocks.alias("blocks"))
    told = materialise(_told(members, "label", materialise(groups, "join-groups"), "gl"), "join-told")
    pairs = told.where("members = 2").select("node", (F.col("whole") - F.col("copies")).alias("near"))
    large = told.where("members > 2").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = _cells(large.join(_texts(docs, large), F.col("nk") == F.col("key")), "label", "node", "copies", "text")
    dealt = cells.repartition("label", "cell").sortWithinPartitions("label", "cell", "side")
    counted = dealt.mapInArrow(_count_within(size, ratio), "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))
    return materialise(pairs.unionByName(counted), "join-near")


def _named(rows: DataFrame, labels: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """doc_id, key, n_shingles, component_id, node, label and, given the linked nodes' ``near``, n_links of each row."""
    # the least id of each node, then of each component; nodes without links are their own
    least = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    known = least.join(labels.select(F.col("node").alias("ln"), "label"), F.col("node") == F.col("ln"), "left")
    links = F.col("copies") - 1
    if near is not None:
        known = known.join(near.select(F.col("node").alias("nn"), "near"), F.col("node") == F.col("nn"), "left")
        links = links + F.coalesce("near", F.lit(0))
    known = known.select("node", F.coalesce("label", "node").alias("label"), F.col("ln").isNotNull().alias("linked"), "least", "copies", links.alias("links"))
    known = known.where("linked or copies > 1")
    whole = known.groupBy("label").agg(F.min("least").alias("component"))
    final = known.join(whole.withColumnRenamed("label", "wl"), F.col("label") == F.col("wl")).select(F.col("node").alias("fn"), "label", "component", "links")
    named = _told(rows, "node", materialise(final, "join-named"), "fn", "doc_id", "left")
    out = ["doc_id", "key", "n_shingles", "node", "label", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("component")).alias("component_id")]
    return named.select(*out, *([] if near is None else [F.coalesce("links", F.lit(0)).cast("long").alias("n_links")]))


def classes(docs: DataFrame, size: int = 5, ratio: Ratio = Ratio(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links, its own included).

    A link: ratio.den * intersection >= ratio.num * union of the sets of
    shingles (``size`` words, A-Z folded; the whole text if shorter). Texts
    that are null, empty or without words have no shingles and no links.
    Repeated rows share a component. Null ids have a row each and count for
    no component's least id. An empty table gives an empty result.
    """
    return _named(*_labels(_keyed(docs, id_col, text_col), size, ratio)).select("doc_id", "n_shingles", "component_id")


def link_counts(docs: DataFrame, size: int = 5, ratio: Ratio = Ratio(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """classes() and n_links: the other rows that a row links to, rows with an equal set among them; 0 without shingles.

    Links are counted after components are known, block by block within each: the
    square of a component's number of different sets, in operations on bits, where
    classes() costs about the number.
    """
    docs = _keyed(docs, id_col, text_col)
    rows, labels = _labels(docs, size, ratio)
    with scratch(docs.sparkSession) as keep:
        near = keep(_within(docs, rows, labels, size, ratio))
    return _named(rows, labels, near).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, size: int = 5, ratio: Ratio = Ratio(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: one row of each component stays, that of the least id, of equal ids that of the least
    text key; a null id comes last.

    Rows equal in id and text are told by their other columns, and one stays.
    Rows without words belong to no component and all stay. An empty table
    gives an empty result. Any further column passes, whatever its name.
    """
    names = docs.columns
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows, labels = _labels(_keyed(docs, id_col, text_col), size, ratio)
        named = _named(rows, labels).where("label is not null")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        first = named.groupBy("label").agg(F.min(order).alias("first")).select(F.col("label").alias("fl"), "first")
        fates = named.join(first, F.col("label") == F.col("fl")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max((order == F.col("first")).cast("int")).alias("stays"))
        # rows not named here are their component's only one
        fates = keep(materialise(fates.where("stays = 0 or n > 1").select("doc_id", "key", "stays"), "join-fates"))
    key, f_id, f_key, stays, row, rank = unused(names, "key", "fate_id", "fate_key", "stays", "row", "rank")
    fates = joinable(fates).select(F.col("doc_id").alias(f_id), F.col("key").alias(f_key), F.col("stays").alias(stays))
    keyed = docs.withColumn(key, key_of(F.col(text_col).cast("string")))
    told = keyed.join(fates, F.col(id_col).cast("long").eqNullSafe(F.col(f_id)) & (F.col(key) == F.col(f_key)), "left")
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    several = told.where(F.col(stays) == 1).groupBy(f_id, f_key).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return told.where(F.col(stays).isNull()).select(*[f"`{c}`" for c in names]).unionByName(several.select(*[F.col(f"{row}.`{c}`") for c in names]))
