"""Toxicity: a chain of linear classifiers, each fed the probabilities of those before it.

Later models are trained on out-of-fold probabilities of the earlier ones, so
that they meet at scoring what they met in training. Words and their beginnings are hashed to
buckets, vectorised over Arrow columns; a model looks at a bounded number of
chosen buckets, so scoring a text of any length touches its words once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, sampled, unused
from .textcore import MARKS, Shingler, WordHasher, pieces, utf8

SLOTS = 18
#: Probability of the last category from which a document is rejected.
THRESHOLD = 0.35
#: Earlier categories: so many kinds of toxic documents, found among the labelled ones by the words that tell them.
CATEGORIES = ("kind_1", "kind_2")
LAST = "toxic"
#: Labelled rows that training reads at most, and buckets that a model looks at at most.
SAMPLE_ROWS, FEATURES, FOLDS = 8_000, 512, 5
#: Slots of a labelled row that training reads at most, the least ones.
MOST_SLOTS = 8_192
#: Bytes of words' beginnings that count as features beside the words, for what only shows with its endings left off.
PREFIXES = (4, 5, 6, 7, 8, 9)


def _hasher() -> WordHasher:
    return WordHasher(between=MARKS, prefixes=PREFIXES)


def slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOTS)).astype(np.int64)


def slot_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(slots(_hasher().words(data, np.array([0, len(data)]))[0])[0])


@dataclass(frozen=True)
class Link:
    """One classifier: chosen slots, their weights, those of the earlier categories' probabilities, and the bias."""

    name: str
    slots: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass(frozen=True)
class Chain:
    links: tuple[Link, ...]

    @property
    def names(self) -> list[str]:
        return [x.name for x in self.links]

    def scorer(self):
        """A function from a string column to (rows, categories) probabilities."""
        chosen = np.unique(np.concatenate([x.slots for x in self.links])) if self.links else np.empty(0, np.int64)
        place = np.full(1 << SLOTS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        weights = np.zeros((len(self.links), len(chosen)))
        for k, x in enumerate(self.links):
            weights[k, place[x.slots]] = x.weights
        hasher = _hasher()

        def score(texts: pa.Array) -> np.ndarray:
            parts = [some(part) for part in pieces(texts)]
            return np.concatenate(parts) if parts else np.zeros((0, len(self.links)))

        def some(texts: pa.Array) -> np.ndarray:
            data, offsets = utf8(texts)
            words, first = hasher.words(data, offsets)
            at = place[slots(words)]
            hit = np.flatnonzero(at >= 0)
            row = np.searchsorted(first, hit, side="right") - 1
            both = np.unique(row * max(1, len(chosen)) + at[hit])
            row, feature = both // max(1, len(chosen)), both % max(1, len(chosen))
            out = np.zeros((len(offsets) - 1, len(self.links)))
            for k, x in enumerate(self.links):
                z = np.bincount(row, weights[k, feature], minlength=len(out)) + x.bias + out[:, :k] @ x.earlier
                out[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            return out

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def _choose(rows: Sequence[np.ndarray], y: np.ndarray, most: int, least_odds: float = 2.5, least_rows: int = 3) -> np.ndarray:
    """The slots that stand out most in positive rows, by the z score of their log odds.

    A slot is in at least ``least_rows`` positive rows and its log odds are at
    least ``least_odds``: how much it tells, which does not change with the
    number of labels as the z score does. The ridge holds what is noise.
    """
    n1, n0 = y.sum(), (~y).sum()
    if not n1 or not n0:
        return np.empty(0, np.int64)

    def count(pick: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << SLOTS)
        for k in np.flatnonzero(pick):
            out[rows[k]] += 1  # a row's slots are distinct
        return out

    a, b = count(y) + 0.5, count(~y) + 0.5
    odds = np.log(a / (n1 + 1 - a) * (n0 + 1 - b) / b)
    able = np.flatnonzero((odds >= least_odds) & (a > least_rows))
    z = odds[able] / np.sqrt(1 / a[able] + 1 / b[able])
    return np.sort(able[np.argsort(-z, kind="stable")[:most]])


def train(rows: Sequence[np.ndarray], labels: dict[str, np.ndarray], most: int = FEATURES, folds: int = FOLDS) -> Chain:
    """A chain over labels in their order; rows: distinct slots of each document. Row k is in fold k modulo folds."""
    n, links, known = len(rows), [], np.zeros((len(rows), 0))
    fold = np.arange(n) % folds
    for name, y in labels.items():
        def fit(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            chosen = _choose([rows[k] for k in np.flatnonzero(pick)], y[pick], most)
            return chosen, _logistic(np.concatenate([matrix(chosen, pick), known[pick]], axis=1), y[pick].astype(float))

        def matrix(chosen: np.ndarray, pick: np.ndarray) -> np.ndarray:
            return np.array([np.isin(chosen, rows[k], assume_unique=True) for k in np.flatnonzero(pick)], float).reshape(int(pick.sum()), len(chosen))

        outside = np.zeros(n)
        for f in range(folds):
            held = fold == f
            if held.any() and (~held).any():
                chosen, w = fit(~held)
                z = np.concatenate([matrix(chosen, held), known[held]], axis=1) @ w[:-1] + w[-1]
                outside[held] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if n:
            chosen, w = fit(np.ones(n, bool))
            links.append(Link(name, chosen, w[: len(chosen)], w[len(chosen) : -1], float(w[-1])))
        known = np.concatenate([known, outside[:, None]], axis=1)
    return Chain(tuple(links))


def kinds(rows: Sequence[np.ndarray], toxic: np.ndarray, most: int = FEATURES, rounds: int = 20) -> dict[str, np.ndarray]:
    """The earlier categories: toxic rows parted by the telling slots that stand in them together.

    Directions of the rows over slots chosen for all toxic ones are parted by
    means of directions, from the row nearest to all and those farthest from
    the centres before. Rows without a chosen slot are of no kind.
    """
    out = {name: np.zeros(len(rows), bool) for name in CATEGORIES}
    chosen, at = _choose(rows, toxic, most), np.flatnonzero(toxic)
    x = np.array([np.isin(chosen, rows[k], assume_unique=True) for k in at], float).reshape(len(at), len(chosen))
    some = x.any(axis=1) if len(chosen) else np.zeros(len(at), bool)
    at, x = at[some], x[some]
    if len(at) < len(CATEGORIES):
        return out
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    centres = [x[np.argmax(x @ x.mean(axis=0))]]
    while len(centres) < len(CATEGORIES):
        centres.append(x[np.argmin((x @ np.array(centres).T).max(axis=1))])
    mine = None
    for _ in range(rounds):
        now = np.argmax(x @ np.array(centres).T, axis=1)
        if mine is not None and (now == mine).all():
            break
        mine = now
        for k in range(len(centres)):
            if (mine == k).any():
                mean = x[mine == k].mean(axis=0)
                centres[k] = mean / max(1e-12, float(np.sqrt(mean @ mean)))
    for k, name in enumerate(CATEGORIES):
        out[name][at[mine == k]] = True
    return out


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[np.ndarray], np.ndarray]:
    """(slots of each row, whether it is toxic) of at most ``sample_rows`` labelled ids, and as many distinct texts, chosen by hash.

    Near copies would let a single document's words stand out, so of sampled
    documents with the same least shingle one counts. Null labels are left out,
    ids with several labels count with the largest.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    picked = materialise(sampled(materialise(known, "toxic-labels"), sample_rows, "label_id"), "toxic-sample")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("said")).join(F.broadcast(picked), F.col("id") == F.col("label_id"))
    texts = texts.groupBy("id", "label", F.xxhash64(F.coalesce("said", F.lit(""))).alias("key")).agg(F.first("said").alias("said"))
    texts = sampled(materialise(texts, "toxic-texts"), sample_rows, "id", "key")

    def run(batches):
        hasher, shingler = _hasher(), Shingler()
        for batch in batches:
            found = []
            for part in pieces(batch.column(2)):
                words, first = hasher.words(*utf8(part))
                at = slots(words)
                found += [np.unique(at[a:b])[:MOST_SLOTS].astype(np.int32) for a, b in zip(first[:-1], first[1:])]
            least = [int(s[:1].view(np.int64)[0]) if len(s) else 0 for s in shingler.sets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "least", "slots"])

    # flat arrays, not Python numbers: a few hundred bytes of slots for every kilobyte of sampled text
    rows = texts.select("id", "label", "said").mapInArrow(run, "id long, y int, least long, slots array<int>").toArrow().combine_chunks()
    ids, least, y = (rows.column(c).to_numpy() for c in ("id", "least", "y"))
    lists = rows.column("slots").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    order = np.lexsort((ids, least))
    keep = order[np.concatenate([[True], least[order][1:] != least[order][:-1]])[: len(order)]]
    return [flat[ends[k] : ends[k + 1]] for k in keep], y[keep] > 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """A chain from sample(), a bound on what training reads at any corpus size. Without labelled documents it is empty."""
    found, toxic = sample(docs, labels, sample_rows, id_col, text_col, label_col)
    return train(found, {**kinds(found, toxic), LAST: toxic})


def probabilities(chain: Chain, text: Column) -> Column:
    """array<double>: the categories' probabilities in the chain's order."""
    state: list = []

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        if not state:
            state.append(chain.scorer())
        p = state[0](texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

    return score(text.cast("string"))


def _judged(docs: DataFrame, chain: Chain, threshold: float, text_col: str, p: str, toxic: str) -> DataFrame:
    """docs with columns p (probabilities) and toxic: the last category's probability reaches the threshold.

    Null and empty texts have the chain's bias alone and are not toxic; an empty
    chain finds nothing toxic.
    """
    if not chain.links:
        return docs.withColumn(p, F.array().cast("array<double>")).withColumn(toxic, F.lit(False))
    scored = docs.withColumn(p, probabilities(chain, F.col(text_col)))
    return scored.withColumn(toxic, (F.element_at(p, -1) >= threshold) & (F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0))


def report(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """doc_id, a probability for each category (p_...), and rejected, of every row.

    Repeated rows and null ids keep a row each; null and empty texts are not
    rejected; an empty table gives an empty result; further columns are left out.
    """
    names = chain.names or [*CATEGORIES, LAST]
    rows = _judged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), chain, threshold, "text", "p", "toxic")
    return rows.select("doc_id", *[F.coalesce(F.try_element_at("p", F.lit(k + 1)), F.lit(0.0)).alias(f"p_{n}") for k, n in enumerate(names)], F.col("toxic").alias("rejected"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the chain, fitted to docs and labels, does not reject.

    Repeated rows share a verdict and all stay or go; null and empty texts and
    null ids stay; any further column passes, whatever its name.
    """
    p, toxic = unused(docs.columns, "p", "toxic")
    return _judged(docs, fit(docs, labels), threshold, "text", p, toxic).where(~F.col(toxic)).select(*[f"`{c}`" for c in docs.columns])
