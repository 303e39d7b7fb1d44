"""Quality rules: document statistics, and decision lists learned from labelled statistics.

Statistics and verdicts are DataFrame expressions throughout. Only the learner
runs on the driver, over at most ``sample_rows`` labelled rows of numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, let, materialise, sampled

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in this text.

    Windows are compared by 64-bit hashes of their words. Texts without a
    repeated window stop after one hash set; the rest sort (hash, place), keep
    places whose neighbour has the same hash and add up the covered words.
    """

    def covered(hashes: Column) -> Column:
        dealt = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))
            marked = F.transform(s, lambda e, k: F.when(twin(e, k), e["i"]).otherwise(F.lit(-1)))
            return F.sort_array(F.filter(marked, lambda i: i >= 0))

        def span(q: Column) -> Column:
            after = F.slice(F.concat(q, F.array(F.element_at(q, -1) + WINDOW)), F.lit(2), F.size(q))
            steps = F.zip_with(q, after, lambda a, b: F.least(F.lit(WINDOW), b - a))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

        return let(let(dealt, places), span)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return of(words)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the BASE statistics (long) and n_upper, n_marks, n_lines, n_chars (long).

    A null or empty text has zeros throughout. Repeated rows stay repeated, null
    ids are kept, and texts of any length are counted whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = lambda chars: F.length("__t") - F.length(F.translate("__t", chars, ""))
    lines = F.transform(F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x))
    words = F.regexp_extract_all("__t", F.lit(WORD), F.lit(0))
    out = df.select(F.col(id_col).alias(id_col), text.alias("__t")).select(
        id_col,
        let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("__w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("__l"),
        F.length("__t").alias("n_chars"),
        F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        counted(SYMBOLS).alias("n_symbols"),
        counted("!").alias("n_marks"),
        F.regexp_count("__t", F.lit(r"\p{Lu}")).alias("n_upper"),
    )
    return out.select(
        id_col,
        F.col("__w.n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.col("__l.n") - F.col("__l.d")).cast("long").alias("n_dup_lines"),
        F.col("__w.r").cast("long").alias("n_repeat_words"),
        F.col("n_upper").cast("long").alias("n_upper"),
        F.col("n_marks").cast("long").alias("n_marks"),
        F.col("__l.n").cast("long").alias("n_lines"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )


#: Rates that rules may test: name -> (numerator, denominator); a zero denominator counts as 1.
RATES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "chars_per_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def rates() -> list[Column]:
    return [(F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")).alias(name) for name, (a, b) in RATES.items()]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold); a row that meets it is rejected."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.tests:
            out = out & ((F.col(name) <= F.lit(at)) if op == "<=" else (F.col(name) > F.lit(at)))
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class DecisionList:
    """Ordered rejecting rules; what none of them meets is kept."""

    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        """true: kept. The first rule that a row meets decides."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def rule_number(self) -> Column:
        """The number, from 1, of the rule that rejects a row; 0 for a kept one."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _holds(tests, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, op, at in tests:
        out &= (x[name] <= at) if op == "<=" else (x[name] > at)
    return out


def _cuts(v: np.ndarray, most: int) -> np.ndarray:
    u = np.unique(v)
    if len(u) > most:
        u = np.unique(np.quantile(u, np.linspace(0, 1, most), method="nearest"))
    return (u[:-1] + u[1:]) / 2


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_tests: int = 3, min_precision: float = 0.9, min_covered: int = 8, max_cuts: int = 64, seed: int = 7) -> DecisionList:
    """Sequential covering over rejected (bad) and kept rows.

    Two thirds of the uncovered rows grow a rule, test by test, by information
    gain for the bad class; the last third prunes final tests while that does
    not lower (bad - good) / covered. A rule stays if, over all rows still
    uncovered, its precision and cover reach the limits; learning ends with the
    first that does not.
    """
    n, names, rng = len(bad), sorted(x), np.random.default_rng(seed)
    left, rules = np.ones(n, bool), []
    cuts = {name: _cuts(x[name], max_cuts) for name in names} if n else {}
    while len(rules) < max_rules and (bad & left).sum() >= min_covered:
        grow = left & (rng.random(n) < 2 / 3)
        prune = left & ~grow
        tests, now = [], grow.copy()
        while len(tests) < max_tests:
            p0, n0 = (now & bad).sum(), now.sum()
            if not p0 or p0 == n0:
                break
            best = (0.0, None)
            for name in names:
                v, b = x[name][now], bad[now]
                order = np.argsort(v, kind="stable")
                v, pos = v[order], np.cumsum(b[order])
                k = np.searchsorted(v, cuts[name], side="right")
                for op, p, m in (("<=", np.where(k > 0, pos[np.maximum(k - 1, 0)], 0), k), (">", pos[-1] - np.where(k > 0, pos[np.maximum(k - 1, 0)], 0), len(v) - k)):
                    ok = (p >= min_covered / 2) & (m < n0)
                    if not ok.any():
                        continue
                    gain = np.where(ok, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(m, 1)) - np.log2(p0 / n0)), 0)
                    j = int(np.argmax(gain))
                    if gain[j] > best[0] + 1e-9:
                        best = (float(gain[j]), (name, op, float(cuts[name][j])))
            if best[1] is None:
                break
            tests.append(best[1])
            now = now & _holds([best[1]], x, n)
        if not tests:
            break

        def worth(t):
            c = prune & _holds(t, x, n)
            return ((c & bad).sum() - (c & ~bad).sum()) / max(1, c.sum())

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        met = left & _holds(tests, x, n)
        precision = (met & bad).sum() / max(1, met.sum())
        if met.sum() < min_covered or precision < min_precision:
            break
        rules.append(Rule(tuple(tests), round(float(precision), 4), int(met.sum())))
        left &= ~met
    return DecisionList(tuple(rules))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = 20_000, **options) -> DecisionList:
    """A decision list from labelled statistics (label 0: reject).

    Reads at most ``sample_rows`` labelled ids, chosen by hash, and of their
    distinct rows as many again: a bound that keeps what reaches the driver the
    same at any corpus size. Null labels are left out, ids with more than one
    label count with their least. Without labelled rows the list is empty and
    keeps everything.
    """
    features = [*RATES, "n_words", "n_lines"]
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("label"))
    known = materialise(sampled(materialise(known, "quality-labels"), sample_rows, "label_id"), "quality-sample")
    numbers = stats.select(F.col(id_col).alias("row_id"), *[F.col(c).cast("double").alias(c) for c in ("n_words", "n_lines")], *rates())
    met = numbers.join(F.broadcast(known), F.col("row_id") == F.col("label_id")).select("row_id", "label", *features).distinct()
    rows = sampled(materialise(met, "quality-rows"), sample_rows, "row_id", *features).orderBy(F.xxhash64("row_id"), "row_id", *features).collect()
    y = np.array([r["label"] == 0 for r in rows], bool)
    return learn({c: np.array([r[c] for r in rows], float) for c in features}, y, **options)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(stats: DataFrame, rules: DecisionList, id_col: str = "doc_id") -> DataFrame:
    """stats with base_failed, kept (false if base_failed, else the list's verdict) and rule_number.

    Every row has a verdict, repeated ones the same, null ids too; an empty
    list of rules keeps what does not fail, and an empty table stays empty.
    """
    names = stats.columns
    wide = stats.select("*", *rates())
    return wide.select(*names, base_failed().alias("base_failed"), (~base_failed() & rules.verdict()).alias("kept"), rules.rule_number().alias("rule_number"))
