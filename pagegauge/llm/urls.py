"""URL filters: host and path rules, and a ratio of character language models for what no rule decides.

Two smoothed variable-order Markov models, of accepted and of rejected
addresses, score an address by the difference of its log-likelihoods per
character; a threshold calibrated on held-out hosts decides. The models are
tables: every distinct address is counted and every one is scored for the
threshold, and nothing that grows with the corpus is gathered on the driver.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, sampled

#: (host, path, verdict), in the form host/path: a rule fits its host and all subdomains where the path starts so.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Host parts that mark an address as rejected for training. Fixed values.
REJECTED_PARTS = ("ads", "adult", "bet", "bets", "casino", "cheap", "free", "gamble", "loan", "loans", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "win", "xxx")
ORDER, ALPHABET, FOLDS = 5, 256, 5
#: Hosts of a kind under which each is held out alone.
FEW = 20
#: A gram with more than this share of all is heavy and is dealt to so many tasks.
HEAVY_SHARE, SALTS = 1 / 256, 32
#: A held-out text's tag: the number of its kind and fold from this bit on, its own number below.
KIND_BIT = 57


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for text, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        out = F.when(fits, F.lit(text)) if out is None else out.when(fits, F.lit(text))
    return out if out is not None else F.lit(None).cast("string")


class Markov:
    """Witten-Bell mixtures of all orders up to ``order`` over characters, longest seen context first.

    The plain form, of texts in memory, of what probabilities() computes over tables.
    """

    def __init__(self, texts: list[str], order: int = ORDER, alphabet: int = ALPHABET) -> None:
        self.order, self.alphabet = order, alphabet
        counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for text in texts:
            padded = "\x02" * order + text + "\x03"
            for k in range(order, len(padded)):
                for n in range(order + 1):
                    counts[padded[k - n : k]][padded[k]] += 1
        self.counts = {c: (dict(v), sum(v.values())) for c, v in counts.items()}

    def probability(self, context: str, char: str) -> float:
        p = 1 / self.alphabet
        for n in range(len(context) + 1):
            seen = self.counts.get(context[len(context) - n :])
            if seen is None:
                break
            followers, total = seen
            p = (followers.get(char, 0) + len(followers) * p) / (total + len(followers))
        return p

    def score(self, text: str) -> float:
        """Mean log probability of a character, the end included."""
        padded = "\x02" * self.order + text + "\x03"
        return sum(math.log(self.probability(padded[k - self.order : k], padded[k])) for k in range(self.order, len(padded))) / (len(text) + 1)


@dataclass(frozen=True)
class Ratio:
    """Models of accepted and rejected addresses, and the ratio above which an address is rejected."""

    accepted: Markov | None
    rejected: Markov | None
    threshold: float

    def value(self, text: str) -> float:
        if self.accepted is None or self.rejected is None:
            return -math.inf
        return self.rejected.score(text) - self.accepted.score(text)


def plain(text: str) -> str:
    """A host as the models see it, digits alike."""
    return "".join("0" if c.isdigit() else c for c in text)


def train(accepted: list[str], rejected: list[str], order: int = ORDER) -> Ratio:
    """Models of all hosts, and a threshold from hosts held out in turn.

    Each host is scored by models trained without its fifth of its kind (with
    fewer than FEW of a kind, without itself). With one kind missing the
    ratio rejects nothing.
    """
    if not accepted or not rejected:
        return Ratio(None, None, 0.0)
    whole = Ratio(Markov(accepted, order), Markov(rejected, order), 0.0)

    def scores(kind: list[str], part) -> list[float]:
        folds, out = FOLDS if len(kind) >= FEW else len(kind), []
        for f in range(folds):
            held = part([h for k, h in enumerate(kind) if k % folds != f])
            out += [held.value(h) for k, h in enumerate(kind) if k % folds == f]
        return out

    good = scores(accepted, lambda rest: Ratio(Markov(rest, order), whole.rejected, 0.0))
    bad = scores(rejected, lambda rest: Ratio(whole.accepted, Markov(rest, order), 0.0))
    return Ratio(whole.accepted, whole.rejected, cut(good, bad))


def cut(good: list[float], bad: list[float]) -> float:
    """The middle of the range of ratios at which the shares of wrongly judged addresses of both kinds add up to least."""
    good, bad = sorted(good), sorted(bad)
    every = sorted({*good, *bad})
    cuts = [every[0] - 1, *((x + y) / 2 for x, y in zip(every, every[1:])), every[-1] + 1]
    # shares times both numbers: whole numbers, so that equal sums are told as equal
    wrong = [(len(good) - bisect_right(good, c)) * len(bad) + bisect_right(bad, c) * len(good) for c in cuts]
    least = min(wrong)
    best = [k for k, w in enumerate(wrong) if w == least]
    return cuts[best[len(best) // 2]]


def cut_table(tallies: DataFrame) -> float:
    """cut() over a table (ratio, good, bad) of distinct ratios and how many of each kind have them, both kinds there.

    Rows are dealt by ranges of ratios and summed up within a range; of each
    range only its sums and its least come to the driver, so the cut is that
    of all rows. How the ranges lie changes the work, not the cut.
    """
    rows = materialise(tallies.repartitionByRange("ratio").withColumn("part", F.spark_partition_id()), "url-cuts")
    parts = rows.groupBy("part").agg(F.min("ratio").alias("first"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("first").collect()
    goods, bads = sum(r["good"] for r in parts), sum(r["bad"] for r in parts)
    # a cut above a ratio judges good ones up to it right and bad ones wrong
    inside = Window.partitionBy("part").orderBy("ratio")
    change = F.sum(F.col("bad") * goods - F.col("good") * bads).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.select("part", "ratio", F.lead("ratio").over(inside).alias("next"), change.alias("change"))
    # both by part: the same dealing serves
    lows = {r["part"]: r for r in summed.groupBy("part", "change").agg(F.count("*").alias("n")).groupBy("part").agg(F.min(F.struct("change", "n")).alias("low")).collect()}

    # (wrong, how many such cuts, part, its change): the cut below all first, then each part's best
    wrong, told = goods * bads, [(goods * bads, 1, None, 0)]
    for r in parts:
        change_, n = lows[r["part"]]["low"]
        told.append((wrong + change_, n, r["part"], change_))
        wrong += r["bad"] * goods - r["good"] * bads
    least = min(t[0] for t in told)
    best = [t for t in told if t[0] == least]
    k = sum(n for _, n, _, _ in best) // 2
    for _, n, part, change_ in best:
        if k < n:
            break
        k -= n
    if part is None:
        return parts[0]["first"] - 1
    found = summed.where((F.col("part") == part) & (F.col("change") == change_)).withColumn("k", F.row_number().over(inside)).where(F.col("k") == k + 1).first()
    at = next(i for i, r in enumerate(parts) if r["part"] == part)
    after = found["next"] if found["next"] is not None else parts[at + 1]["first"] if at + 1 < len(parts) else None
    return found["ratio"] + 1 if after is None else (found["ratio"] + after) / 2


@dataclass(frozen=True)
class Tables:
    """Both models as a table, and the ratio above which an address is rejected.

    counts: gram (a context of ``order`` characters and the next one), accepted
    and rejected: how often it stands in the distinct addresses of a kind.
    Shorter contexts' counts are sums of these. None where a kind is missing.
    """

    counts: DataFrame | None
    threshold: float
    heavy: tuple[str, ...] = ()
    order: int = ORDER


def address(url: Column) -> Column:
    """Host, path and query, up to #; empty for null and where there is no ://."""
    return F.coalesce(F.concat(host(url), F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)), F.lit(""))


def alike(text: Column) -> Column:
    """An address as the models see it, digits alike."""
    return F.regexp_replace(text, r"\p{Nd}", "0")


def grams(rows: DataFrame, order: int) -> DataFrame:
    """(tag, gram, n) of rows (tag, text): the text's grams, its end included, counted by tag within a piece of the rows."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found: Counter = Counter()
                for tag, text in zip(batch.column(0)[at : at + 1024].to_pylist(), batch.column(1)[at : at + 1024].to_pylist()):
                    padded = "\x02" * order + text + "\x03"
                    found.update((tag, padded[k : k + order + 1]) for k in range(len(text) + 1))
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([g for _, g in found], pa.string()), pa.array(found.values(), pa.int64())], names=["tag", "gram", "n"])

    return rows.select(F.col("tag").cast("long"), "text").mapInArrow(run, "tag long, gram string, n long")


def probabilities(counts: DataFrame, variants: dict[str, Column], order: int = ORDER) -> DataFrame:
    """(gram, a probability of its last character for each variant) of every gram of counts, zero counts included.

    variants: name -> count of a gram in that model. Order by order, each from
    the one below: a context has no more rows than characters follow it, so no
    key is hot however many addresses there are.
    """
    full, below = counts.select("gram", *[c.alias(f"c_{v}") for v, c in variants.items()]), None
    for n in range(order + 1):
        level = full.groupBy(F.substring("gram", order + 1 - n, n + 1).alias("gram")).agg(*[F.sum(f"c_{v}").alias(f"c_{v}") for v in variants])
        level = level.withColumn("context", F.substring("gram", 1, n))
        same = Window.partitionBy("context")
        seen = level.select("gram", *[F.col(f"c_{v}") for v in variants], *[F.sum(f"c_{v}").over(same).alias(f"n_{v}") for v in variants], *[F.count(F.when(F.col(f"c_{v}") > 0, 1)).over(same).alias(f"t_{v}") for v in variants])
        if below is None:
            rows, lower = seen, {v: F.lit(1 / ALPHABET) for v in variants}
        else:
            rows = seen.join(below, F.substring("gram", 2, n) == F.col("end"))
            lower = {v: F.col(f"q_{v}") for v in variants}
        mixed = {v: F.when(F.col(f"n_{v}") > 0, (F.col(f"c_{v}") + F.col(f"t_{v}") * lower[v]) / (F.col(f"n_{v}") + F.col(f"t_{v}"))).otherwise(lower[v]) for v in variants}
        # written, since the planner's work on all orders at once grows out of hand
        out = materialise(rows.select("gram", *[mixed[v].alias(v) for v in variants]), "url-probabilities")
        below = out.select(F.col("gram").alias("end"), *[F.col(v).alias(f"q_{v}") for v in variants])
    return out


def ratios(found: DataFrame, logs: DataFrame, value: Column, heavy: tuple[str, ...], keys: tuple[str, ...] = ("tag",)) -> DataFrame:
    """(keys, ratio): the mean of value over the grams of each tag. Heavy grams' rows are dealt to SALTS tasks each."""
    is_heavy = lambda c: c.isin(*heavy) if heavy else F.lit(False)
    rows = found.withColumn("salt", F.when(is_heavy(F.col("gram")), F.pmod("tag", F.lit(SALTS))).otherwise(0).cast("int"))
    known = logs.withColumnRenamed("gram", "lg").withColumn("ls", F.explode(F.when(is_heavy(F.col("lg")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = rows.join(known, (F.col("gram") == F.col("lg")) & (F.col("salt") == F.col("ls")))
    return met.groupBy(*keys).agg((F.sum(F.col("n") * value) / F.sum("n")).alias("ratio"))


def fit(pages: DataFrame, sample_urls: int | None = None, parts=REJECTED_PARTS, url_col: str = "url", order: int = ORDER) -> Tables:
    """Models of all distinct addresses: rejected if a part of the host between dots and dashes is among ``parts``.

    Addresses without a host have no kind and are not counted, but are judged.

    The threshold is fitted to all of them too, each scored by models that
    count no address of its fold of hosts; with fewer than FEW hosts of a kind,
    none of its host. A caller that gives ``sample_urls`` has it fitted to at
    most so many addresses of each kind, chosen by hash.
    """
    url = F.col(url_col)
    texts = pages.select(host(url).alias("host"), address(url).alias("address")).where("host <> ''").distinct()
    texts = materialise(texts.select("host", "address", alike(F.col("address")).alias("text")).withColumn("bad", F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(p) for p in parts]))), "url-texts")
    hosts = {bad: [r["host"] for r in texts.where(F.col("bad") == bad).select("host").distinct().limit(FEW).collect()] for bad in (False, True)}
    if not all(hosts.values()):
        return Tables(None, 0.0, order=order)
    folds = {bad: len(names) if 1 < len(names) < FEW else FOLDS for bad, names in hosts.items()}

    def fold(bad: bool) -> Column:
        """Of few hosts each is a fold; of a single one its addresses are dealt."""
        if 1 < len(hosts[bad]) < FEW:
            return F.array_position(F.array(*[F.lit(h) for h in sorted(hosts[bad])]), F.col("host")).cast("int") - 1
        return F.pmod(F.xxhash64("host" if len(hosts[bad]) > 1 else "address"), F.lit(FOLDS)).cast("int")

    texts = texts.withColumn("fold", F.when(F.col("bad"), fold(True)).otherwise(fold(False)))
    # tag: which kind, and which fold of it
    width = 1 + max(FOLDS, FEW)
    each = grams(texts.select((F.col("bad").cast("int") * width + F.col("fold")).alias("tag"), "text"), order)
    of = lambda bad, f=None: F.sum(F.when((F.col("tag") >= width) == F.lit(bad) if f is None else F.col("tag") == width * bad + f, F.col("n")).otherwise(0))
    held = [(bad, f) for bad in (False, True) for f in range(folds[bad])]
    counts = materialise(each.groupBy("gram").agg(of(False).alias("accepted"), of(True).alias("rejected"), *[of(bad, f).alias(f"held_{int(bad)}_{f}") for bad, f in held]), "url-grams")
    total = counts.agg(F.sum(F.col("accepted") + F.col("rejected"))).first()[0]
    heavy = tuple(r["gram"] for r in counts.where(F.col("accepted") + F.col("rejected") > total * HEAVY_SHARE).select("gram").collect())

    whole = {False: F.col("accepted"), True: F.col("rejected")}
    variants = {"p_0": whole[False], "p_1": whole[True]} | {f"p_{int(bad)}_{f}": whole[bad] - F.col(f"held_{int(bad)}_{f}") for bad, f in held}
    logs = probabilities(counts, variants, order).select("gram", *[F.log(v).alias(v) for v in variants])
    chosen = texts
    if sample_urls is not None:
        some = [sampled(texts.where(F.col("bad") == bad), sample_urls, "address") for bad in (False, True)]
        chosen = some[0].unionByName(some[1])
    # alike addresses of a fold have one ratio: it is computed once and counts as often as they are
    chosen = chosen.groupBy("text", "bad", "fold").agg(F.count("*").alias("weight"))
    chosen = materialise(chosen.withColumn("tag", F.shiftleft((F.col("bad").cast("int") * width + F.col("fold")).cast("long"), KIND_BIT) + F.monotonically_increasing_id()), "url-held")
    kind = F.shiftright("tag", KIND_BIT)
    found = grams(chosen, order).withColumn("bad", kind >= width).withColumn("fold", kind % width)
    own = {bad: F.col(f"p_{int(bad)}") for bad in (False, True)}
    for bad, f in held:
        own[bad] = F.when((F.col("bad") == bad) & (F.col("fold") == f), F.col(f"p_{int(bad)}_{f}")).otherwise(own[bad])
    scored = ratios(found, logs, own[True] - own[False], heavy).join(chosen.select(F.col("tag").alias("st"), "bad", "weight").hint("merge"), F.col("tag") == F.col("st"))
    of_kind = lambda bad: F.sum(F.when(F.col("bad") == bad, F.col("weight")).otherwise(0))
    threshold = cut_table(materialise(scored.groupBy("ratio").agg(of_kind(False).alias("good"), of_kind(True).alias("bad")), "url-ratios"))
    return Tables(counts.select("gram", "accepted", "rejected"), threshold, heavy, order)


def judge(pages: DataFrame, model: Tables, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and ratio (null where a rule decides) of each row.

    Null urls and urls without :// have an empty host and path and fit no rule;
    what has no address is allowed. Repeated rows stay.
    """
    url, verdicts = F.col(url_col), dict(rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), alike(address(url)).alias("text"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    by_models = F.col("rule").isNull() & (F.col("text") != "") if model.counts is not None else F.lit(False)
    none = F.lit(None).cast("double")
    out = rows.where(~by_models).withColumn("ratio", none)
    if model.counts is not None:
        # rows that a rule decides take no part in the join; an address is scored once
        asked = rows.where(by_models).withColumn("tag", F.xxhash64("text"))
        found = materialise(grams(asked.select("tag", "text").distinct(), model.order), "url-asked")
        zero = F.lit(0).cast("long")
        counts = model.counts.unionByName(found.select("gram", zero.alias("accepted"), zero.alias("rejected")).distinct())
        logs = probabilities(counts, {"p_0": F.col("accepted"), "p_1": F.col("rejected")}, model.order).select("gram", (F.log("p_1") - F.log("p_0")).alias("value"))
        scores = ratios(found, logs, F.col("value"), model.heavy).withColumnRenamed("tag", "st")
        out = out.unionByName(asked.join(scores, F.col("tag") == F.col("st"), "left").select(*rows.columns, "ratio"))
    by_rule = F.element_at(F.create_map(*[x for text, v in verdicts.items() for x in (F.lit(text), F.lit(v))]), F.col("rule"))
    verdict = F.when(F.col("rule").isNotNull(), by_rule).when(F.col("ratio") > model.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")
