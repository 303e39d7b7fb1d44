"""Mixing sources to target weights: weighted random order within each source, cut at token budgets.

All steps are DataFrame expressions. Sizes and keys are materialised once; budgets
and prefix sums work on totals by (source, key bucket), then by fine buckets
within the one that a source's budget cuts. Only the one fine bucket that it
cuts, about one row in buckets * buckets, is put in order row by row, so no
source, however large, is sorted or gathered in one task. The sources
themselves, a row each, are ranked in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise, unused

#: Weights of the sources by rank, repeating.
WEIGHTS = (3, 1, 2)


def sized(docs: DataFrame, quality: DataFrame | None, seed: int, buckets: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, key, bucket and fine bucket of each row.

    The key is exponential with the quality weight as its rate: -ln(u) / weight,
    u a hash of id, text and seed. Ascending keys are the order of weighted
    sampling without replacement. The bucket cuts exp(-key) into equal parts,
    the fine bucket each of these again.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    )
    if quality is None:
        base = base.withColumn("weight", F.lit(1.0))
    else:
        base = base.join(quality.select(F.col("doc_id").alias("__q"), F.col("weight").alias("weight")), F.col("doc_id") == F.col("__q"), "left").withColumn("weight", F.coalesce("weight", F.lit(0.75)))
    u = (F.shiftrightunsigned("h", 11).cast("double") + F.lit(1.0)) / F.lit(float(2**53 + 1))
    base = base.select("doc_id", "source", "size", "h", (-F.log(u) / F.col("weight")).alias("key"))
    fine = F.floor((1 - F.exp(-F.col("key"))) * (buckets * buckets)).cast("long")
    return base.withColumn("fine", fine).withColumn("bucket", F.floor(F.col("fine") / buckets).cast("long"))


def quality_weights(labels: DataFrame, good: float = 1.0, bad: float = 0.5) -> DataFrame:
    """doc_id and weight: good for quality 1, bad for quality 0; the least label counts where an id has several."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__l")).select("doc_id", F.when(F.col("__l") > 0, F.lit(good)).otherwise(F.lit(bad)).alias("weight"))


def targets(totals: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target of each source, from (source, source_size).

    Each target is weight * level, at most ``most`` times the source's size,
    with the level at which targets add up to ``share`` of all sizes: sharing
    the excess by weight again and again ends there. Sources that stop are a
    prefix by most * size / weight, so the level follows from running sums.
    """
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    ranked = totals.select("source", F.col("source_size").cast("double").alias("__s"), (F.row_number().over(by_name) - 1).alias("__r"))
    ranked = ranked.select("source", "__s", F.element_at(cycle, F.col("__r") % len(WEIGHTS) + 1).alias("__w"), (F.col("__s") * most).alias("__cap"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        F.row_number().over(by_ratio).alias("__n"),
        # the level if every source before this one stops and no other does
        ((F.sum("__s").over(every) * share - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))) / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(earlier), F.lit(0.0)))).alias("__level"),
    )
    # the first source that its level does not stop fixes the level
    level = F.min(F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct("__n", "__level"))).over(every)["__level"]
    return levels.select("source", F.col("__s").cast("long").alias("source_size"), F.least(F.col("__cap"), F.col("__w") * F.coalesce(level, F.lit(float("inf")))).alias("target"))


#: Parts that a source's rows are dealt to where there are too many sources to broadcast their plan.
SALTS = 64


def _planned(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """rows (source, bucket, ...) with their source's plan (ps, ...) of n rows; no source is gathered in one task."""
    if n <= 1_000_000:
        return rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("ps"))).drop("ps")
    dealt = plan.withColumn("ts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod("bucket", F.lit(SALTS)).cast("int"))
    return salted.join(dealt, F.col("source").eqNullSafe(F.col("ps")) & (F.col("salt") == F.col("ts"))).drop("ps", "ts", "salt")


def _cut(cells: DataFrame) -> DataFrame:
    """(cs, cut, before) of cells (source, bucket, cell, rest, from): the bucket in which a source's rest ends, and the words before it."""
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.withColumn("before", F.col("from") + F.coalesce(F.sum("cell").over(earlier), F.lit(0)))
    inside = sums.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("cell")))
    return inside.groupBy(F.col("source").alias("cs")).agg(F.min("bucket").alias("cut"), F.min("before").alias("before"))


def _taken(docs: DataFrame, labels: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """mix() with h, the hash of id, text and seed."""
    rows = materialise(sized(docs, None if labels is None else quality_weights(labels), seed, buckets), "mix-sizes")
    cells = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell")), "mix-cells")
    aims = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = aims.select(F.col("source").alias("ps"), "source_size", "target", epochs.alias("epochs")).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    aims = materialise(aims, "mix-aims")
    n = aims.count()
    # the bucket that the rest cuts, then the fine bucket within it: only that one is put in order row by row
    first = _cut(_planned(cells, aims, n).withColumn("from", F.lit(0).cast("long")))
    plan = materialise(aims.join(first, F.col("ps").eqNullSafe(F.col("cs")), "left").drop("cs"), "mix-plan")
    inside = _planned(rows, plan.where("cut is not null"), n).where("bucket = cut")
    finer = inside.groupBy("source", F.col("fine").alias("bucket")).agg(F.sum("size").alias("cell"), F.first("rest").alias("rest"), F.first("before").alias("from"))
    second = _cut(finer).select("cs", F.col("cut").alias("fine_cut"), F.col("before").alias("fine_before"))
    plan = materialise(plan.drop("before").join(second, F.col("ps").eqNullSafe(F.col("cs")), "left").drop("cs"), "mix-plan")
    placed = _planned(rows, plan, n)
    names = ("doc_id", "size", "source", "source_size", "target", "epochs", "h")
    # without a cut, the rest is all of the source or nothing
    whole = F.when(F.col("fine") < F.coalesce("fine_cut", F.lit(2**62)), F.col("size")).otherwise(F.lit(0).cast("long"))
    at_cut = F.coalesce(F.col("fine") == F.col("fine_cut"), F.lit(False))
    ends = placed.where(~at_cut).select(*names, (F.col("epochs") * F.col("size") + F.when(F.col("rest") > 0, whole).otherwise(F.lit(0))).alias("taken"))
    ordered = Window.partitionBy("source").orderBy("key", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = placed.where(at_cut).withColumn("b", F.col("fine_before") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("b")))
    return ends.unionByName(middle.select(*names, (F.col("epochs") * F.col("size") + part).alias("taken")))


def mix(docs: DataFrame, labels: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, epochs, taken.

    target // source_size complete epochs take every document of the source;
    the rest of the target goes to documents in key order, the last one in part.
    Sizes count words. Null sources form a source of their own, null and empty
    texts have size 0 and nothing taken, repeated rows are documents of their
    own. An empty table gives an empty result.
    """
    return _taken(docs, labels, share, most, seed, buckets).drop("h")


def mixed(docs: DataFrame, labels: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """The rows of docs as often as mix() takes them; one taken in part comes once more, whole.

    Rows of size 0 come once for every complete epoch of their source, at least
    once. Rows that are equal in id, text and source share their copies, in the
    order of their other columns. Any further column passes, whatever its name.
    """
    names = docs.columns
    quoted = [f"`{c}`" for c in names]
    taken = _taken(docs, labels, share, most, seed, buckets)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.greatest(F.col("epochs"), F.lit(1)))
    key, th, ts, n, equal, row, told, alike, upto, times = unused(names, "key", "th", "ts", "n", "equal", "row", "told", "alike", "upto", "times")
    taken = taken.groupBy(F.col("h").alias(th), F.col("source").alias(ts)).agg(F.sum(copies).cast("long").alias(n), F.count(F.lit(1)).alias(equal))
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))
    joined = keyed.join(taken, (F.col(key) == F.col(th)) & F.col("source").eqNullSafe(F.col(ts)))
    alone = joined.where(F.col(equal) == 1).select(*quoted, F.col(n).alias(times))
    # equal rows are counted by their other columns first, so that a row's million copies are one row; sums of counts part the copies
    whole = F.struct(*quoted)
    several = joined.where(F.col(equal) > 1).groupBy(th, ts, n, equal, F.to_json(whole).alias(told)).agg(F.first(whole).alias(row), F.count(F.lit(1)).alias(alike))
    several = several.withColumn(upto, F.sum(alike).over(Window.partitionBy(th, ts).orderBy(told)))
    share_of = lambda c: F.floor(F.col(n) * c / F.col(equal))
    several = several.select(*[F.col(f"{row}.`{c}`").alias(c) for c in names], (share_of(F.col(upto)) - share_of(F.col(upto) - F.col(alike))).alias(times))
    rows = alone.unionByName(several).where(F.col(times) > 0)
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*quoted)
