"""Helpers that the corpus operators share: materialised tables, lambda bindings, vectorised words.

Conventions of every operator in this package: it selects the columns it needs
from its input and returns its own columns only, so extra columns with clashing
names do no harm; null texts count as empty texts.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a lambda would compute an inlined one for every element."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a local master one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagegauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def discard(spark: SparkSession, path: str) -> None:
    """Delete a materialised table."""
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch while a table is written, but for a single longer row; a batch is held on both sides.
BATCH_BYTES = 4 << 20
#: Paths of tables written inside the scratch blocks that are open, the innermost last.
_open: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor loses nothing.

    The table goes when the scratch block it was written in ends, or with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, was)
    if _open:
        _open[-1].append(path)
    else:
        atexit.register(_discard_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagegauge_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose materialised tables go when it ends, but for those given to the function it yields."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._pagegauge_path)
        return df

    _open.append(made)
    try:
        yield keep
    finally:
        _open.remove(made)
        for path in made:
            if path not in kept:
                discard(spark, path)
            elif _open:
                _open[-1].append(path)
            else:
                atexit.register(_discard_at_exit, spark, path)


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it differ from all names, letters' case aside."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def joinable(df: DataFrame, rows: int | None = None, most: int = 1_000_000) -> DataFrame:
    """df of narrow rows, marked for broadcast if it has at most ``most`` of them; it should be materialised."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def sampled(df: DataFrame, most: int, *by: str) -> DataFrame:
    """df, or of more than ``most`` rows nearly so many: those whose hash of ``by`` lies under a bound that follows from
    their number, four deviations under ``most``. No task hands on more than its share."""
    n = df.count()
    if n <= most:
        return df
    if most <= 100:
        return df.orderBy(F.xxhash64(*by), *by).limit(most)
    share = (most - 4 * most**0.5) / n
    return df.where(F.shiftrightunsigned(F.xxhash64(*by), 1) < int(max(share, 0.5 / n) * 2**63))


def _discard_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            discard(spark, path)
    except Exception:  # the JVM has gone already; nothing is left to tidy with
        return
