"""Files as rows, empty ones included, and the small tables beside them: labels, baselines, ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..plans.schema import FILE, LABEL


def listing(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """file, length of everything in a directory, by Hadoop's file system, so that any store works and empty files count.

    Only names and lengths pass the driver, once for a directory; contents are
    read by executors.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, recursive)
    rows = []
    while found.hasNext():
        status = found.next()
        rows.append((status.getPath().toString(), status.getLen()))
    return spark.createDataFrame(sorted(rows), "file string, length long")


def contents(spark: SparkSession, directory: str, recursive: bool = False, pdf: bool = True) -> DataFrame:
    """FILE of the directory's images (and PDFs), by path; binary sources leave empty files out, the listing brings them back."""
    wanted = names.is_input if pdf else names.is_image
    files = listing(spark, directory, recursive).where(wanted(F.col("file")))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    read = read.select(bare(F.col("path")).alias("__p"), "content")
    return files.join(read, bare(F.col("file")) == F.col("__p"), "left").select("file", "length", F.coalesce("content", F.lit(b"")).alias("content")).orderBy("file")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a JSON-lines file; blank lines drop, the last of a name's lines counts."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where(F.trim("value") != "")
    rows = lines.select("n", F.from_json("value", LABEL).alias("l")).select("n", "l.*")
    last = rows.groupBy("file").agg(F.max_by(F.struct("corners", "expect_verdict", "expect_reasons"), "n").alias("l"))
    return last.select("file", "l.*")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


GROUND_TRUTH = T.StructType(
    [
        T.StructField("_index", T.IntegerType()),
        T.StructField("_rejected", T.StringType()),
        T.StructField("point", T.ArrayType(T.StructType([T.StructField("_name", T.StringType()), T.StructField("_x", T.DoubleType()), T.StructField("_y", T.DoubleType())]))),
    ]
)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """index, corners (top left, top right, bottom right, bottom left) of frames that are neither rejected nor incomplete."""
    rows = spark.read.format("xml").option("rowTag", "frame").schema(GROUND_TRUTH).load(path)
    by_name = F.map_from_entries(F.transform("point", lambda p: F.struct(p["_name"], F.struct(p["_x"].alias("x"), p["_y"].alias("y")))))
    rows = rows.where(F.lower(F.coalesce("_rejected", F.lit("false"))) != "true").select(F.col("_index").alias("index"), by_name.alias("m"))
    corners = F.array(*[F.try_element_at("m", F.lit(k)) for k in ("tl", "tr", "br", "bl")])
    return rows.select("index", corners.alias("corners")).where(F.forall("corners", lambda c: c.isNotNull()))


def empty_error(length):
    """FILE_EMPTY for a file without bytes."""
    return F.when(length == 0, "FILE_EMPTY")


__all__ = ["FILE", "baseline", "contents", "empty_error", "ground_truth", "labels", "listing"]
