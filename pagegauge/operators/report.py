"""Reporting: page numbers, roll-ups, counts, accuracy against labels, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import METRIC_FIELDS
from .rules import rank, unrank

IOU_GOOD = 0.90


def number_pages(pages: DataFrame, file: str = "file", by: str = "page_ix") -> DataFrame:
    """page: 1 to N within each file."""
    return pages.withColumn("page", F.row_number().over(Window.partitionBy(file).orderBy(by)))


def roll_up(pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file, verdict of its worst page, page_count; files without pages fail."""
    out = pages.groupBy("file").agg(F.max(rank(F.col("verdict"))).alias("__r"), F.count(F.lit(1)).alias("page_count"))
    if files is not None:
        out = files.select("file").join(out, "file", "left")
    return out.select("file", unrank(F.col("__r")).alias("verdict"), F.coalesce("page_count", F.lit(0)).alias("page_count"))


def codes_union(pages: DataFrame) -> DataFrame:
    """file, codes: distinct codes in order of first sight over its pages."""
    sorted_ = F.sort_array(F.collect_list(F.struct("page", "reasons")))
    return pages.groupBy("file").agg(F.array_distinct(F.flatten(F.transform(sorted_, lambda p: p["reasons"]))).alias("codes"))


def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def code_counts(rows: DataFrame) -> DataFrame:
    """code, n, most first; codes break ties."""
    return rows.select(F.explode("reasons").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code")


def joined_reasons(reasons: Column) -> Column:
    return F.array_join(reasons, "|")


def split_reasons(text: Column) -> Column:
    return F.filter(F.split(text, "[|]"), lambda x: x != "")


def seconds_median(rows: DataFrame) -> DataFrame:
    """Median of seconds; rows without a time, or with none at all, do not count."""
    return rows.where(F.col("seconds") > 0).agg(F.round(F.median("seconds"), 3).alias("median_seconds"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: pages, counts by verdict, median seconds."""
    of = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v}")
    return rows.agg(F.count(F.lit(1)).alias("n"), of("pass"), of("warn"), of("fail"), F.round(F.median(F.when(F.col("seconds") > 0, F.col("seconds"))), 3).alias("median_seconds"))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2)


def accuracy(rows: DataFrame) -> DataFrame:
    """One row over rows with an expected verdict: crop rate, false passes and false fails, of all labelled rows and of their class."""
    got, want = F.col("verdict"), F.col("expect_verdict")
    labelled = rows.where(want.isNotNull())
    counts = labelled.agg(
        F.count(F.lit(1)).alias("n_labelled"),
        F.count("iou").alias("n_iou"),
        F.count_if(F.col("iou") >= IOU_GOOD).alias("n_good"),
        F.count_if((want != "pass") & (got == "pass")).alias("n_false_pass"),
        F.count_if((want == "pass") & (got == "fail")).alias("n_false_fail"),
        F.count_if(want == "pass").alias("n_want_pass"),
    )
    n, p = F.col("n_labelled"), F.col("n_want_pass")
    return counts.select(
        "n_labelled",
        percent(F.col("n_good"), F.col("n_iou")).alias("crop_rate_pct"),
        "n_false_pass",
        percent(F.col("n_false_pass"), n).alias("false_pass_pct"),
        percent(F.col("n_false_pass"), n - p).alias("false_pass_pct_by_class"),
        "n_false_fail",
        percent(F.col("n_false_fail"), n).alias("false_fail_pct"),
        percent(F.col("n_false_fail"), p).alias("false_fail_pct_by_class"),
    )


def false_files(rows: DataFrame) -> DataFrame:
    """kind (false_pass or false_fail), file: a row each, so that no list is gathered in one task."""
    got, want = F.col("verdict"), F.col("expect_verdict")
    kind = F.when((want != "pass") & (got == "pass"), "false_pass").when((want == "pass") & (got == "fail"), "false_fail")
    return rows.select(kind.alias("kind"), "file").where("kind is not null")


def confusion(rows: DataFrame) -> DataFrame:
    """expect_verdict, verdict, n of rows where they differ."""
    return rows.where("expect_verdict is not null and expect_verdict <> verdict").groupBy("expect_verdict", "verdict").agg(F.count(F.lit(1)).alias("n"))


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """file, before, after of files in both runs whose verdict changed."""
    old = before.select(F.col("file").alias("__f"), F.col("verdict").alias("before"))
    return now.join(old, F.col("file") == F.col("__f")).where(F.col("before") != F.col("verdict")).select("file", "before", F.col("verdict").alias("after"))


def exit_code(rows: DataFrame) -> DataFrame:
    """One row: 2 if anything failed, 1 if anything warned, else 0."""
    return rows.agg(F.coalesce(F.max(rank(F.col("verdict"))), F.lit(0)).alias("exit_code"))


def kept_pages(pages: DataFrame, skip_fail: bool) -> DataFrame:
    out = pages.where("image is not null")
    return out.where("verdict <> 'fail'") if skip_fail else out


def page_guard(pages: DataFrame, page: int) -> DataFrame:
    """The page asked for, or one error row for each file that lacks it."""
    counts = pages.groupBy("file").agg(F.max("page").alias("__n"))
    asked = pages.where(F.col("page") == page).select("file", F.col("page").cast("int").alias("page"), "verdict", F.lit(None).cast("string").alias("error"))
    missing = counts.where((F.col("__n") < page) | F.lit(page < 1)).select("file", F.lit(page).alias("page"), F.lit("fail").alias("verdict"), F.lit("PAGE_OUT_OF_RANGE").alias("error"))
    return asked.unionByName(missing)


def single_page_guard(files: DataFrame) -> DataFrame:
    """file, error of files for an interface that answers one page."""
    return files.select("file", F.when(F.col("page_count") == 0, "PDF_NO_PAGES").when(F.col("page_count") != 1, "PDF_MULTIPAGE").alias("error"))


def output_name(stem: Column, page_count: Column, page: Column) -> Column:
    """stem.png for a single page, stem.pN.png for each of several."""
    return F.when(page_count == 1, F.concat(stem, F.lit(".png"))).otherwise(F.concat(stem, F.lit(".p"), page.cast("string"), F.lit(".png")))


def cli_name(stem: Column, suffix: Column, page: Column) -> Column:
    return F.when(page == 1, F.concat(stem, suffix)).otherwise(F.concat(stem, F.lit(".p"), page.cast("string"), suffix))


def metrics_json(pages: DataFrame) -> Column:
    """The page's metrics as JSON: numbers to four places, what was not measured left out."""
    known = [(n, t) for n, t, _ in METRIC_FIELDS if n in pages.columns]
    return F.to_json(F.struct(*[(F.round(F.col(n), 4) if t == "double" else F.col(n)).alias(n) for n, t in known]))


def documents_json(pages: DataFrame) -> DataFrame:
    """file, document: a JSON text of each file, its verdict, the union of its codes in order of appearance, and its pages
    with their codes and metrics. A file has at most as many pages as the reader takes, so its pages are held together."""
    told = [F.col("told")] if "told" in pages.columns else []
    page = F.struct(F.col("page"), F.col("verdict"), F.col("reasons"), *told, *[F.col(n) for n, _, _ in METRIC_FIELDS if n in pages.columns and n not in ("page", "verdict", "reasons")])
    grouped = pages.groupBy("file").agg(F.sort_array(F.collect_list(page)).alias("pages"), F.max(rank(F.col("verdict"))).alias("worst"))
    codes = F.array_distinct(F.flatten(F.transform("pages", lambda x: x["reasons"])))
    document = F.struct(F.col("file"), unrank(F.col("worst")).alias("verdict"), F.size("pages").alias("page_count"), codes.alias("reasons"), F.col("pages"))
    return grouped.select("file", F.to_json(document).alias("document"))


def as_json(row: DataFrame) -> DataFrame:
    """One column, summary: each row as JSON."""
    return row.select(F.to_json(F.struct(*[f"`{c}`" for c in row.columns])).alias("summary"))


def first_files(pages: DataFrame, n: int) -> DataFrame:
    """The pages of the first n files by name."""
    some = pages.select(F.col("file").alias("first_file")).distinct().orderBy("first_file").limit(n)
    return pages.join(F.broadcast(some), F.col("file") == F.col("first_file")).drop("first_file")


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Of the rows of each key the one that comes last, whole."""
    whole = F.struct(*[f"`{c}`" for c in rows.columns])
    return rows.groupBy(F.col(by).alias("latest_of")).agg(F.max_by(whole, F.col(order)).alias("row")).select("row.*")
