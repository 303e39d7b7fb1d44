"""The service's contract as expressions: statuses, response shapes, exit codes, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_KEY = 16


def status(verdict: Column, error: Column) -> Column:
    """HTTP status of a result: errors by kind, failed pages 422, others 200."""
    return (
        F.when(error == "UNAUTHORIZED", 401)
        .when(error == "TOO_LARGE", 413)
        .when(error.isin("INFERENCE_FAILED", "SERVER_BUSY"), 503)
        .when(error.isNotNull(), 400)
        .when(verdict == "fail", 422)
        .otherwise(200)
    )


def retry_after(error: Column) -> Column:
    return F.when(error == "INFERENCE_FAILED", 5).when(error == "SERVER_BUSY", 2)


def response_kind(fmt: Column, page_count: Column, verdict: Column) -> Column:
    """pdf unless the document failed; several pages, a failed one, or json asked for: json; else png."""
    return F.when((fmt == "pdf") & (verdict != "fail"), "pdf").when((page_count > 1) | (fmt == "json") | (verdict == "fail"), "json").otherwise("png")


def cli_exit(verdict: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), 3).when(verdict == "fail", 2).when(verdict == "warn", 1).otherwise(0)


def bearer(header: Column) -> Column:
    """The token of a Bearer header, null for another scheme or an empty token."""
    token = F.trim(F.regexp_extract(header, r"(?i)^\s*bearer\s+(.*)$", 1))
    return F.nullif(token, F.lit(""))


def parse_keys(rows: DataFrame, column: str = "keys") -> DataFrame:
    """name, key, problem of each entry of name:key lists; the last colon parts them, the name is client without one.

    problem: short (fewer than 16 characters), repeated (the key stands twice in its list), or null.
    """
    each = rows.withColumn("__row", F.monotonically_increasing_id()).select("__row", F.explode(F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")).alias("entry"))
    colon = F.col("entry").contains(":")
    name = F.when(colon, F.trim(F.regexp_extract("entry", "^(.*):[^:]*$", 1))).otherwise("")
    key = F.trim(F.regexp_extract("entry", "([^:]*)$", 1))
    each = each.select("__row", F.when(name == "", "client").otherwise(name).alias("name"), key.alias("key"))
    out = each.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__row", "key")))
    return out.select("name", "key", F.when(F.length("key") < LEAST_KEY, "short").when(F.col("__n") > 1, "repeated").alias("problem"))
