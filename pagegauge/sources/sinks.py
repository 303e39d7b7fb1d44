"""Sinks: report CSV in its fixed column order, and page images under names that do not collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import joined_reasons
from ..plans.schema import REPORT_COLUMNS


def report_csv(rows: DataFrame, path: str) -> None:
    """One sorted CSV with a header; columns that rows lack stay empty, others are left out, codes are joined by |."""
    have = set(rows.columns)
    columns = [(joined_reasons(F.col(c)) if c == "reasons" else F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in REPORT_COLUMNS]
    rows.select(*columns).orderBy("file", "page").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_json(rows: DataFrame, path: str) -> None:
    rows.orderBy("file", "page").write.mode("overwrite").json(path)


def page_files(rows: DataFrame) -> DataFrame:
    """name, image of pages with an image: the input's relative path and suffix stay in the name, so that namesakes do not overwrite each other."""
    bare = F.regexp_replace(F.col("file"), r"^[a-z]+:/+", "")
    tail = F.when(F.col("page_count") == 1, F.lit(".out.png")).otherwise(F.concat(F.lit(".p"), F.col("page").cast("string"), F.lit(".out.png")))
    return rows.where("image is not null").select(F.concat(bare, tail).alias("name"), "image")


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "image") -> None:
    """Each row's bytes as a file of its name under a folder that all executors reach (a path or a URI).

    A file is written beside its name and then moved there, so that a task that
    is run again replaces it whole. Names must be distinct.
    """

    def save(part) -> None:
        from pyarrow import fs

        for row in part:
            at, path = (fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder))
            target = f"{path.rstrip('/')}/{row[0].lstrip('/')}"
            at.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with at.open_output_stream(target + ".part") as out:
                out.write(bytes(row[1]))
            at.move(target + ".part", target)

    rows.select(name, content).where(F.col(name).isNotNull() & F.col(content).isNotNull()).foreachPartition(save)


def documents_pdf(rows: DataFrame) -> DataFrame:
    """file, pdf: each file's page images as one PDF; pages come in order, a file's pages are in one task."""
    import pandas as pd

    from . import codecs, pdf

    def build(group: pd.DataFrame) -> pd.DataFrame:
        images = [codecs.decode(bytes(x)) for x in group.sort_values("page")["image"] if x is not None]
        return pd.DataFrame({"file": [group["file"].iloc[0]], "pdf": [pdf.write(images)]})

    return rows.where("image is not null").select("file", "page", "image").groupBy("file").applyInPandas(build, "file string, pdf binary")
