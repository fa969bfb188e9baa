"""Writers that never replace what is there, with a manifest of what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforetime.sources.files import file_hashes, relative_path


def write_once(df: DataFrame, path: str, *, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write to a path that doesn't exist yet; Spark's commit protocol publishes whole files only."""
    writer = df.write.mode("errorifexists").format(kind).partitionBy(*partition_by)
    (writer.option("header", True) if kind == "csv" else writer).save(path)


def manifest(df: DataFrame, path: str) -> DataFrame:
    """(relative_path, length, sha256) of the data files that a write left under `path`."""
    files = file_hashes(df.sparkSession, path).withColumn("relative_path", relative_path(df.sparkSession, path))
    hidden = F.col("relative_path").rlike(r"(^|/)[_.][^/]*$")
    return files.where(~hidden).select("relative_path", "length", "sha256")


def canonical_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """One JSON text per row with sorted columns, numbered in `order`; for hashes and line-by-line comparison."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.select(*order, text.alias("line")).sort(*order)
