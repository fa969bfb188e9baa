"""Versioned series, panels and retained responses as files.

Readers keep texts as texts until a rule says what they are: a cell that can't
be typed becomes null and shows up in the audit instead of ending the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of a missing number.
MISSING_NUMBERS = ("", "-", "--", ":", "NA", "NaN", "nan")

class SchemaMismatch(ValueError):
    """A file's header isn't the declared one."""


def csv_texts(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """A headed CSV file or folder as texts; every file's header must be `fields` in order (a byte order mark is allowed)."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    is_head = F.regexp_replace(F.split("value", ",")[0], "^﻿|\"", "") == fields[0]
    heads = lines.groupBy("file").agg(F.first(F.when(is_head, F.col("value")), ignorenulls=True).alias("head"))
    wanted = ",".join(fields)
    clean = F.regexp_replace("head", '^﻿|"|\\s+$', "")
    wrong = heads.where(~clean.eqNullSafe(F.lit(wanted))).limit(1).collect()
    if wrong or not lines.limit(1).count():
        raise SchemaMismatch(f"header differs from {wanted}: {wrong[0]['head'] if wrong and wrong[0]['head'] else 'missing'}")
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def tolerant_number(text: Column) -> Column:
    """A finite number; null for spellings of missing and for what is none."""
    bare = F.regexp_replace(text, "[\\s ]", "")
    number = F.when(~bare.isin(*MISSING_NUMBERS), bare.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def versioned_series(spark: SparkSession, path: str) -> DataFrame:
    """(key, period, value, usable_at, is_delete) of a versioned series file.

    The clock is VALID_FROM, or VALID_TO where that is blank; rows without
    either, and rows without value that aren't deletes, are left out.
    """
    rows = csv_texts(
        spark, path, ("KEY", "FREQ", "TIME_PERIOD", "OBS_VALUE", "UNIT", "ACTION", "VALID_FROM", "VALID_TO")
    )
    clock = F.coalesce(F.nullif(F.trim("VALID_FROM"), F.lit("")), F.nullif(F.trim("VALID_TO"), F.lit("")))
    period = F.to_date(
        F.when(F.length("TIME_PERIOD") == 7, F.concat("TIME_PERIOD", F.lit("-01"))).otherwise(F.col("TIME_PERIOD"))
    )
    typed = rows.select(
        F.col("KEY").alias("key"), period.alias("period"), tolerant_number(F.col("OBS_VALUE")).alias("value"),
        F.try_to_timestamp(clock).alias("usable_at"), (
            F.lower(F.trim(F.coalesce("ACTION", F.lit("")))) == "delete"
        ).alias("is_delete"),
    )
    return typed.where(F.col("usable_at").isNotNull() & (F.col("is_delete") | F.col("value").isNotNull()))


def series_violations(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """One row of rule counts for a versioned series file: keys, frequencies, periods outside, unusable values, repeated versions."""
    rows = csv_texts(
        spark, path, ("KEY", "FREQ", "TIME_PERIOD", "OBS_VALUE", "UNIT", "ACTION", "VALID_FROM", "VALID_TO")
    )
    delete = F.lower(F.trim(F.coalesce("ACTION", F.lit("")))) == "delete"
    per_version = rows.groupBy("KEY", "TIME_PERIOD", "VALID_FROM", "ACTION").agg(
        F.count("*").alias("n"),
        F.count(F.when(~delete & tolerant_number(F.col("OBS_VALUE")).isNull(), 1)).alias("unusable"),
        F.collect_set("FREQ").alias("freq"),
    )
    return per_version.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_distinct("KEY").alias("n_keys"),
        F.size(F.array_distinct(F.flatten(F.collect_set("freq")))).alias("n_frequencies"),
        F.count(F.when(~F.col("TIME_PERIOD").between(first, last), 1)).alias("outside_periods"),
        F.coalesce(F.sum("unusable"), F.lit(0)).alias("unusable_values"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeated_versions"),
    )


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a folder; contents stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def relative_path(spark: SparkSession, folder: str) -> Column:
    """The `path` column without the folder that a scan began at."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(held).toUri().getPath()
    bare = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    return F.when(bare.startswith(f"{root.rstrip('/')}/"), F.substr(bare, F.lit(len(root.rstrip("/")) + 2))).otherwise(bare)


def verify_inventory(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(relative_path, failure) of manifest entries (relative_path, length, sha256) that are missing, differ or are repeated."""
    found = file_hashes(spark, folder).withColumn("relative_path", relative_path(spark, folder))
    found = found.select("relative_path", F.col("length").alias("_n"), F.col("sha256").alias("_h"))
    failure = (
        F.when(F.col("relative_path").rlike(r"(^/|(^|/)\.\.(/|$))"), "path_escape")
        .when(F.col("_rows") > 1, "repeated")
        .when(F.col("_h").isNull(), "missing")
        .when(F.col("_n") != F.col("length"), "size")
        .when(F.lower("_h") != F.lower("sha256"), "hash")
    )
    entries = manifest.groupBy("relative_path").agg(
        F.count("*").alias("_rows"), F.min("length").alias("length"), F.min("sha256").alias("sha256")
    )
    return entries.join(found, "relative_path", "left").withColumn("failure", failure).where("failure is not null").select("relative_path", "failure")


def archive_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, member, line_no, line) of the text members of ZIP archives whose names match; one task reads one archive."""
    import re

    wanted = re.compile(pattern)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as held:
                    for member in filter(wanted.fullmatch, held.namelist()):
                        lines = held.read(member).decode("utf-8-sig").splitlines()
                        yield pd.DataFrame(
                            {"archive": archive, "member": member, "line_no": range(len(lines)), "line": lines}
                        )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "archive string, member string, line_no int, line string")


def wide_vintages(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(vintage, period, value, usable_day) of one series in archives of wide monthly files monthly_YYYYMM.csv.

    Row 0 holds names, row 1 keys, rows from 4 on a period text and one value
    per series. A vintage is usable from the first day of the next month.
    """
    lines = archive_members(spark, path, r"monthly_\d{6}\.csv").withColumn("cells", F.split("line", ","))
    place = lines.where("line_no = 1").select(
        "archive", "member", (F.array_position("cells", key) - 1).cast("int").alias("at")
    )
    rows = lines.where("line_no >= 4").join(place, ["archive", "member"]).where("at > 0")
    vintage = F.to_date(F.regexp_extract("member", r"(\d{6})", 1), "yyyyMM")
    parsed = F.coalesce(
        F.try_to_timestamp(F.initcap(F.col("cells")[0]), F.lit("MMM-yy")),
        F.try_to_timestamp(F.col("cells")[0], F.lit("yyyy-MM"))
    ).cast("date")
    period = F.when(F.year(parsed) > 2068, F.add_months(parsed, -1200)).otherwise(parsed)
    typed = rows.select(
        vintage.alias("vintage"), period.alias("period"), tolerant_number(F.col("cells")[F.col("at")]).alias("value"), F.add_months(vintage, 1).alias("usable_day")
    )
    return typed.where(F.col("period").isNotNull() & F.col("value").isNotNull())
