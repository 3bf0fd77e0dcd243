"""Reading filings, curated aliases and intake outputs from files."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import FILING_HEADERS
from ..functions.text import strip

CURATED_SCHEMA = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("primary_employer_name", "alias_name", "alias_type", "usage_count")])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on whatever file system it names."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def with_filing_columns(
    df: DataFrame,
    headers: dict[str, str] = FILING_HEADERS,
    keep: Sequence[str] = (),
    duplicates: str = "first",
    on_missing: str = "null",
) -> DataFrame | None:
    """Pick the filing columns by header text, trimmed and in upper case.

    Of repeated headers the ``first`` or ``last`` counts. A missing column becomes NULL, or
    with ``on_missing="skip"`` the whole table is refused (None). Columns in ``keep`` pass.
    """
    at: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        key = (name or "").strip().upper()
        if duplicates == "last" or key not in at:
            at[key] = i
    wanted = {name: at.get(header.upper()) for name, header in headers.items()}
    if on_missing == "skip" and None in wanted.values():
        return None
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    kept = {c: df.columns.index(c) for c in keep}
    return numbered.select(
        *[(F.lit(None) if i is None else F.col(f"_{i}")).cast("string").alias(name)
          for name, i in wanted.items()],
        *[F.col(f"_{i}").alias(c) for c, i in kept.items()])


def read_filings(
    spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **with_columns
) -> DataFrame | None:
    """Filings of several files in their order of priority; absent files are left out.

    ``file_priority`` is the place in ``paths``, ``row_ordinal`` the row's place in the file.
    Every CSV file and workbook at a path is read by its own header. CSV and Parquet count rows per file; CSV is ordered by block and place in the block.
    """
    parts = []
    required = FILING_HEADERS if with_columns.get("on_missing") == "skip" else {}
    required = with_columns.get("headers", required) if required else {}
    for priority, path in enumerate(paths):
        if not exists(spark, path):
            warnings.warn(f"no file at {path}, left out", stacklevel=2)
            continue
        for raw in _with_row_order(spark, path, fmt, with_columns.get("duplicates", "first"), list(required.values())):
            picked = with_filing_columns(raw, keep=("row_ordinal",), **with_columns)
            if picked is not None:
                parts.append(picked.withColumn("file_priority", F.lit(priority)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def _with_row_order(spark: SparkSession, path: str, fmt: str, duplicates: str, required: list[str]) -> list[DataFrame]:
    """The rows at ``path`` with their order, one table for every header that files there have."""
    if fmt == "parquet":
        return [spark.read.parquet(path).withColumn("row_ordinal", F.struct(
            F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")))]
    if fmt == "csv":
        return [_csv(spark, header, files) for header, files in csv_headers(spark, path).items()]
    if fmt == "workbook":
        from .workbook import read_workbooks

        return [read_workbooks(spark, path, duplicates, required)]
    raise ValueError(f"unknown format {fmt}")


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files at a path by their header, from the first line of each.

    Files are listed here as Spark would; only their first lines are read.
    """
    files = spark.read.text(path).inputFiles()
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found: dict[tuple[str, ...], list[str]] = {}
    for name in sorted(files):
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = file.getFileSystem(conf).open(file)
        try:
            codec = codecs.getCodec(file)
            plain = codec.createInputStream(stream) if codec is not None else stream
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
        finally:
            stream.close()
        if line:
            header = next(csv.reader([line.removeprefix("\ufeff")], escapechar="\\", doublequote=False))
            found.setdefault(tuple(header), []).append(file.toString())
    if not found:
        raise ValueError(f"no header in {path}")
    return found


def _csv(spark: SparkSession, header: tuple[str, ...], files: list[str]) -> DataFrame:
    # Spark renames repeated headers, so columns are numbered first.
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    # Ids rise along a block, and blocks are told apart by where they start.
    rows = spark.read.csv(files, header=True, schema=schema)
    return rows.withColumn("row_ordinal", F.struct(
        F.concat_ws("#", "_metadata.file_name", F.lpad(
            F.col("_metadata.file_block_start").cast("string"), 20, "0")).alias("file"),
        F.monotonically_increasing_id().alias("place"))
    ).toDF(*header, "row_ordinal")


def read_folder(spark: SparkSession, folder: str, pattern: str, fmt: str = "parquet") -> DataFrame:
    """All files of a folder whose name fits, with the name as ``file_name``."""
    if not exists(spark, f"{folder.rstrip('/')}/{pattern}"):
        raise FileNotFoundError(f"no {pattern} in {folder}")
    reader = spark.read.format(fmt).option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=False)
    return reader.load(folder).withColumn("file_name", F.col("_metadata.file_name"))


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """Curated alias lines with their place in the file; no file gives no lines."""
    if not exists(spark, path):
        return spark.createDataFrame([], CURATED_SCHEMA).withColumn("line_no", F.lit(None).cast("long"))
    rows = spark.read.csv(path, header=True, schema=CURATED_SCHEMA)
    return rows.withColumn("line_no", F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")))


def read_intake_csv(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three intake outputs as all-text tables; all of them have to be there."""
    names = ("employers", "employer_job_levels", "employer_aliases")
    paths = {n: f"{folder.rstrip('/')}/{n}.csv" for n in names}
    absent = [p for p in paths.values() if not exists(spark, p)]
    if absent:
        raise FileNotFoundError(f"run intake first, missing: {', '.join(absent)}")
    # Quotes are doubled inside quoted texts, as spreadsheet programs write them.
    reader = spark.read.options(header=True, inferSchema=False, multiLine=True, escape='"')
    return {n: reader.csv(p) for n, p in paths.items()}


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A stored table from a database that the cluster can reach."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
