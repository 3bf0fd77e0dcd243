"""Writing results: CSV exports, table snapshots, appended reports, databases."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import CURATED_ALIAS
from ..operators import merge
from ..operators.aliases import replace_scope

# Column order of the exports.
EMPLOYER_CSV = (
    "employer_name", "total_h1b_certified", "earliest_decision_date",
    "latest_decision_date", "last_active_year", "h1b_dependent")
JOB_LEVEL_CSV = (
    "employer_name", "normalized_job_title", "soc_code",
    "level_1_count", "level_2_count", "level_3_count", "level_4_count", "total_count",
    "level_1_pct", "level_2_pct", "level_3_pct", "level_4_pct")
ALIAS_CSV = ("primary_employer_name", "alias_name", "alias_type", "usage_count")

BATCH_ROWS = 1000

# Columns and types of the stored tables.
TABLE_DDL = {
    "employers": """
        id BIGINT, employer_name STRING NOT NULL, total_h1b_certified INT NOT NULL,
        earliest_decision_date DATE, latest_decision_date DATE, last_active_year INT,
        h1b_dependent BOOLEAN, last_updated TIMESTAMP NOT NULL, embedding ARRAY<FLOAT>""",
    "employer_job_levels": """
        employer_name STRING NOT NULL, normalized_job_title STRING, soc_code STRING,
        level_1_count INT, level_2_count INT, level_3_count INT, level_4_count INT, total_count INT,
        level_1_pct DECIMAL(5,2), level_2_pct DECIMAL(5,2), level_3_pct DECIMAL(5,2), level_4_pct DECIMAL(5,2)""",
    "employer_aliases": """
        primary_employer_name STRING NOT NULL, alias_name STRING NOT NULL,
        alias_type STRING NOT NULL, usage_count INT NOT NULL""",
}


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """CSV with a header and fixed column order; NULL as nothing, flags as True and False."""
    flags = {f.name for f in df.schema if f.dataType.typeName() == "boolean"}
    df.select(*[
        F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if c in flags else c
        for c in columns
    ]).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def create_tables(spark: SparkSession, prefix: str = "") -> None:
    """Create the stored tables that do not exist and add a missing vector column."""
    for name, columns in TABLE_DDL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet")
    if "embedding" not in spark.table(f"{prefix}employers").columns:
        spark.sql(f"ALTER TABLE {prefix}employers ADD COLUMNS (embedding ARRAY<FLOAT>)")


def latest_run(spark: SparkSession, folder: str, before: str | None = None) -> str | None:
    """The newest finished ``run=`` folder; with ``before``, the newest one before it."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/run=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    runs = sorted(status.getPath().getParent().toString() for status in found)
    runs = [r for r in runs if before is None or r.rsplit("=", 1)[1] < before]
    return runs[-1] if runs else None


def _run_of(run_ts: datetime) -> str:
    return run_ts.strftime("%Y%m%d%H%M%S")


def write_run(df: DataFrame, folder: str, run_ts: datetime) -> str:
    """Write a whole table as a new ``run=``; readers take the newest finished one.

    Earlier runs are not touched, so a failed write leaves the last table as it was.
    """
    path = f"{folder.rstrip('/')}/run={_run_of(run_ts)}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_latest(spark: SparkSession, folder: str, before: datetime | None = None) -> DataFrame | None:
    """The newest finished run of a stored table, or None."""
    path = latest_run(spark, folder, before=_run_of(before) if before else None)
    return spark.read.parquet(path) if path else None


def upsert_employers(
    spark: SparkSession, folder: str, fresh: DataFrame, run_ts: datetime, prune: bool = False
) -> str:
    """Merge typed employers with the last stored run and write the result as a new run.

    Vectors of stored rows stay. Repeating a run starts from the same predecessor and gives
    the same table.
    """
    previous = read_latest(spark, folder, before=run_ts)
    merged = merge.with_vector_column(fresh) if previous is None else merge.upsert(
        merge.with_vector_column(previous), fresh, prune=prune)
    return write_run(merged, folder, run_ts)


def upsert_counts(spark: SparkSession, folder: str, counts: DataFrame, run_ts: datetime) -> str:
    """Merge the older counts (employer_name, h1b_count) with the last stored run and write a new one.

    A count overwrites the stored one of its employer; employers without a new count stay.
    """
    columns = ("h1b_count", "last_updated")
    fresh = counts.where("employer_name is not null").select(
        "employer_name", F.col("h1b_count").cast("long").alias("h1b_count"), F.lit(run_ts).alias("last_updated"))
    previous = read_latest(spark, folder, before=run_ts)
    return write_run(fresh if previous is None else merge.upsert(previous, fresh, replace=columns), folder, run_ts)


def replace_curated(spark: SparkSession, folder: str, fresh: DataFrame, run_ts: datetime) -> str:
    """A new run of stored aliases with other curated rows; all other types stay."""
    columns = [*ALIAS_CSV]
    previous = read_latest(spark, folder, before=run_ts)
    new = fresh.withColumn("alias_type", F.lit(CURATED_ALIAS)).select(*columns)
    merged = new if previous is None else replace_scope(previous.select(*columns), new, CURATED_ALIAS)
    return write_run(merged, folder, run_ts)


def publish(spark: SparkSession, store: str, prefix: str = "") -> None:
    """Put the newest runs into the catalog tables, which are created if they are absent."""
    create_tables(spark, prefix)
    for name in TABLE_DDL:
        current = read_latest(spark, f"{store.rstrip('/')}/{name}")
        if current is not None:
            into = spark.table(f"{prefix}{name}").schema
            current.select(*[
                (F.col(f.name) if f.name in current.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in into
            ]).write.insertInto(f"{prefix}{name}", overwrite=True)


def append_reports(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Batched insert into a database the cluster can reach."""
    (df.write.format("jdbc").mode(mode)
     .options(url=url, dbtable=table, batchsize=str(BATCH_ROWS), **options).save())
