"""The whole intake: raw filings in, three tables and a run summary out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..config import FILE_ORDER
from ..operators import aliases as alias_ops
from ..operators import intake, merge
from ..operators.materialize import materialize
from ..sources import sinks, tables


@dataclass(frozen=True)
class Intake:
    cases: DataFrame
    employers: DataFrame
    job_levels: DataFrame
    aliases: DataFrame
    summary: DataFrame


def build(
    raw: DataFrame, curated: DataFrame | None = None, order: Sequence[str] = FILE_ORDER
) -> Intake:
    """Clean the filings once and derive all outputs from the written cases."""
    cases = materialize(intake.clean_cases(raw, order), "cases")
    aliases = intake.aliases(cases)
    if curated is not None:
        aliases = alias_ops.merge_curated(aliases, alias_ops.curated_aliases(curated))
    return Intake(
        cases=cases,
        employers=intake.sort_employers(intake.employers(cases)),
        job_levels=intake.sort_job_levels(intake.job_levels(cases)),
        aliases=intake.sort_aliases(aliases),
        summary=intake.summary(intake.file_counters(raw), cases, aliases))


def export(built: Intake, folder: str) -> None:
    """The three outputs as CSV folders."""
    base = folder.rstrip("/")
    sinks.write_csv(built.employers, f"{base}/employers.csv", sinks.EMPLOYER_CSV)
    sinks.write_csv(built.job_levels, f"{base}/employer_job_levels.csv", sinks.JOB_LEVEL_CSV)
    sinks.write_csv(built.aliases, f"{base}/employer_aliases.csv", sinks.ALIAS_CSV)


def load(spark: SparkSession, csv_folder: str, store: str, run_ts: datetime) -> None:
    """Load exported CSVs: employers are merged, the other two tables replaced as a whole.

    All three inputs are checked before anything is written; each table becomes a new run of
    ``run_ts``, so rows that an export no longer has are gone from the newest run.
    """
    rows = tables.read_intake_csv(spark, csv_folder)
    base = store.rstrip("/")
    sinks.upsert_employers(
        spark, f"{base}/employers", merge.typed_employers(rows["employers"], run_ts), run_ts)
    for name, typed in (
        ("employer_job_levels", merge.typed_job_levels), ("employer_aliases", merge.typed_aliases)):
        sinks.write_run(typed(rows[name]), f"{base}/{name}", run_ts)
