"""Raw filings -> clean cases -> employer, job-level and alias tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import AUTO_ALIAS, CERTIFIED, FILE_ORDER, VISA_CLASS
from ..functions import text


def is_case(status: str = CERTIFIED, visa: str = VISA_CLASS) -> Column:
    """Whether a raw row can become a case; cheap and telling tests first.

    ``contains`` is implied by the exact test and, unlike it, is handed to the scan. A name
    is empty after normalising exactly when it is missing before, so names need not be
    normalised here.
    """
    return (
        F.col("case_status").contains(status)
        & F.col("visa_class").contains(visa)
        & (text.strip(F.col("case_status")) == status)
        & (text.strip(F.col("visa_class")) == visa)
        & ~text.is_missing(F.col("case_number"))
        & ~text.is_missing(F.col("employer_name")))


def certified_filings(raw: DataFrame, status: str = CERTIFIED, visa: str = VISA_CLASS) -> DataFrame:
    """Rows that can become a case."""
    return raw.where(is_case(status, visa)).withColumn(
        "case_number", text.strip(F.col("case_number")))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key.

    Spark keeps one row per key in each map task before the shuffle, so a key that owns a
    large part of the table costs one row per task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def clean_cases(
    raw: DataFrame, order: Sequence[str] = FILE_ORDER, keep: Sequence[str] = ()
) -> DataFrame:
    """One normalised row per case number; the earliest file and row win.

    Fields are normalised after the dedupe, so copies cost no text work. Columns in ``keep``
    pass unchanged.
    """
    kept = first_per_key(certified_filings(raw), ["case_number"], order)
    return kept.select(
        "case_number",
        text.date_text(F.col("decision_date")).alias("decision_date"),
        text.job_title(F.col("job_title")).alias("job_title"),
        text.strip(text.present(F.col("soc_code"))).alias("soc_code"),
        text.employer_name(F.col("employer_name")).alias("employer_name"),
        text.employer_name(F.col("trade_name_dba")).alias("trade_name_dba"),
        text.wage_level(F.col("pw_wage_level")).alias("pw_wage_level"),
        text.yes_no(F.col("h1b_dependent")).alias("h1b_dependent"), *keep,
    )


def sign_as_flag(lead: Column) -> Column:
    """True for a positive lead, false for a negative one, else NULL."""
    return F.when(lead > 0, True).when(lead < 0, False)


def employers(cases: DataFrame) -> DataFrame:
    """Filing count, date range, last year and dependency vote per employer.

    Dates are compared as text, so unparsed dates take part; ISO days have the same order as
    dates and as text, so they are grouped as dates.
    """
    day = text.iso_day(F.col("decision_date"))
    # Texts that are no date are few. As grouping keys they leave fixed-width values to combine,
    # so all cases are hashed; only what is left, about a row per employer, is sorted.
    known = cases.select("employer_name", "h1b_dependent", day.alias("_day"), F.when(
        day.isNull(), F.col("decision_date")).alias("_odd"))
    parts = known.groupBy("employer_name", "_odd").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_day").alias("_first"), F.max("_day").alias("_last"),
        F.count_if("h1b_dependent").alias("_yes"), F.count_if(~F.col("h1b_dependent")).alias("_no"))
    whole = parts.groupBy("employer_name").agg(
        F.sum("_n").alias("total_h1b_certified"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        (F.sum("_yes") - F.sum("_no")).alias("_lead"), F.min("_odd").alias("_low"), F.max("_odd").alias("_high"))
    latest = F.greatest(F.col("_last").cast("string"), "_high")
    return whole.select(
        "employer_name", "total_h1b_certified",
        F.least(F.col("_first").cast("string"), "_low").alias("earliest_decision_date"),
        latest.alias("latest_decision_date"), text.year_of(latest).alias("last_active_year"),
        sign_as_flag(F.col("_lead")).alias("h1b_dependent"))


def job_levels(cases: DataFrame) -> DataFrame:
    """Wage-level counts and shares per employer, title and occupation code."""
    keys = ["employer_name", "job_title", "soc_code"]
    counts = [
        F.count_if(F.col("pw_wage_level") == level).alias(f"level_{i}_count")
        for i, level in enumerate(text.WAGE_LEVELS, 1)
    ]
    total = F.col("total_count")
    shares = [
        text.percent(F.col(f"level_{i}_count"), total).alias(f"level_{i}_pct")
        for i in range(1, 5)
    ]
    return (
        cases.where(F.col("pw_wage_level").isNotNull())
        .groupBy(*keys)
        .agg(*counts, F.count(F.lit(1)).alias("total_count"))
        .select(
            "employer_name",
            F.col("job_title").alias("normalized_job_title"),
            "soc_code",
            *[f"level_{i}_count" for i in range(1, 5)],
            "total_count",
            *shares,
        )
    )


def aliases(cases: DataFrame) -> DataFrame:
    """How often each trade name stands for each employer."""
    return (
        cases.where(F.col("trade_name_dba") != F.col("employer_name"))
        .groupBy(
            F.col("employer_name").alias("primary_employer_name"),
            F.col("trade_name_dba").alias("alias_name"),
        )
        .agg(F.lit(AUTO_ALIAS).alias("alias_type"), F.count(F.lit(1)).alias("usage_count"))
    )


def sort_employers(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("total_h1b_certified"), "employer_name")


def sort_job_levels(df: DataFrame) -> DataFrame:
    return df.orderBy(
        "employer_name", F.desc("total_count"), "normalized_job_title", "soc_code")


def sort_aliases(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("usage_count"), "alias_name", "primary_employer_name")


def simple_counts(raw: DataFrame, status: str = CERTIFIED) -> DataFrame:
    """The older count: exact status, any visa class, every filing of a non-empty name."""
    return (
        raw.where((F.col("case_status") == status) & (F.col("employer_name") != ""))
        .groupBy(text.plain_key(F.col("employer_name")).alias("employer_name"))
        .agg(F.count(F.lit(1)).alias("h1b_count"))
    )


def top_counts(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("h1b_count"), "employer_name").limit(n)


def file_counters(raw: DataFrame, file: str = "file_priority") -> DataFrame:
    """Rows read, unique cases kept and cases first seen, per file.

    Rows collapse to (file, case) pairs before they move; rows that are no case share the
    NULL case and collapse to one pair per file and task.
    """
    pairs = (
        raw.select(file, F.when(is_case(), text.strip(F.col("case_number"))).alias("case_number"))
        .groupBy("case_number", file)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most one row per file in each group.
    first = F.min(file).over(Window.partitionBy("case_number"))
    kept = F.col("case_number").isNotNull()
    return (
        pairs.withColumn("first_file", first)
        .groupBy(file)
        .agg(
            F.sum("n").alias("total_rows"),
            F.count_if(kept).alias("kept_unique"),
            F.count_if(kept & (F.col("first_file") == F.col(file))).alias("new_cases"),
        )
    )


def summary(counters: DataFrame, cases: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """One row of run totals.

    ``unparsed_dates`` counts date texts no layout fitted, which the date range sorts as text.
    """
    parts = [
        counters.agg(
            F.sum("total_rows").alias("rows_scanned"),
            F.sum("kept_unique").alias("rows_kept"),
            F.sum("new_cases").alias("unique_cases"),
        ),
        cases.agg(
            F.countDistinct("employer_name").alias("employers"),
            F.countDistinct("job_title").alias("job_titles"),
            F.count_if(~F.col("decision_date").rlike(r"^\d{4}-\d\d-\d\d$")).alias("unparsed_dates"),
        ),
        alias_rows.agg(F.count(F.lit(1)).alias("aliases")),
    ]
    names = [c for p in parts for c in p.columns]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


# Buckets of the sketches as a power of two; their counts are within a few hundredths.
SKETCH = 14


def summary_states(raw: DataFrame, file: str = "file_priority") -> DataFrame:
    """One row per file that its summary can be merged from: counts, and sketches of cases, employers and titles.

    A new file needs only its own rows read. The sketches are of the file's filings before cases
    of several files are reduced to one.
    """
    case = F.when(is_case(), text.strip(F.col("case_number")))
    name = F.when(case.isNotNull(), text.employer_name(F.col("employer_name")))
    known = raw.select(
        file, case.alias("_case"), name.alias("_employer"),
        F.when(case.isNotNull(), text.job_title(F.col("job_title"))).alias("_title"))
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(SKETCH))
    return known.groupBy(file).agg(
        F.count(F.lit(1)).alias("rows_scanned"), sketch("_case").alias("cases"),
        sketch("_employer").alias("employers"), sketch("_title").alias("job_titles"))


def summary_numbers(raw: DataFrame) -> DataFrame:
    """What ``merged_summary`` estimates, counted."""
    case = F.when(is_case(), text.strip(F.col("case_number")))
    known = raw.where(case.isNotNull())
    return known.agg(
        F.countDistinct(case).alias("exact_cases"),
        F.countDistinct(text.employer_name(F.col("employer_name"))).alias("exact_employers"),
        F.countDistinct(text.job_title(F.col("job_title"))).alias("exact_job_titles"))


def merged_summary(states: DataFrame) -> DataFrame:
    """One row of run totals from the states of any files: rows exactly, distinct numbers about."""
    about = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c)
    return states.agg(F.sum("rows_scanned").alias("rows_scanned"), about("cases"), about("employers"), about("job_titles"))
