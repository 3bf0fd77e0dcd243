"""The shape of physical plans: what reaches the scan, and what must not occur."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from filingmill.config import FILING_HEADERS
from filingmill.operators import intake

SF = "/root/testdata/sf0.001"
# One global row, or one row per chunk of a table, is all that may meet in one task.
ONE_ROW = {"employers_placed", "job_levels_placed", "aliases_placed", "merged_aliases_placed", "ann_recall", "summary_from_states", "intake_summary", "embedding_coverage", "embedding_batches"}


def plan_of(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


BATCH = sorted(q for q in registry.QUERIES if not q.startswith("stream_"))


@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_of_all_rows_and_no_single_task(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in ONE_ROW:
        assert "SinglePartition" not in plan


@pytest.fixture(scope="module")
def filings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "filings")
    types = ", ".join(f"{c} string" for c in FILING_HEADERS) + ", file_priority int, row_ordinal long"
    spark.createDataFrame([], types).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(filings):
    plan = plan_of(intake.employers(intake.clean_cases(filings)))
    scan = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "StringContains(case_status,Certified)" in scan
    assert "StringContains(visa_class,H-1B)" in scan
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "job_title" not in schema and "soc_code" not in schema


def test_dedupe_cuts_rows_before_the_shuffle(filings):
    tree = plan_of(intake.clean_cases(filings)).split("\n\n")[0]
    below = tree[tree.index("Exchange"):]
    assert "WindowGroupLimit" in below and tree.count("Exchange") == 1


def test_aggregates_combine_before_the_shuffle(filings):
    for build in (intake.job_levels, intake.aliases):
        tree = plan_of(build(intake.clean_cases(filings))).split("\n\n")[0]
        assert tree.count("HashAggregate") == 2 and tree.count("Exchange") == 2


def test_all_cases_are_hashed_for_employers(filings):
    tree = plan_of(intake.employers(intake.clean_cases(filings))).split("\n\n")[0]
    # Below the second shuffle, where rows are cases, nothing is sorted to be grouped.
    below = tree[tree.index("Exchange", tree.index("Exchange") + 1):]
    assert "SortAggregate" not in below and tree.count("HashAggregate") == 2
