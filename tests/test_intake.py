"""Intake, load and sources on small tables and files."""

from __future__ import annotations

import csv
import zipfile
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from filingmill.config import FILING_HEADERS, Embedding
from filingmill.operators import aliases as alias_ops
from filingmill.operators import intake, merge
from filingmill.operators.materialize import materialize, temporary
from filingmill.plans import embed
from filingmill.plans import intake as plan
from filingmill.sources import sinks, tables, workbook

COLUMNS = [*FILING_HEADERS, "file_priority", "row_ordinal"]


def filing(case, employer, priority=0, row=0, status="Certified", visa="H-1B", day="2025-01-02",
           title="Dev", soc="15", dba=None, level="I", dep=None):
    return (case, status, day, visa, title, soc, employer, dba, level, dep, priority, row)


def raw(spark, rows):
    types = ", ".join(f"{c} string" for c in FILING_HEADERS) + ", file_priority int, row_ordinal long"
    return spark.createDataFrame(rows, types)


ROWS = [
    filing("C1", " n/a ", 0, 0),                          # no employer: does not claim the case
    filing(" C1 ", "Acme Inc.", 0, 1, day="1/5/2025", dba="Acme", dep="Y"),
    filing("C1", "Other", 0, 2),
    filing("C1", "Earlier row, later file", 1, 0),
    filing("C2", "acme  inc", 1, 5, level="ii", dba="ACME INC", dep="N"),
    filing("C3", "Beta", 1, 6, status=" Certified ", level="x", title=None, soc="null"),
    filing("C4", "Beta", 1, 7, status="certified"),
    filing("C5", "Beta", 1, 8, visa="E-3"),
    filing(None, "Beta", 1, 9),
    filing("C6", "Beta", 0, 9, day="FY25", dep="Y", dba="Beta Trade"),
]


def test_clean_cases_do_not_depend_on_row_order(spark):
    want = None
    for parts in (1, 3, 7):
        df = raw(spark, ROWS).repartition(parts, "row_ordinal")
        got = sorted(map(tuple, intake.clean_cases(df).collect()))
        want = want or got
        assert got == want
    assert [(r[0], r[4]) for r in want] == [
        ("C1", "ACME INC"), ("C2", "ACME INC"), ("C3", "BETA"), ("C6", "BETA")]
    assert want[0][1] == "2025-01-05"


def test_aggregates(spark):
    cases = intake.clean_cases(raw(spark, ROWS))
    emp = {r.employer_name: r for r in intake.employers(cases).collect()}
    assert (emp["ACME INC"].total_h1b_certified, emp["ACME INC"].h1b_dependent) == (2, None)
    beta = emp["BETA"]
    assert (beta.earliest_decision_date, beta.latest_decision_date) == ("2025-01-02", "FY25")
    assert (beta.last_active_year, beta.h1b_dependent) == (None, True)
    levels = intake.sort_job_levels(intake.job_levels(cases)).collect()
    assert [(r.employer_name, r.soc_code, r.level_1_count, r.level_2_count, r.level_1_pct) for r in levels] == [
        ("ACME INC", "15", 1, 1, 50.0), ("BETA", "15", 1, 0, 100.0)]
    alias = intake.sort_aliases(intake.aliases(cases)).collect()
    assert [(r.primary_employer_name, r.alias_name, r.usage_count) for r in alias] == [
        ("ACME INC", "ACME", 1), ("BETA", "BETA TRADE", 1)]


def test_counters_and_summary(spark):
    df = raw(spark, ROWS)
    counters = intake.file_counters(df)
    got = {r.file_priority: (r.total_rows, r.kept_unique, r.new_cases) for r in counters.collect()}
    assert got == {0: (4, 2, 2), 1: (6, 3, 2)}
    cases = intake.clean_cases(df)
    row = intake.summary(counters, cases, intake.aliases(cases)).first()
    assert row.asDict() == {
        "rows_scanned": 10, "rows_kept": 5, "unique_cases": 4, "employers": 2, "job_titles": 1,
        "unparsed_dates": 1, "aliases": 2}


def test_simple_counts(spark):
    counts = {r.employer_name: r.h1b_count for r in intake.simple_counts(raw(spark, ROWS)).collect()}
    # Any visa class, every copy; names are only stripped and put in upper case.
    assert counts == {"N/A": 1, "ACME INC.": 1, "OTHER": 1, "EARLIER ROW, LATER FILE": 1,
                      "ACME  INC": 1, "BETA": 3}


def test_curated_overrides(spark):
    auto = spark.createDataFrame(
        [("A", "X INC.", "TRADE_NAME_DBA", 3), ("A", "Y", "TRADE_NAME_DBA", 2)],
        "primary_employer_name string, alias_name string, alias_type string, usage_count long")
    lines = spark.createDataFrame(
        [(1, "Old", "x inc", None, None), (2, "New Co.", "x  inc.", " ", "4"), (3, "", "z", None, None)],
        "line_no int, primary_employer_name string, alias_name string, alias_type string, usage_count string")
    merged = alias_ops.merge_curated(auto, alias_ops.curated_aliases(lines))
    assert sorted(map(tuple, merged.collect())) == [
        ("A", "Y", "TRADE_NAME_DBA", 2), ("NEW CO", "X INC", "", 4)]


def test_upsert_is_idempotent_and_keeps_vectors(spark):
    columns = "employer_name string, total_h1b_certified int, last_updated string, embedding array<float>"
    stored = spark.createDataFrame([("A", 1, "old", [1.0]), ("B", 2, "old", [2.0])], columns)
    fresh = spark.createDataFrame([("B", 5, "new"), ("C", 7, "new")],
                                  "employer_name string, total_h1b_certified int, last_updated string")
    replace = ("total_h1b_certified", "last_updated")
    once = merge.upsert(stored, fresh, replace=replace)
    want = [("A", 1, "old", [1.0]), ("B", 5, "new", [2.0]), ("C", 7, "new", None)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, merge.upsert(once, fresh, replace=replace).collect())) == want
    pruned = merge.upsert(stored, fresh, replace=replace, prune=True)
    assert sorted(map(tuple, pruned.collect())) == want[1:]


def write_lines(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)


def test_files_in_order_and_headers(spark, tmp_path):
    write_lines(tmp_path / "q1.csv", [
        [" case_number", "Case_Status", "VISA_CLASS", "EMPLOYER_NAME", "employer_name"],
        ["C1", "Certified", "H-1B", "First", "Second"], ["C1", "Certified", "H-1B", "Late", "Late"]])
    write_lines(tmp_path / "q2.csv", [["CASE_NUMBER", "VISA_CLASS"], ["C2", "H-1B"]])
    paths = [str(tmp_path / n) for n in ("q1.csv", "absent.csv", "q2.csv")]
    with pytest.warns(UserWarning, match="absent"):
        df = tables.read_filings(spark, paths, "csv")
    assert df.select("case_number", "employer_name", "file_priority", "job_title").orderBy(
        "file_priority", "row_ordinal").collect()[0][:] == ("C1", "First", 0, None)
    assert [r.employer_name for r in intake.clean_cases(df).collect()] == ["FIRST"]
    older = {"employer_name": "EMPLOYER_NAME", "case_status": "CASE_STATUS"}
    strict = tables.read_filings(
        spark, [paths[0], paths[2]], "csv", headers=older, duplicates="last", on_missing="skip")
    assert [r.employer_name for r in strict.orderBy("row_ordinal").collect()] == ["Second", "Late"]


def test_folder_and_curated_sources(spark, tmp_path):
    for n in ("b.csv", "a.csv"):
        write_lines(tmp_path / n, [["x"], [n]])
    rows = tables.read_folder(spark, str(tmp_path), "*.csv", "csv").orderBy("file_name").collect()
    assert [(r.x, r.file_name) for r in rows] == [("a.csv", "a.csv"), ("b.csv", "b.csv")]
    with pytest.raises(FileNotFoundError):
        tables.read_folder(spark, str(tmp_path), "*.xlsx")
    write_lines(tmp_path / "cur", [
        ["primary_employer_name", "alias_name", "alias_type", "usage_count"],
        ["META, INC", "FB", "MANUAL_CURATED", "0"], ["LAST", "FB", "", ""]])
    curated = alias_ops.curated_aliases(tables.read_curated(spark, str(tmp_path / "cur")))
    assert list(map(tuple, curated.collect())) == [("LAST", "FB", "MANUAL_CURATED", 0)]
    assert tables.read_curated(spark, str(tmp_path / "none")).count() == 0


def make_workbook(path, header, rows):
    """A small workbook with shared, inline, number, flag and date cells."""
    texts: list[str] = []

    def cell(col, row, v):
        ref = f"{chr(65 + col)}{row}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, date):
            return f'<c r="{ref}" s="1"><v>{(v - date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if v.startswith("inline:"):
            return f'<c r="{ref}" t="inlineStr"><is><t>{v[7:]}</t></is></c>'
        texts.append(v)
        return f'<c r="{ref}" t="s"><v>{len(texts) - 1}</v></c>'

    body = "".join(
        f'<row r="{i}">' + "".join(cell(c, i, v) for c, v in enumerate(r)) + "</row>"
        for i, r in enumerate([header, *rows], 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><bookViews><workbookView activeTab="1"/>'
                   '</bookViews><sheets><sheet name="x" sheetId="1" r:id="r1"/><sheet name="y" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")


def test_workbooks_end_to_end(spark, tmp_path):
    header = ["CASE_NUMBER", " case_status ", "VISA_CLASS", "DECISION_DATE", "EMPLOYER_NAME", "SOC_CODE", None]
    make_workbook(tmp_path / "q1.xlsx", header, [
        ["C1", "Certified", "H-1B", date(2025, 1, 31), "inline:Acme Inc.", 15, True],
        ["C1", "Certified", "H-1B", None, "Late", None, None]])
    make_workbook(tmp_path / "q2.xlsx", header, [["C2", "Certified", "H-1B", "2/1/2025", None, "x"],
                                                 ["C3", "Certified", "H-1B", "2/1/2025", "Beta", None]])
    rows = list(workbook.sheet_rows((tmp_path / "q1.xlsx").read_bytes()))
    assert rows[1] == ["C1", "Certified", "H-1B", "2025-01-31", "Acme Inc.", "15", "True"]
    df = tables.read_filings(spark, [str(tmp_path / "q1.xlsx"), str(tmp_path / "q2.xlsx")], "workbook")
    cases = {r.case_number: (r.employer_name, r.decision_date, r.soc_code) for r in intake.clean_cases(df).collect()}
    assert cases == {"C1": ("ACME INC", "2025-01-31", "15"), "C3": ("BETA", "2025-02-01", None)}


def test_build_export_load(spark, tmp_path):
    out, store = str(tmp_path / "out"), str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        plan.load(spark, out, store, datetime(2025, 1, 1))
    built = plan.build(raw(spark, [*ROWS, filing("C9", 'Quote "Q", Inc', 1, 20, dba="Q,1")]))
    plan.export(built, out)
    for ts in (datetime(2025, 1, 1), datetime(2025, 2, 1), datetime(2025, 2, 1)):
        plan.load(spark, out, store, ts)
    current = spark.read.parquet(sinks.latest_run(spark, f"{store}/employers"))
    rows = {r.employer_name: r for r in current.collect()}
    assert set(rows) == {"ACME INC", "BETA", 'QUOTE "Q", INC'}
    assert rows["ACME INC"].earliest_decision_date == date(2025, 1, 2)
    assert rows["BETA"].h1b_dependent is True and rows["BETA"].embedding is None
    assert {r.last_updated for r in rows.values()} == {datetime(2025, 2, 1)}
    aliases = f"{store}/employer_aliases"
    assert {(r.alias_name, r.alias_type) for r in sinks.read_latest(spark, aliases).collect()} == {
        ("ACME", "TRADE_NAME_DBA"), ("BETA TRADE", "TRADE_NAME_DBA"), ("Q,1", "TRADE_NAME_DBA")}
    fresh = spark.createDataFrame([("M", "FB", 0)], "primary_employer_name string, alias_name string, usage_count int")
    for _ in range(2):
        sinks.replace_curated(spark, aliases, fresh, datetime(2025, 3, 1))
    assert sinks.read_latest(spark, aliases).count() == 4
    # A later load is the whole truth: the curated row is gone.
    plan.load(spark, out, store, datetime(2025, 4, 1))
    assert sinks.read_latest(spark, aliases).count() == 3
    sinks.publish(spark, store, "published_")
    try:
        assert spark.table("published_employers").count() == 3 and spark.table("published_employer_aliases").count() == 3
    finally:
        for name in sinks.TABLE_DDL:
            spark.sql(f"DROP TABLE published_{name}")


def test_store_is_filled_once_per_name(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def embed_fn(texts):
        with open(asked, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    store, cfg = str(tmp_path / "employers"), Embedding(dim=2, batch=2)
    with pytest.raises(FileNotFoundError):
        embed.fill_store(spark, store, embed_fn, datetime(2025, 1, 2), cfg)
    rows = spark.createDataFrame([(n, "1", "", "", "", "") for n in ("A", "BB", "CCC")], [*sinks.EMPLOYER_CSV])
    sinks.upsert_employers(spark, store, merge.typed_employers(rows, datetime(2025, 1, 1)), datetime(2025, 1, 1))
    embed.fill_store(spark, store, embed_fn, datetime(2025, 1, 2), cfg, limit=2)
    assert {r.employer_name for r in sinks.read_latest(spark, store).where("embedding is null").collect()} == {"CCC"}
    embed.fill_store(spark, store, embed_fn, datetime(2025, 1, 3), cfg)
    assert {r.employer_name: r.embedding[0] for r in sinks.read_latest(spark, store).collect()} == {"A": 1, "BB": 2, "CCC": 3}
    with open(asked) as f:
        assert sorted(f.read().split()) == ["A", "BB", "CCC"]


def test_tables_are_created_once(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS t1")
    try:
        for _ in range(2):
            sinks.create_tables(spark, "t1.")
        assert "embedding" in spark.table("t1.employers").columns
    finally:
        spark.sql("DROP DATABASE t1 CASCADE")


def test_materialized_copy_is_read_from_the_shared_folder(spark):
    df = materialize(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert df.count() == 5 and all(folder in f for f in df.inputFiles())


def test_temporary_copies_are_deleted(spark):
    import os

    with temporary(spark):
        df = materialize(spark.range(3), "gone")
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_pending_vectors_by_id(spark):
    df = spark.createDataFrame([(3, "C", None), (1, "A", [1.0]), (2, "B", None)],
                               "id int, employer_name string, embedding array<float>")
    assert [r.id for r in merge.pending(df, 1).collect()] == [2]
    assert merge.pending(df).count() == 2
    assert merge.coverage(df).first().pending == 2


def test_another_threads_copies_stay(spark):
    import threading

    kept, ready, done = [], threading.Event(), threading.Event()

    def other():
        ready.wait(60)
        kept.append(materialize(spark.range(4), "kept"))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with temporary(spark):
        materialize(spark.range(3), "gone")
        ready.set()
        assert done.wait(60)
    thread.join()
    assert kept[0].count() == 4


def test_workbooks_are_read_by_their_own_headers(spark, tmp_path):
    make_workbook(tmp_path / "a.xlsx", ["CASE_NUMBER", "EMPLOYER_NAME", "case_number"], [["C1", "Alpha", "last"]])
    make_workbook(tmp_path / "b.xlsx", [" employer_name ", "Case_Number", "NEW"], [["Beta", "C2", "n"]])
    make_workbook(tmp_path / "c.xlsx", ["OTHER"], [["o"]])
    rows = workbook.read_workbooks(spark, f"{tmp_path}/*.xlsx").orderBy("row_ordinal").drop("row_ordinal")
    assert rows.columns == ["CASE_NUMBER", "EMPLOYER_NAME", "NEW", "OTHER"]
    assert list(map(tuple, rows.collect())) == [
        ("C1", "Alpha", None, None), ("C2", "Beta", "n", None), (None, None, None, "o")]
    last = workbook.read_workbooks(spark, f"{tmp_path}/*.xlsx", duplicates="last", required=["Employer_Name"])
    assert [r.CASE_NUMBER for r in last.orderBy("row_ordinal").collect()] == ["last", "C2"]
    both = tables.read_filings(spark, [f"{tmp_path}/[ab].xlsx"], "workbook")
    assert [(r.case_number, r.employer_name, r.job_title) for r in both.orderBy("row_ordinal").collect()] == [
        ("C1", "Alpha", None), ("C2", "Beta", None)]


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    import gzip

    folder = tmp_path / "some filings"
    folder.mkdir()
    (folder / "a.csv").write_text('CASE_NUMBER,"EMPLOYER_NAME"\nC1,Alpha\n')
    (folder / "b.csv").write_text("\ufeffEMPLOYER_NAME,CASE_NUMBER\nBeta,C2\n")
    (folder / "c.csv.gz").write_bytes(gzip.compress(b"employer_name,X,case_number\nGamma,x,C3\n"))
    (folder / "d.csv").write_text("")
    rows = tables.read_filings(spark, [str(folder)], "csv").orderBy("row_ordinal").collect()
    assert [(r.case_number, r.employer_name) for r in rows] == [("C1", "Alpha"), ("C2", "Beta"), ("C3", "Gamma")]


def test_runs_write_only_what_they_change(spark, tmp_path):
    from filingmill.sources.stored import StoredTable

    stored = StoredTable(spark, str(tmp_path / "t"), "k", {"values": ["a", "b"], "vector": ["v"]}, fan=3)
    with pytest.raises(ValueError):
        stored.upsert(spark.createDataFrame([("x", 1, 1)], "k string, a int, b int"))
    rows = spark.range(5000).selectExpr("concat('name ', id) as k", "int(id) as a", "int(null) as b", "array(float(id), 1f) as v")
    stored.upsert(rows)
    few = rows.where("a % 100 = 7").selectExpr("k", "a + 1 as a", "a as b")
    assert stored.upsert(few) == 1
    size = lambda run: sum(f.stat().st_size for f in (tmp_path / "t" / f"{run}-{run}").glob("*.parquet"))
    assert size(1) < 0.1 * size(0)
    now = {r.k: r for r in stored.read().collect()}
    assert len(now) == 5000 and now["name 7"].a == 8 and now["name 7"].b == 7 and list(now["name 7"].v) == [7.0, 1.0]
    # A vector for a row without one, then a repeated run, and a merge of all three.
    stored.upsert(spark.createDataFrame([("new", [2.0])], "k string, v array<float>"), run=2)
    stored.upsert(spark.createDataFrame([("new", [3.0]), (None, [1.0])], "k string, v array<float>"), run=2)
    assert stored.runs.segments() == [(0, 2)]
    now = {r.k: r for r in stored.read().collect()}
    assert len(now) == 5001 and list(now["new"].v) == [3.0] and now["new"].a is None and now["name 7"].a == 8
    assert stored.read(below=1).where("k = 'name 7'").first().a == 7


def test_counts_are_merged_by_employer(spark, tmp_path):
    counts = lambda *rows: spark.createDataFrame(rows, "employer_name string, h1b_count long")
    sinks.upsert_counts(spark, str(tmp_path), counts(("A", 1), ("B", 2), (None, 3)), datetime(2025, 1, 1))
    sinks.upsert_counts(spark, str(tmp_path), counts(("B", 5), ("C", 6)), datetime(2025, 2, 1))
    rows = sinks.read_latest(spark, str(tmp_path)).orderBy("employer_name").collect()
    assert [(r.employer_name, r.h1b_count, r.last_updated.month) for r in rows] == [("A", 1, 1), ("B", 5, 2), ("C", 6, 2)]


def test_rows_of_a_folder_are_written_by_many_tasks(spark, tmp_path):
    from filingmill.checks.queries import folder_counts
    from filingmill.operators.materialize import shared_dir
    from filingmill.sources.sample_views import view

    rows = [(i, i % 4, i % 3, 1, "F", "A", date(2024, 1 + i % 12, 1), 5.0) for i in range(400)]
    lines = spark.createDataFrame(rows, (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_linestatus string, l_returnflag string, "
        "l_shipdate date, l_quantity double"))
    lines.repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name, data, schema in (
            ("part", [(i, "p", "b", 1) for i in range(4)], "p_partkey long, p_name string, p_brand string, p_size int"),
            ("supplier", [(i, f"S{i}", 1) for i in range(3)], "s_suppkey long, s_name string, s_nationkey long"),
            ("nation", [(1, "N")], "n_nationkey long, n_name string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = set(Path(shared_dir(spark)).glob("folder-*"))
    found = folder_counts(spark, str(tmp_path)).collect()
    folder, = set(Path(shared_dir(spark)).glob("folder-*")) - before
    assert len([f for f in (folder / "rows/q1").glob("part-*") if f.stat().st_size]) > 1
    # The fourth file has a header without a column.
    named = view(spark, str(tmp_path), "lca_raw").where("file_priority < 4")
    assert found and sorted(found) == sorted(intake.simple_counts(named).collect())
