"""Running totals, limits, bursts, attempts and their streams."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from filingmill.checks import queries
from filingmill.config import CHECK_LIMITS, Limits
from filingmill.operators import attempts, listings, prefix, requests, running
from filingmill.streaming import events as streams
from filingmill.streaming.batches import Batches

T0 = datetime(2025, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(
        [(i, k, T0 + timedelta(seconds=s), f) for i, (k, s, f) in enumerate(rows)],
        "event_id long, card_id string, ts timestamp, failed boolean")


def random_events(seed, n=600):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(rng.choice(keys), rng.randint(0, 4000), rng.random() < 0.7) for _ in range(n)]


@pytest.mark.parametrize("span", [1, 7, 100_000])
def test_prefix_does_not_depend_on_chunks(spark, span):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([None, 1, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k string, v long")
    got = prefix.running_sum(
        df, ["k"], F.floor(F.col("i") / span), ["i"], {"s": F.col("v"), "n": F.lit(1)}).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [v for i, k, v in rows if k == r.k and i <= r.i]
        assert r.s == sum(v or 0 for v in seen) and r.n == len(seen)


def test_batches_and_progress(spark):
    df = spark.range(0, 1000, 3).withColumn("embedding", F.lit(None))
    out = running.batches(df, "id", 10, span=17)
    rows = out.orderBy("id").collect()
    assert [r.row_no for r in rows] == list(range(1, 335))
    assert rows[9].batch_no == 1 and rows[10].batch_no == 2
    last = running.batch_progress(out, F.lit(5), 0.02, span=4).orderBy(F.desc("batch_no")).first()
    assert (last.rows_so_far, last.tokens_so_far) == (334, 1670)


def test_limits_admit_first_come(spark):
    rows = [("c", i // 3, False) for i in range(130)] + [("d", i * 20, False) for i in range(10)]
    log = events(spark, rows).withColumnRenamed("card_id", "client")
    out = requests.rate_limit(log, CHECK_LIMITS).groupBy("client").agg(
        F.count_if(F.col("refused_by").isNull()).alias("ok"), F.count_if(F.col("refused_by") == 1).alias("no"))
    assert {(r.client, r.ok, r.no) for r in out.collect()} == {("c", 120, 10), ("d", 10, 0)}
    # The second limit counts what the first one let through.
    twice = requests.rate_limit(log.where("client = 'c'"), Limits((("10 seconds", 20), ("1 hour", 50))))
    refused = [r.refused_by for r in twice.orderBy("event_id").collect()]
    assert refused.count(None) == 50 and refused[20:30] == [1] * 10 and refused[-1] == 2
    assert refused.count(2) == 40


def plain_bursts(rows, gap):
    out, by = [], {}
    for k, s, _ in sorted(rows, key=lambda r: r[1]):
        if k in by and s - by[k][1] < gap:
            by[k][1], by[k][2] = s, by[k][2] + 1
        else:
            by[k] = [s, s, 1]
            out.append((k, by[k]))
    return sorted((str(k), b[0], b[1], b[2]) for k, b in out)


@pytest.mark.parametrize("chunk_gaps", [1, 5, 1 << 16])
def test_bursts(spark, chunk_gaps):
    rows = random_events(1)
    got = requests.bursts(events(spark, rows), "card_id", 10.0, chunk_gaps=chunk_gaps).collect()
    at = lambda t: int((t - T0).total_seconds())
    assert sorted((str(r.card_id), at(r.burst_start), at(r.burst_end), r.events) for r in got) == plain_bursts(rows, 10)
    assert all(r.fires_at - r.burst_end == timedelta(seconds=10) for r in got)


def plain_abandoned(rows, n):
    state = {}
    for i, (k, s, failed) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        run, up = state.get(k, (0, None))
        run = run + 1 if failed else 0
        state[k] = (run, i if up is None and run >= n else up)
    return {k: up for k, (_, up) in state.items()}


@pytest.mark.parametrize("chunk", [None, "minute", "day"])
def test_abandoned(spark, chunk):
    rows = random_events(9)
    out = attempts.abandoned(events(spark, rows), F.col("failed"), max_attempts=8, chunk=chunk).collect()
    assert {r.card_id: r.abandoned_event_id for r in out} == plain_abandoned(rows, 8)
    assert sum(r.attempts for r in out) == len(rows)


def drain(stream, spark, tmp_path):
    q = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
         .option("path", str(tmp_path / "o")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "o")).collect()


def test_abandoned_stream_over_several_batches(spark, tmp_path):
    rows = [(k or "none", s, f) for k, s, f in sorted(random_events(4, 400), key=lambda r: r[1])]
    every = events(spark, rows)
    for i in range(4):
        every.where(F.col("event_id").between(i * 100, i * 100 + 99)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = (spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
    out = drain(streams.abandoned_cards(stream, F.col("failed"), max_attempts=6), spark, tmp_path)
    want = {k: up for k, up in plain_abandoned(rows, 6).items() if up is not None}
    assert {r.card_id: r.abandoned_event_id for r in out} == want and want


def in_files(spark, every, where, folder):
    """``every`` as a stream of one batch per condition."""
    for i, rows in enumerate(where):
        every.where(rows).coalesce(1).write.parquet(f"{folder}/{i}")
    return (spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(str(folder)))


def shuffled_batches(spark, rows, folder, batches, late):
    """Events dealt to batches by a time that is up to ``late`` seconds after their own."""
    arrives = [(i, s + (i * 7919) % (late + 1)) for i, (_, s, _) in enumerate(rows)]
    order = [i for i, _ in sorted(arrives, key=lambda a: a[1])]
    size = -(-len(order) // batches)
    cut = [order[a:a + size] for a in range(0, len(order), size)]
    return in_files(spark, events(spark, rows), [F.col("event_id").isin(c) for c in cut], folder)


@pytest.mark.parametrize("late", [0, 60])
def test_bursts_of_a_stream(spark, tmp_path, late):
    rows = random_events(5, 400)
    stream = shuffled_batches(spark, rows, tmp_path / "in", 9, late)
    out = str(tmp_path / "out")
    streams.write_bursts(stream, "card_id", "10 seconds", out, str(tmp_path / "c"), lateness=f"{late} seconds").awaitTermination()
    got = streams.current_bursts(spark, out, "card_id", "10 seconds").collect()
    at = lambda t: int((t - T0).total_seconds())
    assert sorted((str(r.card_id), at(r.burst_start), at(r.burst_end), r.events) for r in got) == plain_bursts(rows, 10)
    # Ended bursts have left the open ones, and the state of old batches is gone.
    assert Batches(spark, f"{out}/closed").read().count() > len(got) / 2
    assert len(Batches(spark, f"{out}/open/rows").finished()) == 2


def test_merged_bursts_reach_over_chunks(spark):
    rng = random.Random(8)
    items = []
    for _ in range(300):
        start = rng.randrange(3000)
        items.append((rng.choice("ab"), start, start + rng.choice([0, 0, 3, 200]), 1))
    df = spark.createDataFrame(items, "k string, first long, last long, events long")
    want = []
    for k in "ab":
        open_ = None
        for _, a, b, n in sorted(x for x in items if x[0] == k):
            if open_ and a - open_[2] < 10:
                open_ = [k, open_[1], max(open_[2], b), open_[3] + n]
                want[-1] = open_
            else:
                open_ = [k, a, b, n]
                want.append(open_)
    for chunk in (1, 3, 1 << 16):
        got = requests.merged_bursts(df, "k", 10, chunk).select("k", "first", "last", "events").collect()
        assert sorted(map(list, got)) == sorted(want)


@pytest.mark.parametrize("late,batches", [(0, 4), (90, 10)])
def test_abandoned_over_written_tables(spark, tmp_path, late, batches):
    rows = [(k or "none", s, f) for k, s, f in random_events(11, 500)]
    stream = shuffled_batches(spark, rows, tmp_path / "in", batches, late)
    out = str(tmp_path / "out")
    streams.write_abandoned(
        stream, F.col("failed"), out, str(tmp_path / "c"), max_attempts=6, lateness=f"{late} seconds").awaitTermination()
    got = streams.current_abandoned(spark, out, max_attempts=6).collect()
    want = {k: up for k, up in plain_abandoned(rows, 6).items() if up is not None}
    assert {r.card_id: r.abandoned_event_id for r in got} == want and want and len(got) == len(want)


def test_first_events_of_a_stream(spark, tmp_path):
    rows = random_events(6, 300)
    stream = shuffled_batches(spark, rows, tmp_path / "in", 10, 1000)
    streams.write_unseen(stream, ["card_id", "failed"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = Batches(spark, str(tmp_path / "out")).read().select("card_id", "failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted({(k, f) for k, _, f in rows}, key=str)
    near = in_files(spark, events(spark, rows), ["event_id < 150", "event_id >= 150"], tmp_path / "again")
    streams.write_unseen(near, ["card_id"], str(tmp_path / "o2"), str(tmp_path / "c2"), within="1 day").awaitTermination()
    assert Batches(spark, str(tmp_path / "o2")).read().count() == len({k for k, _, _ in rows})


def test_segments_are_merged_and_read_whole(spark, tmp_path):
    def newest(rows):
        return rows.groupBy("k").agg(F.max("v").alias("v"))

    table = Batches(spark, str(tmp_path / "t"), newest, fan=3)
    assert table.read() is None and table.last() is None
    for i in range(20):
        table.write(spark.createDataFrame([(i % 4, i), (9, i)], "k int, v int"), i)
        if i == 10:
            # A batch that is run again, as after a failure, and a segment that was never finished.
            table.write(spark.createDataFrame([(i % 4, i), (9, i)], "k int, v int"), i)
            (tmp_path / "t" / "0-26").mkdir()
        assert dict(map(tuple, newest(table.read()).collect())) == {
            9: i, **{k: max(j for j in range(i + 1) if j % 4 == k) for k in range(min(4, i + 1))}}
        assert len(table.segments()) <= 6
    assert table.segments() == [(0, 8), (9, 17), (18, 18), (19, 19)] and table.last() == 19
    assert table.segments(below=8)[-1][1] == 7 or table.segments(below=9) == [(0, 8)]
    assert dict(map(tuple, newest(table.read(below=18)).collect()))[9] == 17


def test_known_names_in_a_stream(spark, tmp_path):
    from filingmill.streaming.names import match_known

    spark.createDataFrame([("acme inc.",), ("acme",), ("?",), (" ",)], "raw_name string").write.parquet(str(tmp_path / "in"))
    emp = spark.createDataFrame(
        [("ACME INC", 4, None, None, 2024, True)],
        "employer_name string, total_h1b_certified int, earliest_decision_date date, latest_decision_date date, "
        "last_active_year int, h1b_dependent boolean")
    aliases = spark.createDataFrame([("ACME INC", "ACME", 1)], "primary_employer_name string, alias_name string, usage_count int")
    stream = spark.readStream.schema("raw_name string").parquet(str(tmp_path / "in"))
    out = drain(match_known(stream, emp, aliases), spark, tmp_path)
    assert {(r.raw_name, r.match_type, r.employer_name) for r in out} == {
        ("acme inc.", "exact", "ACME INC"), ("acme", "alias", "ACME INC"), ("?", None, None), (" ", "invalid_input", None)}


def card(spark, lines):
    return spark.createDataFrame(lines, "card_id int, depth int, line_no int, line_text string")


def test_company_line_of_a_row(spark):
    lines = card(spark, [
        (1, 0, 0, "Staff software engineer, payments"), (1, 0, 1, "Acme Corp"), (1, 0, 2, "Austin, TX"),
        # The first fitting line is the longest one, so the next fitting line counts.
        (2, 0, 0, "A very long name of something"), (2, 0, 1, "Beta"), (2, 0, 2, "Beta"), (2, 0, 3, "Gamma"),
        (3, 0, 0, "Only line"),
        (4, 0, 0, "Software developer"), (4, 1, 0, "Software developer"), (4, 1, 1, "Delta"),
        (5, 0, 0, "Software developer"), *[(5, 1, i, f"Line {i}") for i in range(7)]])
    got = {r.card_id: r.name for r in listings.line_candidates(lines).collect()}
    # Card 4 is read from the row around it; around card 5 there are too many lines.
    assert got == {1: "Acme Corp", 2: "Beta", 4: "Delta"}


def test_candidates_in_order_of_trust(spark):
    links = spark.createDataFrame(
        [(1, 0, "https://www.linkedin.com/company/acme-inc", "", False),
         (1, 1, "https://www.linkedin.com/company/other", "Link Name", True),
         (2, 0, "https://www.linkedin.com/company/beta-co", None, False)],
        "card_id int, link_no int, href string, link_text string, in_block boolean")
    best = {r.card_id: r.company_name for r in listings.best_candidate(listings.link_candidates(links)).collect()}
    assert best == {1: "Link Name", 2: "beta co"}
    blocks = spark.createDataFrame([(2, "Block Name · Austin, TX")], "card_id int, text string")
    detail = {r.card_id: r.company_name for r in listings.best_candidate(
        listings.link_candidates(links), listings.detail_candidates(links, blocks)).collect()}
    assert detail == {1: "Link Name", 2: "Block Name"}
    texts = spark.createDataFrame([(2, 0, "Primary One\nAustin, TX")], "card_id int, ord int, text string")
    names = listings.text_candidates(texts, listings.PRIMARY).collect()
    assert [r.name for r in names] == ["Primary One"]


def test_misses_are_appended_and_cut(spark, tmp_path):
    spark.createDataFrame([(1, "u", "x" * 900), (2, "u", None)], "card_id int, url string, html string").write.parquet(
        str(tmp_path / "in"))
    stream = spark.readStream.schema("card_id int, url string, html string").parquet(str(tmp_path / "in"))
    streams.write_misses(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "o")).orderBy("card_id").collect()
    assert [len(r.html) for r in rows] == [500, 0]


def test_seen_keys_are_not_gathered_on_the_driver(spark, tmp_path, monkeypatch):
    """However small the written keys look on disk, a batch meets them in a shuffle."""
    plans, write = [], Batches.write

    def noted(self, rows, batch_id):
        plans.append(rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple"))
        write(self, rows, batch_id)

    monkeypatch.setattr(Batches, "write", noted)
    for i, keys in enumerate(([1, 2, None], [2, 3, None])):
        spark.createDataFrame([(k, "a") for k in keys], "k long, e string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = (spark.readStream.schema("k long, e string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
    streams.write_unseen(stream, ["k", "e"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(Batches(spark, str(tmp_path / "out")).read().collect(), key=str) == sorted(
        spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (None, "a")], "k long, e string").collect(), key=str)
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def table_of_files(spark, folder, n, files=8):
    """An events table of several files, each from the whole range of time."""
    rng = random.Random(12)
    rows = [(i, T0 + timedelta(seconds=rng.randrange(20 * 86400)), rng.randrange(20), rng.choice(["purchase", "error", "view"]))
            for i in range(n)]
    rows.append((n, None, 3, "error"))
    every = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    for i in range(files):
        every.where(F.col("event_id") % files == i).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return [r for r in rows if r[1] is not None]


def run_in(folder, monkeypatch, name, spark):
    """The rows of a stream query, and how many batches it took."""
    monkeypatch.setattr(queries, "_run_dir", lambda *_: f"{folder}/run")
    out = queries.QUERIES[name](spark, str(folder)).collect()
    return out, len([p for p in (folder / "run/checkpoint/commits").iterdir() if p.suffix != ".crc"])


def micros(t, span):
    seconds = int((t - datetime(1970, 1, 1)).total_seconds())
    return (seconds - seconds % span) * 1_000_000


def test_batches_of_stats_do_not_follow_the_files(spark, tmp_path, monkeypatch):
    rows = table_of_files(spark, tmp_path, 200)
    got, batches = run_in(tmp_path, monkeypatch, "stream_stats", spark)
    want = Counter((u % 5, micros(t, 3600)) for _, t, u, _ in rows)
    bought = Counter((u % 5, micros(t, 3600)) for _, t, u, kind in rows if kind == "purchase")
    assert sorted(map(tuple, got)) == sorted((*k, n, bought[k]) for k, n in want.items())
    assert batches == 4


def test_late_events_of_many_files_are_not_lost(spark, tmp_path, monkeypatch):
    """A part is one batch, so its own files never make each other late."""
    rows = table_of_files(spark, tmp_path, 400)
    got, batches = run_in(tmp_path, monkeypatch, "stream_bursts", spark)
    assert sum(r.events for r in got) == len(rows) and batches == 4


def test_batches_of_limits_do_not_follow_the_files(spark, tmp_path, monkeypatch):
    rows = table_of_files(spark, tmp_path, 200)
    got, batches = run_in(tmp_path, monkeypatch, "stream_limits", spark)
    want = Counter(
        (u % 10, no, micros(t, span), allowed) for _, t, u, _ in rows for no, span, allowed in ((1, 3600, 2), (2, 86400, 5)))
    # The event without a time is counted on its own.
    want.update([(3, 1, None, 2), (3, 2, None, 5)])
    assert sorted(map(tuple, got), key=str) == sorted(
        ((u, no, start, n, n > allowed) for (u, no, start, allowed), n in want.items()), key=str)
    assert batches == 4
