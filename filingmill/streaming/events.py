"""Streams of requests, listing events and extraction misses.

Events later than the watermark are dropped; ten minutes unless told otherwise. Streams that have
to remember more than a window does keep it in written tables: what a batch brings is put
together with the rows it concerns by the operators of the batch side, so a hot key is cut there
like anywhere else, and nothing is held in the memory of a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import CHECK_LIMITS, Limits, Listing
from ..operators import attempts as attempts_ops
from ..operators import requests
from ..operators.attempts import logged_snippet
from ..operators.materialize import materialize, temporary
from .batches import Batches

LATENESS = "10 minutes"


def _every_batch(stream: DataFrame, step, checkpoint: str, trigger: dict | None, mode: str = "append") -> StreamingQuery:
    """Run ``step(batch, batch_id)`` for every batch; its intermediate tables go when it is done."""
    def run(batch: DataFrame, batch_id: int) -> None:
        with temporary(batch.sparkSession):
            step(batch, batch_id)

    return (stream.writeStream.outputMode(mode).foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def write_unseen(
    events: DataFrame, keys: Sequence[str], out: str, checkpoint: str, within: str | None = None,
    ts: str = "ts", trigger: dict | None = None,
) -> StreamingQuery:
    """Write the first event of each combination of keys, however the stream is cut into batches.

    What was seen is what was written: a batch is compared with the stored keys and the stream
    itself remembers nothing. With ``within``, repeats that follow each other closely are
    dropped in front by a state that lasts as long; events later than that are dropped, too.
    """
    keys = list(keys)
    if within is not None:
        events = events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
    seen = Batches(events.sparkSession, out)

    def step(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(keys)
        known = seen.read(below=batch_id)
        if known is not None:
            same = reduce(lambda a, b: a & b, [new[k].eqNullSafe(known[k]) for k in keys])
            # Written keys are small on disk only, so they are never sent to the driver to be dealt out.
            new = new.join(known.hint("merge"), same, "left_anti")
        seen.write(new, batch_id)

    return _every_batch(events, step, checkpoint, trigger)


def write_windows(
    windows: DataFrame, out: str, checkpoint: str, keys: Sequence[str], trigger: dict | None = None
) -> StreamingQuery:
    """Write windows as they change, open ones included; ``current_windows`` reads the newest.

    A batch that is run again overwrites its own segment; merges keep the newest state.
    """
    stored = Batches(windows.sparkSession, out, lambda rows: _newest(rows, keys))
    return _every_batch(
        windows, lambda batch, batch_id: stored.write(batch.withColumn("batch_id", F.lit(batch_id)), batch_id),
        checkpoint, trigger, "update")


def current_windows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest state of every window that ``write_windows`` wrote."""
    return _newest(Batches(spark, out).read(), keys).drop("batch_id")


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, "v.*")


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _seconds(length: str) -> int:
    """Seconds of a length like ``10 minutes``."""
    number, unit = length.split()
    return int(number) * _UNITS[unit.lower().removesuffix("s")]


def limit_breaches(
    requests: DataFrame, limits: Limits = CHECK_LIMITS, client: str = "client", ts: str = "ts",
    lateness: str = LATENESS,
) -> DataFrame:
    """Requests per client, limit and clock-aligned window, and whether they exceed it.

    ``limit_no`` counts the limits from 1. With ``write_windows`` a breach is known as soon as
    it happens. A window is forgotten when the watermark and the longest window have passed it.
    """
    micros = F.unix_micros(ts)
    spans = [_seconds(window) * 1_000_000 for window, _ in limits.windows]
    windows = F.array(*[
        F.struct(F.lit(i).alias("limit_no"), (micros - F.pmod(micros, F.lit(span))).alias("start"),
                 F.lit(span).alias("span"), F.lit(allowed).alias("allowed"))
        for i, (span, (_, allowed)) in enumerate(zip(spans, limits.windows), 1)])
    each = requests.select(client, F.explode(windows).alias("w")).select(
        client, F.col("w.limit_no").alias("limit_no"), F.timestamp_micros("w.start").alias("window_start"),
        F.timestamp_micros(F.col("w.start") + F.col("w.span")).alias("window_end"), F.col("w.allowed").alias("allowed"))
    return (
        each.withWatermark("window_end", f"{_seconds(lateness) + max(spans) // 1_000_000} seconds")
        .groupBy(client, "limit_no", "window_start", "window_end", "allowed")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(client, "limit_no", "window_start", "requests", (F.col("requests") > F.col("allowed")).alias("exceeded")))


def write_bursts(
    events: DataFrame, key: str, gap: str, out: str, checkpoint: str, ts: str = "ts",
    lateness: str = LATENESS, trigger: dict | None = None,
) -> StreamingQuery:
    """Bursts of events of a key; each fires ``gap`` after its last event.

    Open bursts are kept in a table and put together with the next batch. Those that no event can
    reach any more, as events later than ``lateness`` are dropped, are written for good.
    ``current_bursts`` reads both. Events without a time are left out.
    """
    spark, step_us, late = events.sparkSession, _seconds(gap) * 1_000_000, _seconds(lateness) * 1_000_000
    # A burst that has ended is never touched again.
    closed, opened = Batches(spark, f"{out}/closed"), _Latest(spark, f"{out}/open")

    def step(batch: DataFrame, batch_id: int) -> None:
        at = F.unix_micros(ts)
        items = batch.select(key, at.alias("first"), at.alias("last"), F.lit(1).cast("long").alias("events"))
        items = items.where("first is not null")
        before, newest = opened.read(below=batch_id)
        if newest is not None:
            items = items.where(F.col("first") >= newest - late)
        items = materialize(items, "events")
        newest = max(filter(lambda t: t is not None, (newest, items.agg(F.max("last")).first()[0])), default=None)
        if before is not None:
            items = items.unionByName(before)
        merged = materialize(requests.merged_bursts(items, key, step_us), "bursts")
        done = F.col("last") + step_us <= F.lit(None if newest is None else newest - late).cast("long")
        closed.write(merged.where(done), batch_id)
        opened.write(merged.where(~F.coalesce(done, F.lit(False))), newest, batch_id)

    return _every_batch(events, step, checkpoint, trigger)


def current_bursts(spark: SparkSession, out: str, key: str, gap: str) -> DataFrame:
    """The bursts that ``write_bursts`` found so far, with those that are still open."""
    opened = _Latest(spark, f"{out}/open")
    now, _ = opened.read()
    ended = Batches(spark, f"{out}/closed").read(below=opened.last() + 1)
    every = now if ended is None else ended.unionByName(now)
    end = F.col("last") + _seconds(gap) * 1_000_000
    return every.select(
        key, F.timestamp_micros("first").alias("burst_start"), F.timestamp_micros("last").alias("burst_end"),
        F.timestamp_micros(end).alias("fires_at"), "events")


class _Latest:
    """A table that every batch replaces, with the newest event time beside it; the last two are kept."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.rows, self.times = (Batches(spark, f"{folder}/{n}", fan=1 << 62) for n in ("rows", "time"))

    def last(self, below: int | None = None) -> int | None:
        return self.rows.last(below)

    def read(self, below: int | None = None) -> tuple[DataFrame | None, int | None]:
        last = self.last(below)
        if last is None:
            return None, None
        spark, name = self.rows.spark, f"{last}-{last}"
        return spark.read.parquet(f"{self.rows.folder}/{name}"), spark.read.parquet(f"{self.times.folder}/{name}").first()[0]

    def write(self, rows: DataFrame, newest: int | None, batch_id: int) -> None:
        spark = self.rows.spark
        self.times.write(spark.range(1).select(F.lit(newest).cast("long").alias("newest")), batch_id)
        self.rows.write(rows, batch_id)
        for table in (self.rows, self.times):
            for a, _ in [s for s in table.finished() if s[0] < batch_id][:-1]:
                table.delete(a, a)


def session_counters(
    labelled: DataFrame, session: str, sponsors: Column, every: str = "1 hour",
    ts: str = "ts", lateness: str = LATENESS,
) -> DataFrame:
    """Listings seen and sponsors found per session and window."""
    return (
        labelled.withWatermark(ts, lateness)
        .groupBy(session, F.window(ts, every).alias("w"))
        .agg(F.count(F.lit(1)).alias("jobs_scanned"), F.count_if(sponsors).alias("sponsors_found"))
        .select(session, F.col("w.start").alias("window_start"), "jobs_scanned", "sponsors_found"))


def miss_counts(misses: DataFrame, every: str = "1 hour", ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Reported misses per address and window."""
    return (
        misses.withWatermark(ts, lateness)
        .groupBy("url", F.window(ts, every).alias("w"))
        .agg(F.count(F.lit(1)).alias("misses"))
        .select("url", F.col("w.start").alias("window_start"), "misses"))


def write_misses(
    misses: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append reported misses, page text cut to the logged length."""
    reports = misses.withColumn("html", logged_snippet(F.col("html")))
    return (reports.writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def write_abandoned(
    attempts: DataFrame, failed: Column, out: str, checkpoint: str, card: str = "card_id", ts: str = "ts",
    key: str = "event_id", max_attempts: int = Listing.max_attempts, lateness: str = LATENESS,
    forget_after: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Cards that fail ``max_attempts`` times in a row, in the order of event time; they stay given up.

    Attempts wait in a table until the watermark has passed them, so batches may bring them out
    of order by as much as ``lateness``; later ones are dropped. What is known of a card is how many
    failures in a row it had last, or where it was given up. With ``forget_after``, cards not
    given up are forgotten that long after their last attempt. ``current_abandoned`` reads what is
    known by now, waiting attempts included.
    """
    spark, late = attempts.sparkSession, _seconds(lateness) * 1_000_000
    waiting, known = _Latest(spark, f"{out}/waiting"), _known_cards(spark, out, card)
    at = F.unix_micros(ts)

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(card, at.alias("at"), key, failed.alias("failed")).where(f"at is not null and {card} is not null")
        before, newest = waiting.read(below=batch_id)
        if newest is not None:
            rows = rows.where(F.col("at") >= newest - late)
        rows = materialize(rows, "attempts")
        newest = max(filter(lambda t: t is not None, (newest, rows.agg(F.max("at")).first()[0])), default=None)
        rows = rows if before is None else rows.unionByName(before)
        ready = F.coalesce(F.col("at") < F.lit(None if newest is None else newest - late).cast("long"), F.lit(False))
        cards = known.read(below=batch_id)
        if cards is not None and forget_after is not None and newest is not None:
            cards = cards.where((F.col("up_at").isNotNull()) | (F.col("at") >= newest - _seconds(forget_after) * 1_000_000))
        known.write(
            _after(rows.where(ready), cards, card, key, max_attempts).withColumn("batch_id", F.lit(batch_id)), batch_id)
        waiting.write(rows.where(~ready), newest, batch_id)

    return _every_batch(attempts, step, checkpoint, trigger)


def current_abandoned(
    spark: SparkSession, out: str, card: str = "card_id", key: str = "event_id", max_attempts: int = Listing.max_attempts,
) -> DataFrame:
    """(card, abandoned_at, abandoned_<key>) of the cards given up by now."""
    waiting = _Latest(spark, f"{out}/waiting")
    rows, _ = waiting.read()
    stored = _newest(_known_cards(spark, out, card).read(below=waiting.last() + 1), [card]).drop("batch_id")
    fresh = _after(rows, stored, card, key, max_attempts)
    return stored.unionByName(fresh).where("up_at is not null").select(
        card, F.timestamp_micros("up_at").alias("abandoned_at"), F.col("up_key").alias(f"abandoned_{key}")).distinct()


def _known_cards(spark: SparkSession, out: str, card: str) -> Batches:
    return Batches(spark, f"{out}/cards", lambda rows: _newest(rows, [card]))


def _after(rows: DataFrame, cards: DataFrame | None, card: str, key: str, max_attempts: int) -> DataFrame:
    """(card, at, in_row, up_at, up_key) of the cards of ``rows``, going on from what is known of them.

    Cards given up stay out. Failures that went before stand in front as rows, fewer than ``max_attempts``.
    """
    rows = rows.select(card, "at", key, "failed")
    if cards is not None:
        stored = (_newest(cards, [card]) if "batch_id" in cards.columns else cards).select(
            card, F.col("in_row").alias("_in_row"), F.col("up_at").isNotNull().alias("_up"))
        mine = rows.join(stored, card, "left").where(~F.coalesce("_up", F.lit(False)))
        again = mine.where("_in_row > 0").select(card, "_in_row").distinct().select(
            card, F.lit(-1 << 62).cast("long").alias("at"), F.lit(None).cast(rows.schema[key].dataType).alias(key),
            F.lit(True).alias("failed"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_in_row"))).alias("_n")).drop("_n")
        rows = mine.drop("_in_row", "_up").unionByName(again)
    done = attempts_ops.counted(materialize(rows, "ready"), F.col("failed"), card, "at", key, max_attempts)
    return done.select(
        card, F.col("last.at").alias("at"), F.col("in_row").cast("long").alias("in_row"), F.col("up.at").alias("up_at"),
        F.col(f"up.{key}").alias("up_key"))


def abandoned_cards(
    attempts: DataFrame,
    failed: Column,
    card: str = "card_id",
    ts: str = "ts",
    key: str = "event_id",
    max_attempts: int = Listing.max_attempts,
    lateness: str = LATENESS,
    forget_after_days: int | None = None,
) -> DataFrame:
    """One row when a card fails ``max_attempts`` times in a row; it then stays given up.

    The state of a card is two integers. A group is what one micro-batch brings for a card,
    so its size follows the trigger; only time, id and outcome of each attempt are held, to
    bring them into order. With ``forget_after_days``, cards are forgotten that long in event time
    after their last attempt. ``write_abandoned`` does the same over written tables.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = attempts.withWatermark(ts, lateness).select(
        card, ts, F.unix_micros(ts).alias("at"), F.col(key).alias("key"), failed.alias("failed"))
    forget_after_ms = None if forget_after_days is None else forget_after_days * 24 * 3600 * 1000
    card_type = rows.schema[card].dataType.simpleString()
    key_type = rows.schema["key"].dataType.simpleString()

    def step(group, frames, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        in_row, given_up = state.get if state.exists else (0, False)
        parts = [(f["at"].to_numpy(), f["key"].to_numpy(), f["failed"].to_numpy(bool)) for f in frames]
        found = None
        at, ids, bad = (np.concatenate(c) for c in zip(*parts))
        latest_ms = max(int(at.max()) // 1000, state.getCurrentWatermarkMs())
        if not given_up:
            order = np.lexsort((ids, at))
            at, ids, bad = at[order], ids[order], bad[order]
            total = np.cumsum(bad)
            base = np.maximum.accumulate(np.where(bad, -in_row, total))
            run = np.where(bad, total - base, 0)
            over = np.flatnonzero(run >= max_attempts)
            in_row = int(run[-1])
            if len(over):
                given_up, found = True, (at[over[0]], ids[over[0]])
        state.update((in_row, given_up))
        if forget_after_ms is not None:
            state.setTimeoutTimestamp(latest_ms + forget_after_ms)
        if found:
            yield pd.DataFrame({card: [group[0]], "at": [found[0]], "key": [found[1]]})

    done = rows.groupBy(card).applyInPandasWithState(
        step, f"{card} {card_type}, at long, key {key_type}", "in_row long, given_up boolean",
        "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(card, F.timestamp_micros("at").alias("abandoned_at"),
                       F.col("key").alias(f"abandoned_{key}"))
