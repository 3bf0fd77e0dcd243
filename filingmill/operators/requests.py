"""Request limits and bursts over logs of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CHECK_LIMITS, Limits
from . import prefix


def rate_limit(
    requests: DataFrame,
    limits: Limits = CHECK_LIMITS,
    client: str = "client",
    ts: str = "ts",
    key: str = "event_id",
) -> DataFrame:
    """Every request with the limit that refused it, or NULL when it was admitted.

    Windows are clock-aligned and first come, first served; a later limit counts only what
    the ones before it admitted. The first limit keeps its N requests per client and window
    already in the map tasks, so a client with most of the traffic is cut down before the
    shuffle; verdicts return to the requests over their unique ``key``.
    """
    (first_window, first_n), *later = limits.windows

    def place(window: str, *extra: Column) -> Column:
        slot = F.window(ts, window)["start"]
        return F.row_number().over(Window.partitionBy(client, slot, *extra).orderBy(ts, key))

    passed = requests.select(client, ts, key)
    passed = passed.withColumn("_place", place(first_window)).where(F.col("_place") <= first_n)
    passed = passed.withColumn("_refused", F.lit(None).cast("int"))
    for number, (window, n) in enumerate(later, 2):
        passed = passed.withColumn("_place", place(window, F.col("_refused").isNull()))
        passed = passed.withColumn("_refused", F.coalesce(
            "_refused", F.when(F.col("_place") > n, number)))
    verdict = passed.select(key, F.coalesce("_refused", F.lit(0)).alias("_verdict"))
    return requests.join(verdict, key, "left").select(
        *requests.columns,
        F.nullif(F.coalesce("_verdict", F.lit(1)), F.lit(0)).alias("refused_by"))


def bursts(
    events: DataFrame, key: str, gap: float, ts: str = "ts", chunk_gaps: int = 1 << 16
) -> DataFrame:
    """Events of a key that follow each other by less than ``gap`` seconds, as one burst.

    A burst fires ``gap`` after its last event. Events within one slot of length ``gap``
    always share a burst, so they are merged before anything is shuffled. Slots are linked
    within chunks of ``chunk_gaps`` slots; only a chunk's first slot has to wait for the
    chunks before it.
    """
    step = int(gap * 1_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = events.groupBy(key, F.floor(micros / step).alias("_slot")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count(F.lit(1)).alias("_n"))
    first, last = F.col("_first"), F.col("_last")

    def inside(w):
        gap_before = first - F.lag("_last").over(w)
        return [{"_mark": F.when(gap_before >= step, first)},
                {"_start": F.max("_mark").over(prefix.so_far(w))}]

    def carry(w):
        since = F.col("_c_first") - F.max("_c_last").over(prefix.before(w))
        opens = F.when(since.isNull() | (since >= step), F.col("_c_first"))
        return [{"_open": opens},
                {"_latest": F.coalesce("_c_mark", "_open")},
                {"_carried": F.coalesce("_open", F.max("_latest").over(prefix.before(w)))}]

    linked = prefix.along(
        slots, [key], F.floor(F.col("_slot") / chunk_gaps), ["_slot"], inside,
        {"_c_first": F.min(first), "_c_last": F.max(last), "_c_mark": F.max("_mark")}, carry)
    return linked.groupBy(key, F.coalesce("_start", "_carried").alias("_from")).agg(
        F.max("_last").alias("_end"), F.sum("_n").alias("events")
    ).select(
        key, F.timestamp_micros("_from").alias("burst_start"),
        F.timestamp_micros("_end").alias("burst_end"),
        F.timestamp_micros(F.col("_end") + step).alias("fires_at"), "events")


def merged_bursts(items: DataFrame, key: str, step: int, chunk_gaps: int = 1 << 16) -> DataFrame:
    """Bursts of items that are bursts themselves: (key, first, last, events), times in microseconds.

    Items belong together when one begins less than ``step`` after an earlier one of the key ends.
    Like ``bursts``, but an item may reach over many slots and chunks.
    """
    slots = items.groupBy(key, F.floor(F.col("first") / step).alias("_slot")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))
    chunk = F.floor(F.col("_slot") / chunk_gaps)
    seen = prefix.along(
        slots, [key], chunk, ["_slot"],
        lambda w: [{"_in": F.max("last").over(prefix.before(w))}], {"_c_last": F.max("last")},
        lambda w: [{"_before": F.max("_c_last").over(prefix.before(w))}])
    until = F.greatest("_in", "_before")
    opens = F.when(until.isNull() | (F.col("first") - until >= step), F.col("first"))
    marked = seen.select(key, "_slot", "first", "last", "events", opens.alias("_opens"))
    started = prefix.along(
        marked, [key], chunk, ["_slot"],
        lambda w: [{"_in": F.max("_opens").over(prefix.so_far(w))}], {"_c_open": F.max("_opens")},
        lambda w: [{"_before": F.max("_c_open").over(prefix.before(w))}])
    return started.groupBy(key, F.coalesce("_in", "_before").alias("first")).agg(
        F.max("last").alias("last"), F.sum("events").alias("events"))
