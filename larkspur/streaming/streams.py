"""Streams: screening, windowed counts, late data, duplicates, drift per batch, and a cache with expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from larkspur.functions.security import injection, redact


def screened(stream: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds risk and redacts; suspicious rows are dropped.  Works on streams and tables."""
    risk, _ = injection(F.col(text))
    clean, found = redact(F.col(text))
    return stream.withColumn("risk", risk).filter(F.col("risk") < threshold).withColumn("found", found).withColumn(text, clean)


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; the sessions' zone is taken."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def window_counts(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """window_start, keys..., n, total per tumbling or sliding window; rows later than ``late`` are dropped on a stream."""
    rows = event_time(events)
    if late and rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def session_counts(events: DataFrame, gap: str, late: str | None = None, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """session_start, session_end, keys..., n per session with ``gap`` of silence around it."""
    rows = event_time(events)
    if late and rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def without_duplicates(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark."""
    return event_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drift_per_batch(reference: DataFrame, sink: Callable[[int, DataFrame], None], bins: int = 10) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands the drift of each batch's x against the reference to ``sink``."""
    from larkspur.operators.metrics import psi

    def run(batch: DataFrame, number: int) -> None:
        sink(number, psi(reference, batch, bins))

    return run


def expiring_cache(entries: DataFrame, seconds: int) -> DataFrame:
    """key, response, fresh for a stream or table of (key, response, ts): whether a response is still cached.

    The first response of a key is kept for ``seconds``; later ones within that
    time are answered by it, and the next after it is kept anew.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values("ts")
        kept, since = state.get if state.exists else (None, None)
        out = []
        for response, ts in zip(rows["response"], rows["ts"]):
            now = ts.timestamp()
            fresh = since is None or now >= since + seconds
            if fresh:
                kept, since = response, now
            out.append((key[0], kept, fresh))
        state.update((kept, since))
        yield pd.DataFrame(out, columns=["key", "response", "fresh"])

    grouped = event_time(entries).withWatermark("ts", f"{seconds} seconds").groupBy("key")
    return grouped.applyInPandasWithState(step, "key string, response string, fresh boolean", "response string, since double", "append", GroupStateTimeout.NoTimeout)
