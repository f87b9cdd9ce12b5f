"""Keyed state machines over events, in batch by windows and folds, and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _micros(events: DataFrame, ts: str) -> DataFrame:
    return events.withColumn("at", F.unix_micros(F.col(ts).cast("timestamp")))


def rate_limited(events: DataFrame, key: str, ts: str, order: str, gap_micros: int) -> DataFrame:
    """(key, order, start): when each request may start if requests of a key keep a gap: the prefix maximum in closed form.

    Keys are cut into days; counts and maxima of earlier days come from a small aggregate, so a hot key is spread over many tasks.
    Row numbers are long: times a gap they soon pass what an integer holds.
    """
    rows = _micros(events, ts).withColumn("day", F.floor(F.col("at") / F.lit(86_400_000_000)))
    day = W.partitionBy(key, "day").orderBy("at", order)
    rows = rows.withColumn("n", F.row_number().over(day).cast("long")).withColumn("v", F.col("at") - F.col("n") * gap_micros)
    days = rows.groupBy(key, "day").agg(F.count("*").alias("count"), F.max("v").alias("top"))
    earlier = W.partitionBy(key).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("offset", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    days = days.withColumn("carry", F.max(F.col("top") - F.col("offset") * gap_micros).over(earlier)).select(key, "day", "offset", "carry")
    best = F.max("v").over(day.rowsBetween(W.unboundedPreceding, 0))
    full = rows.withColumn("best", best).join(days, [key, "day"])
    return full.select(key, order, (F.greatest(F.col("best") - F.col("offset") * gap_micros, F.coalesce("carry", F.col("best") - F.col("offset") * gap_micros)) + (F.col("n") + F.col("offset")) * gap_micros).alias("start"))


def breaker(events: DataFrame, key: str, ts: str, order: str, failed: str, threshold: int = 3, reset_micros: int = 300_000_000) -> DataFrame:
    """(key, order, failures, open): failures in a row after each event; a success or a pause beyond the reset clears them."""
    by = W.partitionBy(key).orderBy("at", order)
    rows = _micros(events, ts).withColumn("bad", F.expr(failed))
    last_bad = F.last(F.when(F.col("bad"), F.col("at")), True).over(by.rowsBetween(W.unboundedPreceding, -1))
    clear = (~F.col("bad")) | F.coalesce(F.col("at") - last_bad > reset_micros, F.lit(False))
    rows = rows.withColumn("block", F.sum(F.when(clear, 1).otherwise(0)).over(by))
    failures = F.sum(F.when(F.col("bad"), 1).otherwise(0)).over(W.partitionBy(key, "block").orderBy("at", order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("failures", failures.cast("int")).select(key, order, "failures", (F.col("failures") >= threshold).alias("open"))


def cached(events: DataFrame, key: str, ts: str, order: str, ttl_micros: int = 300_000_000, buckets: int = 512) -> DataFrame:
    """(key, order, hit): whether each read finds an entry younger than the time to live, counted from its writing."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["k", "part", "at", "o"])
        group, written, hits = None, 0, []
        for k, part, at in zip(frame["k"].tolist(), frame["part"].tolist(), frame["at"].tolist(), strict=True):
            hit = (k, part) == group and at - written < ttl_micros
            if not hit:
                group, written = (k, part), at
            hits.append(hit)
        return pd.DataFrame({"k": frame["k"], "o": frame["o"], "hit": hits})

    rows = _micros(events, ts).select(F.col(key).alias("k"), F.col(order).alias("o"), "at")
    # a pause of the time to live always ends an entry, so a key may be cut there; parts of many keys are folded in one call
    by = W.partitionBy("k").orderBy("at", "o")
    rows = rows.withColumn("part", F.sum(F.when(F.col("at") - F.lag("at").over(by) >= ttl_micros, 1).otherwise(0)).over(by))
    spread = rows.groupBy(F.pmod(F.xxhash64("k", "part"), F.lit(buckets)).alias("bucket"))
    return spread.applyInPandas(fold, "k long, o long, hit boolean").select(F.col("k").alias(key), F.col("o").alias(order), "hit")


def bounded_cache(reads: list[tuple[int, str]], ttl: int = 300_000, most: int = 500, share: float = 0.25) -> list[bool]:
    """Hits of one cache with a capacity, in order of (time, key): at ``most`` entries expired ones go, then the oldest quarter by first insertion.

    An entry written again keeps its place in that order. The cache is one process's, so this is no distributed operator; see ``cached`` for keyed ones.
    """
    kept: dict[str, int] = {}
    hits = []
    for at, key in reads:
        hit = key in kept and at < kept[key]
        if key in kept and not hit:
            del kept[key]
        if not hit:
            if key not in kept and len(kept) >= most:
                kept = {k: until for k, until in kept.items() if at < until}
                if len(kept) >= most:
                    for k in list(kept)[: int(most * share)]:
                        del kept[k]
            kept[key] = at + ttl
        hits.append(hit)
    return hits


def serial_queue(calls: DataFrame, ts: str, order: str, gap_micros: int = 2_000_000) -> DataFrame:
    """(order, start): when each call of one queue starts if calls keep a gap: the rate limiter with a single key."""
    one = rate_limited(calls.withColumn("_one", F.lit(1)), "_one", ts, order, gap_micros)
    return one.select(order, "start")


def framed(chunks: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """(key, pos, line): the lines of a stream that comes in chunks which cut lines anywhere; an unfinished last line waits and blank lines go."""
    whole = chunks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda c: c[column]), "").alias("_all"))
    lines = F.filter(F.slice(F.split("_all", "\n"), F.lit(1), F.size(F.split("_all", "\n")) - 1), lambda x: F.trim(x) != "")
    return whole.select(key, F.posexplode(lines).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("pos"), "line")


def cache_report(events: DataFrame, ts: str) -> DataFrame:
    """(entries, oldest_micros): how many entries there are and the age of the oldest beside the newest."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.agg(F.count("*").alias("entries"), (F.max(at) - F.min(at)).alias("oldest_micros"))


def cached_stream(events: DataFrame, key: str, ts: str, ttl_seconds: int = 300) -> DataFrame:
    """The same cache over a stream with a watermark: (key, hits, misses) after each trigger; state ends with the time to live."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        written = state.get[0] if state.exists else None
        hits = misses = 0
        times = sorted(t for frame in frames for t in (frame["at"] // 1000).tolist())
        for at in times:
            if written is not None and at - written < ttl_seconds * 1000:
                hits += 1
            else:
                written, misses = at, misses + 1
        state.update((written,))
        state.setTimeoutTimestamp(max(written + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]], "hits": [hits], "misses": [misses]})

    rows = _micros(events.withColumn("_ts", F.col(ts).cast("timestamp")), ts).withWatermark("_ts", "1 minute").select(F.col(key).cast("long").alias("key"), "at", "_ts")
    return rows.groupBy("key").applyInPandasWithState(step, "key long, hits long, misses long", "written long", "append", "EventTimeTimeout")
