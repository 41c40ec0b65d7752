"""Caches and circuit breakers as state machines over event time: sorted walks in batch, keyed state in streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_SECOND = 1_000_000


def _stepped(events: DataFrame, keys: list[str], ts: str, tie: str, kind: Column, starts: Column, step: Callable, outputs: dict[str, str]) -> DataFrame:
    """(keys, t, tie, outputs): every event with what a state machine says of it, in the order of times.

    ``starts`` marks events before which no event has an effect behind them, so the events from one to the next, an
    island, are walked apart and a busy key spreads over many tasks. Within an island events stream through the task in
    sorted batches: only the machine's state is held, never the island. ``step`` changes the state in place and returns
    the outputs; a new island begins with an empty state.
    """
    rows = events.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("tie"), kind.alias("kind")).filter("t is not null")
    order = Window.partitionBy(*keys).orderBy("t", "tie")
    marked = rows.withColumn("gap", F.col("t") - F.lag("t").over(order)).withColumn("starts", F.coalesce(starts | F.col("gap").isNull(), F.lit(True)))
    islands = marked.withColumn("island", F.sum(F.col("starts").cast("int")).over(order)).drop("gap")
    spread = islands.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "t", "tie")
    kept = [*keys, "t", "tie"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            said = []
            for t, what, first in zip(*(batch.column(c).to_pylist() for c in ("t", "kind", "starts"))):
                if first:
                    state = {}
                said.append(step(state, t, what))
            columns = list(zip(*said)) if said else [()] * len(outputs)
            arrays = [pa.array(values, {"bigint": pa.int64(), "int": pa.int32()}[kind]) for values, kind in zip(columns, outputs.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *outputs])

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + "".join(f", `{c}` {kind}" for c, kind in outputs.items())
    return spread.mapInArrow(walk, schema)


def ttl_hits(events: DataFrame, keys: list[str], ts: str, tie: str, ttl: int) -> DataFrame:
    """(keys, n_events, n_misses, n_hits): reads of a cache whose entries live ``ttl`` seconds from the miss that set them.

    A hit does not refresh the entry. An event at least ``ttl`` behind the one before is a miss whatever came before.
    Events without a time are left out; a null key is a key of its own.
    """

    def step(state: dict, t: int, _: object) -> tuple:
        miss = t - state.get("set", t - ttl * _SECOND) >= ttl * _SECOND
        if miss:
            state["set"] = t
        return (int(miss),)

    walked = _stepped(events, keys, ts, tie, F.lit(None).cast("string"), F.col("gap") >= ttl * _SECOND, step, {"miss": "int"})
    return walked.groupBy(*keys).agg(F.count("*").alias("n_events"), F.sum("miss").alias("n_misses")).withColumn("n_hits", F.col("n_events") - F.col("n_misses"))


def _quiet(longest: int) -> Column:
    """A success behind the longest time a breaker stays open finds it closed and resets it."""
    return (F.col("kind") == "success") & (F.col("gap") > longest * _SECOND)


def store_breaker(events: DataFrame, keys: list[str], ts: str, tie: str, kind: Column, threshold: int = 3, cooldown: int = 30) -> DataFrame:
    """(keys, n_events, n_openings, n_rejected, failures): a breaker that opens after ``threshold`` failures in a row.

    kind is failure or success. Open, it rejects every event for ``cooldown`` seconds; the first event behind that finds
    it reset. A success resets the failures. failures is the count at the end.
    """

    def step(state: dict, t: int, what: str) -> tuple:
        n, until, opened, rejected = state.get("n", 0), state.get("until", 0), 0, 0
        if until and t > until:
            n = until = 0
        if t < until:
            rejected = 1
        elif what == "failure":
            n += 1
            if n >= threshold:
                until, opened = t + cooldown * _SECOND, 1
        elif n:
            n = until = 0
        state["n"], state["until"] = n, until
        return opened, rejected, n

    walked = _stepped(events, keys, ts, tie, kind, _quiet(cooldown), step, {"opened": "int", "rejected": "int", "n": "bigint"})
    return walked.groupBy(*keys).agg(F.count("*").alias("n_events"), F.sum("opened").alias("n_openings"), F.sum("rejected").alias("n_rejected"), F.max_by("n", F.struct("t", "tie")).alias("failures"))


def compiler_breaker(events: DataFrame, keys: list[str], ts: str, tie: str, kind: Column, threshold: int = 10, base: int = 60, cap: int = 600) -> DataFrame:
    """(keys, n_events, n_openings, n_rejected, n_network, n_compiler, n_success, failures): a breaker with backoff.

    kind is network_failure, compiler_error or success. Only network failures in a row open it, for
    min(base * 2^min(n - threshold, 5), cap) seconds without jitter. A compiler error resets the failures but not the
    time it is open until; a success resets both. Open, it rejects events, which count nowhere else.
    """

    def step(state: dict, t: int, what: str) -> tuple:
        n, until = state.get("n", 0), state.get("until", 0)
        opened = rejected = network = compiler = success = 0
        if t < until:
            rejected = 1
        elif what == "network_failure":
            n, network = n + 1, 1
            if n >= threshold:
                until, opened = t + min(base * 2 ** min(n - threshold, 5), cap) * _SECOND, 1
        elif what == "compiler_error":
            n, compiler = 0, 1
        else:
            n, until, success = 0, 0, 1
        state["n"], state["until"] = n, until
        return opened, rejected, network, compiler, success, n

    counts = ("openings", "rejected", "network", "compiler", "success")
    walked = _stepped(events, keys, ts, tie, kind, _quiet(cap), step, {**{f"n_{c}": "int" for c in counts}, "n": "bigint"})
    return walked.groupBy(*keys).agg(F.count("*").alias("n_events"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in counts], F.max_by("n", F.struct("t", "tie")).alias("failures"))


def ttl_stream(events: DataFrame, key: str, ts: str, ttl: int) -> DataFrame:
    """(key, t, is_hit) of a stream of cache reads: the time of the last miss is the key's state.

    Within a micro-batch the events of a key are taken in the order of their times; the result is that of the batch
    fold where batches come in time order. An extension: the reference has no streams.
    """

    def reads(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        ts_sorted = sorted(t for frame in frames for t in frame["t"])
        hits = []
        for t in ts_sorted:
            hit = last is not None and t - last < ttl * _SECOND
            hits.append(hit)
            if not hit:
                last = t
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({key: [group[0]] * len(hits), "t": ts_sorted, "is_hit": hits})

    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).filter("t is not null")
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(reads, f"{key} {kind}, t bigint, is_hit boolean", "last bigint", "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, ts: str, kind: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n): counts per window of a stream with a watermark. An extension, like every stream here."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", every).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
