"""Queries of caches and breakers folded over the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.tables import table
from glyphmill.streaming import state

TTL = 300
DAY, HOUR = 86_400, 3_600


def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a cache by user and event type, entries living 300 seconds."""
    return state.ttl_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", TTL)


def breaker_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of a breaker by user: errors are failures, it stays open a day."""
    kind = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    return state.store_breaker(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", kind, 3, DAY)


def breaker_compiler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of a breaker with backoff by user: errors are network failures, clicks compiler errors."""
    kind = F.when(F.col("event_type") == "error", "network_failure").when(F.col("event_type") == "click", "compiler_error").otherwise("success")
    return state.compiler_breaker(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", kind, 3, HOUR, 10 * HOUR)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (ttl_cache, breaker_store, breaker_compiler)}

_NEW1 = "{'t': b.t, 'k': b.k, 'n': %s, 'u': %s, 'o': a.o%s, 'r': a.r%s}"
_N0, _U0 = "CASE WHEN a.u > 0 AND b.t > a.u THEN 0::BIGINT ELSE a.n END", "CASE WHEN a.u > 0 AND b.t > a.u THEN 0::BIGINT ELSE a.u END"
_S7 = "{{'t': b.t, 'k': b.k, 'n': {n}, 'u': {u}, 'o': {o}, 'r': {r}, 'w': {w}, 'c': {c}, 's': {s}}}"


def _seven(**new: str) -> str:
    return _S7.format(**{x: new.get(x, f"a.{x}") for x in "nuorwcs"})


_Z = "0::BIGINT"
ORACLE: dict[str, str] = {
    "ttl_cache": f"""SELECT user_id, event_type, n AS n_events, f.m AS n_misses, n - f.m AS n_hits FROM (SELECT user_id, event_type, count(*) AS n,
        list_reduce(list({{'t': epoch_us(ts), 's': epoch_us(ts), 'm': 1::BIGINT}} ORDER BY ts, event_id), lambda a, b: CASE WHEN b.t - a.s >= {TTL}000000::BIGINT THEN {{'t': b.t, 's': b.t, 'm': a.m + 1}} ELSE {{'t': b.t, 's': a.s, 'm': a.m}} END) AS f FROM events GROUP BY 1, 2)""",
    "breaker_store": f"""SELECT user_id, n AS n_events, f.o AS n_openings, f.r AS n_rejected, f.n AS failures FROM (SELECT user_id, count(*) AS n, list_reduce(list_prepend({{'t': {_Z}, 'k': false, 'n': {_Z}, 'u': {_Z}, 'o': {_Z}, 'r': {_Z}}},
        list({{'t': epoch_us(ts), 'k': event_type = 'error', 'n': {_Z}, 'u': {_Z}, 'o': {_Z}, 'r': {_Z}}} ORDER BY ts, event_id)), lambda a, b: CASE
          WHEN b.t < a.u THEN {_NEW1 % ('a.n', 'a.u', '', ' + 1')}
          WHEN b.k THEN {_NEW1 % (f'{_N0} + 1', f'CASE WHEN {_N0} + 1 >= 3 THEN b.t + {DAY}000000::BIGINT ELSE {_U0} END', f' + CASE WHEN {_N0} + 1 >= 3 THEN 1 ELSE 0 END', '')}
          ELSE {_NEW1 % (_Z, f'CASE WHEN {_N0} > 0 THEN {_Z} ELSE {_U0} END', '', '')} END) AS f FROM events GROUP BY 1)""",
    "breaker_compiler": f"""SELECT user_id, n AS n_events, f.o AS n_openings, f.r AS n_rejected, f.w AS n_network, f.c AS n_compiler, f.s AS n_success, f.n AS failures FROM (SELECT user_id, count(*) AS n, list_reduce(list_prepend({{'t': {_Z}, 'k': '', 'n': {_Z}, 'u': {_Z}, 'o': {_Z}, 'r': {_Z}, 'w': {_Z}, 'c': {_Z}, 's': {_Z}}},
        list({{'t': epoch_us(ts), 'k': event_type, 'n': {_Z}, 'u': {_Z}, 'o': {_Z}, 'r': {_Z}, 'w': {_Z}, 'c': {_Z}, 's': {_Z}}} ORDER BY ts, event_id)), lambda a, b: CASE
          WHEN b.t < a.u THEN {_seven(r='a.r + 1')}
          WHEN b.k = 'error' THEN {_seven(n='a.n + 1', u=f'CASE WHEN a.n + 1 >= 3 THEN b.t + least({HOUR} * CAST(pow(2, least(a.n + 1 - 3, 5)) AS BIGINT), {10 * HOUR}) * 1000000::BIGINT ELSE a.u END', o='a.o + CASE WHEN a.n + 1 >= 3 THEN 1 ELSE 0 END', w='a.w + 1')}
          WHEN b.k = 'click' THEN {_seven(n=_Z, c='a.c + 1')}
          ELSE {_seven(n=_Z, u=_Z, s='a.s + 1')} END) AS f FROM events GROUP BY 1)""",
}
