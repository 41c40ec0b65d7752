"""References to records that do not exist (problem 3): compressed bitmaps per key range and period.

Keys are dictionary-encoded as (key range, integer in the range). What refers to a key, and what holds it, is a bit in
the compressed bitmap of its range block, its kind and its month; bitmaps alone decide which references are orphans:
references AND NOT parents leaves the orphans, and the surviving bits are decoded back to keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.symbols import month_text, name_key, reference_key, symbol_struct, utc_instant, utc_month
from glyphmill.operators.skew import salted_join
from glyphmill.session import cut, shuffle_width

#: Bits of one bitmap: the keys of one block of a range.
BITS = 32_768
#: Stands for "no month": a reference or an entry without a scrape time, and tables without periods.
NO_MONTH = -1
#: What a bitmap tells of its keys.
REFERENCE, HELD, BUILTIN, REMOVED = "reference", "entry", "builtin", "removal"

#: First byte of a compressed bitmap: the places of its bits, its runs of bits, or all of its bits.
_PLACES, _RUNS, _PLAIN = 0, 1, 2


def compress(places: np.ndarray) -> bytes:
    """The smallest of three forms of a bitmap, given by the sorted places of its bits: places, runs, or plain bits."""
    places = places.astype("<u2")
    starts = np.flatnonzero(np.diff(places.astype("int32"), prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(places), BITS // 8):
        lengths = np.diff(np.append(starts, len(places)))
        return bytes([_RUNS]) + np.column_stack([places[starts], (lengths - 1).astype("<u2")]).astype("<u2").tobytes()
    if 2 * len(places) < BITS // 8:
        return bytes([_PLACES]) + places.tobytes()
    bits = np.zeros(BITS, bool)
    bits[places] = True
    return bytes([_PLAIN]) + np.packbits(bits, bitorder="little").tobytes()


def places_of(bitmap: bytes) -> np.ndarray:
    """The sorted places of a bitmap's bits."""
    form, body = bitmap[0], np.frombuffer(bitmap, np.uint8, offset=1)
    if form == _PLACES:
        return body.view("<u2")
    if form == _PLAIN:
        return np.flatnonzero(np.unpackbits(body, bitorder="little")).astype("<u2")
    starts, lengths = body.view("<u2").reshape(-1, 2).astype("int64").T
    return (np.repeat(starts - np.append(0, np.cumsum(lengths + 1)[:-1]), lengths + 1) + np.arange(np.sum(lengths + 1))).astype("<u2")


def among(bitmap: bytes | None, places: np.ndarray) -> np.ndarray:
    """Which of the places are bits of a bitmap, without unpacking it; none for no bitmap."""
    if bitmap is None or len(bitmap) == 1 or not len(places):
        return np.zeros(len(places), bool)
    form, body = bitmap[0], np.frombuffer(bitmap, np.uint8, offset=1)
    if form == _PLAIN:
        return (body[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
    pairs = body.view("<u2") if form == _PLACES else body.view("<u2").reshape(-1, 2)
    starts = pairs if form == _PLACES else pairs[:, 0]
    at = np.searchsorted(starts, places, side="right") - 1
    length = 0 if form == _PLACES else pairs[at, 1]
    return (at >= 0) & (places.astype("int64") - starts[at] <= length)


def references(entries: DataFrame) -> DataFrame:
    """(rec_id, pos, ref_month, key): one row per element of see_also that is a reference.

    pos counts all elements from 0, nulls included. Null, blank and web-address elements are no references.
    """
    month = F.coalesce(utc_month(utc_instant(F.col("scraped_at"))), F.lit(NO_MONTH))
    return (
        entries.select("rec_id", month.alias("ref_month"), F.posexplode("see_also").alias("pos", "_element"))
        .select("rec_id", "pos", "ref_month", reference_key(F.col("_element")).alias("key"))
        .filter(F.col("key").isNotNull())
    )


def parents(entries: DataFrame, builtins: DataFrame, removals: DataFrame) -> DataFrame:
    """(key, kind, month): a row for each row of each table that holds a name, entries with the month of their scrape."""
    symbol = symbol_struct(F.col("name"), F.col("category"))["sym_name"]
    none = F.lit(NO_MONTH).alias("month")
    held = entries.select(symbol.alias("key"), F.lit(HELD).alias("kind"), F.coalesce(utc_month(utc_instant(F.col("scraped_at"))), F.lit(NO_MONTH)).alias("month"))
    native = builtins.select(name_key(F.col("name")).alias("key"), F.lit(BUILTIN).alias("kind"), none)
    gone = removals.select(symbol.alias("key"), F.lit(REMOVED).alias("kind"), none)
    return held.unionByName(native).unionByName(gone).filter(F.col("key").isNotNull())


def encode(refs: DataFrame, holders: DataFrame, ranges: int | None = None) -> DataFrame:
    """(key, kind, month, n, key_range, code): every key with what is known of it, and its integer in its range.

    One row per key, kind and month, whatever the number of rows behind it; equal keys of a range share a code.
    """
    ranges = ranges or 4 * shuffle_width(refs.sparkSession)
    seen = refs.select("key", F.lit(REFERENCE).alias("kind"), F.col("ref_month").alias("month")).unionByName(holders.select("key", "kind", "month"))
    known = seen.groupBy("key", "kind", "month").agg(F.count("*").alias("n")).withColumn("key_range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    return known.withColumn("code", F.dense_rank().over(Window.partitionBy("key_range").orderBy("key")) - 1)


def bitmaps(coded: DataFrame) -> DataFrame:
    """(key_range, block, kind, month, bitmap): the compressed bitmap of each range block, kind and month."""

    @F.pandas_udf("binary")
    def packed(places: pd.Series) -> pd.Series:
        return places.map(compress)

    placed = coded.select("key_range", F.floor(F.col("code") / BITS).cast("int").alias("block"), "kind", "month", (F.col("code") % BITS).cast("int").alias("place"))
    lists = placed.groupBy("key_range", "block", "kind", "month").agg(F.array_sort(F.collect_list("place")).alias("places"))  # at most BITS of them
    return lists.select("key_range", "block", "kind", "month", packed("places").alias("bitmap"))


def _and_not(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """Orphan bits of one range block: its bitmaps, one per kind and month."""
    bits = {(k, m): b for k, m, b in zip(block["kind"], block["month"], block["bitmap"])}
    held = sorted((m for k, m in bits if k == HELD), reverse=True)
    out = []
    after, at = np.zeros(BITS, bool), 0  # keys that entries hold from a later month on
    for month in sorted((m for k, m in bits if k == REFERENCE), reverse=True):
        while at < len(held) and held[at] > max(month, NO_MONTH):
            after[places_of(bits[HELD, held[at]])] = True
            at += 1
        refs = places_of(bits[REFERENCE, month])
        builtin = among(bits.get((BUILTIN, NO_MONTH)), refs)
        before = np.zeros(len(refs), bool)
        for m in held[at:]:
            if m != NO_MONTH:
                before |= among(bits[HELD, m], refs)
        entry = before | after[refs] | among(bits.get((HELD, NO_MONTH)), refs)
        removed = among(bits.get((REMOVED, NO_MONTH)), refs)
        late = after[refs] & ~before & ~builtin if month != NO_MONTH else np.zeros(len(refs), bool)
        absent = ~entry & ~builtin
        for kind, left in (("deleted", absent & removed), ("missing", absent & ~removed), ("late", late)):
            if left.any():
                out.append((month, kind, refs[left].astype("int64")))
    sizes = [len(found) for _, _, found in out]
    return pd.DataFrame(
        {
            "key_range": np.full(sum(sizes), key[0], "int32"),
            "code": np.concatenate([f for _, _, f in out]) + int(key[1]) * BITS if out else np.empty(0, "int64"),
            "month": np.repeat(np.array([m for m, _, _ in out], "int32"), sizes),
            "orphan_kind": np.repeat(np.array([k for _, k, _ in out], object), sizes),
        }
    )


def orphan_keys(refs: DataFrame, holders: DataFrame, ranges: int | None = None) -> DataFrame:
    """(key, ref_month, orphan_kind, n): the orphan keys of each month with their number of references."""
    coded = cut(encode(refs, holders, ranges))
    survivors = bitmaps(coded).groupBy("key_range", "block").applyInPandas(_and_not, "key_range int, code bigint, month int, orphan_kind string")
    named = coded.filter(F.col("kind") == REFERENCE).select("key_range", "code", "month", "key", "n")
    return survivors.join(named, ["key_range", "code", "month"]).select("key", F.col("month").alias("ref_month"), "orphan_kind", "n")


def orphan_references(entries: DataFrame, builtins: DataFrame, removals: DataFrame) -> DataFrame:
    """(rec_id, pos, orphan_kind): one row for each orphan element of see_also.

    deleted: no entry or built-in has the name, a removal does; missing: none of the three does; late: entries have
    it, built-ins do not, and its earliest scrape lies in a later month (UTC) than the referring record's. A record
    without a scrape time shows no late reference, and a name never scraped with a time is never late. Empty tables
    give an empty result; rows landed twice give their references twice, as different records. Calling it writes the
    references and the dictionary once each to the checkpoint folder.
    """
    refs = cut(references(entries))
    orphans = orphan_keys(refs, parents(entries, builtins, removals))
    return salted_join(refs, orphans, ["key", "ref_month"], "n", "rec_id").select("rec_id", "pos", "orphan_kind")


def orphan_report(entries: DataFrame, builtins: DataFrame, removals: DataFrame, table: str) -> DataFrame:
    """(src_table, month, orphan_kind, n_references, n_keys): orphans per table and month; month null without a time."""
    orphans = orphan_keys(references(entries), parents(entries, builtins, removals))
    return (
        orphans.groupBy("ref_month", "orphan_kind")
        .agg(F.sum("n").alias("n_references"), F.count("*").alias("n_keys"))
        .select(F.lit(table).alias("src_table"), F.when(F.col("ref_month") != NO_MONTH, month_text(F.col("ref_month"))).alias("month"), "orphan_kind", "n_references", "n_keys")
    )
