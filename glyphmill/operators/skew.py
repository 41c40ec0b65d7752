"""Equi-join that splits hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The heaviest keys that are split; a key beyond them holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 256
#: Parts a hot key is split into.
SALTS = 32
#: Keys with fewer rows than this are never split.
MIN_ROWS = 50_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: str, how: str = "inner", hot_keys: int = HOT_KEYS, salts: int = SALTS, min_rows: int = MIN_ROWS) -> DataFrame:
    """Join many rows (``left``) to one row per key (``right``) with hot keys spread over many tasks.

    ``right`` holds in ``weight`` how many rows of ``left`` have the key. Its ``hot_keys`` heaviest keys (a top-k,
    so the broadcast is bounded whatever the data) are repeated ``salts`` times; the left rows of such a key
    choose a salt by the hash of ``spread``. All rows keep their matches; null keys match nothing.
    """
    hot = F.broadcast(
        right.filter(F.col(weight) >= min_rows).orderBy(F.desc(weight), *keys).limit(hot_keys).select(*keys, F.lit(salts).alias("_salts"))
    )
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")).otherwise(F.lit(0))
    ).drop("_salts")
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))
    ).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
