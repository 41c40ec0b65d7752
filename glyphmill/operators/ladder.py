"""Lookup of many names at once: the first rung of a ladder that answers, and suggestions where none does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.scalar import bare_name, index_key
from glyphmill.operators.lookup import best_version, hot_winners
from glyphmill.operators.search import fuzzy_names


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.coalesce(index_key(bare_name(F.col("name"))), F.lit("")).alias("name_key"), "category")


def _own(catalog: DataFrame, key: str) -> DataFrame:
    return catalog.filter("name is not null").groupBy(index_key(bare_name(F.col("name"))).alias("name_key"), "category").agg(F.min(key).alias("own_row")).filter("name_key != ''")


def _hot(catalog: DataFrame, namespaces: list[str], names: list[str], key: str) -> DataFrame:
    """(name_key, hot_row, hot_category): winners of the hot subset that have a syntax."""
    rows = catalog.withColumn("name", bare_name(F.col("name")))
    told = rows.filter(F.coalesce("syntax", F.lit("")) != "").select(F.col(key).alias("winner_row"), F.col("category").alias("hot_category"))
    return hot_winners(rows, namespaces, names, key).filter("name_key != ''").join(told, "winner_row").select("name_key", F.col("winner_row").alias("hot_row"), "hot_category")


def lookup(queries: DataFrame, catalog: DataFrame, key: str = "row_no", score: float = 85.0, namespaces: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """(query_id, name_key, stage, row): hot, exact in the category, exact in any category, alike by ``score``, or not found.

    queries: query_id, name, category. ``namespaces`` and ``names`` state the hot subset; its winner answers if it has a
    syntax and the asked category, or none is asked. Alike names of the asked category go before those of any. Rungs are
    equi-joins on one row per name; only names that no exact rung answers are compared with the others, in blocks. Blank
    names are not found.
    """
    asked = _asked(queries)
    own = _own(catalog, key)
    best = best_version(catalog.withColumn("name", bare_name(F.col("name"))), key).select("name_key", "best_row").filter("name_key != ''")
    exact = asked.join(own, ["name_key", "category"], "left").join(best, "name_key", "left")
    if namespaces or names:
        fits = F.col("category").isNull() | (F.col("category") == F.col("hot_category"))
        exact = exact.join(_hot(catalog, namespaces or [], names or [], key), "name_key", "left").withColumn("hot_row", F.when(fits, F.col("hot_row"))).drop("hot_category")
    else:
        exact = exact.withColumn("hot_row", F.lit(None).cast("bigint"))
    lost = exact.filter("best_row is null and name_key != ''").select(F.col("name_key").alias("name"), "category").distinct()
    inside = fuzzy_names(own.select(F.col("name_key").alias("name"), "category"), lost, score, 1, within="category").select(F.col("query").alias("name_key"), "category", F.col("name").alias("inside_key"))
    rest = lost.withColumnRenamed("name", "name_key").join(inside, ["name_key", "category"], "left_anti").select(F.col("name_key").alias("name")).distinct()
    near = fuzzy_names(best.select(F.col("name_key").alias("name")), rest, score, 1).select(F.col("query").alias("name_key"), F.col("name").alias("near_key"))
    found = exact.join(inside, ["name_key", "category"], "left").join(own.select(F.col("name_key").alias("inside_key"), "category", F.col("own_row").alias("inside_row")), ["inside_key", "category"], "left")
    found = found.join(near, "name_key", "left").join(best.select(F.col("name_key").alias("near_key"), F.col("best_row").alias("near_row")), "near_key", "left")
    alike = F.coalesce("inside_row", "near_row")
    return found.select(
        "query_id", "name_key",
        F.when(F.col("hot_row").isNotNull(), "hot").when(F.col("own_row").isNotNull(), "exact_in_category").when(F.col("best_row").isNotNull(), "exact").when(alike.isNotNull(), "alike").otherwise("not_found").alias("stage"),
        F.coalesce("hot_row", "own_row", "best_row", alike).alias("row"),
    )


def suggestions(queries: DataFrame, catalog: DataFrame, key: str = "row_no", score: float = 85.0, least: float = 0.0, best: int = 5) -> DataFrame:
    """(query_id, rank, name, score): up to ``best`` names for each query that no rung of ``lookup`` answers.

    They are the names of the asked category most like it, however little (``least`` is a floor); those of any category
    where it has none.
    """
    lost = lookup(queries, catalog, key, score).filter("stage = 'not_found' and name_key != ''").select("query_id", "name_key").join(_asked(queries).select("query_id", "category"), "query_id")
    own = _own(catalog, key).select(F.col("name_key").alias("name"), "category")
    inside = fuzzy_names(own, lost.select(F.col("name_key").alias("name"), "category"), least, best, within="category").withColumnRenamed("query", "name_key")
    told = lost.join(inside, ["name_key", "category"])
    rest = lost.join(told.select("query_id").distinct(), "query_id", "left_anti")
    near = rest.join(fuzzy_names(own, rest.select(F.col("name_key").alias("name")), least, best).withColumnRenamed("query", "name_key"), "name_key")
    return told.unionByName(near).select("query_id", "rank", "name", "score")
