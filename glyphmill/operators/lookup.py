"""Exact lookups over the flat catalogue: filters, name index, best version, hot subset, browsing, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.scalar import index_key, is_function_like

#: Order in which browsing lists the categories; others follow by name.
CATEGORY_ORDER = ("function", "variable", "constant", "type", "keyword", "operator")


def where(rows: DataFrame, equal: dict | None = None, one_of: dict | None = None, unequal: dict | None = None) -> DataFrame:
    """Rows that satisfy all metadata conditions; no condition keeps every row."""
    clauses = [F.col(k) == v for k, v in (equal or {}).items()]
    clauses += [F.col(k).isin(*v) for k, v in (one_of or {}).items()]
    clauses += [F.col(k) != v for k, v in (unequal or {}).items()]
    return rows.filter(reduce(Column.__and__, clauses)) if clauses else rows


def name_index(rows: DataFrame, key: str = "row_no") -> DataFrame:
    """(name_key, category, n_rows, first): the index of names, as counts and the first row of each category."""
    return rows.select(index_key(F.col("name")).alias("name_key"), "category", key).filter("name_key != ''").groupBy("name_key", "category").agg(F.count("*").alias("n_rows"), F.min(key).alias("first_row"))


def best_version(rows: DataFrame, key: str = "row_no") -> DataFrame:
    """One row per name: function-like rows first, then rows with a syntax, then the longest document; first row within.

    A function-like winner is a function whatever its category says.
    """
    like = is_function_like(F.col("syntax"), F.col("raw_parameters"))
    tier = F.when(like, 1).when(F.coalesce("syntax", F.lit("")) != "", 2).otherwise(3)
    rank = F.struct(tier.alias("tier"), F.when(tier == 3, -F.length(F.coalesce("document", F.lit("")))).otherwise(0).alias("longest"), F.col(key).alias("row"))
    picked = rows.filter(F.col("name").isNotNull()).groupBy(index_key(F.col("name")).alias("name_key")).agg(F.min_by(F.struct(F.col(key).alias("row"), F.col("category").alias("category"), tier.alias("tier")), rank).alias("b"))
    return picked.select("name_key", F.col("b.row").alias("best_row"), F.when(F.col("b.tier") == 1, "function").otherwise(F.col("b.category")).alias("category"), F.col("b.tier").alias("tier"))


def hot_winners(rows: DataFrame, namespaces: list[str], names: list[str], key: str = "row_no") -> DataFrame:
    """(name_key, winner_row, origin): one row per key of the hot subset.

    Rows of the priority namespaces compete by the longest document, earlier namespaces first; rows whose name is a
    priority global win over them, the first row of a name first. Both lists are parameters.
    """
    at = F.array_position(F.array(*[F.lit(n) for n in namespaces]), F.col("namespace")) if namespaces else F.lit(0)
    name_key = index_key(F.col("name"))
    is_global = name_key.isin(*names) if names else F.lit(False)
    length = F.length(F.coalesce("document", F.lit("")))
    rank = F.struct((~is_global).alias("g"), F.when(is_global, 0).otherwise(-length).alias("l"), F.when(is_global, 0).otherwise(at).alias("a"), F.col(key).alias("r"))
    inside = rows.filter(F.col("name").isNotNull() & ((F.coalesce(at, F.lit(0)) > 0) | is_global)).select(name_key.alias("name_key"), rank.alias("rank"))
    return inside.groupBy("name_key").agg(F.min("rank").alias("rank")).select("name_key", F.col("rank.r").alias("winner_row"), F.when(F.col("rank.g"), "namespace").otherwise("global").alias("origin"))


def category_rank(category: Column) -> Column:
    """Place of a category in listings; categories without one come last."""
    out = F.lit(99)
    for i, name in reversed(list(enumerate(CATEGORY_ORDER))):
        out = F.when(category == name, i).otherwise(out)
    return out


def browse(rows: DataFrame) -> DataFrame:
    """(namespace, category, place, n_members, n_names, first_name, last_name): what each namespace holds, in listing order."""
    groups = rows.groupBy(F.coalesce("namespace", F.lit("")).alias("namespace"), F.coalesce("category", F.lit("")).alias("category")).agg(
        F.count("*").alias("n_members"), F.countDistinct("name").alias("n_names"), F.min("name").alias("first_name"), F.max("name").alias("last_name")
    )
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("namespace").orderBy(category_rank(F.col("category")), "category")))


def type_methods(rows: DataFrame, shown: int = 30) -> DataFrame:
    """(owner, n_methods, methods): for each namespace, the functions whose names begin with it.

    The names are those that start with the type's name and a dot, in order, the first ``shown`` of them; the rank is
    taken before they are collected, so no more than those are ever in one row.
    """
    functions = rows.filter("category = 'function'").select(F.col("namespace").alias("owner"), F.col("name").alias("method")).filter(F.startswith("method", F.concat("owner", F.lit(".")))).distinct()
    ranked = functions.withColumn("at", F.row_number().over(Window.partitionBy("owner").orderBy("method")))
    listed = ranked.groupBy("owner").agg(F.count("*").alias("n_methods"), F.array_sort(F.collect_list(F.when(F.col("at") <= shown, F.col("method")))).alias("methods"))
    return listed


def short_types(rows: DataFrame, key: str = "row_no", shown: int = 30, short: int = 500) -> DataFrame:
    """(row, n_methods, methods): the functions of the namespace of each type whose document is under ``short`` characters."""
    types = rows.filter((F.col("category") == "type") & (F.length(F.coalesce("document", F.lit(""))) < short) & (F.col("namespace") != "")).select(key, F.col("namespace").alias("owner"))
    return types.join(type_methods(rows, shown), "owner").select(key, "n_methods", "methods")


def total_check(rows: DataFrame, least: int = 850) -> DataFrame:
    """One row: the number of rows of a known category, and LOW where it is under ``least``."""
    return rows.filter(F.coalesce("category", F.lit("unknown")) != "unknown").agg(F.count("*").alias("n")).withColumn("verdict", F.when(F.col("n") < least, "LOW").otherwise("OK"))


def name_members(rows: DataFrame, key: str = "row_no") -> DataFrame:
    """(name_key, category, row): the index of names as a relation, each name with all its rows; blank names have none."""
    return rows.select(index_key(F.col("name")).alias("name_key"), "category", key).filter("name_key != ''")


def range_check(counts: DataFrame, ranges: dict[str, tuple[int, int]], low: float = 0.7, high: float = 1.5) -> DataFrame:
    """Adds verdict to (category, n): LOW under 0.7 of the expected least, HIGH over 1.5 of the most, else OK; null without a range."""
    least = F.create_map(*[F.lit(x) for k, v in ranges.items() for x in (k, v[0])])[F.col("category")]
    most = F.create_map(*[F.lit(x) for k, v in ranges.items() for x in (k, v[1])])[F.col("category")]
    return counts.withColumn("verdict", F.when(least.isNull(), None).when(F.col("n") < least * low, "LOW").when(F.col("n") > most * high, "HIGH").otherwise("OK"))


def scrape_report(entries: DataFrame, discovered: DataFrame) -> DataFrame:
    """One row of counts over all entries and the discovery index."""
    size = lambda c: F.size(F.coalesce(c, F.array()))
    found = discovered.agg(F.countDistinct("fragment").alias("discovered"))
    report = entries.agg(
        F.count("*").alias("scraped"), F.count_if(F.coalesce("scrape_error", F.lit("")) != "").alias("failed"), F.count_if(size("examples") > 0).alias("with_examples"), F.coalesce(F.sum(size("examples")), F.lit(0)).alias("total_examples"),
        F.count_if(size("parameters") > 0).alias("with_parameters"), F.coalesce(F.sum(size("parameters")), F.lit(0)).alias("total_parameters"), F.count_if(F.coalesce("deprecated", F.lit(False))).alias("deprecated_count"),
    )
    return report.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one").drop("_one")
