"""Duplicates hidden by formatting differences (problem 1): progressive partition refinement.

Rows are first grouped by invariants that are cheap and blind to dress and field order (the stripped length and a
letter histogram over both fields). Only rows of classes with several members get the costlier key, the symbol
itself, and are grouped again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.symbols import symbol_struct
from glyphmill.operators.skew import salted_join
from glyphmill.session import cut

#: Letter groups of the histogram; each is one count of the invariant.
LETTER_GROUPS = ("a", "e", "i", "o", "u", "lr", "nm", "st", "cdg", "0123456789")


def bare_text(name: Column, category: Column) -> Column:
    """Letters, marks and digits of both fields together, in lower case."""
    return F.regexp_replace(F.lower(F.concat_ws("", name, category)), r"[^\p{L}\p{M}\p{N}]+", "")


def histogram(bare: Column) -> Column:
    """Counts of the letter groups packed into a number; blind to the order of the letters, so to that of the fields."""
    packed = F.lit(0).cast("bigint")
    for group in LETTER_GROUPS:  # counts beyond 60 share a class; the costlier key tells them apart
        packed = packed * 61 + F.least(F.length(bare) - F.length(F.translate(bare, group, "")), F.lit(60))
    return packed


def cheap_class(rows: DataFrame, id_col: str, name: str, category: str) -> DataFrame:
    """(id, _name, _category, length, histogram) of every row: the invariants that cost little."""
    bare = rows.select(F.col(id_col), F.col(name).alias("_name"), F.col(category).alias("_category"), bare_text(F.col(name), F.col(category)).alias("_bare"))
    return bare.select(id_col, "_name", "_category", F.length("_bare").alias("length"), histogram(F.col("_bare")).alias("histogram"))


def classes(rows: DataFrame, id_col: str = "rec_id", name: str = "name", category: str = "category") -> DataFrame:
    """``cheap_class`` of every row, written once: what follows reads it instead of the table."""
    return cut(cheap_class(rows, id_col, name, category))


def _symbols(rows: DataFrame, *columns: str) -> DataFrame:
    """The costlier key of rows that hold _name and _category; rows without a name have none and are left out."""
    named = rows.withColumn("_symbol", symbol_struct(F.col("_name"), F.col("_category"))).select(*columns, "_symbol.sym_name", F.coalesce("_symbol.sym_category", F.lit("")).alias("sym_category"))
    return named.filter(F.col("sym_name").isNotNull())


def refine(classed: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """(id, sym_name, sym_category): the rows of classes with several members, with their symbol.

    Rows whose cheap class has one member are unique and end here.
    """
    several = classed.groupBy("length", "histogram").agg(F.count("*").alias("_members")).filter(F.col("_members") > 1)
    return _symbols(salted_join(classed, several, ["length", "histogram"], "_members", id_col), id_col)


def _groups(refined: DataFrame, id_col: str) -> DataFrame:
    return refined.groupBy("sym_name", "sym_category").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n_rows"))


def copies(rows: DataFrame, id_col: str = "rec_id", name: str = "name", category: str = "category") -> DataFrame:
    """(first_id, id, n_rows): each row whose symbol has a smaller id too, with the symbol's smallest id and its rows.

    Rows that are equal throughout (landed again) are copies like any others. A null category is a category of its
    own. An empty table gives an empty result; extra columns are ignored. Calling it writes the classes and the refined
    rows to the checkpoint folder, so the table is read once.
    """
    refined = cut(refine(classes(rows, id_col, name, category), id_col))
    keys = ["sym_name", "sym_category"]
    groups = _groups(refined, id_col).filter(F.col("n_rows") > 1)
    return salted_join(refined, groups, keys, "n_rows", id_col).filter(F.col(id_col) > F.col("first_id")).select("first_id", id_col, "n_rows")


def collapsed(rows: DataFrame, id_col: str = "rec_id", name: str = "name", category: str = "category") -> DataFrame:
    """(sym_name, sym_category, first_id, n_rows): one record per symbol with its number of rows, single rows included.

    The rows of classes with several members are grouped by the costlier key; the one row of any other class is its
    symbol's only one, and gets the key for output alone. Calling it writes the classes to the checkpoint folder.
    """
    classed = classes(rows, id_col, name, category)
    single = classed.groupBy("length", "histogram").agg(F.count("*").alias("_members"), F.min(F.struct(id_col, "_name", "_category")).alias("_row")).filter(F.col("_members") == 1)
    alone = _symbols(single.select("_row.*"), id_col).select("sym_name", "sym_category", F.col(id_col).alias("first_id"), F.lit(1).cast("bigint").alias("n_rows"))
    return _groups(refine(classed, id_col), id_col).unionByName(alone)
