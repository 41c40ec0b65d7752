"""Symbol identity: a record's (name, category) apart from case, white space, punctuation and field order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The categories of the catalogue.
CATEGORIES = ("function", "variable", "constant", "type", "keyword", "annotation", "operator")

#: Fragment prefixes of the reference pages and the category each one means.
FRAGMENT_PREFIXES = {
    "an_": "annotation",
    "const_": "constant",
    "fun_": "function",
    "kw_": "keyword",
    "op_": "operator",
    "type_": "type",
    "var_": "variable",
}

_NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
_WRAPPING = r"[\s\p{Z}\p{Cc}\p{Cf}\"'`‘’“”«»]+"


def squash(col: Column) -> Column:
    """Letters, marks and digits of ``col`` in lower case; null stays null."""
    return F.regexp_replace(F.lower(col), _NOT_WORD, "")


def name_key(col: Column) -> Column:
    """Key of a name. A name without letters and digits (an operator) keeps its signs, without quotes and spaces.

    Null, empty and blank names give null.
    """
    words = squash(col)
    signs = F.regexp_replace(col, _WRAPPING, "")
    return F.when(words != "", words).otherwise(F.nullif(signs, F.lit("")))


def symbol_struct(name: Column, category: Column) -> Column:
    """struct(sym_name, sym_category) of a record; sym_name is null where the record has no name.

    The fields are taken the other way round where only the name field holds a category.
    """
    n, c = squash(name), squash(category)
    swapped = F.coalesce(n.isin(*CATEGORIES) & name_key(category).isNotNull() & ~c.isin(*CATEGORIES), F.lit(False))
    return F.struct(
        F.when(swapped, name_key(category)).otherwise(name_key(name)).alias("sym_name"),
        F.nullif(F.when(swapped, n).otherwise(c), F.lit("")).alias("sym_category"),
    )


def source_code(col: Column) -> Column:
    """A source code in lower case with underscores; blank gives null."""
    return F.nullif(
        F.regexp_replace(F.regexp_replace(F.lower(col), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""), r"[\s\p{Z}_\-]+", "_"),
        F.lit(""),
    )


def reference_key(col: Column) -> Column:
    """Key of a reference to a symbol's name, also when given as a page fragment such as ``#fun_a.b``.

    Null, blank and web addresses give null: they are no references.
    """
    text = F.regexp_replace(col, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")
    prefix = "^#?(?:" + "|".join(p.rstrip("_") for p in FRAGMENT_PREFIXES) + ")_|^#"
    address = text.rlike(r"(?i)^(?:[a-z][a-z0-9+.\-]*://|www\.|mailto:)")
    return F.when(~address, name_key(F.regexp_replace(text, prefix, "")))


def utc_instant(col: Column) -> Column:
    """ISO text as a timestamp; without an offset it is UTC. Blank or malformed text gives null."""
    stripped = F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    text = F.when(stripped.rlike(r"^\d{4}-\d{2}-\d{2}"), stripped)  # a time alone would be read as today's
    zoned = F.when(text.rlike(r"(?i)(?:z|[+-]\d{2}(?::?\d{2})?)$") & text.rlike(r"\d{2}:\d{2}"), text).when(
        text.rlike(r"\d{2}:\d{2}"), F.concat(text, F.lit("Z"))
    ).otherwise(F.concat(text, F.lit("T00:00:00Z")))
    return zoned.try_cast("timestamp")


def utc_month(ts: Column) -> Column:
    """Months since the year 0 of an instant, in UTC whatever the session's time zone."""
    days = F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int")
    day = F.date_add(F.to_date(F.lit("1970-01-01")), days)
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def month_text(month: Column) -> Column:
    """``utc_month`` as YYYY-MM."""
    return F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"))
