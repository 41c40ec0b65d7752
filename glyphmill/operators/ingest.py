"""Building the catalogue: flat records, document text, the two-source merge, sibling enrichment, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.scalar import base_name, merge_key, return_type



def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _known(name: str) -> Column:
    """Elements of an array that are not null; an empty array for null."""
    return F.filter(F.coalesce(F.col(name), F.array()), lambda x: x.isNotNull())


def document_text(entries: DataFrame) -> DataFrame:
    """Adds ``document``: the non-empty parts of an entry joined by blank lines."""

    def part(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value))

    examples, see_also = _known("examples"), _known("see_also")
    shown = F.when(F.size(examples) > 0, F.concat(F.lit("EXAMPLES:\n\n"), F.array_join(examples, "\n\n")))
    return entries.withColumn(
        "document",
        F.concat_ws(
            "\n\n", F.concat(F.upper(_text("category")), F.lit(": "), _text("name")), part("Namespace: ", _text("namespace")), part("Syntax: ", _text("syntax")),
            part("", _text("description")), part("Returns: ", _text("returns")), part("Remarks: ", _text("remarks")), shown, part("See also: ", F.array_join(see_also, ", ")),
        ),
    )


def flatten(entries: DataFrame, key: str = "rec_id") -> DataFrame:
    """The flat record of each entry: nulls as empty text, flags as 0/1, arrays counted, joined or as JSON.

    Null elements of arrays are left out of counts and joined texts. JSON members that are null are left out.
    """
    typed = return_type(F.col("syntax"))
    returns = F.when(typed != "", typed).otherwise(_text("returns"))
    count = {n: F.size(_known(n)) for n in ("examples", "parameters", "overloads")}
    as_json = lambda n: F.when(F.size(_known(n)) > 0, F.to_json(_known(n))).otherwise(F.lit(""))
    return entries.select(
        key, _text("name").alias("name"), _text("category").alias("category"), _text("namespace").alias("namespace"), _text("syntax").alias("syntax"), returns.alias("returns"),
        F.when(_text("returns") != returns, _text("returns")).otherwise(F.lit("")).alias("raw_returns_description"), _text("remarks").alias("remarks"),
        F.coalesce(F.col("deprecated"), F.lit(False)).cast("int").alias("deprecated"), F.array_join(_known("sources"), ", ").alias("sources"), _text("url").alias("url"), _text("scraped_at").alias("scraped_at"),
        (count["examples"] > 0).cast("int").alias("has_examples"), count["examples"].alias("example_count"), count["parameters"].alias("param_count"), count["overloads"].alias("overload_count"),
        _text("description").alias("raw_description"), F.array_join(_known("examples"), " ||| ").alias("raw_examples"), as_json("parameters").alias("raw_parameters"), as_json("overloads").alias("raw_overloads"),
        as_json("type_fields").alias("raw_type_fields"), F.array_join(_known("see_also"), ", ").alias("raw_see_also"),
    )


def last_wins(rows: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """One row per key, the last by ``order``: an aggregation of the greatest struct, so hot keys combine before the shuffle."""
    columns = rows.columns
    grouped = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return grouped.select("_row.*")


#: Fields that the merge takes from the richer side, as whole texts.
_RICHER = ("description", "syntax", "remarks", "returns")


def merge_sources(local: DataFrame, live: DataFrame, order: str = "rec_id") -> DataFrame:
    """Full outer merge of two sources by name and category, with field rules.

    Each side keeps its last row per key. Live values override where not null; if the local side has more text in
    description and syntax, its non-empty texts win where live is empty or shorter. Examples are both sides', first
    copies kept; parameters and overloads are live's unless empty; see_also is the sorted union; match_kind tells
    which sides had the key.
    """
    fields = [c for c in ("name", "category", "namespace", *_RICHER, "examples", "parameters", "overloads", "see_also", "deprecated", "url", "scraped_at") if c in local.columns]
    key = merge_key(F.col("name"), F.col("category"))

    def side(rows: DataFrame, mark: str) -> DataFrame:
        kept = last_wins(rows.select(order, *fields), [key], F.col(order))
        return kept.select(merge_key(F.col("name"), F.col("category")).alias("merge_key"), *[F.col(f).alias(f"{mark}_{f}") for f in fields], F.lit(True).alias(mark))

    both = side(local, "a").join(side(live, "b"), "merge_key", "full_outer")
    has_a, has_b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    size = lambda m: F.length(F.coalesce(f"{m}_description", F.lit(""))) + F.length(F.coalesce(f"{m}_syntax", F.lit("")))
    local_richer = has_a & has_b & (size("a") > size("b"))

    def value(field: str) -> Column:
        a, b = F.col(f"a_{field}"), F.col(f"b_{field}")
        over = F.coalesce(b, a)
        if field in _RICHER:
            la, lb = F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit("")))
            return F.when(local_richer & (la > 0) & ((lb == 0) | (la > lb)), a).otherwise(over)
        if field in ("parameters", "overloads"):
            return F.when(F.size(F.coalesce(b, F.array())) > 0, b).when(has_a, a).otherwise(b)
        if field == "examples":
            return F.array_distinct(F.concat(_list(a), _list(b)))
        if field == "see_also":
            return F.array_sort(F.array_distinct(F.concat(_list(a), _list(b))))
        return over

    def _list(col: Column) -> Column:
        return F.filter(F.coalesce(col, F.array()), lambda x: x.isNotNull())

    kind = F.when(has_a & has_b, "both").when(has_a, "local_only").otherwise("live_only")
    return both.select("merge_key", kind.alias("match_kind"), *[value(f).alias(f) for f in fields])


def enrich_siblings(entries: DataFrame, key: str = "rec_id") -> DataFrame:
    """Truncated entries take the longest full syntax of the entries with their base name.

    Of a group of two or more, the longest syntax with an arrow (ties: smallest key) is given to members whose syntax
    has a parenthesis but no arrow, with its return type and, where they have none, its parameters. The group's best
    is found by an aggregation and joined back; a null syntax or name counts as empty.
    """
    syntax = F.coalesce("syntax", F.lit(""))
    arrow = syntax.contains("→") | syntax.contains("->")
    base = base_name(F.coalesce("name", F.lit("")))
    named = entries.withColumn("_base", base)
    best = (
        named.groupBy("_base")
        .agg(F.count("*").alias("_n"), F.max(F.when(arrow, F.struct(F.length(syntax).alias("l"), (-F.col(key)).alias("k"), syntax.alias("syntax"), F.col("parameters").alias("parameters")))).alias("_best"))
        .filter("_n > 1 and _best is not null")
    )
    joined = named.join(best, "_base", "left")
    cut_short = F.col("_best").isNotNull() & ~arrow & syntax.contains("(")
    typed = return_type(F.col("_best.syntax"))
    old = F.coalesce("returns", F.lit(""))
    lacking = F.size(F.coalesce("parameters", F.array())) == 0
    return joined.select(
        *[c for c in entries.columns if c not in ("syntax", "returns", "parameters")],
        F.when(cut_short, F.col("_best.syntax")).otherwise(F.col("syntax")).alias("syntax"),
        F.when(cut_short & (typed != ""), typed).otherwise(F.col("returns")).alias("returns"),
        F.when(cut_short & lacking & (F.size(F.coalesce("_best.parameters", F.array())) > 0), F.col("_best.parameters")).otherwise(F.col("parameters")).alias("parameters"),
        F.when(cut_short & (typed != "") & (old != "") & (old != typed), old).alias("returns_prose"),
        cut_short.alias("enriched"),
    )


def new_only(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key the existing rows do not have; null keys are new."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def index_category(rows: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """Adds index_category: the category of the discovery row with the same name, first by fragment; null without one.

    Names are compared in lower case and without ``()``. Rows of the index without a known category do not count.
    """
    key = lambda c: F.lower(F.replace(F.col(c), F.lit("()"), F.lit("")))
    known = index.filter(F.col("category") != "unknown").groupBy(key("display_name").alias("_key")).agg(F.min_by("category", F.struct("fragment", "category")).alias("index_category"))
    return rows.withColumn("_key", key(name)).join(known, "_key", "left").drop("_key")
