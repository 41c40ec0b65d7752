"""Queries of landed pages: entries set as reference pages, read back into links, raw items and entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.symbols import CATEGORIES, FRAGMENT_PREFIXES
from glyphmill.operators import pages
from glyphmill.sources.files import page_links
from glyphmill.sources.tables import table

_PREFIX = {category: prefix for prefix, category in FRAGMENT_PREFIXES.items()}


def _escaped(col: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(sign), F.lit(entity))
    return col


def _element(tag: str, kind: str, text: Column) -> Column:
    """An element, or nothing for a null text."""
    return F.coalesce(F.concat(F.lit(f'<{tag} class="{pages.ITEM}__{kind}">'), text, F.lit(f"</{tag}>")), F.lit(""))


def _headed(title: str, body: Column) -> Column:
    return F.when(body != "", F.concat(F.lit(f'<div class="{pages.ITEM}__sub-header">{title}</div>'), body)).otherwise("")


def _each(field: str, shape: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.filter(F.coalesce(field, F.array()), lambda x: x.isNotNull()), shape), "")


def entry_pages(entries: DataFrame, key: str = "rec_id") -> DataFrame:
    """(page_id, html): every entry set as a page of its own.

    Its fragment has the prefix of its category where that is written plainly; else only the heading tells the category.
    """
    code = F.create_map(*[F.lit(x) for pair in _PREFIX.items() for x in pair])[F.col("category")]
    fragment = F.coalesce(F.concat(code, "name"), F.lit(""))
    said = lambda p: F.concat(p["name"], F.lit(" ("), F.coalesce(p["type"], F.lit("")), F.lit(") "), F.coalesce(p["description"], F.lit("")))
    text = lambda c: _element("p", "text", _escaped(c))
    content = F.concat(
        _element("div", "syntax", _escaped(F.col("syntax"))), _each("overloads", lambda o: _element("div", "syntax", _escaped(o))), text(F.col("description")),
        _headed("Arguments", _each("parameters", lambda p: text(said(p)))), _headed("Fields", _each("type_fields", lambda p: text(said(p)))), _headed("Returns", text(F.col("returns"))), _headed("Remarks", text(F.col("remarks"))),
        _each("examples", lambda e: F.concat(F.lit(f'<pre class="{pages.ITEM}__example"><code>'), _escaped(e), F.lit("</code></pre>"))),
        _headed("See also", F.concat(F.lit(f'<div class="{pages.ITEM}__see-also">'), _each("see_also", lambda s: F.concat(F.lit('<a href="ref/#'), _escaped(s), F.lit('">'), _escaped(s), F.lit("</a> "))), F.lit("</div>"))),
    )
    heading = F.concat(F.lit("<h2>"), _escaped(F.coalesce("category", F.lit(""))), F.lit("s</h2>"))
    item = F.concat(F.lit(f'<div class="{pages.ITEM}" id="'), _escaped(fragment), F.lit(f'"><h3 class="{pages.ITEM}__header">'), _escaped(F.coalesce("name", F.lit(""))), F.lit(f'</h3><div class="{pages.ITEM}__content">'), content, F.lit("</div></div>"))
    return entries.select(F.col(key).alias("page_id"), F.concat(F.lit("<html><body>"), heading, item, F.lit("<br/></body></html>")).alias("html"))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry, set as a page and read back."""
    items = pages.raw_items(entry_pages(table(spark, sf_dir, "pine_merged_entries").withColumn("see_also", F.array().cast("array<string>"))))
    found = pages.entries_of(items, table(spark, sf_dir, "discovery_index"))
    return found.select(
        F.col("page_id").alias("rec_id"), "name", "category", "namespace", "syntax", F.size("overloads").alias("n_overloads"), F.md5("description").alias("description_digest"), F.size("parameters").alias("n_parameters"),
        F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["type"])), ",").alias("parameter_list"), F.size("type_fields").alias("n_fields"), "returns", "remarks", F.size("examples").alias("n_examples"),
        F.md5(F.array_join("examples", "\n")).alias("examples_digest"), "deprecated",
    )


def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discovery index of pages that link every discovered fragment."""
    rows = table(spark, sf_dir, "discovery_index")
    html = F.concat(F.lit('<p><a class="x" href="ref/#'), "fragment", F.lit('"><b>'), _escaped(F.col("display_name")), F.lit("</b></a> <a href='ref/#top'>top</a></p>"))
    return page_links(rows.select(html.alias("html"))).select("fragment", "url", "display_name", "category", "namespace")


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The see-also links of every entry's page."""
    items = pages.raw_items(entry_pages(table(spark, sf_dir, "pine_merged_entries")))
    return items.select(F.col("page_id").alias("rec_id"), F.posexplode("see_also").alias("pos", "link"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (page_entries, page_index, page_references)}

_CATS = ", ".join(f"'{c}'" for c in CATEGORIES)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


_LINES = "list_transform(list_filter(coalesce({0}, []), lambda p: p.name IS NOT NULL), lambda p: trim(p.name || ' (' || coalesce(p.type, '') || ') ' || coalesce(p.description, '')))"
_PARSED = r"list_filter({0}, lambda l: regexp_matches(l, '^[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)'))"

ORACLE: dict[str, str] = {
    "page_entries": f"""WITH x AS (SELECT *, {_strip('name')} AS header, lower(regexp_extract(lower({_strip("coalesce(category, '') || 's'")}), '^\\S+')) AS heading FROM pine_merged_entries WHERE name IS NOT NULL),
        i AS (SELECT lower(replace(display_name, '()', '')) AS k, arg_min(category, struct_pack(f := fragment, c := category)) AS found FROM discovery_index WHERE category <> 'unknown' GROUP BY 1),
        n AS (SELECT *, {_strip("CASE WHEN strpos(header, '(') > 1 THEN substring(header, 1, strpos(header, '(') - 1) WHEN strpos(header, '(') = 0 AND strpos(header, '<') > 1 THEN substring(header, 1, strpos(header, '<') - 1) WHEN strpos(header, '<') > 1 THEN substring(header, 1, strpos(header, '<') - 1) ELSE header END")} AS parsed FROM x),
        c AS (SELECT n.*, CASE WHEN n.category IN ({_CATS}) THEN n.category WHEN right(heading, 1) = 's' AND left(heading, -1) IN ({_CATS}) THEN left(heading, -1) ELSE found END AS cat FROM n LEFT JOIN i ON i.k = lower(replace(parsed, '()', ''))),
        p AS (SELECT *, {_PARSED.format(_LINES.format('parameters'))} AS ps, {_PARSED.format(_LINES.format('type_fields'))} AS fs, list_transform(list_filter(coalesce(examples, []), lambda e: {_strip('e')} <> ''), lambda e: {_strip('e')}) AS es, regexp_replace({_strip('parsed')}, '^[()`]+|[()`]+$', '', 'g') AS bare,
          lower(concat_ws(' ', description, array_to_string({_LINES.format('parameters')}, ' '), array_to_string({_LINES.format('type_fields')}, ' '), returns, remarks)) AS alltext FROM c WHERE parsed <> '' AND cat IS NOT NULL)
        SELECT rec_id, parsed AS name, cat AS category, CASE WHEN contains(bare, '.') THEN nullif(split_part(bare, '.', 1), '') END AS namespace, CASE WHEN syntax IS NULL THEN {_strip("list_filter(coalesce(overloads, []), lambda o: o IS NOT NULL)[1]")} ELSE {_strip('syntax')} END AS syntax,
          CAST(greatest(0, len(list_filter(coalesce(overloads, []), lambda o: o IS NOT NULL)) - CASE WHEN syntax IS NULL THEN 1 ELSE 0 END) AS INT) AS n_overloads, md5({_strip('description')}) AS description_digest, CAST(len(ps) AS INT) AS n_parameters,
          array_to_string(list_transform(ps, lambda l: regexp_extract(l, '^([a-zA-Z_][a-zA-Z0-9_]*)', 1) || ':' || {_strip("regexp_extract(l, '[(]([^)]*)[)]', 1)")}), ',') AS parameter_list, CAST(len(fs) AS INT) AS n_fields,
          nullif({_strip('returns')}, '') AS returns, nullif({_strip('remarks')}, '') AS remarks, CAST(len(es) AS INT) AS n_examples, md5(array_to_string(es, chr(10))) AS examples_digest,
          contains(alltext, 'deprecated') OR contains(alltext, 'obsolete') OR contains(alltext, 'no longer supported') OR contains(alltext, 'removed in') AS deprecated FROM p""",
    "page_index": f"""WITH k AS (SELECT fragment, {_strip('display_name')} AS display_name, CASE {' '.join(f"WHEN starts_with(fragment, '{p}') THEN '{c}'" for p, c in FRAGMENT_PREFIXES.items())} END AS category FROM discovery_index),
        f AS (SELECT fragment, category, min(display_name) AS display_name FROM k WHERE category IS NOT NULL GROUP BY 1, 2)
        SELECT fragment, '#' || fragment AS url, display_name, category, CASE WHEN contains(b, '.') THEN nullif(split_part(b, '.', 1), '') END AS namespace FROM (SELECT *, regexp_replace(display_name, '^[()`]+|[()`]+$', '', 'g') AS b FROM f)""",
    "page_references": f"""SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1 AS INT) AS pos, link FROM (SELECT rec_id, i, {_strip('e')} AS link FROM (SELECT rec_id, unnest(see_also) AS e, generate_subscripts(see_also, 1) AS i FROM pine_merged_entries)) WHERE link <> ''""",
}
