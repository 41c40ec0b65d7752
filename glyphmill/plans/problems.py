"""Queries of the general data problems (2, 3, 4) over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.operators import nested, orphans, packed
from glyphmill.session import cut
from glyphmill.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each child of the entries and payloads, at any depth."""
    return p2_bridge(spark, sf_dir).select("src_table", "row_key", "child_path")


def p2_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a child with its parent's place and both identities."""
    rows = nested.bridge(table(spark, sf_dir, "pine_merged_entries"), table(spark, sf_dir, "pine_entry_payloads"))
    return rows.drop("own_json")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.bridge(table(spark, sf_dir, "pine_merged_entries"), table(spark, sf_dir, "pine_entry_payloads"), roots=True)


def p2_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct object once, the entries themselves included, with its number of occurrences."""
    return nested.objects(_occurrences(spark, sf_dir))


def p2_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence beside its stored object: the round trip from the flat tables."""
    rows = cut(_occurrences(spark, sf_dir))
    return nested.expanded(rows, nested.objects(rows)).select("src_table", "row_key", "child_path", "child_kind", "own_json")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences whose object or parent is not stored, by table: none."""
    rows = cut(_occurrences(spark, sf_dir))
    return nested.unresolved(rows, nested.objects(rows))


def p2_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of the typed entries, with their text out of the store of distinct objects."""
    rows = nested.entry_children(table(spark, sf_dir, "pine_merged_entries"))
    return nested.expanded(rows, nested.objects(rows)).select("row_key", "child_path", "child_kind", "ordinal", "own_json")


def _orphan_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("pine_merged_entries", "builtin_symbols", "entry_removals"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each orphan element of see_also."""
    return orphans.orphan_references(*_orphan_tables(spark, sf_dir))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references by table and month."""
    return orphans.orphan_report(*_orphan_tables(spark, sf_dir), table="pine_merged_entries")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value packed in the cells of the catalogue."""
    return packed.unpack(table(spark, sf_dir, "catalog_records"))


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source packed in the cells of the catalogue: the part of problem 4 whose forms SQL can read."""
    return packed.unpack(table(spark, sf_dir, "catalog_records"), fields=("sources",)).select("row_no", "pos", "item_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_bridge, p2_objects, p2_expanded, p2_links, p2_typed, p3_found, p3_report, p4_found, p4_sources)
}

#: SQL that states a query's result; for the others SQL is too weak (JSON of free shapes, quoting rules).
_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"
_SIGNS = r"regexp_replace({0}, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}\"''`‘’“”«»]+', '', 'g')"
_CATS = "('function','variable','constant','type','keyword','annotation','operator')"


def name_key_sql(col: str) -> str:
    """``name_key`` in DuckDB's SQL."""
    return f"CASE WHEN {_KEY.format(col)} <> '' THEN {_KEY.format(col)} ELSE nullif({_SIGNS.format(col)}, '') END"


def symbol_sql(table_name: str, columns: str) -> str:
    """A subquery with sym_name and sym_category in DuckDB's SQL."""
    n, c = _KEY.format("name"), _KEY.format("category")
    swapped = f"coalesce({n} IN {_CATS} AND ({name_key_sql('category')}) IS NOT NULL AND {c} NOT IN {_CATS}, false)"
    return (
        f"SELECT {columns}, {name_key_sql('raw_name')} AS sym_name, nullif({_KEY.format('raw_category')}, '') AS sym_category FROM "
        f"(SELECT *, CASE WHEN {swapped} THEN category ELSE name END AS raw_name, CASE WHEN {swapped} THEN name ELSE category END AS raw_category FROM {table_name})"
    )


_UTC = "TRY_CAST(CASE WHEN regexp_matches(scraped_at, '(Z|[+-]\\d\\d:\\d\\d)$') THEN scraped_at ELSE scraped_at || '+00:00' END AS TIMESTAMPTZ)"
_MONTH = f"(year({_UTC} AT TIME ZONE 'UTC') * 12 + month({_UTC} AT TIME ZONE 'UTC') - 1)"

_P3 = f"""
WITH e AS ({symbol_sql('pine_merged_entries', f'rec_id, see_also, {_MONTH} AS m')}),
held AS (SELECT sym_name AS k, min(m) AS first_m FROM e WHERE sym_name IS NOT NULL GROUP BY 1),
builtin AS (SELECT DISTINCT {name_key_sql('name')} AS k FROM builtin_symbols),
gone AS (SELECT DISTINCT sym_name AS k FROM ({symbol_sql('entry_removals', 'removal_id')}) WHERE sym_name IS NOT NULL),
x AS (SELECT rec_id, m, unnest(see_also) AS el, generate_subscripts(see_also, 1) - 1 AS pos FROM e),
y AS (SELECT rec_id, m, pos, regexp_replace(trim(el, ' \t\n\r'), '^#?(fun|var|const|type|kw|op|an)_|^#', '') AS el FROM x WHERE NOT regexp_matches(el, '^\\s*[A-Za-z]+://')),
r AS (SELECT rec_id, m, pos, {name_key_sql('el')} AS k FROM y),
o AS (SELECT r.*, CASE WHEN h.k IS NULL AND b.k IS NULL THEN CASE WHEN g.k IS NULL THEN 'missing' ELSE 'deleted' END
                       WHEN h.k IS NOT NULL AND b.k IS NULL AND h.first_m > r.m THEN 'late' END AS orphan_kind
      FROM r LEFT JOIN held h USING (k) LEFT JOIN builtin b USING (k) LEFT JOIN gone g USING (k) WHERE r.k IS NOT NULL)
"""



def _members_sql(element: str, *names: str) -> str:
    parts = ", ".join(f"""CASE WHEN {element}."{n}" IS NOT NULL THEN '"{n}":' || CAST(to_json({element}."{n}") AS VARCHAR) END""" for n in sorted(names))
    return "'{' || concat_ws(',', " + parts + ") || '}'"


def _children_sql(field: str, text: str) -> str:
    each = f"SELECT rec_id, unnest({field}) AS e, generate_subscripts({field}, 1) - 1 AS i FROM pine_merged_entries"
    return f"SELECT rec_id AS row_key, '{field}[' || i || ']' AS child_path, '{field}' AS child_kind, CAST(i AS INT) AS ordinal, {text} AS own_json FROM ({each}) WHERE e IS NOT NULL"


_EDGES = r"regexp_replace({0}, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g')"
_BARE = f"""CASE WHEN regexp_matches(t, '^(".*"|''.*''|“.*”|`.*`)$') THEN {_EDGES.format('substring(t, 2, length(t) - 2)')} ELSE t END"""

ORACLE: dict[str, str] = {
    "p4_sources": rf"""WITH c AS (SELECT row_no, sources AS cell FROM catalog_records WHERE sources <> ''),
        t AS (SELECT row_no, CASE WHEN json_valid(cell) AND regexp_matches(cell, '^\s*\[') THEN list_transform(CAST(cell AS JSON[]), lambda j: {_EDGES.format("json_extract_string(j, '$')")})
          ELSE list_transform(list_transform(regexp_extract_all(cell, '"[^"]*"|''[^'']*''|“[^”]*”|`[^`]*`|[^,;|·+\t\n"''“`]+'), lambda x: {_EDGES.format('x')}), lambda t: {_BARE}) END AS vs FROM c),
        f AS (SELECT row_no, list_filter(vs, lambda v: v <> '') AS vs FROM t)
        SELECT row_no, CAST(generate_subscripts(vs, 1) - 1 AS INT) AS pos, unnest(vs) AS item_text FROM f""",
    "p2_links": "SELECT unnest(['pine_merged_entries', 'pine_entry_payloads']) AS src_table, CAST(0 AS BIGINT) AS n_objects, CAST(0 AS BIGINT) AS n_parents",
    "p2_typed": " UNION ALL ".join(
        [
            _children_sql("parameters", _members_sql("e", "name", "type", "description", "optional", "default")), _children_sql("overloads", "CAST(to_json(e) AS VARCHAR)"),
            _children_sql("type_fields", _members_sql("e", "name", "type", "description")),
        ]
    ),
    "p3_found": _P3 + "SELECT rec_id, CAST(pos AS INT) AS pos, orphan_kind FROM o WHERE orphan_kind IS NOT NULL",
    "p3_report": _P3
    + """SELECT 'pine_merged_entries' AS src_table, CASE WHEN m IS NULL THEN NULL ELSE printf('%04d-%02d', CAST(m // 12 AS INT), CAST(m % 12 + 1 AS INT)) END AS month,
         orphan_kind, count(*) AS n_references, count(DISTINCT k) AS n_keys FROM o WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3""",
}
