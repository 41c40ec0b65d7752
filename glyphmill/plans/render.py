"""Queries of rendering: details of entries, listings, capped texts, script addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import render
from glyphmill.functions import scalar as S
from glyphmill.operators import lookup
from glyphmill.sources.tables import table

#: Characters after which the texts of the query are capped.
LIMIT = 1_000


def entry_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full text of every catalogue row, with its digest and length."""
    rows = table(spark, sf_dir, "catalog_records").select("row_no", render.entry_detail().alias("detail"))
    return rows.select("row_no", F.md5("detail").alias("digest"), F.length("detail").alias("n_chars"))


def namespace_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every catalogue row as a line of its namespace's listing and cheat sheet, with what the lines are sorted by.

    Lines are rows, so that a large namespace is no single row; ``global`` is the empty namespace.
    """
    ordered = lookup.CATEGORY_ORDER
    return table(spark, sf_dir, "catalog_records").select(
        F.when(F.coalesce("namespace", F.lit("")) == "", "global").otherwise(F.col("namespace")).alias("listing"), lookup.category_rank(F.col("category")).alias("place"), "category", "name", "row_no",
        render.display_name(F.col("name"), F.col("namespace")).alias("display_name"), render.listing_line(ordered).alias("line"), render.cheatsheet_line(ordered).alias("cheat_line"), render.first_paragraph(F.col("raw_description"), 60).alias("snippet"),
    )


def capped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text capped, its open fence closed and the rest counted."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", render.capped(F.col("text"), LIMIT).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))


def script_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all symbols as they stand in an address."""
    return table(spark, sf_dir, "pine_merged_entries").filter("name is not null").select("rec_id", S.script_id(F.col("name")).alias("script_id"), S.namespace_of(F.col("name")).alias("namespace"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (entry_details, namespace_listing, capped_texts, script_ids)}


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|[\\n\\v\\f\\r]'), lambda l: {_strip('l')}), lambda l: l <> '')"


_MEMBER = """'  ' || coalesce(json_extract_string(m, '$.name'), '?') || CASE WHEN coalesce(json_extract_string(m, '$.type'), '') <> '' THEN ' (' || json_extract_string(m, '$.type') || ')' ELSE '' END{extra}
    || CASE WHEN coalesce(json_extract_string(m, '$.description'), '') <> '' THEN chr(10) || '    ' || json_extract_string(m, '$.description') ELSE '' END"""
_OPTIONAL = """ || CASE WHEN coalesce(json_extract_string(m, '$.optional'), '') NOT IN ('', 'false', '0') THEN ' [optional]' ELSE '' END || coalesce(' = ' || json_extract_string(m, '$.default'), '')"""
_LIST = "CASE WHEN starts_with({0}, '[') AND json_valid({0}) THEN CAST({0} AS JSON[]) END"
_DEDUP_KEY = r"substring(lower(regexp_replace(e, '\s+', '', 'g')), 1, 120)"
_SIGNATURE = "'  ' || CASE WHEN coalesce(syntax, '') <> '' THEN substring(syntax, 1, {0}) ELSE coalesce(name, '?') END || CASE WHEN coalesce(returns, '') <> '' THEN ' -> ' || substring(returns, 1, {1}) ELSE '' END"
_SENTENCE = "substring(split_part(coalesce(raw_description, ''), '.', 1), 1, {0})"
_ORDERED = ", ".join(f"'{c}'" for c in lookup.CATEGORY_ORDER)

ORACLE: dict[str, str] = {
    "entry_details": f"""WITH b AS (SELECT row_no, unnest(bs) AS e, generate_subscripts(bs, 1) AS i FROM (SELECT row_no, list_filter(list_transform(string_split(raw_examples, ' ||| '), lambda b: {_strip('b')}), lambda b: b <> '') AS bs FROM catalog_records WHERE raw_examples <> '')),
        k AS (SELECT row_no, e, i, {_DEDUP_KEY} AS k, length(e) - length(replace(e, chr(10), '')) AS l FROM b),
        f AS (SELECT row_no, k, min(i) AS seen, arg_min(e, struct_pack(l := -l, i := i)) AS e FROM k GROUP BY 1, 2),
        t AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY seen) AS n FROM f),
        ex AS (SELECT row_no, 'EXAMPLES (' || count(*) || '):' || chr(10) || string_agg('--- Example ' || n || ' ---' || chr(10) || regexp_replace(e, '\\r\\n|[\\n\\v\\f\\r]', chr(10), 'g'), chr(10) ORDER BY n) AS ex FROM t WHERE n <= 3 GROUP BY 1),
        r AS (SELECT c.*, ex, {_strip("coalesce(document, '')")} AS doc, {_LIST.format('raw_parameters')} AS ps, {_LIST.format('raw_type_fields')} AS fs FROM catalog_records c LEFT JOIN ex USING (row_no)),
        d AS (SELECT row_no, CASE WHEN length(doc) < 10 THEN '''' || coalesce(name, '?') || ''' was found but has no local documentation.' ELSE concat_ws(chr(10),
          upper(coalesce(category, '?')) || ': ' || CASE WHEN coalesce(namespace, '') <> '' AND NOT starts_with(coalesce(name, '?'), namespace || '.') THEN namespace || '.' ELSE '' END || coalesce(name, '?'),
          'SYNTAX: ' || nullif(syntax, ''), concat_ws(chr(10), 'DESCRIPTION:', nullif(array_to_string({_lines("CASE WHEN coalesce(raw_description, '') <> '' THEN raw_description ELSE doc END")}, chr(10)), '')),
          CASE WHEN coalesce(raw_parameters, '') = '' THEN CASE WHEN param_count > 0 THEN 'PARAMETERS: ' || param_count || ' parameters' END WHEN len(ps) > 0 THEN 'PARAMETERS (' || len(ps) || '):' || chr(10) || array_to_string(list_transform(ps, lambda m: {_MEMBER.format(extra=_OPTIONAL)}), chr(10)) END,
          'RETURNS: ' || nullif(returns, ''), CASE WHEN coalesce(remarks, '') <> '' THEN concat_ws(chr(10), 'REMARKS:', nullif(array_to_string({_lines('remarks')}, chr(10)), '')) END,
          CASE WHEN len(fs) > 0 THEN 'FIELDS:' || chr(10) || array_to_string(list_transform(fs, lambda m: {_MEMBER.format(extra='')}), chr(10)) END,
          CASE WHEN coalesce(raw_examples, '') = '' THEN CASE WHEN example_count > 0 THEN 'EXAMPLES: ' || example_count || ' examples available' END ELSE ex END, 'SEE ALSO: ' || nullif(raw_see_also, '')) END AS detail FROM r)
        SELECT row_no, md5(detail) AS digest, CAST(length(detail) AS INT) AS n_chars FROM d""",
    "namespace_listing": f"""SELECT CASE WHEN coalesce(namespace, '') = '' THEN 'global' ELSE namespace END AS listing, CAST(coalesce(list_position([{_ORDERED}], category) - 1, 99) AS INT) AS place, category, name, row_no,
        CASE WHEN coalesce(namespace, '') <> '' AND NOT starts_with(name, namespace || '.') THEN namespace || '.' || name ELSE name END AS display_name,
        CASE WHEN category = 'function' THEN {_SIGNATURE.format(80, 30)} ELSE '  ' || coalesce(name, '?') || CASE WHEN category IN ({_ORDERED}) AND {_SENTENCE.format(100)} <> '' THEN ' - ' || {_SENTENCE.format(100)} ELSE '' END END AS line,
        CASE WHEN category = 'function' THEN {_SIGNATURE.format(70, 25)} ELSE '  ' || coalesce(name, '?') END || CASE WHEN category IN ({_ORDERED}) AND {_SENTENCE.format(80)} <> '' THEN chr(10) || '    ' || {_SENTENCE.format(80)} ELSE '' END AS cheat_line,
        CASE WHEN length(split_part(coalesce(raw_description, ''), chr(10) || chr(10), 1)) > 60 THEN substring(split_part(raw_description, chr(10) || chr(10), 1), 1, 60) || '...' ELSE split_part(coalesce(raw_description, ''), chr(10) || chr(10), 1) END AS snippet FROM catalog_records""",
    "capped_texts": f"""WITH k AS (SELECT doc_id, text, substring(text, 1, {LIMIT}) AS kept FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, text, kept, list_reduce(list_transform(string_split(kept, chr(10)), lambda x: CASE WHEN {_strip('x')} = '```' OR starts_with({_strip('x')}, '``` ') THEN 2 WHEN starts_with({_strip('x')}, '```') THEN 1 ELSE 0 END), lambda a, x: CASE WHEN x = 0 THEN a WHEN a = 1 THEN CASE WHEN x = 2 THEN 0 ELSE 1 END ELSE 1 END, 0) AS fenced FROM k),
        c AS (SELECT doc_id, text, CASE WHEN fenced = 1 THEN kept || chr(10) || '```' ELSE kept END AS closed FROM l),
        t AS (SELECT doc_id, CASE WHEN length(text) <= {LIMIT} THEN text ELSE closed || chr(10) || chr(10) || '[...truncated - ' || format('{{:,}}', length(text) - length(closed)) || ' chars omitted]' END AS t FROM c)
        SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INT) AS n_chars FROM t""",
    "script_ids": f"""SELECT rec_id, replace(replace(name, '%', '%25'), ' ', '%25') AS script_id, CASE WHEN contains(b, '.') THEN nullif(split_part(b, '.', 1), '') END AS namespace FROM (SELECT rec_id, name, regexp_replace({_strip('name')}, '^[()`]+|[()`]+$', '', 'g') AS b FROM pine_merged_entries WHERE name IS NOT NULL)""",
}
