"""Queries of catalogue building and exact lookup, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import scalar as S
from glyphmill.operators import ingest, lookup
from glyphmill.sources.tables import table

#: Expected rows per category: (least, most) of a full scrape.
RANGES = {"function": (470, 520), "variable": (150, 180), "constant": (180, 220), "type": (15, 25), "keyword": (15, 25), "operator": (15, 20), "annotation": (5, 10)}
#: Namespaces and names of the hot subset, parameters of the query.
HOT_NAMESPACES = ["chartstd", "tidekit", "surflab"]
HOT_NAMES = ["chartstd.smoothlinearlotlimitprev", "@hedgeearlygapbudgetmax"]


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised forms of every discovered name."""
    rows = table(spark, sf_dir, "discovery_index")
    name = F.col("display_name")
    return rows.select(
        "fragment", S.merge_key(name, F.col("category")).alias("merge_key"), S.base_name(name).alias("base_name"), S.bare_name(name).alias("bare_name"), S.index_key(name).alias("index_key"),
        S.namespace_of(name).alias("namespace_found"), S.fragment_category(F.col("fragment")).alias("fragment_category"), S.identifier(name).alias("identifier"), S.namespace_key(F.col("namespace")).alias("namespace_key"),
    )


def flatten_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat record of every entry."""
    return ingest.flatten(table(spark, sf_dir, "pine_merged_entries")).drop("raw_parameters", "raw_type_fields")


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every entry's document text, and its length."""
    rows = ingest.document_text(table(spark, sf_dir, "pine_merged_entries"))
    return rows.select("rec_id", F.md5("document").alias("digest"), F.length("document").alias("n_chars"))


def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the shipped manual merged with entries of the live pages."""
    rows = table(spark, sf_dir, "pine_merged_entries")
    merged = ingest.merge_sources(rows.filter("source = 'local_docs'"), rows.filter("source = 'live_site'"))
    return merged.select(
        "merge_key", "match_kind", "name", "syntax", "description", "returns", "remarks", F.size("examples").alias("n_examples"), F.array_join("see_also", "|").alias("see_also"), F.size(F.coalesce("parameters", F.array())).alias("n_parameters")
    )


def enrich_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that take a fuller syntax from a sibling."""
    rows = ingest.enrich_siblings(table(spark, sf_dir, "pine_merged_entries"))
    return rows.filter("enriched").select("rec_id", "syntax", "returns", "returns_prose", F.size(F.coalesce("parameters", F.array())).alias("n_parameters"))


def upsert_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the last row of each id."""
    rows = table(spark, sf_dir, "catalog_records").filter("id is not null")
    return ingest.last_wins(rows.select("id", "row_no", "name", "category"), [F.col("id")], F.col("row_no"))


def new_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered names that the catalogue does not hold yet."""
    key = lambda c: F.lower(F.replace(F.col(c), F.lit("()"), F.lit("")))
    found = table(spark, sf_dir, "discovery_index").withColumn("name_key", key("display_name"))
    held = table(spark, sf_dir, "catalog_records").withColumn("name_key", key("name"))
    return ingest.new_only(found, held, "name_key").groupBy("category").agg(F.countDistinct("fragment").alias("n_fragments"), F.count("*").alias("n_rows"))


def union_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all three tables together, with where they come from."""
    built = table(spark, sf_dir, "builtin_symbols").select("name", F.lit("builtin").alias("origin"))
    gone = table(spark, sf_dir, "entry_removals").select("name", "category", F.lit("removal").alias("origin"))
    held = table(spark, sf_dir, "catalog_records").select("name", "category", F.lit("catalog").alias("origin"))
    rows = held.unionByName(gone).unionByName(built, allowMissingColumns=True)
    return rows.groupBy("origin", "category").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


def index_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows beside the category that the discovery index gives their name."""
    rows = ingest.index_category(table(spark, sf_dir, "catalog_records"), table(spark, sf_dir, "discovery_index"))
    return rows.select("row_no", "category", "index_category")


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by category and source."""
    return table(spark, sf_dir, "pine_merged_entries").groupBy("category", "source").agg(F.count("*").alias("n"), F.countDistinct("namespace").alias("n_namespaces"))


def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the catalogue outside their expected range."""
    counts = table(spark, sf_dir, "catalog_records").groupBy("category").agg(F.count("*").alias("n"))
    return lookup.range_check(counts, RANGES)


def total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the discovery found enough."""
    return lookup.total_check(table(spark, sf_dir, "discovery_index"))


def name_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every catalogue row under its name."""
    return lookup.name_members(table(spark, sf_dir, "catalog_records"))


def short_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that go with each type whose document is short."""
    return lookup.short_types(table(spark, sf_dir, "catalog_records")).select("row_no", "n_methods", F.array_join("methods", "|").alias("methods"))


def flatten_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the flat record that are JSON."""
    return ingest.flatten(table(spark, sf_dir, "pine_merged_entries")).select("rec_id", "raw_parameters", "raw_overloads", "raw_type_fields")


def scrape_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all entries."""
    return lookup.scrape_report(table(spark, sf_dir, "pine_merged_entries"), table(spark, sf_dir, "discovery_index"))


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts over the catalogue."""
    return table(spark, sf_dir, "catalog_records").agg(
        F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.countDistinct("namespace").alias("n_namespaces"), F.count_if(F.col("has_examples") == 1).alias("n_with_examples"),
        F.sum("example_count").alias("n_examples"), F.sum("param_count").alias("n_parameters"), F.count_if(F.col("deprecated") == 1).alias("n_deprecated"), F.count_if(F.coalesce("raw_see_also", F.lit("")) != "").alias("n_with_see_also"),
    )


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct namespaces of the discovery index."""
    return table(spark, sf_dir, "discovery_index").filter("namespace is not null").select("namespace").distinct()


def filter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and variables of two namespaces with examples, examples as a category left out."""
    rows = lookup.where(table(spark, sf_dir, "catalog_records"), equal={"has_examples": 1}, one_of={"namespace": ["tidekit", "surflab"], "category": ["function", "variable"]}, unequal={"category": "example"})
    return rows.select("row_no", "name", "category", S.is_function_like(F.col("syntax"), F.col("raw_parameters")).alias("function_like"))


def return_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows that return a float, by the type's own word."""
    rows = table(spark, sf_dir, "catalog_records").withColumn("found", S.return_type(F.col("syntax")))
    return rows.filter(S.return_type_matches(F.lit("float"), F.col("found"))).select("row_no", "found")


def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of names."""
    return lookup.name_index(table(spark, sf_dir, "catalog_records"))


def best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of every name."""
    return lookup.best_version(table(spark, sf_dir, "catalog_records"))


def hot_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners of the hot subset."""
    return lookup.hot_winners(table(spark, sf_dir, "catalog_records"), HOT_NAMESPACES, HOT_NAMES)


def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each namespace holds, in listing order."""
    return lookup.browse(table(spark, sf_dir, "catalog_records"))


def type_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of each namespace, the first thirty by name."""
    return lookup.type_methods(table(spark, sf_dir, "catalog_records")).select("owner", "n_methods", F.array_join("methods", "|").alias("methods"))


def parse_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter lines as text, parsed back into their parts."""
    each = table(spark, sf_dir, "pine_merged_entries").select("rec_id", F.posexplode("parameters").alias("pos", "p")).filter("p.name is not null")
    line = F.concat("p.name", F.lit(" ("), F.coalesce("p.type", F.lit("")), F.lit(") "), F.coalesce("p.description", F.lit("")))
    return each.select("rec_id", "pos", S.parse_parameter(line).alias("q")).select("rec_id", "pos", "q.name", "q.type", "q.description", "q.optional", "q.default")


def payload_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed payloads as a listing: name, category and what is deprecated, through every wrapping."""
    raw = F.col("payload")
    text = F.when(F.trim(raw).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw)
    pick = lambda field: F.coalesce(F.get_json_object("text", f"$.result.{field}"), F.get_json_object("text", f"$.{field}"))
    rows = table(spark, sf_dir, "pine_entry_payloads").select("land_id", text.alias("text"))
    return rows.select("land_id", pick("name").alias("name"), pick("category").alias("category"), F.coalesce(pick("namespace"), F.lit("")).alias("namespace")).filter("name is not null").groupBy("namespace", "category").agg(
        F.count("*").alias("n"), F.countDistinct("name").alias("n_names")
    )


def distinct_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries' examples after near-equal ones are gone."""
    rows = table(spark, sf_dir, "pine_merged_entries").select("rec_id", F.size(F.coalesce("examples", F.array())).alias("n_before"), "examples")
    from glyphmill.operators.search import distinct_examples as distinct

    return rows.withColumn("kept", distinct(F.col("examples"))).select("rec_id", "n_before", F.size("kept").alias("n_kept"), F.md5(F.array_join("kept", "\n\n")).alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_names, flatten_metadata, document_text, merge_sources, enrich_siblings, upsert_catalog, new_fragments, union_removed, index_category, category_counts, range_check, scrape_report,
        catalog_stats, namespaces, filter_metadata, return_types, name_index, best_version, hot_winners, browse, type_methods, total_check, name_members, short_types, flatten_members, parse_parameters, payload_listing, distinct_examples,
    )
}

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _listed(field: str, names: tuple[str, ...]) -> str:
    """A field as JSON in SQL, members that are null left out; empty without an element."""
    parts = ", ".join(f"""CASE WHEN e."{n}" IS NOT NULL THEN '"{n}":' || CAST(to_json(e."{n}") AS VARCHAR) END""" for n in names)
    element = f"'{{' || concat_ws(',', {parts}) || '}}'" if names else "CAST(to_json(e) AS VARCHAR)"
    known = f"list_filter(coalesce({field}, []), lambda e: e IS NOT NULL)"
    return f"CASE WHEN len({known}) > 0 THEN '[' || array_to_string(list_transform({known}, lambda e: {element}), ',') || ']' ELSE '' END"


def _base(x: str) -> str:
    return f"replace(replace(replace({_strip(f'lower({x})')}, ' ', ''), '()', ''), '`', '')"


def _merge_key(name: str, category: str) -> str:
    return f"CASE WHEN coalesce({category}, '') <> '' THEN {_base(f'coalesce({name}, chr(32))')} || '__' || {category} ELSE {_base(f'coalesce({name}, chr(32))')} END"


def _typed(x: str) -> str:
    return _strip(f"regexp_extract(coalesce({x}, ''), '(?s)(?:→|->)\\s*(.+)$', 1)")


_LIST = "list_filter(coalesce({0}, []), lambda x: x IS NOT NULL)"
_L = _LIST.format
_INDEX_KEY = _strip("lower(name)")
_LIKE = "((contains(coalesce(syntax,''), '(') AND contains(coalesce(syntax,''), ')')) OR coalesce(raw_parameters,'') <> '')"
_ARROW = "(contains(coalesce(syntax,''), '→') OR contains(coalesce(syntax,''), '->'))"

_MERGE = f"""
WITH e AS (SELECT *, {_merge_key('name', 'category')} AS merge_key FROM pine_merged_entries),
a AS (SELECT * FROM e WHERE source = 'local_docs' QUALIFY row_number() OVER (PARTITION BY merge_key ORDER BY rec_id DESC) = 1),
b AS (SELECT * FROM e WHERE source = 'live_site' QUALIFY row_number() OVER (PARTITION BY merge_key ORDER BY rec_id DESC) = 1),
m AS (SELECT coalesce(a.merge_key, b.merge_key) AS merge_key, a.merge_key IS NOT NULL AS in_a, b.merge_key IS NOT NULL AS in_b, a AS ra, b AS rb,
      a.merge_key IS NOT NULL AND b.merge_key IS NOT NULL AND length(coalesce(a.description,'')) + length(coalesce(a.syntax,'')) > length(coalesce(b.description,'')) + length(coalesce(b.syntax,'')) AS richer
      FROM a FULL OUTER JOIN b ON a.merge_key = b.merge_key)
"""


def _rich(f: str) -> str:
    a, b = f"ra.{f}", f"rb.{f}"
    return f"CASE WHEN richer AND length(coalesce({a},'')) > 0 AND (length(coalesce({b},'')) = 0 OR length(coalesce({a},'')) > length(coalesce({b},''))) THEN {a} ELSE coalesce({b}, {a}) END AS {f}"


_EXAMPLES = """
SELECT rec_id, i, e, substring(lower(regexp_replace(e, '\\s+', '', 'g')), 1, 120) AS k, length(e) - length(replace(e, chr(10), '')) AS l
FROM (SELECT rec_id, unnest(examples) AS e, generate_subscripts(examples, 1) AS i FROM pine_merged_entries) WHERE e IS NOT NULL
"""

ORACLE: dict[str, str] = {
    "normalize_names": f"""SELECT fragment, {_merge_key('display_name', 'category')} AS merge_key, {_base('display_name')} AS base_name, regexp_replace({_strip('display_name')}, '[()]+$', '') AS bare_name, {_strip('lower(display_name)')} AS index_key,
        CASE WHEN contains(regexp_replace({_strip('display_name')}, '^[()`]+|[()`]+$', '', 'g'), '.') THEN nullif(split_part(regexp_replace({_strip('display_name')}, '^[()`]+|[()`]+$', '', 'g'), '.', 1), '') END AS namespace_found,
        CASE WHEN starts_with(fragment,'an_') THEN 'annotation' WHEN starts_with(fragment,'const_') THEN 'constant' WHEN starts_with(fragment,'fun_') THEN 'function' WHEN starts_with(fragment,'kw_') THEN 'keyword' WHEN starts_with(fragment,'op_') THEN 'operator'
             WHEN starts_with(fragment,'type_') THEN 'type' WHEN starts_with(fragment,'var_') THEN 'variable' ELSE 'unknown' END AS fragment_category,
        CASE WHEN i = '' THEN 'param' WHEN regexp_matches(i, '^[0-9]') THEN '_' || i ELSE i END AS identifier, regexp_replace({_strip('lower(namespace)')}, '\\.+$', '') AS namespace_key
        FROM (SELECT *, regexp_replace(regexp_replace(display_name, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS i FROM discovery_index)""",
    "flatten_metadata": f"""SELECT rec_id, coalesce(name,'') AS name, coalesce(category,'') AS category, coalesce(namespace,'') AS namespace, coalesce(syntax,'') AS syntax, r AS returns,
        CASE WHEN coalesce(returns,'') <> r THEN coalesce(returns,'') ELSE '' END AS raw_returns_description, coalesce(remarks,'') AS remarks, CAST(coalesce(deprecated,false) AS INT) AS deprecated, array_to_string({_L('sources')}, ', ') AS sources,
        coalesce(url,'') AS url, coalesce(scraped_at,'') AS scraped_at, CAST(len({_L('examples')}) > 0 AS INT) AS has_examples, CAST(len({_L('examples')}) AS INT) AS example_count, CAST(len({_L('parameters')}) AS INT) AS param_count, CAST(len({_L('overloads')}) AS INT) AS overload_count,
        coalesce(description,'') AS raw_description, array_to_string({_L('examples')}, ' ||| ') AS raw_examples, CASE WHEN len({_L('overloads')}) > 0 THEN CAST(to_json({_L('overloads')}) AS VARCHAR) ELSE '' END AS raw_overloads, array_to_string({_L('see_also')}, ', ') AS raw_see_also
        FROM (SELECT *, CASE WHEN {_typed('syntax')} <> '' THEN {_typed('syntax')} ELSE coalesce(returns,'') END AS r FROM pine_merged_entries)""",
    "document_text": f"""SELECT rec_id, md5(d) AS digest, CAST(length(d) AS INT) AS n_chars FROM (SELECT rec_id, concat_ws(chr(10)||chr(10), upper(coalesce(category,'')) || ': ' || coalesce(name,''), CASE WHEN namespace <> '' THEN 'Namespace: ' || namespace END, CASE WHEN syntax <> '' THEN 'Syntax: ' || syntax END,
        nullif(description,''), CASE WHEN returns <> '' THEN 'Returns: ' || returns END, CASE WHEN remarks <> '' THEN 'Remarks: ' || remarks END, CASE WHEN len({_L('examples')}) > 0 THEN 'EXAMPLES:' || chr(10) || chr(10) || array_to_string({_L('examples')}, chr(10)||chr(10)) END,
        CASE WHEN array_to_string({_L('see_also')}, ', ') <> '' THEN 'See also: ' || array_to_string({_L('see_also')}, ', ') END) AS d FROM pine_merged_entries)""",
    "merge_sources": _MERGE
    + f"""SELECT merge_key, CASE WHEN in_a AND in_b THEN 'both' WHEN in_a THEN 'local_only' ELSE 'live_only' END AS match_kind, coalesce(rb.name, ra.name) AS name, {_rich('syntax')}, {_rich('description')}, {_rich('returns')}, {_rich('remarks')},
        CAST(len(list_distinct(list_concat({_L('ra.examples')}, {_L('rb.examples')}))) AS INT) AS n_examples, array_to_string(list_sort(list_distinct(list_concat({_L('ra.see_also')}, {_L('rb.see_also')}))), '|') AS see_also,
        CAST(CASE WHEN len(coalesce(rb.parameters, [])) > 0 THEN len(rb.parameters) WHEN in_a THEN len(coalesce(ra.parameters, [])) ELSE len(coalesce(rb.parameters, [])) END AS INT) AS n_parameters FROM m""",
    "enrich_siblings": f"""WITH e AS (SELECT *, {_base("coalesce(name,'')")} AS b FROM pine_merged_entries),
        g AS (SELECT b, count(*) AS n, arg_max(struct_pack(s := coalesce(syntax,''), p := parameters), struct_pack(l := length(coalesce(syntax,'')), k := -rec_id)) FILTER ({_ARROW}) AS best FROM e GROUP BY b HAVING count(*) > 1),
        j AS (SELECT e.*, best.s AS bs, best.p AS bp, {_typed('best.s')} AS t FROM e JOIN g USING (b) WHERE best IS NOT NULL AND NOT {_ARROW} AND contains(coalesce(syntax,''), '('))
        SELECT rec_id, bs AS syntax, CASE WHEN t <> '' THEN t ELSE returns END AS returns, CASE WHEN t <> '' AND coalesce(returns,'') <> '' AND returns <> t THEN returns END AS returns_prose,
        CAST(CASE WHEN len(coalesce(parameters,[])) = 0 THEN len(coalesce(bp,[])) ELSE len(parameters) END AS INT) AS n_parameters FROM j""",
    "upsert_catalog": "SELECT id, row_no, name, category FROM catalog_records WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no DESC) = 1",
    "new_fragments": "SELECT category, count(DISTINCT fragment) AS n_fragments, count(*) AS n_rows FROM discovery_index d WHERE NOT EXISTS (SELECT 1 FROM catalog_records c WHERE lower(replace(c.name,'()','')) = lower(replace(d.display_name,'()',''))) GROUP BY 1",
    "union_removed": "SELECT origin, category, count(*) AS n, count(DISTINCT name) AS n_names FROM (SELECT name, category, 'catalog' AS origin FROM catalog_records UNION ALL SELECT name, category, 'removal' FROM entry_removals UNION ALL SELECT name, NULL, 'builtin' FROM builtin_symbols) GROUP BY 1, 2",
    "index_category": """SELECT c.row_no, c.category, d.index_category FROM catalog_records c LEFT JOIN (SELECT lower(replace(display_name,'()','')) AS k, category AS index_category FROM discovery_index WHERE category <> 'unknown'
        QUALIFY row_number() OVER (PARTITION BY lower(replace(display_name,'()','')) ORDER BY fragment, category) = 1) d ON lower(replace(c.name,'()','')) = d.k""",
    "category_counts": "SELECT category, source, count(*) AS n, count(DISTINCT namespace) AS n_namespaces FROM pine_merged_entries GROUP BY 1, 2",
    "total_check": "SELECT count(*) AS n, CASE WHEN count(*) < 850 THEN 'LOW' ELSE 'OK' END AS verdict FROM discovery_index WHERE coalesce(category, 'unknown') <> 'unknown'",
    "name_members": f"SELECT {_INDEX_KEY} AS name_key, category, row_no FROM catalog_records WHERE {_INDEX_KEY} <> ''",
    "short_types": """WITH m AS (SELECT owner, count(*) AS n_methods, array_to_string(list(method ORDER BY method) FILTER (nth <= 30), '|') AS methods FROM (SELECT owner, method, row_number() OVER (PARTITION BY owner ORDER BY method) AS nth
        FROM (SELECT DISTINCT namespace AS owner, name AS method FROM catalog_records WHERE category = 'function' AND starts_with(name, namespace || '.'))) GROUP BY owner)
        SELECT row_no, n_methods, methods FROM catalog_records JOIN m ON owner = namespace WHERE category = 'type' AND length(coalesce(document, '')) < 500 AND namespace <> ''""",
    "flatten_members": f"""SELECT rec_id, {_listed('parameters', ('name', 'type', 'description', 'optional', 'default'))} AS raw_parameters, {_listed('overloads', ())} AS raw_overloads, {_listed('type_fields', ('name', 'type', 'description'))} AS raw_type_fields FROM pine_merged_entries""",
    "range_check": "SELECT category, n, CASE WHEN lo IS NULL THEN NULL WHEN n < lo * 0.7 THEN 'LOW' WHEN n > hi * 1.5 THEN 'HIGH' ELSE 'OK' END AS verdict FROM (SELECT category, count(*) AS n FROM catalog_records GROUP BY 1) LEFT JOIN (VALUES "
    + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in RANGES.items()) + ") r(category, lo, hi) USING (category)",
    "scrape_report": """SELECT count(*) AS scraped, count(*) FILTER (coalesce(scrape_error,'') <> '') AS failed, count(*) FILTER (len(coalesce(examples,[])) > 0) AS with_examples, CAST(coalesce(sum(len(coalesce(examples,[]))),0) AS BIGINT) AS total_examples,
        count(*) FILTER (len(coalesce(parameters,[])) > 0) AS with_parameters, CAST(coalesce(sum(len(coalesce(parameters,[]))),0) AS BIGINT) AS total_parameters, count(*) FILTER (coalesce(deprecated,false)) AS deprecated_count,
        (SELECT count(DISTINCT fragment) FROM discovery_index) AS discovered FROM pine_merged_entries""",
    "catalog_stats": """SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT namespace) AS n_namespaces, count(*) FILTER (has_examples = 1) AS n_with_examples, CAST(sum(example_count) AS BIGINT) AS n_examples, CAST(sum(param_count) AS BIGINT) AS n_parameters,
        count(*) FILTER (deprecated = 1) AS n_deprecated, count(*) FILTER (coalesce(raw_see_also,'') <> '') AS n_with_see_also FROM catalog_records""",
    "namespaces": "SELECT DISTINCT namespace FROM discovery_index WHERE namespace IS NOT NULL",
    "filter_metadata": f"SELECT row_no, name, category, {_LIKE} AS function_like FROM catalog_records WHERE has_examples = 1 AND namespace IN ('tidekit','surflab') AND category IN ('function','variable') AND category <> 'example'",
    "return_types": f"""SELECT row_no, found FROM (SELECT row_no, {_typed('syntax')} AS found FROM catalog_records) WHERE CASE WHEN lower(found) = 'float' THEN true WHEN contains(lower(found), 'float') THEN regexp_matches(lower(found), '(^|[\\s<>,\\[\\]])float($|[\\s<>,\\[\\]])') ELSE contains('float', lower(found)) END""",
    "name_index": f"SELECT {_INDEX_KEY} AS name_key, category, count(*) AS n_rows, min(row_no) AS first_row FROM catalog_records WHERE {_INDEX_KEY} <> '' GROUP BY 1, 2",
    "best_version": f"""SELECT name_key, row_no AS best_row, CASE WHEN tier = 1 THEN 'function' ELSE category END AS category, CAST(tier AS INT) AS tier FROM (SELECT {_INDEX_KEY} AS name_key, row_no, category, length(coalesce(document,'')) AS dl,
        CASE WHEN {_LIKE} THEN 1 WHEN coalesce(syntax,'') <> '' THEN 2 ELSE 3 END AS tier FROM catalog_records WHERE name IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY tier, CASE WHEN tier = 3 THEN -dl ELSE 0 END, row_no) = 1""",
    "hot_winners": f"""SELECT name_key, row_no AS winner_row, CASE WHEN g THEN 'global' ELSE 'namespace' END AS origin FROM (SELECT {_INDEX_KEY} AS name_key, row_no, length(coalesce(document,'')) AS dl, list_position({HOT_NAMESPACES}, namespace) AS ns_at, {_INDEX_KEY} IN ({', '.join(f"'{n}'" for n in HOT_NAMES)}) AS g FROM catalog_records WHERE name IS NOT NULL)
        WHERE coalesce(ns_at,0) > 0 OR g QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY NOT g, CASE WHEN g THEN 0 ELSE -dl END, CASE WHEN g THEN 0 ELSE ns_at END, row_no) = 1""",
    "browse": """SELECT *, CAST(row_number() OVER (PARTITION BY namespace ORDER BY CASE category WHEN 'function' THEN 0 WHEN 'variable' THEN 1 WHEN 'constant' THEN 2 WHEN 'type' THEN 3 WHEN 'keyword' THEN 4 WHEN 'operator' THEN 5 ELSE 99 END, category) AS INT) AS place
        FROM (SELECT coalesce(namespace,'') AS namespace, coalesce(category,'') AS category, count(*) AS n_members, count(DISTINCT name) AS n_names, min(name) AS first_name, max(name) AS last_name FROM catalog_records GROUP BY 1, 2)""",
    "type_methods": """SELECT owner, count(*) AS n_methods, array_to_string(list(method ORDER BY method) FILTER (nth <= 30), '|') AS methods FROM (SELECT owner, method, row_number() OVER (PARTITION BY owner ORDER BY method) AS nth
        FROM (SELECT DISTINCT namespace AS owner, name AS method FROM catalog_records WHERE category = 'function' AND starts_with(name, namespace || '.'))) GROUP BY owner""",
    "parse_parameters": f"""SELECT rec_id, CAST(pos AS INT) AS pos, p.name AS name, {_strip("coalesce(p.type,'')")} AS type, {_strip("coalesce(p.description,'')")} AS description,
        contains(lower(coalesce(p.description,'') || ' ' || coalesce(p.type,'')), 'optional') AS optional, nullif(regexp_replace({_strip("regexp_extract(coalesce(p.description,''), '[Dd]efault\\s*(?:is|value|=)\\s*(.+?)(?:\\.|$)', 1)")}, '\\.+$', ''), '') AS default
        FROM (SELECT rec_id, unnest(parameters) AS p, generate_subscripts(parameters, 1) - 1 AS pos FROM pine_merged_entries) WHERE p.name IS NOT NULL""",
    "payload_listing": """WITH t AS (SELECT land_id, CASE WHEN starts_with(trim(payload), '"') AND json_valid(payload) THEN payload::JSON->>'$' ELSE payload END AS text FROM pine_entry_payloads),
        j AS (SELECT land_id, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM t),
        p AS (SELECT land_id, coalesce(j->>'$.result.name', j->>'$.name') AS name, coalesce(j->>'$.result.category', j->>'$.category') AS category, coalesce(j->>'$.result.namespace', j->>'$.namespace', '') AS namespace FROM j)
        SELECT namespace, category, count(*) AS n, count(DISTINCT name) AS n_names FROM p WHERE name IS NOT NULL GROUP BY 1, 2""",
    "distinct_examples": f"""WITH x AS ({_EXAMPLES}), f AS (SELECT rec_id, k, min(i) AS seen FROM x GROUP BY 1, 2),
        w AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY rec_id, k ORDER BY l DESC, i) = 1),
        s AS (SELECT rec_id, list(e ORDER BY seen) AS kept FROM w JOIN f USING (rec_id, k) GROUP BY 1)
        SELECT p.rec_id, CAST(len(coalesce(examples,[])) AS INT) AS n_before, CAST(len(coalesce(kept,[])) AS INT) AS n_kept, md5(array_to_string(coalesce(kept,[]), chr(10)||chr(10))) AS digest FROM pine_merged_entries p LEFT JOIN s USING (rec_id)""",
}
