"""Queries of the whole search: every document whose id 50 divides asks, over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import scalar as S
from glyphmill.functions import terms
from glyphmill.operators import modes
from glyphmill.plans.catalog import HOT_NAMESPACES
from glyphmill.plans.ranked import _alike, name_hits
from glyphmill.sources.tables import table

#: Hits of a search, and the source that the filtered searches ask for.
N, SOURCE = 10, "forum_threads"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their vectors: manual entries are functions and code is an example; the second line is the syntax."""
    kind = F.when(F.col("doc_kind") == "entry", "function").when(F.col("doc_kind") == "code", modes.ASIDE).otherwise(F.col("doc_kind"))
    syntax = F.coalesce(F.get(F.split("text", "\n", 3), F.lit(1)), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", kind.alias("category"), F.col("source").alias("namespace"), syntax.alias("syntax"), F.lit("").alias("parameters"), S.return_type(syntax).alias("returns"), F.contains("text", F.lit("```")).cast("int").alias("has_examples"))
    return rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "embedding")


def _documents(spark: SparkSession, sf_dir: str, **asked: str) -> DataFrame:
    queries = _queries(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "about_name", "source")
    return modes.documents(_catalog(spark, sf_dir), queries, name_hits(docs, queries.select(F.col("id").alias("query_id"))), N, **asked)


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over all documents."""
    return _documents(spark, sf_dir)


def search_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for functions."""
    return _documents(spark, sf_dir, category="function")


def search_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search within one source."""
    return _documents(spark, sf_dir, namespace=SOURCE)


def search_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with examples close to the query."""
    return modes.close_by(_catalog(spark, sf_dir), _queries(spark, sf_dir), N, {"has_examples": 1})


def search_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions to suggest."""
    return modes.close_by(_catalog(spark, sf_dir), _queries(spark, sf_dir), N, {"category": "function"})


def search_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that return the type that the query document's own syntax returns, a float series without one."""
    catalog = _catalog(spark, sf_dir)
    asked = _queries(spark, sf_dir).join(catalog.select("id", F.coalesce(F.nullif("returns", F.lit("")), F.lit("series float")).alias("return_type")), "id", "left").fillna("series float", ["return_type"])
    return modes.returning(catalog, asked, N)


def short_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered names most like the first three letters of every built-in name whose id 50 divides."""
    queries = table(spark, sf_dir, "builtin_symbols").filter("symbol_id % 50 = 0").select(F.substring("name", 1, 3).alias("name"))
    return modes.short_query(table(spark, sf_dir, "discovery_index").select(F.col("display_name").alias("name")), queries)


def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered names that the words of every catalogue row's name lead to, for the rows whose number 50 divides."""
    rows = table(spark, sf_dir, "catalog_records").filter("row_no % 50 = 0 and name is not null")
    text = F.lower(F.regexp_replace(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), r"\.", " "))
    names = table(spark, sf_dir, "discovery_index").select(F.col("fragment").alias("id"), F.col("display_name").alias("name"))
    return modes.name_hits(rows.select(F.col("row_no").alias("query_id"), text.alias("text")), names)


def biased_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest function of each query, those of one source counted as nearer."""
    catalog = _catalog(spark, sf_dir)
    hits = modes.nearest(catalog, _queries(spark, sf_dir), N, {"category": "function"}).join(catalog.select("id", "namespace"), "id")
    return modes.biased(hits, SOURCE)


def rows_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows of the removed names."""
    return modes.by_names(table(spark, sf_dir, "catalog_records"), table(spark, sf_dir, "entry_removals")).select("row_no", "name", "category")


def types_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue types of the discovered names."""
    return modes.types_by_name(table(spark, sf_dir, "catalog_records"), table(spark, sf_dir, "discovery_index").select(F.col("display_name").alias("name"))).select("row_no", "name")


def hot_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What loading the hot subset counts."""
    return modes.loads(table(spark, sf_dir, "catalog_records"), HOT_NAMESPACES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (search_documents, search_functions, search_source, search_examples, search_suggestions, search_returns, short_queries, search_names, biased_choice, rows_by_name, types_by_name, hot_loads)
}


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


_ALL = f"""d AS (SELECT doc_id AS id, about_name, source AS namespace, text, CASE doc_kind WHEN 'entry' THEN 'function' WHEN 'code' THEN 'example' ELSE doc_kind END AS category, coalesce(split_part(text, chr(10), 2), '') AS syntax, contains(text, '```') AS has_examples FROM documents),
    q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
    v AS MATERIALIZED (SELECT q.query_id, d.*, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS x, round(x, 6) AS distance, {_strip("regexp_extract(syntax, '(?s)(?:→|->)\\s*(.+)$', 1)")} AS returns FROM d JOIN embeddings e ON e.vec_id = d.id, q)"""


def _near(n: int, condition: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9), id) AS rank FROM v WHERE {condition} QUALIFY rank <= {n}"


def _documents_sql(category: str | None = None, namespace: str | None = None) -> str:
    inside = f"namespace = '{namespace}'" if namespace else "true"
    base = f"h AS ({_near(N, f'category = {category!r} AND {inside}' if category else f'category <> {modes.ASIDE!r} AND {inside}')})"
    if not category:
        base += f""", l AS (SELECT query_id FROM h WHERE rank <= 3 GROUP BY 1 HAVING NOT bool_or(category IN {modes.DUE!r})),
        s AS ({_near(N, f"category = 'function' AND {inside}")}),
        t AS (SELECT query_id, id, distance, rank, CASE WHEN rank = 1 THEN 0 ELSE 2 END AS tier FROM h UNION ALL SELECT query_id, id, distance, rank, 1 FROM s SEMI JOIN l USING (query_id) ANTI JOIN h USING (query_id, id))"""
    else:
        base += ", t AS (SELECT query_id, id, distance, rank, 0 AS tier FROM h)"
    extra = ""
    if category == "function":
        base += f", e AS ({_near(N, inside)})"
        extra = """UNION ALL SELECT e.query_id, e.id, e.distance, 'function', 1, e.rank FROM e ANTI JOIN f ON f.query_id = e.query_id AND f.id = e.id WHERE coalesce(e.category, '') <> 'function' AND contains(e.syntax, '(') AND contains(e.syntax, ')') AND e.query_id IN (SELECT query_id FROM f)"""
    return f"""WITH {_ALL}, {base}, r AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, id) AS rank FROM t),
        n AS (SELECT a.query_id, d.id, row_number() OVER (PARTITION BY a.query_id ORDER BY coalesce(d.namespace = o.namespace, false) DESC, d.id) AS name_rank FROM (SELECT DISTINCT query_id FROM r) a JOIN d o ON o.id = a.query_id JOIN d ON d.about_name = o.about_name),
        f AS (SELECT coalesce(r.query_id, n.query_id) AS query_id, coalesce(r.id, n.id) AS id, coalesce(distance, 0.01) AS distance, row_number() OVER (PARTITION BY coalesce(r.query_id, n.query_id) ORDER BY name_rank IS NULL, name_rank, rank) AS spot FROM r FULL OUTER JOIN n ON n.query_id = r.query_id AND n.id = r.id),
        g AS (SELECT query_id, id, f.distance, d.category, 0 AS tier, spot FROM f JOIN d USING (id) {extra}),
        c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, spot, id) AS cut FROM g QUALIFY cut <= {N}),
        k AS (SELECT c.*, row_number() OVER (PARTITION BY query_id, lower({_strip("substring(coalesce(d.text, ''), 1, 120)")}) ORDER BY cut) AS copy FROM c JOIN d USING (id))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cut) AS INT) AS place, id, distance, category FROM k WHERE copy = 1 AND distance < {modes.FAR}"""


_NAME = "lower(replace({0}, '()', ''))"
_STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_ALIASES = ", ".join("({}, '{}', [{}])".format(i, p, ", ".join(f"'{n}'" for n in names)) for i, (p, names) in enumerate(terms.ALIASES))


def _plain(x: str) -> str:
    return f"lower(replace({_strip(x)}, '()', ''))"


ORACLE: dict[str, str] = {
    "search_documents": _documents_sql(),
    "search_functions": _documents_sql(category="function"),
    "search_source": _documents_sql(namespace=SOURCE),
    "search_examples": f"WITH {_ALL} SELECT query_id, CAST(rank AS INT) AS place, id, distance FROM ({_near(N, 'has_examples')}) WHERE distance < {modes.FAR}",
    "search_suggestions": f"""WITH {_ALL} SELECT query_id, CAST(rank AS INT) AS place, id, distance FROM ({_near(N, "category = 'function'")}) WHERE distance < {modes.FAR}""",
    "search_returns": f"""WITH {_ALL}, a AS (SELECT q.query_id, lower(coalesce(nullif({_strip("regexp_extract(d.syntax, '(?s)(?:→|->)\\s*(.+)$', 1)")}, ''), 'series float')) AS asked FROM q LEFT JOIN d ON d.id = q.query_id),
        h AS ({_near(max(5 * N, 50), "category = 'function'")}),
        m AS (SELECT h.*, lower(returns) AS r, asked, returns <> '' AND (r = asked OR (contains(r, asked) AND regexp_matches(r, '(^|[\\s<>,\\[\\]])' || regexp_escape(asked) || '($|[\\s<>,\\[\\]])')) OR (NOT contains(r, asked) AND contains(asked, r))) AS direct FROM h JOIN a USING (query_id)),
        k AS (SELECT *, bool_or(direct) OVER (PARTITION BY query_id) AS has FROM m)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY direct DESC, rank) AS INT) AS place, id, distance, direct FROM k WHERE CASE WHEN has THEN direct OR distance < {modes.NEAR_BESIDE_DIRECT} ELSE rank <= {modes.SHOWN_ALONE} AND distance < {modes.NEAR_ALONE} END QUALIFY place <= {N}""",
    "short_queries": f"""WITH q AS (SELECT DISTINCT {_NAME.format('trim(substring(name, 1, 3))')} AS query FROM builtin_symbols WHERE symbol_id % 50 = 0), n AS (SELECT DISTINCT {_NAME.format('trim(display_name)')} AS name FROM discovery_index WHERE trim(display_name) <> ''),
        s AS (SELECT query, name, {_alike('query', 'name')} AS score FROM q, n) SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS INT) AS rank, name, round(score, 6) AS score FROM s QUALIFY rank <= 5""",
    "search_names": f"""WITH q AS (SELECT row_no AS query_id, lower(replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '.', ' ')) AS text FROM catalog_records WHERE row_no % 50 = 0 AND name IS NOT NULL),
        w AS (SELECT query_id, text, list_filter(regexp_extract_all(text, '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ({_STOPS})) AS words FROM q),
        a AS (SELECT query_id, list(name ORDER BY spot) AS names FROM (SELECT query_id, name, min(i * 100 + j) AS spot FROM (SELECT query_id, i, unnest(names) AS name, generate_subscripts(names, 1) AS j FROM q JOIN (VALUES {_ALIASES}) t(i, pattern, names) ON regexp_matches(text, '(?i)' || pattern)) GROUP BY 1, 2) GROUP BY 1),
        p AS (SELECT query_id, [struct_pack(p := text, l := 70.0::DOUBLE)] || list_transform(coalesce(a.names, []), lambda x: struct_pack(p := x, l := 60.0::DOUBLE)) || list_transform(range(1, len(words)), lambda i: struct_pack(p := words[i] || ' ' || words[i + 1], l := 65.0::DOUBLE)) || list_transform(words, lambda x: struct_pack(p := x, l := 75.0::DOUBLE)) AS ps FROM w LEFT JOIN a USING (query_id)),
        x AS (SELECT query_id, t - 1 AS spot, {_plain('e.p')} AS probe, e.l AS least FROM (SELECT query_id, unnest(ps) AS e, generate_subscripts(ps, 1) AS t FROM p) WHERE {_plain('e.p')} <> ''),
        n AS (SELECT {_plain('display_name')} AS name, min(fragment) AS id FROM discovery_index WHERE {_plain('display_name')} <> '' GROUP BY 1),
        e AS (SELECT query_id, spot, 1 AS rank, id, 100.0::DOUBLE AS score FROM x JOIN n ON n.name = x.probe),
        r AS (SELECT x.* FROM x ANTI JOIN e USING (query_id, spot) WHERE NOT contains(probe, '.')), u AS (SELECT DISTINCT probe FROM r),
        s AS (SELECT probe, id, name, {_alike('probe', 'name')} AS score FROM u JOIN n ON 200.0 * least(length(probe), length(name)) >= 60 * (length(probe) + length(name))),
        k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, name) AS rank FROM s WHERE score >= 60 QUALIFY rank <= 2),
        h AS (SELECT * FROM e UNION ALL SELECT query_id, spot, rank, id, round(score, 6) FROM r JOIN k USING (probe) WHERE round(score, 6) >= least)
        SELECT query_id, id, arg_min(score, spot * 10 + rank) AS score, CAST(min(spot * 10 + rank) AS BIGINT) AS seen FROM h GROUP BY 1, 2""",
    "biased_choice": f"""WITH {_ALL}, h AS ({_near(N, "category = 'function'")}) SELECT query_id, id, distance FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance - CASE WHEN namespace = '{SOURCE}' THEN 0.05 ELSE 0 END, 9), rank) = 1""",
    "rows_by_name": "SELECT row_no, name, category FROM catalog_records WHERE name IN (SELECT name FROM entry_removals WHERE name IS NOT NULL UNION SELECT lower(name) FROM entry_removals WHERE name IS NOT NULL)",
    "types_by_name": "SELECT row_no, name FROM catalog_records WHERE category = 'type' AND name IN (SELECT display_name FROM discovery_index WHERE display_name IS NOT NULL UNION SELECT 'type.' || display_name FROM discovery_index WHERE display_name IS NOT NULL)",
    "hot_loads": f"""WITH r AS (SELECT namespace, row_no, {_strip('lower(name)')} AS k, list_position({HOT_NAMESPACES!r}, namespace) AS load, length(coalesce(document, '')) AS size FROM catalog_records WHERE name IS NOT NULL AND list_position({HOT_NAMESPACES!r}, namespace) > 0),
        m AS (SELECT *, max(size) OVER (PARTITION BY k ORDER BY load, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
        SELECT namespace, count(*) AS n_loaded, count(DISTINCT k) AS n_names, count(*) FILTER (size > before) AS n_replaced FROM m GROUP BY 1""",
}
