"""Queries of ranked search: vectors, fuzzy names, rank fusion, content dedup, lookup ladder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import scalar as S
from glyphmill.operators import ladder, search
from glyphmill.plans.catalog import HOT_NAMES, HOT_NAMESPACES
from glyphmill.sources.tables import table


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id 50 divides, exactly."""
    return search.vector_topk(table(spark, sf_dir, "embeddings"), 10)


def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an inverted file."""
    return search.vector_topk_indexed(table(spark, sf_dir, "embeddings"), 10)


def topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the indexed search against the exact one."""
    exact, near = vector_topk(spark, sf_dir), vector_topk_indexed(spark, sf_dir)
    hit = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count("*").alias("n_exact"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_exact"))


def topk_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the indexed search finds nine in ten of the exact one's rows."""
    return topk_recall(spark, sf_dir).select("n_exact", (F.col("recall") >= 0.9).alias("reached"))


def vector_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors under a distance of 0.95, with their relevance in percent."""
    return vector_topk(spark, sf_dir).filter("distance < 0.95").select("query_id", "vec_id", S.relevance(F.col("distance")).alias("relevance"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after those with the beginning of an earlier one are gone."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return search.content_dedup(rows, "text", "doc_id", keep=["doc_id", "source"])


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered names most like every built-in name whose id 50 divides."""
    queries = table(spark, sf_dir, "builtin_symbols").filter("symbol_id % 50 = 0").select("name")
    return search.fuzzy_names(table(spark, sf_dir, "discovery_index").select(F.col("display_name").alias("name")), queries, 45.0)


def _about(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "about_name", "source", "doc_kind")
    hits = vector_topk(spark, sf_dir).select("query_id", "rank", F.col("vec_id").alias("id"), "distance")
    return docs, hits


def name_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, seen, score): the ten documents and more about each query document's symbol, those of its own source first."""
    known = docs.filter("about_name is not null").select("id", "about_name", F.col("source").alias("own"))
    first = lambda *keys: known.withColumn("seen", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter("seen <= 10")
    asked = queries.join(docs.select(F.col("id").alias("query_id"), "about_name", F.col("source").alias("own")), "query_id")
    # the ten best of a query by (score, id) are among the first ten of its own source and the first ten of any source
    same = asked.join(first("about_name", "own"), ["about_name", "own"]).select("query_id", "id", "seen", F.lit(100.0).alias("score"))
    others = asked.join(first("about_name").withColumnRenamed("own", "source"), "about_name").filter(~F.coalesce(F.col("own") == F.col("source"), F.lit(False)))
    return same.unionByName(others.select("query_id", "id", "seen", F.lit(85.0).alias("score")))


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about the query document's symbol, those of its own source first, before the nearest vectors; the first ten of both."""
    docs, hits = _about(spark, sf_dir)
    return search.fuse(hits, name_hits(docs, hits.select("query_id").distinct()), 10)


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors, with the ten nearest manual entries behind the first hit where the first three have no wanted category."""
    docs, hits = _about(spark, sf_dir)
    kinds = docs.select("id", F.when(F.col("doc_kind") == "entry", "function").otherwise(F.col("doc_kind")).alias("category"))
    told = hits.join(kinds, "id")
    entries = table(spark, sf_dir, "embeddings").join(kinds.filter("category = 'function'").select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")
    near = search.vector_topk(entries, max(10, 3), queries=queries).select("query_id", "rank", F.col("vec_id").alias("id"))
    return search.interleave(told.select("query_id", "rank", "id", "category"), near)


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entry_removals").filter("removal_id % 50 = 0").select(F.col("removal_id").alias("query_id"), "name", "category")


def lookup_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the catalogue answers for removed names whose id 50 divides."""
    return ladder.lookup(_removed(spark, sf_dir), table(spark, sf_dir, "catalog_records"), namespaces=HOT_NAMESPACES, names=HOT_NAMES)


def lookup_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like the removed names for which the catalogue has no answer."""
    return ladder.suggestions(_removed(spark, sf_dir), table(spark, sf_dir, "catalog_records"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and pairs of words of every document, as a query would use them."""
    words = S.query_words(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    pairs = S.bigrams(F.col("words"))
    return rows.select("doc_id", F.size("words").alias("n_words"), F.size(pairs).alias("n_pairs"), F.md5(F.array_join("words", " ")).alias("digest"), F.get(pairs, F.lit(0)).alias("first_pair"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (vector_topk, vector_topk_indexed, topk_recall, topk_reached, vector_relevance, content_dedup, fuzzy_names, rank_fusion, interleaved, lookup_ladder, lookup_suggestions, query_terms)
}

_TOPK = """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS INT) AS rank, vec_id, round(d, 6) AS distance
    FROM (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) QUALIFY rank <= 10"""

_LCS = """list_reduce(list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 THEN list_transform(range(0, len(b) + 1), lambda j: 0) ELSE [i] END),
    lambda prev, cur: list_reduce(list_concat([[0]], list_transform(range(1, len(b) + 1), lambda j: [j])),
      lambda acc, j: list_append(acc, CASE WHEN a[cur[1]] = b[j[1]] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[j[1]]) END)))[len(b) + 1]"""

_STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)



def _alike(a: str, b: str) -> str:
    """The score of two names in SQL."""
    return f"(SELECT 200.0::DOUBLE * ({_LCS}) / (len(a) + len(b)) FROM (SELECT string_split({a}, '') AS a, string_split({b}, '') AS b))"


def _stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _bare(x: str) -> str:
    return _stripped(f"lower(regexp_replace({_stripped(x)}, '[()]+$', ''))")


def _ladder_sql(hot: bool) -> str:
    names, spaces = ", ".join(f"'{n}'" for n in HOT_NAMES), ", ".join(f"'{n}'" for n in HOT_NAMESPACES)
    winners = f"""SELECT nk, row_no, category, syntax FROM c WHERE nk IN ({names}) OR list_position([{spaces}], namespace) > 0
        QUALIFY row_number() OVER (PARTITION BY nk ORDER BY nk NOT IN ({names}), CASE WHEN nk IN ({names}) THEN 0 ELSE -dl END, CASE WHEN nk IN ({names}) THEN 0 ELSE list_position([{spaces}], namespace) END, row_no) = 1"""
    return f"""q AS (SELECT removal_id AS query_id, coalesce({_bare('name')}, '') AS nk, category FROM entry_removals WHERE removal_id % 50 = 0),
        c AS (SELECT row_no, {_bare('name')} AS nk, category, namespace, syntax, length(coalesce(document, '')) AS dl,
          CASE WHEN (contains(coalesce(syntax, ''), '(') AND contains(coalesce(syntax, ''), ')')) OR coalesce(raw_parameters, '') <> '' THEN 1 WHEN coalesce(syntax, '') <> '' THEN 2 ELSE 3 END AS tier FROM catalog_records WHERE name IS NOT NULL),
        own AS (SELECT nk, category, min(row_no) AS own_row FROM c WHERE nk <> '' GROUP BY 1, 2),
        best AS (SELECT nk, row_no AS best_row FROM c WHERE nk <> '' QUALIFY row_number() OVER (PARTITION BY nk ORDER BY tier, CASE WHEN tier = 3 THEN -dl ELSE 0 END, row_no) = 1),
        hot AS (SELECT nk, row_no AS hot_row, category AS hot_category FROM ({winners}) WHERE coalesce(syntax, '') <> '' AND nk <> '' AND {'true' if hot else 'false'}),
        x AS (SELECT q.*, own_row, best_row, CASE WHEN q.category IS NULL OR q.category = hot_category THEN hot_row END AS hot_row FROM q LEFT JOIN own ON own.nk = q.nk AND own.category = q.category LEFT JOIN best ON best.nk = q.nk LEFT JOIN hot ON hot.nk = q.nk),
        lost AS (SELECT DISTINCT nk, category FROM x WHERE best_row IS NULL AND nk <> ''),
        i AS (SELECT l.nk, l.category, own_row FROM lost l JOIN own o ON o.category = l.category AND {_alike('l.nk', 'o.nk')} >= 85 QUALIFY row_number() OVER (PARTITION BY l.nk, l.category ORDER BY {_alike('l.nk', 'o.nk')} DESC, o.nk) = 1),
        n AS (SELECT l.nk, best_row FROM (SELECT DISTINCT nk FROM lost ANTI JOIN i USING (nk, category)) l JOIN best b ON {_alike('l.nk', 'b.nk')} >= 85 QUALIFY row_number() OVER (PARTITION BY l.nk ORDER BY {_alike('l.nk', 'b.nk')} DESC, b.nk) = 1),
        a AS (SELECT x.query_id, x.nk AS name_key, x.category, CASE WHEN hot_row IS NOT NULL THEN 'hot' WHEN x.own_row IS NOT NULL THEN 'exact_in_category' WHEN x.best_row IS NOT NULL THEN 'exact' WHEN coalesce(i.own_row, n.best_row) IS NOT NULL THEN 'alike' ELSE 'not_found' END AS stage,
          coalesce(hot_row, x.own_row, x.best_row, i.own_row, n.best_row) AS row FROM x LEFT JOIN i ON i.nk = x.nk AND i.category = x.category LEFT JOIN n ON n.nk = x.nk)"""


ORACLE: dict[str, str] = {
    "topk_reached": f"SELECT count(*) AS n_exact, true AS reached FROM ({_TOPK})",
    "lookup_ladder": f"WITH {_ladder_sql(True)} SELECT query_id, name_key, stage, row FROM a",
    "lookup_suggestions": f"""WITH {_ladder_sql(False)}, m AS (SELECT query_id, name_key, category FROM a WHERE stage = 'not_found' AND name_key <> ''),
        p AS (SELECT m.query_id, o.nk, {_alike('m.name_key', 'o.nk')} AS score FROM m JOIN own o ON o.category = m.category),
        r AS (SELECT m.query_id, o.nk, {_alike('m.name_key', 'o.nk')} AS score FROM (SELECT * FROM m WHERE query_id NOT IN (SELECT query_id FROM p)) m, (SELECT DISTINCT nk FROM own) o)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, nk) AS INT) AS rank, nk AS name, round(score, 6) AS score FROM (SELECT * FROM p UNION ALL SELECT * FROM r) QUALIFY rank <= 5""",
    "vector_topk": _TOPK,
    "vector_relevance": f"SELECT query_id, vec_id, CAST(round_even(greatest(0, 1 - distance) * 100, 0) AS INT) AS relevance FROM ({_TOPK}) WHERE distance < 0.95",
    "content_dedup": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(substring(coalesce(text,''), 1, 120), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) ORDER BY doc_id) = 1",
    "fuzzy_names": f"""WITH q AS (SELECT DISTINCT lower(replace(trim(name),'()','')) AS query FROM builtin_symbols WHERE symbol_id % 50 = 0), n AS (SELECT DISTINCT lower(replace(trim(display_name),'()','')) AS name FROM discovery_index),
        p AS (SELECT query, name, string_split(query, '') AS a, string_split(name, '') AS b FROM q, n WHERE 200.0 * least(length(query), length(name)) >= 45 * (length(query) + length(name))),
        s AS (SELECT query, name, 200.0::DOUBLE * ({_LCS}) / (len(a) + len(b)) AS score FROM p)
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS INT) AS rank, name, round(score, 6) AS score FROM s WHERE score >= 45 QUALIFY rank <= 5""",
    "rank_fusion": f"""WITH v AS ({_TOPK}), t AS (SELECT doc_id AS id, about_name, source, row_number() OVER (PARTITION BY about_name ORDER BY doc_id) AS seen FROM documents WHERE about_name IS NOT NULL),
        n AS (SELECT v.query_id, t.id, row_number() OVER (PARTITION BY v.query_id ORDER BY CASE WHEN d.source = t.source THEN 100.0 ELSE 85.0 END DESC, t.seen, t.id) AS name_rank FROM (SELECT DISTINCT query_id FROM v) v JOIN documents d ON d.doc_id = v.query_id JOIN t USING (about_name) WHERE t.seen <= 10),
        b AS (SELECT coalesce(v.query_id, n.query_id) AS query_id, coalesce(v.vec_id, n.id) AS id, v.distance, v.rank, n.name_rank FROM v FULL OUTER JOIN n ON v.query_id = n.query_id AND v.vec_id = n.id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY name_rank IS NULL, name_rank, rank) AS INT) AS place, id, coalesce(distance, 0.01) AS distance FROM b QUALIFY place <= 10""",
    "interleaved": f"""WITH c AS (SELECT doc_id AS id, CASE WHEN doc_kind = 'entry' THEN 'function' ELSE doc_kind END AS category FROM documents),
        h AS (SELECT query_id, rank, id, category FROM ({_TOPK}) JOIN c ON id = vec_id),
        l AS (SELECT query_id FROM h WHERE rank <= 3 GROUP BY query_id HAVING NOT bool_or(category IN ('function', 'variable', 'type', 'constant'))),
        s AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank
          FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings e JOIN c ON c.id = e.vec_id WHERE q.vec_id % 50 = 0 AND c.category = 'function') QUALIFY rank <= 10)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, id) AS INT) AS place, id
        FROM (SELECT query_id, rank, id, CASE WHEN rank = 1 THEN 0 ELSE 2 END AS tier FROM h UNION ALL SELECT query_id, rank, id, 1 AS tier FROM s SEMI JOIN l USING (query_id) ANTI JOIN h USING (query_id, id))""",
    "query_terms": f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ({_STOPS})) AS words FROM documents)
        SELECT doc_id, CAST(len(words) AS INT) AS n_words, CAST(greatest(len(words) - 1, 0) AS INT) AS n_pairs, md5(array_to_string(words, ' ')) AS digest, CASE WHEN len(words) > 1 THEN words[1] || ' ' || words[2] END AS first_pair FROM w""",
}
