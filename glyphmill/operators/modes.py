"""Ranked search as a whole: documents, examples and suggestions, return types, short queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.scalar import bigrams, index_key, query_words, return_type_matches, strip
from glyphmill.functions.terms import aliases
from glyphmill.operators.lookup import where
from glyphmill.operators.search import fuzzy_names, fuse, vector_topk

#: What is too far to be shown, and how near a row must be that matches in meaning only.
FAR = 0.7
NEAR_BESIDE_DIRECT, NEAR_ALONE, SHOWN_ALONE = 0.4, 0.6, 5
#: Categories of which one is due among the first three hits, and the one left out by default.
DUE = ("function", "variable", "type", "constant")
ASIDE = "example"


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def nearest(catalog: DataFrame, queries: DataFrame, n: int, equal: dict | None = None, unequal: dict | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the n nearest rows that satisfy the conditions, which hold before the search.

    catalog and queries: id, embedding; catalog also what the conditions name.
    """
    rows = where(catalog, equal=equal, unequal=unequal)
    return vector_topk(rows, n, key="id", queries=queries).withColumnRenamed("vec_id", "id")


def documents(catalog: DataFrame, queries: DataFrame, name_hits: DataFrame, n: int = 5, category: str | None = None, namespace: str | None = None, prefix: int = 120) -> DataFrame:
    """(query_id, place, id, distance, category): the search over all documents, step by step.

    catalog: id, embedding, category, namespace, syntax, parameters, text. queries: id, embedding. name_hits:
    query_id, score, seen, id; no condition applies to them. The n nearest rows; where no ``category`` is asked and the
    first three are of no category that is due, the nearest functions go behind the first; name hits go to the front;
    for functions, rows that look like one are put behind. What is beyond n is cut, then the first row with the same
    beginning stays, then what is far is left out. Nulls are no category, no namespace and an empty text.
    """
    equal = {k: v for k, v in (("category", category), ("namespace", namespace)) if v is not None}
    told = catalog.select("id", "category", "namespace", "syntax", "parameters", F.lower(strip(F.substring(F.coalesce("text", F.lit("")), 1, prefix))).alias("beginning"))
    hits = nearest(catalog, queries, n, equal, None if category else {"category": ASIDE}).select("query_id", F.col("rank").alias("place"), "id", "distance")
    if not category:
        lacking = hits.join(told.select("id", "category"), "id").filter("place <= 3").groupBy("query_id").agg(F.max(F.coalesce(F.col("category").isin(*DUE), F.lit(False))).alias("due")).filter("NOT due").select("query_id")
        more = nearest(catalog, queries, max(n, 3), {**equal, "category": "function"}).join(lacking, "query_id", "left_semi").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
        tiers = hits.withColumn("tier", F.when(F.col("place") == 1, 0).otherwise(2)).unionByName(more.select("query_id", F.col("rank").alias("place"), "id", "distance", F.lit(1).alias("tier")))
        hits = _placed(tiers.withColumnRenamed("place", "at"), F.col("tier"), F.col("at"), F.col("id")).select("query_id", "place", "id", "distance")
    found = fuse(hits.withColumnRenamed("place", "rank"), name_hits).join(told, "id").withColumn("tier", F.lit(0))
    if category == "function":
        like = told.filter((F.coalesce("category", F.lit("")) != "function") & ((F.coalesce("syntax", F.lit("")).contains("(") & F.coalesce("syntax", F.lit("")).contains(")")) | (F.coalesce("parameters", F.lit("")) != "")))
        extra = nearest(catalog, queries, n, {k: v for k, v in equal.items() if k == "namespace"}).join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").join(like, "id")
        extra = extra.select("id", "query_id", F.col("rank").alias("place"), "distance", F.lit("function").alias("category"), "namespace", "syntax", "parameters", "beginning", F.lit(1).alias("tier"))
        extra = extra.join(found.select("query_id").distinct(), "query_id", "left_semi")
        found = found.unionByName(extra)
    cut = _placed(found.withColumnRenamed("place", "at"), F.col("tier"), F.col("at"), F.col("id")).drop("at").filter(F.col("place") <= n)
    first = Window.partitionBy("query_id", "beginning").orderBy("place")  # at most n rows of a query are left
    kept = cut.withColumn("_copy", F.row_number().over(first)).filter((F.col("_copy") == 1) & (F.col("distance") < FAR))
    return _placed(kept.select("query_id", F.col("place").alias("at"), "id", "distance", "category"), F.col("at")).select("query_id", "place", "id", "distance", "category")


#: The least score of a name for the whole query, an alias of it, two words in a row, and a word; the hits of each.
PROBES = (70.0, 60.0, 65.0, 75.0)
PROBE_HITS = 2


def name_hits(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, id, score, seen): names that a query's text, its aliases, pairs of words and words lead to.

    queries: query_id, text. names: id, name. A probe that is a name is that name (score 100); one with a dot is nothing
    else; any other takes the names most like it. An id counts once, where it was first seen.
    """
    plain = lambda c: F.lower(F.replace(strip(c), F.lit("()"), F.lit("")))
    words = query_words(F.col("text"))
    tried = lambda texts, least: F.transform(texts, lambda t: F.struct(plain(t).alias("probe"), F.lit(least).alias("least")))
    probes = F.concat(*[tried(t, least) for t, least in zip((F.array("text"), aliases(F.col("text")), bigrams(words), words), PROBES)])
    probed = queries.select("query_id", F.posexplode(probes).alias("at", "p")).select("query_id", "at", "p.*").filter("probe != ''")
    held = names.select(plain(F.col("name")).alias("name"), "id").filter("name != ''").groupBy("name").agg(F.min("id").alias("id"))
    exact = probed.join(held.withColumnRenamed("name", "probe"), "probe").select("query_id", "at", F.lit(1).alias("rank"), "id", F.lit(100.0).alias("score"))
    rest = probed.join(exact.select("query_id", "at"), ["query_id", "at"], "left_anti").filter(~F.col("probe").contains("."))
    # a score counts when rounded to six places, so what is asked for may be less by that
    alike = fuzzy_names(held.select("name"), rest.select(F.col("probe").alias("name"), (F.col("least") - 1e-6).alias("least")), min(PROBES) - 1e-6, PROBE_HITS, floor="least").join(held, "name").withColumnRenamed("query", "probe")
    near = rest.join(alike, "probe").filter(F.col("score") >= F.col("least")).select("query_id", "at", "rank", "id", "score")
    first = exact.unionByName(near).groupBy("query_id", "id").agg(F.min(F.struct((F.col("at") * 10 + F.col("rank")).alias("seen"), "score")).alias("f"))
    return first.select("query_id", "id", "f.score", F.col("f.seen").cast("bigint").alias("seen"))


def close_by(catalog: DataFrame, queries: DataFrame, n: int, equal: dict) -> DataFrame:
    """(query_id, place, id, distance): the n nearest rows of a condition that are not far: rows with examples, or functions to suggest."""
    return nearest(catalog, queries, n, equal).filter(F.col("distance") < FAR).select("query_id", F.col("rank").alias("place"), "id", "distance")


def returning(catalog: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, place, id, distance, direct): functions that return the asked type.

    catalog: id, embedding, category, returns. queries: id, embedding, return_type. Of the max(5 n, 50) nearest
    functions those whose type matches come first, by distance, with the near ones behind them; where none matches, the
    first few that are not too far.
    """
    hits = nearest(catalog, queries, max(5 * n, 50), {"category": "function"}).join(catalog.select("id", F.lower("returns").alias("returns")), "id").join(queries.select(F.col("id").alias("query_id"), F.lower(strip(F.col("return_type"))).alias("asked")), "query_id")
    direct = F.coalesce((F.col("returns") != "") & return_type_matches(F.col("asked"), F.col("returns")), F.lit(False))
    hits = hits.withColumn("direct", direct).withColumn("_any", F.max(F.col("direct")).over(Window.partitionBy("query_id")))
    near = F.when(F.col("_any"), F.col("direct") | (F.col("distance") < NEAR_BESIDE_DIRECT)).otherwise((F.col("rank") <= SHOWN_ALONE) & (F.col("distance") < NEAR_ALONE))
    return _placed(hits.filter(near), F.desc("direct"), F.col("rank")).filter(F.col("place") <= n).select("query_id", "place", "id", "distance", "direct")


def short_query(names: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """(query, rank, name, score): names most like a query too short for its meaning, however little."""
    return fuzzy_names(names, queries, 0.0, n)


def biased(hits: DataFrame, namespace: str, bias: float = 0.05) -> DataFrame:
    """(query_id, id, distance): the nearest hit of each query when rows of one namespace count as ``bias`` nearer; ties by rank.

    hits: query_id, rank, id, distance, namespace.
    """
    near = F.col("distance") - F.when(F.col("namespace") == namespace, bias).otherwise(0.0)
    return hits.groupBy("query_id").agg(F.min_by(F.struct("id", "distance"), F.struct(F.round(near, 9), "rank")).alias("b")).select("query_id", "b.*")


def by_names(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose name is one of the names, as written or in lower case; ``names`` has one column ``name``."""
    wanted = names.select("name").union(names.select(F.lower("name"))).filter("name is not null").distinct()
    return catalog.join(wanted, "name", "left_semi")


def types_by_name(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of category type whose name is one of the names, with or without ``type.`` before it."""
    wanted = names.select("name").union(names.select(F.concat(F.lit("type."), "name"))).filter("name is not null").distinct()
    return catalog.filter("category = 'type'").join(wanted, "name", "left_semi")


def loads(rows: DataFrame, namespaces: list[str], key: str = "row_no") -> DataFrame:
    """(namespace, n_loaded, n_names, n_replaced): what loading the hot subset counts, by namespace.

    Rows come in the order of the namespaces and of ``key``; a row replaces what its name holds if its document is
    strictly longer than all before it.
    """
    at = F.array_position(F.array(*[F.lit(n) for n in namespaces]), F.col("namespace"))
    inside = rows.filter("name is not null").select(index_key(F.col("name")).alias("name_key"), "namespace", at.alias("at"), F.length(F.coalesce("document", F.lit(""))).alias("size"), F.col(key).alias("row")).filter(F.coalesce("at", F.lit(0)) > 0)
    before = Window.partitionBy("name_key").orderBy("at", "row").rowsBetween(Window.unboundedPreceding, -1)
    longest = F.max("size").over(before)
    counted = inside.withColumn("replaces", F.coalesce(F.col("size") > longest, F.lit(False)))
    return counted.groupBy("namespace").agg(F.count("*").alias("n_loaded"), F.countDistinct("name_key").alias("n_names"), F.count_if("replaces").alias("n_replaced"))
