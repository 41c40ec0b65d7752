"""Queries of the training-data problems 1, 5, 6, 7 and 8 over whole tables, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import dedupe, language, packing, survivors, tokens
from glyphmill.plans.problems import symbol_sql
from glyphmill.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record whose symbol has a smaller record too."""
    return dedupe.copies(table(spark, sf_dir, "pine_merged_entries")).select(F.col("first_id").alias("first_rec_id"), "rec_id")


def p1_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per symbol with its number of rows."""
    return dedupe.collapsed(table(spark, sf_dir, "pine_merged_entries")).withColumnRenamed("first_id", "first_rec_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which record gives each slot of the surviving record of each symbol."""
    return survivors.survivors(table(spark, sf_dir, "pine_merged_entries"), table(spark, sf_dir, "source_trust"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each symbol with two or more records, its source codes in one text."""
    return survivors.merged_records(table(spark, sf_dir, "pine_merged_entries"), table(spark, sf_dir, "source_trust")).withColumn("sources", F.array_join("sources", "|"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: a digest of the bytes that each document's ids stand for."""
    return tokens.decode(p6_ids(spark, sf_dir)).select("doc_id", F.md5("bytes").alias("digest"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's container, for every capacity of token_budgets."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_budgets"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p7_packed(spark, sf_dir))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed for each capacity, and what is wrong with their containers: nothing."""
    documents = table(spark, sf_dir, "documents")
    return packing.packing_faults(packing.pack_documents(documents, table(spark, sf_dir, "token_budgets")), tokens.token_counts(documents))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label, and the stretches of documents in several languages."""
    return language.wrong_or_mixed(language.languages(table(spark, sf_dir, "documents")))


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and stretch."""
    return language.languages(table(spark, sf_dir, "documents")).select("doc_id", "seg_no", "lang_code", "confidence", "n_chars")


def p8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the stretches: confidences outside 0 to 1, numbers that skip, documents whose stretches are not all of it; nothing."""
    told = language.languages(table(spark, sf_dir, "documents"))
    per = told.groupBy("doc_id").agg(
        F.count_if(~F.col("confidence").between(1e-9, 1.0)).alias("unsure"), F.count("*").alias("n"), F.max("seg_no").alias("last"), F.max("n_segments").alias("n_segments"), F.sum(F.when(F.col("seg_no") > 0, F.col("n_chars"))).alias("parts"), F.max(F.when(F.col("seg_no") == 0, F.col("n_chars"))).alias("whole")
    )
    return per.agg(F.coalesce(F.sum("unsure"), F.lit(0)).alias("n_unsure"), F.count_if((F.col("n") != F.col("last") + 1) | (F.col("last") != F.col("n_segments"))).alias("n_gaps"), F.count_if(F.col("parts") != F.col("whole")).alias("n_partial"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_symbols, p5_found, p5_records, p6_ids, p6_decoded, p7_packed, p7_fill, p7_faults, p8_found, p8_languages, p8_faults)
}

_SYMBOLS = f"SELECT rec_id, sym_name, coalesce(sym_category, '') AS sym_category FROM ({symbol_sql('pine_merged_entries', 'rec_id')}) WHERE sym_name IS NOT NULL"

_TRIMMED = r"regexp_replace({0}, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g')"
_CODE = "nullif(regexp_replace(" + _TRIMMED.format("lower(c)") + r", '[\s\p{Z}_\-]+', '_', 'g'), '')"
_AT = r"TRY_CAST(CASE WHEN regexp_matches(scraped_at, '(Z|[+-]\d\d:\d\d)$') THEN scraped_at ELSE scraped_at || '+00:00' END AS TIMESTAMPTZ)"
_STAND_INS = ", ".join(f"'{x}'" for x in survivors.STAND_INS)
_ELIDED = r"regexp_matches(v, '(?:…|\.\.\.|\[cut\])$|\((?:…|\.\.\.)\)')"
_STEM = r"regexp_replace(v, '[\s\p{Z}]*(?:…|\.\.\.|\[cut\])$', '')"

_SURVIVORS = f"""
WITH r AS MATERIALIZED (SELECT rec_id, sym_name || '|' || coalesce(sym_category, '') AS k, sources, syntax, description, {_AT} AS at_time FROM ({symbol_sql('pine_merged_entries', 'rec_id, sources, syntax, description, scraped_at')}) WHERE sym_name IS NOT NULL),
g AS MATERIALIZED (SELECT k, min(rec_id) AS first_rec_id FROM r GROUP BY k HAVING count(*) > 1),
c AS MATERIALIZED (SELECT rec_id, k, {_CODE} AS code FROM (SELECT rec_id, k, unnest(sources) AS c FROM r SEMI JOIN g USING (k))),
b AS (SELECT rec_id, min(trust_rank) AS best FROM c JOIN source_trust ON source_code = code GROUP BY 1),
v AS MATERIALIZED (SELECT k, slot, rec_id, at_time, best, v, {_ELIDED} AS elided FROM (SELECT k, rec_id, at_time, best, unnest(['syntax', 'description']) AS slot, unnest([{_TRIMMED.format('syntax')}, {_TRIMMED.format('description')}]) AS v FROM r SEMI JOIN g USING (k) LEFT JOIN b USING (rec_id))
      WHERE v <> '' AND lower(v) NOT IN ({_STAND_INS})),
stems AS MATERIALIZED (SELECT DISTINCT k, slot, CASE WHEN elided THEN {_STEM} ELSE v END AS stem FROM v),
w AS (SELECT * FROM v WHERE NOT elided AND NOT EXISTS (SELECT 1 FROM stems s WHERE s.k = v.k AND s.slot = v.slot AND s.stem <> v.v AND starts_with(s.stem, v.v)))
SELECT first_rec_id, slot, rec_id AS from_rec_id FROM w JOIN g USING (k) QUALIFY row_number() OVER (PARTITION BY k, slot ORDER BY best NULLS LAST, at_time DESC NULLS LAST, rec_id) = 1
UNION ALL SELECT first_rec_id, 'sources/' || code AS slot, min(rec_id) FROM c JOIN g USING (k) WHERE code IS NOT NULL GROUP BY first_rec_id, code
"""

_RECORDS = f"""
WITH s AS ({_SURVIVORS}),
t AS (SELECT rec_id AS from_rec_id, {_TRIMMED.format('syntax')} AS syntax, {_TRIMMED.format('description')} AS description FROM pine_merged_entries)
SELECT first_rec_id, max(syntax) FILTER (slot = 'syntax') AS syntax, max(description) FILTER (slot = 'description') AS description,
  coalesce(string_agg(substring(slot, 9), '|' ORDER BY slot) FILTER (starts_with(slot, 'sources/')), '') AS sources FROM s JOIN t USING (from_rec_id) GROUP BY 1
"""

ORACLE: dict[str, str] = {
    "p5_found": _SURVIVORS,
    "p5_records": _RECORDS,
    "p1_found": f"""SELECT first_rec_id, rec_id FROM (SELECT rec_id, min(rec_id) OVER (PARTITION BY sym_name, sym_category) AS first_rec_id FROM ({_SYMBOLS})) WHERE rec_id > first_rec_id""",
    "p1_symbols": f"SELECT sym_name, sym_category, min(rec_id) AS first_rec_id, count(*) AS n_rows FROM ({_SYMBOLS}) GROUP BY 1, 2",
    "p8_faults": "SELECT CAST(0 AS BIGINT) AS n_unsure, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_partial",
    "p7_faults": """SELECT budget_id, CAST(capacity AS BIGINT) AS capacity, (SELECT count(*) FROM documents WHERE text <> '') AS n_documents, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_amiss
        FROM (SELECT DISTINCT budget_id, capacity FROM token_budgets WHERE budget_id IS NOT NULL AND capacity > 0)""",
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
