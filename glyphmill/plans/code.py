"""Queries of code diagnostics and rewriting over the code of documents and catalogue examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import render, terms
from glyphmill.functions import scalar as S
from glyphmill.operators import hints, lint, lookup, responses, rewrite
from glyphmill.plans.code_sql import ORACLE
from glyphmill.sources.tables import table

__all__ = ["ORACLE", "QUERIES"]


_CODE = ["rec_id", "pos"]


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, pos, code): every example of every entry, by its place in the array."""
    return table(spark, sf_dir, "pine_merged_entries").select("rec_id", F.posexplode("examples").alias("pos", "code")).filter("code is not null")


def lint_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of every example."""
    return lint.lint(_codes(spark, sf_dir), _CODE)


def lint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics by rule: the header, reassignments and comparisons that SQL can state."""
    rows = lint_code(spark, sf_dir).filter("code in ('LOCAL_VERSION', 'LOCAL_REASSIGN', 'LOCAL_NA_CMP', 'LOCAL_V4_COLOR')")
    return rows.groupBy("code", "type").agg(F.count("*").alias("n"), F.countDistinct(*_CODE).alias("n_codes"), F.sum("line_no").alias("line_sum"))


def code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every example holds."""
    return lint.code_summary(_codes(spark, sf_dir), _CODE)


def migrate_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example migrated, as a digest, with whether it changed."""
    rows = _codes(spark, sf_dir).withColumn("new", rewrite.migrate(F.col("code")))
    return rows.select(*_CODE, F.md5("new").alias("digest"), (F.col("new") != F.col("code")).alias("changed"))


def repair_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example repaired, as a digest, with the repairs that applied."""
    rows = _codes(spark, sf_dir).withColumn("r", rewrite.repair(rewrite.drop_when_argument(F.col("code"))))
    return rows.select(*_CODE, F.md5("r.code").alias("digest"), F.array_join("r.fixes", ",").alias("fixes"))


def repair_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example repaired with its bare calls prefixed, as a digest, with the repairs that applied."""
    rows = _codes(spark, sf_dir).withColumn("r", rewrite.repair_calls(F.col("code")))
    return rows.select(*_CODE, F.md5("r.code").alias("digest"), F.array_join("r.fixes", ",").alias("fixes"))


def modernize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example repaired and migrated, as a digest, with the repairs that applied."""
    rows = _codes(spark, sf_dir).withColumn("r", rewrite.modernize(F.col("code")))
    return rows.select(*_CODE, F.md5("r.code").alias("digest"), F.array_join("r.fixes", ",").alias("fixes"))


def without_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example as the body of a strategy's call with a ``when`` argument, which goes."""
    rows = _codes(spark, sf_dir).filter("code not like '%(%' and code not like '%)%' and code not like '%,%'")
    wrapped = F.concat(F.lit("strategy.entry(a, when = f(b, c)"), F.lit(", "), F.col("code"), F.lit(")"))
    return rows.select(*_CODE, rewrite.drop_when_argument(wrapped).alias("code"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, payload): every error report, and the compiler response that its messages stand for.

    A message is a code, a place and a name in backticks; names hold entities and format characters. A report without a
    message is a rejection.
    """
    rows = table(spark, sf_dir, "documents").filter("doc_kind = 'error_report'").select("doc_id", "text", F.regexp_extract_all("text", F.lit(_MESSAGE), F.lit(0)).alias("m"))
    part = lambda m, i: F.regexp_extract(m, _MESSAGE, i)
    items = F.transform(
        "m",
        lambda m: F.struct(
            F.struct(part(m, 2).cast("int").alias("line"), part(m, 3).cast("int").alias("column")).alias("start"), part(m, 1).alias("code"), F.lit("Could not find {kind} '{fullName}' in {scope}").alias("message"),
            F.when(part(m, 1).startswith("CW"), "warning").alias("type"), F.struct(part(m, 4).alias("fullName"), F.lit("symbol").alias("kind")).alias("ctx"),
        ),
    )
    payload = F.when(F.size("m") > 0, F.to_json(F.struct(F.lit(True).alias("success"), F.struct(items.alias("errors")).alias("result")))).otherwise(F.lit('{"success": false, "reason": "no message"}'))
    return rows.select("doc_id", "text", payload.alias("payload"))


_MESSAGE = r"\b(C[EW][0-9]{5}) @ ([0-9]{1,9}):([0-9]{1,9}) `([^`\n]*)`"


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = responses.normalize_responses(_reports(spark, sf_dir), "doc_id", "payload")
    return told.select("doc_id", "success", F.posexplode(F.concat("errors", "warnings")).alias("at", "d")).select("doc_id", "success", "at", "d.*")


def compile_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostics of every landed response, placeholders filled from their context."""
    return _diagnostics(spark, sf_dir).select("doc_id", "at", "success", "line", "column", "code", "type", "text")


def filled_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a diagnostic at the start of each example's first line says, filled from the code."""
    rows = _codes(spark, sf_dir).select(*_CODE, "code", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("Undeclared {kind} '{identifier}' of {argumentType}{typePostfix} {other}").alias("text"))
    return responses.fill_from_code(rows).select(*_CODE, "text")


def explained_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight diagnostics of each report that name a symbol, rendered, with the beginning of its catalogue entry."""
    catalog = table(spark, sf_dir, "catalog_records")
    best = lookup.best_version(catalog).select("name_key", F.col("best_row").alias("row_no"))
    docs = best.join(catalog.select("row_no", render.entry_detail().alias("detail")), "row_no").select("name_key", F.array_join(F.slice(F.split("detail", r"\R"), 1, 5), "\n").alias("docs"))
    named = _diagnostics(spark, sf_dir).withColumn("name_key", F.lower(S.error_name(F.col("text")))).filter("name_key is not null")
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).filter("n <= 8")
    shown = first.join(docs, "name_key", "left").withColumn("report", responses.diagnostic_text())
    return shown.select("doc_id", "n", "name_key", F.md5("report").alias("report"), F.md5("docs").alias("docs"))


def fix_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the hint of the first and of the longest namespace that it names, with the name it quotes filled in."""
    spaces = table(spark, sf_dir, "discovery_index").filter("namespace != ''").select("namespace").distinct()
    ranked = spaces.select(F.row_number().over(Window.orderBy("namespace")).alias("ord"), F.concat("namespace", F.lit(".")).alias("pattern"))  # a row per namespace
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = hints.pattern_list(ranked, "ord", "pattern")
    hint = F.create_map(*[F.lit(x) for o, p in told for x in (o, f"{{name}}: see the pages of {p}")])
    matched = hints.match_patterns(texts.withColumn("key", F.struct("doc_id", F.regexp_extract("text", r"'([a-zA-Z_][a-zA-Z0-9_.]*)'", 0).alias("quoted"))), "key", "text", told)
    fill = lambda of: hints.filled(hint[F.col(of)], F.col("key.quoted"))
    return matched.select("key.doc_id", fill("first_match").alias("first_hint"), fill("longest_match").alias("longest_hint"))


def query_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of every entry's name and description mean by aliases, and the indicator families that they name."""
    text = F.concat_ws(" ", F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), "description")
    rows = table(spark, sf_dir, "pine_merged_entries").select("rec_id", F.array_join(terms.aliases(text), ",").alias("names"), F.array_join(terms.families(text), ",").alias("families"))
    return rows.filter("names != '' or families != ''")


def input_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameter of each entry that the first word of its first parameter's description means, or that its last parameter's name with an ending does."""
    rows = table(spark, sf_dir, "pine_merged_entries").select("rec_id", F.filter(F.transform("parameters", lambda p: p["name"]), lambda n: n.isNotNull()).alias("names")).filter("size(names) > 0")
    variable = F.concat(F.get("names", F.size("names") - 1), F.lit("Input"))
    return rows.select("rec_id", variable.alias("variable"), terms.parameter_for(variable, F.col("names")).alias("parameter"))


def input_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed input declaration for every parameter: from its default where it has one, else from its name."""
    rows = table(spark, sf_dir, "pine_merged_entries").select("rec_id", F.posexplode("parameters").alias("pos", "p")).filter("trim(p.name) != ''")
    asked = F.when(F.col("p.default").isNotNull(), F.concat("p.name", F.lit(" = "), "p.default")).otherwise(F.col("p.name"))
    return rows.select("rec_id", "pos", S.input_line(asked).alias("line"))


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error codes in reports, with what they mean."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\b(C[EW]\d{5}) @ \d+:\d+"), F.lit(1)))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).withColumn("meaning", S.describe_code(F.col("code")))


def error_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol that the reference's pattern finds in the first line of an error report, beside the best catalogue row of that name; reports without one are left out."""
    named = table(spark, sf_dir, "documents").filter("doc_kind = 'error_report'").select("doc_id", F.lower(S.error_name(F.replace(F.substring_index("text", "\n", 1), F.lit("`"), F.lit("'")))).alias("name_key")).filter("name_key is not null")
    best = lookup.best_version(table(spark, sf_dir, "catalog_records")).select("name_key", "best_row")
    return named.join(best, "name_key", "left").select("doc_id", "name_key", "best_row")


def report_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error report with the symbol its first line names in any dress, null without one, beside the best catalogue row of that name."""
    line = F.substring_index("text", "\n", 1)
    found = F.coalesce(S.error_name(F.replace(line, F.lit("`"), F.lit("'"))), S.error_name(S.undressed(line)))
    named = table(spark, sf_dir, "documents").filter("doc_kind = 'error_report'").select("doc_id", F.lower(found).alias("name_key"))
    best = lookup.best_version(table(spark, sf_dir, "catalog_records")).select("name_key", "best_row")
    return named.join(best, "name_key", "left").select("doc_id", "name_key", "best_row")


def hint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the longest built-in name in the see-also cell of each catalogue row."""
    patterns = hints.pattern_list(table(spark, sf_dir, "builtin_symbols"), "symbol_id", "name")
    return hints.match_patterns(table(spark, sf_dir, "catalog_records"), "row_no", "raw_see_also", patterns)


def sanitize_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text made safe for a literal, and its text without control characters, as digests."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", F.md5(S.sanitize_text(F.col("text"))).alias("text_digest"), S.sanitize_literal(F.col("text")).alias("literal"), F.length(S.redact_paths(F.col("text"))).alias("redacted_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (lint_code, lint_counts, code_summary, migrate_code, repair_code, repair_calls, modernize_code, without_when, compile_diagnostics, filled_diagnostics, explained_errors, fix_hints, query_aliases, input_parameters, input_lines, error_codes, error_symbols, report_symbols, hint_match, sanitize_texts)
}
