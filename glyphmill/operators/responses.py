"""Compiler responses that were landed as JSON: diagnostics as rows, placeholders filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.scalar import describe_code
from glyphmill.sources.schemas import RESPONSE, RESPONSE_ITEM

#: What a placeholder says where the code shows no identifier; null stands for the word of its own.
PLACEHOLDERS = (
    ("identifier", "value", True), ("name", "value", True), ("kind", "identifier", False), ("fullName", "value", True), ("funId", "function", True), ("funName", "function", True), ("argDisplayName", "argument", True),
    ("argUserFriendlyRepresentation", "value", True), ("argumentType", "type", False), ("currentTypeDocStr", "expected type", False), ("typePostfix", "", False), ("scope", "scope", False),
)


def _item(raw: Column) -> Column:
    """A diagnostic from one item: an object, or a bare text."""
    e = F.from_json(raw, RESPONSE_ITEM)
    number = lambda *cols: F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols], F.lit(0))
    said = F.coalesce(*[F.nullif(e[n], F.lit("")) for n in ("text", "message", "msg")], raw)
    context = F.coalesce(F.map_entries(e["ctx"]), F.array().cast("array<struct<key:string,value:string>>"))
    own = F.array(*[F.struct(F.lit(n).alias("key"), e[n].alias("value")) for n in ("text", "msg")])
    filled = F.aggregate(F.filter(F.concat(context, own), lambda kv: kv["value"].isNotNull()), said, lambda text, kv: F.replace(text, F.concat(F.lit("{"), kv["key"], F.lit("}")), kv["value"]))
    is_object = F.trim(raw).startswith("{")
    zero = F.lit(0)
    return F.struct(
        F.when(is_object, number(e["line"], e["lineNumber"], e["start"]["line"])).otherwise(zero).alias("line"), F.when(is_object, number(e["column"], e["col"], e["start"]["column"])).otherwise(zero).alias("column"),
        F.when(is_object, number(e["end"]["line"])).otherwise(zero).alias("end_line"), F.when(is_object, number(e["end"]["column"])).otherwise(zero).alias("end_col"), F.coalesce(F.when(is_object, e["code"]), F.lit("")).alias("code"),
        F.when(is_object, filled).otherwise(raw).alias("text"), F.coalesce(F.when(is_object, F.nullif(e["type"], F.lit(""))), F.lit("error")).alias("type"), F.when(is_object, e["ctx"]).alias("ctx"),
    )


def normalize_responses(responses: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, success, errors, warnings): each response with its diagnostics, warnings apart.

    Items come from the result, else from the top level; a rejection without items is one error with its reason. A
    response that is not JSON is a rejection. success means no errors.
    """
    r = F.from_json(F.col(payload), RESPONSE)
    none = F.array().cast("array<string>")
    inner, outer = F.coalesce(r["result"]["errors"], none), F.coalesce(r["errors"], none)
    items = F.filter(F.when(F.size(inner) > 0, inner).otherwise(outer), lambda i: i.isNotNull())
    reason = F.to_json(F.struct(F.coalesce(r["reason"], F.lit("Unknown compilation failure")).alias("text")))
    rejected = ~F.coalesce(r["success"], F.lit(False)) & (F.size(items) == 0)
    rows = responses.select(key, F.when(rejected, F.array(reason)).otherwise(items).alias("_items")).withColumn("_all", F.transform("_items", _item))
    errors = F.filter("_all", lambda d: d["type"] != "warning")
    return rows.select(key, (F.size(errors) == 0).alias("success"), errors.alias("errors"), F.filter("_all", lambda d: d["type"] == "warning").alias("warnings"))


def diagnostic_text() -> Column:
    """A diagnostic (columns line, column, end_line, end_col, code, type, text, ctx) as lines: place, message, meaning, context."""
    at = lambda line, column: F.concat(F.lit("Line "), F.col(line).cast("string"), F.lit(", Col "), F.col(column).cast("string"))
    ends = (F.col("end_line") > 0) & (F.col("end_col") > 0) & ((F.col("end_line") != F.col("line")) | (F.col("end_col") != F.col("column")))
    tag = F.when(F.col("code") != "", F.col("code")).otherwise(F.upper("type"))
    head = F.concat(at("line", "column"), F.when(ends, F.concat(F.lit(" -> "), at("end_line", "end_col"))).otherwise(""), F.lit(" ["), tag, F.lit("]"))
    meaning = F.nullif(describe_code(F.col("code")), F.lit(""))
    context = F.array_join(F.transform(F.map_entries("ctx"), lambda kv: F.concat(kv["key"], F.lit("='"), kv["value"], F.lit("'"))), ", ")
    return F.concat_ws("\n", head, F.concat(F.lit("  "), F.col("text")), F.concat(F.lit("  Code: "), meaning), F.concat(F.lit("  Context: "), F.nullif(context, F.lit(""))))


def fill_from_code(diagnostics: DataFrame, code: str = "code", text: str = "text", line: str = "line", column: str = "column") -> DataFrame:
    """Placeholders left in ``text`` filled from the identifier at the diagnostic's place in the code.

    Positions count from 1; one outside the code shows no identifier. Unknown placeholders become their own word.
    """
    at = F.when(F.col(line) > 0, F.get(F.split(F.col(code), r"\R"), F.col(line) - 1))
    shown = F.when((F.col(column) > 0) & (F.col(column) <= F.length(at)), F.regexp_extract(F.substring(at, F.col(column), F.length(at)), r"^[\p{L}\p{N}_.]*", 0))
    word = F.coalesce(F.nullif(shown, F.lit("")), F.lit(None).cast("string"))
    out = F.col(text)
    for name, stand_in, takes in PLACEHOLDERS:
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(word, F.lit(stand_in)) if takes else F.lit(stand_in))
    out = F.regexp_replace(out, r"\{(\w+)\}", "$1")
    return diagnostics.withColumn(text, F.when(F.coalesce(F.col(code), F.lit("")) == "", F.col(text)).otherwise(out))
