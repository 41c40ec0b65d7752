"""Entries as text: details, listing lines, capped texts. Labels and widths are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.scalar import relevance, strip
from glyphmill.operators.search import distinct_examples

_MEMBERS = "array<struct<name:string,type:string,description:string,optional:string,default:string>>"
#: A text over this many characters is capped.
CAP = 80_000


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _members(raw: Column) -> Column:
    """The members of a JSON list of objects; null where it is none."""
    return F.when(strip(raw).startswith("["), F.from_json(raw, _MEMBERS))


def _member_lines(m: Column, extra: Column) -> Column:
    kind = F.coalesce(m["type"], F.lit(""))
    head = F.concat(F.lit("  "), F.coalesce(m["name"], F.lit("?")), F.when(kind != "", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise(""), extra)
    said = F.coalesce(m["description"], F.lit(""))
    return F.when(said != "", F.concat(head, F.lit("\n    "), said)).otherwise(head)


def parameters_text(raw: Column, count: Column) -> Column:
    """The parameters of a flat record, one or two lines each; their number where only that is known; else empty."""
    members = _members(raw)

    def line(m: Column) -> Column:
        optional = ~F.coalesce(m["optional"], F.lit("")).isin("", "false", "0")
        return _member_lines(m, F.concat(F.when(optional, " [optional]").otherwise(""), F.coalesce(F.concat(F.lit(" = "), m["default"]), F.lit(""))))

    full = F.concat(F.lit("PARAMETERS ("), F.size(members).cast("string"), F.lit("):\n"), F.array_join(F.transform(members, line), "\n"))
    number = F.when(F.coalesce(count, F.lit(0)) > 0, F.concat(F.lit("PARAMETERS: "), count.cast("string"), F.lit(" parameters"))).otherwise("")
    return F.when(F.coalesce(raw, F.lit("")) == "", number).when(F.size(members) > 0, full).otherwise("")


def fields_text(raw: Column) -> Column:
    """The fields of a type; empty without any."""
    members = _members(raw)
    return F.when(F.size(members) > 0, F.concat(F.lit("FIELDS:\n"), F.array_join(F.transform(members, lambda m: _member_lines(m, F.lit(""))), "\n"))).otherwise("")


def examples_text(raw: Column, count: Column, shown: int = 3) -> Column:
    """The first ``shown`` distinct examples; their number where only that is known; else empty."""
    blocks = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r" \|\|\| "), strip), lambda b: b != "")
    kept = F.slice(distinct_examples(blocks), 1, shown)
    each = F.transform(kept, lambda b, i: F.concat(F.lit("--- Example "), (i + 1).cast("string"), F.lit(" ---\n"), F.regexp_replace(F.regexp_replace(b, r"\R\z", ""), r"\R", "\n")))
    full = F.concat(F.lit("EXAMPLES ("), F.size(kept).cast("string"), F.lit("):\n"), F.array_join(each, "\n"))
    number = F.when(F.coalesce(count, F.lit(0)) > 0, F.concat(F.lit("EXAMPLES: "), count.cast("string"), F.lit(" examples available"))).otherwise("")
    return F.when(F.coalesce(raw, F.lit("")) == "", number).when(F.size(kept) > 0, full).otherwise("")


def display_name(name: Column, namespace: Column) -> Column:
    """The name behind its namespace, unless it already begins with it."""
    prefix = F.concat(namespace, F.lit("."))
    return F.when((F.coalesce(namespace, F.lit("")) != "") & ~name.startswith(prefix), F.concat(prefix, name)).otherwise(name)


def _lines_of(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, r"\R"), strip), lambda l: l != ""), "\n")


def entry_detail(distance: Column | None = None) -> Column:
    """The full text of a flat record (columns of the catalogue), capped; a notice where it has no document to speak of."""
    document, name = _text("document"), F.coalesce("name", F.lit("?"))
    part = lambda label, value: F.when(value != "", F.concat(F.lit(label), value))
    near = F.coalesce(F.concat(F.lit(" (Relevance: "), relevance(distance).cast("string"), F.lit("%)")), F.lit("")) if distance is not None else F.lit("")
    head = F.concat(F.upper(F.coalesce("category", F.lit("?"))), F.lit(": "), display_name(name, F.col("namespace")), near)
    said = F.when(_text("raw_description") != "", F.col("raw_description")).otherwise(strip(document))
    texts = [parameters_text(F.col("raw_parameters"), F.col("param_count")), fields_text(F.col("raw_type_fields")), examples_text(F.col("raw_examples"), F.col("example_count"))]
    parameters, fields, examples = [F.nullif(t, F.lit("")) for t in texts]
    body = F.concat_ws(
        "\n", head, part("SYNTAX: ", _text("syntax")), F.concat_ws("\n", F.lit("DESCRIPTION:"), F.nullif(_lines_of(said), F.lit(""))), parameters, part("RETURNS: ", _text("returns")),
        F.when(_text("remarks") != "", F.concat_ws("\n", F.lit("REMARKS:"), F.nullif(_lines_of(F.col("remarks")), F.lit("")))), fields, examples, part("SEE ALSO: ", _text("raw_see_also")),
    )
    return F.when(F.length(strip(document)) < 10, F.concat(F.lit("'"), name, F.lit("' was found but has no local documentation."))).otherwise(capped(body))


def capped(text: Column, limit: int = CAP) -> Column:
    """A text of at most ``limit`` characters as it is; a longer one cut, its open fence closed, the rest counted."""
    kept = F.substring(text, 1, limit)

    def step(fenced: Column, line: Column) -> Column:
        closes = (line == "```") | line.startswith("``` ")
        return F.when(~line.startswith("```"), fenced).when(fenced, ~closes).otherwise(True)

    fenced = F.aggregate(F.transform(F.split(kept, "\n"), strip), F.lit(False), step)
    closed = F.when(fenced, F.concat(kept, F.lit("\n```"))).otherwise(kept)
    rest = F.format_number(F.length(text) - F.length(closed), 0)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(closed, F.lit("\n\n[...truncated - "), rest, F.lit(" chars omitted]")))


def first_sentence(text: Column, width: int) -> Column:
    """What stands before the first full stop, at most ``width`` characters."""
    return F.substring(F.substring_index(F.coalesce(text, F.lit("")), ".", 1), 1, width)


def first_paragraph(text: Column, width: int) -> Column:
    """What stands before the first blank line; cut at ``width`` characters with three dots behind."""
    part = F.substring_index(F.coalesce(text, F.lit("")), "\n\n", 1)
    return F.when(F.length(part) > width, F.concat(F.substring(part, 1, width), F.lit("..."))).otherwise(part)


def _signature(width: int, returns: int) -> Column:
    name = F.coalesce("name", F.lit("?"))
    shown = F.when(_text("syntax") != "", F.substring("syntax", 1, width)).otherwise(name)
    return F.concat(F.lit("  "), shown, F.when(_text("returns") != "", F.concat(F.lit(" -> "), F.substring("returns", 1, returns))).otherwise(""))


def listing_line(ordered: tuple[str, ...]) -> Column:
    """A record's line in a listing: a signature for functions, the name and what it is for the other ``ordered`` categories, else the name."""
    name, said = F.concat(F.lit("  "), F.coalesce("name", F.lit("?"))), first_sentence(F.col("raw_description"), 100)
    other = F.when(F.col("category").isin(*ordered), F.concat(name, F.when(said != "", F.concat(F.lit(" - "), said)).otherwise(""))).otherwise(name)
    return F.when(F.col("category") == "function", _signature(80, 30)).otherwise(other)


def cheatsheet_line(ordered: tuple[str, ...]) -> Column:
    """A record's lines in a cheat sheet: the signature or name, and what it is below it for the ``ordered`` categories."""
    name, said = F.concat(F.lit("  "), F.coalesce("name", F.lit("?"))), first_sentence(F.col("raw_description"), 80)
    head = F.when(F.col("category") == "function", _signature(70, 25)).otherwise(name)
    return F.when(F.col("category").isin(*ordered) & (said != ""), F.concat(head, F.lit("\n    "), said)).otherwise(head)
