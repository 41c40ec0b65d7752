"""Several values packed in one field (problem 4): delimiter skeletons.

A cell's skeleton is the cell with its ordinary characters masked: each run of them becomes ``a``, each run of spaces
``_``; quotes, escapes, brackets and every sign that might delimit stay. Which of those signs split, and which values
are wrapped in what, is resolved once per distinct skeleton and says for each value from which masked run to which it
reaches. The rules are joined back, by broadcast while they are small, and the cells take their values by position.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.skew import salted_join
from glyphmill.session import cut

#: Rules are broadcast up to this many bytes with their skeletons; beyond it they are joined by a shuffle with salts.
BROADCAST_BYTES = 8_000_000

#: The signs that delimit list fields, those that do so in one field only, signs that delimit between
#: spaces where no other does, the fields that hold code, and the quotes that may wrap a value.
MARKS = ",;|·\t\n"
FIELD_MARKS = {"sources": "+"}
SPACED_MARKS = "+/&"
CODE_FIELDS = ("raw_examples",)
QUOTES = {'"': '"', "'": "'", "“": "”", "`": "`"}

_GAP = r"\s\p{Z}\p{Cf}"
_EDGE = rf"[{_GAP}]+"
#: Signs that stay in the skeleton of a list, and of code that is quoted or bracketed as a whole.
_LIST_SIGNS = r"\"'“”`\\,;|·+/&()\[\]\t\n"
_QUOTED_SIGNS = r"\"\\,;|\[\]\n\-"
#: In other code string literals are ordinary; what may delimit are bars, semicolons and lines of three dashes, which
#: become one sign that separates records.
_LINE = "\x1e"
_DASHES = r"(?<![^\n])---[ \t]*+(?=\n|\z)"
_CODE_RUN = rf'(?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|(?!{_DASHES})[^|;{_LINE}])++'


def _run(signs: str) -> str:
    """A run of ordinary characters, spaces inside it included."""
    return rf"[^{signs}{_GAP}](?:[^{signs}]*[^{signs}{_GAP}])?"


#: By kind of skeleton: what is masked, in this order, by which sign. Every other character stays.
_MASKS = {
    "l": ((_run(_LIST_SIGNS), "a"), (rf"[{_GAP}&&[^\t\n]]+", "_")),
    "q": ((_run(_QUOTED_SIGNS), "a"), (rf"[{_GAP}&&[^\n]]+", "_")),
    "c": ((_DASHES, _LINE), (_CODE_RUN, "a")),
}


def _kind(cell: Column, field: Column) -> Column:
    """Kind of the cell's skeleton: code that begins with a quote or bracket, other code, or a list."""
    return F.when(field.isin(*CODE_FIELDS), F.when(cell.rlike(rf"^[{_GAP}]*+[\"\[]"), "q").otherwise("c")).otherwise("l")


def _by_kind(kind: Column, apply) -> Column:
    return F.when(kind == "q", apply(_MASKS["q"])).when(kind == "c", apply(_MASKS["c"])).otherwise(apply(_MASKS["l"]))


def skeleton(cell: Column, field: Column) -> Column:
    """The kind of the cell, the marks of its field alone, a colon, and the cell with its runs masked."""
    kind = _kind(cell, field)
    own = F.lit("")
    for name, marks in FIELD_MARKS.items():
        own = F.when(field == name, marks).otherwise(own)
    masked = _by_kind(kind, lambda masks: reduce(lambda text, mask: F.regexp_replace(text, *mask), masks, cell))
    return F.concat(kind, own, F.lit(":"), masked)


def _skip(shape: str, i: int, signs: str) -> int:
    while i < len(shape) and shape[i] in signs:
        i += 1
    return i


def _close(shape: str, i: int, quote: str, doubled: bool = True) -> int:
    """Where the quote that opens at ``i`` closes; -1 if it does not. Escaped and doubled quotes are inside."""
    simple, i = quote in "”`", i + 1
    while i < len(shape):
        if shape[i] == "\\" and not simple:
            i += 2
        elif shape[i] != quote:
            i += 1
        elif doubled and not simple and shape[i + 1 : i + 2] == quote:
            i += 2
        else:
            return i
    return -1


def _json_list(shape: str) -> list | None:
    """Rule of a JSON list of texts; None where the skeleton is no such list."""
    gap, out = "_\t\n", []
    i = _skip(shape, 0, gap)
    if shape[i : i + 1] != "[":
        return None
    i = _skip(shape, i + 1, gap)
    while shape[i : i + 1] == '"' and (end := _close(shape, i, '"', doubled=False)) > 0:
        out.append((i, end + 1 - i, "j"))
        i = _skip(shape, end + 1, gap)
        if shape[i : i + 1] != ",":
            break
        i = _skip(shape, i + 1, gap)
        if shape[i : i + 1] != '"':
            return None
    return out if shape[i : i + 1] == "]" and _skip(shape, i + 1, gap) == len(shape) else None


def _between(shape: str, i: int) -> int:
    """Length of a delimiter of code at ``i``: two or more bars, three or more semicolons, a line of three dashes."""
    bars, semicolons = _skip(shape, i, "|") - i, _skip(shape, i, ";") - i
    if bars >= 2:
        return bars
    if semicolons >= 3:
        return semicolons
    if shape.startswith("---", i) and shape[i - 1 : i] in ("", "\n"):
        end = _skip(shape, i + 3, "_")
        return end - i if shape[end : end + 1] in ("", "\n") else 0
    return 0


def _wrapped_code(shape: str) -> list | None:
    """Rule of code whose blocks are all quoted; None where something else stands between the quotes."""
    out, i = [], _skip(shape, 0, "_\n")
    if shape[i : i + 1] != '"':
        return None
    while i < len(shape):
        if shape[i] == '"':
            if (end := _close(shape, i, '"')) < 0:
                return None
            out.append((i, end + 1 - i, '"'))
            i = _skip(shape, end + 1, "_\n")
            if i == len(shape):
                break
        passed = 3 if shape.startswith("---", i) else 1 if shape[i] == "," else _between(shape, i)
        if not passed:
            return None
        i = _skip(shape, i + passed, "_\n")
    return out


def _code(shape: str, kind: str) -> list:
    """Rule of other code: blocks between its delimiters; in a quoted skeleton literals within a line are whole."""
    out, start, i = [], 0, 0
    while i < len(shape):
        passed = 1 if kind == "c" and shape[i] == _LINE else _between(shape, i)
        if passed:
            out.append((start, i - start, ""))
            start = i = i + passed
        elif kind == "q" and shape[i] == '"':
            end = _close(shape, i, '"', doubled=False)
            i = end + 1 if end > 0 and "\n" not in shape[i:end] else i + 1
        elif shape[i] in "|;":  # too few of them: they are code
            i = _skip(shape, i, shape[i])
        else:
            i += 1
    return [r for r in [*out, (start, len(shape) - start, "")] if r[1]]


def _plain_end(shape: str, i: int, marks: str) -> int:
    """Where an unquoted value ends: at the next mark that stands in no closed parentheses."""
    while i < len(shape) and shape[i] not in marks:
        if shape[i] == "(":
            depth, j = 1, i + 1
            while j < len(shape) and depth and shape[j] != "\n":
                depth += {"(": 1, ")": -1}.get(shape[j], 0)
                j += 1
            i = j if not depth else i + 1
        else:
            i += 1
    return i


def _list(shape: str, marks: str) -> list:
    """Rule of a list: marks split outside quotes and closed parentheses; a quote wraps a value if it ends with it."""
    out, i = [], 0
    while (i := _skip(shape, i, marks + "_")) < len(shape):
        quote = QUOTES.get(shape[i])
        end = _close(shape, i, quote) + 1 if quote else 0
        after = _skip(shape, end, "_")
        if end and (after == len(shape) or shape[after] in marks):
            out.append((i, end - i, shape[i]))
        else:
            end = _plain_end(shape, i, marks)
            out.append((i, end - i, ""))
        i = end
    return out


def resolve(skeleton: str) -> list[tuple[int, int, str]]:
    """Splitting rule of a skeleton: (first run, number of runs, wrapping) of each value; wrapping is '', a quote or j for JSON.

    A JSON list is read as one, whatever else its signs might mean. Code is a row of quoted blocks if nothing else
    stands between the quotes, else it splits at its own delimiters. A list splits at the marks; where none of them
    stands outside quotes and parentheses, at the sign among ``+``, ``/`` and ``&`` that most often stands between spaces.
    """
    head, _, shape = skeleton.partition(":")
    kind, marks = head[0], MARKS + head[1:]
    rule = _json_list(shape)
    if rule is not None:
        return rule
    if kind != "l":
        rule = _wrapped_code(shape) if kind == "q" else None
        return _code(shape, kind) if rule is None else rule
    rule = _list(shape, marks)
    if len(rule) == 1 and not rule[0][2]:
        spaced = {m: shape.count(f"_{m}_") for m in SPACED_MARKS}
        most = max(spaced, key=lambda m: (spaced[m], m))
        if spaced[most]:
            return _list(shape, marks + most)
    return rule


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["rule"] = [[{"first": i, "n": n, "wrap": w} for i, n, w in resolve(s)] for s in batch["skeleton"]]
        yield batch


def _value(run: Column, wrap: Column) -> Column:
    """A value without outer spaces, wrapping quotes and their escapes."""
    bare = F.regexp_replace(run, rf"^{_EDGE}|{_EDGE}$", "")
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    jsoned = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>")[0]
    plain = F.regexp_replace(F.regexp_replace(inner, r"\\([\"'“”`\\])", "$1"), r"([\"'])\1", "$1")
    text = F.when(wrap == "j", F.coalesce(jsoned, inner)).when(wrap != "", plain).otherwise(bare)
    return F.regexp_replace(text, rf"^{_EDGE}|{_EDGE}$", "")


def unpack(records: DataFrame, key: str = "row_no", fields: tuple[str, ...] = ("raw_examples", "raw_see_also", "sources"), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row_no, field_name, pos, item_text): one row per value packed in the fields.

    List fields split at commas, semicolons, bars, middle dots, tabs and line ends (sources at plus signs too), not
    inside parentheses that close; code fields at two or more bars, three semicolons and lines of three dashes, outside
    string literals. Both read JSON lists and values wrapped in quotes, inside which delimiters are text and a doubled
    or escaped quote is one quote. Null, empty and blank cells give no rows, empty values do not count, pos counts the
    others from 0. Repeated rows keep their values under their own key, extra columns are ignored, an empty table gives
    an empty result. Calling it runs a job: the rules of the distinct skeletons are resolved, and their bytes summed.
    """
    cells = (
        records.select(F.col(key).alias("row_no"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields])).alias("c"))
        .select("row_no", "c.field_name", "c.cell")
        .filter(F.col("cell").rlike(r"[^\s\p{Z}\p{Cf}]"))
        .withColumn("skeleton", skeleton(F.col("cell"), F.col("field_name")))
    )
    shapes = cells.groupBy("skeleton").agg(F.count("*").alias("n_cells"))
    rules = cut(shapes.mapInPandas(_rules, "skeleton string, n_cells bigint, rule array<struct<first:int,n:int,wrap:string>>"))
    weight = rules.agg(F.sum(F.octet_length("skeleton") + 16 + 40 * F.size("rule"))).first()[0] or 0
    few = weight <= broadcast_bytes  # the bound of the broadcast is measured
    ruled = cells.join(F.broadcast(rules.drop("n_cells")), "skeleton") if few else salted_join(cells, rules, ["skeleton"], "n_cells", "row_no")
    runs = _by_kind(F.substring("skeleton", 1, 1), lambda masks: F.regexp_extract_all("cell", F.lit("(?s)" + "|".join(p for p, _ in masks) + "|."), F.lit(0)))
    values = F.filter(F.transform("rule", lambda r: _value(F.array_join(F.slice("runs", r["first"] + 1, r["n"]), ""), r["wrap"])), lambda v: v != "")
    return ruled.withColumn("runs", runs).select("row_no", "field_name", F.posexplode(values).alias("pos", "item_text"))
