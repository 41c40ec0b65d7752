"""Local diagnostics of code, without a compiler. Each code is one row, so every rule works inside it: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.scalar import blank_literals

#: Bare colour names of the old syntax, and functions that need the ta namespace.
OLD_COLORS = ("aqua", "black", "blue", "fuchsia", "gray", "green", "lime", "maroon", "navy", "olive", "orange", "purple", "red", "silver", "teal", "white", "yellow")
BARE_FUNCTIONS = (
    "alma", "atr", "barssince", "bb", "change", "correlation", "crossover", "crossunder", "cum", "dmi", "ema", "falling", "highest", "hma", "kama", "linreg",
    "lowest", "macd", "mom", "percentrank", "pivothigh", "pivotlow", "rising", "rsi", "sma", "stdev", "stoch", "supertrend", "swma", "valuewhen", "variance", "vwap", "wma",
)


_DIAG = "array<struct<line_no:int,code:string,text:string,type:string>>"


def raw_lines(code: Column) -> Column:
    """The lines of a code; a line end at the end adds no line."""
    return F.split(F.regexp_replace(code, r"\R\z", ""), r"\R")


def clean_lines(code: Column) -> Column:
    """struct(line_no, c) of each line, from 1, with the literals of the whole code blanked and comments cut."""
    return F.transform(raw_lines(blank_literals(code)), lambda l, i: F.struct((i + 1).cast("int").alias("line_no"), F.regexp_replace(l, "(?s)//.*$", "").alias("c")))


def _diagnostic(line: Column, code: str, text: Column | str, kind: str = "error") -> Column:
    return F.struct(line.cast("int").alias("line_no"), F.lit(code).alias("code"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(kind).alias("type"))


def _matching(pattern: str, code: str, text: str, kind: str = "error") -> Column:
    """A diagnostic for every line that matches."""
    return F.transform(F.filter("_lines", lambda l: F.rlike(l["c"], F.lit(pattern))), lambda l: _diagnostic(l["line_no"], code, text, kind))


def _once(condition: Column, diagnostic: Column) -> Column:
    return F.when(condition, F.array(diagnostic)).otherwise(F.array().cast(_DIAG))


def _header() -> Column:
    first = F.slice("_raw", 1, 10)
    told = F.get(F.filter(F.transform(first, lambda l, i: F.struct((i + 1).alias("line_no"), F.regexp_extract(l, r"^\s*//@version=(\d)", 1).alias("v"))), lambda x: x["v"] != ""), F.lit(0))
    other = F.coalesce(told["v"] != "6", F.lit(False))
    text = F.when(other, F.concat(F.lit("The code says version "), told["v"], F.lit(", not //@version=6"))).otherwise("No //@version=6 in the first ten lines")
    return _once(~F.exists(first, lambda l: l.contains("//@version=6")), _diagnostic(F.when(other, told["line_no"]).otherwise(1), "LOCAL_VERSION", text))


def _study() -> Column:
    lines = F.filter("_lines", lambda l: F.rlike(l["c"], F.lit(r"\bstudy\s*\(")))
    return _once(F.size(lines) > 0, _diagnostic(F.get(lines, F.lit(0))["line_no"], "LOCAL_V5_STUDY", "study() is now called indicator()"))


def _colors(pattern: str) -> Column:
    named = F.transform("_lines", lambda l: F.struct(l["line_no"].alias("line_no"), F.regexp_extract(l["c"], pattern, 1).alias("n")))
    text = lambda n: F.concat(F.lit("The color "), n, F.lit(" is now written color."), n)
    return F.transform(F.filter(named, lambda x: x["n"].isin(*OLD_COLORS)), lambda x: _diagnostic(x["line_no"], "LOCAL_V4_COLOR", text(x["n"])))


def _balance(opening: str, closing: str, extra: str, lacking: str, word: str) -> Column:
    """Fold over a code's signs: the depth, and lines where a closing sign has no partner; there the depth starts anew."""
    signs = F.flatten(F.transform("_lines", lambda l: F.transform(F.regexp_extract_all(l["c"], F.lit(rf"([\{opening}\{closing}])"), F.lit(1)), lambda s: F.struct(l["line_no"].alias("line_no"), s.alias("s")))))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("bad"))

    def step(acc: Column, s: Column) -> Column:
        return (
            F.when(s["s"] == opening, F.struct((acc["depth"] + 1).alias("depth"), acc["bad"].alias("bad")))
            .when(acc["depth"] == 0, F.struct(F.lit(0).alias("depth"), F.array_append(acc["bad"], s["line_no"]).alias("bad")))
            .otherwise(F.struct((acc["depth"] - 1).alias("depth"), acc["bad"].alias("bad")))
        )

    def told(acc: Column) -> Column:
        closed = F.transform(acc["bad"], lambda n: _diagnostic(n, extra, f"No {word} was opened for this '{closing}'"))
        text = F.concat(acc["depth"].cast("string"), F.lit(f" of '{opening}' never closed by a {word}"))
        return F.concat(closed, _once(acc["depth"] > 0, _diagnostic(F.size("_lines"), lacking, text)))

    return F.aggregate(signs, start, step, told)


def _reassigned() -> Column:
    pick = lambda pattern: F.filter(F.transform("_lines", lambda l: F.struct(l["line_no"].alias("line_no"), F.regexp_extract(l["c"], pattern, 1).alias("n"))), lambda x: x["n"] != "")
    declared = pick(r"^\s*(?:var\s+|varip\s+)?(?:\w+\s+)?(\w+)\s*=(?![=>])")
    early = F.filter(pick(r"^\s*(\w+)\s*:="), lambda u: ~F.exists(declared, lambda d: (d["n"] == u["n"]) & (d["line_no"] <= u["line_no"])))
    text = lambda n: F.concat(n, F.lit(" gets a value by := before its declaration by ="))
    return F.transform(early, lambda u: _diagnostic(u["line_no"], "LOCAL_REASSIGN", text(u["n"])))


def _strategy() -> Column:
    whole = F.array_join(F.transform("_lines", lambda l: l["c"]), "\n")
    declared, called = whole.rlike(r"\bstrategy\s*\("), whole.rlike(r"\bstrategy\.(entry|exit|close|order|cancel)")
    return _once(called & ~declared, _diagnostic(F.lit(0), "", "Strategy calls need a strategy() declaration"))


def _bare() -> Column:
    pattern = F.lit(rf"(?<![\w.])({'|'.join(BARE_FUNCTIONS)})\s*\(")
    named = F.transform("_lines", lambda l: F.struct(l["line_no"].alias("line_no"), F.array_min(F.regexp_extract_all(l["c"], pattern, F.lit(1))).alias("n")))
    text = lambda n: F.concat(n, F.lit("() is now called ta."), n, F.lit("()"))
    return F.transform(F.filter(named, lambda x: x["n"].isNotNull()), lambda x: _diagnostic(x["line_no"], "", text(x["n"])))


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def lint(codes: DataFrame, key: str | list[str] = "doc_id", code: str = "code") -> DataFrame:
    """(keys, line_no, code, text, type): the diagnostics of every code; codes without one give no row.

    Rules: version header, old study call, bare old colours, balance of parentheses and brackets, reassignment before
    declaration, comparison with na, unchecked array access, varip without input, strategy calls without declaration,
    the removed transp argument, bare functions (of several in a line the first by name). String literals and comments
    never match. Null and empty codes give no row.
    """
    # fixed values: the patterns of the rules and the codes they tell; what they say is in own words
    rules = [
        _header(), _study(), _colors(r"\bcolor\s*=\s*(\w+)"), _colors(r"\bbgcolor\s*\(\s*(\w+)"), _balance("(", ")", "CE10016", "CE10015", "parenthesis"), _balance("[", "]", "LOCAL_BRACKET", "LOCAL_BRACKET", "bracket"), _reassigned(),
        _matching(r"==\s*na\b|\bna\s*==", "LOCAL_NA_CMP", "Nothing equals na; ask na(x)"), _matching(r"!=\s*na\b|\bna\s*!=", "", "Everything differs from na; ask not na(x)"),
        _matching(r"array\.get\s*\(", "", "array.get() fails beyond array.size()", "warning"),
        _matching(r"^\s*varip\s+\w+\s*=\s*(?!.*input\().+", "", "varip without an input() may not keep what it holds", "warning"),
        _strategy(), _matching(r",\s*transp\s*=", "", "The argument transp is gone; color.new() takes the transparency", "warning"), _bare(),
    ]
    rows = codes.filter(F.col(code) != "").select(*_keys(key), raw_lines(F.col(code)).alias("_raw"), clean_lines(F.col(code)).alias("_lines"))
    return rows.select(*_keys(key), F.explode(F.concat(*rules)).alias("d")).select(*_keys(key), "d.*")


def code_summary(codes: DataFrame, key: str | list[str] = "doc_id", code: str = "code") -> DataFrame:
    """(keys, n_lines, n_plots, n_inputs, n_vars, n_comments, has_request, script_type): counts per code, inside its row."""
    rows = codes.filter(F.col(code) != "").select(*_keys(key), raw_lines(F.col(code)).alias("_raw"), clean_lines(F.col(code)).alias("_lines"))
    count = lambda pattern: F.size(F.filter("_lines", lambda l: F.rlike(l["c"], F.lit(pattern))))
    has = lambda pattern: F.exists("_lines", lambda l: F.rlike(l["c"], F.lit(pattern)))
    return rows.select(
        *_keys(key), F.size("_raw").alias("n_lines"), count(r"\bplot\w*\s*\(").alias("n_plots"), count(r"\binput(\.\w+)?\s*\(").alias("n_inputs"), count(r"^\s*(var|varip)\s").alias("n_vars"),
        F.size(F.filter("_raw", lambda l: F.rlike(l, F.lit(r"^\s*//")))).alias("n_comments"), has(r"\brequest\.").alias("has_request"),
        F.when(has(r"\bstrategy\s*\("), "strategy").when(has(r"\blibrary\s*\("), "library").when(has(r"\b(indicator|study)\s*\("), "indicator").otherwise("unknown").alias("script_type"),
    )
