"""Ordered rewrite chains over code: migration to namespaced calls and targeted repairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.scalar import blank_literals, let

#: Calls that gained a namespace, in the order they are rewritten.
NAMESPACED = {
    "ta": (
        "ema", "sma", "rsi", "macd", "atr", "bb", "stoch", "wma", "hma", "vwap", "crossover", "crossunder", "highest", "lowest", "barssince", "valuewhen",
        "linreg", "mom", "cum", "change", "pivothigh", "pivotlow", "supertrend", "correlation", "percentrank", "dmi", "stdev", "variance", "rising",
        "falling", "alma", "kama", "swma", "percentile_nearest_rank", "percentile_linear_interpolation",
    ),
    "request": ("security",),
    "math": ("abs", "round", "floor", "ceil", "pow", "sqrt", "log", "exp", "sin", "cos", "tan", "asin", "acos", "atan", "sign", "min", "max", "avg"),
    "str": ("tostring", "tonumber"),
}
#: Names that are values too and are rewritten without a call.
VALUES = ("vwap",)


def _calls(names: tuple[str, ...] | list[str]) -> str:
    return rf"(?<!\.)\b({'|'.join(names)})\s*\("


def _prefixed(x: Column, space: str, calls: str) -> Column:
    """``x`` (code, blank) with the calls of one namespace prefixed where they stand bare outside literals."""
    found = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(calls), F.lit(1)))

    def given(y: Column) -> Column:
        some = F.concat(F.lit(r"(?<!\.)\b("), F.array_join(y["outside"], "|"), F.lit(r")\s*\("))
        every = F.size(F.array_except(y["inside"], y["outside"])) == 0
        own = F.regexp_replace(y["code"], some, F.lit(rf"{space}.$1("))
        code = F.when(F.size(y["outside"]) == 0, y["code"]).when(every, F.regexp_replace(y["code"], calls, rf"{space}.$1(")).otherwise(own)
        return F.struct(code.alias("code"), y["blank"].alias("blank"))

    return let(F.struct(x["code"].alias("code"), x["blank"].alias("blank"), found(x["blank"]).alias("outside"), found(x["code"]).alias("inside")), given)


def _valued(x: Column, space: str, name: str) -> Column:
    value = rf"(?<!\.)\b{name}\b"
    return F.struct(F.when(x["blank"].rlike(value), F.regexp_replace(x["code"], value, f"{space}.{name}")).otherwise(x["code"]).alias("code"), x["blank"].alias("blank"))


def migrate(code: Column) -> Column:
    """Code with every bare call of NAMESPACED prefixed; a name behind a dot is left alone.

    A rule applies only where it matches outside string literals, but then to the whole text. One alternation per
    namespace does the work of its rules: they have distinct names, so their order does not matter, and what stands bare
    does not change by prefixes given to others. A pattern of its own is formed only for a code that has a name in
    literals alone; all others share constant ones.
    """
    step = F.struct(code.alias("code"), blank_literals(code).alias("blank"))
    for space, names in NAMESPACED.items():
        step = let(step, lambda x: _prefixed(x, space, _calls([n for n in names if n not in VALUES])))  # noqa: B023
        for name in names:
            if name in VALUES:
                step = let(step, lambda x: _valued(x, space, name))  # noqa: B023
    return step["code"]


#: The repairs and what each says it did; a condition with an index backtracks as listed. BARE are
#: the calls that a repair prefixes; a migration prefixes all.
BARE = NAMESPACED["ta"][:24]
REPAIRS = (
    (r",\s*transp\s*=\s*\d+", "", "transp"),
    (r"\bif\s+(volume|close|open|high|low)(\[\d+\])?\b(?!\s*[<>=!])", "if $1$2 > 0", "implicit_bool"),
    (r"\bbool\s+(\w+)\s*=\s*na\b", "var bool $1 = false", "bool_na"),
)
PREFIX = (_calls(BARE), "ta.$1(", "prefix")
STUDY = (r"\bstudy\s*\(", "indicator(", "study")


def _repaired(step: Column, rules: tuple) -> Column:
    """struct(code, fixes) after the rules, each gated on a match outside string literals."""
    for pattern, replacement, name in rules:
        mended = lambda x: F.struct(F.regexp_replace(x["code"], pattern, replacement).alias("code"), F.array_append(x["fixes"], F.lit(name)).alias("fixes"))  # noqa: B023, E731
        step = let(step, lambda x: F.when(blank_literals(x["code"]).rlike(pattern), mended(x)).otherwise(x))  # noqa: B023
    return step


def _unmended(code: Column) -> Column:
    return F.struct(code.alias("code"), F.array().cast("array<string>").alias("fixes"))


def repair(code: Column) -> Column:
    """struct(code, fixes): the targeted repairs, each gated on a match outside string literals."""
    return _repaired(_unmended(code), REPAIRS)


def repair_calls(code: Column) -> Column:
    """struct(code, fixes): bare calls prefixed, then the targeted repairs; a strategy without a declaration is told, not mended."""
    step = _repaired(_repaired(_unmended(code), (PREFIX, REPAIRS[0])), REPAIRS[1:])
    return let(step, lambda x: F.struct(x["code"].alias("code"), F.when(x["code"].contains("strategy.entry") & ~x["code"].contains("strategy("), F.array_append(x["fixes"], F.lit("declaration"))).otherwise(x["fixes"]).alias("fixes")))


def modernize(code: Column) -> Column:
    """struct(code, fixes): the repairs of a migration in its own order, the renamed study call, then ``migrate``."""
    step = _repaired(_unmended(code), (REPAIRS[0], REPAIRS[2], REPAIRS[1], STUDY))
    return let(step, lambda x: F.struct(migrate(x["code"]).alias("code"), x["fixes"].alias("fixes")))


def _argument_end(text: str, start: int) -> int:
    depth = 0
    for i in range(start, len(text)):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            if depth == 0:
                return i
            depth -= 1
        elif text[i] == "," and depth == 0:
            return i
    return len(text)


def drop_when(code: str) -> str:
    """Code without the ``when`` argument of strategy calls; one inside a nested call stays. A call never closed is left alone."""
    cuts = []
    for call in re.finditer(r"strategy\.(?:entry|exit|close)\s*\(", code):
        end, at, depth = -1, call.end(), 0
        found = None
        while at < len(code):
            ch = code[at]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    end = at
                    break
                depth -= 1
            elif ch == "," and depth == 0 and found is None and (m := re.match(r",\s*when\s*=", code[at:])):
                found = (at, _argument_end(code, at + m.end()))
            at += 1
        if end >= 0 and found:
            cuts.append(found)
    for a, b in reversed(cuts):
        code = code[:a] + code[b:]
    return code


def drop_when_argument(code: Column) -> Column:
    """``drop_when`` as a column: balanced parentheses are beyond regular expressions, so Arrow batches go to Python.

    Null stays null.
    """

    @F.pandas_udf("string")
    def dropped(codes: pd.Series) -> pd.Series:
        return codes.map(drop_when, na_action="ignore")

    return dropped(code)
