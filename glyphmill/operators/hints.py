"""Texts against a table of patterns: the first and the longest pattern that a text contains, and the hint of it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern table is small by nature; more patterns than this are refused. Each regular expression holds a part of them.
MAX_PATTERNS = 100_000
PART = 1_000


def pattern_list(patterns: DataFrame, order: str, pattern: str) -> list[tuple[int, str]]:
    """(order, pattern in lower case) of the bounded pattern table, blank patterns left out."""
    rows = patterns.select(F.col(order).cast("bigint").alias("o"), F.lower(pattern).alias("p")).filter("o is not null and p != ''").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    return sorted((r.o, r.p) for r in rows)


def _either(texts: list[str], depth: int = 2) -> str:
    """An expression for any of the texts, the longest first, with common beginnings shared."""
    if depth == 0 or len(texts) < 3:
        return "|".join(re.escape(t) for t in sorted(texts, key=len, reverse=True))
    heads: dict[str, list[str]] = {}
    for text in texts:
        heads.setdefault(text[:1], []).append(text[1:])
    last = heads.pop("", None)  # the text that ends here is the shortest
    parts = [f"{re.escape(h)}(?:{_either(rest, depth - 1)})" for h, rest in heads.items()]
    return "|".join([*parts, *([""] if last else [])])


def match_patterns(texts: DataFrame, key: str, text: str, patterns: list[tuple[int, str]]) -> DataFrame:
    """(key, first_match, longest_match): orders of the first pattern a text contains, and of the longest (ties: first).

    Case does not matter. One expression finds the longest pattern at every place of a text, overlaps included; patterns
    that begin another one are found with it, so their orders are known beforehand. Built-in functions alone, no shuffle.
    Texts without a match, null and empty texts give no row.
    """
    orders: dict[str, int] = {}
    for order, pattern in patterns:
        orders[pattern] = min(order, orders.get(pattern, order))
    told = {p: min(orders[p[:n]] for n in range(1, len(p) + 1) if p[:n] in orders) for p in orders}
    if not told:
        return texts.select(key, F.lit(None).cast("bigint").alias("first_match"), F.lit(None).cast("bigint").alias("longest_match")).limit(0)
    names = sorted(told)
    lower, best = F.lower(F.col(text)), []
    for at in range(0, len(names), PART):
        some = names[at : at + PART]
        table = F.from_json(F.lit(json.dumps({p: {"first": told[p], "size": -len(p), "own": orders[p]} for p in some})), "map<string,struct<first:bigint,size:int,own:bigint>>")
        found = F.array_distinct(F.regexp_extract_all(lower, F.lit(f"(?=({_either(some)}))"), F.lit(1)))
        best.append(F.transform(found, lambda p: table[p]))  # noqa: B023
    hits = texts.select(key, F.concat(*best).alias("_hits")).filter(F.size("_hits") > 0)
    longest = F.array_min(F.transform("_hits", lambda h: F.struct(h["size"].alias("size"), h["own"].alias("own"))))
    return hits.select(key, F.array_min(F.transform("_hits", lambda h: h["first"])).alias("first_match"), longest["own"].alias("longest_match"))


def filled(hint: Column, text: Column) -> Column:
    """A hint with ``{name}`` as the first identifier in single quotes of the text, ``value`` without one."""
    quoted = F.regexp_extract(text, r"'([a-zA-Z_][a-zA-Z0-9_.]*)'", 1)
    return F.replace(hint, F.lit("{name}"), F.when(quoted != "", quoted).otherwise("value"))
