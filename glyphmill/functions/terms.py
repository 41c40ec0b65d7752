"""Tables of terms matched against text: query aliases, indicator families, input names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a query may say, and the names it then means too.
ALIASES = (
    (r"\bmacd\b|\bmoving\s+average\s+convergence", ("ta.macd",)),
    (r"\brsi\b|\brelative\s+strength", ("ta.rsi",)),
    (r"\bbollinger", ("ta.bb",)),
    (r"\bsuper\s*trend", ("ta.supertrend",)),
    (r"\bnot\s+(a\s+)?number\b", ("na", "nz")),
    (r"\bnot\s+available\b", ("na", "nz")),
    (r"\bcurrent\s+timeframe\b|\bchart\s+timeframe\b", ("timeframe.period",)),
    (r"\bcurrent\s+(bar|candle)?\s*close\s*price\b", ("close",)),
    (r"\bcurrent\s+(bar\s+)?price\b", ("close", "open")),
    (r"\breplace\s+(with\s+)?(default|null|zero|na)\b", ("nz", "na")),
    (r"\bprice\s+level\b|\bhorizontal\s+line\b", ("hline",)),
    (r"\bdetect\s+(a\s+)?new\s+bar\b", ("barstate.isnew",)),
    (r"\bcurrent\s+symbol\b|\bsymbol\s+name\b", ("syminfo.ticker",)),
    (r"\barray\s+(is\s+)?empty\b", ("array.size",)),
    (r"\bbar\s+(is\s+)?confirmed\b", ("barstate.isconfirmed",)),
    (r"\bmarket\s+(is\s+)?open\b", ("session.ismarket", "syminfo.isintraday")),
)

#: Indicator families and how a description names them, in order.
FAMILIES = (
    ("bollinger", r"\bbollinger\b|\bbb\b(?!\s*=)"), ("supertrend", r"\bsupertrend\b|\bsuper.?trend\b"), ("stochastic", r"\bstochastic\b|\bstoch\b"), ("rsi", r"\brelative\s+strength\b|\brsi\b"),
    ("ema", r"\bexponential\s+moving\s+average\b|\bema\b"), ("sma", r"\bsimple\s+moving\s+average\b|\bsma\b"), ("atr", r"\baverage\s+true\s+range\b|\batr\b"), ("vwap", r"\bvolume\s+weighted\s+average\b|\bvwap\b"),
    ("adl", r"\baccumulation\s+distribution\b|\badl\b|\baccdist\b"), ("obv", r"\bon\s+balance\s+volume\b|\bobv\b"), ("cci", r"\bcommodity\s+channel\b|\bcci\b"), ("mfi", r"\bmoney\s+flow\s+index\b|\bmfi\b"),
    ("williams", r"\bwilliams\s*%?\s*r\b|\bwpr\b"), ("macd", r"\bmacd\b|\bmoving\s+average\s+convergence\s+divergence\b"), ("dmi", r"\bdirectional\s+movement\b|\bdmi\b|\badx\b"), ("ichimoku", r"\bichimoku\b|\bcloud\b"),
    ("sar", r"\bparabolic\s+sar\b|\bstop\s+and\s+reverse\b|\bsar\b"), ("keltner", r"\bkeltner\b|\bkc\b"), ("donchian", r"\bdonchian\b|\bchannel\b(?!.*cci)"), ("aroon", r"\baroon\b"), ("cmf", r"\bchaikin\s+money\s+flow\b|\bcmf\b"),
    ("tema", r"\btriple\s+exponential\b|\btema\b"), ("dema", r"\bdouble\s+exponential\b|\bdema\b"),
)


def aliases(query: Column) -> Column:
    """Names that a query means by its aliases, in order, each once; empty for null."""
    hits = [F.when(query.rlike(f"(?i){pattern}"), F.array(*[F.lit(n) for n in names])) for pattern, names in ALIASES]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*hits))))


def families(description: Column) -> Column:
    """Indicator families that a description names, in order; empty for null."""
    text = F.lower(description)
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in FAMILIES]))


def parameter_for(variable: Column, parameters: Column) -> Column:
    """The parameter an input variable means: equal, else an ending, else a beginning, else contained; the first of its kind.

    All but equality need three letters; null where none fits.
    """
    v = F.lower(variable)

    def tier(p: Column) -> Column:
        name = F.lower(p)
        return F.when(name == v, 1).when(F.length(name) < 3, None).when(F.endswith(v, name), 2).when(F.startswith(v, name), 3).when(F.contains(v, name) | F.contains(name, v), 4)

    ranked = F.transform(parameters, lambda p, i: F.struct(tier(p).alias("tier"), i.alias("at"), p.alias("name")))
    return F.array_min(F.filter(ranked, lambda r: r["tier"].isNotNull()))["name"]
