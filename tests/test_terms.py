"""Aliases, families, parameters of inputs, first and longest patterns."""

from pyspark.sql import functions as F

from glyphmill.functions import terms
from glyphmill.operators import hints


def test_terms(spark):
    df = spark.createDataFrame([(1, "How does MACD with Bollinger bands work when not available"), (2, "nothing"), (3, None), (4, "relative strength and RSI, not a number")], "i int, q string")
    got = {r.i: r.a for r in df.select("i", terms.aliases(F.col("q")).alias("a")).collect()}
    assert got == {1: ["ta.macd", "ta.bb", "na", "nz"], 2: [], 3: [], 4: ["ta.rsi", "na", "nz"]}
    df = spark.createDataFrame([(1, "RSI of the Exponential Moving Average"), (2, "Channel, later CCI"), (3, "price channel"), (4, None), (5, "bb = 1")], "i int, q string")
    got = {r.i: r.f for r in df.select("i", terms.families(F.col("q")).alias("f")).collect()}
    assert got == {1: ["rsi", "ema"], 2: ["cci"], 3: ["donchian"], 4: [], 5: []}


def test_parameter_for(spark):
    cases = [("length", ["source", "Length"], "Length"), ("rsiLength", ["len", "length"], "length"), ("srcClose", ["x", "src"], "src"), ("fastlen2", ["length", "len"], "len"), ("ab", ["abc", "a"], "abc"), ("zz", ["source"], None), ("x", [], None), (None, ["a"], None)]
    df = spark.createDataFrame([(i, v, p) for i, (v, p, _) in enumerate(cases)], "i int, v string, p array<string>")
    got = {r.i: r.x for r in df.select("i", terms.parameter_for(F.col("v"), F.col("p")).alias("x")).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(cases)}


def test_first_and_longest_pattern(spark):
    patterns = spark.createDataFrame([(1, "Cannot call"), (2, "cannot"), (3, "Cannot call 'na'"), (4, ""), (5, None), (6, "CANNOT")], "ord int, pattern string")
    texts = spark.createDataFrame([(1, "Error: cannot call 'NA' here"), (2, "I CANNOT"), (3, "fine"), (4, None), (5, "")], "i bigint, text string").withColumn("m", F.lit("clash"))
    table = hints.pattern_list(patterns, "ord", "pattern")
    assert sorted(tuple(r) for r in hints.match_patterns(texts, "i", "text", table).collect()) == [(1, 1, 3), (2, 2, 2)]
    assert hints.match_patterns(texts, "i", "text", []).count() == 0


def test_patterns_against_brute_force(spark):
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("aabc.(") for _ in range(rng.randint(1, n)))
    patterns = [(i, word(6)) for i in range(60)]
    texts = [word(40) for _ in range(300)]
    got = {r.i: (r.first_match, r.longest_match) for r in hints.match_patterns(spark.createDataFrame(list(enumerate(texts)), "i bigint, text string"), "i", "text", patterns).collect()}
    expected = {}
    for i, text in enumerate(texts):
        hits = [(o, p) for o, p in patterns if p in text]
        if hits:
            expected[i] = (min(hits)[0], min((-len(p), o) for o, p in hits)[1])
    assert got == expected
    many = [(i, f"p{i}x") for i in range(hints.PART + 3)]  # more than one expression holds
    assert [tuple(r) for r in hints.match_patterns(spark.createDataFrame([(1, "a P1002X p7x")], "i bigint, text string"), "i", "text", many).collect()] == [(1, 7, 1002)]


def test_hints_are_filled(spark):
    rows = [("use {name}({name})", "no 'ta.ema' here, nor 'x'"), ("use {name}", "no name"), ("plain", "'a'")]
    df = spark.createDataFrame(rows, "hint string, text string")
    assert [r[0] for r in df.select(hints.filled(F.col("hint"), F.col("text"))).collect()] == ["use ta.ema(ta.ema)", "use value", "plain"]
