"""Diagnostics and rewriting: one violating code per rule, clean codes, literals and comments, and random code."""

import random
import re

from pyspark.sql import functions as F

from glyphmill.functions import scalar as S
from glyphmill.operators import lint, rewrite

HEAD = "//@version=6\n"
CASES = [
    ("clean", HEAD + 'indicator("x")\nfloat a = ta.ema(close, 5)\na := a + 1\nplot(a)\n', []),
    ("no header", "plot(close)", [(1, "LOCAL_VERSION")]),
    ("old header", "\n//@version=5\nplot(close)", [(2, "LOCAL_VERSION")]),
    ("study", HEAD + 'study("a")\nstudy("b")', [(2, "LOCAL_V5_STUDY")]),
    ("colors", HEAD + "plot(close, color=red)\nbgcolor(blue)\nplot(close, color=color.red)", [(2, "LOCAL_V4_COLOR"), (3, "LOCAL_V4_COLOR")]),
    ("closing", HEAD + "a = (1))\nb = ((2)\nc = 1]", [(2, "CE10016"), (4, "CE10015"), (4, "LOCAL_BRACKET")]),
    ("reset", HEAD + "a = 1))(", [(2, "CE10016"), (2, "CE10016"), (2, "CE10015")]),
    ("open bracket", HEAD + "a = b[1\n", [(2, "LOCAL_BRACKET")]),
    ("reassign", HEAD + "x := 1\nx = 2\nx := 3\nvar float y = 1\ny := 2", [(2, "LOCAL_REASSIGN")]),
    ("na", HEAD + "a = x == na\nb = na != y", [(2, "LOCAL_NA_CMP"), (3, "")]),
    ("warnings", HEAD + "a = array.get(b, 1)\nvarip c = 5\nvarip d = input(5)\nplot(a, transp = 50)", [(2, ""), (3, ""), (5, "")]),
    ("strategy", HEAD + 'strategy.entry("a", 1)', [(0, "")]),
    ("strategy declared", HEAD + 'strategy("s")\nstrategy.entry("a", 1)', []),
    ("bare", HEAD + "a = sma(close, 1) + ema(close, 2)\nb = ta.ema(close, 2)\nc = my.rsi(1)", [(2, "")]),
    ("hidden", HEAD + 'a = "study(red) == na ))"\n// ema(1) x := 2 ]\nb = \'rsi(\'', []),
    ("over lines", HEAD + 'a = "one\nstudy(two)"\nb = c == na', [(3, "LOCAL_NA_CMP")]),  # the blanked literal is one line
    ("apostrophes", HEAD + "// don't\nx = y == na // isn't\nz = y == na", [(3, "LOCAL_NA_CMP")]),
    ("empty", "", []),
    ("null", None, []),
]


def test_lint_rules(spark):
    df = spark.createDataFrame([(i, c) for i, (_, c, _) in enumerate(CASES)], "doc_id bigint, code string").withColumn("line_no", F.lit("clash"))
    got = {}
    for r in lint.lint(df).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.code))
    for i, (name, _, expected) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted(expected), name
    assert lint.lint(df.limit(0)).count() == 0


def test_lint_names_the_first_of_several(spark):
    df = spark.createDataFrame([(1, HEAD + "a = sma(close, 1) + ema(close, 2)")], "doc_id bigint, code string")
    assert [r.text for r in lint.lint(df).collect()] == ["ema() is now called ta.ema()"]


def test_code_summary(spark):
    df = spark.createDataFrame([(1, HEAD + 'strategy("s")\nvar a = input.int(1)\nplot(a)\nplotshape(a)\n// plot(b)\n'), (2, "x = 1")], "doc_id bigint, code string")
    got = {r.doc_id: r for r in lint.code_summary(df).collect()}
    assert (got[1].n_lines, got[1].n_plots, got[1].n_inputs, got[1].n_vars, got[1].n_comments, got[1].script_type) == (6, 2, 1, 1, 2, "strategy")
    assert got[2].script_type == "unknown"


def migrated(code):
    blank = lambda c: re.sub(r"'(?:[^'\\]|\\.)*'", "''", re.sub(r'"(?:[^"\\]|\\.)*"', '""', c))
    for space, names in rewrite.NAMESPACED.items():
        for name in names:
            pattern = rf"(?<!\.)\b{name}\b" if name in rewrite.VALUES else rf"(?<!\.)\b{name}\s*\("
            if re.search(pattern, blank(code)):
                code = re.sub(pattern, f"{space}.{name}" + ("" if name in rewrite.VALUES else "("), code)
    return code


def test_migration_against_one_rule_at_a_time(spark):
    rng = random.Random(6)
    names = ["ema", "sma", "vwap", "security", "abs", "max", "tostring", "foo", "ta.ema", "x.max", "myema", "log10"]
    codes = ["".join(rng.choice(names) + rng.choice(["(", " (", " + ", '("ema(1)", ', "'max('"]) + rng.choice(["close, ", "1)", ") "]) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    codes += ["ema(ema(x))", "ta.ema(x)", 's = "ema(x)"', 'ema(x) + "ema(y)"', "", "close[1]", "log10(x)"]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, code string")
    got = {r.i: r.m for r in df.select("i", rewrite.migrate(F.col("code")).alias("m")).collect()}
    assert got == {i: migrated(c) for i, c in enumerate(codes)}


def test_repairs(spark):
    cases = {
        "plot(a, color=b, transp = 50)": ("plot(a, color=b)", ["transp"]), "if volume": ("if volume > 0", ["implicit_bool"]), "if close[1]": ("if close > 0[1]", ["implicit_bool"]), "if close > 1": ("if close > 1", []),
        "bool x = na": ("var bool x = false", ["bool_na"]), 'a = ", transp=1"': ('a = ", transp=1"', []), "": ("", []),
    }
    df = spark.createDataFrame([(c,) for c in cases], "code string")
    assert {r.code: (r.r.code, r.r.fixes) for r in df.select("code", rewrite.repair(F.col("code")).alias("r")).collect()} == cases


def test_repairs_of_calls_and_migrations(spark):
    cases = {
        "x = ema(sma(a, 1), 2)": ("x = ta.ema(ta.sma(a, 1), 2)", ["prefix"]), 'strategy.entry("a", transp=1)': ('strategy.entry("a")', ["transp", "declaration"]), 'strategy("s")\nstrategy.entry("a")': ('strategy("s")\nstrategy.entry("a")', []),
        "alma(a)": ("alma(a)", []), 's = "ema(1)"': ('s = "ema(1)"', []), None: (None, []),
    }
    df = spark.createDataFrame([(c,) for c in cases], "code string")
    got = {r.code: (r.r.code, r.r.fixes) for r in df.select("code", rewrite.repair_calls(F.col("code")).alias("r")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in cases.items() if k is not None}
    df = spark.createDataFrame([('study("a")\nbool b = na\nif close\n    x = rsi(abs(y), 3)',), ("indicator(1)",)], "code string")
    assert [tuple(r.r) for r in df.select(rewrite.modernize(F.col("code")).alias("r")).collect()] == [
        ('indicator("a")\nvar bool b = false\nif close > 0\n    x = ta.rsi(math.abs(y), 3)', ["bool_na", "implicit_bool", "study"]), ("indicator(1)", []),
    ]


def test_migration_names_its_input_once(spark):
    """The plan does not grow with the number of rules: the code is read a bounded number of times."""
    plan = spark.range(1).select(F.lit("ema(1)").alias("code")).select(rewrite.migrate(F.col("code")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("code#") < 40 and plan.count("regexp_replace") < 20


def test_blanking_keeps_every_place(spark):
    cases = {'a "b\\"c" d': 'a "    " d', "x 'y' z": "x ' ' z", '"" \'\'': '"" \'\'', 'open " end': 'open " end', '"it\'s" + \'"\'': '"    " + \' \'', '"a\nb"c': '"   "c', "": ""}
    df = spark.createDataFrame([(c,) for c in cases], "code string")
    got = {r.code: r.b for r in df.select("code", S.blank_literals(F.col("code")).alias("b")).collect()}
    assert all(len(k) == len(v) for k, v in got.items())
    for k, v in cases.items():
        if k != '"it\'s" + \'"\'':
            assert got[k] == v, k
    long = spark.range(1).select(S.blank_literals(F.concat(F.lit('"'), F.repeat(F.lit("\\\\x"), 100_000), F.lit('" + ema(1)')))).first()[0]
    assert long.endswith('" + ema(1)') and "x" not in long[:-10]


def test_input_lines(spark):
    cases = {
        "length": 'int length = input.int(20, "length")', "Source": 'Source = input.source(close, "Source")', "hl2": 'hl2 = input.source(hl2, "hl2")', "mult": 'float mult = input.float(2.0, "mult")', "lineColor": 'lineColor = input.color(color.blue, "lineColor")',
        "show it": 'bool show_it = input.bool(true, "show it")', "q": 'float q = input.float(1.0, "q")', "a = 5": 'int a = input.int(5, "a")', "a=1.5": 'float a = input.float(1.5, "a")', "b = TRUE": 'bool b = input.bool(true, "b")', 's = "x=y"': 'string s = input.string("x=y", "s")',
        "src = close": 'src = input.source(close, "src")', "9z = abc": 'float _9z = input.float(abc, "9z")',
    }
    df = spark.createDataFrame([(c,) for c in cases], "asked string")
    assert {r.asked: r.line for r in df.select("asked", S.input_line(F.col("asked")).alias("line")).collect()} == cases


def test_drop_when(spark):
    cases = {
        'strategy.entry("a", strategy.long, when = f(x, (y)), qty=1)': 'strategy.entry("a", strategy.long, qty=1)',
        "strategy.close(calc(a, when=true), b)": "strategy.close(calc(a, when=true), b)",
        "strategy.exit(a, when=b)\nstrategy.exit(c, when=d)": "strategy.exit(a)\nstrategy.exit(c)",
        "strategy.exit(a, when=b": "strategy.exit(a, when=b", "other(a, when=b)": "other(a, when=b)", "": "", None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "code string")
    assert {r.code: r.x for r in df.select("code", rewrite.drop_when_argument(F.col("code")).alias("x")).collect()} == cases


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


def test_scalars(spark):
    c = F.col
    rows = [
        (S.bare_name(F.lit(" ta.ema() ")), "ta.ema"), (S.bare_name(F.lit("f)()(")), "f"), (S.namespace_key(F.lit(" TA.. ")), "ta"), (S.base_name(F.lit(" `A b`() ")), "ab"), (S.merge_key(F.lit("X()"), F.lit("type")), "x__type"),
        (S.merge_key(F.lit("X()"), F.lit(None).cast("string")), "x"), (S.fragment_category(F.lit("op_+")), "operator"), (S.fragment_category(F.lit("zz_a")), "unknown"), (S.namespace_of(F.lit(" `ta.ema()` ")), "ta"), (S.namespace_of(F.lit(".x")), None), (S.namespace_of(F.lit("plot")), None),
        (S.return_type(F.lit("f(x) → a → b")), "a → b"), (S.return_type(F.lit("f(x) ->  series float ")), "series float"), (S.return_type(F.lit(None).cast("string")), ""), (S.header_name(F.lit("ta.sma(a, b)")), "ta.sma"), (S.header_name(F.lit("array<int>")), "array"), (S.header_name(F.lit("(x)")), "(x)"),
        (S.sanitize_text(F.lit(" a\x00b\x07\tc\n ")), "ab\tc"), (S.sanitize_literal(F.lit('say "a\\b"')), "say 'a/b'"), (S.sanitize_literal(F.lit(" \x01 ")), "Script"), (S.identifier(F.lit("1 a-b")), "_1_a_b"), (S.identifier(F.lit("--")), "param"),
        (S.redact_paths(F.lit("no /usr/lib/x.py here")), "no [path]"), (S.error_name(F.lit("Undeclared identifier 'ta.x'")), "ta.x"), (S.error_name(F.lit("Cannot call foo.bar now")), "foo.bar"), (S.error_name(F.lit("nothing")), None),
        (S.relevance(F.lit(0.375)), 62), (S.relevance(F.lit(1.5)), 0), (F.substring(S.describe_code(F.lit("CE10016")), 1, 6), "syntax"), (S.describe_code(F.lit("CE1")), ""),
        (S.query_words(F.lit("How to plot the RSI and the MACD line")), ["rsi", "macd", "line"]), (S.bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), ["a b", "b c"]), (S.bigrams(F.array().cast("array<string>")), []),
        (S.return_type_matches(F.lit("int"), F.lit("series int")), True), (S.return_type_matches(F.lit("int"), F.lit("point")), False), (S.return_type_matches(F.lit("series float"), F.lit("float")), True),
        (S.is_function_like(F.lit("a()"), F.lit(None).cast("string")), True), (S.is_function_like(F.lit("a"), F.lit("")), False),
    ]
    got = spark.range(1).select(*[e.alias(f"c{i}") for i, (e, _) in enumerate(rows)]).first()
    for i, (_, expected) in enumerate(rows):
        assert got[i] == expected, (i, got[i], expected)
    p = one(spark, S.parse_parameter(c("line")), line=" src (series float, const) Optional. The source. Default is close. ")
    assert (p.name, p.type, p.optional, p.default) == ("src", "series float, const", True, "close")
    assert one(spark, S.parse_parameter(c("line")), line="no parameter") is None
