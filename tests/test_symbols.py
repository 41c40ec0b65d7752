"""Symbol keys, reference keys and instants against plain cases."""

from pyspark.sql import functions as F

from glyphmill.functions import symbols as Y


def each(spark, expr, *rows):
    """expr over rows of one or more texts, in order."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.x for r in df.select("i", expr(*[F.col(n) for n in names]).alias("x")).orderBy("i").collect()]


def symbols(spark, *rows):
    return [(s.sym_name, s.sym_category) for s in each(spark, Y.symbol_struct, *rows)]


def test_dress_does_not_matter(spark):
    names = ("lib.fooBar", " LIB . foo_bar ", "`lib::Foo-Bar`", "“lib．fooBar”", "lib.\u200bfooBar ()", "lib#foo bar;")
    pairs = [(n, c) for n in names for c in ("function", "(Function)", "\tfunction", "FUNCTION:", "[function]")]
    assert set(symbols(spark, *pairs, *[(c, n) for n, c in pairs])) == {("libfoobar", "function")}


def test_near_names_differ(spark):
    assert len(set(symbols(spark, ("lib.foo2", "function"), ("lib.foo", "function"), ("lib.foo", "type"), ("lib.foos", "type")))) == 4


def test_operators_keep_their_signs(spark):
    got = symbols(spark, (" ` == ` ", "Operator."), ('"!="', "operator"), ("operator", "[]"), ("operator", '"?:" '))
    assert got == [("==", "operator"), ("!=", "operator"), ("[]", "operator"), ("?:", "operator")]


def test_rows_without_a_name(spark):
    got = symbols(spark, *[(n, "function") for n in (None, "", " \t", "\u200b")], ("lib.foo", None))
    assert got == [(None, "function")] * 4 + [("libfoo", None)]


def test_references(spark):
    got = each(spark, Y.reference_key, "#fun_lib.foo", "an_@foo", " lib .foo\n", "function_x", None, "", "  ", "https://a.example/b#c", "www.a.example")
    assert got == ["libfoo", "foo", "libfoo", "functionx"] + [None] * 5


def test_instants(spark):
    got = each(
        spark, lambda c: F.unix_micros(Y.utc_instant(c)), "2025-03-05T20:17:02Z", "2025-03-05T15:17:02-05:00", "2025-03-05 20:17:02", "2025-03-05T20:17:02.000000+00:00", " 2025-03-05T22:17:02+02:00 ",
        None, "", " ", "soon", "20:17:02", "T20:17:02Z",
    )
    assert len(set(got[:5])) == 1 and got[0] is not None and got[5:] == [None] * 6


def test_month_is_utc(spark):
    assert each(spark, lambda c: Y.month_text(Y.utc_month(Y.utc_instant(c))), "2025-01-01T00:30:00+02:00", "2024-12-31T22:30:00-05:00") == ["2024-12", "2025-01"]


def test_source_codes(spark):
    assert each(spark, Y.source_code, "live_site", " Live Site", "LIVE-SITE", "live_site ", " ") == ["live_site"] * 4 + [None]
