"""Rendering of flat records and capped texts."""

from pyspark.sql import functions as F

from glyphmill.functions import render
from glyphmill.operators.lookup import CATEGORY_ORDER

FLAT = (
    "name string, category string, namespace string, syntax string, returns string, remarks string, raw_description string, raw_parameters string, param_count int, raw_type_fields string, raw_examples string, example_count int, raw_see_also string, document string"
)


def flat(spark, **values):
    columns = [c.split(" ")[0] for c in FLAT.split(", ")]
    return spark.createDataFrame([tuple(values.get(c) for c in columns)], FLAT)


def test_entry_detail(spark):
    row = dict(
        name="ema", category="function", namespace="ta", syntax="ta.ema(a, n)", returns="float", remarks=" one \n\ntwo", raw_description="Smooths.\n\n  Well. ", document="x" * 20, raw_see_also="ta.sma",
        raw_parameters='[{"name": "a", "type": "int", "description": "the a", "optional": true, "default": 3}, {"type": "", "optional": false}]', raw_type_fields='[{"name": "f", "type": "int"}]', raw_examples="a = 1\nb |||  ||| A=1\tb\n ||| c ||| d ||| e",
    )
    df = flat(spark, **row)
    assert df.select(render.entry_detail(F.lit(0.25))).first()[0].split("\n") == [
        "FUNCTION: ta.ema (Relevance: 75%)", "SYNTAX: ta.ema(a, n)", "DESCRIPTION:", "Smooths.", "Well.", "PARAMETERS (2):", "  a (int) [optional] = 3", "    the a", "  ?", "RETURNS: float", "REMARKS:", "one", "two", "FIELDS:", "  f (int)",
        "EXAMPLES (3):", "--- Example 1 ---", "a = 1", "b", "--- Example 2 ---", "c", "--- Example 3 ---", "d", "SEE ALSO: ta.sma",
    ]
    bare = flat(spark, name="x", category="type", document=" short ")
    assert bare.select(render.entry_detail()).first()[0] == "'x' was found but has no local documentation."
    counted = flat(spark, name="ta.x", category=None, namespace="ta", document="long enough", param_count=2, example_count=4, raw_parameters="", raw_type_fields="{broken")
    assert counted.select(render.entry_detail()).first()[0].split("\n") == ["?: ta.x", "DESCRIPTION:", "long enough", "PARAMETERS: 2 parameters", "EXAMPLES: 4 examples available"]
    for bad in ("{}", "[1", '{"name": "a"}', "[]"):
        assert "PARAMETERS" not in flat(spark, name="x", document="long enough", raw_parameters=bad, param_count=3).select(render.entry_detail()).first()[0]


def test_capped(spark):
    cases = {
        "short": ("short", 10), "exact": ("exactly ten"[:10], 10), "fence": ("```py\ncode and more", 8), "closed": ("```\nx\n```\nmore text", 12), "inner": ("```\n```py\n``` x\nmore and more", 18), "null": (None, 5), "empty": ("", 5),
    }
    got = {k: spark.createDataFrame([(t,)], "t string").select(render.capped(F.col("t"), n)).first()[0] for k, (t, n) in cases.items()}
    assert got["short"] == "short" and got["exact"] == "exactly te" and got["null"] is None and got["empty"] == ""
    assert got["fence"] == "```py\nco\n```\n\n[...truncated - 7 chars omitted]"
    assert got["closed"] == "```\nx\n```\nmo\n\n[...truncated - 7 chars omitted]"
    assert "\n```\n\n[" not in got["inner"]
    long = spark.range(1).select(render.capped(F.repeat(F.lit("a"), 2_001_234))).first()[0]
    assert long.endswith("[...truncated - 1,921,234 chars omitted]")


def test_lines(spark):
    df = flat(spark, name="close", category="variable", namespace="", raw_description="Last price. Of the bar.", syntax="close", returns="float")
    lines = df.select(render.listing_line(CATEGORY_ORDER), render.cheatsheet_line(CATEGORY_ORDER)).first()
    assert tuple(lines) == ("  close - Last price", "  close\n    Last price")
    f = flat(spark, name="f", category="function", returns="x" * 50, syntax="s" * 100).select(render.listing_line(CATEGORY_ORDER), render.cheatsheet_line(CATEGORY_ORDER)).first()
    assert tuple(f) == ("  " + "s" * 80 + " -> " + "x" * 30, "  " + "s" * 70 + " -> " + "x" * 25)
    names = spark.createDataFrame([("ta.a", "ta"), ("a", "ta"), ("a", ""), ("a", None)], "n string, s string").select(render.display_name(F.col("n"), F.col("s")))
    assert [r[0] for r in names.collect()] == ["ta.a", "ta.a", "a", "a"]
    assert spark.range(1).select(render.first_paragraph(F.lit("ab cd\n\nx"), 3)).first()[0] == "ab ..."
