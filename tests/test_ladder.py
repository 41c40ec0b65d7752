"""Rungs of the lookup ladder that depend on the asked category, the hot subset and the suggestions."""

from glyphmill.operators import ladder

CATALOG = "row_no bigint, name string, category string, namespace string, syntax string, raw_parameters string, document string"
QUERIES = "query_id bigint, name string, category string"


def catalog(spark):
    return spark.createDataFrame(
        [
            (1, "ta.methods", "function", "ta", "ta.methods()", "", "d"), (2, "ta.methodxy", "type", "ta", "", "", "d"), (3, "hotname", "variable", "hot", "", "", "short"), (4, "hotname", "variable", "hot", "hotname", "", "a longer document"),
            (5, "bare", "variable", "hot", "", "", "d"), (6, "volumes", "type", "m", "", "", "d"),
        ],
        CATALOG,
    )


def test_alike_name_of_the_asked_category_goes_first(spark):
    queries = spark.createDataFrame([(1, "ta.methodx", "type"), (2, "ta.methodsx", "function"), (3, "ta.methodsx", "constant"), (4, "ta.methodsx", None)], QUERIES)
    got = {r.query_id: (r.stage, r.row) for r in ladder.lookup(queries, catalog(spark)).collect()}
    assert got == {1: ("alike", 2), 2: ("alike", 1), 3: ("alike", 1), 4: ("alike", 1)}
    queries = spark.createDataFrame([(5, "ta.methodsx", "type")], QUERIES)  # the better name is of another category
    assert [(r.stage, r.row) for r in ladder.lookup(queries, catalog(spark)).collect()] == [("alike", 2)]


def test_hot_rung(spark):
    queries = spark.createDataFrame([(1, "HotName()", "variable"), (2, "hotname", None), (3, "hotname", "type"), (4, "bare", "variable")], QUERIES)
    got = {r.query_id: (r.stage, r.row) for r in ladder.lookup(queries, catalog(spark), namespaces=["hot"]).collect()}
    assert got == {1: ("hot", 4), 2: ("hot", 4), 3: ("exact", 4), 4: ("exact_in_category", 5)}


def test_suggestions(spark):
    queries = spark.createDataFrame([(1, "ta.mods", "function"), (2, "volu", "keyword"), (3, "qqqqqqqq", "type"), (4, "bare", "type"), (5, " ", "type")], QUERIES)
    got = sorted((r.query_id, r.rank, r.name) for r in ladder.suggestions(queries, catalog(spark)).collect())
    assert [g for g in got if g[0] != 2] == [(1, 1, "ta.methods"), (3, 1, "ta.methodxy"), (3, 2, "volumes")]
    assert [g[2] for g in got if g[0] == 2][0] == "volumes" and len([g for g in got if g[0] == 2]) == 5
