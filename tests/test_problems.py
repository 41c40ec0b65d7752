"""Nested records, orphans and packed fields: small fixtures, dirt, and a brute force over real rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import nested, orphans, packed, skew

ENTRY = (
    "rec_id bigint, name string, category string, overloads array<string>, parameters array<struct<name:string,type:string,description:string,optional:boolean,default:string>>, "
    "type_fields array<struct<name:string,type:string,description:string>>, see_also array<string>, scraped_at string"
)


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def payloads(spark, *texts):
    return spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "land_id bigint, payload string")


def paths(df):
    return sorted((r.row_key, r.child_path) for r in df.select("row_key", "child_path").collect())


def test_payload_shapes(spark):
    p = {"name": "a", "type": "int"}
    got = paths(nested.payload_children(payloads(
        spark,
        {"parameters": [p, None, p]},
        {"Parameters": p, "typeFields": {"x": {}, "y": None, "z": {"type": "int"}}},
        {"success": True, "result": {"overloads": ["f(a)", {"syntax": "f(b)", "parameters": {"q": {"type": "int", "type_fields": [p]}}}]}},
        json.dumps(json.dumps({"type_fields": json.dumps([p])})),
        "{broken", None, "null", "[]", "3", {"parameters": "", "overloads": "[]", "type_fields": {}},
    )))
    assert got == sorted([
        (0, "parameters[0]"), (0, "parameters[2]"), (1, "parameters[0]"), (1, "type_fields[0]"), (1, "type_fields[2]"),
        (2, "overloads[0]"), (2, "overloads[1]"), (2, "overloads[1].parameters[0]"), (2, "overloads[1].parameters[0].type_fields[0]"), (3, "type_fields[0]"),
    ])


def test_identical_objects_are_stored_once(spark):
    deep = {"name": "a", "type_fields": [{"name": "b", "type": "int"}]}
    rows = nested.payload_children(payloads(spark, {"parameters": [deep, {"type_fields": [{"type": "int", "name": "b"}], "name": "a"}]}, {"parameters": [deep]}))
    store = nested.objects(rows)
    assert {(r.child_kind, r.n_occurrences) for r in store.collect()} == {("parameters", 3), ("type_fields", 3)}
    assert nested.expanded(rows, store).count() == rows.count()
    roots = {r.parent_id for r in rows.filter("depth = 1 and row_key = 0").collect()}
    assert len(roots) == 1


def test_entries_and_payloads_share_identities(spark):
    param = ("a", "int", None, None, None)
    e = nested.entry_children(entries(spark, [(1, "n", "c", ["f(a)", None], [None, param], None, None, None)]))
    p = nested.payload_children(payloads(spark, {"parameters": [{"type": "int", "name": "a", "default": None}], "overloads": ["f(a)"]}))
    ids = lambda d: {(r.child_kind, r.object_id) for r in d.collect()}
    assert ids(e) == ids(p)
    assert paths(e) == [(1, "overloads[0]"), (1, "parameters[1]")]


def chain(levels):
    return '{"name":"a","parameters":[' * levels + '"leaf"' + "]}" * levels


@pytest.mark.parametrize("levels", [1_000, 5_000])
def test_children_at_any_depth(spark, levels):
    rows = nested.payload_children(payloads(spark, chain(levels)), roots=True).cache()
    assert rows.filter("depth > 0").count() == levels
    assert rows.agg(F.max("depth"), F.max(F.length("child_path"))).first() == (levels, 14 * levels - 1)
    assert rows.select("object_id").distinct().count() == levels + 1  # each level holds another tree
    assert [tuple(r) for r in nested.unresolved(rows, nested.objects(rows)).collect()] == [("pine_entry_payloads", 0, 0)]
    rows.unpersist()


def test_a_hundred_thousand_levels():
    levels = 100_000
    deepest = next(nested.walk(nested.loads(chain(levels))))
    assert deepest[4] == levels and len(deepest[0]) == 14 * levels - 1
    own = {"name": "a", "default": nested.loads("[" * levels + "]" * levels), "overloads": ["f()"]}
    child, root = nested.walk(own)
    assert child[0] == "overloads[0]" and root[7].count("[") == levels


def test_deep_parser_agrees_with_the_library():
    good = ['{"a": [1, -2.5e3, true, null, "x\\u00e9\\n"], "b": {}, "a": []}', " [ ] ", '"x"', "0", '{"k":{"l":[[],{}]}}', "NaN", '[1,"\\ud83d\\ude00"]']
    for text in good:
        assert repr(nested._deep(text)) == repr(json.loads(text))
    for text in ("", "[", "[1,]", "{1:2}", '{"a":1,}', "[1}", "01", "1 2", "[1]]", '"x', "tru", '{"a" 1}'):
        for parse in (nested._deep, json.loads):
            with pytest.raises(ValueError):
                parse(text)


def test_odd_signs_in_own_members(spark):
    bad = '{"name": "x\\u001f\\ud800y\\\\u001f", "overloads": ["a\\u001f", "\\ud800"]}'
    rows = {r.child_path: r.own_json for r in nested.payload_children(payloads(spark, bad), roots=True).collect()}
    assert rows == {"overloads[0]": '"a\\u001F"', "overloads[1]": '"\\uD800"', "": '{"name":"x\\u001F\\uD800y\\\\u001f"}'}


def test_an_entry_has_one_identity_in_both_tables(spark):
    row = (1, "n\u001f", "c", ["f(a)"], [("a", "int", None, None, None)], None, [], None)
    e = nested.entry_children(entries(spark, [row, (2, row[1], "d", *row[3:])]), roots=True)
    p = nested.payload_children(payloads(spark, {"name": "n\u001f", "category": "c", "see_also": [], "overloads": ["f(a)"], "parameters": [{"type": "int", "name": "a"}], "scraped_at": None}), roots=True)
    roots = lambda d: [r.object_id for r in d.filter("depth = 0").orderBy("row_key").collect()]
    assert roots(e)[0] == roots(p)[0] and roots(e)[0] != roots(e)[1]  # equal children, other own members
    both = e.unionByName(p)
    assert {tuple(r) for r in nested.unresolved(both, nested.objects(both)).collect()} == {("pine_merged_entries", 0, 0), ("pine_entry_payloads", 0, 0)}
    assert e.filter("row_key = 1").count() == 3 and nested.entry_children(entries(spark, [row])).count() == 2


def test_nested_empty_and_extra_columns(spark):
    none = entries(spark, [(1, None, None, None, None, None, None, None), (2, "x", "y", [], [], [], [], "")])
    assert nested.entry_children(none.withColumn("row_key", F.lit(9)).withColumn("kids", F.lit("x"))).count() == 0
    assert nested.bridge(none.limit(0), payloads(spark, None).limit(0)).count() == 0


def tables(spark, rows, builtins=(), removed=()):
    e = entries(spark, [(i, n, c, None, None, None, s, t) for i, n, c, s, t in rows])
    b = spark.createDataFrame([(n,) for n in builtins], "name string")
    r = spark.createDataFrame([(n, c) for n, c in removed], "name string, category string")
    return e, b, r


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_orphans(spark):
    rows = [
        (1, "a.one", "function", ["a.two", None, "", "gone.x", "#fun_not.there", "https://a.example", "built.in", "A.ONE ()", "later.z"], "2024-01-31T23:30:00-05:00"),
        (2, "`A . Two`", "(Variable)", ["later.z"], "2024-05-01T00:00:00Z"),
        (3, "later.z", "type", ["a.one"], "2024-05-09 01:00:00"),
        (4, "function", "later.z", ["later.z", "no"], None),
        (5, None, "function", ["later.z"], "2023-01-01T00:00:00"),
        (6, "never.timed", "type", None, ""),
        (7, "x", "type", ["never.timed"], "2020-01-01T00:00:00"),
    ]
    got = found(orphans.orphan_references(*tables(spark, rows, ["built.in"], [("GONE.x", "function")])))
    assert got == sorted([(1, 0, "late"), (1, 3, "deleted"), (1, 4, "missing"), (1, 8, "late"), (4, 1, "missing"), (5, 0, "late")])
    report = orphans.orphan_report(*tables(spark, rows, ["built.in"], [("GONE.x", "function")]), "t")
    assert {(r.month, r.orphan_kind): r.n_references for r in report.collect()} == {("2024-02", "late"): 2, ("2024-02", "deleted"): 1, ("2024-02", "missing"): 1, (None, "missing"): 1, ("2023-01", "late"): 1}


def test_orphans_of_empty_tables(spark):
    e, b, r = tables(spark, [])
    assert orphans.orphan_references(e, b, r).count() == 0
    e, b, r = tables(spark, [(1, "a", "type", ["b"], None)])
    assert found(orphans.orphan_references(e, b, r)) == [(1, 0, "missing")]


def test_many_keys_per_range(spark):
    """More keys than a bitmap has bits: blocks of one range are told apart."""
    n = orphans.BITS + 500
    refs = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(5).alias("ref_month"), F.lit(1).alias("rec_id"), F.lit(0).alias("pos"))
    parents = spark.range(0, n, 2).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(orphans.HELD).alias("kind"), F.lit(5).alias("month"))
    got = orphans.orphan_keys(refs, parents, ranges=1)
    assert got.count() == n // 2
    assert got.filter("orphan_kind != 'missing' or cast(substring(key, 2) as int) % 2 = 0").count() == 0


def test_compressed_bitmaps():
    rng = np.random.default_rng(7)
    shapes = [np.arange(0), np.arange(orphans.BITS), np.array([0, orphans.BITS - 1]), np.arange(0, orphans.BITS, 2), np.arange(500, 9000), np.sort(rng.choice(orphans.BITS, 9000, replace=False)), np.sort(rng.choice(orphans.BITS, 40, replace=False))]
    everywhere = np.arange(orphans.BITS).astype("<u2")
    for places in shapes:
        bitmap = orphans.compress(places)
        assert len(bitmap) <= 1 + min(orphans.BITS // 8, 2 * len(places))
        assert list(orphans.places_of(bitmap)) == list(places)
        assert list(np.flatnonzero(orphans.among(bitmap, everywhere))) == list(places)
    assert {orphans.compress(places)[0] for places in shapes} == {0, 1, 2}
    assert not orphans.among(None, everywhere).any()


CELLS = [
    ("raw_see_also", "a.b, c;d | e\tf\ng · h", ["a.b", "c", "d", "e", "f", "g", "h"]),
    ("raw_see_also", '"Time, sessions", \'x;y\' ; “p|q”', ["Time, sessions", "x;y", "p|q"]),
    ("raw_see_also", '"Why ""na"" is not zero"', ['Why "na" is not zero']),
    ("raw_see_also", '["a", "b \\"c\\", d", ""]', ["a", 'b "c", d']),
    ("raw_see_also", " , a, ,", ["a"]),
    ("raw_see_also", "Plots and fills|x+y", ["Plots and fills", "x+y"]),
    ("raw_see_also", "ta.sma(src, len); ta.ema(f(a, b), len)", ["ta.sma(src, len)", "ta.ema(f(a, b), len)"]),  # a fixed class of delimiters splits these wrongly
    ("raw_see_also", "f(a, b; c", ["f(a", "b", "c"]),
    ("raw_see_also", "ta.sma + ta.ema", ["ta.sma", "ta.ema"]),
    ("raw_see_also", "a / b / c+d", ["a", "b", "c+d"]),
    ("raw_see_also", "a + b, c", ["a + b", "c"]),
    ("raw_see_also", '"a" , "b, c', ["a", '"b', "c"]),
    ("raw_see_also", '["a", b]', ['["a"', "b]"]),
    ("sources", "a+b + c", ["a", "b", "c"]),
    ("sources", '  "a, archived"  ', ["a, archived"]),
    ("sources", '"never closed, b', ['"never closed', "b"]),
    ("raw_examples", 'x = 1\nplot(x) ||| alert("a ||| b")|||', ["x = 1\nplot(x)", 'alert("a ||| b")']),
    ("raw_examples", "a = b\n---\n\n---\nc := d - e -- f", ["a = b", "c := d - e -- f"]),
    ("raw_examples", '"f(""x"", 1)\ng", "h || i"', ['f("x", 1)\ng', "h || i"]),
    ("raw_examples", "a ;;; b;c || d", ["a", "b;c", "d"]),
    ("raw_examples", '["a\\n\\"b\\"", "c"]', ['a\n"b"', "c"]),
    ("raw_examples", '"x || y" + z || w', ['"x || y" + z', "w"]),
    ("raw_examples", '[a, b] = f()\n---\nx ---\n--- y\n"', ["[a, b] = f()", 'x ---\n--- y\n"']),
]


@pytest.mark.parametrize("limit", [packed.BROADCAST_BYTES, 0])
def test_packed_cells(spark, limit):
    rows = [(i, *[c if f == field else None for f in ("raw_examples", "raw_see_also", "sources")]) for i, (field, c, _) in enumerate(CELLS)]
    rows += [(90, None, "", " \t "), (91, " ||| ", ",;", "[]")]
    df = spark.createDataFrame(rows, "row_no bigint, raw_examples string, raw_see_also string, sources string").withColumn("pos", F.lit("clash")).withColumn("cell", F.lit(1))
    got = {}
    for r in packed.unpack(df, broadcast_bytes=limit).collect():
        got.setdefault(r.row_no, {})[r.pos] = r.item_text
    for i, (_, cell, expected) in enumerate(CELLS):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == expected, cell
    assert 90 not in got and 91 not in got
    assert packed.unpack(df.limit(0)).count() == 0


def test_packed_long_cell(spark):
    cell = " ||| ".join(f'alert("x {i}")\nplot({i})' for i in range(3000))
    df = spark.createDataFrame([(1, cell, ", ".join(["a.b"] * 20000), None)], "row_no bigint, raw_examples string, raw_see_also string, sources string")
    assert {r.field_name: r["count"] for r in packed.unpack(df).groupBy("field_name").count().collect()} == {"raw_examples": 3000, "raw_see_also": 20000}


def test_salted_join_is_a_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = skew.salted_join(left, right, ["k"], "n", "id", min_rows=10, hot_keys=2, salts=4)
    assert sorted(map(tuple, got.select("id", "first").collect())) == sorted(map(tuple, left.join(right, "k").select("id", "first").collect()))
