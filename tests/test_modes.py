"""Search as a whole, vectors and names: brute force, dirt, ties and empty tables."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from glyphmill.operators import modes, search

VECTORS = "id bigint, embedding array<double>"


def turned(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def vectors(spark, rows, key="vec_id"):
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>")


def test_most_alike_loses_nothing():
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    letters, lengths = search._letters(names), np.array([len(n) for n in names])
    for score in (0.0, 45.0, 70.0, 85.0):
        for query in rng.sample(names, 20) + ["zzz", "a" * 40]:
            scored = sorted(((search.indel_ratio(query, n), n) for n in names), key=lambda x: (-x[0], x[1]))
            assert search.most_alike(query, names, letters, lengths, score, 5) == [x for x in scored if x[0] >= score][:5]


def test_exact_search_leaves_odd_vectors_out(spark):
    rows = [(50, turned(0)), (1, turned(1)), (2, turned(2)), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0]), (7, turned(1)), (100, [0.0, 0.0])]
    got = [(r.query_id, r.rank, r.vec_id) for r in search.vector_topk(vectors(spark, rows), 4).orderBy("query_id", "rank").collect()]
    assert got == [(50, 1, 50), (50, 2, 1), (50, 3, 7), (50, 4, 2)]
    assert search.vector_topk(vectors(spark, []), 3).count() == 0 and search.vector_topk_indexed(vectors(spark, []), 3).count() == 0


def test_index_recall_at_several_sizes(spark):
    rng = np.random.default_rng(3)
    for n in (40, 3_000):
        x = rng.normal(size=(n, 24))
        df = vectors(spark, [(i, row.tolist()) for i, row in enumerate(x)] + [(n + 1, None)]).repartition(4)
        exact = {(r.query_id, r.vec_id) for r in search.vector_topk(df, 10).collect()}
        near = {(r.query_id, r.vec_id) for r in search.vector_topk_indexed(df, 10, parts=8).collect()}
        assert len(near & exact) >= 0.9 * len(exact) and len(near) == len(exact)


def catalog(spark, rows):
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, category string, namespace string, syntax string, parameters string, text string, returns string")


def guide(i, degrees, category="guide", namespace="a", syntax="", text=None, returns=""):
    return (i, turned(degrees), category, namespace, syntax, "", text or f"text {i}", returns)


def asked(spark):
    return spark.createDataFrame([(900, turned(0))], VECTORS)


def hits(spark, rows=()):
    return spark.createDataFrame(list(rows), "query_id bigint, score double, seen bigint, id bigint")


def told(df):
    return [(r.place, r.id) for r in df.orderBy("place").collect()]


def test_documents_step_by_step(spark):
    rows = [guide(1, 1), guide(2, 2), guide(3, 3, text="text 1"), guide(4, 4), guide(5, 0, "example"), guide(20, 20, "function"), guide(21, 21, "function", "b"), (30, None, None, None, None, None, None, None), guide(31, 80, "function")]
    c = catalog(spark, rows)
    # the five nearest are 1, 2, 3, 4, 20: none of the first three is due, so the functions not among them, 21 and 31, go
    # behind the first, and the sixth is cut; 3 begins as 1 does, 31 is far, and the example stays aside
    assert told(modes.documents(c, asked(spark), hits(spark), 5)) == [(1, 1), (2, 21), (3, 2)]
    assert told(modes.documents(c, asked(spark), hits(spark, [(900, 90.0, 1, 4), (900, 99.0, 2, 21)]), 5)) == [(1, 21), (2, 4), (3, 1), (4, 2)]
    assert told(modes.documents(c, asked(spark), hits(spark), 5, namespace="b")) == [(1, 21)]
    assert told(modes.documents(c, asked(spark), hits(spark), 2, category="guide")) == [(1, 1), (2, 2)]
    assert modes.documents(c.limit(0), asked(spark), hits(spark, [(900, 90.0, 1, 4)]), 5).count() == 0


def test_functions_are_filled_up_with_what_looks_like_one(spark):
    c = catalog(spark, [guide(1, 1, "function"), guide(2, 2, syntax="f(x)"), guide(3, 3), guide(4, 4, syntax="g(y)")])
    got = modes.documents(c, asked(spark), hits(spark), 3, category="function").orderBy("place").collect()
    assert [(r.place, r.id, r.category) for r in got] == [(1, 1, "function"), (2, 2, "function")]  # the three nearest of any kind are 1, 2 and 3


def test_return_types(spark):
    c = catalog(spark, [guide(1, 1, "function", returns="series float"), guide(2, 60, "function", returns="array<float>"), guide(3, 3, "function", returns="bool"), guide(4, 80, "function", returns="float"), guide(5, 2, "guide", returns="float")])
    ask = asked(spark).withColumn("return_type", F.lit(" Float "))
    assert [(r.place, r.id, r.direct) for r in modes.returning(c, ask, 5).orderBy("place").collect()] == [(1, 1, True), (2, 2, True), (3, 4, True), (4, 3, False)]
    none = asked(spark).withColumn("return_type", F.lit("table"))
    assert [(r.place, r.id) for r in modes.returning(c, none, 5).orderBy("place").collect()] == [(1, 1), (2, 3), (3, 2)]

def test_most_alike_of_each_loses_nothing(monkeypatch):
    rng = random.Random(6)
    # few and many letters, null and wide characters; queries of several words of bits, and texts that are compared alone
    for together, pairs, long, letters, most in ((4, 7, 1024, "ab", 12), (128, 8192, 1024, "abcdefgh. _", 40), (3, 50, 1024, "abcé漢😀\0_", 90), (16, 64, 1024, "ab", 200), (16, 64, 30, "abcdef", 60)):
        for name, value in (("TOGETHER", together), ("PAIRS", pairs), ("LONG", long)):
            monkeypatch.setattr(search, name, value)
        made = lambda n: list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)))
        names = made(150)
        queries = list(dict.fromkeys(made(20) + names[:3]))
        for floors in ([0.0] * len(queries), [rng.choice([0.0, 60 - 1e-6, 70.0, 100.0]) for _ in queries]):
            got = {}
            for q, n, s in search.most_alike_of_each(queries, floors, names, 2):
                got.setdefault(q, []).append((-s, n))
            for q, floor in zip(queries, floors):
                scored = sorted((-search.indel_ratio(q, n), n) for n in names)
                assert sorted(got.get(q, []))[:2] == [x for x in scored if -x[0] >= floor][:2]
    assert search.most_alike_of_each([], [], ["a"], 2) == search.most_alike_of_each(["a"], [0.0], [], 2) == []


def test_name_blocks_compare_no_pair_alone(monkeypatch):
    rng, alone = random.Random(4), []
    ratio = search.indel_ratio
    monkeypatch.setattr(search, "indel_ratio", lambda a, b: alone.append(a) or ratio(a, b))
    words = ["".join(rng.choice("aeiouklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    names = sorted({"".join(rng.choices(words, k=5)) for _ in range(3000)})
    queries = sorted({" ".join(rng.choices(words, k=5)) for _ in range(300)})
    found = search.most_alike_of_each(queries, [70.0] * len(queries), names, 2)
    assert found and not alone  # nearly a million pairs
    assert all(s == ratio(q, n) for q, n, s in found)


def test_floor_of_a_query(spark):
    names = spark.createDataFrame([("close",), ("closed",), ("clod",)], "name string")
    queries = spark.createDataFrame([("closer", 90.0), ("clos", 80.0), ("clos", None), ("Clo", 99.0), (None, 1.0)], "name string, floor double")
    got = {(r.query, r.name) for r in search.fuzzy_names(names, queries, 70.0, 5, floor="floor").collect()}
    assert got == {("closer", "close"), ("clos", "close"), ("clos", "closed"), ("clos", "clod")}  # the lowest of a query's floors holds, a null is none


def test_names_loads_and_bias(spark):
    rows = spark.createDataFrame([(1, "a", "type", "n", "xx"), (2, "A", "type", "n", "xxx"), (3, "type.b", "type", "m", "x"), (4, None, "type", "n", "x"), (5, "a", "function", "n", "xxx"), (6, "c", "type", "z", "")], "row_no bigint, name string, category string, namespace string, document string")
    names = spark.createDataFrame([("A",), ("b",), (None,)], "name string")
    assert sorted(r.row_no for r in modes.by_names(rows, names).collect()) == [1, 2, 5]
    assert sorted(r.row_no for r in modes.types_by_name(rows, names).collect()) == [2, 3]
    assert sorted(map(tuple, modes.loads(rows, ["n", "m"]).collect())) == [("m", 1, 1, 0), ("n", 3, 1, 1)]
    near = spark.createDataFrame([(1, 1, 10, 0.30, "a"), (1, 2, 11, 0.34, "ta"), (1, 3, 12, 0.36, "ta"), (2, 1, 10, 0.2, "a"), (2, 2, 11, 0.25, "ta")], "query_id bigint, rank int, id bigint, distance double, namespace string")
    assert {(r.query_id, r.id) for r in modes.biased(near, "ta").collect()} == {(1, 11), (2, 10)}


def test_name_hits(spark):
    names = spark.createDataFrame([(1, "ta.macd"), (2, "moving_average"), (3, "close"), (4, "closed"), (5, "Close()"), (6, None), (7, " ")], "id bigint, name string")
    queries = spark.createDataFrame([(1, "how does macd use close"), (2, "moving average"), (3, "ta.macd"), (4, "no.such"), (5, None), (6, "")], "query_id bigint, text string")
    got = {}
    for r in modes.name_hits(queries, names).orderBy("query_id", F.desc("score"), "seen").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got[1] == [(1, 100.0), (3, round(200 * 5 / 15, 6))]  # the alias of macd; close is first seen through "macd close", and that score stays
    assert got[2] == [(2, round(200 * 13 / 28, 6))] and got[3] == [(1, 100.0)]
    assert 4 not in got and 5 not in got and 6 not in got
    assert modes.name_hits(queries.limit(0), names).count() == 0 and modes.name_hits(queries, names.limit(0)).count() == 0
