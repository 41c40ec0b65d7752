"""Building, lookup and ranked search on small tables with nulls, ties, repeats and clashing columns."""

import random

from pyspark.sql import functions as F

from glyphmill.operators import ingest, ladder, lookup, search

ENTRY = "rec_id bigint, name string, category string, namespace string, syntax string, description string, returns string, remarks string, examples array<string>, parameters array<struct<name:string>>, overloads array<string>, see_also array<string>, deprecated boolean, url string, scraped_at string"


def entry(i, name, category="function", **kw):
    order = [c.split(" ")[0] for c in ENTRY.replace("array<struct<name:string>>", "x").split(", ")]
    return tuple({"rec_id": i, "name": name, "category": category, **kw}.get(c) for c in order)


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def test_merge_sources(spark):
    local = entries(
        spark, entry(1, "a", description="old"), entry(2, "a()", description="a long text", syntax="a(x)", examples=["e1", None], see_also=["z", "b"]), entry(3, "only local"), entry(9, None, None),
    )
    live = entries(spark, entry(1, " A ", description="short", syntax="", returns="int", examples=["e2", "e1"], parameters=[("p",)], see_also=["b", "c"]), entry(2, "only live", parameters=[]))
    got = {r.merge_key: r for r in ingest.merge_sources(local, live).collect()}
    a = got["a__function"]
    assert (a.match_kind, a.description, a.syntax, a.returns, a.examples, a.see_also, a.parameters[0].name) == ("both", "a long text", "a(x)", "int", ["e1", "e2"], ["b", "c", "z"], "p")
    assert {k: r.match_kind for k, r in got.items()} == {"a__function": "both", "onlylocal__function": "local_only", "onlylive__function": "live_only", "": "local_only"}
    assert ingest.merge_sources(local.limit(0), live.limit(0)).count() == 0


def test_live_empty_text_overrides(spark):
    got = ingest.merge_sources(entries(spark, entry(1, "a", description="x", remarks="r")), entries(spark, entry(1, "a", description="longer text", remarks=""))).first()
    assert (got.description, got.remarks) == ("longer text", "")


def test_enrich_siblings(spark):
    rows = entries(
        spark, entry(1, "map.put()", syntax="map.put()", returns="prose"), entry(2, "map.put", "variable", syntax="map.put(id) → value", parameters=[("id",)]), entry(3, "map.put", "type", syntax="map.put(id, k) -> v", parameters=[("id",), ("k",)]),
        entry(4, "alone()", syntax="alone()"), entry(5, "map.put", "constant", syntax=None), entry(6, None),
    )
    got = {r.rec_id: r for r in ingest.enrich_siblings(rows).collect()}
    assert len(got) == 6 and [i for i, r in got.items() if r.enriched] == [1]
    assert (got[1].syntax, got[1].returns, got[1].returns_prose, len(got[1].parameters)) == ("map.put(id) → value", "value", "prose", 1)


def test_flatten_nulls(spark):
    rows = entries(spark, entry(1, None, None), entry(2, "a", syntax="a → int", returns="said", examples=[None, "x"], deprecated=True)).withColumn("type_fields", F.array().cast("array<struct<name:string>>")).withColumn("sources", F.array(F.lit("s"), F.lit(None)))
    got = {r.rec_id: r for r in ingest.flatten(rows).collect()}
    assert (got[1].name, got[1].returns, got[1].deprecated, got[1].example_count, got[1].raw_parameters) == ("", "", 0, 0, "")
    assert (got[2].returns, got[2].raw_returns_description, got[2].deprecated, got[2].example_count, got[2].raw_examples, got[2].sources) == ("int", "said", 1, 1, "x", "s")
    assert {r.rec_id: r.document for r in ingest.document_text(rows).collect()} == {1: ": ", 2: "FUNCTION: a\n\nSyntax: a → int\n\nReturns: said\n\nEXAMPLES:\n\nx"}


CATALOG = "row_no bigint, name string, category string, namespace string, syntax string, raw_parameters string, document string"


def catalog(spark):
    return spark.createDataFrame(
        [
            (1, "ta.x", "variable", "ta", "", "", "long document"), (2, "TA.X ", "type", "ta", "s", "", "d"), (3, "ta.x", "constant", "ta", "ta.x()", "", ""), (4, "y", "variable", "m", None, None, "aa"), (5, "y", "type", "ta", None, None, "aaa"),
            (6, "y", "type", "ta", None, None, "aaa"), (7, None, None, None, None, None, None), (8, "ta.method", "function", "ta", "", "[1]", None), (9, "ta.method", "function", "ta", "", "[1]", None), (10, " ", "type", "", "", "", ""),
        ],
        CATALOG,
    )


def test_lookups(spark):
    rows = catalog(spark)
    best = {r.name_key: (r.best_row, r.category, r.tier) for r in lookup.best_version(rows).collect()}
    assert best == {"ta.x": (3, "function", 1), "y": (5, "type", 3), "ta.method": (8, "function", 1), "": (10, "type", 3)}
    hot = {r.name_key: (r.winner_row, r.origin) for r in lookup.hot_winners(rows, ["m", "ta"], ["ta.x"]).collect()}
    assert hot == {"ta.x": (1, "global"), "y": (5, "namespace"), "ta.method": (8, "namespace")}
    assert {(r.name_key, r.category): r.n_rows for r in lookup.name_index(rows).collect()}[("y", "type")] == 2
    methods = lookup.type_methods(rows, 1).collect()
    assert [(m.owner, m.n_methods, m.methods) for m in methods] == [("ta", 1, ["ta.method"])]
    assert lookup.where(rows).count() == 10 and lookup.where(rows, equal={"namespace": "ta"}, one_of={"category": ["type"]}, unequal={"syntax": "s"}).count() == 0
    places = {(r.namespace, r.category): r.place for r in lookup.browse(rows).collect()}
    assert places[("ta", "function")] == 1 and places[("ta", "variable")] == 2


def test_ladder(spark):
    queries = spark.createDataFrame([(1, "ta.x()", "type"), (2, "y", "function"), (3, "ta.methid", "function"), (4, "zzzzzzzz", "type"), (5, None, None)], "query_id bigint, name string, category string")
    got = {r.query_id: (r.stage, r.row) for r in ladder.lookup(queries, catalog(spark)).collect()}
    assert got == {1: ("exact_in_category", 2), 2: ("exact", 5), 3: ("alike", 8), 4: ("not_found", None), 5: ("not_found", None)}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_indel_ratio():
    rng = random.Random(7)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert search.lcs_length(a, b) == lcs(a, b)
    assert search.indel_ratio("", "") == 100.0 and search.indel_ratio("a", "") == 0.0


def test_fuzzy_names_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    rng = random.Random(8)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)] + [None, "", "AB()"]
    queries = names[:7]
    make = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    plain = {n.lower().replace("()", "") for n in names if n}
    got = {(r.query, r.rank): (r.name, r.score) for r in search.fuzzy_names(make(names), make(queries), 50.0, 3).collect()}
    for q in {x.lower() for x in queries}:
        ranked = sorted(((-round(search.indel_ratio(q, n), 6), n) for n in plain if search.indel_ratio(q, n) >= 50))[:3]
        assert [got.get((q, i + 1)) for i in range(len(ranked))] == [(n, -s) for s, n in ranked]
        assert (q, len(ranked) + 1) not in got


def vectors(spark, n, seed=9, dims=8):
    rng = random.Random(seed)
    rows = [(i, [float(rng.gauss(0, 1) + (3 if i % 3 else -3)) for _ in range(dims)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, [0.0] * dims), (n + 2, None)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), rows


def test_vector_topk_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "BLOCK", 32)
    df, rows = vectors(spark, 150)
    held = [(i, np.array(v, "float32").astype(float)) for i, v in rows if v and any(v)]
    got = {(r.query_id, r.rank): (r.vec_id, r.distance) for r in search.vector_topk(df, 5, every=25).collect()}
    for q, v in [(i, v) for i, v in held if i % 25 == 0]:
        d = sorted((round(1 - float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), 9), i) for i, w in held)[:5]
        assert [got[(q, i + 1)][0] for i in range(5)] == [i for _, i in d]
    assert search.vector_topk(df.filter("embedding is null"), 5).count() == 0


def test_index_recall(spark):
    df, _ = vectors(spark, 600, dims=12)
    exact = {(r.query_id, r.vec_id) for r in search.vector_topk(df, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in search.vector_topk_indexed(df, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert search.vector_topk_indexed(df.limit(0), 10).count() == 0


def test_fusion_against_the_loop(spark):
    rng = random.Random(10)
    vec, names, expected = [], [], []
    for q in range(40):
        hits = rng.sample(range(30), rng.randint(0, 8))
        named = [(rng.choice([100.0, 85.0, 70.0]), s, i) for s, i in enumerate(rng.sample(range(30), rng.randint(0, 5)))]
        vec += [(q, r + 1, i, 0.1 + r / 10) for r, i in enumerate(hits)]
        names += [(q, sc, s, i) for sc, s, i in named]
        order = list(hits)
        if hits:
            promoted = 0
            for _, _, i in sorted(named, key=lambda x: -x[0]):
                if i not in order:
                    order.insert(promoted, i)
                    promoted += 1
                else:
                    at = order.index(i)
                    if at > promoted:
                        order.pop(at)
                        order.insert(promoted, i)
                    promoted += 1
        expected += [(q, p + 1, i) for p, i in enumerate(order[:6])]
    got = search.fuse(spark.createDataFrame(vec, "query_id int, rank int, id int, distance double"), spark.createDataFrame(names, "query_id int, score double, seen int, id int"), 6)
    assert sorted((r.query_id, r.place, r.id) for r in got.collect()) == sorted(expected)


def test_interleave(spark):
    hits = spark.createDataFrame([(1, 1, 10, "guide"), (1, 2, 11, "guide"), (2, 1, 10, "type"), (3, 1, 12, "guide")], "query_id int, rank int, id int, category string")
    extra = spark.createDataFrame([(1, 1, 20), (1, 2, 11), (2, 1, 20), (3, 1, 21)], "query_id int, rank int, id int")
    got = sorted((r.query_id, r.place, r.id) for r in search.interleave(hits, extra).collect())
    assert got == [(1, 1, 10), (1, 2, 20), (1, 3, 11), (2, 1, 10), (3, 1, 12), (3, 2, 21)]


def test_content_dedup_far_first_copy_hides(spark):
    rows = spark.createDataFrame([(1, " Same text", 0.9), (2, "same TEXT ", 0.1), (3, None, 0.2), (4, "", 0.1), (5, "x" * 130 + "a", 0.1), (6, "x" * 130 + "b", 0.1)], "rank int, text string, distance double")
    assert sorted(r["rank"] for r in search.content_dedup(rows, "text", "rank").collect()) == [1, 3, 5]
    assert sorted(r["rank"] for r in search.content_dedup(rows, "text", "rank", "distance").collect()) == [3, 5]


def test_distinct_examples(spark):
    df = spark.createDataFrame([(1, ["a b", "AB", "a\nb", "c", None, "a b\n"]), (2, None), (3, [])], "i int, e array<string>")
    assert {r.i: r.k for r in df.select("i", search.distinct_examples(F.col("e")).alias("k")).collect()} == {1: ["a\nb", "c"], 2: [], 3: []}
