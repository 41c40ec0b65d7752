"""Ranked plans on small tables whose whole result is known."""

import math

from glyphmill.plans import ranked


def turned(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def landed(spark, folder, docs, vectors):
    """docs: (doc_id, about_name, source, doc_kind); vectors: (vec_id, embedding)."""
    spark.createDataFrame(docs, "doc_id bigint, about_name string, source string, doc_kind string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_interleaved_has_the_ten_nearest_entries(spark, tmp_path):
    """Query 50 is no entry and its ten hits are guides; twelve entries and four other queries lie behind."""
    guides, queries, entries = range(1, 10), (100, 150, 200, 250), range(301, 313)
    docs = [(50, None, "s", "guide"), *[(i, None, "s", "guide") for i in [*guides, *queries]], *[(i, None, "s", "entry") for i in entries]]
    vectors = [(50, turned(0)), *[(i, turned(i * 0.1)) for i in guides], *[(q, turned(2 + n)) for n, q in enumerate(queries)], *[(e, turned(20 + n)) for n, e in enumerate(entries)]]
    got = sorted((r.place, r.id) for r in ranked.interleaved(spark, landed(spark, tmp_path, docs, vectors)).collect() if r.query_id == 50)
    assert got == list(enumerate([50, *range(301, 311), *guides], 1))


def test_rank_fusion_scores_before_it_cuts(spark, tmp_path):
    """Documents of a hot symbol from the query's own source go first although ten others have smaller ids."""
    others, own, nameless = range(1, 16), range(101, 105), range(201, 204)
    docs = [(150, "hot", "b", "x"), *[(i, "hot", "a", "x") for i in others], *[(i, "hot", "b", "x") for i in own], *[(i, "hot", None, "x") for i in nameless], (200, "hot", None, "x")]
    vectors = [(150, turned(0)), (200, turned(1)), (301, turned(2))]
    got = sorted((r.query_id, r.place, r.id) for r in ranked.rank_fusion(spark, landed(spark, tmp_path, docs, vectors)).collect())
    assert [i for q, _, i in got if q == 150] == [*own, 150, 1, 2, 3, 4, 5]
    assert [i for q, _, i in got if q == 200] == list(range(1, 11))


def test_rank_fusion_takes_ten_of_a_large_own_source(spark, tmp_path):
    docs = [(50, "hot", "b", "x"), *[(i, "hot", "a", "x") for i in range(1, 13)], *[(i, "hot", "b", "x") for i in range(101, 115)]]
    got = sorted((r.place, r.id) for r in ranked.rank_fusion(spark, landed(spark, tmp_path, docs, [(50, turned(0))])).collect())
    assert [i for _, i in got] == [50, *range(101, 110)]
