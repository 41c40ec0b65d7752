"""Hidden duplicates, survivorship, tokens, packing and languages: small fixtures, dirt, brute force and round trips."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import dedupe, language, packing, survivors, tokens

RECORD = "rec_id bigint, name string, category string, syntax string, description string, sources array<string>, scraped_at string"


def records(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], RECORD)


def trust(spark, rows=(("live", 1), ("local", 2), ("wiki", 2), (None, 1), ("x", None))):
    return spark.createDataFrame(list(rows), "source_code string, trust_rank int")


def found(df):
    return sorted(tuple(r) for r in df.collect())


# 1 -------------------------------------------------------------------------------------------------------------


def test_copies(spark):
    rows = [
        (5, "lib.foo", "function"), (2, " LIB::Foo ", "[Function]"), (9, "function", "lib-foo"), (3, "lib.foo2", "function"), (4, "oof.lib", "function"),
        (6, None, "function"), (7, "", None), (8, "==", "operator"), (10, "operator", "`==`"), (11, "!=", "operator"), (12, "lib.foo", None), (13, "lib.foo", None), (5_000, "lib.foo", "function"),
    ]
    df = records(spark, rows).withColumn("length", F.lit("clash")).withColumn("_members", F.lit(1))
    got = found(dedupe.copies(df).select("first_id", "rec_id"))
    assert got == [(2, 5), (2, 9), (2, 5_000), (8, 10), (12, 13)]
    counts = {r.first_id: r.n_rows for r in dedupe.collapsed(df).collect()}
    assert counts == {2: 4, 3: 1, 4: 1, 8: 2, 11: 1, 12: 2}
    assert dedupe.copies(df.limit(0)).count() == 0


def test_long_names_do_not_overflow(spark):
    df = records(spark, [(1, "a" * 5_000, "type"), (2, "A" * 5_000, "TYPE"), (3, "9" * 70_000, "type")])
    assert found(dedupe.copies(df).select("first_id", "rec_id")) == [(1, 2)]


def test_cheap_class_only_splits_what_differs(spark):
    """Rows of one symbol never fall into different cheap classes."""
    df = records(spark, [(i, n, c) for i, (n, c) in enumerate([("lib.fooBar9", "type"), ("TYPE.", "LIB foo_bar-9"), ("lib．foobar9​", "(type)")])])
    assert dedupe.cheap_class(df, "rec_id", "name", "category").select("length", "histogram").distinct().count() == 1


# 5 -------------------------------------------------------------------------------------------------------------


def test_survivors(spark):
    long = "This function smooths the closing price over the last bars."
    rows = [
        (1, "a.b", "function", "a.b(x) → int", "TODO", ["wiki", "New Code"], "2024-01-01T00:00:00Z"),
        (2, "A.B", "function", "a.b(x, y) → int", long, ["LOCAL", None], "2024-01-02T00:00:00Z"),
        (3, "a.b", "function", "a.b(x, y", long[:20], ["live"], "2024-01-03T00:00:00Z"),
        (4, "a.b", "function", "a.b(...)", long[:30] + "…", ["live"], "2025-01-03T00:00:00Z"),
        (5, "a.b", "function", "a.b(x) → int", None, ["local"], ""),
        (6, "a.b", "function", " ", "n/a", [], "2026-01-01T00:00:00Z"),
        (7, "single", "type", "single", "one", ["live"], None),
        (8, None, "type", "x", "y", ["live"], None),
        (9, None, "type", "x", "y", ["live"], None),
        (20, "tie", "type", "tie → int", None, None, "2024-01-01T00:00:00Z"),
        (21, "tie", "type", "tie → int", "whole", None, "2024-01-01T01:00:00+01:00"),
    ]
    df = records(spark, rows).withColumn("codes", F.lit("clash"))
    assert found(survivors.survivors(df, trust(spark))) == sorted([
        (1, "syntax", 2), (1, "description", 2), (1, "sources/wiki", 1), (1, "sources/new_code", 1), (1, "sources/local", 2), (1, "sources/live", 3), (20, "syntax", 20), (20, "description", 21),
    ])
    merged = {r.first_rec_id: (r.syntax, r.description, r.sources) for r in survivors.merged_records(df, trust(spark)).collect()}
    assert merged[1] == ("a.b(x, y) → int", long, ["live", "local", "new_code", "wiki"])
    assert survivors.survivors(df.limit(0), trust(spark)).count() == 0
    assert len(found(survivors.survivors(df, trust(spark).limit(0)))) == 8


def test_trust_join_beyond_the_map(spark, monkeypatch):
    rows = [(1, "a", "type", "a → int", "d", ["local"], None), (2, "a", "type", "a → float", "e", ["live"], None)]
    small = found(survivors.survivors(records(spark, rows), trust(spark)))
    monkeypatch.setattr(survivors, "MAP_CODES", 1)
    assert found(survivors.survivors(records(spark, rows), trust(spark))) == small
    assert (1, "syntax", 2) in small


def test_whole_values_against_brute_force(spark):
    rng = random.Random(4)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) + rng.choice(["", "", "…", " [cut]"]) for _ in range(400)} | {"x" * n for n in range(1, 60)})
    marked = lambda t: t.endswith(("…", "[cut]"))
    stem = lambda t: t.removesuffix("…").removesuffix(" [cut]")
    expected = {t for t in texts if not marked(t) and not any(stem(s) != t and stem(s).startswith(t) for s in texts)}
    rows = [(name, "c", slot, stem(t), not marked(t), i) for i, t in enumerate(texts) for name, slot in (("s", "syntax"), ("s", "description"), ("t", "syntax"))]
    df = spark.createDataFrame(rows, "sym_name string, sym_category string, slot string, stem string, whole boolean, ord int")
    for told in (survivors.whole_values(df), survivors.whole_values_ranged(df)):
        kept = told.filter("whole").collect()
        assert len(kept) == 3 * len(expected)
        assert {texts[r.ord] for r in kept} == expected


def test_survivors_of_hot_symbols(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "TODO", "", "alpha beta", "alpha beta gam", "beta…"]
    rows = [(i, f"n{rng.randint(0, 4)}", "type", " ".join(rng.choice(words) for _ in range(3)), rng.choice(words), [rng.choice(["live", "wiki", "Odd"])], f"2024-01-{rng.randint(1, 28):02d}T00:00:00Z") for i in range(400)]
    df = records(spark, [*rows, (900, "once", "type", "x", "y", ["live"], None)])
    usual = found(survivors.survivors(df, trust(spark)))
    assert usual == found(survivors.best_offers(df, trust(spark), hot_rows=2, hot_symbols=3).select("first_rec_id", "slot", (-F.col("best.ord.neg_id")).alias("from_rec_id")))
    assert len(usual) >= 5 * 4 and 900 not in {r[0] for r in usual}
    assert found(survivors.survivors(df, trust(spark), ())) != usual  # what stands in for a value is a parameter


def test_long_source_codes_stay_whole(spark):
    df = records(spark, [(1, "a", "type", "s", "d", ["x" * 3_000], None), (2, "a", "type", "s", "d", None, None)])
    assert [len(c) for c in survivors.merged_records(df, trust(spark)).first().sources] == [3_000]


# 6 -------------------------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "a", "don't stop", "x = f(1)\n\n  \ty", "日本語のテキスト。" * 3, "naïve 🚀 👩‍💻", "<|endoftext|>", "\u0000​", "ы" * 50]


def docs(spark, texts, label=None):
    return spark.createDataFrame([(i, t, label) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")


def test_encoding_round_trip(spark):
    rng = random.Random(1)
    long = ["".join(rng.choice("ab cd.1\n ЖЩ日本=-'") for _ in range(30_000)), "=" * 30_000, "あ" * 20_000, "word " * 9_000, " " * 20_000 + "x", "it's " * 5_000]
    texts = TEXTS + long + [long[0]]
    df = docs(spark, texts).withColumn("ids", F.lit("clash"))
    coder = tokens.encoding()
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got == {i: coder.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    raw = {r.doc_id: bytes(r.bytes) for r in tokens.decode(tokens.encode(df)).collect()}
    assert raw == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {i: len(v) for i, v in got.items()}
    assert tokens.encode(df.limit(0)).count() == 0


def test_parts_are_the_text():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab 1.\n日'") for _ in range(rng.randint(0, 400)))
        assert "".join(tokens.parts(text, 20)) == text
        assert [i for p in tokens.parts(text, 20) for i in tokens.encoding().encode_ordinary(p)] == tokens.encoding().encode_ordinary(text)


# 7 -------------------------------------------------------------------------------------------------------------


def sizes(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, n_tokens bigint")


def test_packing_keeps_every_token(spark):
    rng = random.Random(3)
    values = [0, None, 512, 513, 5_000, 1] + [rng.randint(1, 700) for _ in range(3_000)]
    packed = packing.pack(sizes(spark, values), [(1, 512), (3, 2_048)], partitions=8).cache()
    for budget, capacity in ((1, 512), (3, 2_048)):
        rows = packed.filter(F.col("budget_id") == budget)
        per = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("s"))
        assert per.agg(F.max("s")).first()[0] <= capacity
        total = {r.doc_id: r.s for r in rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("s")).collect()}
        assert total == {i: v for i, v in enumerate(values) if v}
        split = {r.doc_id for r in rows.groupBy("doc_id").count().filter("count > 1").collect()}
        assert split == {i for i, v in enumerate(values) if v and v > capacity}
        least = -(-sum(v or 0 for v in values) // capacity)
        assert per.count() <= least * 1.02 + 1
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, packing.pack(sizes(spark, values), [(1, 512), (3, 2_048)], partitions=8).collect()))


def test_rounds_follow_the_residual(spark):
    """Few items in many tasks: the rounds go on while they save containers, and end when none can be saved."""
    rng = random.Random(9)
    values = [rng.randint(1, 100) for _ in range(3_000)]
    packed = packing.pack(sizes(spark, values), [(1, 1_000)], partitions=64)
    assert packed.select("container_id").distinct().count() <= -(-sum(values) // 1_000) + packing.LEAST_TASKS
    faults = packing.packing_faults(packed, sizes(spark, values)).first()
    assert (faults.n_documents, faults.n_over, faults.n_amiss) == (3_000, 0, 0)
    assert packing.pack(sizes(spark, [7] * 50), [(1, 10)], partitions=1).select("container_id").distinct().count() == 50


def test_packing_of_nothing(spark):
    assert packing.pack(sizes(spark, []), [(1, 10)]).count() == 0
    assert packing.pack(sizes(spark, [1]), []).count() == 0
    assert packing.pack(sizes(spark, [0, None]), [(1, 10)]).count() == 0
    budgets = spark.createDataFrame([(1, 10), (2, None), (3, 0), (None, 5), (1, 10)], "budget_id int, capacity int")
    assert packing.budget_list(budgets) == [(1, 10)]


def test_best_fit_against_first_principles():
    rng = random.Random(5)
    for _ in range(100):
        items = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        bins = packing.best_fit(items, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(items)))
        assert all(sum(items[i] for i in b) <= 100 for b in bins)


# 8 -------------------------------------------------------------------------------------------------------------

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(language.sample(spark.read.parquet(f"{DATA}/documents.parquet")))


def test_labels(spark):
    cases = {"de": "de", "EN": "en", "en_GB": "en", "pt-BR": "pt", "German": "de", "jpn": "ja", " French ": "fr", "dut": "nl", "und": None, "zxx": None, "": None, None: None, "xx": None, "pine": None, "n/a": None, "deutsch": None}
    df = docs(spark, list(cases)).select("doc_id", language.label_code(F.col("text")).alias("code"))
    assert [r.code for r in df.orderBy("doc_id").collect()] == list(cases.values())


def test_sentences():
    text = "### lib.fooBar\nlib.fooBar(x) → int\n\nOne two three. Four&nbsp;five!\n```\nx = lib.fooBar(1)\n// A comment here.\n// 45\n```\n* Point one? Two.\n------\nCE10001 @ 1:2 `lib.foo`\nこれは文です。次の文です。"
    assert language.sentences(text) == ["One two three.", "Four five!", "A comment here.", "Point one?", "Two.", "これは文です。", "次の文です。"]
    assert language.words("It calls `lib.fooBar()` 45 times, don't 3e1fb3c0") == ["it", "calls", "times", "don", "t"]
    assert language.sentences(None) == [] and language.sentences("```\nx = 1") == []


def test_forward_sums_all_segmentations():
    import numpy as np

    table = np.zeros((max(language.vocabulary().values()) + 1, 1))
    pieces = language.vocabulary()
    for piece, p in (("▁a", 0.5), ("b", 0.25), ("▁ab", 0.125), ("▁", 0.1), ("a", 0.2), ("ab", 0.05)):
        table[pieces[piece]] = p
    got = float(np.exp(language.Unigrams(table, ("xx",)).word("ab")[0]))
    assert abs(got - (0.5 * 0.25 + 0.125 + 0.1 * 0.2 * 0.25 + 0.1 * 0.05)) < 1e-9


def test_long_words_count(spark):
    assert language.words("Die Verantwortlichkeitsbewusstseinsfrage bleibt") == ["die", "verantwortlichkeitsbewusstseinsfrage", "bleibt"]
    assert language.words("漢" * 40 + "は") == ["漢" * 40, "は"]


@needs_data
def test_words_of_any_length(model):
    short = "verantwortlichkeitsbewusstsein"
    assert abs(model.word(short) - model._long_word(short)).max() < 1e-6
    endless = model.word("unterschiedlichkeit" * 5_000)
    assert model.languages[int(endless.argmax())] == "de" and endless.max() < -10_000 and len(set(endless)) == len(endless)


@needs_data
def test_every_labelled_language_is_fitted(spark):
    rows = [(i, "Please check the closing price of the bar.", "en") for i in range(500)] + [(900, "Personne ne sait pourquoi la légende reste vide.", "fr")]
    picked = language.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows=10)
    assert collections.Counter(code for code, _ in picked) == {"en": 10, "fr": 1}


@needs_data
def test_languages(spark, model):
    de, en, fr = "Bitte prüfen Sie, ob die Legende noch leer ist, sobald die Börse öffnet.", "Please check whether the closing price is still empty.", "Personne ne sait pourquoi la légende reste vide."
    texts = [de, f"{de} {de} {en} {en} {en} {fr}", None, "", " ", "x = 1\nplot(x)", "```\ny := 2\n```", "123 ... !!", de, f"{en}\n```\n// {de}\nx = 1\n```", en * 400]
    df = spark.createDataFrame([(i, t, lab) for i, (t, lab) in enumerate(zip(texts, ["en", "de-DE", None, None, None, None, None, None, "German", "en", "xx"]))], "doc_id bigint, text string, lang string").withColumn("seg_no", F.lit("clash"))
    got = found(language.wrong_or_mixed(language.languages(df, model)))
    assert got == [(0, 0, "de"), (1, 0, "en"), (1, 1, "de"), (1, 2, "en"), (1, 3, "fr"), (9, 0, "de"), (9, 1, "en"), (9, 2, "de"), (10, 0, "en")]
    assert language.languages(df.limit(0), model).count() == 0
    confidence = [r.confidence for r in language.languages(df, model).collect()]
    assert all(0 < c <= 1 for c in confidence)


def test_no_labelled_rows(spark):
    assert language.languages(docs(spark, ["some text here"], "und")).count() == 0


@needs_data
def test_held_out_accuracy(spark, model):
    """Documents of one kind are in one language, and labels agree with it but for the few wrong ones."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_kind not in ('mixed', 'code', 'blank')")
    told = [r for r in language.languages(rows, model).filter("seg_no = 0").collect()]
    assert sum(r.n_segments == 1 for r in told) / len(told) > 0.99
    labelled = [r for r in told if r.label_code]
    assert sum(r.label_code == r.lang_code for r in labelled) / len(labelled) > 0.9
    assert collections.Counter(r.lang_code for r in told).keys() <= set(language.LANGUAGES)
