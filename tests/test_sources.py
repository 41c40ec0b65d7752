"""Files in and out, landed pages, source files, landed compiler responses."""

import json

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import responses
from glyphmill.sources import files


def test_entries_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "name": "ta.x", "parameters": [{"name": "p", "optional": True}], "unknown": 1}, {"id": "2", "examples": ["e"]}]))
    rows = files.read_entries(spark, str(tmp_path / "a.json"))
    assert [(r.id, r.name) for r in rows.orderBy("id").collect()] == [("1", "ta.x"), ("2", None)]
    files.write_json(rows, str(tmp_path / "out"))
    assert files.read_entries(spark, str(tmp_path / "out"), lines=True).count() == 2
    both = files.read_inputs(spark, {"local": str(tmp_path / "a.json"), "live": str(tmp_path / "none.json")})
    assert {r.origin for r in both.collect()} == {"local"}
    with pytest.raises(ValueError):
        files.read_inputs(spark, {"live": str(tmp_path / "none.json")})


def test_page_links(spark):
    html = '<a class="x" href="/v6/#fun_ta.ema"><b>ta.ema</b>()</a> <a href="#zz_no">no</a><A HREF=\'p#var_close\'> close </A><a href="#fun_ta.ema">again</a>'
    rows = files.page_links(spark.createDataFrame([(html,), (None,), ("",)], "html string"), base="https://a.example/")
    assert sorted(map(tuple, rows.collect())) == [("fun_ta.ema", "https://a.example/#fun_ta.ema", "ta.ema()", "function", "ta"), ("var_close", "https://a.example/#var_close", "close", "variable", None)]


def test_source_files(spark, tmp_path):
    for name, text in {"ok/a.pine": "x", "ok/b.txt": "\n" * 5 + "indicator('a')", "ok/c.txt": "\n" * 30 + "indicator('a')", "ok/d.txt": "text", "okay/e.pine": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.source_files(spark, str(tmp_path), [str(tmp_path / "ok")])
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.pine", "b.txt"]


RESPONSES = [
    {"success": True, "result": {"errors": []}},
    {"success": False, "result": {"errors": [{"line": 3, "column": 4, "text": "Cannot call {funId} with {n}", "ctx": {"funId": "ta.ema", "n": 5}, "code": "CE1"}]}},
    {"success": False, "reason": "too large", "result": None},
    {"success": False, "errors": [{"message": "m", "start": {"line": 7, "column": 2}, "end": {"line": 7, "column": 9}}, "bare text"]},
    {"success": True, "result": {"errors": [{"lineNumber": 2, "col": 1, "msg": "careful", "type": "warning"}, {"text": "bad {msg}", "msg": "x"}]}},
    {"success": False},
]


def test_normalized_responses(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(RESPONSES)] + [(90, "not json"), (91, None)], "id bigint, payload string")
    got = {r.id: r for r in responses.normalize_responses(df, "id", "payload").collect()}
    assert {i: r.success for i, r in got.items()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 90: False, 91: False}
    e = got[1].errors[0]
    assert (e.line, e.column, e.text, e.code, e.type) == (3, 4, "Cannot call ta.ema with 5", "CE1", "error")
    assert [x.text for x in got[2].errors] == ["too large"] and [x.text for x in got[5].errors] == ["Unknown compilation failure"]
    assert [(x.line, x.column, x.end_col, x.text) for x in got[3].errors] == [(7, 2, 9, "m"), (0, 0, 0, "bare text")]
    assert [(x.line, x.text) for x in got[4].warnings] == [(2, "careful")] and [x.text for x in got[4].errors] == ["bad x"]


def test_fill_from_code(spark):
    code = "a = 1\nb = 2\nplot(xyz.q + 1)"
    rows = [(1, 3, 6, "Undeclared {identifier} {odd}", code), (2, 9, 1, "Call {funId}{typePostfix}", code), (3, 3, 99, "{name} is {kind}", code), (4, 1, 1, "{name}", ""), (5, 1, 1, "{name}", None), (6, 0, 0, "plain", code)]
    df = spark.createDataFrame(rows, "i int, line int, column int, text string, code string")
    assert {r.i: r.text for r in responses.fill_from_code(df).collect()} == {1: "Undeclared xyz.q odd", 2: "Call function", 3: "value is identifier", 4: "{name}", 5: "{name}", 6: "plain"}


def test_build_once(spark, tmp_path):
    rows, path = spark.range(3), str(tmp_path / "catalog")
    assert files.build_once(rows, path) and not files.build_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    assert files.build_once(spark.range(5), path, force=True) and spark.read.parquet(path).count() == 5
    empty = str(tmp_path / "empty")
    assert files.build_once(spark.range(0), empty) and files.build_once(rows, empty)
    assert spark.read.parquet(empty).count() == 3
