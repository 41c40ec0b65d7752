"""The symbol of every error report, whatever its dress."""

from glyphmill.plans import code


def test_every_report_is_kept(spark, tmp_path):
    said = ["CE1 @ 1:2 `@gaugeFast`", "CE1 @ 1:2 `iron.​vault`", "﻿CE1 @ 1:2 &quot;cobalt.snap&quot;", "CE1 @ 1:2 'ta.x'\nmore", "nothing here", None]
    spark.createDataFrame([(i, "error_report", t) for i, t in enumerate(said)], "doc_id bigint, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Iron.vault", "type", "s", "", "")], "row_no bigint, name string, category string, syntax string, raw_parameters string, document string").write.parquet(f"{tmp_path}/catalog_records.parquet")
    got = {r.doc_id: (r.name_key, r.best_row) for r in code.report_symbols(spark, str(tmp_path)).collect()}
    assert got == {0: ("gaugefast", None), 1: ("iron.vault", 7), 2: ("cobalt.snap", None), 3: ("ta.x", None), 4: (None, None), 5: (None, None)}
