"""The query of windows on small tables."""

import __spark_entry__ as entry


def test_every_text_is_windowed(spark, tmp_path):
    long = "A sentence about the wheel. " * 60
    spark.createDataFrame([("a", "short \t text "), ("a", "short \t text "), ("b", long), ("c", None), ("d", " ")], "id string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(1, "x" * 1101), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.item_table, r.id, r.ordinal, r.piece) for r in entry.queries()["chunk_windows"](spark, str(tmp_path)).collect())
    assert [x[:3] for x in got] == [("chunks", "a", 0), ("chunks", "b", 0), ("chunks", "b", 1), ("documents", "1", 0), ("documents", "1", 1)]
    assert got[0][3] == "short text" and all(len(x[3]) <= 1100 for x in got)
