"""Queries over the given records on small tables."""

import __spark_entry__ as entry


def test_status_by_release_counts_every_row(spark, tmp_path):
    rows = [("1", "r", " Answered"), ("1", "r", "answered"), ("2", "r", "provider_error"), ("3", "r", "pipeline_error"), ("4", "r", "not_applicable"), ("5", "r", None), ("6", "r", "new"), ("7", None, None)]
    spark.createDataFrame(rows, "id string, retrieval_release string, status string").write.parquet(str(tmp_path / "queries.parquet"))
    got = {r.retrieval_release: r.asDict() for r in entry.queries()["status_by_release"](spark, str(tmp_path)).collect()}
    assert got["r"] == {"retrieval_release": "r", "answered": 1, "clarify": 0, "no_evidence": 0, "refused": 0, "not_applicable": 1, "provider_error": 1, "pipeline_error": 1, "missing": 1, "other": 1}
    assert got[None]["missing"] == 1 and sum(v for k, v in got[None].items() if k != "retrieval_release") == 1
