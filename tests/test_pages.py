from pyspark.sql import functions as F

from loomwright.operators import linking as L


def test_page_edges_take_little_disk(spark, tmp_path):
    # four pages of 2,503 units, which fill no whole blocks, and 100 references to each
    u = spark.range(10_012).select(
        F.col("id").alias("unit_id"), F.concat(F.lit("m"), F.expr("cast(id div 100000 as string)")).alias("manual_id"), (F.col("id") % 4).cast("int").alias("page"),
        F.when(F.col("id") < 400, F.concat(F.lit("see page "), F.expr("cast(id div 100 as string)"))).otherwise("").alias("text"))
    out = str(tmp_path / "edges")
    L.page_reference_edges(u).write.parquet(out)
    got = spark.read.parquet(out)
    assert (got.count(), got.distinct().count()) == (400 * 2_503 - 100,) * 2 and got.where("dst % 4 <> src div 100 or label <> cast(dst % 4 as string) or src = dst").count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "edges").glob("*.parquet")) < 600_000


def test_page_edges_keep_repeats_and_drop_nulls(spark, monkeypatch):
    rows = [("r", "m", 1, "see page 2, on page 2 and refer to page 1"), ("r", "m", 1, "see page 2"), *[(f"u{i}", "m", 2, None) for i in range(5)], ("u0", "m", 2, ""),
            (None, "m", 2, "see page 1"), ("n", None, 2, "see page 2"), ("p", "m", None, "see page 1"), ("o", "other", 2, "")]
    u = spark.createDataFrame(rows, "unit_id string, manual_id string, page int, text string")
    want = sorted([("r", f"u{i}", "2") for i in (0, 0, 1, 2, 3, 4)] * 2 + [("p", "r", "1")] * 2)
    for block in (1, 2, 128):
        monkeypatch.setattr(L, "PAGE_BLOCK", block, raising=False)
        assert sorted(tuple(r) for r in L.page_reference_edges(u).collect()) == want
    assert L.page_reference_edges(u.limit(0)).count() == 0
