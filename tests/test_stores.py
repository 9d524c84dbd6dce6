"""Files, releases, exports, feeds; and the registry itself."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwright.sources import files, stores
from loomwright.streaming import feeds


def test_delivered_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<nav>x</nav><h1>Title</h1><p>One &amp; two</p><script>bad()</script>")
    (tmp_path / "b.txt").write_text("plain  text")
    (tmp_path / "c.txt").write_text("plain  text")
    (tmp_path / "d.bin").write_bytes(b"\xff\xfe\x00\x01")
    (tmp_path / "e.txt").write_bytes(b"")
    got = files.delivered(spark, str(tmp_path))
    by = {os.path.basename(r.path): (r.text, r.rejected) for r in got.collect()}
    assert by == {"a.html": ("Title\nOne & two", None), "b.txt": ("plain text", None), "c.txt": ("plain text", None), "d.bin": (None, "not text")}
    new = files.new_only(got.where("rejected is null"), got.where("path like '%a.html'"))
    assert [os.path.basename(r.path) for r in new.collect()] == ["b.txt"]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1,\n "tags": ["x"]}')
    (tmp_path / "b.json").write_text("{broken")
    rows = files.json_documents(spark, str(tmp_path), "id int, tags array<string>").collect()
    assert sorted((r.id or 0, r._corrupt is not None) for r in rows) == [(0, True), (1, False)]


def test_release(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    root = str(tmp_path / "store")
    first = stores.publish(rows, root)
    assert stores.publish(rows.orderBy(F.desc("i")), root) == first == stores.current_release(spark, root)
    second = stores.publish(rows.where("i = 1"), root)
    assert second["release"] != first["release"] and spark.read.parquet(second["path"]).count() == 1 and os.path.exists(first["path"])
    assert stores.publish(rows.limit(0), root)["rows"] == 0


def test_replace_and_csv(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.replace_by_key(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    stores.replace_by_key(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    stores.guarded_csv(spark.createDataFrame([("=1", 'say "x"')], "a string, b string"), str(tmp_path / "c"))
    read = lambda: "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(str(tmp_path / "c" / "part-*"))))
    assert read() == '\ufeffa,b\n\'=1,"say ""x"""\n'
    stores.guarded_csv(spark.createDataFrame([("@x", i) for i in range(9)], "a string, b int").repartition(3), str(tmp_path / "c"))
    assert read().count("\ufeff") == read().count("a,b") == 1 and read().count("'@x,") == 9


def test_a_failed_publication_leaves_the_old_release(spark, tmp_path, monkeypatch):
    rows, root = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string"), str(tmp_path / "store")
    first = stores.publish(rows, root)
    with monkeypatch.context() as m:
        m.setattr(stores, "_point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            stores.publish(rows.where("i = 1"), root)
    assert stores.current_release(spark, root) == first
    second = stores.publish(rows.where("i = 1"), root)
    assert stores.current_release(spark, root) == second != first
    assert stores.rolled_back(spark, root, first["release"]) == first == stores.current_release(spark, root)
    with pytest.raises(ValueError):
        stores.rolled_back(spark, root, "r-0")


def test_latest_rows_of_many_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(5):
        spark.createDataFrame([("a", i), (f"k{i}", 0)], "k string, at int").coalesce(1).write.mode("append").parquet(src)
    feed = feeds.stream(spark, src, 1)
    feeds.logged(spark, feed, ["k"], "at", str(tmp_path / "log"), 2)
    got = feeds.latest(feeds._log(spark, str(tmp_path / "log"), feed.schema), ["k"], "at")
    assert {(r.k, r.at) for r in got.collect()} == {("a", 4), *((f"k{i}", 0) for i in range(5))} and len(os.listdir(tmp_path / "log" / "base")) == 2


def test_feed_is_appended_once(spark, tmp_path):
    src, store, ckpt = (str(tmp_path / n) for n in ("src", "store", "ckpt"))
    spark.createDataFrame([("1", "a"), ("1", "a"), ("2", None)], "id string, text string").write.parquet(src)
    feed = lambda: feeds.stream(spark, src, 1)
    feeds.append_new(spark, feed(), "id", store, ckpt)
    spark.createDataFrame([("1", "a"), ("1", "changed"), ("3", "c")], "id string, text string").write.mode("append").parquet(src)
    feeds.append_new(spark, feed(), "id", store, ckpt)
    assert sorted((r.id, r.text or "") for r in spark.read.parquet(store).collect()) == [("1", "a"), ("1", "changed"), ("2", ""), ("3", "c")]


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["rrf_hybrid_topk", "note_edges", "conditional_closure", "cited_page_rollup", "upsert_feedback", "filled_cells", "bm25_scoped_topk", "timing_summary"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    sql = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    norm = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(norm, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(norm, r)) for r in sql)


def test_second_intent_is_the_whole_first_line(spark, tmp_path):
    line = "needle " * 40 + "zigzag"  # the last word begins after character 200
    rows = [(20, line + "\nnext bobbin", "s", "unseen"), (21, "zigzag", "s", None), (22, "bobbin", "s", None), (40, None, "s", "zigzag"), (60, "", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, title string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.query_id, r.doc_id, r.intents) for r in entry.queries()["multi_intent_merge"](spark, str(tmp_path)).collect()}
    assert got == {(20, 20, "1"), (20, 21, "1"), (40, 20, "0"), (40, 21, "0")}


def test_given_texts_are_linked(spark, tmp_path):
    chunks = [("m:1:0", "m", 1, 0, "Tighten it, see NOTE 1 and see page 9.\n(NOTE 1) Keep off.", "text"), ("m:1:0", "m", 1, 0, "Tighten it, see NOTE 1 and see page 9.\n(NOTE 1) Keep off.", "text"),
              ("m:9:0", "m", 9, 0, "WARNING: Disconnect.\n\nPitch 4 or less", "text"), ("m:9:1", "m", 9, 1, None, "text")]
    spark.createDataFrame(chunks, "id string, manual_id string, page int, ordinal int, text string, extraction string").write.parquet(str(tmp_path / "chunks.parquet"))
    drafts = [("d", "m", 9, "table", "t", "Settings", None, None, [], ["Install if Function No. 12 is set to 3"], [], ["No.", "Setting range"], [["12", "0-2"]], None, None)]
    spark.createDataFrame(drafts, "draft_id string, manual_id string, page int, kind string, title string, text string, condition_text string, cause string, checks array<string>, actions array<string>, warnings array<string>, table_headers array<string>, table_rows array<array<string>>, parent_key string, section_key string").write.parquet(str(tmp_path / "unit_drafts.parquet"))
    run = lambda name, *cols: {tuple(r) for r in entry.queries()["given_" + name](spark, str(tmp_path)).select(*cols).collect()}
    assert run("note_edges", "src", "dst", "number") == {("m:1:0#0", "m:1:0#1", "1")}
    assert run("requirement_edges", "src", "dst", "required_value") == {("d", "d#0", "3")}
    assert run("page_reference_edges", "src", "dst") == {("m:1:0#0", x) for x in ("m:9:0#0", "m:9:0#1", "d", "d#0")}
    assert run("claim_violations", "unit_id", "code") == {("d", "value_out_of_range")} and len(run("pitch_condition", "unit_id")) == 1
    got = run("conditional_closure", "query_id", "node", "required_value")
    assert {x for x in got if x[0] == "d"} == {("d", "d", None), ("d", "d#0", "3"), ("d", "m:9:0#0", None)} and ("m:1:0#0", "m:1:0#1", None) in got


def test_written_tables_are_cleared(spark, tmp_path):
    from loomwright import session

    session.clear(spark)
    t = session.materialise(spark.range(3).toDF("i"), "t")
    path = session._written[-1]
    assert t.count() == 3 and os.path.exists(path) and session.clear(spark) == 1 and not os.path.exists(path)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60
