"""Operators against brute force and golden cases; nulls, ties, repeated rows, empty tables and clashing columns."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwright import tables
from loomwright.functions.text import tokens
from loomwright.operators import closure as C
from loomwright.operators import layout as Y
from loomwright.operators import linking as L
from loomwright.operators import records as D
from loomwright.operators import retrieval as R


def test_bm25_against_plain_python(spark):
    r = random.Random(1)
    words = "needle thread wheel cover lever spring motor plate the of".split()
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(60)] + [(90, None), (91, ""), (92, "the of")]
    asked = [(1, "needle wheel wheel"), (2, "spring of motor"), (3, None), (4, "unknown")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("term", F.lit("clash"))
    got = {(x.query_id, x.doc_id): x.score for x in R.bm25(df, spark.createDataFrame(asked, "query_id long, question string")).collect()}
    tok = lambda t: [w for w in (t or "").split() if w not in ("the", "of")]
    counts = {i: Counter(tok(t)) for i, t in docs}
    avg = sum(map(sum, (c.values() for c in counts.values()))) / len(docs)
    df_ = Counter(w for c in counts.values() for w in c)
    want = {}
    for q, t in asked:
        for i, c in counts.items():
            s = sum(math.log(1 + (len(docs) - df_[w] + 0.5) / (df_[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in set(tok(t)) if c[w])
            if s:
                want[(q, i)] = s
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert R.bm25(df.limit(0), spark.createDataFrame(asked, "query_id long, question string")).count() == 0


def test_scope_keeps_statistics_apart(spark):
    docs = spark.createDataFrame([(1, "a", "needle wheel"), (2, "a", "wheel"), (3, "b", "needle"), (4, "b", "needle")], "doc_id long, s string, text string")
    asked = spark.createDataFrame([(7, "a", "needle")], "query_id long, s string, question string")
    rows = R.bm25(docs, asked, scope="s").collect()
    assert [x.doc_id for x in rows] == [1] and abs(rows[0].score - math.log(1 + 1.5 / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.5))) < 1e-9


def test_cosine_top_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    v[5] = v[6]
    rows = [(i, v[i].tolist()) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(5)
    got = defaultdict(dict)
    for x in R.cosine_top(df, df.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "vec"), 6).collect():
        got[x.query_id][x.rank] = x.doc_id
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 200, 10):
        s = np.round(u @ u[q], 12)
        assert [got[q][k] for k in range(1, 7)] == sorted(range(200), key=lambda i: (-s[i], i))[:6]


def test_cosine_holds_one_block_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 4)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 11)], "doc_id long, vec array<double>")
    seen, collect, write = [], type(df).collect, getattr(R, "materialise", None)
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append("collected") or collect(self))
    monkeypatch.setattr(R, "materialise", lambda *a: seen.append("written") or write(*a), raising=False)
    got = R.cosine_top(df, df.withColumnRenamed("doc_id", "query_id"), 1)
    assert seen == ["collected", "written"] * 3
    assert {(r.query_id, r.doc_id) for r in got.toLocalIterator()} == {(i, i) for i in range(1, 11)}


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    rows = {x.doc_id: (x.fused_rank, round(x.rank_score, 6)) for x in R.fused(a, b).collect()}
    assert rows == {11: (1, round(1 / 62 + 1 / 61, 6)), 10: (2, round(1 / 61, 6)), 12: (3, round(1 / 62, 6))}


def test_latest(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("a", None, "z"), (None, 3, "n"), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    assert {(x.k, x.at, x.v) for x in tables.latest(df, ["k"], "at").collect()} == {("a", 2, "y"), (None, 3, "n"), ("b", None, None)}
    assert tables.latest(df.limit(0), ["k"], "at").count() == 0


def _units(spark, rows):
    return spark.createDataFrame(rows, "unit_id string, manual_id string, page int, section_key string, kind string, extraction_method string, text string").withColumn("target", F.lit("clash"))


def test_linking(spark):
    u = _units(spark, [
        ("n1", "m", 3, "1", "information", "text", "(NOTE 2) Keep off."), ("n1v", "m", 3, "1", "information", "vlm", "NOTE 2: other words"), ("n2", "m", 9, "2", "information", "text", "(NOTE 2) Elsewhere."),
        ("t", "m", 5, "1", "table", "text", "No.: 12; Setting range: 0-3; See NOTE 2"), ("p", "m", 5, "1", "procedure", "text", "Tighten it if Function No. 12 is set to 1, see page 9 and see page 77. NOTE 4"),
        ("q", "m", 9, "2", "procedure", "text", "Function No. 12 is set to 2"), ("w", "m", 1, "0", "information", "text", "WARNING: Disconnect."), ("x", "m", 5, "1", "information", "text", "For sub-class -45[] this is not required."), ("z", "m", 5, None, "information", "text", None)])
    assert {(r.src, r.dst, r.number) for r in L.note_edges(u).collect()} == {("t", "n1", "2")}
    assert {(r.unit_id, r.number) for r in L.unresolved_notes(u).collect()} == {("p", "4")}
    assert {(r.src, r.dst, r.required_value, r.tier) for r in L.requirement_edges(u).collect()} == {("p", "t", "1", "section"), ("q", "t", "2", "manual")}
    assert {tuple(r) for r in L.warnings_of(u).select("src", "warnings", "first").collect()} == {("t", 1, "w"), ("p", 1, "w"), ("q", 1, "w")}
    assert {(r.src, r.dst) for r in L.page_reference_edges(u).collect()} == {("p", "n2"), ("p", "q")} and {(r.src, r.label) for r in L.unresolved_pages(u).collect()} == {("p", "77")}
    assert {r.unit_id: r.status for r in L.applicability(u, "-45B").collect() if r.unit_id in ("x", "p")} == {"x": "excluded", "p": "not_established"}
    assert ("p", 1, "x") in {(r.src, r.exceptions, r.last) for r in L.exceptions_of(u).collect()} and L.note_edges(u.limit(0)).count() == 0


def test_branches_stars_and_switches(spark):
    u = _units(spark, [
        ("s", "m", 2, "1", "table", "text", "Function No.: 47; Setting range: 0-2; Use: see NOTE 7\n1: see NOTE 8\n2: presser foot drops, see NOTE 8"), ("a", "m", 3, "1", "information", "text", "(NOTE 7) Presser foot will not drop if DIP switch 4 is set to OFF."),
        ("b", "m", 3, "1", "information", "text", "(NOTE 8) Only then."), ("star", "m", 2, "9", "information", "text", "* 3 Keep the oil clean."), ("ref", "m", 2, "1", "information", "text", "Fill it *3 and move it * 5 mm."),
        ("on", "m", 4, "2", "table", "text", "DIP switch: 4; Description: x; State: ON"), ("off", "m", 4, "2", "table", "text", "DIP switch: 4; Description: x; State: OFF"), ("need", "m", 8, "3", "procedure", "text", "DIP switch 4 must be turned on."),
        ("plain", "m", 8, "3", "information", "text", "NOTE: hold the wheel."), ("no", "m", 8, "3", "information", "text", "It is disabled when Function No. 47 is set to 1.")])
    assert {tuple(r) for r in L.note_edges(u).select("src", "dst", "number", "when_value").collect()} == {("s", "a", "7", None), ("s", "b", "8", "2"), ("ref", "star", "star:3", None)}
    assert {(r.src, r.dst, r.required_value) for r in L.requirement_edges(u).collect()} == {("need", "on", "ON")}
    assert {tuple(r) for r in L.setting_exclusions(u.replace("2: presser foot drops, see NOTE 8", "x", "text")).collect()} == set()
    v = u.withColumn("text", F.when(F.col("unit_id") == "s", "Function No.: 47; Setting range: 0-2; Use: see NOTE 7\n1: Presser foot drop (slowly)").otherwise(F.col("text")))
    assert {tuple(r) for r in L.setting_exclusions(v).select("unit_id", "when_value", "setting_id", "value").collect()} == {("s", "1", "dip:4", "OFF")}
    assert {tuple(r) for r in L.plain_notes_of(u).collect()} == {("need", 1)}


def test_hubs_reach_what_edges_reach(spark):
    r = random.Random(4)
    texts = ["Tighten it.", "WARNING: hot. Remove it.", "CAUTION", "For sub-class -45[] this is not required.", "NOTE: slowly.", "Plain."]
    rows = [(f"u{i}", f"m{i % 3}", r.randint(1, 7), str(r.randint(1, 3)), r.choice(["procedure", "information", "table"]), "text", r.choice(texts)) for i in range(80)]
    u = _units(spark, rows)
    edges = L.hub_edges(u).select("src", "dst", F.lit(None).cast("string").alias("required_value"), F.lit(None).cast("string").alias("when_value"))
    seeds = u.select(F.col("unit_id").alias("query_id"), F.col("unit_id").alias("node"), F.lit(None).cast("string").alias("required_value"))
    got = {(x.query_id, x.node) for x in C.evidence_closure(edges, seeds).collect() if not x.node.startswith("hub:")}
    works = lambda x: x[4] in ("procedure", "table") or x[6].startswith("Tighten") or "Remove" in x[6]
    warns, excepts = [x for x in rows if "WARNING" in x[6] or "CAUTION" in x[6]], [x for x in rows if "sub-class" in x[6]]
    near = {x[0]: {w[0] for w in warns if works(x) and w[1] == x[1] and (w[2] <= 4 or w[2] == x[2])} | {e[0] for e in excepts if x not in excepts and (e[1], e[3]) == (x[1], x[3])}
            | {n[0] for n in rows if n[6].startswith("NOTE:") and x[4] == "procedure" and (n[1], n[3]) == (x[1], x[3])} for x in rows}
    want = set()
    for x in rows:
        seen, todo = {x[0]}, [x[0]]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        want |= {(x[0], y) for y in seen}
    assert got == want
    counts = {x.src: (x.warnings, x.first) for x in L.warnings_of(u).collect()}
    for x in rows:
        own = sorted(w[0] for w in warns if works(x) and w[1] == x[1] and (w[2] <= 4 or w[2] == x[2]) and w[0] != x[0])
        assert counts.get(x[0]) == ((len(own), own[0]) if own else None)


def test_closure(spark):
    edges = [("owner", "setting", "2", None), ("setting", "matching", None, "2"), ("setting", "opposite", None, "1"), ("matching", "owner", None, None), ("x", None, None, None)]
    e = spark.createDataFrame(edges, "src string, dst string, required_value string, when_value string").withColumn("query_id", F.lit("clash"))
    s = spark.createDataFrame([(1, "owner", None), (2, "setting", None), (3, "x", None), (4, None, None)], "query_id long, node string, required_value string")
    got = defaultdict(set)
    for r in C.evidence_closure(e, s).collect():
        got[r.query_id].add(r.node)
    assert got == {1: {"owner", "setting", "matching"}, 2: {"owner", "setting", "matching", "opposite"}, 3: {"x"}}
    sizes = {r.query_id: (r.nodes, r.chars, r.too_large) for r in C.closure_sizes(C.evidence_closure(e, s), spark.createDataFrame([("owner", "x" * 9), ("setting", None)], "node string, text string"), 8).collect()}
    assert sizes[1] == (3, 9, True) and sizes[3] == (1, 0, False)
    assert C.evidence_closure(e, s.limit(0)).count() == 0


def test_long_closure_merges_rounds(spark):
    e = spark.createDataFrame([(i, i + 1, None, None) for i in range(12)], "src long, dst long, required_value string, when_value string")
    assert C.evidence_closure(e, spark.createDataFrame([(1, 0, None)], "query_id long, node long, required_value string")).count() == 13


def test_covered_blocks(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        x, y = r.uniform(0, 400), r.uniform(0, 400)
        rows.append((i, r.randint(0, 2), "table" if i % 6 == 0 else "block", x, y, x + r.uniform(5, 250), y + r.uniform(5, 250)))
    got = {x.box_id: x.covered for x in Y.covered_blocks(spark.createDataFrame(rows, "box_id int, page int, kind string, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect()}
    want = {}
    for i, p, k, x0, y0, x1, y1 in rows:
        if k == "block":
            s = max((max(0, min(x1, t[5]) - max(x0, t[3])) * max(0, min(y1, t[6]) - max(y0, t[4])) / ((x1 - x0) * (y1 - y0)) for t in rows if t[2] == "table" and t[1] == p), default=0)
            if s > 0.5:
                want[i] = s
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_blocks_and_notes(spark):
    schema = "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string"
    blocks = spark.createDataFrame([("d", 1, 10.0, 10.0, 200.0, 20.0, "Turn the wheel slowly and then"), ("d", 1, 10.0, 25.0, 220.0, 35.0, "stop the machine."), ("d", 1, 10.0, 40.0, 200.0, 50.0, "Next one starts."), ("d", 2, 0.0, 0.0, 9.0, 9.0, None)], schema)
    assert [(r.text, r.x1, r.y1) for r in Y.merged_blocks(blocks).orderBy("y0").collect()] == [("Turn the wheel slowly and then\nstop the machine.", 220.0, 35.0), ("Next one starts.", 200.0, 50.0)]
    alone = spark.createDataFrame([("d", 1, 10.0, 10.0, 60.0, 20.0, "WARNING"), ("d", 1, 80.0, 22.0, 200.0, 30.0, "Disconnect it"), ("d", 1, 80.0, 33.0, 150.0, 40.0, "1-2 Heading"), ("d", 1, 300.0, 10.0, 400.0, 20.0, "Other column, which goes on and"), ("d", 1, 302.0, 24.0, 400.0, 34.0, "on here.")], schema)
    assert sorted((r.text, r.x0, r.y1) for r in Y.merged_blocks(alone).collect()) == [("1-2 Heading", 80.0, 40.0), ("Other column, which goes on and\non here.", 300.0, 34.0), ("WARNING\nDisconnect it", 10.0, 30.0)]
    assert Y.merged_blocks(alone.limit(0)).count() == Y.footer_notes(alone).count() == 0
    lines = spark.createDataFrame([("d", 1, 10.0, 100.0, 200.0, 110.0, "(NOTE 1) First part"), ("d", 1, 20.0, 113.0, 200.0, 123.0, "goes on"), ("d", 1, 10.0, 125.0, 200.0, 135.0, "(NOTE 2) Second"), ("d", 1, 10.0, 160.0, 200.0, 170.0, "far away")], schema)
    assert [(r.text, r.y1) for r in Y.footer_notes(lines).orderBy("y0").collect()] == [("(NOTE 1) First part\ngoes on", 123.0), ("(NOTE 2) Second", 135.0)]


def test_tables(spark):
    df = spark.createDataFrame([("d", "m", 1, ["No.", "Item"], [["1", "a"], [None, "b"], ["3"]]), ("e", "m", 1, [], [])], "draft_id string, manual_id string, page int, table_headers array<string>, table_rows array<array<string>>")
    assert [r.text for r in Y.table_rows(df).orderBy("row").collect()] == ["No.: 1; Item: a", "No.: [merged/blank]; Item: b", "No.: 3; Item: [merged/blank]"]
    assert {(r.row, r.col): r.filled for r in Y.filled_cells(df).collect()} == {(0, 0): "1", (1, 0): "1", (2, 0): "3", (0, 1): "a", (1, 1): "b"}


def test_records(spark):
    q = spark.createDataFrame([("1", "answered", '[{"id": "m:1:0", "manual_id": "m", "page": 1}, {"id": "m:1:1", "manual_id": "m", "page": 1}]'), ("2", None, "[]"), ("3", "x", "broken"), ("4", "x", None), ("5", "x", '[{"id": "n:1:0", "manual_id": null, "page": 1}]')], "id string, status string, sources_json string")
    assert D.query_sources(q).count() == 6
    chunks = spark.createDataFrame([("m:1:0", "first"), ("m:1:1", "second"), ("m:1:0", "first")], "id string, text string")
    pages = {(r.query_id, r.manual_id): (r.n_chunks, r.text) for r in D.cited_pages(q, chunks).collect()}
    assert pages == {("1", "m"): (2, "first\n\nsecond"), ("5", None): (1, "")}
    assert {r.id for r in D.without_manuals(q, spark.createDataFrame([("m",)], "manual_id string")).collect()} == {"2", "3", "4", "5"}
    assert {r.id for r in D.without_manuals(q, spark.createDataFrame([("n",)], "manual_id string")).collect()} == {"1", "2", "3", "4"}
    cells = spark.createDataFrame([("=1",), ("  +x",), ("a=1",), (None,), ("",)], "c string").select(D.guarded(F.col("c")).alias("g")).collect()
    assert [r.g for r in cells] == ["'=1", "'  +x", "a=1", None, ""]
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, t string")
    assert D.digest(rows, "i", "t").first() == D.digest(rows.orderBy(F.desc("i")).repartition(3), "i", "t").first() != D.digest(rows.distinct(), "i", "t").first()
    assert D.digest(rows.limit(0), "i", "t").first().n == 0


def test_key_terms_and_intents(spark):
    from loomwright.operators import terms as T

    r = random.Random(3)
    rows = [("hot", f"{r.choice(['needle', 'Thread', 'সুতা'])} {i:03d} {'x' * r.randint(0, 40)}".strip()) for i in range(300)]
    rows += [("a", "Wheel"), ("a", "wheel"), ("a", "a, b"), ("a", "y" * 90), ("a", None), (None, "z"), ("b", "")]
    got = defaultdict(list)
    for x in T.key_terms(spark.createDataFrame(rows, "owner string, term string")).orderBy("owner", "position").collect():
        got[x.owner].append(x.term)
    want, size = [], 0
    for t in sorted({t for o, t in rows if o == "hot"}, key=str.lower):
        if len(want) < 32 and size + len(t.encode()) + 1 <= 480:
            want.append(t)
            size += len(t.encode()) + 1
    assert got == {"hot": want, "a": ["Wheel"]}
    asked = spark.createDataFrame([("The motor stops suddenly. The thread breaks at once! Thanks a lot.",), ("Why?",), (None,), (" ".join(f"The motor number {i} stops here." for i in range(5)),)], "q string")
    assert [x.i for x in asked.select(T.intents(F.col("q")).alias("i")).collect()] == [["The motor stops suddenly.", "The thread breaks at once!"], ["Why?"], None, None]
    more = spark.createDataFrame([("The needle hits the plate and the motor stops at once. Before that the thread was loose.",), ("The pedal is stuck now Additionally the oil drips down",), ("সুতা ছিঁড়ে যায় বারবার এবং মেশিন থেকে শব্দ হয়",)], "q string")
    assert [x.i for x in more.select(T.intents(F.col("q")).alias("i")).collect()] == [["The needle hits the plate", "the motor stops at once. Before that the thread was loose."], ["The pedal is stuck now", "Additionally the oil drips down"], ["সুতা ছিঁড়ে যায় বারবার", "মেশিন থেকে শব্দ হয়"]]


def test_pruned_ranks_equal_all_scores(spark):
    r = random.Random(9)
    common, rare = ["common", "usual", "often"], [f"rare{i}" for i in range(40)]
    docs = [(i, r.choice("ab"), " ".join([w for w in common if r.random() < 0.8] * r.randint(1, 4) + r.choices(rare, k=r.randint(0, 4)))) for i in range(150)] + [(900, "a", None), (901, None, "common rare1")]
    asked = [(i, r.choice("ab"), " ".join(r.sample(common, r.randint(0, 3)) + r.sample(rare, r.randint(0, 3)))) for i in range(30)] + [(50, "a", None), (51, "b", "common")]
    d, q = spark.createDataFrame(docs, "doc_id long, s string, text string"), spark.createDataFrame(asked, "query_id long, s string, question string")
    for scope in (None, "s"):
        every = R.bm25(d, q, scope=scope).withColumn("score", F.round("score", 6))
        want = {tuple(x) for x in R.top(every, F.col("score"), 5).select("query_id", "doc_id", "rank", "score").collect()}
        assert {tuple(x) for x in R.bm25_top(d, q, 5, scope=scope).select("query_id", "doc_id", "rank", "score").collect()} == want and want
    assert R.bm25_top(d.limit(0), q).count() == R.bm25_top(d, q.limit(0)).count() == 0


def test_ranks_cost_rows_not_pairs(spark, monkeypatch):
    """A term of all documents, which many ask: no table holds a row for each question and document. Documents and terms in parts."""
    written = []
    keep = R.materialise

    def counted(df, name):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(R, "materialise", counted)
    monkeypatch.setattr(R, "DOCS", 7)
    monkeypatch.setattr(R, "TERMS", 30)
    docs = spark.createDataFrame([(i, "common " * (i % 3 + 1) + f"w{i % 5}") for i in range(120)], "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(i, f"common w{i % 40}") for i in range(60)], "query_id long, question string")
    want = {tuple(x) for x in R.top(R.bm25(docs, asked).withColumn("score", F.round("score", 6)), F.col("score"), 4).select("query_id", "doc_id", "rank", "score").collect()}
    written.clear()
    assert {tuple(x) for x in R.bm25_top(docs, asked, 4).select("query_id", "doc_id", "rank", "score").collect()} == want
    assert max(written) < 60 * 120 / 10


def test_rows_of_one_query_and_of_one_document_count_together(spark):
    docs = spark.createDataFrame([("a", "wheel needle"), ("a", "wheel"), ("b", "wheel"), ("c", "needle needle")], "doc_id string, text string").repartition(3)
    once, twice = [("q", "wheel needle")], [("q", "wheel"), ("q", "wheel needle")]
    got = [[tuple(x) for x in R.bm25_top(docs, spark.createDataFrame(rows, "query_id string, question string")).orderBy("rank").collect()] for rows in (once, twice)]
    assert got[0] == got[1] and [x[1] for x in got[0]][0] == "a" and len(got[0]) == 3
    every = {x.doc_id: x.score for x in R.bm25(docs, spark.createDataFrame(once, "query_id string, question string")).collect()}
    assert all(abs(every[d] - s) < 1e-6 for _, d, s, _ in got[0])


def test_terms_are_counted_by_batches(spark, monkeypatch):
    """Counts of a batch's terms are made by array operations, so many terms at a time; no row is sorted by Spark, string by string."""
    r = random.Random(3)
    rows = [None if i % 9 == 4 else r.choices(["wheel", "কলম", "lever", "x"], k=i % 13) for i in range(60)] + [["wheel"] * 50]
    docs = spark.createDataFrame([(i, t and " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    plan = docs.sparkSession._jvm.PythonSQLUtils.explainString(R.term_counts(docs, "doc_id", "text")._jdf.queryExecution(), "extended")
    assert "array_sort" not in plan and "Sort" not in plan
    want = {(i, w, n, len(t)) for i, t in enumerate(rows) for w, n in Counter(t or []).items()}
    assert {tuple(x) for x in R.term_counts(docs, "doc_id", "text").select("doc_id", "term", "tf", "len").collect()} == want
    monkeypatch.setattr(R, "MOST", 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(61)), pa.array(rows, pa.list_(pa.string()))], ["doc_id", "t"])
    parts = list(R._counted(iter([batch.slice(0, 30), batch.slice(30), batch.slice(0, 0)])))
    got = [x for p in parts for x in p.to_pylist()]
    assert len(parts) > 10 and [x["doc_id"] for x in got] == list(range(61)) and [x["len"] for x in got] == [None if t is None else len(t) for t in rows]
    assert {(x["doc_id"], y["term"], y["tf"], x["len"]) for x in got for y in x["run"]} == want


def test_words_are_parted_as_spark_parts_them(spark, monkeypatch):
    """Words come from Arrow batches, not from Spark's arrays of strings; the terms are those of tokens()."""
    pieces = ["Wheels", "glass", "buses", "is", "The", "as", "কলম", "x_1", "é", "İs", "²", " ", "--", "\n", "ss", "gas", "Straße", "ΣΑΣ", "s", "\u00ad", "٣"]
    r = random.Random(8)
    texts = [None, "", " ", "the", *["".join(r.choices(pieces, k=r.randint(0, 12))) + " ".join(r.choices(pieces, k=r.randint(0, 12))) for _ in range(200)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert "extract_all" not in spark._jvm.PythonSQLUtils.explainString(R._runs(docs, "doc_id", "text")._jdf.queryExecution(), "extended")
    want = {x.doc_id: x.t for x in docs.select("doc_id", tokens(F.col("text")).alias("t")).collect()}
    got = {x.doc_id: (Counter({y.term: y.tf for y in x.run}), x.len) for x in R._runs(docs, "doc_id", "text").collect()}
    assert got == {i: (Counter(t or []), None if t is None else len(t)) for i, t in want.items()}
    monkeypatch.setattr(R, "MOST_BYTES", 40)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t and t.lower() for t in texts])], ["doc_id", "t"])
    parts = list(R._worded(iter([batch.slice(0, 50), batch.slice(50), batch.slice(0, 0)])))
    assert len(parts) > 50 and [x["doc_id"] for p in parts for x in p.to_pylist()] == list(range(len(texts)))


def test_search_keeps_as_many_rows_however_many_tasks_read(spark):
    """What is shuffled is k rows of a set for each task that can run at once, not for each part of the documents."""
    docs = spark.createDataFrame([(i, f"wheel w{i}") for i in range(400)], "doc_id long, text string").repartition(40)
    asked = spark.createDataFrame([(1, "wheel"), (2, "w7 wheel")], "query_id long, question string")
    found = R.bm25_top(docs, asked, 3)
    assert {(x.query_id, x.doc_id, x.rank) for x in found.collect()} == {(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 7, 1), (2, 0, 2), (2, 1, 3)}
    assert "Coalesce" in spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "extended")


def test_unique_target_against_brute_force(spark):
    r = random.Random(4)
    owners = [(r.randint(0, 25), r.choice("kl"), r.choice([1, 2, 3, None])) for _ in range(70)]
    targets = [(r.choice("kkl"), f"t{i:02}", r.choice([1, 2, 3, None]), r.choice(["text", "vlm", "vlm"]), r.choice(["One  word", "One word", "two"])) for i in range(9)]
    for seed in range(4):
        some = random.Random(seed).sample(targets, 2 + seed)
        want = set()
        for o, page in {(o, p) for o, _, p in owners}:
            keys = {k for a, k, p in owners if (a, p) == (o, page)}
            met = [t for t in some if t[0] in keys]
            met = [t for t in met if t[3] == "text"] or met
            wordings = {(p, " ".join(w.split())): max(t for _, t, q, _, v in met if (q, v.split()) == (p, w.split())) for _, _, p, _, w in met}
            here = [t for (p, _), t in wordings.items() if p is not None and p == page]
            for one in (list(wordings.values()), here):
                if len(one) == 1:
                    want.add((o, one[0]))
                    break
        a, b = spark.createDataFrame(owners, "o int, k string, page int"), spark.createDataFrame(some, "k string, target string, t_page int, t_method string, t_text string")
        assert {tuple(x) for x in L.unique_target(a, b, ["o"], ["k"]).collect()} == want


def _shuffled(spark, run):
    """The most rows that a stage of ``run`` writes for another one."""
    sc = spark.sparkContext

    def listed():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found, it = {}, sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None).iterator()
        while it.hasNext():
            s = it.next()
            found[s.stageId()] = s.shuffleWriteRecords()
        return found

    before = listed()
    run()
    return max(n for i, n in listed().items() if i not in before)


def _crowd(spark):
    """A manual's section of 300 notes and settings of one number, to which 300 units refer."""
    notes = [(f"n{i}", "m", "s", 9, "information", "text", f"(NOTE 2) wording {i}") for i in range(300)]
    rows = [(f"t{i}", "m", "s", 9, "table", "text", f"No.: 4; Setting range: {i}") for i in range(300)]
    users = [(f"u{i}", "m", "s", 1, "procedure", "text", 'See NOTE 2. Only enabled when Function No. 4 is set to "1".') for i in range(300)]
    return spark.createDataFrame(notes + rows + users, "unit_id string, manual_id string, section_key string, page int, kind string, extraction_method string, text string").withColumn("blocked", F.lit(0))


def test_notes_and_settings_of_a_crowd_build_no_pairs(spark, monkeypatch):
    u = _crowd(spark)
    found = []
    most = _shuffled(spark, lambda: found.extend([L.note_edges(u).collect(), L.requirement_edges(u).collect()]))
    assert found == [[], []] and most < 3_000


def test_manifest_and_issues_of_a_crowd(spark, monkeypatch):
    from loomwright.plans import units as U

    monkeypatch.setattr(U, "_units", lambda *_: _crowd(spark))
    rows = []
    most = _shuffled(spark, lambda: rows.extend([U.release_manifest(spark, "", lambda *_: _crowd(spark)).collect(), U.blocking_issues(spark, "").collect()]))
    assert [(x.units, x.tables, x.note_edges, x.prerequisite_edges) for x in rows[0]] == [(900, 300, 0, 0)]
    assert sorted(tuple(x) for x in rows[1]) == sorted([(f"u{i}", s) for i in range(300) for s in ("note 2", "setting function:4")]) and most < 3_000
