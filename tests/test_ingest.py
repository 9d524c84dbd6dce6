"""Units from drafts, claims, context and checks, on small tables with nulls, repeats and ties."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwright.functions import text as X
from loomwright.operators import ingest as I
from loomwright.plans.views import given_units

DRAFT = "draft_id string, manual_id string, page int, kind string, title string, text string, parent_key string, section_key string, table_headers array<string>, table_rows array<array<string>>"


def test_paragraphs(spark):
    long = " ".join(f"Sentence {i} has just six words." for i in range(60))
    t = f" First one.\n\nSecond\n(NOTE 2) A note.\n* 3 Star note\n\n{long}\n\n"
    got = spark.createDataFrame([(t,), (None,), ("",), ("x " * 300,)], "t string").select(I.paragraphs(F.col("t")).alias("p")).collect()
    assert got[0].p[:4] == ["First one.", "Second", "(NOTE 2) A note.", "* 3 Star note"]
    assert all(len(p.split()) <= 250 for p in got[0].p) and " ".join(got[0].p[4:]) == long and len(got[0].p) == 6
    assert got[1].p is None and got[2].p == [] and [len(p.split()) for p in got[3].p] == [300]


def test_drafts(spark):
    rows = [("a", "m", 1, "table", "T", "x", None, "2-1", ["No.", "Setting range"], [["7", "0-3"], ["8", None]]), ("b", "m", 1, "table", "T", "x", "a", None, ["No."], [["7"]]), ("c", "m", 1, "information", "t", "y" * 3000, None, "", None, None),
            ("d", "m", 2, "information", None, "z" * 3000, None, "3-1", [], []), ("e", "m", 2, "procedure", "t", "w" * 900, None, "3-2", [], []), ("f", "m", 2, "information", "t", None, None, "3-2", [], []), ("f", "m", 2, "information", "t", None, None, "3-2", [], []), ("g", "m", 2, "information", "t", "q" * 1500, None, "3", [], [])]
    d = spark.createDataFrame(rows, DRAFT).withColumn("row", F.lit("clash"))
    assert {(r.draft_id, r.searchable) for r in I.searchable(d).collect()} == {("a", False), ("b", True), ("c", True), ("d", True), ("e", True), ("f", True), ("g", True)}
    assert {(r.unit_id, r.parent_id) for r in I.table_units(d).collect()} == {("a", None), ("a#0", "a"), ("a#1", "a"), ("b", None), ("b#0", "b")}
    assert {r.draft_id: (r.section_key, r.inherited) for r in I.inherited_sections(d).collect() if r.draft_id in "abcf"} == {"a": ("2-1", False), "b": ("2-1", True), "c": ("2-1", True), "f": ("3-2", False)}
    got = {}
    for r in I.section_context(d).orderBy("draft_id", "position").collect():
        got.setdefault(r.draft_id, []).append(r.sibling)
    # of d, e, f and g, in order, those that fit into 4,000 characters
    assert got == {"d": ["e", "f", "g"], "e": ["d", "f"], "f": ["d", "e"], "g": ["d", "e", "f"]}
    declared = {tuple(r) for r in I.declared_settings(d).collect()}
    assert declared == {("m", "function:7", 0, 3)}
    claims = I.setting_claims(spark.createDataFrame([("p", "m", 1, "Set Function No. 7 to 2 and set function no 7 to 9."), ("q", "m", 1, "set Function No. 9 to 1"), ("r", "m", 1, None)], "item_id string, manual_id string, page int, text string"))
    assert {tuple(r) for r in I.claim_support(claims, I.declared_settings(d)).collect()} == {("p", "function:7", 2, "supported"), ("p", "function:7", 9, "out_of_range"), ("q", "function:9", 1, "undeclared")}
    assert I.section_context(d.limit(0)).count() == I.table_units(d.limit(0)).count() == 0


def test_questions_and_translations(spark):
    rows = [("হাঁটু দিয়ে সুতা কাটলে থামে না", "It does not stop after the knee lever is used"), ("Function No. 7 is set to 3, 4 mm", "Function No. 7 = 2, 4 cm"), ("Не стоп", "It is not stopped"), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b string").select(I.missing_terms(F.col("a"), F.col("b")).alias("m"), *I.drift(F.col("a"), F.col("b")))
    got = df.collect()
    assert got[0].m == [r"সুতা\s*কাট"] and not got[0].concepts_same and got[0].negation_same and got[0].bindings_kept
    assert not got[1].bindings_kept and not got[1].units_same and got[1].concepts_same
    assert got[2].concepts_same and got[2].negation_same  # another script: only what the question has must be kept
    q = spark.createDataFrame([("It makes a loud noise", "Electrical noise may occur"), ("It makes a loud noise", "The belt makes sounds"), ("speed at pitch 5 mm", "pitch 4 or less"), (None, "x")], "q string, t string")
    assert [r.k for r in q.select(I.kept_evidence(F.col("q"), F.col("t")).alias("k")).collect()] == [False, True, False, True]
    assert spark.createDataFrame([("a (all models) b\nc (x)\nd (see specification 3)",)], "t string").select(I.scope_lines(F.col("t")).alias("s")).first().s == ["a (all models) b", "d (see specification 3)"]


def test_merged_cells_and_corroboration(spark):
    cells = [("t", 0, 0, "head", 0.0, 40.0), ("t", 0, 1, "a", 0.0, 10.0), ("t", 1, 0, None, None, None), ("t", 1, 1, None, None, None), ("t", 2, 0, "x", 40.0, 50.0), ("t", 2, 1, "b", 30.0, 50.0), ("t", 1, 2, "c", 12.0, 20.0)]
    got = {(r.row, r.col): (r.text, r.from_row) for r in I.recovered_cells(spark.createDataFrame(cells, "table_id string, row int, col int, text string, y0 double, y1 double")).collect()}
    assert got[(1, 0)] == ("head", 0) and got[(1, 1)] == (None, None) and got[(0, 1)] == ("a", None)
    side = lambda name, rows: spark.createDataFrame(rows, f"{name}_id string, page_key string, headers array<string>, cells array<string>")
    visual = side("visual", [("v1", "p", ["No.", "Item"], ["7", "Oil ga"]), ("v2", "p", ["No.", "Other"], ["7", "x"]), ("v3", "p", ["No.", "Item"], ["7", "wheel"])])
    native = side("native", [("n", "p", ["NO.", "item", "Range"], ["7", "oil gauge", None]), ("m", "q", ["No.", "Item"], ["7", "Oil ga"])])
    assert {tuple(r) for r in I.corroborated(visual, native).collect()} == {("v1", "n")}


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 1)], "k string, v int")
    assert {tuple(r) for r in I.snapshot_changes(old, new, ["k"], "v").collect()} == {("b", "changed"), ("d", "added")}
    assert {tuple(r) for r in I.snapshot_changes(old, new.limit(0), ["k"], "v").collect()} == {("a", "removed"), ("b", "removed"), ("c", "removed")}


def test_search_from_question_to_evidence(spark, tmp_path):
    chunks = [("m:1:0", "m", 1, 0, "WARNING: hot surface", "text"), ("m:5:0", "m", 5, 0, "Adjust the zigzag cam, see NOTE 1\n(NOTE 1) Slowly.", "text"), ("m:5:1", "m", 5, 1, "zigzag cam of sub-class -45B is not required", "text"), ("m:6:0", "m", 6, 0, "Electrical noise at the zigzag cam", "text"), ("m:7:0", "m", 7, 0, None, "text")]
    spark.createDataFrame(chunks, "id string, manual_id string, page int, ordinal int, text string, extraction string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([], "draft_id string, manual_id string, page int, kind string, title string, text string, condition_text string, cause string, checks array<string>, actions array<string>, warnings array<string>, table_headers array<string>, table_rows array<array<string>>, parent_key string, section_key string").write.parquet(str(tmp_path / "unit_drafts.parquet"))
    asked = [("00000000000000000000000000000014", "Why does the zigzag cam make a loud noise on sub-class -45B?"), ("00000000000000010000000000000004", "zigzag"), ("15", "zigzag"), ("1e", None)]
    spark.createDataFrame(asked, "id string, question string").write.parquet(str(tmp_path / "queries.parquet"))
    got = {(r.query_id[-2:], r.node, r.via, r.applicability) for r in entry.queries()["evidence_search"](spark, str(tmp_path)).collect()}
    assert {x for x in got if x[0] == "14"} == {("14", "m:5:0#0", "match", "not_established"), ("14", "m:5:1#0", "match", "excluded"), ("14", "m:5:0#1", "needed", "not_established"), ("14", "m:1:0#0", "needed", "not_established")}
    assert {x[1] for x in got if x[0] == "04"} >= {"m:5:0#0", "m:6:0#0"} and {x[0] for x in got} == {"14", "04"}


def test_given_units_shuffle_texts_once(spark, tmp_path):
    chunks = [("c", "m", 1, 0, "One\n\nTwo", "text")] * 2 + [("n", "m", 1, 0, None, "text")]
    spark.createDataFrame(chunks, "id string, manual_id string, page int, ordinal int, text string, extraction string").write.parquet(str(tmp_path / "chunks.parquet"))
    # two drafts of one id: a row belongs to the section of its own
    draft = lambda section, cell: ("d", "m", 2, "table", "t", "x", None, None, None, None, None, ["h"], [[cell]], None, section)
    spark.createDataFrame([draft("1", "a"), draft("2", "b"), draft("1", "a")], "draft_id string, manual_id string, page int, kind string, title string, text string, condition_text string, cause string, checks array<string>, actions array<string>, warnings array<string>, table_headers array<string>, table_rows array<array<string>>, parent_key string, section_key string").write.parquet(str(tmp_path / "unit_drafts.parquet"))
    u = given_units(spark, str(tmp_path))
    assert sorted((x.unit_id, x.section_key, x.text) for x in u.collect()) == [("c#0", "", "One"), ("c#1", "", "Two"), ("d", "1", "x"), ("d", "2", "x"), ("d#0", "1", "h: a"), ("d#0", "2", "h: b")]
    assert u._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1


def test_reduced_texts_are_judged_as_whole_ones(spark):
    questions = ["It makes a loud noise", "Which function makes a loud noise?", "speed at pitch 5 mm", "electrical noise", "x", None]
    texts = ["Electrical  noise may occur", "electrical noise and sounds", "See function settings", "FUNCTION No. 4", "function", "Pitch 4 or less", "more than pitch 4", "The belt", "", None,
             "sub-class -45B", "(-4[]A/5[]B)", "Sub class -45", "-4□", "not required for class", "why?", "-4?B", "(-45B)", "a [x] b"]
    df = spark.createDataFrame([(q, t) for q in questions for t in texts], "q string, t string")
    r = df.select("t", I.kept_evidence(F.col("q"), F.col("t")).alias("a"), I.kept_evidence(F.col("q"), I.judged_text(F.col("t"))).alias("b"), I.judged_text(F.col("t")).alias("j"), F.coalesce(X.model_patterns(F.col("t")), F.array().cast("array<string>")).alias("p"), I.scoped_patterns(F.col("t")).alias("s")).collect()
    assert all(x.a == x.b and x.p == x.s for x in r) and {x.a for x in r} == {True, False} and any(x.p for x in r)
    assert {x.t for x in r if x.j == ""} >= {"The belt", "function", None}
