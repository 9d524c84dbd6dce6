"""Problems 3, 4, 6: lines, look-alikes, pieces; also nulls, empty tables, repeated rows and clashing columns."""

import re

import pytest
from pyspark.sql import functions as F

from loomwright.llm import boilerplate, lookalikes, splitting


def _chunks(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "id string, manual_id string, text string")
    return df.withColumn("line_no", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("cluster", F.lit(2)) if extra else df


def test_repeated_lines(spark):
    rows = [(f"a{i}", "a", f"Text number {'xyzuvwpqrs'[i]} body\n\n(c) {2000 + i}  ACME works.\n" + ("shared" if i < 4 else "own " + "xyzuvwpqrs"[i])) for i in range(10)]
    rows += [("a0", "a", rows[0][2])] * 2  # delivered again
    rows += [(f"r{i}", "b", "same whole text\nagain") for i in range(9)]  # one text under nine ids is one document
    rows += [("n", "a", None), ("e", "a", ""), ("m", None, "x"), ("d", "a", "12\n--")]
    found = {(r.doc_id, r.line_no) for r in boilerplate.repeated_lines(_chunks(spark, rows)).collect()}
    assert found == {(f"a{i}", 3) for i in range(10)}
    clean = {r.doc_id: (r.text, r.removed) for r in boilerplate.without_repeated_lines(_chunks(spark, rows)).collect()}
    assert clean["a9"] == ("Text number s body\n\nown s", 1) and clean["n"] == (None, 0) and clean["e"] == ("", 0) and len(clean) == 23
    assert boilerplate.repeated_lines(_chunks(spark, [])).count() == 0


def test_lines_of_a_hot_source_against_brute_force(spark):
    rows = [(f"h{i}", "hot", "\n".join(["Every page", f"w{i % 7}x".replace(str(i % 7), "abcdefg"[i % 7]), "z" * (i + 1)])) for i in range(60)]
    found = {(r.doc_id, r.line_no) for r in boilerplate.repeated_lines(_chunks(spark, rows)).collect()}
    letters = lambda s: "".join(c for c in s.lower() if c.isalpha())
    count = {}
    for i, m, t in rows:
        for k in {letters(x) for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
    assert found == {(i, n) for i, m, t in rows for n, x in enumerate(t.split("\n"), 1) if count[letters(x)] >= max(5, 6)}


def test_look_same(spark):
    rows = [
        ("1", "Open the lid of K-5071-7", None), ("2", "Оpen the lid of К-5071-7", None), ("3", "Open the lid of K‑5071-7​", "Open the lid of K-5071-7"),
        ("4", "open the lid of K-5071-7", None), ("5", "Open  the lid of K-5071-7", None), ("6", "Open the lid of K-5071-8", None), ("7", "Ｏpen the lid of K-5071-7", None),
        ("8", "Où est la pédale ?", None), ("9", "Où est la pédale ?", None), ("10", "Ou est la pedale ?", None), ("11", "", "​"), ("12", None, None), ("13", " ", ""),
        ("14", "Open the lid of K-5071-7", "Open the lid of K-5071-7"), ("15", "мост", None),
    ]
    df = spark.createDataFrame(rows + rows[:3], "id string, question string, search_question string").withColumn("form", F.lit(0)).withColumn("look", F.lit(0))
    got = {(r.query_id, r.other_id) for r in lookalikes.look_same(df).collect()}
    same = [("1", "14"), ("2",), ("3",), ("7",)]
    want = {tuple(sorted((a, b))) for i, x in enumerate(same) for y in same[i + 1 :] for a in x for b in y} | {("8", "9"), ("3", "3")}
    assert got == want
    forms = {(r.id, r.name): r.form for r in lookalikes.unified(df, "id", "question").collect()}
    assert forms[("15", "question")] == "мост" and forms[("2", "question")] == "Open the lid of K-5071-7"
    assert lookalikes.look_same(df.limit(0)).count() == 0


def test_repairs_go_to_the_dominant_script(spark):
    rows = [("1", "двигатель и крышка"), ("2", "двигaтель и крышка"), ("3", "the thread of\u0456t"), ("4", "The \u0430rm"), ("5", "The arm"), ("6", "ва\u0441uum pump"), ("7", "vacuum"), ("8", "кnown сare"), ("9", "Xαρά")]
    form = {r.id: r.form for r in lookalikes.unified(spark.createDataFrame(rows, "id string, q string"), "id", "q").collect()}
    assert form["2"] == form["1"] and form["4"] == form["5"]
    # no word of the corpus comes out: nothing is done
    assert form["3"] == "the thread of\u0456t" and form["6"] == "ва\u0441uum pump" and form["8"] == "кnown сare" and form["9"] == "Xαρά"


def test_pieces(spark):
    s = "Turn the wheel by hand and check No. 5 at 0.35 mm. "
    rows = [("a", s * 40), ("a", s * 40), ("b", "x" * 3000), ("c", None), ("d", " \n "), ("e", "short  \t text"), ("f", ("word " * 30).strip() + ", "), ("g", ("অংশ খুলে নিন। " * 120)), ("h", "para one.\n\n" + "long " * 150 + "\n\n" + "tail " * 150), ("i", "one two " * 200 + ". End here.")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("ordinal", F.lit(9)).withColumn("seg", F.lit(9))
    got = {}
    for r in splitting.pieces(df, "id", "text").collect():
        got.setdefault(r.item_id, {})[r.ordinal] = r.text
    assert set(got) == {"a", "b", "e", "f", "g", "h", "i"} and got["e"] == {0: "short text"}
    texts = {i: re.sub(r"[ \t]+", " ", t or "").strip() for i, t in rows}
    for i, parts in got.items():
        parts = [parts[k] for k in range(len(parts))]
        assert all(0 < len(p) <= 1100 for p in parts)
        whole = parts[0]
        for p in parts[1:]:  # what a piece repeats is at most 180 characters of the one before
            tight = re.sub(r"\s+", "", p)
            k = next(k for k in range(180, -1, -1) if re.sub(r"\s+", "", whole).endswith(tight[:k]) and (k == 0 or tight[:k]))
            whole = re.sub(r"\s+", "", whole) + tight[k:]
        assert len(re.sub(r"\s+", "", whole)) <= len(re.sub(r"\s+", "", texts[i]))
    kinds = {r.item_id: r.cut for r in splitting.cut_kinds(df, "id", "text").collect()}
    assert kinds == {"a": "natural", "b": "forced", "g": "natural", "h": "natural", "i": "forced"}
    assert splitting.cut_kinds(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("text", ["a" * 5000, "ab. " * 700, "\n".join(["line"] * 900), "😀" * 2500])
def test_segments_give_the_text_back(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(splitting.segments(F.col("t")).alias("s")).first()
    assert "".join(row.s) == text and all(len(x) <= 1130 for x in row.s)


def test_republished_articles_are_no_boilerplate(spark):
    rows = [(f"a{d}", "s", "The same story\nfrom line to line", f"2025-01-0{d}") for d in range(1, 8)]
    rows += [(f"b{d}", "s", f"Story {'x' * d}\nShare this page", f"2025-02-0{d}") for d in range(1, 6)]
    rows += [(f"c{d}", "s", f"Report {'y' * d}\nOnly today", "2025-03-01") for d in range(1, 6)]
    df = spark.createDataFrame(rows, "id string, manual_id string, text string, published string")
    found = {(r.doc_id, r.line_no) for r in boilerplate.repeated_lines(df, published="published").collect()}
    assert found == {(f"b{d}", 2) for d in range(1, 6)}
    assert {r.doc_id[0] for r in boilerplate.repeated_lines(df).collect()} == {"b", "c"}
