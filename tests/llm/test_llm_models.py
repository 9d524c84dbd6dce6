"""Problems 1, 2, 5, 9: languages, pair defects, scanned text, reading levels, on small made corpora with known answers."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import language, ocr, pairs, reading, sampling

NOUNS = {
    "en": ["needle", "thread", "wheel", "cover", "bobbin", "lever", "motor", "spring"],
    "de": ["Nadel", "Faden", "Handrad", "Abdeckung", "Spule", "Hebel", "Motor", "Feder"],
    "fr": ["aiguille", "courroie", "manivelle", "pédale", "bobine", "plaque", "griffe", "canette"],
    "es": ["aguja", "correa", "palanca", "placa", "bobina", "tapa", "polea", "caja"],
    "bn": ["সুচ", "সুতা", "চাকা", "ঢাকনা", "ববিন", "লিভার", "মোটর", "বেল্ট"],
}
FRAMES = {
    "en": ["Turn the {} slowly and check the {} for wear.", "Remove the {} before the {} is cleaned with a brush.", "The {} must not touch the {} while it is running."],
    "de": ["Drehen Sie {} langsam und prüfen Sie dabei {} auf Verschleiß.", "Entfernen Sie zuerst {} und reinigen Sie danach {} gründlich.", "Während des Betriebs darf {} niemals {} berühren."],
    "fr": ["Tournez la {} lentement puis vérifiez que la {} ne soit pas usée.", "Retirez la {} avant de nettoyer la {} avec une brosse.", "Pendant la marche la {} ne doit jamais toucher la {}."],
    "es": ["Gire la {} despacio y compruebe que la {} no esté gastada.", "Retire la {} antes de limpiar la {} con un cepillo.", "Durante el trabajo la {} no debe tocar nunca la {}."],
    "bn": ["{} ধীরে ঘুরিয়ে দেখুন {} ক্ষয় হয়েছে কি না।", "{} পরিষ্কার করার আগে {} খুলে রাখুন।", "চলার সময় {} যেন {} স্পর্শ না করে।"],
}


def text(r, lang, n):
    return " ".join(r.choice(FRAMES[lang]).format(*r.sample(NOUNS[lang], 2)) for _ in range(n))


@pytest.fixture(scope="module")
def items(spark):
    r = random.Random(3)
    rows = []
    for i in range(240):
        lang = r.choice(list(NOUNS))
        label = {0: None, 1: "xx", 2: r.choice(list(NOUNS)), 3: {"en": "English", "de": "de-DE", "fr": "fra", "es": "Spanish", "bn": "Bangla"}[lang]}.get(i % 10, lang)
        if i % 8 == 5:
            other = r.choice([x for x in NOUNS if x != lang])
            rows.append((str(i), label, text(r, lang, 3) + " " + text(r, other, 2) + "\n" + text(r, lang, 2), f"{lang} {other} {lang}"))
        else:
            rows.append((str(i), label, text(r, lang, r.randint(3, 7)), lang))
    rows += [("null", "en", None, ""), ("empty", "en", "", ""), ("dump", "en", "0xA3 D4 40\n1.2\t3.4\n▲■ 77", ""), ("long", "de", text(r, "en", 3000), "en")]
    return rows, spark.createDataFrame([x[:3] for x in rows], "item_id string, label string, text string").withColumn("item_table", F.lit("t")).withColumn("seg_no", F.lit("clash")).withColumn("lang", F.lit("clash"))


def test_languages(spark, items):
    rows, df = items
    got = {}
    for x in language.mislabelled(df).collect():
        got.setdefault(x.item_id, {})[x.seg_no] = x.lang
        assert 0.5 <= x.confidence <= 1
    code = {"English": "en", "de-DE": "de", "fra": "fr", "Spanish": "es", "Bangla": "bn"}
    want = {i: dict(enumerate(t.split(), 1)) for i, label, _, t in rows if t and (" " in t or code.get(label, label) != t)}
    assert sum(got.get(i) == w for i, w in want.items()) >= 0.97 * len(want)
    assert len(set(got) - set(want)) <= 0.03 * len(want) and not {"null", "empty", "dump"} & set(got)
    assert language.mislabelled(df.limit(0)).count() == 0


def test_suffix_automaton_spells_every_stretch():
    r = random.Random(2)
    seq = [r.randint(0, 3) for _ in range(60)]
    states = language.suffix_automaton(seq)
    pieces = {tuple(seq[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}

    def spelt(p):
        s = 0
        for c in p:
            if c not in states[s]:
                return False
            s = states[s][c]
        return True

    assert all(spelt(p) for p in pieces)
    assert all(spelt(p) == (p in pieces) for p in (tuple(r.randint(0, 3) for _ in range(5)) for _ in range(300)))


def test_phrases_equal_a_plain_parse():
    texts = {("en", False): text(random.Random(1), "en", 20), ("de", False): text(random.Random(1), "de", 20)}
    parser = language.CrossParser(language._letters(iter(texts.values())), texts)
    trained = {c: bytes(parser.symbols.of([t])[0].tolist()) for c, t in texts.items()}
    probe = [text(random.Random(9), "en", 1), "Zebra", "", text(random.Random(9), "de", 2)]
    got = parser.phrases(probe)
    for i, t in enumerate(probe):
        sym = bytes(parser.symbols.of([t])[0].tolist())
        for k, c in enumerate(parser.classes):
            n, at = 0, 0
            while at < len(sym):
                end = at + 1
                while end < len(sym) and sym[at : end + 1] in trained[c]:
                    end += 1
                n, at = n + 1, end
            assert abs(got[i, k] * len(sym) / parser.tables[k][3] - n) < 1e-6


def test_pair_defects(spark):
    r = random.Random(4)
    ask = {"en": "How do I adjust the {} when the {} is worn?", "de": "Wie stelle ich {} ein, wenn {} verschlissen ist?", "fr": "Comment régler la {} quand la {} est usée ?", "es": "¿Cómo ajusto la {} si la {} está gastada?", "bn": "{} কীভাবে ঠিক করব যখন {} ক্ষয় হয়?"}
    rows, want = [], {}
    for i in range(900):
        lang = r.choice(list(NOUNS))
        q, a = ask[lang].format(*r.sample(NOUNS[lang], 2)), text(r, lang, r.randint(1, 3)) + r.choice(["", " [1][2]", " (p. 12)"])
        kind = {0: "empty", 1: "truncated", 2: "refusal", 3: "copy", 4: "wrong_language"}.get(i % 45)
        if kind == "empty":
            a = r.choice([None, "", "N/A", "<p></p>", "​", "..."])
        elif kind == "truncated":
            a = a[: r.randint(12, max(13, len(a.split(" [")[0].split(" (")[0]) - 6))].rstrip(" .।")
        elif kind == "refusal":
            a = {"en": "Sorry, I am unable to answer this question.", "de": "Leider kann ich diese Frage nicht beantworten.", "fr": "Désolé, je ne peux pas répondre à cette demande.", "es": "Lo siento, no puedo ayudar con este tema.", "bn": "দুঃখিত, আমি এই প্রশ্নের উত্তর দিতে পারছি না।"}[lang]
        elif kind == "copy":
            a = r.choice([q, f"Q: {q}", q.upper()])
        elif kind == "wrong_language":
            a = text(r, r.choice([x for x in NOUNS if x != lang]), 2)
        rows.append((str(i), q, a, r.choice(["answered", " Answered"])))
        if kind:
            want[str(i)] = kind
    rows += [("x", "q", "N/A", "refused"), ("y", None, text(r, "en", 2), "answered"), ("z", "", text(r, "en", 20_000 // 40), "answered"), ("w", "q", "", None)]
    labels = spark.createDataFrame([(lang, text(r, lang, 4)) for lang in NOUNS for _ in range(60)], "label string, text string")
    df = spark.createDataFrame(rows, "id string, question string, answer string, status string").withColumn("defect", F.lit("clash"))
    got = {x.query_id: x.defect for x in pairs.defects(df, labels).collect()}
    right = sum(got.get(i) == k for i, k in want.items())
    assert right >= 0.85 * len(want), (right, len(want))
    assert len(set(got) - set(want)) <= 0.15 * len(want) and not {"x", "w", "y", "z"} & set(got)
    assert pairs.defects(df.limit(0), labels).count() == 0


def test_refusals_of_unseen_wordings():
    r = random.Random(5)
    sound = [(f"How do I adjust the {r.choice(NOUNS['en'])}?", text(r, lang, r.randint(1, 3))) for lang in NOUNS for _ in range(120)]
    held = lambda how: zlib.crc32(how.encode()) % 4 == 1
    model = pairs.PairModel(sound, [], None, held=held)
    unseen = pairs.refusals(np.random.default_rng(1), 300, lambda how: not held(how))
    judged = model.judge(["How?"] * 300, unseen, None)
    assert sum(j is not None and j[0] == "refusal" for j in judged) >= 0.9 * 300
    fresh = [text(r, lang, 2) for lang in NOUNS for _ in range(40)]
    assert sum(j is not None for j in model.judge(["How?"] * len(fresh), fresh, None)) <= 0.02 * len(fresh)


def test_refusals_tell_nothing_of_languages():
    r = random.Random(4)
    langs = [r.choice(list(NOUNS)) for _ in range(600)]
    parser = language.CrossParser(*language.fit([(lang, text(r, lang, 4)) for lang in langs]))
    sound = [(text(r, lang, 1) + f" No {i}?", text(r, lang, 2)) for i, lang in enumerate(langs)]
    asked = [text(r, lang, 1) + "?" for lang in langs[:50]]
    other = [text(r, r.choice([x for x in NOUNS if x != lang]), 2) for lang in langs[:50]]
    for seed in range(3):
        model = pairs.PairModel(sound, [], parser, seed=seed)
        margin = lambda answers: model._margins(answers, pairs.features(asked, [(a, False) for a in answers], parser))[:, pairs.DEFECTS.index("wrong_language")]  # noqa: B023, E731
        # made refusals are in any language; the cut stays clear of the pairs on both sides of it
        assert np.quantile(margin(other), 0.1) > 0.5 and margin([text(r, lang, 2) for lang in langs[:50]]).max() < -0.5


def test_sample_of_a_text_that_is_repeated(spark):
    rows = [("en", f"text {i}") for i in range(300)] + [("en", "text 7")] * 3000 + [(None, "x")]
    got = sampling.first_by_hash(spark.createDataFrame(rows, "lang string, text string").withColumn("extra", F.lit(1)), 20, ["lang"], ["text"]).collect()
    assert len({x.text for x in got if x.lang}) == sum(x.lang is not None for x in got) == 20 and sum(x.lang is None for x in got) == 1


@pytest.mark.parametrize("question, lang", [("How? Please answer in Bengali.", "bn"), ("O quê? (máquina nº A9) Responda em inglês, por favor.", "en"), ("How? Do not answer in English, use Bengali.", "bn"), ("কীভাবে? ইংরেজিতে উত্তর দিন।", "en"), ("Comment ? Répondez en anglais.", "en"), ("The English thread?", None), ("", None)])
def test_requested_language(question, lang):
    assert pairs.requested(question) == lang


def test_headers_run_over_pages(spark):
    parts = ["Nadelstange", "Greifer", "Spule", "Hebel", "Feder", "Riemen", "Motor", "Deckel"]
    body = "the wheel is turned slowly until the mark is level with the edge of the plate"
    rows = [(f"o{i}", f"Thread Tension {i}\n{body}\nSchmieren Sie {parts[i]}, {parts[-1 - i]}\nOil {parts[i]}\n{i + 1}", "ocr-eng") for i in range(4)]
    rows += [("m", f"Thrcad Tensiom\n{body}", "ocr-eng"), ("t", f"Check The Bobbin Winder\n{body}", "ocr-eng"), ("c", f"{body}. {body}", "text"), ("n", None, "ocr-eng"), ("b", " ", "ocr-eng")]
    df = spark.createDataFrame(rows, "id string, text string, extraction string").withColumn("word", F.lit("clash"))
    got = {(r.chunk_id, r.line_no, r.noise) for r in ocr.noise(df).collect() if r.noise in ("header", "page_number")}
    assert got == {(f"o{i}", 1, "header") for i in range(4)} | {(f"o{i}", 5, "page_number") for i in range(4)} | {("m", 1, "header")}
    assert ocr.noise(df.limit(0)).count() == 0


def test_a_frequent_word_can_be_beaten(spark):
    clean = [(f"c{i}", "the needle moves down and the hand wheel turns. " * 300 + " the needlc stops" * (i < 5), "text") for i in range(6)]
    scanned = [(f"o{i}", "the necdle stops and the hancl whccl turns down\nthe needlc moves and the whcel stops", "ocr-eng") for i in range(8)]
    got = {(r.observed, r.word) for r in ocr.noise(spark.createDataFrame(clean + scanned, "id string, text string, extraction string")).collect() if r.noise == "misread"}
    assert ("needlc", "needle") in got and ("whcel", "wheel") in got


def test_scanned_text(spark):
    r = random.Random(6)
    clean = [(f"c{i}", text(r, "en", 8) + " Use a self-locking nut.", "text") for i in range(150)]
    swap = {"e": "c", "o": "0", "n": "ri", "m": "rn", "h": "b", "l": "1"}
    rows, want = list(clean), set()
    for i in range(120):
        words = (text(r, "en", 6) + " Use a self-locking nut.").split()
        lines, line = [], []
        for w in words:
            line.append(w)
            if len(line) == 7:
                lines.append(line)
                line = []
        lines += [line] if line else []
        out = []
        for n, line in enumerate(lines):
            k = r.randrange(len(line))
            core = line[k].strip(".").lower()
            c = r.choice(list(swap))
            if i % 2 and len(core) > 4 and c in core and line[k][0].islower():
                line[k] = line[k].replace(c, swap[c], 1)
                want.add((f"o{i}", len(out) + 1, "misread", core))
            out.append(" ".join(line))
        if i % 3 == 0:
            out.insert(2, "THREAD TENSION")
            out.insert(2, "- 14 -")
            want = {(a, b + 2 if a == f"o{i}" and b > 2 else b, c, d) for a, b, c, d in want} | {(f"o{i}", 3, "page_number", ""), (f"o{i}", 4, "header", "")}
        if i % 3 == 1:
            first = out[0].split()
            long = next((w for w in first if len(w) > 5 and w.islower() and w.isalpha()), None)
            if long and not any(x[:2] == (f"o{i}", 1) for x in want):
                k = first.index(long)
                out[0:1] = [" ".join(first[:k] + [long[:3] + "-"]), " ".join([long[3:]] + first[k + 1 :])]
                want = {(a, b + 1 if a == f"o{i}" and b > 1 else b, c, d) for a, b, c, d in want} | {(f"o{i}", 1, "hyphen", long)}
        rows.append((f"o{i}", "\n".join(out), "ocr-eng"))
    rows += [("n", None, "ocr-eng"), ("e", "", "ocr-eng"), ("b", " \n ", "ocr-eng"), ("L", text(r, "en", 2000), "ocr-eng"), rows[200]]
    df = spark.createDataFrame(rows, "id string, text string, extraction string").withColumn("word", F.lit("clash")).withColumn("page", F.lit(1))
    got = {(x.chunk_id, x.line_no, x.noise, x.word) for x in ocr.noise(df).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want), (sorted(want - got)[:5], sorted(got - want)[:5])
    whole = {x.chunk_id: x.text for x in ocr.repaired(df).collect()}
    assert whole["n"] is None and whole["e"] == "" and "TENSION" not in whole["o0"] and "\n" not in whole["o0"] and len(whole) == 124
    assert ocr.noise(df.limit(0)).count() == 0


def test_mend_keeps_case_and_paragraphs():
    fixes = [{"line_no": 1, "noise": "hyphen", "word": "needle", "observed": "nee-dle"}, {"line_no": 2, "noise": "page_number", "word": "", "observed": ""}, {"line_no": 5, "noise": "misread", "word": "motor", "observed": "rnotor"}]
    assert ocr.mend("Turn the nee-\n- 3 -\ndle, then stop.\n\nThe Rnotor runs.", fixes) == "Turn the needle, then stop.\n\nThe Motor runs."


def test_reading_levels(spark):
    r = random.Random(8)
    make = {
        "basic": lambda: f"Put the {r.choice(['cloth', 'pin', 'lid', 'box'])} on the {r.choice(['desk', 'tray', 'mat'])} and wait.",
        "standard": lambda: f"Tighten the {r.choice(['screw', 'bracket', 'lever', 'cover'])} firmly before the {r.choice(['seam', 'shift', 'fabric'])} is finished.",
        "expert": lambda: f"Notwithstanding {r.choice(['metallurgical', 'parametric', 'tribological'])} considerations, {r.choice(['recalibration', 'synchronisation', 'deterioration'])} necessitates comprehensive verification.",
    }

    def doc(level, n):
        others = [x for x in make if x != level]
        return " ".join(make[level]() if r.random() < 0.8 else make[r.choice(others)]() for _ in range(n))

    samples = spark.createDataFrame([(i, doc(level, 8), level) for i, level in enumerate(list(make) * 30)], "sample_id int, text string, reading_level string")
    truth = {i: r.choice(list(make)) for i in range(150)}
    rows = [(i, doc(level, 14)) for i, level in truth.items()] + [(900, None), (901, ""), (902, "Put the pin on the mat and wait."), (903, doc("basic", 10) + " " + text(r, "de", 3)), (904, text(r, "fr", 20)), (905, "a | b | 1\n" * 90), (906, doc("expert", 4000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labelled = [("en", doc(r.choice(list(make)), 4)) for _ in range(60)] + [(lang, text(r, lang, 4)) for lang in ("de", "fr") for _ in range(60)]
    languages = language.fitted(spark.createDataFrame(labelled, "label string, text string"))
    got = {x.doc_id: x.reading_level for x in reading.reading_levels(df, samples, languages).collect()}
    assert set(got) == set(truth) | {906} and sum(got[i] == level for i, level in truth.items()) >= 0.93 * len(truth) and got[906] == "expert"
    assert reading.reading_levels(df.limit(0), samples, languages).count() == 0


def test_a_sentence_of_unknown_words_alone():
    from loomwright.llm.reading import WordGrades

    model = WordGrades([("Turn the wheel until the belt runs.", "basic"), ("The lever must be aligned with the motor plate.", "standard")])
    known = ["turn", "the", "wheel", "until", "the", "belt"] * 12
    assert model.judge([known, ["zzyx", "qwrt", "plmk"]])[:2] == model.judge([known])[:2]
    assert model.judge([["zzyx", "qwrt", "plmk"] * 30]) is None


def test_one_sentence_tells_a_foreign_text():
    r = random.Random(6)
    parser = language.CrossParser(*language.fit([(lang, text(r, lang, 4)) for lang in ("en", "de", "fr") for _ in range(60)]))
    parsed, plain = [], parser.phrases
    parser.phrases = lambda texts: parsed.extend(texts) or plain(texts)
    words = lambda lang, n: [s.lower().rstrip(".").split() for s in (text(r, lang, 1) for _ in range(n))]
    english, foreign = words("en", 12), words("de", 40)
    assert reading._in_english([english, foreign, english[:2] + foreign[:1], []], parser) == [True, False, False, False]
    assert len(set(parsed)) == len(parsed) and len(set(parsed) & {" ".join(s) for s in foreign}) <= 2
    assert list(reading.prose("The belt\nruns on.\nStop No. 4 now! 1. It is a\n\nlid")) == [["the", "belt", "runs", "on"], ["stop", "no", "now"]]
