"""Reading level of documents from the grades at which their words are acquired."""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import CLEAR, GROUP_CHARS, CrossParser, by_language, parser_of
from .sampling import first_by_hash

# The levels and the middle of their US school grades.
LEVELS = ("basic", "standard", "expert")
GRADES = np.array([3.0, 9.0, 14.0])

#: Words of prose that an estimate needs.
LEAST_WORDS = 60
#: Rows of graded text that the model is fitted on at most.
SAMPLE_ROWS = 5_000
QUANTILES = np.linspace(0.1, 0.9, 9)
#: Rounds of the estimate of what each sentence of a graded text belongs to.
ROUNDS = 5

_LETTERS = re.compile(r"[^\W\d_]+")
#: The mark that ends a sentence, and what follows it up to the next one.
_STOP = re.compile(r"[.!?।](?<!\bNo\.)(?<!\bno\.)(?<!\bFig\.)(?<!\bRef\.)(?<!\bp\.)[\"'”’)\]]{0,3}\s+")
_ITEM = re.compile(r"^\s*(?:[-*•·]|\d{1,3}[.)]|[a-z]\))\s+")
_CAPTION = re.compile(r"^\s*(?:Fig|Ref|Tab|Table|Figure|Abb)\b\.?\s*\S{0,20}\s*(?:$|[:.]?\s)", re.I)
# one search each, as those with one way to begin are the fast ones
_MARKS = [re.compile(p) for p in (r"[|;\t=<>{}①-⓿]", r"\s{3}", r":\s*\d")]
#: ASCII letters in lower case, all else a space.
_ASCII_WORDS = "".join(c.lower() if c.isalpha() else " " for c in map(chr, range(128)))


def _lines(text: str) -> Iterator[str]:
    """The lines of a text; a break before a small letter ends none, unless a stop, a colon or a blank line is before it."""
    own = ""
    for i, line in enumerate(text.replace("\r", "").split("\n")):
        head = own.rstrip(" ")
        if i and "a" <= line[:1] <= "z" and (head[-1:] not in ".!?:" and not head[-1:].isspace() if head else i == 1):
            own = f"{head} {line}"
        else:
            if i:
                yield own
            own = line
    yield own


def _sentences(line: str) -> Iterator[str]:
    at = 0
    for m in _STOP.finditer(line):
        yield line[at : m.start() + 1]
        at = m.end()
    yield line[at:]


def _words(part: str) -> list[str]:
    return part.translate(_ASCII_WORDS).split() if part.isascii() else _LETTERS.findall(part.lower())


def prose(text: str) -> Iterator[list[str]]:
    """The words of each sentence of a text's prose, in lower case: no headings, captions, table lines, codes or lines of symbols. An item of a list is a
    sentence without a full stop too."""
    for line in _lines(text):
        line = (line[m.end() :] if (m := _ITEM.match(line)) else line).strip()
        if not line or len(line) < 60 and _CAPTION.match(line):
            continue
        for part in _sentences(line):
            words = _words(part)
            if len(words) < 3 or any(p.search(part) for p in _MARKS):
                continue
            if part.rstrip("\"'”’)] ").endswith((".", "!", "?", "।")) or len(words) >= 4 and sum(w[0].islower() for w in _LETTERS.findall(part)) * 2 >= len(words):
                yield words


class WordGrades:
    """Acquisition grades of words, and the calibration from quantiles of a document's word grades to its level."""

    def __init__(self, samples: list[tuple[str, str]]):
        rows = [(LEVELS.index(level), list(prose(text))) for text, level in samples if text and level in LEVELS]
        part = self._spread(rows)
        count: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
        for (_, sentences), share in zip(rows, part):
            for words, p in zip(sentences, share):
                for w in words:
                    count[w] += p
        total = sum(count.values(), np.zeros(3)) + 1
        self.grade = {w: self._grade(n, total) for w, n in count.items()}
        features, target = [], []
        for (level, sentences), share in zip(rows, part):
            # the sample's own words are left out of their grades, as they would be of a new document
            own: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
            for words, p in zip(sentences, share):
                for w in words:
                    own[w] += p
            rest_total = total - sum(own.values(), np.zeros(3))
            grades = {w: self._grade(rest, rest_total) for w, n in own.items() if (rest := count[w] - n).sum() > 0.01}
            if (x := self._quantiles(sentences, grades)) is not None:
                features.append(x)
                target.append(level)
        self.level_of(np.array(features), np.array(target))

    @staticmethod
    def _spread(rows: list[tuple[int, list[list[str]]]]) -> list[np.ndarray]:
        """How much each sentence of each sample belongs to each level: a text of one level holds sentences of others too.

        Word distributions by level and these shares are estimated in turn, from the samples' own levels on.
        """
        share = [np.tile(np.where(np.arange(3) == level, 0.8, 0.1), (len(sentences), 1)) for level, sentences in rows]
        place = {w: i for i, w in enumerate(sorted({w for _, sentences in rows for words in sentences for w in words}))}
        index = [[[place[w] for w in words] for words in sentences] for _, sentences in rows]
        for _ in range(ROUNDS):
            n, mix = np.full((max(1, len(place)), 3), 0.05), np.full((3, 3), 1.0)
            for (level, _), sentences, p in zip(rows, index, share):
                mix[level] += p.sum(axis=0)
                for words, q in zip(sentences, p):
                    np.add.at(n, words, q)
            log_word, log_mix = np.log(n / n.sum(axis=0)), np.log(mix / mix.sum(axis=1, keepdims=True))
            for (level, _), sentences, p in zip(rows, index, share):
                for k, words in enumerate(sentences):
                    score = log_mix[level] + log_word[words].sum(axis=0)
                    p[k] = np.exp(score - score.max())
                    p[k] /= p[k].sum()
        return share

    @staticmethod
    def _grade(n: np.ndarray, total: np.ndarray) -> float:
        """The mean grade of a word's occurrences, each level counted by its rate, pulled to the middle where there are few."""
        rate = (n + 0.2) / total
        return float(rate @ GRADES / rate.sum())

    @staticmethod
    def _quantiles(sentences: list[list[str]], grades: dict[str, float]) -> np.ndarray | None:
        """Quantiles of the known words' grades; every sentence has the same weight, however long it is."""
        values, weights = [], []
        for words in sentences:
            known = [*filter(None, map(grades.get, words))]  # no grade is 0
            values += known
            weights += [1 / max(1, len(known))] * len(known)
        if not values:
            return None
        v, w = np.array(values), np.array(weights)
        order = np.argsort(v, kind="stable")
        share = np.cumsum(w[order]) / w.sum()
        return v[order][np.minimum(np.searchsorted(share, QUANTILES), len(v) - 1)]

    def level_of(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit weights of the quantiles (ridge) and the two cuts that part the levels best."""
        if len(y) == 0:
            self.mean, self.weights, self.cuts = np.zeros(len(QUANTILES)), np.zeros(len(QUANTILES)), np.array([6.0, 12.5])
            return
        self.mean = x.mean(axis=0)
        a = x - self.mean
        self.weights = np.linalg.solve(a.T @ a + 1.0 * np.eye(a.shape[1]), a.T @ (GRADES[y] - GRADES[y].mean()))
        score = a @ self.weights
        cuts = []
        for k in (0, 1):
            # of all cuts between neighbours the one with the fewest on the wrong side, in the middle of the widest gap
            s = np.sort(score)
            mids = (s[1:] + s[:-1]) / 2 if len(s) > 1 else s
            wrong = np.array([((score <= m) != (y <= k)).sum() for m in mids])
            best = mids[wrong == wrong.min()]
            cuts.append(float(np.median(best)))
        self.cuts = np.array(cuts)

    def judge(self, sentences: list[list[str]]) -> tuple[str, float, int] | None:
        """(level, score, words) of a text's sentences, or None for one of too little prose or of no known word."""
        n = sum(map(len, sentences))
        if n < LEAST_WORDS or (x := self._quantiles(sentences, self.grade)) is None:
            return None
        score = float((x - self.mean) @ self.weights)
        return LEVELS[int((score > self.cuts).sum())], score, n


def _in_english(texts: list[list[list[str]]], parser: CrossParser) -> list[bool]:
    """Whether every sentence of each text is English by the cross-parser; a short one that it is unsure of speaks for no language.
    The longest sentence of each text is parsed first, and only if that is English its others are too."""
    joined = [[" ".join(words) for words in sentences] for sentences in texts]
    if "en" not in parser.languages:
        return [False] * len(texts)
    foreign: dict[str, bool] = {}

    def parse(sentences: Iterator[str]) -> None:
        if new := [s for s in dict.fromkeys(sentences) if s not in foreign]:
            cost = by_language(parser, parser.phrases(new))
            english = cost[:, parser.languages.index("en")]
            other = np.delete(cost, parser.languages.index("en"), axis=1).min(axis=1, initial=np.inf)
            long = np.array([s.count(" ") >= 7 for s in new])
            foreign.update(zip(new, (english > other * np.where(long, 1.0, CLEAR / (1 - CLEAR))).tolist()))

    longest = [max(own, key=len, default="") for own in joined]
    parse(s for s in longest if s)
    parse(s for own, first in zip(joined, longest) if own and not foreign[first] for s in own)
    return [bool(own) and not foreign[first] and not any(foreign[s] for s in own) for own, first in zip(joined, longest)]


def fit(samples: DataFrame) -> WordGrades:
    """The model from (text, reading_level), fitted in a task; at most SAMPLE_ROWS distinct rows, those of the smallest hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(r for pdf in frames for r in zip(pdf["text"], pdf["reading_level"]))
        yield pd.DataFrame({"model": [pickle.dumps(WordGrades(rows))]})

    rows = first_by_hash(samples.select("text", "reading_level").where("text is not null and reading_level is not null").withColumn("all", F.lit(1)), SAMPLE_ROWS, ["all"], ["text", "reading_level"])
    row = rows.select("text", "reading_level").coalesce(1).mapInPandas(run, "model binary").first()
    return pickle.loads(row.model) if row else WordGrades([])


def reading_levels(documents: DataFrame, samples: DataFrame, languages: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, reading_level, score, words) of every document written wholly in English with enough words of prose.

    ``languages`` is the cross-parser's model, which decides what is English. Null, empty and blank texts, texts in part or whole
    in another language and texts with too little prose have no row. Repeated rows give repeated rows. Narrow: the model is a few
    hundred words from the graded samples, whose number is bounded.
    """
    model = fit(samples)
    kind = documents.schema[doc_id].dataType.simpleString()

    def judged(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [(d, s) for d, t in zip(pdf["doc_id"], pdf["text"]) if t and sum(map(len, s := list(prose(t)))) >= LEAST_WORDS]
        english = _in_english([s for _, s in texts], parser_of(languages)) if languages[1] else []
        rows = [(d, *j) for (d, s), e in zip(texts, english) if e and (j := model.judge(s))]
        return pd.DataFrame(rows, columns=["doc_id", "reading_level", "score", "words"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = pdf["text"].map(lambda t: len(t) if t else 0).cumsum() // GROUP_CHARS
            for _, part in pdf.groupby(size.to_numpy(), sort=False):
                yield judged(part)

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, reading_level string, score double, words int")
