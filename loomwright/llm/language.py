"""Languages of texts and of their segments by cross-parsing: the language whose text needs the fewest phrases wins."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalikes import LOOKALIKES
from .sampling import first_by_hash

# The languages and the usual spellings of their labels.
LANGUAGES = ("bn", "de", "en", "es", "fr", "hi", "pt")
SPELLINGS = {
    "bn": ("bn", "ben", "bengali", "bangla", "বাংলা"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "hi": ("hi", "hin", "hindi", "हिन्दी", "हिंदी"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
}

#: Distinct labelled rows of Indic and of other text that the model is fitted on, and the characters of whole sentences of these from
#: which on a class's automaton takes no more.
SAMPLE_ROWS, SAMPLE_CHARS = 2_500, 60_000
#: Sentences of one sampled row, spread evenly over the row, so that no long row with a wrong label speaks for its class.
ROW_SENTENCES = 24

SPACE, DIGIT, OTHER, DROPPED = 0, 1, 2, -1


def label_code(label: Column) -> Column:
    """The language that a label names in a usual spelling, a region aside; null for any other label."""
    plain = F.lower(F.btrim(F.regexp_replace(F.coalesce(label, F.lit("")), r"[\s ]+", " ")))
    base = F.when(plain.rlike(r"^[a-z]{2,3}[-_][a-z0-9]{2,4}$"), F.regexp_extract(plain, "^[a-z]+", 0)).otherwise(plain)
    code = F.lit(None).cast("string")
    for lang, names in SPELLINGS.items():
        code = F.when(base.isin(*names), F.lit(lang)).otherwise(code)
    return code


# --- sentences -------------------------------------------------------------------------------------------------------

_ABBREVIATED = r"(?<!\bNo\.)(?<!\bno\.)(?<!\bNr\.)(?<!\bnº\.)(?<!\bn\.)(?<!\bFig\.)(?<!\bp\.)(?<!\bz\.B\.)(?<!\be\.g\.)(?<!\bca\.)(?<!\bbzw\.)"
_END = re.compile(rf"(?<=[.!?।॥])(?<!\d[.])(?:{_ABBREVIATED})[\"'”’»)\]]{{0,3}}\s+|(?<=\d\.)\s+(?=[^\W\da-z_])|\s*\n\s*\n\s*|\n(?![^\S\n]*[a-zà-ÿ])|(?<=[.!?।:;])[^\S\n]*\n")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[ঀ-৿ऀ-ॿ'’‌‍̀-ͯ])*")
_TABLE = re.compile(r"[|;\t=]{1}")
_STOP = re.compile(r"[.!?।॥][\"'”’»)\]\s]*$")


def units(text: str) -> list[str]:
    """The sentences and other stretches of a text in reading order; a line break inside a sentence doesn't end it."""
    return [u for u in (p.strip() for p in _END.split(text)) if u]


def is_sentence(unit: str) -> bool:
    """A full stop and three words, or five words without one; table lines, dumps and lines of symbols are none."""
    words = [w for w in _WORD.findall(unit) if len(w) > (2 if w.isascii() and w.isupper() else 1)]
    if sum(map(len, words)) * 2 < len(unit):
        return False
    return len(words) >= 3 and _STOP.search(unit) is not None and unit.count("|") < 2 or len(words) >= 5 and not _TABLE.search(unit)


# --- symbols ---------------------------------------------------------------------------------------------------------

_to_latin = dict(zip(*LOOKALIKES))
_INDIC = re.compile(r"[ঀ-৿ऀ-ॿ]")


def _letter(cp: int) -> str:
    """The letter that a code point stands for; '' for an invisible one, ' ' for what is neither letter nor digit."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F:
        return ""
    if kind[0] not in "LMN":
        return " "
    ch = unicodedata.normalize("NFKC", _to_latin.get(ch, ch)).casefold()
    return "0" if ch[:1].isdigit() or kind[0] == "N" else ch[:1]


class Symbols:
    """Letters as small numbers: those of the fitted texts, one for all digits, one for all other letters."""

    def __init__(self, letters: list[str]):
        self.letters = letters
        number = {c: i + 3 for i, c in enumerate(letters)}
        number[" "], number["0"], number[""] = SPACE, DIGIT, DROPPED
        self.table = np.full(0x3100, OTHER, dtype=np.int32)
        for cp in range(len(self.table)):
            self.table[cp] = number.get(_letter(cp), OTHER)
        for cp in range(0xFF00, 0xFFF0):  # wide forms
            self.table[cp - 0xFF00 + 0x3000] = number.get(_letter(cp), OTHER)
        self.table[0x3000] = SPACE
        self.indic = np.array([0, 0, 0, *[int(_INDIC.match(c) is not None) for c in letters]])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts in a row, start of each and the end): runs of spaces become one, each text begins with one."""
        joined = "\n" + "\n".join(t.replace("\n", " ") for t in texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = cp == 10
        wide = (cp >= 0xFF00) & (cp < 0xFFF0)
        index = np.where(wide, cp - 0xFF00 + 0x3000, np.minimum(cp, 0x30FF))
        sym = self.table[index]
        sym[(cp > 0x30FF) & ~wide] = OTHER
        sym[starts] = SPACE
        keep = sym != DROPPED
        sym, starts = sym[keep], starts[keep]
        single = np.ones(len(sym), dtype=bool)
        single[1:] = (sym[1:] != SPACE) | (sym[:-1] != SPACE) | starts[1:]
        sym, starts = sym[single], starts[single]
        return sym, np.append(np.flatnonzero(starts), len(sym))


# --- automata --------------------------------------------------------------------------------------------------------


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 begins, and every path from it spells a stretch of ``sequence``."""
    next_, link, length, last = [{}], [-1], [0], 0
    for c in sequence:
        cur = len(next_)
        next_.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in next_[p]:
            next_[p][c] = cur
            p = link[p]
        if p >= 0:
            q = next_[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(next_)
                next_.append(dict(next_[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and next_[p].get(c) == q:
                    next_[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return next_


class CrossParser:
    """Counts the phrases that each language's text needs for given texts."""

    def __init__(self, letters: list[str], texts: dict[tuple[str, bool], str]):
        self.symbols = Symbols(letters)
        self.classes = sorted(texts)
        self.languages = sorted({lang for lang, _ in texts})
        self.tables = []
        for c in self.classes:
            sym, _ = self.symbols.of([texts[c]])
            states = suffix_automaton(sym.tolist())
            used = np.unique(sym)
            column = np.zeros(len(letters) + 3, dtype=np.int64)
            column[used] = np.arange(1, len(used) + 1)
            width = len(used) + 1
            # a missing transition is 0; states count from 1 and are stored as the place of their row
            table = np.zeros((len(states) + 1) * width, dtype=np.int32)
            for i, edges in enumerate(states):
                row = (i + 1) * width
                for c, to in edges.items():
                    table[row + column[c]] = (to + 1) * width
            self.tables.append((table, column, width, np.log2(max(2, len(sym)))))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, classes): the phrases that each text needs for each of its symbols.

        A phrase of Latin text costs the bits of its place in the class's text, as classes differ in size. Indic script by itself
        leaves few languages, of which those that come by wrong labels are small and would gain by it; there a phrase costs 1.

        All texts are parsed side by side, the longest first, so that a step is a few array operations on those still running.
        """
        sym, bounds = self.symbols.of(texts)
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        begin, length = bounds[:-1][order], size[order]
        steps = int(length[0]) if len(length) else 0
        running = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than the step
        out = np.empty((len(texts), len(self.classes)))
        indic = self.symbols.indic[sym]
        share = np.add.reduceat(indic, bounds[:-1]) / np.maximum(1, size) if len(texts) else np.zeros(0)
        native = share[order] > 0.25
        for k, (table, column, width, bits) in enumerate(self.tables):
            codes = column[sym]
            state = np.full(len(begin), width, dtype=np.int64)
            count = np.ones(len(begin), dtype=np.int32)
            for step in range(steps):
                n = running[step]
                c = codes[begin[:n] + step]
                to = table[state[:n] + c]
                failed = np.flatnonzero(to == 0)
                if len(failed):
                    again = table[width + c[failed]]
                    alone = again == 0  # a letter that the class has nowhere is a phrase of its own
                    count[failed] += (state[failed] != width).astype(np.int32) + alone
                    again[alone] = width
                    to[failed] = again
                state[:n] = to
            count -= (state == width) & (length > 0)
            out[order, k] = count * np.where(native, 1.0, bits) / np.maximum(1, length)
        return out


def by_language(parser: CrossParser, bits: np.ndarray) -> np.ndarray:
    """(texts, languages) from (texts, classes): the lowest of each language's classes."""
    return np.stack([bits[:, [k for k, c in enumerate(parser.classes) if c[0] == lang]].min(axis=1) for lang in parser.languages], axis=1)


def _letters(sentences: Iterator[str]) -> list[str]:
    return sorted({c for s in sentences for ch in set(s) if (c := _letter(ord(ch))).isalpha() or c and unicodedata.category(c)[0] == "M"})


#: An item stays among the labelled texts if its label is the best language of its whole text and of this share of its sentences.
PURE = 0.8
#: Share of a class's items that must stay, or else the class is one of wrong labels.
LEAST_STANDING = 0.05


def _native(text: str) -> bool:
    """A quarter of the text or more is in an Indic script."""
    return len(_INDIC.findall(text)) * 4 >= len(text.replace(" ", ""))


def _spread(sentences: list[str]) -> list[str]:
    return sentences if len(sentences) <= ROW_SENTENCES else [sentences[i * len(sentences) // ROW_SENTENCES] for i in range(ROW_SENTENCES)]


def fit(rows: list[tuple[str, str]]) -> tuple[list[str], dict[tuple[str, bool], str]]:
    """(letters, text of each class) from labelled texts, some of whose labels are wrong; a class is a language in one script.

    Twice, each half of the items is parsed by the automata of the other half's items that still stand; an item stays if its
    own language needs the fewest phrases for it, so that neither wrongly labelled nor mixed items give the automata their text.
    A class of which less than LEAST_STANDING stays is dropped, unless its language would be left without any.
    """
    items = [((lang, _native(text)), s) for lang, text in sorted(rows, key=lambda r: hashlib.md5(r[1].encode()).digest()) if (s := _spread([u for u in units(text) if is_sentence(u)]))]
    letters = _letters(u for _, s in items for u in s)
    stands = [True] * len(items)
    classes = sorted({c for c, _ in items})

    def texts(half: int | None) -> dict[tuple[str, bool], str]:
        chosen = {}
        for c in classes:
            mine = [i for i, item in enumerate(items) if item[0] == c and (half is None or i % 2 == half)]
            standing = [i for i in mine if stands[i]]
            chosen[c] = (standing if len(standing) >= LEAST_STANDING * len(mine) else [], mine)
        found = {lang for (lang, _), (standing, _) in chosen.items() if standing}
        out = {}
        for c, (standing, mine) in chosen.items():
            # the first sentence of each item, then the second of each, so that no long item speaks for its class
            turns = zip_longest(*(items[i][1] for i in standing or ([] if c[0] in found else mine)))
            sentences = list(dict.fromkeys(u for turn in turns for u in turn if u is not None))
            before = np.cumsum([0] + [len(u) + 1 for u in sentences])
            text = " ".join(u for u, n in zip(sentences, before) if n < SAMPLE_CHARS)
            if text:
                out[c] = text
        return out

    for _ in range(2):
        judged = list(stands)
        for half in (0, 1):
            model = texts(1 - half)
            mine = [i for i in range(len(items)) if i % 2 == half]
            if not model or not mine:
                continue
            parser = CrossParser(letters, model)
            bits = parser.phrases([u for i in mine for u in items[i][1]])
            weight = np.array([len(u) for i in mine for u in items[i][1]], dtype=float)
            at = 0
            for i in mine:
                c, sentences = items[i]
                own, chars = bits[at : at + len(sentences)], weight[at : at + len(sentences), None]
                at += len(sentences)
                mine_too = np.array([p[0] == c[0] for p in parser.classes])
                judged[i] = bool(mine_too[(own * chars).sum(axis=0).argmin()] and mine_too[own.argmin(axis=1)].mean() >= PURE)
        stands = judged
    return letters, texts(None)


def labelled_sample(items: DataFrame) -> DataFrame:
    """(lang, text): at most SAMPLE_ROWS rows of Indic and of other text, chosen by hash; ``items`` has (label, text).

    Within these, languages keep their shares, so that right labels outnumber wrong ones.
    """
    rows = items.select(label_code(F.col("label")).alias("lang"), "text").where("lang is not null and length(text) > 20")
    rows = rows.withColumn("native", F.col("text").rlike(r"[ঀ-৿ऀ-ॿ]"))
    return first_by_hash(rows, SAMPLE_ROWS, ["native"], ["text", "lang"]).select("lang", "text")


def fitted(items: DataFrame) -> tuple[list[str], dict[tuple[str, bool], str]]:
    """fit() of the labelled sample, whose size is bounded, in one task; the driver gets the letters and the classes' texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in frames for r in zip(pdf["lang"], pdf["text"])]
        letters, texts = fit(rows) if rows else ([], {})
        yield pd.DataFrame([("", False, "".join(letters)), *[(lang, native, text) for (lang, native), text in texts.items()]], columns=["lang", "native", "text"])

    rows = labelled_sample(items).coalesce(1).mapInPandas(run, "lang string, native boolean, text string").collect()
    return [c for r in rows if not r.lang for c in r.text], {(r.lang, r.native): r.text for r in rows if r.lang}


_parsers: dict[int, CrossParser] = {}


def parser_of(model: tuple[list[str], dict[tuple[str, bool], str]]) -> CrossParser:
    """The model's automata, built once in each worker."""
    key = hash((tuple(model[0]), tuple(sorted(model[1].items()))))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(*model)
    return _parsers[key]


#: Sentences are parsed together up to so many characters.
GROUP_CHARS = 1_500_000
#: A sentence of less confidence takes the language before it, or else after it, if the text has any clearer one.
CLEAR = 0.52


def segments(items: DataFrame, model: tuple[list[str], dict[tuple[str, bool], str]], keys: list[str]) -> DataFrame:
    """(keys…, seg_no, segs, lang, confidence, segment): the language segments of each row's ``text``, numbered from 1 to segs.

    A segment is the longest run of whole sentences in one language; what is no sentence belongs to the one before it.
    Confidence is the phrases that the second language needs over those of both, a mean over the segment's sentences. Null and
    empty texts, and texts without a full sentence, give no row. Repeated rows give repeated rows. Narrow.
    """
    schema = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys) + ", seg_no int, segs int, lang string, confidence double, segment string"

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        parser = parser_of(model)
        split = [units(t) if t else [] for t in pdf["text"]]
        flat = [(i, u) for i, us in enumerate(split) for u in us if is_sentence(u)]
        unique = {u: n for n, u in enumerate(dict.fromkeys(u for _, u in flat))}
        if not unique:
            return pd.DataFrame({k: [] for k in [*keys, "seg_no", "segs", "lang", "confidence", "segment"]})
        bits = by_language(parser, parser.phrases(list(unique)))
        rank = np.sort(bits, axis=1)
        best = bits.argmin(axis=1)
        sure = rank[:, 1] / np.maximum(1e-9, rank[:, 0] + rank[:, 1]) if bits.shape[1] > 1 else np.ones(len(bits))
        rows = []
        for i, us in enumerate(split):
            runs: list[list] = []
            head: list[str] = []
            clear = [n for u in us if (n := unique.get(u)) is not None and sure[n] >= CLEAR]
            for u in us:
                n = unique.get(u)
                if n is None or clear and sure[n] < CLEAR:
                    (runs[-1][2] if runs else head).append(u)
                elif runs and runs[-1][0] == best[n]:
                    runs[-1][1].append(sure[n])
                    runs[-1][2].append(u)
                else:
                    runs.append([best[n], [sure[n]], head + [u]])
                    head = []
            for no, (lang, confidence, parts) in enumerate(runs, 1):
                rows.append((i, no, len(runs), parser.languages[lang], float(np.mean(confidence)), "\n".join(parts)))
        out = pd.DataFrame(rows, columns=["i", "seg_no", "segs", "lang", "confidence", "segment"])
        for k in keys:
            out[k] = pdf[k].to_numpy()[out["i"].to_numpy()]
        return out[[*keys, "seg_no", "segs", "lang", "confidence", "segment"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = pdf["text"].map(lambda t: len(t) if t else 0).cumsum() // GROUP_CHARS
            for _, part in pdf.groupby(size.to_numpy(), sort=False):
                yield judge(part)

    return items.select(*keys, "text").mapInPandas(run, schema)


def mislabelled(items: DataFrame) -> DataFrame:
    """(item_table, item_id, seg_no, lang, confidence) of every item whose label is missing, unusable or wrong, and of every item
    with more than one language; one row for each segment, distinct.

    ``items`` has (item_table, item_id, label, text), one row for each item. The model is fitted on these items' own labels. A
    label in another usual spelling is right. An empty table, or one without a usable label, gives an empty result.
    """
    model = fitted(items)
    if not model[1]:
        return items.select("item_table", "item_id", F.lit(1).alias("seg_no"), F.lit("").alias("lang"), F.lit(0.0).alias("confidence")).where(F.lit(False))
    items = items.withColumn("code", F.coalesce(label_code(F.col("label")), F.lit("")))
    found = segments(items, model, ["item_table", "item_id", "code"])
    return found.where("segs > 1 or lang <> code").select("item_table", "item_id", "seg_no", "lang", "confidence").distinct()
