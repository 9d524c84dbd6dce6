"""Question-answer pairs with a defect: empty, truncated, refusing, copying or in another language than asked for.

A multi-label linear classifier on hashed n-grams and features of the pair, trained on defects that are made from sound pairs:
answers cut off, questions for answers, answers swapped with ones in another language, and refusals. Each label has the features
that can tell it: n-grams of the whole answer (empty, refusal) or of its end (truncated), and its own features of the pair, so that
what is common among the sound pairs of one sample can't speak for another label. Languages come from the cross-parser.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import LANGUAGES, CrossParser, by_language, fitted as fitted_languages, is_sentence, parser_of, units
from .lookalikes import INVISIBLE, LOOKALIKES
from .sampling import first_by_hash

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
#: Hashed n-grams, and rows that are sampled of each kind: pairs of each answer script, refused answers.
BUCKETS, SAMPLE_PAIRS, SAMPLE_REFUSALS = 1 << 16, 2_500, 400
#: Share of pairs that are taken to have each defect when thresholds are chosen, as made defects are far more frequent.
EXPECTED_SHARE = 0.02
#: A sentence that so many sampled pairs answer with is none of a sound answer; a pair this near to a refusal isn't learnt from.
OFTEN, DOUBT = 3, 2.0
#: Characters of answers and questions that are judged at once.
GROUP_CHARS = 1_500_000

# What a placeholder says, and how languages are called in each language.
PLACEHOLDERS = {"", "na", "none", "null", "nil", "nan", "tbd", "todo", "answer", "empty", "undefined", "noanswer", "notavailable", "unknown", "respuesta", "antwort", "réponse", "resposta", "উত্তর", "उत्तर"}
CALLED = {
    "en": ("english", "anglais", "englisch", "inglés", "ingles", "inglês", "ইংরেজি", "ইংরাজি", "अंग्रेज", "अँग्रेज"),
    "bn": ("bengali", "bangla", "বাংলা", "बांग्ला", "बंगाली", "bengalí"),
    "de": ("german", "allemand", "deutsch", "alemán", "alemão", "জার্মান", "जर्मन"),
    "fr": ("french", "français", "französisch", "francés", "francês", "ফরাসি", "फ़्रेंच", "फ्रेंच"),
    "es": ("spanish", "espagnol", "spanisch", "español", "espanhol", "স্প্যানিশ", "स्पेनिश"),
    "pt": ("portuguese", "portugais", "portugiesisch", "portugués", "português", "পর্তুগিজ", "पुर्तगाली"),
    "hi": ("hindi", "হিন্দি", "हिंदी", "हिन्दी"),
}
#: How an answer is asked for, and how it is refused. Fixed values.
_ASK = r"answer|reply|respond|explain|write|use|répond|respond|antwort|schreib|erklär|escrib|contest|explique|escrev|responda|উত্তর|ব্যাখ্যা|লিখ|जवाब|उत्तर|समझा|लिख"
_NOT = r"\b(?:not|don't|never|without|nicht|kein\w*|pas|no|não|na[oã])\b|করবেন না|দেবেন না|নয়|নহে|मत|न दें|नहीं"
_asked = re.compile(_ASK, re.I)
_negated = re.compile(_NOT, re.I)
_called = {lang: re.compile("|".join(map(re.escape, names)), re.I) for lang, names in CALLED.items()}
_clauses = re.compile(r"[.!?।;,:)]\s+|\n")

# Parts that refusals are put together from for training: by language openings, pairs of (what is refused, how), and closes.
# A word of the second part may stand in for the place of the first, marked {}.
REFUSALS = {
    "en": (("", "Sorry, ", "Sorry, but ", "I'm sorry, ", "Unfortunately, ", "I'm afraid ", "My apologies, ", "As an AI assistant, ", "Regrettably, "),
           ((("help with this", "help you here", "assist you with this topic", "answer that", "answer your question", "give advice on this subject", "offer guidance about that", "provide such instructions", "discuss this", "share those details", "comment on this matter", "carry out this request", "tell you that", "say more about this machine"),
             ("I can't {}", "I cannot {}", "I am unable to {}", "I'm not able to {}", "I won't {}", "I will not {}", "I must refuse to {}", "I have to decline to {}", "I must decline to {}", "I would rather not {}", "I am not permitted to {}", "I'm not allowed to {}", "it is not possible for me to {}", "I don't have permission to {}", "my rules forbid me to {}")),
            (("This request", "This question", "That topic", "Such a matter"),
             ("{} falls outside what I can deal with", "{} lies beyond what I may discuss", "{} is not something I can assist with", "{} cannot be answered by me", "{} has to be refused", "{} will get no answer here", "{} is one I must turn down"))),
           ("", ", please ask a qualified person", "; contact a service engineer instead", " because it could be unsafe", ", as this might be dangerous")),
    "bn": (("", "দুঃখিত, ", "মাফ করবেন, ", "ক্ষমা চাইছি, ", "দুর্ভাগ্যবশত, ", "সহকারী হিসেবে "),
           ((("এই প্রশ্নের উত্তর", "এ বিষয়ে পরামর্শ", "এ ধরনের নির্দেশনা", "এমন তথ্য", "এই কাজের ধাপগুলো"),
             ("আমি {} দিতে পারব না", "আমি {} দিতে পারছি না", "আমি {} দিতে অক্ষম", "আমি {} দিতে অপারগ", "{} দেওয়া আমার পক্ষে সম্ভব নয়", "{} দেওয়ার অনুমতি আমার নেই", "আমি {} দিতে রাজি নই")),
            (("এই কাজে সাহায্য", "এ বিষয়ে সহায়তা", "এ নিয়ে আলোচনা", "এই অনুরোধটি গ্রহণ", "আপনার অনুরোধ পূরণ"),
             ("আমি {} করতে পারব না", "আমি {} করতে পারছি না", "আমি {} করতে পারি না", "{} করা আমার পক্ষে সম্ভব নয়", "আমি {} করতে অপারগ", "{} করার অনুমতি আমার নেই"))),
           ("", ", দয়া করে কোনো মেকানিককে জিজ্ঞাসা করুন", ", অনুগ্রহ করে দক্ষ কারিগর ডাকুন", ", কারণ এতে বিপদ হতে পারে")),
    "hi": (("", "क्षमा करें, ", "माफ़ कीजिए, ", "खेद है, ", "दुर्भाग्य से ", "सहायक के रूप में "),
           ((("इस प्रश्न का उत्तर", "इस विषय पर सलाह", "ऐसे निर्देश", "ऐसी जानकारी", "इसका जवाब"),
             ("मैं {} नहीं दे सकता", "मैं {} देने में असमर्थ हूँ", "{} देना मेरे लिए संभव नहीं है", "मुझे {} देने की अनुमति नहीं है", "मैं {} नहीं दूँगा")),
            (("इस काम में मदद", "इस विषय में सहायता", "इस पर चर्चा", "यह अनुरोध स्वीकार", "आपका अनुरोध पूरा"),
             ("मैं {} नहीं कर सकता", "{} करना मेरे लिए संभव नहीं है", "मैं {} करने में असमर्थ हूँ", "मुझे {} करने की अनुमति नहीं है"))),
           ("", ", कृपया किसी मिस्त्री से पूछें", ", कृपया किसी जानकार से संपर्क करें", ", क्योंकि इसमें खतरा हो सकता है")),
    "de": (("", "Es tut mir leid, ", "Leider ", "Entschuldigung, ", "Bedauerlicherweise ", "Als Assistent "),
           ((("diese Frage", "Ihre Anfrage", "so etwas"),
             ("{} kann ich nicht beantworten", "{} darf ich nicht beantworten", "{} muss ich ablehnen", "{} werde ich nicht beantworten", "ich bin nicht in der Lage, {} zu beantworten")),
            (("hierbei", "bei diesem Thema", "in dieser Sache", "damit"),
             ("{} kann ich leider nicht helfen", "{} darf ich nicht helfen", "ich kann Ihnen {} nicht weiterhelfen", "es ist mir nicht möglich, {} zu helfen")),
            (("dazu", "hierzu", "zu diesem Punkt"),
             ("{} darf ich keine Auskunft geben", "{} kann ich keine Anleitung geben", "ich bin nicht in der Lage, {} einen Rat zu geben", "es ist mir nicht erlaubt, {} etwas zu sagen", "{} gebe ich keine Antwort"))),
           ("", ", bitte fragen Sie eine Fachkraft", ", weil das gefährlich sein kann", "; wenden Sie sich an den Kundendienst")),
    "fr": (("", "Désolé, ", "Je suis désolé, mais ", "Malheureusement, ", "Je regrette, ", "En tant qu'assistant, "),
           ((("répondre à cette question", "répondre à votre demande", "vous aider sur ce point", "vous aider à ce sujet", "donner de telles consignes", "donner un avis là-dessus", "en parler"),
             ("je ne peux pas {}", "je ne suis pas en mesure de {}", "je ne suis pas autorisé à {}", "il m'est impossible de {}", "je dois refuser de {}", "je préfère ne pas {}", "je n'ai pas le droit de {}")),),
           ("", ", veuillez demander à un spécialiste", ", car cela serait dangereux", " ; adressez-vous au service après-vente")),
    "es": (("", "Lo siento, ", "Lo siento, pero ", "Por desgracia, ", "Lamentablemente, ", "Disculpe, ", "Como asistente, "),
           ((("responder a esa pregunta", "responder a su solicitud", "ayudarle con este asunto", "ayudar en este tema", "dar esas instrucciones", "dar consejos al respecto", "hablar de ello"),
             ("no puedo {}", "no me es posible {}", "no estoy autorizado para {}", "no tengo permiso para {}", "debo negarme a {}", "me resulta imposible {}", "no voy a {}")),),
           ("", ", pregunte a un especialista", ", porque sería peligroso", "; acuda al servicio técnico")),
    "pt": (("", "Desculpe, ", "Lamento, mas ", "Infelizmente, ", "Sinto muito, ", "Como assistente, "),
           ((("responder a essa pergunta", "responder ao seu pedido", "ajudar com esse tema", "ajudar nesse assunto", "dar esse tipo de orientação", "dar conselhos sobre isso", "falar disso"),
             ("não posso {}", "não consigo {}", "não me é possível {}", "não tenho autorização para {}", "não tenho permissão para {}", "preciso recusar-me a {}", "não vou {}")),),
           ("", ", pergunte a um especialista", ", porque seria perigoso", "; procure a assistência técnica")),
}


def refusals(rng: np.random.Generator, n: int, held: Callable[[str], bool] = lambda how: False) -> list[str]:
    """``n`` refusals put together from their parts, some of two sentences; ways of refusing for which ``held`` is true are left out."""
    pick = lambda part: part[rng.integers(0, len(part))]
    out = []
    while len(out) < n:
        lang = pick(LANGUAGES)
        opening, cores, close = REFUSALS[lang]
        made = []
        for _ in range(1 + (rng.random() < 0.25)):
            what, how = pick(cores)
            how = pick([h for h in how if not held(h)] or how)
            text = pick(opening) + how.format(pick(what)) + pick(close)
            made.append(text[:1].upper() + text[1:] + ("।" if lang in ("bn", "hi") else "."))
        out.append(" ".join(made))
    return out


_tags = re.compile(r"<[^<>]{0,40}>")
_invisible = re.compile(INVISIBLE)
_latin = str.maketrans(*LOOKALIKES)
_trail = re.compile(r"(?:\s*(?:\[\d{1,3}\]|\(\s*(?:p|pp|S|pág|পৃ|पृ)\.?\s*\d{1,4}\s*\)))+\s*$")
_quoted = re.compile(r"\(?[\"“„«][^\"”“»]{3,400}[\"”»]\)?")
_lead = re.compile(r"^\s*(?:q|question|frage|pregunta|pergunta|প্রশ্ন|प्रश्न|a|answer)\s*[:.)]\s*", re.I)


def requested(question: str) -> str | None:
    """The language that a question asks to be answered in, if any: one named in a clause that asks for it and doesn't deny it."""
    for clause in reversed(_clauses.split(question)):
        for lang, names in _called.items():
            if names.search(clause) and not _negated.search(clause) and _asked.search(clause):
                return lang
    return None


_odd = re.compile("[" + LOOKALIKES[0] + "]")
_no_letter = re.compile(r"[^\w\u0300-\u036f\u0900-\u0963\u0966-\u097f\u0980-\u09ff]|_")


def _clean(text: str | None) -> str:
    if not text:
        return ""
    text = _invisible.sub("", unicodedata.normalize("NFKC", text))
    return text.translate(_latin) if _odd.search(text) else text


def _letters(text: str) -> str:
    return _no_letter.sub("", text.casefold())


def parted(answer: str | None) -> tuple[str, bool]:
    """(the answer without tags, citations and outer white space, whether citations close it)."""
    text = _clean(answer)
    text = (_tags.sub(" ", text) if "<" in text else text).strip()
    cut = _trail.sub("", text).strip()
    return cut, len(cut) < len(text)


def bare(answer: str | None) -> str:
    return parted(answer)[0]


# --- hashed n-grams ----------------------------------------------------------------------------------------------------


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, row of each): digits alike, a space around each text."""
    rows = [f" {re.sub(r'[0-9০-৯०-९]+', '0', t.casefold())} " for t in texts]
    cp = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cp, np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])


def grams(texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of each text, rows in order."""
    cp, row = _codes(texts)
    cp = cp.astype(np.uint64) + np.uint64(1)
    rows, buckets = [], []
    h = np.full(len(cp), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(cp) < n:
            break
        h = (h[: len(cp) - n + 1] ^ cp[n - 1 :]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        if n in sizes:
            inside = row[: len(cp) - n + 1] == row[n - 1 :]
            rows.append(row[: len(cp) - n + 1][inside])
            buckets.append((h[inside] & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(rows) if rows else np.zeros(0, np.int32), np.concatenate(buckets) if buckets else np.zeros(0, np.int32)


class Linear:
    """Logistic regression of one label on mean n-gram weights and features, by AdaGrad over shuffled batches."""

    def __init__(self, sizes: tuple[int, ...], extra: int):
        self.sizes, self.w, self.v, self.b = sizes, np.zeros(BUCKETS if sizes else 0, np.float32), np.zeros(extra), 0.0

    def scores(self, texts: list[str] | tuple[np.ndarray, np.ndarray], extra: np.ndarray) -> np.ndarray:
        s = extra @ self.v + self.b
        if not self.sizes:
            return s
        row, bucket = texts if isinstance(texts, tuple) else grams(texts, self.sizes)
        n = np.maximum(1, np.bincount(row, minlength=len(extra)))
        return s + np.bincount(row, weights=self.w[bucket], minlength=len(extra)) / np.sqrt(n)

    def fit(self, texts: tuple[np.ndarray, np.ndarray] | None, y: np.ndarray, extra: np.ndarray, rows: np.ndarray, epochs: int = 8, rate: float = 0.3, seed: int = 7) -> "Linear":
        """Fit on ``rows`` of (n-grams, labels, features)."""
        rng = np.random.default_rng(seed)
        if self.sizes:
            order = np.argsort(texts[0], kind="stable")
            row, bucket = texts[0][order], texts[1][order]
            bounds = np.searchsorted(row, np.arange(len(y) + 1))
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // 128)):
                s = extra[batch] @ self.v + self.b
                if self.sizes:
                    size = bounds[batch + 1] - bounds[batch]
                    at = np.repeat(bounds[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    own, norm = np.repeat(np.arange(len(batch)), size), 1 / np.sqrt(np.maximum(1, size))
                    b = bucket[at]
                    s = s + np.bincount(own, weights=self.w[b], minlength=len(batch)) * norm
                g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[batch]) / len(batch)
                if self.sizes:
                    grad = np.bincount(b, weights=(g * norm)[own], minlength=BUCKETS)
                    gw += (grad * grad).astype(np.float32)
                    self.w -= (rate * grad / np.sqrt(gw)).astype(np.float32)
                d = extra[batch].T @ g
                gv += d * d
                self.v -= rate * d / np.sqrt(gv)
                gb += g.sum() ** 2
                self.b -= rate * g.sum() / np.sqrt(gb)
        return self


# --- languages of a pair -----------------------------------------------------------------------------------------------


def tongues(texts: list[str], parser: CrossParser | None) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(letters of the sentences of each language, mean phrases of each language) of each text, by the cross-parser; None for a
    text of no letters. Names and the like between the sentences don't count unless there is no sentence."""
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
    if parser is None:
        return out
    parts = []
    for i, t in enumerate(texts):
        own = [u for u in units(t) if is_sentence(u)] or ([t] if len(_letters(t)) >= 8 else [])
        parts += [(i, u) for u in own]
    unique = {u: n for n, u in enumerate(dict.fromkeys(u for _, u in parts))}
    if not unique:
        return out
    cost = by_language(parser, parser.phrases(list(unique)))
    best = cost.argmin(axis=1)
    for i, u in parts:
        n = unique[u]
        if out[i] is None:
            out[i] = (np.zeros(cost.shape[1]), np.zeros(cost.shape[1]))
        out[i][0][best[n]] += len(u)
        out[i][1][:] += cost[n] * len(u)
    return out


# --- features of a pair ------------------------------------------------------------------------------------------------

_closed = re.compile(r"[.!?।॥…][\"')\]”’»]*$")
_enumerator = re.compile(r"(?:^|[.!?।॥:;)\"”\n]\s+|\n)(?:\d{1,2}|[০-৯०-९]{1,2})[.)।]$")
_value = re.compile(r"=\s*\d+$")
_open = re.compile(r"[,;:\-–]$")
_mark = re.compile(r"(?:^|\s)\d{1,2}[.)](?=\s)")


def _end(answer: str) -> str:
    """The last words, whose n-grams tell a sentence that is over from one that is cut; closing marks don't count."""
    return answer.rstrip(" .!?।\"')]”’")[-24:] + "⏎"


def _covered(letters: str, by: str, k: int = 5) -> int:
    """How many of the letters stand in a stretch of ``k`` letters that ``by`` has too."""
    k = min(k, len(letters), len(by))
    known = {by[i : i + k] for i in range(len(by) - k + 1)}
    n, end = 0, 0
    for i in range(len(letters) - k + 1):
        if letters[i : i + k] in known:
            n, end = n + i + k - max(i, end), i + k
    return n


def _overlap(question: str, answer: str) -> tuple[float, float, float]:
    """(share of the answer's letters that the question has in stretches, the reverse share, the answer's other letters)."""
    q, a = _letters(_lead.sub("", question)), _letters(_lead.sub("", answer))
    if not q or not a:
        return 0.0, 0.0, float(len(a))
    own = _covered(a, q)
    return own / len(a), _covered(q, a) / len(q), float(len(a) - own)


#: Features of each label, by their place.
OWN = {"empty": (0, 1, 2), "truncated": (3, 4, 5, 6, 7, 8), "refusal": (9,), "copy": (10, 11, 12, 13), "wrong_language": (14, 15, 16)}
FEATURES = 17


def features(questions: list[str], parts: list[tuple[str, bool]], parser: CrossParser | None) -> np.ndarray:
    """(pairs, FEATURES) of clean questions and parted answers: what OWN shares out among the labels."""
    answers = [text for text, _ in parts]
    x = np.zeros((len(answers), FEATURES))
    # a quotation is no part of the language that an answer is in
    plain = [p if len(_letters(p := _quoted.sub(" ", a))) > 8 else a for a in answers]
    spoken = tongues(questions + plain, parser)
    for i, (q, (a, cited)) in enumerate(zip(questions, parts)):
        letters = _letters(a)
        x[i, 0] = letters in PLACEHOLDERS or not any(c.isalnum() for c in letters)
        x[i, 1] = len(letters) < 4
        x[i, 2] = min(len(letters), 40) / 40
        value, listed = _value.search(a) is not None, _enumerator.search(a) is not None
        closed = not listed and _closed.search(a) is not None
        x[i, 3:9] = closed, cited, _open.search(a) is not None or a.count("(") > a.count(")"), value, listed, not closed and not value
        x[i, 9] = min(len(letters), 400) / 400
        own, back, rest = _overlap(q, a)
        x[i, 10:14] = own, back, own > 0.9 and back > 0.6, min(rest, 30.0) / 30
        asks, says = spoken[i], spoken[len(questions) + i]
        asked = requested(q)
        if says is None or asks is None and not asked:
            continue
        allowed = np.array([lang == asked for lang in parser.languages]) if asked else asks[0] >= 0.1 * asks[0].sum()
        if allowed.any():
            gap = says[1][allowed].min() / max(says[1].min(), 1e-9) - 1
            outside = says[0][~allowed].sum() / max(says[0].sum(), 1e-9)
            x[i, 14:17] = min(gap, 1.0), outside, outside > 0.5 and gap > 0.04
    return x


# --- training ----------------------------------------------------------------------------------------------------------

_WHOLE_GRAMS, _END_GRAMS = (3, 4, 5), (1, 2, 3, 4, 5, 6)


class PairModel:
    """The classifier of each label and its threshold."""

    def __init__(self, pairs: list[tuple[str, str]], known: list[str], parser: CrossParser | None, seed: int = 11, held: Callable[[str], bool] = lambda how: False):
        """``pairs`` answered (question, answer), some with defects of their own, ``known`` refused answers; ways of refusing that
        are ``held`` are left out, so that the rest can be measured on them."""
        clean = [(_clean(q), parted(a)) for q, a in pairs if a]
        # an answer that ends in a full stop or in its citations is over
        sound = [(q, p) for q, p in clean if len(_letters(p[0])) >= 12 and (p[1] or _closed.search(p[0]) and not _enumerator.search(p[0])) and _overlap(q, p[0])[0] < 0.8]
        # sentences that many answer with, whatever was asked, tell nothing of sound answers
        own = [[_letters(u) for u in units(text)] for _, (text, _) in sound]
        often = Counter(u for us in own for u in set(us))
        sound = [pair for pair, us in zip(sound, own) if min((often[u] for u in us), default=0) < OFTEN]
        x = features([q for q, _ in sound], [p for _, p in sound], parser)
        for _ in range(2):  # answered pairs hold defects too, which would blur what is learnt: what a first fit doubts is left out
            self._fit(sound, x, known, parser, np.random.default_rng(seed), held)
            keep = (self._margins([p[0] for _, p in sound], x) < [-DOUBT if d == "refusal" else 0 for d in DEFECTS]).all(axis=1)
            if keep.sum() < 50:
                break
            sound, x = [p for p, k in zip(sound, keep) if k], x[keep]

    @staticmethod
    def _made(sound: list[tuple[str, tuple[str, bool]]], known: list[str], parser: CrossParser | None, rng: np.random.Generator, held: Callable[[str], bool]) -> list[tuple[str, str, int, int]]:
        """(question, answer, label or -1, half of the ways to refuse that the answer is of) made from sound pairs."""
        spoken = tongues([q for q, _ in sound] + [p[0] for _, p in sound], parser)
        by_language: dict[int, list[str]] = {}
        for (_, (text, _)), t in zip(sound, spoken[len(sound) :]):
            if t is not None:
                by_language.setdefault(int(t[0].argmax()), []).append(text)
        rows = []
        for (q, (text, _)), t in zip(sound, spoken):
            kind = rng.integers(0, 10)
            if _value.search(text):  # a value ends an answer too, cited or not
                rows.append((q, text, -1, 0))
            if kind <= 2 and len(text) > 12:
                cut = text[: int(rng.integers(max(4, len(text) // 5), len(text) - 2))].rstrip()
                marks = [m.end() for m in _mark.finditer(text)][1:]
                if marks and rng.random() < 0.5:  # a list is cut off after the mark of its next item
                    cut = text[: marks[rng.integers(0, len(marks))]]
                if not _value.search(cut) and (_enumerator.search(cut) or not _closed.search(cut)):  # what ends a sentence shows no cut
                    rows.append((q, cut + ["", ",", "..."][rng.choice(3, p=[0.9, 0.05, 0.05])], 1, 0))
            elif kind == 4:
                rows.append((q, [q, f"Q: {q}", q.lower(), f"  {q} ", q.upper(), f"{q} {q}", f'"{q}"', q.rstrip("?।. ")][rng.integers(0, 8)], 3, 0))
            elif kind == 5 and t is not None:
                asked = requested(q)
                others = [k for k in by_language if (parser.languages[k] != asked if asked else t[0][k] == 0)]
                if others:
                    pool = by_language[others[rng.integers(0, len(others))]]
                    rows.append((q, pool[rng.integers(0, len(pool))], 4, 0))
            elif kind == 6:
                rows.append((q, ["", " ", "N/A", "-", "null", "...", "<p></p>", "—", "none", "[]", "?", "TBD", "n.a."][rng.integers(0, 13)], 0, 0))
            elif kind == 7:  # an answer that repeats the question and goes on is one
                rows.append((q, f"{q}{' ' if rng.random() < 0.5 else chr(10)}{text}", -1, 0))
            elif kind >= 8:
                half = int(rng.integers(0, 2))
                r = known[rng.integers(0, len(known))] if known and rng.random() < 0.1 else refusals(rng, 1, lambda how: held(how) or (zlib.crc32(how.encode()) >> 3) % 2 != half)[0]
                rows.append((q, r if rng.random() < 0.5 else r.rstrip(".।"), 2, half))
        return rows

    def _fit(self, sound: list[tuple[str, tuple[str, bool]]], x: np.ndarray, known: list[str], parser: CrossParser | None, rng: np.random.Generator, held: Callable[[str], bool]) -> None:
        made = self._made(sound, known, parser, rng, held)
        parts = [parted(a) for _, a, _, _ in made]
        y = np.array([-1] * len(sound) + [r[2] for r in made])
        half = np.array([-1] * len(sound) + [r[3] if r[2] == 2 else -1 for r in made])
        half[half < 0] = rng.integers(0, 2, (half < 0).sum())  # the rest is held out at random
        x = np.vstack([x, features([r[0] for r in made], parts, parser)])
        views = self._views([p[0] for _, p in sound] + [text for text, _ in parts])
        self.labels, self.thresholds = [], np.zeros(len(DEFECTS))
        for k, d in enumerate(DEFECTS):
            # a refusal or a copy lacks its full stop as often as not, which says nothing about a sound answer's end; most made refusals
            # are in another language than their question too, which says nothing about a sound answer's language
            mine = np.flatnonzero((y == -1) | (y == k)) if d in ("truncated", "wrong_language") else np.arange(len(y))
            new = lambda: Linear({"truncated": _END_GRAMS, "copy": (), "wrong_language": ()}.get(d, _WHOLE_GRAMS), len(OWN[d]))
            # each half is scored by a fit on the other one; refusals are parted by their wordings, so the cut is that of unseen ones
            score = np.zeros(len(y))
            for h in (0, 1):
                there = mine[half[mine] != h]
                if len(there):
                    here = mine[half[mine] == h]
                    score[here] = new().fit(views[d], (y == k).astype(float), x[:, OWN[d]], there, epochs=6).scores(views[d], x[:, OWN[d]])[here]
            self.thresholds[k] = self._threshold(score[mine], y[mine] == k)
            self.labels.append(new().fit(views[d], (y == k).astype(float), x[:, OWN[d]], mine, epochs=6))

    @staticmethod
    def _views(texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray] | None]:
        whole = grams(texts, _WHOLE_GRAMS)
        return {"empty": whole, "refusal": whole, "truncated": grams([_end(t) for t in texts], _END_GRAMS), "copy": None, "wrong_language": None}

    def _scores(self, views: dict, x: np.ndarray) -> np.ndarray:
        return np.stack([model.scores(views[d], x[:, OWN[d]]) for d, model in zip(DEFECTS, self.labels)], axis=1)

    def _margins(self, texts: list[str], x: np.ndarray) -> np.ndarray:
        return self._scores(self._views(texts), x) - self.thresholds

    @staticmethod
    def _threshold(score: np.ndarray, y: np.ndarray) -> float:
        """The cut with the best F1 on held-out pairs at the expected share of defects, in the middle of those as good."""
        if not y.any() or y.all():
            return np.inf
        weight = np.where(y, EXPECTED_SHARE / y.mean(), (1 - EXPECTED_SHARE) / max(1e-9, 1 - y.mean()))
        s = np.sort(np.unique(score))
        cuts = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2])
        order = np.argsort(-score, kind="stable")
        hits, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
        n = np.searchsorted(-score[order], -cuts, side="left")  # scores above each cut
        f1 = np.where(n > 0, 2 * hits[np.maximum(n, 1) - 1] / (all_[np.maximum(n, 1) - 1] + (weight * y).sum()), 0.0)
        good = cuts[f1 >= f1.max() - 1e-9]
        return float((good[0] + good[-1]) / 2)

    def judge(self, questions: list[str | None], answers: list[str | None], parser: CrossParser | None) -> list[tuple[str, float] | None]:
        """(defect, margin) of each pair, or None for a sound one; of several defects the one with the largest margin, but an empty
        or copied answer is that before all, and a refusal before it is cut or in another language."""
        parts = [parted(a) for a in answers]
        margin = self._margins([text for text, _ in parts], features([_clean(q) for q in questions], parts, parser))
        out: list[tuple[str, float] | None] = []
        for m in margin:
            first = next((DEFECTS.index(d) for d in ("empty", "copy", "refusal", "wrong_language", "truncated") if m[DEFECTS.index(d)] > 0), None)
            out.append(None if first is None else (DEFECTS[first], float(m[first])))
        return out


def training_rows(queries: DataFrame) -> DataFrame:
    """(kind, a, b): bounded samples of distinct rows, chosen by hash: `pair` (question, answer) and `refusal` (answer)."""
    status = F.lower(F.btrim("status"))
    q = queries.where("answer is not null")
    script = F.when(F.col("answer").rlike("[ঀ-৿]"), "bn").when(F.col("answer").rlike("[ऀ-ॿ]"), "hi").otherwise("la")
    pairs = q.where(status == "answered").select(F.col("question").alias("a"), F.col("answer").alias("b"), script.alias("script"))
    refused = q.where(status == "refused").select(F.lit("").alias("a"), F.col("answer").alias("b"))
    pairs, refused = first_by_hash(pairs, SAMPLE_PAIRS, ["script"], ["a", "b"]), first_by_hash(refused, SAMPLE_REFUSALS, ["a"], ["b"])
    return pairs.select(F.lit("pair").alias("kind"), "a", "b").unionByName(refused.select(F.lit("refusal").alias("kind"), "a", "b"))


def fitted(queries: DataFrame, languages: tuple) -> PairModel:
    """The model of the bounded samples, fitted in one task; the driver gets its weights, under a MB."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in frames for r in zip(pdf["kind"], pdf["a"], pdf["b"])]
        rows.sort(key=lambda r: tuple(x or "" for x in r))
        of = lambda kind: [(a, b) for k, a, b in rows if k == kind]
        model = PairModel(of("pair"), [b for _, b in of("refusal")], parser_of(languages) if languages[1] else None)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    row = training_rows(queries).coalesce(1).mapInPandas(run, "model binary").first()
    return pickle.loads(row.model) if row else PairModel([], [], None)


def defects(queries: DataFrame, labels: DataFrame, query_id: str = "id") -> DataFrame:
    """(query_id, defect, margin) of each answered pair with a defect, one row for each row of ``queries`` that has one.

    ``queries`` has (question, answer, status), ``labels`` (label, text), texts with a language label, of which some are wrong.
    Only status `answered` counts, whatever its case and spacing. A null answer is empty; a null or blank question asks for no
    language and can't be copied. Repeated rows give repeated rows; where no pair is sound nothing is learnt or found. Narrow, but for the samples that the model is fitted on.
    """
    languages = fitted_languages(labels)
    model = fitted(queries, languages)
    kind = queries.schema[query_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = (pdf["question"].map(lambda t: len(t) if t else 0) + pdf["answer"].map(lambda t: len(t) if t else 0)).cumsum() // GROUP_CHARS
            for _, part in pdf.groupby(size.to_numpy(), sort=False):
                judged = model.judge(list(part["question"]), list(part["answer"]), parser_of(languages) if languages[1] else None)
                yield pd.DataFrame([(i, *j) for i, j in zip(part["query_id"], judged) if j], columns=["query_id", "defect", "margin"])

    answered = queries.where(F.lower(F.btrim(F.regexp_replace("status", r"[\s ]+", " "))) == "answered")
    return answered.select(F.col(query_id).alias("query_id"), "question", "answer").mapInPandas(run, f"query_id {kind}, defect string, margin double")
