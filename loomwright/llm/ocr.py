"""Text of scanned pages made whole: broken words, misread words, running headers and page numbers.

A line is a running header if it has a title's form and it runs: its parts, or most of their words, stand on several pages. The
rest is a noisy channel: how often a stretch of a word is misread as another is learned from the scanned words that no clean text
has, a candidate's likelihood is that of the corpus n-grams, and Viterbi chooses among the candidates of a page's words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Words of the clean text, the most frequent, whose occurrences aren't handed on, as no candidate can beat them: those that one
#: can beat are found by their candidates and handed on after all, so this spares work and changes no result.
FREQUENT = 5_000
#: A word of clean text that is this much rarer than a candidate may itself be misread.
RARER = 200
#: Misreadings kept: those of several words and with this share of all, so no more than its inverse.
LEAST_SHARE, LEAST_WORDS = 0.0002, 2
#: Misreadings within one word; longer strings are no words.
MOST_EDITS, LONGEST = 2, 40
#: Pages on which a part of a header stands at least, and the share of running words by which a misread part is one too.
RUNNING_PAGES, RUNNING_SHARE = 3, 0.6
#: Weight of the unigram beside the bigram, in counts.
PRIOR = 1.0

_CLEAN_WORD = r"[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*"
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_PAGE = re.compile(r"\W*(?:p(?:a[g9][ec])?\.?|PA[G6][EF]|S\.|Seite)?[\W_]*(?:[0-9OolIiSBzZ|]{1,5}|[ivxlcdm]{1,8})(?:[\W_]{1,3}[0-9OolISBzZ|]{1,5})?\W*", re.I)
_BREAK = re.compile(r"([^\W_]+(?:['’-][^\W_]+)*)[-¬‐‑\xad]\s*$")
_NUMBER = str.maketrans("oOlISBzZ|", "001158227")


def kind_of(line: str) -> str | None:
    """`header`, `page_number` or None for a line of running text or a blank one, by its form alone.

    A page number is a number or numeral by itself, however it is set off or misread. What may be a header has no sentence's end
    and no more than one word in small letters ("and"), as titles and section names do; one with a page number may be too.
    """
    s = line.strip()
    if not s:
        return None
    if _PAGE.fullmatch(s):
        return "page_number" if re.search(r"[0-9]|^\W*[ivxlcdmVXI]+\W*$|[Oo][lI]|[lI]{2}|[lI][Oo]", s) else None
    words = [w for w in re.findall(r"[^\W_]+", s) if not w.isdigit()]
    small = sum(w[0].islower() for w in words)
    long = [w for w in words if len(w) >= 4]
    if long and small <= 1 and small < len(words) and not re.search(r"[.!?,;:।]$", s) and not re.search(r"\bN[o0]\.", s):
        return "header"
    return None


# Letters that scans take for one another, each class by one letter.
_FOLD = str.maketrans("o0cefti1l|jnhmurb6dg9qs5z2", "oooooo" + "iiiii" + "nnnnn" + "bbb" + "ggg" + "ss" + "zz")
_PART = re.compile(r"\s[-–—|·•]\s|\s{2,}|\||(?<=\d)[.]?\s+(?=[^\W\d_])|(?<=[^\W\d_])\s+(?=\d{1,3}$)")


def header_parts(line: str) -> list[tuple[str, list[str]]]:
    """(key, words) of the parts of a line, between its numbers and marks: the letters as a scan might confuse them."""
    out = []
    for part in _PART.split(line.strip()):
        words = [w for x in re.findall(r"[^\W_]+", part.lower()) if sum(c.isalpha() for c in x) >= 2 and (w := x.translate(_FOLD))]
        if words:
            out.append(("".join(words), words))
    return out


def running_headers(pages: DataFrame) -> DataFrame:
    """(chunk_id, headers): the numbers of the lines of each page that are running headers.

    A line that may be one by its form is one if a part of it stands on RUNNING_PAGES pages, or if RUNNING_SHARE of a part's words
    are words of such parts. Parts are counted over distinct pages in two steps, and words are compared once for each distinct part.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(chunk, no, key, words) for chunk, text in zip(pdf["chunk_id"], pdf["text"]) for no, line in enumerate(text.split("\n"), 1) if kind_of(line) == "header" for key, words in header_parts(line)]
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "part", "words"])

    parts = materialise(pages.mapInPandas(run, "chunk_id string, line_no int, part string, words array<string>"), "ocr-parts")
    pages_of = parts.groupBy("part", "chunk_id").agg(F.first("words").alias("words")).groupBy("part").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    pages_of = materialise(pages_of.withColumn("runs", F.col("n") >= RUNNING_PAGES), "ocr-running")
    words = pages_of.where("runs").select(F.explode("words").alias("word")).distinct().withColumn("known", F.lit(1))
    others = pages_of.where("not runs").select("part", F.explode("words").alias("word")).join(words, "word", "left").groupBy("part").agg((F.sum(F.coalesce("known", F.lit(0)) * F.length("word")) / F.sum(F.length("word"))).alias("share"))
    found = pages_of.where("runs").select("part").unionByName(others.where(F.col("share") >= RUNNING_SHARE).select("part"))
    return parts.select("chunk_id", "line_no", "part").join(found, "part").groupBy("chunk_id").agg(F.collect_set("line_no").alias("headers"))


def body(text: str, headers: set[int]) -> tuple[list[tuple[int, str]], list[tuple[int, str, str, str]]]:
    """((line_no, noise) of headers and page numbers, tokens of the rest). ``headers`` are the lines that run.

    A token is (line_no, word, joined, between): the word in lower case, for a word broken over lines with its hyphen, and then
    also ``joined`` without it.
    """
    noise, tokens = [], []
    held: tuple[int, str] | None = None
    for no, line in enumerate(text.split("\n"), 1):
        if (kind := kind_of(line)) == "page_number" or no in headers:
            noise.append((no, "header" if no in headers else kind))
            continue
        if not line.strip():
            continue
        words = _WORD.findall(line)
        if held is not None:
            first = re.match(r"\s*(" + _WORD.pattern + ")", line)
            if first and not first.group(1)[0].isupper():
                right = first.group(1).lower()
                # a break in a word that has a hyphen of its own leaves that one alone
                tokens.append((held[0], f"{held[1]}-{right}", held[1] + right, ""))
                words = words[1:]
            else:
                tokens.append((held[0], held[1], "", ""))
            held = None
        broken = _BREAK.search(line)
        if broken and words:
            held = (no, broken.group(1).lower())
            words = words[:-1]
        tokens += [(no, w.lower(), "", "" if not any(c.isupper() for c in w[1:]) else w) for w in words]
    if held is not None:
        tokens.append((held[0], held[1], "", ""))
    return noise, tokens


def _is_code(word: str, raw: str) -> bool:
    """A number, a model's name or the like: digits with capitals, or nothing but digits and what they are misread as."""
    digits = sum(c.isdigit() for c in word)
    if not digits:
        return False
    plain = word.translate(_NUMBER).replace("-", "")
    return plain.isdigit() or bool(raw) or re.search(r"\d{3}|-\d", word) is not None


def clean_bigrams(chunks: DataFrame) -> DataFrame:
    """(w1, w2, n) of the text that was not scanned; a text begins with `^`."""
    words = F.concat(F.array(F.lit("^")), F.regexp_extract_all(F.lower("text"), F.lit(_CLEAN_WORD), F.lit(0)))
    pairs = chunks.where("extraction <> 'ocr-eng' and text is not null").select(words.alias("w"))
    pairs = pairs.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("w1"), F.col("p.b").alias("w2")).agg(F.count("*").alias("n"))


def _holes(words: DataFrame, word: str, prefix: str) -> DataFrame:
    """(key, part, n): each word with each stretch of one or two characters left out; key is what stays around it."""
    places = F.expr(f"flatten(transform(array(1, 2), k -> transform(sequence(1, greatest(length({word}) - k + 1, 1)), i -> struct(i AS i, k AS k))))")
    out = words.select(word, "n", F.explode(places).alias("h"))
    return out.select(F.col(word).alias(f"w_{prefix}"), F.expr(f"concat(substring({word}, 1, h.i - 1), '*', substring({word}, h.i + h.k))").alias("key"), F.expr(f"substring({word}, h.i, h.k)").alias(prefix), F.col("n").alias(f"n_{prefix}"))


def confusions(unknown: DataFrame, words: DataFrame) -> list[tuple[str, str, float]]:
    """(seen, meant, log probability): stretches in which unknown words differ from a clean one that is otherwise the same.

    ``unknown`` and ``words`` have (word, n). Each has at least LEAST_SHARE of all, so a table of bounded size goes to the driver.
    """
    a = _holes(unknown.where(rf"length(word) between 3 and {LONGEST} and word rlike r'^[\p{{L}}\p{{N}}]+$' and word rlike r'\p{{L}}{{2}}'"), "word", "seen")
    b = _holes(words.where(rf"length(word) between 3 and {LONGEST} and n >= 3 and word rlike r'^\p{{L}}+$'"), "word", "meant")
    pairs = a.join(b, "key").where("left(seen, 1) <> left(meant, 1) and right(seen, 1) <> right(meant, 1)")
    pairs = pairs.select("w_seen", "seen", "meant", "n_seen").distinct()
    often = pairs.groupBy("seen", "meant").agg(F.sum("n_seen").alias("all"))
    # a word that differs from several in several ways counts for the way that is most common over all words
    best = pairs.join(often, ["seen", "meant"]).groupBy("w_seen").agg(F.max_by(F.struct("seen", "meant", "n_seen"), F.struct("all", "seen", "meant")).alias("b"))
    found = materialise(best.groupBy("b.seen", "b.meant").agg(F.sum("b.n_seen").alias("n"), F.count("*").alias("kinds")).where(F.col("kinds") >= LEAST_WORDS), "ocr-confusions")
    total = found.agg(F.sum("n")).first()[0] or 1
    return [(r.seen, r.meant, math.log(r.n / total)) for r in found.where(F.col("n") >= LEAST_SHARE * total).orderBy(F.desc("n"), "seen", "meant").collect()]


def _scanned(chunks: DataFrame) -> DataFrame:
    return chunks.where("extraction = 'ocr-eng' and text is not null").select(F.col("id").alias("chunk_id"), "text").distinct()


def parsed(pages: DataFrame, skipped: frozenset[str], only: bool = False) -> DataFrame:
    """(chunk_id, line_no, noise, at, word, joined, prev, next): headers and page numbers, broken words, and the words that are
    not ``skipped`` with their neighbours; with ``only`` just the words that are. ``at`` counts a page's words. ``pages`` has
    (chunk_id, text, headers). Narrow."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for chunk, text, headers in zip(pdf["chunk_id"], pdf["text"], pdf["headers"]):
                noise, tokens = body(text, set(headers) if headers is not None else set())
                rows += [(chunk, no, kind, -1, "", "", "", "") for no, kind in noise if not only]
                for at, (no, word, joined, raw) in enumerate(tokens):
                    if not joined and word in skipped if only else joined or word not in skipped and not _is_code(word, raw):
                        prev = tokens[at - 1][1] if at else "^"
                        after = tokens[at + 1][1] if at + 1 < len(tokens) else ""
                        rows.append((chunk, no, "hyphen" if joined else "", at, word, joined, prev, after))
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "noise", "at", "word", "joined", "prev", "next"])

    return pages.mapInPandas(run, "chunk_id string, line_no int, noise string, at int, word string, joined string, prev string, next string")


def candidates(tokens: DataFrame, words: DataFrame, table: list[tuple[str, str, float]]) -> DataFrame:
    """(word, choices) of distinct ``word``: each clean word it may stand for with the channel's log probability and its count.

    Misreadings are undone in the word, at most MOST_EDITS of them, and what comes out is looked up in the clean words by a join.
    """

    by_first: dict[str, list[tuple[str, str, float]]] = {}
    for seen, meant, lp in table:
        by_first.setdefault(seen[:1], []).append((seen, meant, lp))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for word in pdf["word"]:
                best = {word: 0.0}
                edge = [(word, 0.0, 0)]
                for _ in range(MOST_EDITS):
                    nxt = []
                    for w, score, start in edge:
                        for i in range(start, len(w)):
                            for seen, meant, lp in by_first.get(w[i], ()):
                                if w.startswith(seen, i):
                                    new, s = w[:i] + meant + w[i + len(seen) :], score + lp
                                    if best.get(new, -1e9) < s:
                                        best[new] = s
                                        nxt.append((new, s, i + len(meant)))
                    edge = nxt
                rows += [(word, w, s) for w, s in best.items()]
            yield pd.DataFrame(rows, columns=["word", "choice", "lp"])

    tried = tokens.select("word").distinct().where(F.length("word") <= LONGEST).mapInPandas(run, "word string, choice string, lp double")
    known = tried.join(words.select(F.col("word").alias("choice"), "n"), "choice")
    return known.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("lp", "n", "choice")), asc=False).alias("choices"))


def _viterbi(page: list, pairs: dict[tuple[str, str], int], total: float) -> list[tuple[int, str, str, str]]:
    """(line_no, noise, word, observed) of a page's broken and corrected words. ``page`` has the suspect words in order."""

    def step(prev: str, n_prev: float, word: str, n: float) -> float:
        return math.log((pairs.get((prev, word), 0) + PRIOR * max(n, 0.1) / total) / (n_prev + PRIOR))

    out, run = [], []

    def close() -> None:
        if not run:
            return
        paths = {run[0]["prev"]: (0.0, 1.0, [])}
        for tok in run:
            nxt: dict[str, tuple[float, float, list]] = {}
            for word, lp, n in tok["states"]:
                best = max(((score + step(p, n_p, word, n) + lp, trail) for p, (score, n_p, trail) in paths.items()), key=lambda x: x[0])
                if word not in nxt or nxt[word][0] < best[0]:
                    nxt[word] = (best[0], n, [*best[1], word])
            paths = nxt
        after = run[-1]["next"]
        best = max(paths.items(), key=lambda kv: kv[1][0] + (math.log((pairs.get((kv[0], after), 0) + 0.01) / (kv[1][1] + PRIOR)) if after else 0.0))
        for tok, word in zip(run, best[1][2]):
            seen = {tok["word"], tok["joined"]} - {""}
            if tok["noise"] == "hyphen":
                out.append((tok["line_no"], "hyphen", word, tok["word"]))
            if word not in seen:
                out.append((tok["line_no"], "misread", word, tok["word"]))
        run.clear()

    for tok in page:
        if run and tok["at"] != run[-1]["at"] + 1:
            close()
        run.append(tok)
    close()
    return out


def _states(tok) -> list[tuple[str, float, float]]:
    """(word, log probability of what was read, count): the word as read if it is known or nothing else is, and its candidates."""
    states: dict[str, tuple[float, float]] = {}
    for choices, seen in ((tok["choices"], tok["word"]), (tok["joined_choices"], tok["joined"])):
        choices = () if choices is None else choices
        own = max((c["n"] for c in choices if c["choice"] == seen), default=0)
        for c in choices:
            word, lp, n = c["choice"], c["lp"], c["n"]
            if word != seen and own and n < RARER * own:
                continue
            if word not in states or states[word][0] < lp:
                states[word] = (lp, float(n))
    if not states:
        states[tok["joined"] or tok["word"]] = (0.0, 0.0)
    return [(w, lp, n) for w, (lp, n) in states.items()]


def _decoded(tokens: DataFrame, choices: DataFrame, bigrams: DataFrame, total: float) -> DataFrame:
    """(chunk_id, line_no, noise, word, observed): broken and misread words as they were meant."""
    joined = choices.select(F.col("word").alias("joined"), F.col("choices").alias("joined_choices"))
    suspects = tokens.join(choices, "word", "left").join(joined, "joined", "left").where("choices is not null or joined_choices is not null or noise = 'hyphen'")
    fields = ["at", "line_no", "noise", "word", "joined", "prev", "next", "choices", "joined_choices"]
    pages = materialise(suspects.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("page")), "ocr-pages")

    def pairs_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = set()
            for chunk, page in zip(pdf["chunk_id"], pdf["page"]):
                before, last = [], -9
                for tok in page:
                    words = [s[0] for s in _states(tok)]
                    rows.update((chunk, p, w) for p in (before if tok["at"] == last + 1 else [tok["prev"]]) for w in words)
                    if tok["next"]:
                        rows.update((chunk, w, tok["next"]) for w in words)
                    before, last = words, tok["at"]
            yield pd.DataFrame(list(rows), columns=["chunk_id", "w1", "w2"])

    counts = pages.mapInPandas(pairs_of, "chunk_id string, w1 string, w2 string").join(bigrams, ["w1", "w2"])
    counts = counts.groupBy("chunk_id").agg(F.collect_list(F.struct("w1", "w2", "n")).alias("pairs"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for chunk, page, pairs in zip(pdf["chunk_id"], pdf["page"], pdf["pairs"]):
                known = {(p["w1"], p["w2"]): p["n"] for p in pairs} if pairs is not None else {}
                rows += [(chunk, *r) for r in _viterbi([{**tok, "states": _states(tok)} for tok in page], known, total)]
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "noise", "word", "observed"])

    return pages.join(counts, "chunk_id", "left").mapInPandas(decode, "chunk_id string, line_no int, noise string, word string, observed string")


def noise(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no, noise, word, observed): every header, page number, broken and misread word of the scanned chunks.

    ``chunks`` has (id, text, extraction). Lines are numbered from 1, blank ones included. For broken and misread words ``word``
    is the intended whole word in lower case and ``observed`` what stands there; both are empty for lines. Null, empty and blank
    texts give no row; a chunk delivered twice counts once; without clean text nothing is misread. Counts and misreadings are
    those of all chunks; only the frequent words and the misreadings, both of bounded number, pass through the driver. A line of
    a title's form that doesn't run over pages is text.
    """
    bigrams = materialise(clean_bigrams(chunks), "ocr-bigrams")
    words = bigrams.groupBy(F.col("w2").alias("word")).agg(F.sum("n").alias("n"))
    words = materialise(words, "ocr-words")
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    most = words.where("n >= 5").orderBy(F.desc("n"), "word").limit(FREQUENT)
    frequent = frozenset(r.word for r in most.collect())
    scanned = _scanned(chunks)
    pages = materialise(scanned.join(running_headers(scanned), "chunk_id", "left"), "ocr-lines")
    rows = materialise(parsed(pages, frequent), "ocr-tokens")
    tokens = rows.where("at >= 0")
    unknown = tokens.where("noise = ''").groupBy("word").agg(F.count("*").alias("n")).join(words.select("word"), "word", "left_anti")
    table = confusions(unknown, words)
    if table:
        rival = candidates(most, words, table).join(most, "word").where(F.exists("choices", lambda c: (c["choice"] != F.col("word")) & (c["n"] >= RARER * F.col("n"))))
        if beaten := frozenset(r.word for r in rival.select("word").collect()):
            tokens = tokens.unionByName(materialise(parsed(pages, beaten, only=True), "ocr-tokens"))
    wanted = tokens.select("word").union(tokens.where("joined <> ''").select(F.col("joined").alias("word")))
    found = _decoded(tokens, candidates(wanted, words, table), bigrams, total)
    return rows.where("at < 0").select("chunk_id", "line_no", "noise", "word", F.lit("").alias("observed")).unionByName(found)


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): each scanned chunk as whole paragraphs: no headers and page numbers, broken words whole, misread words as
    meant, lines of a paragraph in one. Blank lines part paragraphs; a null text stays null."""
    fixes = noise(chunks).groupBy("chunk_id").agg(F.collect_list(F.struct("line_no", "noise", "word", "observed")).alias("fixes"))
    pages = chunks.where("extraction = 'ocr-eng'").select(F.col("id").alias("chunk_id"), "text").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "text": [mend(t, f if f is not None else []) for t, f in zip(pdf["text"], pdf["fixes"])]})

    return pages.join(fixes, "chunk_id", "left").mapInPandas(run, "chunk_id string, text string")


def _cased(word: str, like: str) -> str:
    return word.upper() if len(like) > 1 and like.isupper() else word[:1].upper() + word[1:] if like[:1].isupper() else word


def mend(text: str | None, fixes: list) -> str | None:
    """``text`` with its fixes (line_no, noise, word, observed) made."""
    if text is None:
        return None
    dropped = {f["line_no"] for f in fixes if f["noise"] in ("header", "page_number")}
    whole = {f["line_no"]: f["word"] for f in fixes if f["noise"] == "hyphen"}
    meant = {(f["line_no"], f["observed"]): f["word"] for f in fixes if f["noise"] == "misread"}
    paragraphs: list[list[str]] = [[]]
    carried = False
    for no, line in enumerate(text.split("\n"), 1):
        if no in dropped:
            continue
        if not line.strip():
            paragraphs.append([])
            continue
        if carried:  # the rest of a broken word went to the line before
            first = re.match(r"\s*" + _WORD.pattern + r"(\S*)\s*", line)
            if first:
                paragraphs[-1][-1] += first.group(1)
                line = line[first.end() :]
            carried = False
        line = _WORD.sub(lambda m: _cased(w, m.group()) if (w := meant.get((no, m.group().lower()))) else m.group(), line)
        if no in whole and (broken := _BREAK.search(line)):
            line = line[: broken.start()] + _cased(whole[no], broken.group(1))
            carried = True
        if line.strip():
            paragraphs[-1].append(line.strip())
    return "\n\n".join(re.sub(r"\s+", " ", " ".join(p)) for p in paragraphs if p)
