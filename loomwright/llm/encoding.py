"""Encoding of a corpus with a public byte-level BPE: distinct words share the encodings of their prefixes in a trie."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
#: The pattern that cuts a text into words before merging. A fixed value of this vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps from batch to batch; beyond it they are dropped and computed again, with the same result.
KEPT_WORDS = 400_000
#: A word longer than this is encoded by itself, not put into the trie, as it would share nothing.
TRIE_BYTES = 64


class Bpe:
    """Ranks of a vocabulary file, and the states of its encodings.

    The encoding of a byte string ends in exactly one token; taking it off leaves a prefix whose encoding is the rest. So the
    last token of each prefix is all that has to be known: of the tokens that end a prefix it is the one that stays apart from
    the last token before it when the two are merged together.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.spelling = {r: b for b, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.apart: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids by merging the neighbours of lowest rank, again and again."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 30:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks[i] == low:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def stays_apart(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.apart.get(pair)
        if known is None:
            known = self.apart[pair] = self.merge(self.spelling[left] + self.spelling[right]) == [left, right]
        return known

    def extend(self, word: bytes, last: list[int]) -> None:
        """Append the last token of each further prefix of ``word``; ``last`` has those of the prefixes known so far."""
        ranks = self.ranks
        for end in range(len(last) + 1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(word[start:end])
                if token is not None and (start == 0 or self.stays_apart(last[start - 1], token)) and (start > 0 or self.whole(token)):
                    last.append(token)
                    break

    def whole(self, token: int) -> bool:
        """The token's spelling is encoded as the token itself."""
        pair = (token, -1)
        known = self.apart.get(pair)
        if known is None:
            known = self.apart[pair] = self.merge(self.spelling[token]) == [token]
        return known

    def ids(self, word: bytes, last: list[int]) -> list[int]:
        out, end = [], len(word)
        while end:
            out.append(token := last[end - 1])
            end -= len(self.spelling[token])
        return out[::-1]

    def learn(self, words: set[str]) -> None:
        """Encode distinct words: in sorted order they are the trie's depth-first walk, and ``last`` the path's states."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        path, last = b"", []
        for raw, word in sorted((w.encode(), w) for w in words):
            if len(raw) > TRIE_BYTES:
                own: list[int] = []
                self.extend(raw, own)
                self.words[word] = self.ids(raw, own)
                continue
            shared = 0
            for a, b in zip(path, raw):
                if a != b:
                    break
                shared += 1
            del last[shared:]
            self.extend(raw, last)
            path = raw
            self.words[word] = self.ids(raw, last)


_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """(Bpe, words finder), once for each worker."""
    if path not in _loaded:
        import regex

        any_words = regex.compile(WORDS).findall
        # the same pattern for plain ASCII, where the standard library is faster and \\p{L}, \\p{N} are ranges
        ascii_words = re.compile(WORDS.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII).findall
        _loaded[path] = (Bpe(path), lambda t: ascii_words(t) if t.isascii() else any_words(t))
    return _loaded[path]


def encoder(path: str):
    """A function that encodes a list of texts; null and empty texts give no ids."""
    bpe, words_of = load(path)

    def encode(texts: list[str | None]) -> list[list[int]]:
        split = [words_of(t) if t else () for t in texts]
        new = set().union(*split) - bpe.words.keys() if split else set()
        known = bpe.words
        if new:
            if len(known) + len(new) > KEPT_WORDS:
                new = set().union(*split)
            bpe.learn(new)
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]

    return encode


def _path(vocabulary: str, tokenizers: str) -> str:
    return os.path.join(tokenizers, f"{vocabulary}.tiktoken")


#: Texts are taken together up to so many characters: words are looked for in the trie once for each such group.
GROUP_CHARS = 4_000_000


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group: list[str | None] = []
    size = 0
    for t in texts:
        if group and size + len(t or "") > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t or "")
    if group:
        yield group


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the ids of each row's text, special strings as plain text; an empty or null text gives an empty list.

    Narrow: each task encodes its own rows and nothing is shuffled. Repeated rows give repeated rows; the order of rows is kept.
    """
    path = _path(vocabulary, tokenizers)
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            offset = 0
            for group in _groups(batch.column(1).to_pylist()):
                ids = pa.array(code(group), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(offset, len(group)), ids], ["doc_id", "ids"])
                offset += len(group)

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokens): as encode(), with the number of ids only."""
    path = _path(vocabulary, tokenizers)
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, words_of = load(path)
        for batch in batches:
            offset = 0
            for group in _groups(batch.column(1).to_pylist()):
                split = [words_of(t) if t else () for t in group]
                every = set().union(*split)
                new = every - bpe.words.keys()
                if new:
                    bpe.learn(every if len(bpe.words) + len(new) > KEPT_WORDS else new)
                size = {w: len(bpe.words[w]) for w in every}
                counts = pa.array([sum(map(size.__getitem__, words)) for words in split], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(offset, len(group)), counts], ["doc_id", "tokens"])
                offset += len(group)

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, tokens long")
