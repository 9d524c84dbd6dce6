"""One consistent form for texts that look the same but differ in their characters."""

from __future__ import annotations

from functools import reduce
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

# Letters of other scripts that look like the Latin letter below them, by script.
LIKE_LATIN = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХԌԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXGWaesijopcyxhdqwl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοαιρυνκϲϳ", "ABEZHIKMNOPTYXCoaipuvkcj"),
    "Armenian": ("ՕՍօսհո", "OUouhn"),
}
#: All of these and their Latin letters.
LOOKALIKES = ("".join(x for x, _ in LIKE_LATIN.values()), "".join(y for _, y in LIKE_LATIN.values()))
#: Invisible: soft hyphen, grapheme joiner, zero-width characters, direction marks, word joiner, byte order mark, variation selectors.
INVISIBLE = r"[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]"
#: Every kind of space, each by one plain space.
SPACES = r"[\t\n\u000B\f\r\u0085   -     　]"
HYPHENS = r"[‐‑﹣－]"
SCRIPTS = ("Latin", *LIKE_LATIN)
_ODD_LETTER = "[" + "".join(rf"\p{{Is{x}}}" for x in LIKE_LATIN) + "]"
_TOKEN = r"[\p{L}\p{M}\p{N}]+"


def _plain(ch: str) -> str | None:
    """The plain form of a wide, narrow or ligature character."""
    parts = unicodedata.decomposition(ch).split()
    if parts and (parts[0] in ("<wide>", "<narrow>") or 0xFB00 <= ord(ch) <= 0xFB06):
        return unicodedata.normalize("NFKC", ch)
    return None


_WIDE = {c: p for c in map(chr, (*range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF))) if (p := _plain(c))}


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def surface(text: Column) -> Column:
    """The text without invisible characters, with plain spaces, hyphens and letter widths, outer spaces dropped.

    Spaces are replaced one by one, as two look different from one.
    """
    one = {c: p for c, p in _WIDE.items() if len(p) == 1}
    text = F.translate(F.regexp_replace(text, INVISIBLE, ""), "".join(one), "".join(one.values()))
    text = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_WIDE[c])), [c for c in _WIDE if len(_WIDE[c]) > 1], text)
    return F.btrim(F.regexp_replace(F.regexp_replace(text, SPACES, " "), HYPHENS, "-"))


def composed(df: DataFrame, column: str) -> DataFrame:
    """``column`` in Unicode's composed form."""
    return df.withColumn(column, _composed(F.col(column)))


def in_script(token: Column, script: str) -> Column:
    """The token with every look-alike as a letter of ``script``; null if a letter of another one of SCRIPTS is left."""
    plain = F.translate(token, *LOOKALIKES)
    if script != "Latin":
        plain = F.translate(plain, LIKE_LATIN[script][1], LIKE_LATIN[script][0])
    others = "".join(rf"\p{{Is{x}}}" for x in SCRIPTS if x != script)
    return F.when(~plain.rlike(f"[{others}]"), plain)


def _letters_of(text: str, script: str) -> Column:
    return F.length(F.regexp_replace(text, rf"[^\p{{Is{script}}}]+", ""))


def bits(column: str) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(column))


def surfaced(rows: DataFrame, row_id: str, *columns: str) -> DataFrame:
    """(id, name, chars, form): a row for each text of ``columns`` that is not null, with 128 bits of it and its surface. Narrow."""
    long = rows.select(F.col(row_id).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("text")) for c in columns])).alias("c"))
    long = long.select("id", "c.name", "c.text").where("text is not null")
    return composed(long.select("id", "name", bits("text").alias("chars"), surface(F.col("text")).alias("form")), "form")


def repairs(surfaces: DataFrame) -> DataFrame:
    """(form, mended) for the distinct (form) that hold misplaced look-alikes.

    The dominant script of a token is the one of most of its letters, then of its text's. A token of several scripts is mixed: its
    look-alikes become letters of its dominant script, or else of the next one. A token all of whose letters are look-alikes has no
    mixture of its own, but with its text where most letters are of other scripts; it becomes one of the script that is most
    frequent there, Latin before others. Either is done only if the result is wholly of that script and in the corpus vocabulary, a
    token of some text that isn't mixed. Only texts with Greek, Cyrillic or Armenian letters and those words of the corpus that a
    repair asks for are shuffled.
    """
    odd = surfaces.select("form").where(F.col("form").rlike(_ODD_LETTER)).distinct()
    tokens = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)))).alias("token")
    odd = odd.select("form", F.length(F.regexp_replace("form", r"\P{L}+", "")).alias("letters"), *[_letters_of("form", x).alias(f"text_{x}") for x in SCRIPTS])
    suspect = odd.select("*", tokens("form")).where(F.col("token").rlike(_ODD_LETTER))
    suspect = suspect.select("*", *[_letters_of("token", x).alias(f"own_{x}") for x in SCRIPTS])
    mixed = sum(F.when(F.col(f"own_{x}") > 0, 1).otherwise(0) for x in SCRIPTS) > 1
    # a script's rank in a mixed token is that of its letters there, then in the text; in a token of one script that of the text alone
    foreign = sum(F.when(F.col(f"own_{x}") > 0, F.col(f"text_{x}")).otherwise(0) for x in SCRIPTS) * 2 < F.col("letters")
    there = {x: F.col(f"text_{x}") * 2 + (1 if x == "Latin" else 0) for x in SCRIPTS}
    rank = {x: F.when(mixed, F.when(F.col(f"own_{x}") > 0, F.col(f"own_{x}") * 1_000_000 + there[x])).when(foreign & (F.col(f"own_{x}") == 0), there[x]) for x in SCRIPTS}
    tries = F.array(*[F.struct((-rank[x]).alias("order"), F.lit(i).alias("script"), in_script(F.col("token"), x).alias("word")) for i, x in enumerate(SCRIPTS)])
    suspect = suspect.select("form", "token", F.explode(F.filter(tries, lambda t: t["order"].isNotNull() & t["word"].isNotNull() & (t["word"] != F.col("token")))).alias("t")).select("form", "token", "t.order", "t.script", "t.word")
    wanted = suspect.select(F.col("word").alias("token")).distinct()
    unmixed = ~(F.col("token").rlike(_ODD_LETTER) & F.col("token").rlike(r"\p{IsLatin}"))
    known = surfaces.select(tokens("form")).where(unmixed).join(wanted, "token", "left_semi").select(F.col("token").alias("word")).distinct()
    fixes = suspect.join(known, "word").groupBy("form", "token").agg(F.min(F.struct("order", "script", "word"))["word"].alias("word"))
    fixes = fixes.groupBy("form").agg(F.collect_list(F.struct("token", "word")).alias("fixes"))
    # longest first, so that no token is replaced inside a longer one
    fixes = fixes.withColumn("fixes", F.array_sort("fixes", lambda a, b: F.length(b["token"]) - F.length(a["token"])))
    return fixes.select("form", F.aggregate("fixes", F.col("form"), lambda t, x: F.replace(t, x["token"], x["word"])).alias("mended"))


def unified(rows: DataFrame, row_id: str, *columns: str) -> DataFrame:
    """(id, name, chars, form): the texts of ``columns``, one row each, with 128 bits of them and their consistent form.

    Null texts give no row, blank ones an empty form; repeated rows stay; letter case, digits and anything else a reader can
    see stay. Surfaces are written once; texts without letters of other scripts that look alike are not shuffled.
    """
    surfaces = materialise(surfaced(rows, row_id, *columns), "surfaces")
    odd = F.col("form").rlike(_ODD_LETTER)
    mended = surfaces.where(odd).join(repairs(surfaces), "form", "left").select("id", "name", "chars", F.coalesce("mended", "form").alias("form"))
    return surfaces.where(~odd).unionByName(mended)


def look_same(rows: DataFrame, row_id: str = "id", text: str = "question", other: str | None = "search_question") -> DataFrame:
    """(query_id, other_id): two rows whose ``text`` looks the same in different characters, the smaller id first, and one row
    with itself if its ``text`` and ``other`` do. Blank and null texts look like nothing and pair with none.

    Classes of one form are joined by 128 bits of the form and only where a class has more than one spelling; equal spellings
    are never paired, so copies of one text cost nothing.
    """
    form = unified(rows, row_id, *([text, other] if other else [text])).where("form <> ''")
    form = materialise(form.select("id", "name", "chars", bits("form").alias("look")), "looks")
    own = form.where(F.col("name") == text).select("id", "look", "chars")
    several = own.groupBy("look").agg(F.min("chars").alias("a"), F.max("chars").alias("b")).where("a <> b").select("look")
    own = own.join(several, "look", "left_semi").distinct()
    a, b = own.select("look", F.col("id").alias("query_id"), F.col("chars").alias("a")), own.select("look", F.col("id").alias("other_id"), F.col("chars").alias("b"))
    pairs = a.join(b, "look").where("a <> b and query_id < other_id").select("query_id", "other_id")
    if not other:
        return pairs.distinct()
    # copies of a row have the same texts; rows of one id with other texts are compared with all of them
    both = form.groupBy("id", "look").agg(F.collect_set(F.when(F.col("name") == text, F.col("chars"))).alias("x"), F.collect_set(F.when(F.col("name") == other, F.col("chars"))).alias("y"))
    both = both.where(F.exists("x", lambda v: F.exists("y", lambda w: v != w)))
    return pairs.union(both.select(F.col("id").alias("query_id"), F.col("id").alias("other_id"))).distinct()
