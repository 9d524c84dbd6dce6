"""Oversized items cut into pieces under a limit, at natural boundaries where there are any, with an overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1100, 180

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "No", "Nos", "Nr", "no", "nos", "nr", "n", "N", "Fig", "fig", "Figs", "p", "pp", "P", "Pag", "pág", "pag", "S", "Abb", "abb", "ca", "bzw", "z.B", "z. B",
    "d.h", "u.a", "usw", "e.g", "i.e", "etc", "approx", "vs", "cf", "Dr", "Mr", "Mrs", "Ms", "St", "Ref", "ref", "Sec", "sec", "Ch", "ch", "Vol", "vol",
    "Ed", "ed", "Inc", "Ltd", "Co", "max", "min", "Max", "Min", "Art", "art", "av", "aprox", "p.ej", "p. ej", "Ud", "Uds", "Sr", "Sra", "env", "núm", "Núm", "tab", "Tab",
)

_SHORT = "|".join(a.replace(".", r"\.").replace(" ", r"\s") for a in ABBREVIATIONS)
#: The place after a sentence's end: its mark, closing quotes, then white space that the piece keeps.
SENTENCE = rf"(?:(?<=[!?।॥…。！？])|(?<=[^\s.]\.|\.\.\.)(?<!(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_SHORT})\.))[\"'”’»)\]]{{0,3}}(?:\s{{1,20}}|$)"
LINE = r"(?:[ \t]{0,20}\r?\n\s{0,20})"
PARAGRAPH = r"(?:[ \t]{0,20}\r?\n[ \t]{0,20}\r?\n\s{0,20})"


def squeezed(text: Column) -> Column:
    """``text`` with runs of spaces and tabs as one space and without outer white space."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"^\s+|\s+$", "")


def pattern(limit: int, overlap: int) -> str:
    """Alternatives by strength of the boundary, each up to what the overlap leaves; then any boundary up to the limit; then a
    space or, at last, characters."""
    room, half = limit - overlap, max(1, (limit - overlap) // 2)
    strong = "|".join(rf"[\s\S]{{{half},{room}}}{b}" for b in (PARAGRAPH, LINE, SENTENCE))
    any_end = f"(?:{PARAGRAPH}|{LINE}|{SENTENCE})"
    # what a boundary itself consumes is white space, which doesn't count at a piece's end
    return rf"{strong}|[\s\S]{{1,{room}}}{any_end}|[\s\S]{{{room},{limit}}}?{any_end}|[\s\S]{{1,{limit}}}\z|[\s\S]{{{half},{room}}}[ \t](?=\S)|[\s\S]{{1,{room}}}"


def segments(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The text's consecutive segments; joined they give it back."""
    return F.regexp_extract_all(text, F.lit(pattern(limit, overlap)), F.lit(0))


def is_natural(segment: Column) -> Column:
    """The segment ends where a paragraph, line or sentence does."""
    return segment.rlike(rf"(?:{PARAGRAPH}|{LINE}|{SENTENCE})\z")


def oversized(items: DataFrame, item_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, text, segments) of the items whose squeezed text is longer than ``limit`` characters; distinct rows."""
    short = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.length("text") > limit)
    short = short.withColumn("text", squeezed(F.col("text"))).where(F.length("text") > limit)
    return short.withColumn("segments", segments(F.col("text"), limit, overlap))


def cut_kinds(items: DataFrame, item_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, cut): `forced` if a segment ends within a stretch that holds no natural boundary for ``limit`` characters,
    else `natural`. Null, empty and short texts give no rows; an item of several texts may have several rows."""
    big = oversized(items, item_id, text, limit, overlap)
    inner = F.slice("segments", F.lit(1), F.size("segments") - 1)
    return big.select("item_id", F.when(F.forall(inner, is_natural), "natural").otherwise("forced").alias("cut")).distinct()


def pieces(items: DataFrame, item_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, ordinal, text): every item as pieces of at most ``limit`` characters, numbered from 0.

    A piece is its segment after the end of the one before, at most ``overlap`` characters and as many as the limit leaves,
    from the start of a word where there is one. An item within the limit is one piece of its squeezed text; null and blank
    texts give no piece; repeated rows count once; an item of several texts has the pieces of each.
    """
    base = items.select(F.col(item_id).alias("item_id"), squeezed(F.col(text)).alias("text")).where("text <> ''")
    base = base.withColumn("seg", F.when(F.length("text") > limit, segments(F.col("text"), limit, overlap)).otherwise(F.array("text")))
    seg = F.col("seg")
    # each segment goes along with the end of the one before, not with all of them
    pairs = F.transform(seg, lambda own, i: F.named_struct(F.lit("own"), own, F.lit("last"), F.when(i > 0, F.right(F.get(seg, i - 1), F.lit(overlap + 1))).otherwise(F.lit(""))))
    base = base.select("item_id", F.posexplode(pairs).alias("ordinal", "p")).select("item_id", "ordinal", "p.own", F.col("p.last").alias("before"))
    own = F.rtrim(F.regexp_replace("own", r"\s+\z", ""))
    room = F.least(F.lit(overlap), limit - F.length(own))
    tail = F.when(room > 0, F.right("before", room)).otherwise("")
    # from the start of a word, unless the tail is one word
    whole = F.when(F.length(tail) < F.length("before"), F.regexp_replace(tail, r"\A\S{1,40}\s+(?=\S)", "")).otherwise(tail)
    return base.select("item_id", "ordinal", F.regexp_replace(F.concat(whole, own), r"\A\s+", "").alias("text")).distinct()
