"""From drafts to units: paragraphs, rows of tables, sections, settings and claims; evidence under a budget; checks of what was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .layout import table_rows

#: Words of a paragraph that is not cut, and characters of the context that goes along with a match.
MOST_WORDS, MOST_CONTEXT = 250, 4000


def _words(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def paragraphs(text: Column, most: int = MOST_WORDS) -> Column:
    """The paragraphs of a text in order: parted at blank lines and where a numbered or starred note begins. One of more than ``most``
    words is cut at the ends of sentences and packed up to as many; a single sentence stays whole. Null for a null text."""
    marked = F.regexp_replace(F.regexp_replace(text, r"\n\s*\n", "\u001f"), r"(?imd)^(\s*(?:\(NOTE\s+\d+\)|\*\s*\d+\s+[A-Za-z]))", "\u001f$1")
    parts = F.filter(F.transform(F.split(marked, "\u001f"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def packed(part: Column) -> Column:
        sentences = F.split(F.regexp_replace(part, r"([.!?])\s+", "$1\u001f"), "\u001f")
        start = F.named_struct(F.lit("out"), F.array().cast("array<string>"), F.lit("own"), F.lit(""))

        def add(state: Column, s: Column) -> Column:
            longer = F.concat_ws(" ", F.nullif(state["own"], F.lit("")), s)
            full = (state["own"] != "") & (_words(longer) > most)
            return F.named_struct(F.lit("out"), F.when(full, F.array_append(state["out"], state["own"])).otherwise(state["out"]), F.lit("own"), F.when(full, s).otherwise(longer))

        return F.aggregate(sentences, start, add, lambda s: F.array_append(s["out"], s["own"]))

    return F.flatten(F.transform(parts, lambda p: F.when(_words(p) > most, packed(p)).otherwise(F.array(p))))


def table_units(drafts: DataFrame) -> DataFrame:
    """(unit_id, parent_id, row, text): a unit for each table, of its title and headers, and one for each of its rows, which names it."""
    tables = drafts.where(F.size("table_rows") > 0)
    heads = F.concat_ws("\n", "title", F.concat(F.lit("Column headers: "), F.array_join("table_headers", "; ")))
    parents = tables.select(F.col("draft_id").alias("unit_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("row"), heads.alias("text"))
    rows = table_rows(drafts).select(F.concat_ws("#", "draft_id", "row").alias("unit_id"), F.col("draft_id").alias("parent_id"), "row", "text")
    return parents.unionByName(rows).distinct()


def searchable(drafts: DataFrame) -> DataFrame:
    """(draft_id, searchable): no table whose cells or headers are unresolved, and no whole table of several rows, as its rows are
    units of their own. A draft with a parent is part of another table."""
    table = F.col("kind") == "table"
    blank = F.exists("table_rows", lambda r: F.exists(r, lambda c: c.isNull())) | F.exists("table_headers", lambda h: h.isNull() | (h == ""))
    whole = F.col("parent_key").isNull() & (F.size("table_rows") > 1)
    return drafts.select("draft_id", (~(table & (F.coalesce(blank, F.lit(False)) | whole))).alias("searchable")).distinct()


def inherited_sections(drafts: DataFrame) -> DataFrame:
    """(draft_id, section_key, inherited): a draft without a section takes that of its page, if the page has exactly one."""
    d = drafts.select("draft_id", "manual_id", "page", F.coalesce("section_key", F.lit("")).alias("own")).distinct()
    only = d.where("own <> ''").groupBy("manual_id", "page").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a = b").select("manual_id", "page", "a")
    return d.join(only, ["manual_id", "page"], "left").select("draft_id", F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("a", F.lit(""))).alias("section_key"), ((F.col("own") == "") & F.col("a").isNotNull()).alias("inherited"))


def declared_settings(drafts: DataFrame) -> DataFrame:
    """(manual_id, setting_id, low, high) of the rows of tables that give a function's range."""
    row = table_rows(drafts)
    number, low, high = F.regexp_extract("text", r"(?:^|; )No\.: *(\d+)", 1), F.regexp_extract("text", r"Setting range: *(\d+)-(\d+)", 1), F.regexp_extract("text", r"Setting range: *(\d+)-(\d+)", 2)
    return row.select("manual_id", F.concat(F.lit("function:"), number).alias("setting_id"), low.try_cast("int").alias("low"), high.try_cast("int").alias("high")).where("setting_id <> 'function:' and low is not null").distinct()


def setting_claims(texts: DataFrame) -> DataFrame:
    """(item_id, manual_id, page, setting_id, value): what texts tell to set a function to. ``texts``: (item_id, manual_id, page, text)."""
    pattern = F.lit(r"(?i)\bset\s+Function\s+No\.?\s*(\d+)\s+to\s+(\d+)")
    found = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("n"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("v"))
    c = texts.where(F.contains(F.lower("text"), F.lit("function"))).select("item_id", "manual_id", "page", F.explode(found).alias("f"))
    return c.select("item_id", "manual_id", "page", F.concat(F.lit("function:"), F.col("f.n")).alias("setting_id"), F.col("f.v").try_cast("int").alias("value")).distinct()


def claim_support(claims: DataFrame, declared: DataFrame) -> DataFrame:
    """(item_id, setting_id, value, support): `supported` if a range that the manual declares for the setting holds the value,
    `out_of_range` if only others do, `undeclared` without any."""
    inside = F.max((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
    found = claims.join(declared, ["manual_id", "setting_id"], "left").groupBy("item_id", "setting_id", "value").agg(inside.alias("inside"))
    return found.select("item_id", "setting_id", "value", F.when(F.col("inside"), "supported").when(F.col("inside").isNull(), "undeclared").otherwise("out_of_range").alias("support"))


def section_context(drafts: DataFrame, most: int = MOST_CONTEXT) -> DataFrame:
    """(draft_id, sibling, position): the drafts that go along with a match, those of its page whose section is its own but for the last
    part, in order, as long as they fit into ``most`` characters; one that doesn't fit is skipped, not the end. Tables neither
    take nor give context. The drafts of one page and section are few; each takes its context from their list."""
    d = drafts.where("section_key <> '' and kind <> 'table'").select("draft_id", "manual_id", "page", "section_key", F.coalesce(F.length("text"), F.lit(0)).alias("size")).distinct()
    d = d.withColumn("scope", F.when(F.contains("section_key", F.lit("-")), F.regexp_replace("section_key", "-[^-]*$", "")).otherwise(F.col("section_key")))
    group = d.groupBy("manual_id", "page", "scope").agg(F.array_sort(F.collect_list(F.struct("draft_id", "size"))).alias("all"))
    start = F.named_struct(F.lit("size"), F.lit(0), F.lit("ids"), F.array().cast("array<string>"))

    def add(state: Column, x: Column) -> Column:
        fits = state["size"] + x["size"] <= most
        return F.when(fits, F.named_struct(F.lit("size"), state["size"] + x["size"], F.lit("ids"), F.array_append(state["ids"], x["draft_id"]))).otherwise(state)

    taken = F.aggregate(F.filter("all", lambda x: x["draft_id"] != F.col("draft_id")), start, add, lambda s: s["ids"])
    return d.join(group, ["manual_id", "page", "scope"]).select("draft_id", F.posexplode(taken).alias("position", "sibling"))


# Terms of a question that its translation must have, as (term, translation).
EVENT_TERMS = ((r"সুতা\s*কাট", r"thread\s*(?:trimm|cut)|cut\w*\s+(?:the\s+)?thread"), (r"হাঁটু", "knee"), (r"নিউট্রাল", "neutral"), (r"থামানো", r"stop\w*|stationary"))
# Concepts and units that question and translation must both have, and negation.
CONCEPTS = (r"thread\s*(?:trimm\w*|cut\w*)|cut\w*\s+(?:the\s+)?thread|সুতা\s*কাট", r"\bknee\b|হাঁটু", r"\bneutral\b|নিউট্রাল", r"\bstop\w*|\bstationary\b|থাম|থেমে", r"\btreadle\b|\bpedal\b|প্যাডেল",
            r"\b(?:uncertain|maybe|perhaps|possibly)\b|নিশ্চিত\s*ন[ইয়]|সম্ভবত|হয়তো", r"\b(?:sometimes|intermittent\w*|occasionally)\b|মাঝে\s*মাঝে|কখন[োও]\s*কখন[োও]", r"\bcounterclockwise\b|বামাবর্তে|ঘড়ির\s*কাঁটার\s*বিপরীত", r"\bclockwise\b|দক্ষিণাবর্তে|ঘড়ির\s*কাঁটার\s*দিকে")
UNITS = (r"mm\b|মিমি|মিলিমিটার", r"seconds?\b|secs?\b|সেকেন্ড", r"rpm\b|আরপিএম", r"volts?\b|V\b|ভোল্ট")
NEGATION = r"\b(?:cannot|can't|couldn't|no\s+longer|not|never|fails?\s+to|doesn't|don't|won't|isn't|no\s+(?:issue|problem|noise))\b|[ঀ-৿]+\s+না(?:\s|[।!?.,]|$)|নেই|নয়"
BINDING = r"(?:Function(?:\s+(?:No\.?|number))?|ফাংশন(?:\s+(?:নম্বর|নং))?)\s*(\d+)\s*(?:=|is(?:\s+set\s+to)?|set\s+to|at|হলো|হল|এর\s+মান)\s*(\d+(?:\.\d+)?)"


def missing_terms(question: Column, translation: Column) -> Column:
    """Terms of events that a question has and its translation hasn't."""
    return F.filter(F.array(*[F.when(question.rlike(a) & ~translation.rlike(f"(?i){b}"), F.lit(a)) for a, b in EVENT_TERMS]), lambda t: t.isNotNull())


def drift(a: Column, b: Column) -> list[Column]:
    """bindings_kept, concepts_same, units_same, negation_same of a question and its translation, with digits as ASCII. Outside of
    Bengali and Latin script only what the question has must be in the translation."""
    bilingual = ~a.rlike(r"[\p{L}&&[^\p{IsLatin}\x{0980}-\x{09ff}]]")
    has = lambda t, p: t.rlike(f"(?i){p}")
    same = lambda p: F.when(bilingual, has(a, p) == has(b, p)).otherwise(~has(a, p) | has(b, p))
    numbers = lambda t, u: F.array_sort(F.regexp_extract_all(t, F.lit(rf"(?i)(\d+(?:\.\d+)?)\s*(?:{u})"), F.lit(1)))
    bound = lambda t: F.transform(F.arrays_zip(F.regexp_extract_all(t, F.lit(f"(?i){BINDING}"), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(f"(?i){BINDING}"), F.lit(2)).alias("v")), lambda x: F.concat(x["n"], F.lit("="), x["v"]))
    every = lambda parts: F.forall(F.array(*parts), lambda x: x)
    units = [same(u) & (~(bilingual | has(a, u)) | (numbers(a, u) == numbers(b, u))) for u in UNITS]
    return [(F.size(F.array_except(bound(a), bound(b))) == 0).alias("bindings_kept"), every([same(c) for c in CONCEPTS]).alias("concepts_same"), every(units).alias("units_same"), F.when(bilingual, has(a, NEGATION) == has(b, NEGATION)).otherwise(F.lit(True)).alias("negation_same")]


def kept_evidence(question: Column, text: Column) -> Column:
    """Whether a text may be evidence for a question: not of electrical noise or unrelated settings where a sound is asked about, and
    not for another pitch than the one asked about."""
    off = X.audible_noise(question) & (X.electrical_noise_only(text) | X.unrelated_setting(question, text))
    return ~F.coalesce(off, F.lit(False)) & F.coalesce(X.pitch_condition(question, text), F.lit(True))


def judged_text(text: Column) -> Column:
    """A text that kept_evidence() may turn down; an empty one in place of any other, which it keeps for every question."""
    low = F.lower(text)
    told = F.contains(low, F.lit("electrical")) | F.contains(low, F.lit("pitch")) | F.contains(low, F.lit("function")) & text.rlike(f"(?i){X.SETTING_TEXT}")
    return F.when(told, text).otherwise("")


def scoped_patterns(text: Column) -> Column:
    """The sub-class patterns of a text, none for a null one. Only texts that have the signs of one are searched."""
    upper = F.upper(text)
    has = reduce(lambda a, b: a | b, [F.contains(upper, F.lit(x)) for x in ("[", "□", "▯", "?", "(-", "SUB")])
    signs = has & upper.rlike(r"\[\s*\]|[□▯]|(?:-|/\s*)[0-9][0-9A-Z?]*\?|\(-|SUB[- ]?CLASS\s+-")
    return F.when(signs, X.model_patterns(text)).otherwise(F.array().cast("array<string>"))


def scope_lines(text: Column) -> Column:
    """Lines whose parentheses limit them to specifications or models."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?i)\([^()\n]*(?:specifications?|models?)[^()\n]*\)"))


def recovered_cells(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, text, from_row): cells of tables, where a cell without text takes that of the nearest cell above in its column
    whose box reaches down past the top of its row; one that no box covers stays null.

    ``cells`` has (table_id, row, col, text, y0, y1), null boxes for cells that were not drawn. An interval join within each column
    of a table; a column has few cells.
    """
    tops = cells.groupBy("table_id", "row").agg(F.min("y0").alias("top"))
    missing = cells.where("text is null").select("table_id", "row", "col").join(tops, ["table_id", "row"])
    above = cells.where("text is not null").select("table_id", "col", F.col("row").alias("from_row"), F.col("text").alias("cover"), F.col("y0").alias("a"), F.col("y1").alias("b"))
    hit = missing.join(above, ["table_id", "col"]).where((F.col("from_row") < F.col("row")) & (F.col("a") <= F.col("top") + 0.5) & (F.col("b") > F.col("top") + 0.5))
    hit = hit.groupBy("table_id", "row", "col").agg(F.max(F.struct("from_row", "cover")).alias("h"))
    return cells.select("table_id", "row", "col", "text").join(hit, ["table_id", "row", "col"], "left").select("table_id", "row", "col", F.coalesce("text", "h.cover").alias("text"), F.when(F.col("text").isNull(), F.col("h.from_row")).alias("from_row"))


def corroborated(visual: DataFrame, native: DataFrame) -> DataFrame:
    """(visual_id, native_id): rows of machine-read tables that a row of the text layer bears out: two headers agree at least, and every
    cell that was read is part of the native row's cell under its header, white space and case aside.

    Both have (…_id, page_key, headers, cells); rows meet by page and header, so only tables that share a header are compared.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    flat = lambda df, i: df.select(F.col(i), "page_key", F.explode(F.arrays_zip(F.transform("headers", plain).alias("h"), F.transform("cells", plain).alias("c"))).alias("x")).select(i, "page_key", F.col("x.h").alias("h"), F.col("x.c").alias(i + "_cell")).where("h <> ''")
    v, n = flat(visual, "visual_id"), flat(native, "native_id")
    needed = v.where("coalesce(visual_id_cell, '') <> ''").groupBy("visual_id").agg(F.count("*").alias("needed"))
    both = v.join(n, ["page_key", "h"]).groupBy("visual_id", "native_id").agg(F.count("*").alias("headers"), F.count_if((F.coalesce("visual_id_cell", F.lit("")) != "") & F.contains("native_id_cell", F.col("visual_id_cell"))).alias("found"))
    return both.join(needed, "visual_id").where("headers >= 2 and found = needed").select("visual_id", "native_id")


def snapshot_changes(old: DataFrame, new: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """(key…, change) of rows that two snapshots don't share: `added`, `removed` or `changed` in any of ``columns``. One row a key each."""
    row = lambda df, name: df.select(*key, F.struct(*columns).alias(name), F.lit(True).alias(f"in_{name}"))
    both = row(old, "old").join(row(new, "new"), key, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")
