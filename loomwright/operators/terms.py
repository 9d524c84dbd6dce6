"""Intents of questions, their merged results, and key terms under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words by which a part of a question tells of an event. Fixed values.
EVENTS = r"(?i)\b(foot|treadle|pedal|needle|thread|motor|oil|nozzle|temperature|voltage|error|alarm|noise)\b|ফুট|প্যাডেল|সুতা|হাঁটু|মোটর|ত্রুটি|আওয়াজ|সাউন্ড|শব্দ"
LEAST_CHARS, MOST_INTENTS = 15, 4
MOST_TERMS, MOST_BYTES, LONGEST_TERM = 32, 480, 80


# What parts a question besides the ends of its sentences, as patterns before which, or in place of which, a part ends,
# and how a part begins that belongs to the one before.
CONNECTED = r"\s+and\s+((?:after|once|the motor|the treadle|(?:the )?(?:sewing )?machine)\b|(?:mak\w*|produc\w*)\b[^.!?;]{0,50}\b(?:noise|sounds?)\b)"
CONNECTED_BENGALI = r"\s+(?:এবং|আর)\s+(মেশিন|[^।.!?]{0,35}(?:আওয়াজ|আওয়াজ|সাউন্ড|শব্দ))"
ADDED = r"\b(Additionally|Furthermore|Secondly)\b|(এছাড়া|এছাড়াও|অন্যদিকে)"
CONTINUED = r"^(?:Previously\b|Before\b|আগে(?:\s|$)|প্যাডেল\s+তখন)"


def intents(question: Column) -> Column:
    """The parts of a question that tell of events of their own, each once; the question itself where there are fewer than two. A part
    that goes on from the one before (`Before …`) is joined to it. Null where there are more than MOST_INTENTS, as such a question
    must be narrowed, and for a null question."""
    cut = F.regexp_replace(question, r"([.!?;।])\s+|\n\s*\n", "$1\u001f")
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, f"(?i){CONNECTED}", "\u001f$1"), CONNECTED_BENGALI, "\u001f$1"), f"(?i){ADDED}", "\u001f$1$2")
    parts = F.filter(F.transform(F.split(cut, "\u001f"), lambda p: F.btrim(p)), lambda p: (F.length(p) >= LEAST_CHARS) & p.rlike(EVENTS))

    def joined(done: Column, part: Column) -> Column:
        last = F.element_at(done, F.size(done))
        on = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), part)))
        return F.when((F.size(done) > 0) & part.rlike(f"(?i){CONTINUED}"), on).otherwise(F.array_append(done, part))

    found = F.aggregate(parts, F.array().cast("array<string>"), joined)
    distinct = F.array_distinct(found)
    return F.when(F.size(found) > MOST_INTENTS, None).when(F.size(found) <= 1, F.array(question)).when(found.isNotNull(), distinct)


def merged_intents(found: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, intents, first_intent, best_rank, primary) from (query_id, intent, doc_id, rank): each document once, with
    the intents that found it; it is primary if one of them ranks it within ``limit``. Aggregates only."""
    return found.groupBy("query_id", "doc_id").agg(F.array_join(F.sort_array(F.collect_set("intent")), ",").alias("intents"), F.min("intent").alias("first_intent"), F.min("rank").alias("best_rank"), F.max(F.col("rank") <= limit).alias("primary"))


def key_terms(terms: DataFrame) -> DataFrame:
    """(owner, position, term): of each owner's terms in order those that fit into MOST_TERMS and MOST_BYTES; one that doesn't fit
    is skipped, not the end. ``terms`` has (owner, term); case aside each counts once; long ones and lists are left out.

    Owners are sorted within partitions and read as a stream, so an owner with a third of all terms needs no memory.
    """
    clean = terms.where("term is not null and owner is not null").select("owner", F.btrim("term").alias("term")).where((F.length("term").between(1, LONGEST_TERM)) & ~F.col("term").rlike("[,;:]"))
    once = clean.groupBy("owner", F.lower("term").alias("folded")).agg(F.min("term").alias("term"))
    kind = terms.schema["owner"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, n, size = None, 0, 0
        for pdf in frames:
            rows = []
            for o, t in zip(pdf["owner"], pdf["term"]):
                if o != owner:
                    owner, n, size = o, 0, 0
                need = len(t.encode()) + 1
                if n < MOST_TERMS and size + need <= MOST_BYTES:
                    rows.append((o, n, t))
                    n, size = n + 1, size + need
            yield pd.DataFrame(rows, columns=["owner", "position", "term"])

    return once.select("owner", "folded", "term").repartition("owner").sortWithinPartitions("owner", "folded").select("owner", "term").mapInPandas(run, f"owner {kind}, position int, term string")
