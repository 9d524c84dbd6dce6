"""Page layout: overlapping boxes, headings that hold for what follows, blocks and notes that go on, merged cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def covered_blocks(boxes: DataFrame, page: list[str], share: float = 0.5, cell: float = 100.0) -> DataFrame:
    """(box_id, covered) of blocks of which more than ``share`` lies in a table of their page.

    A range join by grid cells: both sides are put into the cells they touch, joined by page and cell, and each pair counts in
    the cell of its intersection's corner only, so no page is paired with itself as a whole.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor(F.col(hi) / cell).cast("int"))
    grid = lambda df: df.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    b = grid(boxes.where("kind = 'block'"))
    t = grid(boxes.where("kind = 'table'").select(*page, *[F.col(c).alias("t" + c) for c in ("x0", "y0", "x1", "y1")], F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).drop("x0", "y0", "x1", "y1")
    hit = b.join(t, [*page, "cx", "cy"])
    left, top = F.greatest("x0", "tx0"), F.greatest("y0", "ty0")
    hit = hit.where((F.floor(left / cell) == F.col("cx")) & (F.floor(top / cell) == F.col("cy")))
    w, h = F.least("x1", "tx1") - left, F.least("y1", "ty1") - top
    part = F.when((w > 0) & (h > 0), w * h).otherwise(0.0) / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return hit.groupBy("box_id").agg(F.max(part).alias("covered")).where(F.col("covered") > share)


def carried(rows: DataFrame, within: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the last ``value`` that is not null, up to the row itself, in order within each group (an as-of join with the
    nearest one before)."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


# How far, in points, lines of one block or note may lie apart, and left edges of one column.
GAP_ABOVE, GAP_BELOW, EDGE, NOTE_GAP, NOTE_LEFT, NOTE_RIGHT = -2, 20, 14, 12, 8, 120
ALERT = r"\A\s*(WARNING|CAUTION|DANGER)\s*:?\s*\z"


def _islands(rows: DataFrame, within: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """``name``: the number of the island that each row is in; a row for which ``starts`` is true or null begins a new one."""
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(Window.partitionBy(*within).orderBy(*order)))


def _joined(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row of each key: the box around its rows and their texts in order."""
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    parts = F.array_sort(F.collect_list(F.struct(F.col("y0").alias("y"), F.col("x0").alias("x"), text.alias("t"))))
    return rows.groupBy(*keys).agg(*box, F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """(doc, page, x0, y0, x1, y1, text): blocks of a page whose sentences go on in the next one of their column are one, with the
    box around them.

    Columns are islands of left edges, pieces of a sentence islands within a column: a block goes on with the one above it if it
    starts in small letters close below, and that one has words enough, no end and no heading or note after it. A lone warning
    word belongs to the column of what follows it and takes that, whatever it starts with. Windows only; blank and null texts
    give no row, repeated rows stay.
    """
    page = ["doc", "page"]
    b = blocks.select("doc", "page", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text").where("trim(text) <> ''")
    b = b.withColumn("alert", F.col("text").rlike(ALERT))
    # warning words are few: each takes the left edge of the first block close below it
    word = b.where("alert").select("doc", "page", "x0", F.col("y0").alias("y0"), F.col("y1").alias("foot")).distinct()
    below = word.join(b.select("doc", "page", F.col("x0").alias("bx"), F.col("y0").alias("by")), page).where((F.col("by") - F.col("foot")).between(GAP_ABOVE, GAP_BELOW) & (F.col("by") > F.col("y0")))
    below = below.groupBy(*page, "x0", "y0").agg(F.min(F.struct("by", F.abs(F.col("bx") - F.col("x0")).alias("d"), "bx")).alias("next"))
    b = b.join(below, [*page, "x0", "y0"], "left").withColumn("edge", F.when(F.col("alert"), F.coalesce("next.bx", "x0")).otherwise(F.col("x0"))).drop("next")
    b = _islands(b, page, ["edge"], F.col("edge") - F.lag("edge").over(Window.partitionBy(*page).orderBy("edge")) >= EDGE, "column")
    above = lambda c: F.lag(c).over(Window.partitionBy(*page, "column").orderBy("y0", "x0", "text"))
    words = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    begins_small = F.col("text").rlike(r"\A\s*[a-z(・•]")
    b = b.withColumn("prose", (words >= 5) | begins_small).withColumn("open", ~F.regexp_replace("text", r":?\s*\z", "").rlike(r"[.!?:]\z") & (F.col("alert") | ~F.col("text").rlike(r":\s*\z")))
    goes_on = (F.col("y0") - above("y1")).between(GAP_ABOVE, GAP_BELOW) & above("open") & (above("alert") | above("prose") & begins_small)
    goes_on = goes_on & X.heading_key(F.col("text")).isNull() & ~F.col("text").rlike(r"(?i)\A\s*\(?NOTE\s+\d+")
    b = _islands(b.withColumn("starts", ~goes_on), [*page, "column"], ["y0", "x0", "text"], F.col("starts"), "island")
    return _joined(b, [*page, "column", "island"], F.when(F.col("starts"), F.rtrim("text")).otherwise(F.trim("text"))).drop("column", "island")


def footer_notes(lines: DataFrame) -> DataFrame:
    """(doc, page, x0, y0, x1, y1, text): each numbered note of a page with the lines that it goes on in, indented ones included,
    up to a gap, a heading or a line of numbers.

    A line belongs to the nearest note above it whose column it stands in, an equi-join by page; what follows the first break
    among a note's lines is cut off by a window. A page has few notes. Null texts give no row.
    """
    page = ["doc", "page"]
    line = lines.select("doc", "page", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text").where("text is not null")
    line = line.withColumn("first", F.col("text").rlike(r"(?i)\A\s*\(NOTE\s+\d+\)\s+\S"))
    note = line.where("first").select("doc", "page", F.col("x0").alias("nx"), F.col("y0").alias("ny"), F.col("text").alias("n_text")).distinct()
    inside = (F.col("x0") >= F.col("nx") - NOTE_LEFT) & (F.col("x0") <= F.col("nx") + NOTE_RIGHT) & (F.col("y0") >= F.col("ny"))
    own = F.struct("ny", "nx", "n_text")
    found = line.join(note, page).where(inside & (~F.col("first") | (F.col("y0") == F.col("ny")) & (F.col("x0") == F.col("nx")) & (F.col("text") == F.col("n_text"))))
    found = found.groupBy(*page, "x0", "y0", "x1", "y1", "text", "first").agg(F.max(own).alias("note"))
    w = Window.partitionBy(*page, "note").orderBy(F.desc("first"), "y0", "x0")
    gap = F.col("y0") - F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = ~F.col("first") & ((gap > NOTE_GAP) | F.trim("text").rlike(r"\A[\d. –-]+\z") | X.heading_key(F.col("text")).isNotNull())
    found = found.where(F.col("first") | (F.col("y0") > F.col("note.ny"))).withColumn("ends", ends).withColumn("aside", gap < GAP_ABOVE)
    found = found.where(F.col("first") | ~F.coalesce("aside", F.lit(False))).withColumn("over", F.max("ends").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(found.where("not over"), [*page, "note"], F.trim("text")).drop("note")


def table_rows(drafts: DataFrame, *keep: str) -> DataFrame:
    """(draft_id, manual_id, page, …, row, cells, text): each row of each table with its cells as `header: cell; …`."""
    rows = drafts.where(F.size("table_rows") > 0).select("draft_id", "manual_id", "page", *keep, "table_headers", F.posexplode("table_rows").alias("row", "cells"))
    line = F.array_join(F.zip_with("table_headers", "cells", lambda h, c: F.concat(F.coalesce(h, F.lit("")), F.lit(": "), F.coalesce(c, F.lit("[merged/blank]")))), "; ")
    return rows.select("draft_id", "manual_id", "page", *keep, "row", "cells", line.alias("text"))


def filled_cells(drafts: DataFrame) -> DataFrame:
    """(draft_id, row, col, cell, filled): blank cells take the one above them, as merged cells do. Within each row of ``drafts``."""
    cell = drafts.where(F.size("table_rows") > 0).select("draft_id", F.posexplode("table_rows").alias("row", "cells")).select("draft_id", "row", F.posexplode("cells").alias("col", "cell")).distinct()
    return carried(cell, ["draft_id", "col"], ["row"], "cell", "filled").select("draft_id", "row", "col", "cell", "filled")
