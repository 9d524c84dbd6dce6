"""Typed edges between units: notes, required settings, warnings, page references, applicability. All are equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialise

#: A branch of a setting, `2: …`, in a table's row after its header's name.
BRANCH = r"^(?:[^:;]*: )?\s*(\d+)\s*:\s*(.*)"
#: Units of a page that are joined at once.
PAGE_BLOCK = 128
# Fixed value: how a note says that a predicate doesn't hold if a switch is set so.
DENIAL = r"(?i)([^.!?\n]+?)\s+(?:will|does|can)\s+not\s+(.+?)\s+if\s+DIP\s+switch\s+(\d+)\s+is\s+set\s+to\s+(ON|OFF)\b"


def _with(units: DataFrame, *words: str) -> DataFrame:
    """Units whose text has one of the words, whatever its case: a plain search that spares the others the patterns."""
    return units.where(reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(w)) for w in words]))


def note_definitions(units: DataFrame) -> DataFrame:
    """(manual_id, section_key, number, unit_id, page, extraction_method, text) of units that define a note."""
    return _with(units, "note", "*").select("manual_id", "section_key", X.own_note(F.col("text")).alias("number"), "unit_id", "page", "extraction_method", "text").where("number is not null")


def note_references(units: DataFrame) -> DataFrame:
    """(unit_id, manual_id, section_key, page, number, when_value) of notes that units refer to, their own left out. ``when_value`` is
    the value of the branch, `2: see NOTE 7`, in whose line a note is referred to, the last one that is."""
    own = F.coalesce(X.own_note(F.col("text")), F.lit(""))
    lines = F.transform(F.split("text", "\n"), lambda x: F.named_struct(F.lit("notes"), X.note_numbers(x), F.lit("value"), F.regexp_extract(x, r"^\s*(\d+)\s*:", 1)))
    # most texts have no branch, so that their lines aren't searched
    lines = F.when(F.col("text").rlike(r"(?:^|\n)\s*\d+\s*:"), lines)
    u = _with(units, "note", "*").select("unit_id", "manual_id", "section_key", "page", lines.alias("lines"), F.explode(F.array_except(X.note_numbers(F.col("text")), F.array(own))).alias("number"))
    branch = F.filter("lines", lambda x: F.array_contains(x["notes"], F.col("number")) & (x["value"] != ""))
    return u.withColumn("b", branch).select(
        "unit_id", "manual_id", "section_key", "page", "number", F.when(F.size("b") > 0, F.element_at(F.transform("b", lambda x: x["value"]), -1)).alias("when_value"))


def unique_target(owners: DataFrame, targets: DataFrame, owner: list[str], key: list[str]) -> DataFrame:
    """Of each owner's candidates, the targets of its key, the one that is meant: (owner…, target), where there is just one.

    ``owners`` has the owner's columns, the key and page; ``targets`` the key, target, t_page, t_method, t_text. Native wording comes
    before machine readings; equal texts of one page are one candidate; of several the only one on the owner's page is taken.
    Targets are counted by key, and by key and page, before they are joined, so no pair is built.
    """
    wording = F.struct("t_page", F.btrim(F.regexp_replace("t_text", r"\s+", " ")).alias("words"))
    pool = targets.select(*key, F.col("t_page").alias("page"), (F.col("t_method") != "vlm").alias("native"), wording.alias("w"), "target").where("native is not null")
    # the least and the greatest wording, this one with its target: there is one wording where both are the same
    paged = pool.groupBy(*key, "page").agg(*[x for flag, of in ((True, "a"), (False, "b")) for x in (
        F.min(F.when(F.col("native") == flag, F.col("w"))).alias(f"low_{of}"), F.max(F.when(F.col("native") == flag, F.struct("w", "target"))).alias(f"high_{of}"))])
    paged = materialise(paged, "wordings")
    whole = paged.groupBy(*key).agg(*[x for of in "ab" for x in (F.min(f"low_{of}").alias(f"low_{of}"), F.max(f"high_{of}").alias(f"high_{of}"))])
    # a wording goes along only where it is the only one
    met = lambda at: [x for of in "ab" for x in (F.when(F.col(f"low_{of}") == F.col(f"high_{of}.w"), F.col(f"high_{of}")).alias(f"{at}_{of}"), F.col(f"high_{of}").isNotNull().alias(f"any_{at}_{of}"))]
    both = owners.select(*dict.fromkeys([*owner, "page", *key])).join(whole.select(*key, *met("key")), key)
    both = both.join(paged.select(*key, "page", *met("page")), [*key, "page"], "left")

    # an owner of several keys has one wording where all of them have the same one
    def single(at: str) -> Column:
        one, of = F.col(at), F.coalesce(F.col(f"any_{at}"), F.lit(False))
        only = (F.count_if(of & one.isNull()) == 0) & (F.min(one["w"]) == F.max(one["w"]))
        return F.when(only, F.max(one)["target"])

    target = F.when(F.max("any_key_a"), F.coalesce(single("key_a"), single("page_a"))).otherwise(F.coalesce(single("key_b"), single("page_b")))
    return both.groupBy(*owner, "page").agg(target.alias("target")).select(*owner, "target").where("target is not null")


def note_edges(units: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(src, dst, number, when_value): a unit and the note it refers to, a numbered one of its section or a starred one of its page.
    ``references``: note_references() of the units, where they are there already; else they are found once, into a table."""
    references = materialise(note_references(units), "references") if references is None else references
    d = note_definitions(units).select("manual_id", F.coalesce("section_key", F.lit("")).alias("section_key"), "number", F.col("unit_id").alias("target"), F.col("page").alias("t_page"), F.col("extraction_method").alias("t_method"), F.col("text").alias("t_text"))
    # one key serves both: the section of a numbered note, the page of a starred one
    place = lambda page: F.when(F.col("number").startswith("star:"), F.concat(F.lit("page "), F.col(page).cast("string"))).otherwise(F.concat(F.lit("section "), F.col("section_key")))
    refs = references.where("section_key is not null or number like 'star:%'").withColumn("section_key", F.coalesce("section_key", F.lit("")))
    found = unique_target(refs.withColumn("place", place("page")), d.withColumn("place", place("t_page")), ["unit_id", "number"], ["manual_id", "place", "number"]).where("target <> unit_id")
    when = refs.groupBy("unit_id", "number").agg(F.max("when_value").alias("when_value"))
    return found.join(when, ["unit_id", "number"]).select(F.col("unit_id").alias("src"), F.col("target").alias("dst"), "number", "when_value")


def unresolved_notes(units: DataFrame) -> DataFrame:
    """(unit_id, number) of references that no single note answers; they block the unit."""
    references = materialise(note_references(units), "references")
    resolved = note_edges(units, references).select(F.col("src").alias("unit_id"), "number")
    return references.select("unit_id", "number").distinct().join(resolved, ["unit_id", "number"], "left_anti")


def settings(units: DataFrame) -> DataFrame:
    """(manual_id, section_key, setting_id, state, …) of table rows that define a function's setting or a switch's state."""
    number = F.when(F.col("text").rlike(r"(?i)setting\s+(?:range|details)[^:;]*:"), F.regexp_extract("text", r"(?i)(?:^|; )(?:Function\s*)?No\.?\s*:\s*(\d+)\b", 1)).otherwise("")
    switch, state = F.regexp_extract("text", r"(?:^|; )DIP switch: ?(\d+)\s*(?:;|$)", 1), F.regexp_extract("text", r"(?:^|; )State: ?(ON|OFF)(?:;|$)", 1)
    setting = F.when((switch != "") & (state != ""), F.concat(F.lit("dip:"), switch)).when(number != "", F.concat(F.lit("function:"), number))
    return units.where("kind = 'table'").select("manual_id", "section_key", setting.alias("setting_id"), F.when(state != "", state).alias("state"), F.col("unit_id").alias("target"), F.col("page").alias("t_page"), F.col("extraction_method").alias("t_method"), F.col("text").alias("t_text")).where("setting_id is not null")


def required_settings(units: DataFrame) -> DataFrame:
    """(unit_id, manual_id, section_key, page, setting_id, value) of settings that units require; found once, into a table."""
    need = _with(units, "function", "dip").select("unit_id", "manual_id", "section_key", "page", F.explode(X.requirements(F.col("text"))).alias("r"))
    return materialise(need.select("unit_id", "manual_id", "section_key", "page", "r.setting_id", "r.value"), "required")


def requirement_edges(units: DataFrame, need: DataFrame | None = None) -> DataFrame:
    """(src, dst, setting_id, required_value, tier): a unit and the setting it requires, that of its section, or else of its manual; a
    switch's row must have the required state."""
    need = required_settings(units) if need is None else need
    s = settings(units)
    section = ["manual_id", "section_key", "setting_id"]
    near = need.join(s.select(*section).distinct(), section, "left_semi")
    far = need.join(near.select("unit_id", "setting_id").distinct(), ["unit_id", "setting_id"], "left_anti")
    # a function's row fits whatever value is required, a switch's the one of its state
    owners = near.withColumn("tier", F.lit("section")).unionByName(far.withColumn("tier", F.lit("manual")))
    switch = F.col("setting_id").startswith("dip:")
    owners = owners.select("unit_id", "setting_id", "value", "tier", "page", "manual_id", F.when(F.col("tier") == "section", F.col("section_key")).otherwise("").alias("place"), F.when(switch, F.col("value")).otherwise("").alias("state"))
    rows = s.withColumn("state", F.when(switch, F.col("state")).otherwise(""))
    at = lambda tier, place: F.struct(F.lit(tier).alias("tier"), place.alias("place"))
    rows = rows.withColumn("at", F.explode(F.array(at("section", F.col("section_key")), at("manual", F.lit(""))))).select("*", "at.tier", "at.place")
    return unique_target(owners, rows, ["unit_id", "setting_id", "value", "tier"], ["manual_id", "tier", "place", "setting_id", "state"]).where("target <> unit_id").select(F.col("unit_id").alias("src"), F.col("target").alias("dst"), "setting_id", F.col("value").alias("required_value"), "tier")


def _bare_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.substring(w, 1, F.length(w) - 1)).otherwise(w))


def setting_exclusions(units: DataFrame) -> DataFrame:
    """(unit_id, when_value, setting_id, value): branches of a function's setting that a switch rules out, as the note that the
    setting refers to says of the same short predicate that it does not hold if the switch is set so."""
    part = lambda k: F.regexp_extract("t_text", DENIAL, k)
    own = settings(units).where("setting_id like 'function:%'").select(F.col("target").alias("src"), "t_text").withColumnRenamed("t_text", "text")
    notes = units.select(F.col("unit_id").alias("dst"), F.col("text").alias("t_text")).where(F.col("t_text").rlike(r"(?i)if\s+DIP\s+switch"))
    pairs = note_edges(units).join(own, "src").join(notes, "dst").withColumn("switch", part(3)).where("switch <> ''")
    predicate = _bare_words(F.concat(F.regexp_replace(part(1), r"^.*?\)\s*", ""), F.lit(" "), part(2)))
    branch = F.transform(F.split("text", "\n|; "), lambda x: F.named_struct(F.lit("value"), F.regexp_extract(x, BRANCH, 1), F.lit("words"), _bare_words(F.regexp_replace(F.regexp_extract(x, BRANCH, 2), r"\(.*", ""))))
    pairs = pairs.select("src", "switch", part(4).alias("state"), predicate.alias("predicate"), F.explode(branch).alias("b")).where("b.value <> '' and b.words = predicate")
    return pairs.select(F.col("src").alias("unit_id"), F.col("b.value").alias("when_value"), F.concat(F.lit("dip:"), "switch").alias("setting_id"), F.upper("state").alias("value")).distinct()


def _worked() -> Column:
    return (F.col("kind").isin("procedure", "table")) | F.col("text").rlike(r"(?i)\b(adjust|remove|install|disconnect|tighten|loosen|lubricate)\b")


def _warns() -> Column:
    return F.col("text").rlike("WARNING|CAUTION|DANGER")


def _plain_note() -> Column:
    return F.contains(F.lower("text"), F.lit("note")) & F.col("text").rlike(r"(?i)\bNOTE\s*:") & X.own_note(F.col("text")).isNull()


def _works(units: DataFrame) -> DataFrame:
    return units.where(_worked()).select("manual_id", "page", F.col("unit_id").alias("src"))


def _warnings(units: DataFrame) -> DataFrame:
    return units.where(_warns()).select("manual_id", "page", F.col("unit_id").alias("dst"))


def warnings_of(units: DataFrame, first_pages: int = 4) -> DataFrame:
    """(src, warnings, first): a unit that is worked by, the number of warnings of its page and of its manual's first pages, itself
    aside, and the least of these.

    Warnings are counted by manual and page before the join, so no pair is built. Of each group the two least ids go along, as a
    unit's own one doesn't count.
    """
    owner, warning = _works(units).distinct(), _warnings(units).distinct()

    def counted(w: DataFrame, key: list[str], name: str) -> DataFrame:
        least = w.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("dst"))).where("n <= 2").groupBy(*key).agg(F.array_sort(F.collect_list("dst")).alias(f"{name}_two"))
        return w.groupBy(*key).agg(F.count("*").alias(f"{name}_n")).join(least, key)

    general = counted(warning.where(F.col("page") <= first_pages).drop("page").distinct(), ["manual_id"], "g")
    same = counted(warning.where(F.col("page") > first_pages), ["manual_id", "page"], "p")
    own = warning.select(F.col("dst").alias("src")).distinct().withColumn("own", F.lit(1))
    found = owner.join(general, "manual_id", "left").join(same, ["manual_id", "page"], "left").join(own, "src", "left")
    others = F.filter(F.concat(F.coalesce("g_two", F.array_remove(F.array("src"), F.col("src"))), F.coalesce("p_two", F.array_remove(F.array("src"), F.col("src")))), lambda x: x != F.col("src"))
    count = F.coalesce("g_n", F.lit(0)) + F.coalesce("p_n", F.lit(0)) - F.when((F.col("own") == 1) & (F.col("page") <= first_pages) | (F.col("own") == 1) & F.col("p_n").isNotNull(), 1).otherwise(0)
    return found.select("src", count.alias("warnings"), F.array_min(others).alias("first")).where("warnings > 0")


def page_reference_edges(units: DataFrame) -> DataFrame:
    """(src, dst, label): a unit and every unit of the page of its manual that it refers to.

    The result is as many rows as pages' units times their references. So that a written one takes little disk, a page's units are
    joined in blocks of ``PAGE_BLOCK`` that are taken apart last: of neighbouring rows one id stays and the other comes back after a
    block, which run lengths and compression leave little of. The tasks are more than the input asks for, which adaptive execution
    goes by: the ids of one then fit a file's dictionary.
    """
    key, tasks = ["manual_id", "label"], 8 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ref = _with(units, "page").select(F.col("unit_id").alias("src"), "manual_id", F.explode(X.page_references(F.col("text"))).alias("label")).repartition(tasks, *key)
    paged = units.select("manual_id", F.col("page").cast("string").alias("label"), F.col("unit_id").alias("dst")).dropna().repartition(tasks, *key)
    number = F.row_number().over(Window.partitionBy(*key).orderBy("dst")) - 1
    blocks = paged.withColumn("block", F.floor(number / PAGE_BLOCK)).groupBy(*key, "block").agg(F.collect_list("dst").alias("block_dst"))
    # merged, not hashed: a block meets all references before the next one
    pairs = blocks.join(ref.hint("merge"), key).select("src", "label", F.explode("block_dst").alias("dst"))
    return pairs.where("src <> dst").select("src", "dst", "label")


def unresolved_pages(units: DataFrame) -> DataFrame:
    """(src, label) of references to a page that its manual has not."""
    ref = _with(units, "page").select(F.col("unit_id").alias("src"), "manual_id", F.explode(X.page_references(F.col("text"))).alias("label"))
    return ref.join(units.select("manual_id", F.col("page").cast("string").alias("label")).distinct(), ["manual_id", "label"], "left_anti").select("src", "label")


def _excludes(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("class")) & text.rlike(r"(?i)not\s+(necessary|required|applicable|available)|does\s+not\s+apply") & text.rlike(r"(?i)sub[- ]?class")


def exceptions_of(units: DataFrame) -> DataFrame:
    """(src, exceptions, last): every unit that is no exception, the number of its section's exceptions and the greatest of these.
    Exceptions are counted by section before the join."""
    flagged = units.withColumn("exception", _excludes(F.col("text")))
    rule = flagged.where("exception").groupBy("manual_id", "section_key").agg(F.count("*").alias("exceptions"), F.max("unit_id").alias("last"))
    return flagged.where("not exception").select("manual_id", "section_key", F.col("unit_id").alias("src")).join(rule, ["manual_id", "section_key"]).select("src", "exceptions", "last")


def hub_edges(units: DataFrame, first_pages: int = 4) -> DataFrame:
    """(src, dst): what goes along with many units of a place, by way of the place: a unit that is worked by leads to the hubs of its
    manual and page, and these to their warnings; a unit leads to the hub of its section, and that to its exceptions; a procedure
    leads to its section's hub of plain notes (`NOTE: …` without a number). Units and evidence are added up, not multiplied.
    Hubs begin with `hub:`."""
    hub = lambda kind, *key: F.concat_ws("\u001f", F.lit(f"hub:{kind}"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]).alias("hub")
    general, paged = hub("manual", "manual_id"), hub("page", "manual_id", "page")
    scope, noted = hub("section", "manual_id", "section_key"), hub("notes", "manual_id", "section_key")
    # texts are searched once, into a table of what they are
    told = materialise(units.select(
        "unit_id", "manual_id", "page", "section_key", "kind", _worked().alias("works"), _warns().alias("warns"),
        F.coalesce(_excludes(F.col("text")), F.lit(False)).alias("exception"), _plain_note().alias("plain")), "told")
    out = [told.where("works").select(F.col("unit_id").alias("src"), F.explode(F.array(general, paged)).alias("dst")), told.where("not exception").select(F.col("unit_id").alias("src"), scope.alias("dst")), told.where("kind = 'procedure'").select(F.col("unit_id").alias("src"), noted.alias("dst"))]
    to = lambda which, place: told.where(which).select(place.alias("src"), F.col("unit_id").alias("dst"))
    into = [to(F.col("warns") & (F.col("page") <= first_pages), general), to(F.col("warns") & (F.col("page") > first_pages), paged), to("exception", scope), to("plain", noted)]
    reached = reduce(DataFrame.unionByName, into).distinct()
    # a hub that leads nowhere isn't gone to
    return reduce(DataFrame.unionByName, out).join(reached.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct().unionByName(reached)


def plain_notes_of(units: DataFrame) -> DataFrame:
    """(src, notes): procedures with the number of plain notes, `NOTE: …` without a number, that hold for their section."""
    plain = units.where(_plain_note())
    n = plain.groupBy("manual_id", "section_key").agg(F.count("*").alias("notes"))
    own = plain.select(F.col("unit_id").alias("src"), F.lit(1).alias("own")).distinct()
    found = units.where("kind = 'procedure'").select("manual_id", "section_key", F.col("unit_id").alias("src")).join(n, ["manual_id", "section_key"]).join(own, "src", "left")
    return found.select("src", (F.col("notes") - F.coalesce("own", F.lit(0))).alias("notes")).where("notes > 0")


def applicability(units: DataFrame, subclass: str) -> DataFrame:
    """(unit_id, patterns, status): `excluded` where a pattern of an exception fits the sub-class, `within` or `outside` where a
    plain pattern does or doesn't, else `not_established`."""
    patterns = X.model_patterns(F.col("text"))
    fits = F.exists("patterns", lambda p: X.matches_model(p, F.lit(subclass)))
    u = units.select("unit_id", patterns.alias("patterns"), _excludes(F.col("text")).alias("exception"))
    status = F.when(F.col("exception") & fits, "excluded").when((F.size("patterns") > 0) & ~F.col("exception"), F.when(fits, "within").otherwise("outside")).otherwise("not_established")
    return u.select("unit_id", "patterns", status.alias("status"))
