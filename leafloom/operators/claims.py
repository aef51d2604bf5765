"""Claims against the leaves they cite: what a reply says is kept only where the cited passages support it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import evidence as E
from leafloom.functions.classify import essential_rank
from leafloom.functions.text import cap_chars, date_phrase, truncate_words
from leafloom.functions.units import let, strip

# Words and characters of each field, and how many items are kept.
CAPS = {"big": (12, 120), "detail": (40, 300), "label": (5, 120), "value": (30, 600), "who": (8, 100), "what": (25, 300), "due": (10, 100), "deadline": (10, 120), "start_here": (25, 300), "size": (20, 200), "basis": (30, 300)}
ESSENTIALS, ACTIONS = 7, 12


def capped(c: Column, field: str) -> Column:
    words, chars = CAPS[field]
    return let(strip(c), lambda t: F.when(t != "", cap_chars(truncate_words(t, words), chars)))


def cited(claims: DataFrame, leaves: DataFrame, claim: str = "claim_id", leaf: str = "leaf_id") -> DataFrame:
    """claims with cites cut down to real leaves, in order, and their texts joined in source."""
    c = claims.select("tree_id", claim, F.posexplode("cites").alias("_pos", leaf)).join(leaves.select("tree_id", leaf, F.col("text").alias("_t")), ["tree_id", leaf])
    got = c.groupBy("tree_id", claim).agg(F.array_sort(F.collect_list(F.struct("_pos", leaf, "_t"))).alias("_c"))
    texts = F.array_join(F.transform("_c", lambda x: x["_t"]), " ")
    out = claims.drop("cites").join(got, ["tree_id", claim], "left")
    return out.withColumns({"cites": F.coalesce(F.transform("_c", lambda x: x[leaf]), F.array().cast("array<string>")), "source": F.coalesce(texts, F.lit(""))}).drop("_c")


def _where(x: DataFrame, check, *names: str) -> DataFrame:
    """Rows for which check(columns by name) holds, with each column computed once: as a filter of its own it would be inlined at every use."""
    return x.where(let(F.struct(*names), lambda s: check(*[s[n] for n in names])))


def _both(big: Column, detail: Column) -> Column:
    return F.concat_ws(" ", big, detail)


def fact_held(big: Column, detail: Column, source: Column) -> Column:
    """Has the cited text the numbers, weekdays and months of a key fact, and enough of its words?"""
    numbers = F.forall(F.concat(E.number_tokens(big), E.number_tokens(detail)), lambda t: E.number_in(t, source))
    return numbers & let(_both(big, detail), lambda item: E.dates_ok(item, source) & E.overlap_ok(item, source))


def key_facts(facts: DataFrame, leaves: DataFrame) -> DataFrame:
    """facts: tree_id, claim_id, big, detail, cites. Kept with cites whose text has its numbers, weekdays, months and enough of its words."""
    x = cited(facts.withColumns({"big": capped(F.col("big"), "big"), "detail": capped(F.col("detail"), "detail")}).where("big is not null and detail is not null"), leaves)
    kept = _where(x.where(F.size("cites") > 0), fact_held, "big", "detail", "source")
    warned = let(F.struct("big", "detail", "source"), lambda s: E.qualifier_dropped(_both(s["big"], s["detail"]), s["source"]))
    return kept.withColumn("warning", warned)


def essentials(items: DataFrame, leaves: DataFrame, most: int = ESSENTIALS) -> DataFrame:
    """items: tree_id, claim_id, pos, label, value, cites. Supported ones, the first of each label, seven a tree; deadlines and deliverables first."""
    label = capped(F.regexp_replace(strip(F.col("label")), ":+$", ""), "label")
    x = cited(items.withColumns({"label": label, "value": capped(F.col("value"), "value")}).where("label is not null and value is not null"), leaves)
    open_ = lambda value, cites: F.lower(value).startswith("not stated") | (F.size(cites) == 0)
    x = _where(x, lambda value, cites, source: E.supported(value, source) & (open_(value, cites) | E.overlap_ok(value, source)), "value", "cites", "source")
    first = Window.partitionBy("tree_id", F.lower("label")).orderBy("pos")
    x = x.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_k", F.row_number().over(Window.partitionBy("tree_id").orderBy("pos"))).where(F.col("_k") <= most)
    rank = essential_rank(F.col("label"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("tree_id").orderBy(rank, "pos"))).drop("_n", "_k")


def _borne_out(said: Column, source: Column) -> Column:
    return E.supported(said, source) & E.overlap_ok(said, source)


def first_steps(items: DataFrame, leaves: DataFrame) -> DataFrame:
    """items: tree_id, claim_id, text, cites."""
    x = cited(items.withColumn("text", capped(F.col("text"), "start_here")).where("text is not null"), leaves)
    return _where(x.where(F.size("cites") > 0), _borne_out, "text", "source")


def job_sizes(items: DataFrame, leaves: DataFrame) -> DataFrame:
    """items: tree_id, claim_id, text, basis, cites. The basis must be supported; the estimate itself is free."""
    x = cited(items.withColumns({"text": capped(F.col("text"), "size"), "basis": capped(F.col("basis"), "basis")}).where("text is not null and basis is not null"), leaves)
    return _where(x.where(F.size("cites") > 0), _borne_out, "basis", "source")


def deadlines(items: DataFrame, leaves: DataFrame, today: Column) -> DataFrame:
    """items: tree_id, claim_id, iso, time, label, cites. Dates that the source has, with the time if it has that too."""
    x = cited(items.withColumn("label", capped(F.col("label"), "deadline")).where("label is not null"), leaves)
    x = x.withColumn("_d", E.resolve_date(F.col("iso"), F.col("source"), today)).where((F.size("cites") > 0) & F.col("_d").isNotNull() & E.supported(F.col("label"), F.col("source")))
    time = strip(F.col("time"))
    return x.withColumns({"iso": F.col("_d.iso"), "year_inferred": F.col("_d.year_inferred"), "time": F.when(E.time_in(time, F.col("source")), time)}).drop("_d")


def actions(items: DataFrame, leaves: DataFrame, today: Column, most: int = ACTIONS) -> DataFrame:
    """items: tree_id, claim_id, pos, who, what, due, due_iso, cites. A name of the source, a supported task, twelve a tree, earliest due first."""
    x = cited(items.withColumns({c: capped(F.col(c), c) for c in ("who", "what", "due")}).where("who is not null and what is not null"), leaves)
    s = F.col("source")
    x = _where(x.where(F.size("cites") > 0), lambda who, what, source: F.arrays_overlap(E.name_tokens(who), E.name_tokens(source)) & _borne_out(what, source), "who", "what", "source")
    x = x.where(F.col("due").isNull() | E.supported(F.col("due"), s)).withColumn("_d", E.resolve_date(F.col("due_iso"), s, today))
    first = Window.partitionBy("tree_id", F.lower("who"), F.lower("what")).orderBy("pos")
    x = x.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_k", F.row_number().over(Window.partitionBy("tree_id").orderBy("pos"))).where(F.col("_k") <= most)
    x = x.withColumns({"due_iso": F.col("_d.iso"), "year_inferred": F.coalesce(F.col("_d.year_inferred"), F.lit(False))})
    return x.withColumn("place", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.asc_nulls_last("due_iso"), "pos"))).drop("_d", "_n", "_k")


def overview_line(kind: Column, what: Column, source: Column) -> Column:
    """What the document is: as given if the source has its numbers and dates, else from its kind."""
    k = F.concat(F.lower(F.substring(kind, 1, 1)), F.substring(kind, 2, 1000))
    plain = F.concat(F.lit("This is a"), F.when(F.lower(F.substring(kind, 1, 1)).isin(*"aeiou"), "n").otherwise(""), F.lit(" "), k, F.lit("."))
    ok = F.coalesce(strip(what) != "", F.lit(False)) & F.forall(E.prose_numbers(what), lambda t: E.number_in(t, source)) & E.dates_ok(what, source)
    return F.when(ok, cap_chars(truncate_words(strip(what), 45), 400)).otherwise(plain)


ACTION = r"^([A-Z][a-z]+(?: [A-Z][a-z]+)?) to (.+?)(?: (?:by|on) ((?:[A-Z][a-z]+day )?\d{1,2} [A-Z][a-z]+(?: \d{4})?))?\.?$"


def extract_actions(leaves: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, pos, who, what, due, due_iso, cites) of sentences that say who is to do what, and by when (MM-DD where no year is written)."""
    s = F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+", -1)).alias("pos", "s")
    x = leaves.select("tree_id", "leaf_id", s).withColumn("s", F.regexp_replace(strip(F.col("s")), r"^[-*]+\s*", "")).where(F.col("s").rlike(ACTION))
    part = lambda k: F.nullif(F.regexp_extract("s", ACTION, k), F.lit(""))
    x = x.select("tree_id", "leaf_id", "pos", part(1).alias("who"), F.regexp_replace(strip(part(2)), "[.]+$", "").alias("what"), part(3).alias("due"))
    return x.withColumns({"due_iso": date_phrase(F.col("due"))["iso"], "cites": F.array("leaf_id")})
