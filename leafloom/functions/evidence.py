"""Checks of short claims against the passages they cite: shared words, numbers, dates, times, dropped qualifiers. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import let, strip

# Words without content, and the endings that stemming takes off (the first that fits).
STOP_WORDS = (
    "a about above after again all also an and any are as at be because been before being below between both but by can could did do does "
    "doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most "
    "my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they "
    "this those through to too under until up very was we were what when where which while who whom why will with would you your yours "
    "also may must shall need needs per via etc eg ie one two three"
).split()
SUFFIXES = ("ations", "ation", "ments", "ment", "ings", "ing", "ies", "ied", "ed", "es", "ly", "s")
OVERLAP_FLOOR = 0.35
TOKEN = "[A-Za-z0-9][A-Za-z0-9'’-]*"
NUMBER = r"(?i)\d[\d,.]*s?|\bbillion\b|\bmillion\b"


def _stem(low: Column) -> Column:
    """The stem of a word in lower case. Of at most five letters and at least four, so that an ending counts only where it begins after the fourth."""

    def cut(w: Column) -> Column:
        return F.when(w.rlike("[0-9]"), F.replace(w, F.lit(","), F.lit(""))).otherwise(F.substring(w, 1, F.when(F.substring(w, 5, 2**31 - 1).isin(*SUFFIXES), 4).otherwise(5)))

    bare = F.regexp_replace(F.regexp_replace(low, "^['’-]+|['’-]+$", ""), "['’]s$", "")
    return let(F.when(low.rlike("['’-]"), bare).otherwise(low), cut)


def stem(word: Column) -> Column:
    return _stem(F.lower(word))


def content_tokens(c: Column) -> Column:
    """Stems of the content words, in order, each once. A word that comes again is not lowered or stemmed again."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)))
    low = F.array_distinct(F.transform(found, lambda x: F.lower(x)))
    kept = F.filter(low, lambda x: ~x.isin(*STOP_WORDS) & ((F.length(x) >= 3) | x.rlike("[0-9]")))
    return F.array_distinct(F.transform(kept, _stem))


def overlap(item: Column, source: Column) -> Column:
    """struct<shared, total> of the item's content words."""
    return let(content_tokens(item), lambda a: F.struct(F.size(F.array_intersect(a, content_tokens(source))).alias("shared"), F.size(a).alias("total")))


def overlap_ok(item: Column, source: Column, floor: float = OVERLAP_FLOOR) -> Column:
    return let(overlap(item, source), lambda o: F.when(o["total"] == 0, True).otherwise(o["shared"] / o["total"] >= floor))


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0))


def prose_numbers(c: Column) -> Column:
    """number_tokens() without punctuation at their end."""
    return F.filter(F.transform(number_tokens(c), lambda t: F.regexp_replace(t, "[.,]+$", "")), lambda t: t != "")


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\d),(?=\d{3}(?!\d))", "")


# Small numbers in words.
_NUMBER_WORDS = dict(enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())) | {30: "thirty", 40: "forty", 50: "fifty", 60: "sixty", 70: "seventy", 80: "eighty", 90: "ninety"}


def number_in(token: Column, source: Column) -> Column:
    """Does the number stand in the source as a whole number, thousands commas aside, or as a word?"""
    t, low = F.regexp_replace(F.lower(token), "[.,]+$", ""), F.lower(F.coalesce(source, F.lit("")))
    whole = F.regexp_like(_plain(low), F.concat(F.lit(r"(?<![\w.,])\Q"), _plain(t), F.lit(r"\E(?!\d|[.,]\d)")))
    word = F.element_at(F.create_map(*[F.lit(str(x)) for kv in _NUMBER_WORDS.items() for x in kv]), F.regexp_replace(t, "^0+(?=\\d)", ""))
    as_word = F.coalesce(t.rlike("^[0-9]+$") & word.isNotNull() & F.regexp_like(low, F.concat(F.lit(r"\b"), word, F.lit(r"\b"))), F.lit(False))
    named = F.regexp_like(low, F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b")))
    return F.when(t == "", True).when(~t.rlike("^[0-9]"), named).otherwise(whole | as_word)


# Names of days and months, with their abbreviations.
_DAYS = "Mon(?:day)?|Tue(?:s(?:day)?)?|Wed(?:nesday)?|Thu(?:r(?:s(?:day)?)?)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?"
_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
_DAY3, _MONTH3 = "mon tue wed thu fri sat sun".split(), "jan feb mar apr may jun jul aug sep oct nov dec".split()
_NUMERIC = r"(?<![\d.])(\d{1,2})[/.\-](\d{1,2})(?:[/.\-](\d{2,4}))?(?![\d])"
_ISO = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)"


def _named(c: Column, pattern: str, names: list[str]) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.array_position(F.array(*map(F.lit, names)), F.lower(F.substring(x, 1, 3))).cast("int") - 1))


def weekdays_in(c: Column, strict: bool = True) -> Column:
    """0 (Monday) to 6; strict: written as names, with a capital."""
    return _named(c, rf"{'' if strict else '(?i)'}\b(?:{_DAYS})\b", _DAY3)


def months_in_item(c: Column) -> Column:
    may = F.when(F.coalesce(c, F.lit("")).rlike(r"\bMay\s+\d{1,2}\b|\b\d{1,2}(?:st|nd|rd|th)?\s+(?:of\s+)?May\b"), F.array(F.lit(4))).otherwise(F.array().cast("array<int>"))
    return F.array_union(_named(c, rf"\b(?:{_MONTHS})\b", _MONTH3), may)


def months_in_source(c: Column) -> Column:
    """Months by name, or as either part of a numeric date."""
    c = F.coalesce(c, F.lit(""))
    part = lambda rx, k: F.transform(F.regexp_extract_all(c, F.lit(rx), F.lit(k)), lambda x: x.cast("int") - 1)
    numbers = F.filter(F.concat(part(_NUMERIC, 1), part(_NUMERIC, 2), part(_ISO, 2)), lambda x: x.between(0, 11))
    return F.array_union(_named(c, rf"(?i)\b(?:{_MONTHS}|May)\b", _MONTH3), numbers)


def dates_ok(item: Column, source: Column) -> Column:
    held = lambda own, there: let(own, lambda x: (F.size(x) == 0) | (F.size(F.array_except(x, there)) == 0))
    return held(weekdays_in(item), weekdays_in(source, strict=False)) & held(months_in_item(item), months_in_source(source))


def supported(item: Column, source: Column) -> Column:
    return F.forall(prose_numbers(item), lambda t: number_in(t, source)) & dates_ok(item, source)


def day_in(day: Column, source: Column) -> Column:
    d = day.cast("string")
    return F.regexp_like(F.coalesce(source, F.lit("")), F.concat(F.lit(r"(?i)(?<![\d.,])"), d, F.lit(r"(?:st|nd|rd|th)?(?![\d]|[.,]\d)|(?<![\d.,])0"), d, F.lit(r"(?!\d)")))


def date_in(date: Column, source: Column) -> Column:
    return day_in(F.dayofmonth(date), source) & F.array_contains(months_in_source(source), F.month(date) - 1)


def years_in(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), lambda x: x.cast("int")))


def parse_iso(c: Column, today: Column) -> Column:
    """struct<date, year_inferred>; a date without its year is the next such day from `today` on. Null if there is none."""
    t = strip(c)
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    md = F.regexp_extract(t, r"(?i)^(?:-{1,4}|\?{1,4}|null|)-?(\d{2}-\d{2})$", 1)
    on = [F.try_to_date(F.concat((F.year(today) + k).cast("string"), F.lit("-"), md), "yyyy-MM-dd") for k in (0, 1, 4)]
    nxt = F.when(md != "", F.coalesce(*[F.when(d >= today, d) for d in on]))
    return F.when(full.isNotNull(), F.struct(full.alias("date"), F.lit(False).alias("year_inferred"))).when(nxt.isNotNull(), F.struct(nxt.alias("date"), F.lit(True).alias("year_inferred")))


def resolve_date(iso: Column, source: Column, today: Column) -> Column:
    """struct<iso, year_inferred> of a date that the source supports: day and month stand there, and a year that stands there must match."""
    p, years = parse_iso(iso, today), years_in(source)
    moved = F.try_to_date(F.concat(F.get(years, F.lit(0)).cast("string"), F.date_format(p["date"], "-MM-dd")), "yyyy-MM-dd")
    made = lambda d, inferred: F.struct(F.date_format(d, "yyyy-MM-dd").alias("iso"), inferred.alias("year_inferred"))
    one = p["year_inferred"] & (F.size(years) == 1)
    out = F.when(one, F.when(moved.isNotNull(), made(moved, F.lit(False)))).when(F.size(years) == 0, made(p["date"], F.lit(True))).when(F.array_contains(years, F.year(p["date"])), made(p["date"], p["year_inferred"]))
    return F.when(p.isNotNull() & date_in(p["date"], source), out)


def time_in(hhmm: Column, source: Column) -> Column:
    """Does the clock time HH:MM stand in the source, in 24 or 12 hours, or as midnight or noon?"""
    ok = F.coalesce(hhmm, F.lit("")).rlike(r"^([01]?\d|2[0-3]):([0-5]\d)$")
    h, mm, src = F.regexp_extract(hhmm, r"^(\d+):", 1).cast("int"), F.regexp_extract(hhmm, r":(\d+)$", 1), F.coalesce(source, F.lit(""))
    two, one = F.lpad(h.cast("string"), 2, "0"), h.cast("string")
    like = lambda *parts: F.regexp_like(src, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    plain = like(r"(?<!\d)", two, "[:.h]", mm, r"(?!\d)|(?<!\d)", one, "[:.]", mm, r"(?!\d)") & ((h >= 13) | (h == 0) | like(r"(?<!\d)", two, "[:.]", mm))
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string")
    minutes = F.when(mm == "00", "(?:[:.]00)?").otherwise(F.concat(F.lit("(?:[:.]"), mm, F.lit(")")))
    half = like(r"(?i)(?<![\d:.])", h12, minutes, r"\s*", F.when(h < 12, "a").otherwise("p"), r"\.?m?\.?(?![a-z])")
    named = ((h == 0) & (mm == "00") & src.rlike(r"(?i)\bmidnight\b")) | ((h == 12) & (mm == "00") & src.rlike(r"(?i)\b(noon|midday)\b"))
    return ok & F.coalesce(plain | half | named, F.lit(False))


# Words of negation and exception in a source, and what counts as keeping them.
_QUALIFIER = (
    r"(?i)\b(must not|shall not|may not|should not|cannot|can't|cant|do not|does not|did not|don't|doesn't|not|never|no|unless|except(?:ion|ions)?|"
    r"only if|only when|without|excluding|other than)\b|n't\b"
)
_KEPT = (
    r"(?i)\b(not|no|none|nobody|nothing|neither|nor|never|unless|except(?:ion|ions)?|only|without|excluding|cannot|prohibit(?:ed|s)?|forbid(?:den)?|ban(?:ned)?|"
    r"must\s+not|shall\s+not|may\s+not|disallow(?:ed)?|exempt(?:ed)?)\b|n't\b"
)


def qualifier_dropped(item: Column, cited: Column) -> Column:
    """struct<qualifier, sentence> if the cited sentence that shares most with the item (two words at least) is qualified and the item isn't."""
    sentences = F.filter(F.transform(F.split(F.coalesce(cited, F.lit("")), r"(?<=[.!?])\s+|\n+", -1), strip), lambda s: s != "")
    rated = lambda mine: F.transform(sentences, lambda s, k: F.struct((-F.size(F.array_intersect(mine, content_tokens(s)))).alias("minus"), k.alias("k"), s.alias("s")))
    told = lambda f, s: F.when(f != "", F.struct(f.alias("qualifier"), s.alias("sentence")))
    of_best = lambda best: F.when(best["minus"] <= -2, let(F.lower(F.regexp_extract(best["s"], _QUALIFIER, 0)), lambda f: told(f, best["s"])))
    found = let(content_tokens(item), lambda mine: F.when(F.size(mine) >= 2, let(F.get(F.array_sort(rated(mine)), F.lit(0)), of_best)))
    # a sentence is weighed only where any is qualified
    return F.when(~F.coalesce(item, F.lit("")).rlike(_KEPT) & cited.rlike(_QUALIFIER), found)


def name_tokens(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{L}{2,}"), F.lit(0)), lambda x: F.lower(x))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin("and", "the", "dr", "mr", "ms", "mrs")))
