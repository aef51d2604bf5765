"""Row-wise text repair, titles, caps and checks as native expressions. Lines are split at line feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import BLANK, SOLID, WHITE, let, strip, words

# ---------------------------------------------------------------- characters

# Replacements of single characters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
HYPHENS = "‐‑‒"
ODD_SPACES = "       "
DROPPED = "­​‌‍⁠﻿"
LINE_BREAKS = " \x0b"
PARAGRAPH_BREAKS = " \x0c"


def plain_characters(c: Column) -> Column:
    """Line ends, ligatures, hyphens, odd spaces and zero-width characters."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.translate(c, HYPHENS + ODD_SPACES + LINE_BREAKS + DROPPED, "-" * len(HYPHENS) + " " * len(ODD_SPACES) + "\n" * len(LINE_BREAKS))
    for found, put in [*LIGATURES.items(), *((x, "\n\n") for x in PARAGRAPH_BREAKS)]:
        c = F.replace(c, F.lit(found), F.lit(put))
    return c


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def clean_characters(c: Column) -> Column:
    """plain_characters(), then each line: inner blanks squeezed, tabs of the indent to four blanks, no blanks at its end. Lines inside code fences only lose those at their end."""
    state = F.struct(F.lit(False).alias("fence"), F.array().cast("array<string>").alias("out"))

    def step(s, line):
        mark = line.rlike(rf"^[{WHITE}]*(?:```|~~~)")
        right = F.regexp_replace(line, f"[{WHITE}]+$", "")
        body = F.regexp_replace(strip(line), "[ \t]+", " ")
        indent = F.replace(F.regexp_extract(line, "^[ \t]*", 0), F.lit("\t"), F.lit("    "))
        plain = F.when(body == "", "").otherwise(F.concat(indent, body))
        return F.struct((s["fence"] != mark).alias("fence"), F.concat(s["out"], F.array(F.when(mark | s["fence"], right).otherwise(plain))).alias("out"))

    text = plain_characters(F.coalesce(c, F.lit("")))
    fenced = F.array_join(F.aggregate(lines_of(text), state, step, lambda s: s["out"]), "\n")
    unfenced = F.array_join(F.transform(lines_of(text), lambda x: F.when(strip(x) == "", "").otherwise(F.concat(F.replace(F.regexp_extract(x, "^[ \t]*", 0), F.lit("\t"), F.lit("    ")), F.regexp_replace(strip(x), "[ \t]+", " ")))), "\n")
    return F.when(text.rlike(rf"(?m)^[{WHITE}]*(?:```|~~~)"), fenced).otherwise(unfenced)


# ---------------------------------------------------------------- shapes

BULLETS = "●○•▪◦■□‣∙⁃◆◇▸►➢✓✔"
_STRUCTURE = rf"^[{WHITE}]*(?:#{{1,6}}[{WHITE}]|[-*+][{WHITE}]|[0-9]{{1,3}}[.)][{WHITE}]|>|\||```|~~~)"
TERMINAL = "[.!?][\"')\\]”’]*$"


def _median(a: Column) -> Column:
    return let(F.sort_array(a), lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2)


def _full_lines(c: Column) -> Column:
    return F.filter(lines_of(c), lambda x: x.rlike(SOLID))


def looks_word_per_line(c: Column) -> Column:
    """Twenty or more lines, nearly all of one or two words, half of them at most one."""

    def told(full: Column) -> Column:
        few = let(F.transform(full, lambda x: F.size(words(x))), lambda n: (F.size(F.filter(n, lambda k: k <= 2)) / F.size(n) >= 0.85) & let(_median(n), lambda m: m <= 1))
        return F.when(F.size(full) >= 20, few).otherwise(False)

    return F.when(c.isNotNull(), let(_full_lines(c), told))


def looks_hard_wrapped(c: Column) -> Column:
    """Prose broken at a width: eight lines or more of middling length, mostly unfinished, few of them blank."""

    def told(full: Column) -> Column:
        return let(F.filter(full, lambda x: ~x.rlike(_STRUCTURE) & ~x.rlike(f"^{BLANK}*[{BULLETS}]")), lambda prose: shaped(full, prose))

    # each test is made only where those before it hold, the cheap ones first
    def shaped(full: Column, prose: Column) -> Column:
        blank = 1 - F.size(full) / F.greatest(F.lit(1), F.size(lines_of(c)))
        middling = let(_median(F.transform(prose, lambda x: F.length(x))), lambda m: m.between(25, 110))
        unfinished = F.size(F.filter(prose, lambda x: ~x.rlike(TERMINAL))) / F.size(prose)
        per_line = F.aggregate(prose, F.lit(0).cast("long"), lambda s, x: s + F.size(words(x))) / F.size(prose)
        return (F.size(prose) >= 8) & (blank < 0.25) & middling & (unfinished >= 0.55) & (per_line >= 5)

    return F.coalesce(F.when(c.isNotNull(), let(_full_lines(c), told)), F.lit(False))


def dehyphenate(c: Column) -> Column:
    """Joins a word that a line break cut after a hyphen."""
    return F.regexp_replace(c, "([A-Za-z])-\n([a-z])", "$1$2")


# ---------------------------------------------------------------- titles and caps


def shorten(line: Column, limit: int) -> Column:
    head = F.substring(line, 1, limit)
    at_word = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(at_word, "[ ,;:\\-–]+$", ""), F.lit("…")))


def title_from_text(c: Column, fallback: str = "Untitled") -> Column:
    """The first line that isn't blank: a heading in up to 200 characters, else 90."""
    line = strip(F.regexp_extract(F.coalesce(c, F.lit("")), f"{SOLID}[^\n]*", 0))

    def cut(line: Column) -> Column:
        heading = F.regexp_extract(line, rf"^#{{1,6}}[{WHITE}]+(.*)", 1)
        is_heading = line.rlike(rf"^#{{1,6}}[{WHITE}]+")
        return F.when(line == "", fallback).when(is_heading, shorten(strip(heading), 200)).otherwise(shorten(line, 90))

    return let(line, cut)


def truncate_words(c: Column, n: int) -> Column:
    return let(c, lambda c: let(words(c), lambda w: F.when(F.size(w) <= n, strip(c)).otherwise(F.array_join(F.slice(w, 1, n), " "))))


def cap_chars(c: Column, n: int) -> Column:
    """At most n characters, cut at a blank if one lies in the second half."""

    def cut(head: Column) -> Column:
        last = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last blank
        return F.when((F.instr(head, " ") > 0) & (last > n // 2), F.substring(head, F.lit(1), last)).otherwise(head)

    return let(strip(c), lambda t: F.when(F.length(t) <= n, t).otherwise(F.regexp_replace(let(F.substring(t, 1, n), cut), "[ ,;:\\-–]+$", "")))


# Words that a cut title must not end with.
DANGLING = (
    "a an the of to by in on at for and or with from as than that into via per is are be before after"
).split()


def truncate_title(c: Column, n: int = 8) -> Column:
    """The first n words without a dangling connective or number at the end (two words stay)."""
    loose = lambda x: F.lower(F.regexp_replace(x, "^[,;:\\-–]+|[,;:\\-–]+$", "")).isin(*DANGLING) | F.regexp_replace(x, "^[,;:.]+|[,;:.]+$", "").rlike("^[0-9]+$")
    kept = lambda w: F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n - 2))), F.slice(w, 1, n), lambda k, _: F.when((F.size(k) > 2) & let(F.element_at(k, -1), loose), F.slice(k, 1, F.size(k) - 1)).otherwise(k))
    cut = lambda w: F.regexp_replace(F.array_join(kept(w), " "), "[ ,;:\\-–]+$", "")
    return let(c, lambda c: let(words(c), lambda w: F.when(F.size(w) <= n, strip(c)).otherwise(cut(w))))


# Limits of the fields of a summary.
TITLE_WORDS, TITLE_CHARS, HOOK_WORDS, HOOK_CHARS = 8, 120, 20, 300
POINTS, POINT_WORDS, POINT_CHARS, STEPS, STEP_WORDS, SHORT_WORDS, SHORT_CHARS = 4, 18, 300, 8, 20, 3, 24


def clean_title(c: Column) -> Column:
    return let(strip(c), lambda t: F.when(t != "", cap_chars(truncate_title(t, TITLE_WORDS), TITLE_CHARS)))


def clean_hook(c: Column) -> Column:
    return let(strip(c), lambda t: F.when(t != "", cap_chars(truncate_words(t, HOOK_WORDS), HOOK_CHARS)))


def clean_short_title(c: Column) -> Column:
    """Dropped, not cut, beyond three words or 24 characters."""
    return let(strip(c), lambda t: F.when((t != "") & (F.length(t) <= SHORT_CHARS) & (F.size(words(t)) <= SHORT_WORDS), t))


def clean_points(a: Column, most: int = POINTS, n: int = POINT_WORDS) -> Column:
    full = F.filter(a, lambda x: x.isNotNull() & (strip(x) != ""))
    return F.coalesce(F.transform(F.slice(full, 1, most), lambda x: cap_chars(truncate_words(x, n), POINT_CHARS)), F.array().cast("array<string>"))


def clean_steps(a: Column) -> Column:
    return clean_points(a, STEPS, STEP_WORDS)


def clean_child_titles(m: Column, ids: Column) -> Column:
    """Map of the titles whose key is one of ids, each cut like a title."""
    kept = F.map_filter(m, lambda k, v: F.array_contains(ids, k) & v.isNotNull() & (strip(v) != ""))
    return F.transform_values(kept, lambda k, v: cap_chars(truncate_title(strip(v), TITLE_WORDS), TITLE_CHARS))


def first_clause(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    m = F.regexp_extract(c, r"^[^.!?。！？\n]{1,80}", 0)
    return strip(F.when(m != "", m).otherwise(c))


# Words that a map label does not begin or end with.
LEAD_FILLER = "how why what when the a an".split()
TRAIL_STOP = "and or of to for in on with by at the a an as is are vs from".split()


def key_title(short: Column, title: Column) -> Column:
    """The short title, else four words of the title (five for a pair joined by "and") without filler at either end."""
    t = strip(F.regexp_replace(F.coalesce(title, F.lit("")), f"[{WHITE}]+", " "))
    bare = lambda x, keep: F.regexp_replace(F.lower(x), f"[^a-z{keep}]", "")
    w = F.filter(F.split(t, " "), lambda x: x != "")
    lead = F.aggregate(w, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & bare(x, "").isin(*LEAD_FILLER), 1).otherwise(0)).alias("n"), (s["on"] & bare(x, "").isin(*LEAD_FILLER)).alias("on")), lambda s: s["n"])
    w = F.slice(w, F.least(lead, F.greatest(F.size(w) - 1, F.lit(0))) + 1, F.greatest(F.size(w), F.lit(1)))
    joins = lambda k: F.lower(F.coalesce(F.get(w, F.lit(k)), F.lit(""))).isin("and", "&", "or")
    take = F.when(F.size(w) <= 4, F.size(w)).when(joins(3), 5).when(joins(4) & (F.size(w) > 5), 3).otherwise(4)
    w = F.slice(w, 1, F.greatest(take, F.lit(1)))
    w = F.aggregate(w, w, lambda k, _: F.when((F.size(k) > 1) & bare(F.element_at(k, -1), "&").isin(*TRAIL_STOP), F.slice(k, 1, F.size(k) - 1)).otherwise(k))
    out = F.regexp_replace(F.array_join(w, " "), f"[{WHITE},;:\\-–—.?!]+$", "")
    out = F.when(out == "", t).otherwise(out)
    return F.when(F.coalesce(short, F.lit("")) != "", short).otherwise(F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 2**31 - 1)))


# ---------------------------------------------------------------- other fields


def strip_tags(c: Column) -> Column:
    """Markup to text: scripts and styles go, line-ending tags break lines, entities are resolved, blanks squeezed."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>|</p>|</div>", "\n"), "<[^>]+>", " ")
    # The entities in use.
    for name, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(put))
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t ]+", " "), f"[{WHITE}]*\n[{WHITE}]*", "\n"))


def clean_url(c: Column) -> Column:
    t = strip(c)
    return F.when((t == "") | t.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))


def json_object(c: Column) -> Column:
    """The JSON object in a reply: without a code fence, else from the first brace to the last; null if neither parses."""
    t = strip(c)
    fenced = F.regexp_extract(t, r"(?s)^```(?:json)?[ \t]*\n(.*)\n```$", 1)
    t = F.when(fenced != "", strip(fenced)).otherwise(t)
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    whole = F.when(t.rlike(r"(?s)^\{.*\}$"), F.try_parse_json(t))
    return F.coalesce(whole, F.when(inner != "", F.try_parse_json(inner)))


def safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]{1,64}\z"), F.lit(False))


def tree_id(text: Column, objective: str = "", model: str = "") -> Column:
    """Content address of a build: 16 hex digits over goal, model and text."""
    lead = (f"objective:{objective}\n" if objective else "") + f"{model}\n"
    return F.substring(F.sha2(F.concat(F.lit(lead), F.coalesce(text, F.lit(""))), 256), 1, 16)


#: Parameters that a stored tree depends on.
BUILD_VERSION = "r3-leaf120-gist25-stop34-schema7"


def lower_safe(c: Column) -> Column:
    """Lower case, character by character where lowering the whole would change its length."""
    low = F.lower(c)
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.length(F.lower(x)) == F.length(x), F.lower(x)).otherwise(x)), "")
    return F.when(F.length(low) == F.length(c), low).otherwise(each)


def clean_label(c: Column) -> Column:
    return F.substring(strip(F.regexp_replace(c, r"[\x00-\x1f\x7f]+", " ")), 1, 80)


def date_phrase(c: Column) -> Column:
    """struct<phrase, iso> of the first date: day and month, else month and day; iso without the year where none is written."""
    # Month names in order.
    months = "January February March April May June July August September October November December".split()
    alt = "|".join(months)
    a, b = rf"\b([0-9]{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({alt})(?:\s+([0-9]{{4}}))?", rf"\b({alt})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?(?:,?\s+([0-9]{{4}}))?"
    number = F.create_map(*[F.lit(x) for k, m in enumerate(months) for x in (m, f"{k + 1:02d}")])

    def made(rx, day, month):
        year = F.regexp_extract(c, rx, 3)
        md = F.concat(F.element_at(number, F.regexp_extract(c, rx, month)), F.lit("-"), F.lpad(F.regexp_extract(c, rx, day), 2, "0"))
        return F.when(c.rlike(rx), F.struct(F.regexp_extract(c, rx, 0).alias("phrase"), F.when(year != "", F.concat(year, F.lit("-"), md)).otherwise(md).alias("iso")))

    return F.coalesce(made(a, 1, 2), made(b, 2, 1))


# What makes a paragraph of an email a legal or environmental footer.
DISCLAIMERS = (
    r"not the intended recipient", r"intended (?:only )?for (?:the )?(?:named |intended )?(?:recipient|addressee|use of)",
    r"received this (?:e-?mail|message|communication|transmission) in error", r"\bprivileged\b", r"confidentiality (?:notice|statement)",
    r"\b(?:e-?mail|message)\b[^.]{0,80}\bconfidential\b", r"unauthori[sz]ed (?:use|disclosure|copying|review|distribution)",
    r"please consider the environment", r"\bdisclaimer\b", r"\bvirus(?:es)?\b.{0,40}\b(?:scan|free|checked)",
)
DISCLAIMER_LEAD = (
    r"^\s*(this (?:e-?mail|message|communication)|confidential|disclaimer|notice|please consider the environment|think before you print|"
    r"the information (?:in|contained in) this)"
)


def drop_disclaimers(c: Column) -> Column:
    def stays(p):
        hits = sum((p.rlike("(?i)" + d).cast("int") for d in DISCLAIMERS), F.lit(0))
        return (hits == 0) | ((hits == 1) & ~p.rlike("(?i)" + DISCLAIMER_LEAD))

    return F.array_join(F.filter(F.split(c, r"\n\s*\n", -1), stays), "\n\n")
