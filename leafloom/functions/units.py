"""Counting units of text: words between white space, and one for each Han or Kana character. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words (Unicode white space and the four ASCII separators).
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Characters written without spaces, each of which counts as a word.
CJK = (
    r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}"  # Hiragana, Katakana and its extensions
    r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"  # Han
    r"\x{ff66}-\x{ff9f}"  # half-width Katakana
    r"\x{20000}-\x{2fa1f}"  # Han extensions B to F
)
# Full-width punctuation; a run of it alone is no word.
CJK_PUNCTUATION = r"\x{3000}-\x{3004}\x{3008}-\x{303f}\x{ff01}-\x{ff0f}\x{ff1a}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}"

def let(value: Column, body) -> Column:
    """body(value) with the value computed once. An expression used several times would else be inlined, and computed, each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


WORD = f"[^{WHITE}]+"
# The same characters for Spark only: printable ASCII is told by one range, where a list of ranges is gone through for each character.
BLANK, SOLID, WIDE = f"[[^!-~]&&[{WHITE}]]", f"[!-~[^{WHITE}]]", rf"[[^\x00-\x7f]&&[{CJK}]]"
UNIT = f"[{CJK}]|[^{WHITE}{CJK}]+"
WORDS_PER_MINUTE = 238


def strip(c: Column) -> Column:
    """Without white space at both ends (Unicode's, not just blanks)."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def words(c: Column) -> Column:
    """Array of the runs between white space."""
    return F.regexp_extract_all(c, F.lit(f"{SOLID}+"), F.lit(0))


def units(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UNIT), F.lit(0))


def word_count(c: Column) -> Column:
    """Words of a text; the cheap count is enough where no CJK character occurs."""
    c = F.coalesce(c, F.lit(""))
    cjk = F.size(F.filter(units(c), lambda u: ~u.rlike(f"^[{CJK_PUNCTUATION}]+$")))
    return F.when(c.rlike(WIDE), cjk).otherwise(F.regexp_count(c, F.lit(f"{SOLID}+")))


def head_words(c: Column, n: int) -> Column:
    """The first n words joined by single blanks; texts with CJK characters keep their spacing up to the nth unit."""
    c = F.coalesce(c, F.lit(""))
    lead = rf"^(?:[{WHITE}]*(?:[{CJK_PUNCTUATION}]+(?![^{WHITE}{CJK}{CJK_PUNCTUATION}]))*[{WHITE}]*(?:{UNIT})){{0,{n}}}"
    return F.when(c.rlike(WIDE), strip(F.regexp_extract(c, lead, 0))).otherwise(F.array_join(F.slice(words(c), 1, n), " "))


def reading_minutes(n: Column) -> Column:
    """Whole minutes to read n words, halves up, at least one."""
    return F.greatest(F.lit(1), F.floor(n / WORDS_PER_MINUTE + 0.5)).cast("long")


def share_percent(n: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.greatest(F.lit(1), F.floor(100 * n / whole + 0.5)).cast("long"))
