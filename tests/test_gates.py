from pyspark.sql import functions as F

from leafloom.functions import classify, text, units

CUES = [p for cues in classify.CUES.values() for p in cues] + [p for goal in classify.GOALS.values() for p, _ in goal] + [p for _, p, _ in classify.BOOSTS.values()]
TEXTS = ["\n# Head\nx", "  \n  \n plain line, long enough to be cut somewhere behind ninety characters, as titles of pasted text are, here", "", None, "a\nb\n" * 12, "Lines of middling length, as they are wrapped by hand\n" * 9]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classes_told_by_one_range_are_the_same(spark):
    c = spark.createDataFrame([(chr(k),) for k in [*range(1, 0x3400), *range(0xF900, 0x10000), 0x20000, 0x2FA1F, 0x2FA20]], "c string")
    same = [(F.col("c").rlike(f"^{a}\\z") != F.col("c").rlike(f"^{b}\\z")) for a, b in ((units.BLANK, f"[{units.WHITE}]"), (units.SOLID, f"[^{units.WHITE}]"), (units.WIDE, f"[{units.CJK}]"))]
    assert c.where(same[0] | same[1] | same[2]).count() == 0 and c.where(F.col("c").rlike(units.BLANK)).count() > 20


def test_lines_are_split_and_told_once(spark):
    """Before: each use of an array split and stripped all lines again, 33 times for the two flags."""
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    out = df.select(text.looks_word_per_line(F.col("t")).alias("w"), text.looks_hard_wrapped(F.col("t")).alias("h"))
    assert plan(out).count("split(") <= 4
    assert [tuple(r) for r in out.collect()] == [(False, False), (False, False), (False, False), (None, False), (True, False), (False, True)]
    titled = df.select(text.title_from_text(F.col("t")).alias("x"))
    assert plan(titled).count("split(") == 0
    assert [r.x for r in titled.collect()] == ["Head", "plain line, long enough to be cut somewhere behind ninety characters, as titles of pasted…", "Untitled", "Untitled", "a", "Lines of middling length, as they are wrapped by hand"]


def test_patterns_find_what_their_words_pass(spark):
    """A text is passed over only where its pattern can't match; most patterns have words, and none is tried without them."""
    from leafloom.functions.classify import _needed, _seen

    assert _needed(r"\bbrief\b|\bworth \d+\s*%") == ["brief", "worth "] and _needed(r"^#{1,6}\s*(?:references|bibliography)\b") == ["#"] and _needed(r"\bp\s*[<=]") is None
    assert sum(_needed(p) is not None for p in CUES) > 0.9 * len(CUES)
    told = ["We report p < .05", "ASSIGNMENT brief, worth 20 % of the final mark", "# Methods\n## Results", "Options: a | b --flag", "hi all,\nre: thanks,", "Due: by Friday vs. Monday", "said on Monday (AP)", "minute taker, chaired", "pip install x", "explained"]
    df = spark.createDataFrame([(t,) for t in told], "t string")
    for flags in ("im", "i"):
        t = F.col("t")
        row = df.select(*[F.sum((_seen(t, F.lower(t), p, flags) != t.rlike(f"(?{flags}){p}")).cast("int")).alias(str(k)) for k, p in enumerate(CUES)]).first()
        assert not any(row)
