"""Text units, repair and chunking against hand-made expectations, and native forms against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from leafloom.functions import chunking, repair, text, units


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select(f(F.col("v")).alias("o"), "k").orderBy("k").collect()]


WORDS = [("", 0), ("a - b | c", 5), ("漢字かな", 4), ("。、", 1), ("「漢」字", 2), ("한국어 단어", 2), ("three 漢字 words", 4), ("x y　z", 3), (" a\x1cb\n", 2)]


def test_word_count(spark):
    assert col(spark, [w for w, _ in WORDS], units.word_count) == [n for _, n in WORDS]
    assert [chunking.word_count(w) for w, _ in WORDS] == [n for _, n in WORDS]


def test_head_words(spark):
    assert col(spark, ["a  b c", "漢字です。", None], lambda c: units.head_words(c, 2)) == ["a b", "漢字", ""]


def test_minutes(spark):
    assert col(spark, [1, 238, 357, 358], units.reading_minutes, "int") == [1, 1, 2, 2]


def test_titles(spark):
    got = col(spark, ["\n\n# Head line\nx", "word " * 40, "", "short"], text.title_from_text)
    assert got[0] == "Head line" and got[1] == " ".join(["word"] * 18) + "…" and got[2:] == ["Untitled", "short"]


def test_caps(spark):
    assert col(spark, ["a b c", "a b"], lambda c: text.truncate_words(c, 2)) == ["a b", "a b"]
    assert col(spark, ["abcdef ghijkl", "abcdefghijklmn", "a bcdefghijklmn"], lambda c: text.cap_chars(c, 10)) == ["abcdef", "abcdefghij", "a bcdefghi"]
    assert col(spark, ["Submit as one PDF by 5 pm, 14 November 2025 now"], text.truncate_title) == ["Submit as one PDF by 5 pm"]
    assert col(spark, ["one two three", "one two three four", "x" * 25], text.clean_short_title) == ["one two three", None, None]


def test_key_title(spark):
    got = col(spark, ["The history of bread and butter in towns", "Salt", "How the sea and the sky are one thing"], lambda c: text.key_title(F.lit(None).cast("string"), c))
    assert got == ["History of bread and butter", "Salt", "Sea and the sky"]


def test_json_object(spark):
    got = col(spark, ['```json\n{"a": 1}\n```', 'so: {"a": 1} done', "[1]", "no"], lambda c: F.variant_get(text.json_object(c), "$.a", "int"))
    assert got == [1, 1, None, None]


def test_strip_tags(spark):
    assert col(spark, ["<p>a&amp;b</p><script>x</script><div> c </div>"], text.strip_tags) == ["a&b\nc"]


REPAIRS = [
    "ﬁne “text”\r\nwith­ soft hyphens", "a\tb\n\n\n\nc  \n    \td", "```\n  code\t x \n```\nafter   that", "• one\n• two\ntail", "intro • one • two",
    "\n\n".join("This is a sentence with many words . Another one follows here with words".split()),
    "\n".join("the quick brown fox jumps over the lazy dog and runs a-\nway again until night" for _ in range(6)),
]


def test_clean_characters_native_is_plain(spark):
    assert col(spark, REPAIRS, text.clean_characters) == [repair.clean_characters(x) for x in REPAIRS]


@pytest.mark.parametrize("x", REPAIRS)
def test_normalise_is_idempotent(x):
    once = repair.normalise_text(x)
    assert repair.normalise_text(once) == once


def test_shapes(spark):
    flags = col(spark, REPAIRS, text.looks_word_per_line), col(spark, REPAIRS, text.looks_hard_wrapped)
    assert flags[0] == [repair.word_per_line(x.split("\n")) for x in REPAIRS]
    assert flags[1] == [repair.hard_wrapped(x.split("\n")) for x in REPAIRS]


def test_word_per_line_becomes_prose():
    assert repair.normalise_text("\n\n".join(f"w{k}" for k in range(30))) == " ".join(f"w{k}" for k in range(30))


MAIL = "From: A <a@x.org>\nTo: B\nSubject: Plan\n\nHere is the plan for the week, please read all of it today.\n\nBest,\nAnn\nCEO\n+1 555 123 4567\n\nOn Mon, 1 Jan 2024, B wrote:\n> old text\n> more"


def test_email_noise(spark):
    out = repair.strip_email_noise(MAIL)
    assert "old text" not in out and "CEO" not in out and "the plan for the week" in out and repair.strip_email_noise(out) == out
    assert repair.strip_email_noise("just text\n> quoted") == "just text\n> quoted"
    assert col(spark, [MAIL, None], repair.without_email_noise) == [out, None]


def test_running_lines(spark):
    pages = [f"Report\nbody {k}\nmore\nlast {k}\nPage {k} of 4" for k in range(1, 5)]
    few, alone, odd = pages[:2], ["a", "b", "c"], ["", "Head 1\nx", "head 2", "HEAD 3\ny\n\n z ", "long " * 40]
    out, same, other, last = col(spark, [pages, few, alone, odd], repair.without_running_lines, "array<string>")
    assert all("Page" not in p for p in out) and out[0].startswith("Report") and not out[1].startswith("Report") and out[1] == "more"
    assert same == few and other == alone and last == ["", "x", "", "y\n z ", "long " * 40]


def test_one_cells(spark):
    docs = ["| all of it |\n| opens\ncloses |\n|  |\n||\n# Head ¶\n# x |\na | b", "| a | b |\n|---|---|\n| one |", None]
    got = col(spark, docs, repair.one_cells_unwrapped)
    assert got == ["all of it\nopens\ncloses\n\n||\n# Head\n# x |\na | b", docs[1], None]


def test_chunks():
    rnd = random.Random(2)
    doc = "\n\n".join(["# Title"] + [f"## S{k}\n\n" + " ".join(f"w{rnd.randint(0, 99)}{'.' if rnd.random() < 0.1 else ''}" for _ in range(rnd.randint(20, 500))) for k in range(5)])
    got = chunking.chunk(doc)
    assert all(w <= chunking.LEAF_WORDS for _, w, _, _, atomic, _ in got if not atomic)
    assert all(0 <= a < b <= len(doc) for _, _, a, b, _, _ in got)
    assert [x[2] for x in got] == sorted(x[2] for x in got) and all(p[5][0] == "Title" for p in got)
    assert chunking.chunk("tiny  text ") == [("tiny  text", 2, 0, 10, False, [])]


def test_chunk_kinds():
    body = "word " * 70
    got = chunking.chunk(f"{body}\n\n1. one\n2. two\n\n| a |\n| b |\n\n```\nx\n```\n\nsee $$x^2$$ there")
    assert [t for t, *_, atomic, _ in got if atomic] == ["1. one\n2. two", "| a |\n| b |", "```\nx\n```", "$$x^2$$"]


def test_sentence_cuts():
    got = chunking.chunk(("Alpha beta et al. found that Fig. 3 shows it. " * 30).strip())
    assert all(t.endswith("it.") for t, *_ in got)
    cjk = chunking.chunk("漢字。" * 100)
    assert all(t.endswith("。") and w <= 120 for t, w, *_ in cjk)


def test_udtf(spark):
    spark.udtf.register("chunk_text", chunking.ChunkText)
    spark.createDataFrame([("a " * 300,)], "text string").createOrReplaceTempView("one_doc")
    assert spark.sql("SELECT leaf_no, words FROM one_doc, LATERAL chunk_text(text) ORDER BY 1").collect() == [(0, 120), (1, 120), (2, 60)]


def test_limits(spark):
    from leafloom.sources import files

    rows = [(1, "words", 3, 10), (2, " \n\t", 0, 10), (3, None, 0, 10), (4, "long", files.MAX_WORDS + 1, 10), (5, "large", 3, files.MAX_UPLOAD + 1), (6, "edge", files.MAX_WORDS, files.MAX_UPLOAD)]
    d = spark.createDataFrame(rows, "k int, text string, n int, size long")
    assert {r.k: r.problem for r in files.within_limits(d, "n", size="size").collect()} == {1: None, 2: "empty", 3: "empty", 4: "too many words", 5: "file too large", 6: None}
    assert files.within_limits(d, "n").where("k = 5").first().problem is None
