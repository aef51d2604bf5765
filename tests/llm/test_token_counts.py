import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import token_counts as T
from leafloom.llm.tokens import tokenizer_path

PATH = tokenizer_path(T.TOKENIZER)
PARTS = ["the", "A", "Straße", "ÉTÉ", "don't", "it's", "'llama", "x1", "42", "!!", "'", ",", "\n", "\n\n", "\t", " ", "  ", " ", "　", "日本", "\x1c", "\x85", "é", "̈", " ̈", "Σ", "İ", "<|endoftext|>", "<|startoftext|>x", "\r\n", "—", "🙂", "​", "\x00"]


def plain(texts):
    return [len(T.load(PATH).plain.encode(t or "", add_special_tokens=False).ids) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=30))
def test_counts_of_words_are_the_counts_of_the_text(parts):
    counter = T.load(PATH)
    for text in ("".join(parts), " ".join(parts)):
        assert counter.count(text) == plain([text])[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=30), st.integers(0, 40))
def test_stable_places_part_the_tokens(parts, at):
    text, counter = " ".join(parts), T.load(PATH)
    n, (places,) = counter.places(text, [(0, len(text) + 1)], True)
    assert n == plain([text])[0] and places[-1][0] == len(text)
    for x, _, before in places:
        assert plain([text[:x], text[x:]]) == [before, n - before]


def texts():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgé1,'") for _ in range(n))
    prose = " ".join(word(rnd.randint(1, 9)) for _ in range(900))
    blob = word(2_000)
    return [None, "", " ", prose, prose, prose + " " + blob + " " + prose, blob * 3, blob + prose, prose + blob, "　".join([word(5)] * 400), " " * 3_000, ("<|endoftext|>" * 90 + " ") * 3, ("é" * 70 + "\n") * 20, "x" * 64, "a b " * 16]


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (256, 32), (100_000, 10)])
def test_spliced_counts_are_the_library_s(spark, chunk, overlap):
    rows = [(None if k == 3 else k % 13, t, "x", 1) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string, n_tokens long").repartition(3)
    got = T.count_tokens(docs, chunk=chunk, overlap=overlap, limit=300)
    want = [(r[0], len((r[1] or "").encode()), n, n > 300) for r, n in zip(rows, plain(t for _, t, *_ in rows))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_query_is_the_library_s(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = {(r.doc_id, len(r.text.encode()), n, n > 2048) for r, n in zip(rows, plain(r.text for r in rows))}
    got = T.op13_overlap_token_counts(spark, sf).collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == want


def test_empty_table(spark):
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
