import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.llm import tokens as T


@pytest.fixture(scope="module")
def tok():
    return T.WordCachedTokenizer(T.tokenizer_path())


def same(tok, texts):
    want = [e.ids for e in tok.plain.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tok.encode_batch(texts)] == want


PARTS = ["the", "a", "Straße", "été", "don't", "it's", "x1", "42", "!!", "...", ",", "\n", "\n\n", "\t", " ", "  ", " ", "　", "日本", "\x1c", "\x85", "é", "<|endoftext|>", "\r\n", "—", "'", "s", "1,000.5", "🙂", "​"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=25))
def test_same_ids_as_library(parts):
    tok = T.load(T.tokenizer_path())
    same(tok, ["".join(parts), " ".join(parts)])


def test_documents(tok, spark, sf):
    same(tok, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_cache_turns_over(tok):
    tok.KEEP = 50
    rnd = random.Random(1)
    for _ in range(10):
        same(tok, [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 60))) for _ in range(40)) for _ in range(3)])


def test_wavelet_matrix_round_trip():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 512, 513, 5000):
        ids = (rnd.zipf(1.3, n) % 50257).astype(np.uint16)
        ends = sorted({n // 2, n - 1}) if n else []
        ids[ends] = T.END
        wm, docs, among = T.load_shard(T.dump_shard(ids, [5, None][: len(ends)], ends))
        assert docs == [5, None][: len(ends)] and wm.select_all(T.END, among).tolist() == ends
        whole = T.load_shard(T.dump_shard(ids, [5, None][: len(ends)], ends))[0]
        assert (whole.decode() == ids).all() and whole.select_all(T.END, among).tolist() == ends
        count = Counter(ids.tolist())
        for t in list(count)[:8]:
            assert wm.count(t) == count[t]
            assert wm.occurrences(t)[:50] == np.flatnonzero(ids == t).tolist()[:50] if count[t] < 200 else wm.select(t, 7) == np.flatnonzero(ids == t)[7]
        for i in range(0, n, max(1, n // 9)):
            assert wm.access(i) == ids[i] and wm.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        assert wm.count(50300) == 0
    with pytest.raises(ValueError):
        T.load_shard(b"XXXX" + T.dump_shard(ids, [1], [n - 1])[4:])


def check_index(rows, texts_by_order, tok):
    at = 0
    for r, t in zip(rows, texts_by_order):
        ids = [*tok.plain.encode(t, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_query_against_whole_file(spark, sf, tok):
    rows = sorted(T.op5_wavelet_token_shards(spark, sf).collect(), key=lambda r: r.doc_id)
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    check_index(rows, [d.text for d in docs], tok)


def test_nulls_ties_and_small_shards(spark, tok):
    data = [(2, "b c"), (1, None), (2, "a"), (None, "x y z"), (3, "long " * 3000), (3, "long " * 3000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    shards = T.write_token_shards(df, shard_tokens=4)
    rows = sorted(T.read_token_index(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 3]
    assert shards.agg({"n_tokens": "sum"}).first()[0] == sum(r.n_tokens for r in rows)
    starts = np.cumsum([0] + [r.n_tokens for r in rows])[:-1]
    assert [r.start for r in rows] == starts.tolist()


def test_empty_table(spark):
    assert T.read_token_index(T.write_token_shards(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_lookup_inflates_few_frames():
    ids = np.tile(np.arange(1, 1000, dtype=np.uint16), 200)
    ids[-1] = T.END
    wm, _, among = T.load_shard(T.dump_shard(ids, [1], [len(ids) - 1]))
    assert wm.select_all(T.END, among).tolist() == [len(ids) - 1] and wm.access(77_777) == ids[77_777] and wm.select(5, 100) == 100 * 999 + 4
    known = sum(len(p.known) for p in wm.planes)
    assert known < sum(len(p.frames) for p in wm.planes) / 2


def test_very_long_text_and_clashing_columns(spark, tok):
    text = "lorem ipsum dolor " * 120_000
    df = spark.createDataFrame([(1, text, 5, b"x"), (2, "a", 6, b"y")], "doc_id long, text string, n_tokens int, payload binary")
    rows = sorted(T.read_token_index(T.write_token_shards(df)).collect(), key=lambda r: r.doc_id)
    check_index(rows, [text, "a"], tok)


def test_a_word_before_stops_is_asked_once():
    """Before: the model was asked anew for a known word with stops behind it."""
    tok = T.WordCachedTokenizer(T.tokenizer_path())
    asked, model = [], tok.model
    tok.model = lambda word: asked.append(word) or model(word)
    same(tok, ["so zyxel zyxel, zyxel. zyxel; été été!"])
    assert len(asked) == len(set(asked)) and len(asked) <= 3
