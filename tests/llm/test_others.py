import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafloom.llm import ann, chat, mixing, packing, quality, registry, warc
from leafloom.llm.tokens import load, tokenizer_path


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    res = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)


# ---------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    rnd = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<", "|", "<\\|", "<\\/", "\n", "é🙂", "ok", "assistant"]
    said = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6)))
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "a\nb", "<|im_end|>", None]), rnd.choice([said(), None])) for c in (1, 2, 3, None) for t in range(12)] + [(4, None, "user", "x"), (4, 1, "user", "y"), (4, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df).cache()
    got = {r.conv_id: r for r in chat.parse_conversations(made).collect()}
    for c in (1, 2, 3, None, 4):
        turns = sorted([(t if t is not None else -1, chat_esc_role(r or ""), chat_esc(x or ""), r or "", x or "") for k, t, r, x in rows if k == c])
        assert [(x.role, x.text) for x in got[c].turns] == [(r, x) for *_, r, x in turns]
        assert got[c].loss_text == "".join(x for *_, r, x in turns if r == "assistant")
    assert got[4].formatted == "<|im_start|>user\nx<|im_sep|>y<|im_sep|>y<|im_end|>\n"
    assert chat.format_conversations(df.limit(0)).count() == 0


def chat_esc(t):
    return t.replace("\\", "\\\\").replace("<|", "<\\|")


def chat_esc_role(t):
    return chat_esc(t).replace("\n", "<\\/")


# ---------------------------------------------------------------- quality


def test_additive_model():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 19))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9
    assert (quality.fit(x[:0], y[:0]).score(x) > 0.99).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op8_additive_quality(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    told = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and np.mean([a == b for a, b in told]) > 0.97


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "word " * 40_000, "c"), (2, "word " * 40_000, "c")], "doc_id long, text string, quality_score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score_documents(docs, quality.fit_on(docs, none)).collect()
    assert len(out) == 4 and all(r.quality_score > 0.99 for r in out)


# ---------------------------------------------------------------- packing


def test_packing(spark):
    tok = load(tokenizer_path()).plain
    rnd = random.Random(2)
    texts = [None, "", "x", *(" ".join(rnd.choice("the of and quick brown fox".split()) for _ in range(rnd.randint(1, 2600))) for _ in range(120))]
    df = spark.createDataFrame([(k if k != 5 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = packing.pack(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r.doc_id == (k if k != 5 else None)), key=lambda r: r.start)
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1]) and sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    total = {s: sum(r.length for r in p) for s, p in by.items()}
    padded = sum(packing.cost(n) * 1024 for n in total.values())
    assert 1 - sum(total.values()) / padded < 0.02
    assert packing.pack(df.limit(0)).count() == 0


def test_column_generation_bound():
    lengths, demand = np.array([100, 300, 333, 512, 700]), np.array([50.0, 70, 20, 31, 40])
    solved = packing.column_generation(lengths, demand)
    for k in range(5):
        assert sum(a * p.count(k) for p, a in solved) == pytest.approx(demand[k])
    chosen = packing.whole_patterns(lengths, demand, solved)
    assert [sum(n * p.count(k) for p, n in chosen) for k in range(5)] == demand.tolist()
    assert all(lengths[p].sum() <= 1024 for p, _ in chosen)


# ---------------------------------------------------------------- mixing


def water(budget, kids):
    """Plain form: {name: (weight, cap)} -> budgets, shortages to the siblings."""
    out, left, open_ = {}, budget, dict(kids)
    while open_:
        w = sum(x for x, _ in open_.values())
        full = [k for k, (x, c) in open_.items() if x and c * w <= left * x]
        if not full:
            return out | {k: (left * x // w if w else 0) for k, (x, _) in open_.items()}
        k = min(full, key=lambda k: (open_[k][1] / open_[k][0], k))
        out[k] = open_[k][1]
        left -= open_.pop(k)[1]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_share_out(spark, seed):
    rnd = random.Random(seed)
    kids = {f"k{k}": (rnd.randint(0, 5), rnd.randint(0, 100)) for k in range(9)}
    df = spark.createDataFrame([("p", k, 300, w, c) for k, (w, c) in kids.items()], "parent string, kid string, parent_budget long, w long, cap long")
    assert {r.kid: r.budget for r in mixing.share_out(df, ["parent"], "kid").collect()} == water(300, kids)


def test_mix_odd_rows(spark):
    rows = [(1, None, None, None), (2, "a b c", "en", "s1"), (2, "a b c", "en", "s1"), (None, "d e", "en", "s1"), (3, "w " * 30_000, "fr", "odd name")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_tokens", F.lit("clash"))
    assert mixing.mix(df, percent=100, epochs=1).count() == 4
    twice = mixing.mix(df, percent=200, epochs=2).groupBy("epoch").count().collect()
    assert {r.epoch: r["count"] for r in twice} == {0: 4, 1: 4}
    assert mixing.mix(df.limit(0)).count() == 0


# ---------------------------------------------------------------- neighbours


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in ann.op6_permutation_index(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        assert [k for k, _, _ in got[q]] == list(range(1, 11))
        assert all(s == pytest.approx(d[ids == v][0], rel=1e-12) for _, v, s in got[q])
        hit += len(set(best) & {v for _, v, _ in got[q]})
    assert hit / (10 * len(got)) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (100, [5.0, 5.0]), (1, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 0)]
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ---------------------------------------------------------------- WARC


def test_canonical_urls(spark):
    urls = ["http://www.Ex.org:80/a/?b=2&a=1&utm_source=x#f", "https://ex.org/a?a=1&b=2", "ex.org/a/", "https://ex.org/a?ref=1", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(warc.canonical_url(F.col("u"))).collect()] == ["ex.org/a?a=1&b=2", "ex.org/a?a=1&b=2", "ex.org/a", "ex.org/a", ""]


def test_files_and_resolution(spark, tmp_path):
    http = lambda status, **h: f"HTTP/1.1 {status} X\r\n".encode() + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in h.items()).encode() + b"\r\n"
    rec = lambda kind, rid, url, when, block: warc.format_record([("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Target-URI", url), ("WARC-Date", when)], block)
    data = b"".join([
        rec("response", "a", "http://x.org/p", "2024-01-01T00:00:00Z", http(200, ETag='"1"', Content_Type="text/html") + b"<p>1</p>"),
        rec("response", "b", "http://x.org/p", "2024-01-03T00:00:00Z", http(200, ETag='"2"', Content_Type="text/html") + b"<p>2</p>"),
        rec("response", "c", "http://x.org/p", "2024-01-03T12:00:00Z", http(500, ETag='"3"')),
        rec("revisit", "r1", "https://www.x.org/p/", "2024-01-03T00:00:00Z", http(304, ETag='W/"1"', Content_Type="nope", Age="5")),
        rec("revisit", "r2", "https://x.org/p", "2024-02-03T00:00:00Z", http(304, ETag='"1"')),
        rec("revisit", "r3", "https://x.org/p", "2024-02-03T00:00:00Z", http(304)),
        rec("revisit", "r4", "https://x.org/other", "2024-02-03T00:00:00Z", http(304, ETag='"1"')),
        rec("revisit", "r5", "https://x.org/p", "never", http(304, ETag='"2"')),
    ])
    (tmp_path / "a.warc.gz").write_bytes(data)
    records = warc.read_warc(spark, str(tmp_path))
    assert records.count() == 8 and bytes(records.where("record_id = 'a'").first().body) == b"<p>1</p>"
    got = {r.record_id: r for r in warc.resolve_revisits(records.withColumn("extra", F.lit(1))).collect()}
    assert {k: (r.outcome, r.base_id) for k, r in got.items()} == {"r1": ("resolved", "a"), "r2": ("changed", "b"), "r3": ("unchecked", "b"), "r4": ("no-base", None), "r5": ("no-base", None)}
    assert [(h.name, h.value) for h in got["r1"].headers] == [("age", "5"), ("content-type", "text/html"), ("etag", 'W/"1"')]
    assert warc.resolve_revisits(records.limit(0)).count() == 0
    assert [b for _, b in warc.parse_records(data[:-30])] == [b for _, b in warc.parse_records(data)][: len(list(warc.parse_records(data[:-30])))]


def test_digest_shas_are_of_whole_texts(spark, sf):
    out = {r.conv_id: r for r in chat.op7_chat_formatting(spark, sf).collect()}
    assert out[-1].loss_sha256 == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest() and out[-1].n_turns == 2


def test_revisits_without_a_url_and_odd_rows(spark):
    h = lambda **x: [(k, v) for k, v in x.items()]
    long = "v" * 200_000
    rows = [
        ("a", "response", None, 10, 200, h(etag="1"), "d"), ("b", "revisit", None, 20, 304, h(etag="1"), None), ("c", "response", "  ", 10, 200, h(etag="1"), "d"),
        ("d", "revisit", " ", 20, 304, h(etag="1"), None), ("e", "revisit", "https://", 20, 304, h(etag="1"), "d"),
        ("f", "response", "x.org", 10, None, h(etag="1", big=long), "d"), ("g", "revisit", "X.org/", 20, 304, h(etag="1"), None), ("g", "revisit", "X.org/", 20, 304, h(etag="1"), None), ("h", "revisit", "x.org", None, None, None, None),
    ]
    kind = "record_id string, warc_type string, url string, ts long, status int, headers array<struct<name:string,value:string>>, digest string"
    odd = spark.createDataFrame(rows, kind).withColumns({"base": F.lit(1), "period": F.lit("p"), "outcome": F.lit("mine"), "url_key": F.lit("k")})
    got = sorted((r.record_id, r.outcome, r.base_id, dict(r.headers or []).get("big") == long) for r in warc.resolve_revisits(odd).collect())
    assert got == [(x, "no-base", None, False) for x in "bde"] + [("g", "resolved", "f", True)] * 2 + [("h", "no-base", None, False)]
