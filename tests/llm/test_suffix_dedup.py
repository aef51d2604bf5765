import hashlib
import random
from collections import Counter

from leafloom.llm.suffix_dedup import op1_suffix_array_dedup, suffix_array_dedup


def brute(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def cases(rnd):
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(20), prose(400)
    texts = [None, "", "x", "a" * 300, "ab" * 200, long, long, long[:500] + prose(30), prose(5) + passage, passage + prose(40), passage]
    texts += [prose(rnd.randint(1, 80)) for _ in range(20)]
    texts += [prose(10) + passage[rnd.randint(0, 20) : rnd.randint(40, 100)] + prose(10) for _ in range(30)]
    texts += [prose(9) + long[1000:1300] + prose(3) for _ in range(5)] + ["the the the " * 60, "z" + "the the the " * 40]
    return texts


def test_matches_brute_force(spark):
    for width, seed in ((24, 1), (40, 2), (200, 3)):
        texts = cases(random.Random(seed))
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(3)
        got = suffix_array_dedup(df, width=width).collect()
        want = brute(texts, width)
        assert len(got) == len(texts)
        for r in got:
            spans = list(zip(r.removed_from, r.removed_to))
            assert (r.n_bytes, sum(b - a for a, b in spans), len(spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], (width, r.doc_id)


def test_repeated_ids_and_rows(spark):
    t = "one two three four five six seven " * 3
    df = spark.createDataFrame([(1, t), (1, t), (1, "short"), (None, t + "!"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, len(r.kept)) for r in suffix_array_dedup(df, width=24).collect())
    assert got == [(0, 0), (5, 5), (102, 0), (102, 0), (103, 1)]


def test_empty_table(spark):
    assert suffix_array_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 200)))
    got = op1_suffix_array_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
