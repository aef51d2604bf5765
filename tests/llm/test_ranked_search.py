import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from leafloom.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """docs: (doc_id, text) in order; items: (item_id, text)."""
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, words in asked.items():
        scored = []
        for (doc, _), c, n in zip(docs, counts, sizes):
            s = 0
            for t in words & c.keys():
                m = 10 + (90 * n * n_docs) // n_terms
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if s:
                scored.append((-s, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_is_the_plain_sum(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert rows(R.op11_tput_ranked_search(spark, sf)) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert sorted(con.execute(R.OP11_SQL).fetchall(), key=repr) == want


@pytest.mark.parametrize("head,broadcast_rows", [(1, 200_000), (128, 0)])
def test_hot_terms_copies_and_ties(spark, head, broadcast_rows):
    rnd = random.Random(3)
    word = lambda: "w%d" % int(rnd.paretovariate(0.6))
    docs = [(k, " ".join(word() for _ in range(rnd.randint(1, 40)))) for k in range(300)]
    docs += [(1_000 + k, "the same text w1 w2 Straße ÉTÉ") for k in range(150)]
    docs += [(7, "twice w3"), (7, "twice w3"), (None, "twice w3 w4"), (None, None), (8, ""), (9, "... \x7f\x00 --"), (10, "w5 " * 3_000 + "rare")]
    items = [(k, " ".join(word() for _ in range(rnd.randint(1, 12)))) for k in range(25)]
    items += [(50, "SAME text"), (51, "twice W3!w4"), (52, None), (53, "unknown words"), (54, ""), (None, "rare w5"), (55, "straße"), (55, "rare"), (56, "Été")]
    left = spark.createDataFrame([(t, d, 1, 2) for d, t in docs], "text string, doc_id long, rid int, list int").coalesce(1)
    right = spark.createDataFrame(items, "item_id long, text string")
    assert rows(R.search(left, right, head=head, broadcast_rows=broadcast_rows)) == brute(docs, items)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    as_items = lambda d: d.withColumnRenamed("doc_id", "item_id")
    assert rows(R.search(none, as_items(one))) == rows(R.search(one, as_items(none))) == rows(R.search(none, as_items(none))) == []
    # one document: its terms weigh floor(1000 * ln(4 / 3))
    assert len(rows(R.search(one, as_items(one)))) == 1
