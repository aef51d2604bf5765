import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from leafloom.functions import address
from leafloom.operators import search


def expected(text):
    try:
        a = ipaddress.ip_address(text.strip().removeprefix("[").removesuffix("]"))
    except ValueError:
        return None
    return (getattr(a, "ipv4_mapped", None) or a).is_global


def test_addresses(spark):
    rnd = random.Random(3)
    edges = [ipaddress.ip_network(n) for n in (*address.CLOSED, *address.OPEN_WITHIN)]
    near = [str(type(n[0])(x)) for n in edges for x in (int(n[0]) - 1, int(n[0]), int(n[-1]), int(n[-1]) + 1) if 0 <= x < 1 << n.max_prefixlen]
    some = [str(ipaddress.ip_address(rnd.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rnd.getrandbits(128) >> rnd.choice([0, 1, 64, 100]))) for _ in range(200)]
    odd = ["", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "::", "::1", "[::1]", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::8.8.8.8", "g::1", ":1:2", "12345::", "FE80::1", " 8.8.8.8 ", ":", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    exploded = [ipaddress.ip_address(x).exploded.upper() for x in some[-20:]]
    texts = [*near, *some, *odd, *exploded]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", address.is_public_address(F.col("t")).alias("p")).collect()
    assert {texts[r.k]: r.p for r in got} == {t: expected(t) for t in texts}


def test_links(spark):
    rows = [
        ("http://x.org/a", ["8.8.8.8"], None), ("HTTPS://u:p@X.org:8443?q", ["8.8.8.8", "2606:4700::1"], None), ("http://x.org", ["8.8.8.8", "10.0.0.1"], "private"), ("ftp://x.org", ["8.8.8.8"], "scheme"),
        ("x.org", ["8.8.8.8"], "scheme"), ("http:///x", ["8.8.8.8"], "host"), ("http://x.org", [], "unknown"), ("http://x.org", None, "unknown"), ("http://127.0.0.1:80/", ["8.8.8.8"], "private"),
        ("http://[::1]:80/", None, "private"), ("http://[2606:4700::1]/", None, None), ("http://x.org", ["nonsense"], "private"), (None, ["8.8.8.8"], "scheme"), ("http://x.org#@10.0.0.1", ["8.8.8.8"], None),
    ]
    got = spark.createDataFrame([(k, u, a) for k, (u, a, _) in enumerate(rows)], "k int, u string, a array<string>").select("k", address.link_problem(F.col("u"), F.col("a")).alias("p")).collect()
    assert {r.k: r.p for r in got} == {k: p for k, (*_, p) in enumerate(rows)}


@pytest.fixture(scope="module")
def nodes(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["the", "then", "on", "another", "Straße", "İstanbul", "aa", "aaa", "a", "lathe"])
    text = lambda n: rnd.choice(["", None, "  ".join(word() for _ in range(n)), "\n".join(word() for _ in range(n))])
    rows = [(t, f"n{k}", "n0" if k else None, k > 2, text(30), text(4), [text(3) or "x"] if k == 1 else [], text(5)) for t in range(20) for k in range(5)]
    return spark.createDataFrame(rows, "tree_id int, node_id string, parent string, is_leaf boolean, text string, title string, key_points array<string>, hook string")


def test_index_finds_what_a_scan_finds(spark, nodes, tmp_path):
    found = search.entries(nodes, nodes.select("tree_id", F.col("hook").alias("text")).where("node_id = 'n0'"))
    search.write_index(found, str(tmp_path))
    index = search.read_index(spark, str(tmp_path))
    held = [tuple(r) for r in index.entries.select(*search.KEY, "low").collect()]
    assert any(n is None and f == "overview" for _, n, f, _ in held) and not any(n == "n0" for _, n, *_ in held)
    for q in ("the", "THE  on", "he o", "aa", "e a", "on another th", "straße", "nothing here", "a", "", "e on a", "istanbul"):
        squeezed = " ".join(q.lower().split())
        want = [(*key, low.count(squeezed)) for *key, low in held if len(squeezed) > 1 and squeezed in low]
        got = sorted(map(tuple, search.find(index, q).collect()), key=lambda r: (r[0], r[1] or "", r[2]))
        assert got == sorted(want, key=lambda r: (r[0], r[1] or "", r[2])), q


def test_only_some_buckets_are_read(spark, nodes, tmp_path):
    search.write_index(search.entries(nodes), str(tmp_path))
    plan = search.find(search.read_index(spark, str(tmp_path)), "lathe")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_queries_go_through_the_index_together(spark, nodes, tmp_path, monkeypatch):
    """Before: find() read all postings and moved all texts once for each query."""
    search.write_index(search.entries(nodes), str(tmp_path))
    index = search.read_index(spark, str(tmp_path))
    asked = ["the", "he o", "aa", "a", "on another th", "nothing here", "THE  on"]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = sorted(((q, *r) for q in asked for r in rows(search.find(index, q))), key=str)
    found = search.find_all(index, asked)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == want and want and plan.count("Relation [entry#") == 1 == plan.count("Relation [tree_id#")
    monkeypatch.setattr(search, "BITS", 3)  # several turns, and more words than there are bits for
    monkeypatch.setattr(search, "BROADCAST_WORDS", 0)
    long = "then on another then on"
    assert rows(search.find_all(index, [*asked, long])) == sorted([*want, *((long, *r) for r in rows(search.find(index, long)))], key=str)
    assert search.find_all(index, ["a"]).count() == 0 == search.find_all(index, []).count()
