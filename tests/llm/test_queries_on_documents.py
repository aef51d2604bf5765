"""op8's scores against a plain sum of table entries, and op9's pieces against the library, on the documents table."""

import math
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict

import pytest

from leafloom.llm import packing, quality
from leafloom.llm.tokens import load, tokenizer_path


def plain_odds(model, x):
    """One row's odds, entry by entry."""
    bins = [bisect_right(list(e), v) for e, v in zip(model.edges, x)]
    out = model.start + sum(float(t[b]) for t, b in zip(model.tables, bins))
    return out + sum(float(t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]]) for i, j, t in model.pairs)


def test_scores_are_sums_of_table_entries(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_on(docs, labels)
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    got = {r.doc_id: r.score for r in quality.op8_additive_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    import pyarrow as pa

    x = quality._matrix(pa.array([r.text or "" for r in rows]))
    for r, v in zip(rows, x):
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-plain_odds(model, v))), abs=1e-9)


def test_pieces_hold_every_token_once(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    plain = load(tokenizer_path()).plain
    ids = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 0] for r in rows}
    pieces, places = defaultdict(list), defaultdict(list)
    for p in packing.op9_cutting_stock_packing(spark, sf).collect():
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and len(own) == p.length > 0
        assert p.ids_crc32 == zlib.crc32(array("I", own).tobytes())
        pieces[p.doc_id].append((p.start, p.length))
        places[p.sequence_id].append((p.offset, p.length))
    assert pieces.keys() == ids.keys()
    for spans, total in [(x, len(ids[d])) for d, x in pieces.items()] + [(x, None) for x in places.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 1024
    used = [sum(n for _, n in x) for x in places.values()]
    padding = sum(1024 - n for n in used if n & (n - 1))  # a sequence that ends at a power of two is not padded
    assert padding < 0.002 * sum(used) + 1024 and sum(used) == sum(map(len, ids.values()))
