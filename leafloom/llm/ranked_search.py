"""Ranked lexical search by TPUT: three phases over postings that are partitioned by term.

1. Heads: of every list the HEAD postings of highest impact. Their sums per item and document are lower bounds; the K-th highest of
   an item is its first bound.
2. Threshold: a document without any posting of at least bound / terms cannot reach the bound, so every list gives all its postings
   from there on, and lists whose best posting is below give none. The sums are better lower bounds with a better K-th; a document
   that cannot reach it, even with all it may hold in the lists or parts of lists not given, is out.
3. Look-up: for what is left the exact postings, and the K best by exact score.

Impacts are whole numbers known once the corpus has been counted, so bounds are exact and ties are kept to the end. Lists are
filed by level of impact (a term's list is many pieces, of which the threshold takes the upper ones), and rows of a small side
(terms, items) are broadcast only up to BROADCAST_ROWS; beyond, they are joined on a key salted by document, so that the list of a
frequent term is dealt out.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table

K, HEAD = 10, 128
#: Rows of a few numbers or words that are broadcast at most, and the salts of the joins that stand in beyond that.
BROADCAST_ROWS, SALTS = 200_000, 32
#: Bits of the filter that keeps other words than the items' from being filed: one fixed size for any number of items.
FILTER_BITS = 1 << 18

#: Bytes that part terms become a blank, A-Z become a-z, all others stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_NO_ID = -(2**63)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _bit(term: bytes) -> int:
    return zlib.crc32(term) % FILTER_BITS


def _item_batches(batches):
    for b in batches:
        rows = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in set(terms(text))]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].decode() for r in rows], pa.string()), pa.array([_bit(r[1]) for r in rows], pa.int32())], names=["item", "term", "bit"])


def _posting_batches(bits: bytes):
    """(term, rid, doc_id, tf, n) of the terms that the filter lets through, and for each batch a row without a term: documents with terms, and their terms."""
    asked = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool).tolist()

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        known: dict[bytes, bool] = {}
        for b in batches:
            out, docs, total = [], 0, 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = terms(text)
                n = len(words)
                docs, total, rid = docs + (n > 0), total + n, rid + 1
                for t, tf in Counter(words).items():
                    take = known.get(t)
                    if take is None:
                        take = asked[_bit(t)]
                        if len(known) < 500_000 and len(t) < 48:
                            known[t] = take
                    if take:
                        out.append((t, rid, doc, tf, n))
            out.append((None, None, None, docs, total))
            cols = list(zip(*out))
            yield pa.record_batch([pa.array(cols[0], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["term", "rid", "doc_id", "tf", "n"])

    return run


def _beside(big: DataFrame, small: DataFrame, keys: list[str], rows: int, limit: int) -> DataFrame:
    """big joined with a small side of so many rows; beyond the limit on a key salted by document, so no list is one task's."""
    if rows <= limit:
        return big.join(F.broadcast(small), keys)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.col("rid"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def level(impact: Column) -> Column:
    """Pieces of a list: by powers of the fourth root of two."""
    return F.floor(4 * F.log2(impact.cast("double"))).cast("int")


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(item, kth): the k-th highest sum of each item, 0 where it has fewer."""
    best = sums.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sum")))).where(F.col("_r") <= k)
    return best.groupBy("item").agg(F.when(F.count("*") >= k, F.min("sum")).otherwise(F.lit(0)).cast("long").alias("kth"))


def search(docs: DataFrame, items: DataFrame, k: int = K, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Null texts have no terms and are not counted as documents. Rows of one item_id are one item with the terms of all; a null
    item_id is an item of its own, and one without terms gets no row. Repeated rows of docs are documents of their own. Equal scores
    go by doc_id, null last, then by the place of the row. Texts of any length count whole. Other columns are not used, whatever
    their names. Empty tables give an empty result.
    """
    spark = prepare(docs.sparkSession)
    asked = items.select(F.coalesce(F.col(item_col).cast("long"), F.lit(_NO_ID)).alias("item"), F.col(text_col).alias("text"))
    words = materialize(asked.mapInArrow(_item_batches, "item long, term string, bit int").distinct(), "search-items")
    bits = np.zeros(FILTER_BITS, bool)
    bits[[r[0] for r in words.select("bit").distinct().collect()]] = True  # FILTER_BITS rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = materialize(texts.mapInArrow(_posting_batches(np.packbits(bits).tobytes()), "term string, rid long, doc_id long, tf long, n long"), "search-raw")
    n_docs, n_terms = raw.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    raw = raw.where("term is not null")

    # what is known of every list: weight and name by number
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    named = raw.groupBy("term").agg(F.count("*").alias("df")).join(words.select("term").distinct(), "term")
    lists = materialize(named.select("term", weight.alias("w"), F.monotonically_increasing_id().alias("list")), "search-lists")
    n_lists = lists.count()
    impact = F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 8 * (10 + ((90 * n * {n_docs}) div {max(1, n_terms)}))))")
    filed = _beside(raw, lists, ["term"], n_lists, broadcast_rows).select("list", "rid", "doc_id", impact.alias("impact")).where("impact > 0")
    postings = materialize(filed.withColumn("level", level(F.col("impact"))), "search-postings")

    # phase 1
    own = Window.partitionBy("list").orderBy(F.desc("impact"), F.asc_nulls_last("doc_id"), "rid")
    heads = materialize(postings.select("list", "rid", "doc_id", "impact").withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= head), "search-heads")
    best = heads.where("_r = 1").select("list", F.col("impact").alias("best"))
    wanted = words.join(lists.select("term", "list"), "term").join(best, "list").select("item", "list", "best")
    wanted = materialize(wanted.withColumn("lists", F.count("*").over(Window.partitionBy("item"))), "search-wanted")
    n_wanted = wanted.count()
    bound = _kth(_beside(heads, wanted, ["list"], n_wanted, broadcast_rows).groupBy("item", "rid").agg(F.sum("impact").alias("sum")), k)

    # phase 2, in whole numbers: no posting of `least` means less than the bound. `rest`: what a list may hold of a document beyond what it gave
    least = F.greatest(F.expr("(kth + lists - 1) div lists"), F.lit(1))
    cut = wanted.join(bound, "item").select("item", "list", "best", least.alias("least"), F.least(F.col("best"), least - 1).alias("rest"))
    cut = materialize(cut, "search-cut")
    upper = cut.where("best >= least").withColumn("level", F.explode(F.sequence(level(F.col("least")), level(F.col("best"))))).drop("best")
    upper = materialize(upper, "search-upper")
    given = _beside(postings, upper, ["list", "level"], upper.count(), broadcast_rows).where("impact >= least")
    sums = given.groupBy("item", "rid").agg(F.sum("impact").alias("sum"), F.sum("rest").alias("held"), F.first("doc_id").alias("doc_id"))
    sums = materialize(sums, "search-sums")
    reach = cut.groupBy("item").agg(F.sum("rest").alias("spare")).join(_kth(sums, k), "item")
    left = sums.join(reach, "item").where("sum + spare - held >= kth").select("item", "rid", "doc_id", "sum", (F.col("spare") - F.col("held")).alias("open"))
    left = materialize(left, "search-left")

    # phase 3
    asking = left.where("open > 0").select("item", "rid")
    found = postings.select("rid", "list", "impact").join(F.broadcast(asking) if asking.count() <= broadcast_rows else asking, "rid")
    below = cut.select("item", "list", "least")
    found = _beside(found, below, ["item", "list"], n_wanted, broadcast_rows).where("impact < least")
    more = found.groupBy("item", "rid").agg(F.sum("impact").alias("more"))
    exact = left.join(more, ["item", "rid"], "left").select("item", "rid", "doc_id", (F.col("sum") + F.coalesce("more", F.lit(0))).alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid")
    out = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.when(F.col("item") != _NO_ID, F.col("item")).alias("item_id"), "rank", "doc_id", "score")


def op11_tput_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = "[translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR t IN regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')]"
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tfs AS (SELECT rid, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
lists AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total),
scored AS (SELECT i.item_id, t.rid, t.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM items i JOIN tfs t USING (term) JOIN lists USING (term), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {K}
"""
