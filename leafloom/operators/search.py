"""Search over a corpus of trees: postings of words by bucket, and an exact look at what they name.

What is searched are the titles, points and texts of nodes and the overviews of trees, blanks squeezed and letters lowered without a
change of length. A query is a string that may begin and end inside words: all its words but the first and last must stand as they
are, the last must begin one and the first end one (one word alone may lie anywhere in one). So the words that can hold an end of the
query come from the vocabulary, their postings from their buckets only, and only entries that have all of them are told.

An entry has a number, and that alone stands in postings. Several queries go through the index together: what a word may be for all of
them is one row of bits, and an entry's bits are joined by or. No entry's text is moved: it is looked at where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions.text import lower_safe
from leafloom.functions.units import BLANK, SOLID

#: Parts of the postings; a word's bucket follows from the word.
BUCKETS, LEAST = 64, 2
#: Bits of a long that words of queries take (of a longer query the first so many words are asked of the postings, and all of the text), and
#: rows of the vocabulary that are sent to every task at most; more are joined by a shuffle.
BITS, BROADCAST_WORDS = 60, 200_000
KEY = ["tree_id", "node_id", "field"]


def _bare(c: Column) -> Column:
    """White space as single blanks, none at the ends; a blank that stands alone is not touched."""
    return F.trim(F.regexp_replace(c, f"{BLANK}{{2,}}|[{BLANK}&&[^ ]]", " "))


def squeezed(c: Column) -> Column:
    return lower_safe(_bare(F.coalesce(c, F.lit(""))))


def entries(nodes: DataFrame, overviews: DataFrame | None = None) -> DataFrame:
    """(tree_id, node_id, field, low): title, point (points, else the hook) and text of every node but a root that summarises, and overview (of
    a tree: node_id null). overviews: tree_id, text."""
    points = F.when(F.size("key_points") > 0, F.array_join("key_points", " ")).otherwise(F.col("hook"))
    of = lambda name, c: F.struct(F.lit(name).alias("field"), c.alias("_value"))
    told = F.array(of("title", F.col("title")), of("point", F.when(~F.col("is_leaf"), points)), of("text", F.col("text")))
    out = nodes.where("is_leaf or parent is not null").select("tree_id", "node_id", F.inline(told))
    if overviews is not None:
        out = out.unionByName(overviews.select("tree_id", F.lit(None).cast("string").alias("node_id"), F.lit("overview").alias("field"), F.col("text").alias("_value")))
    # squeezed() in two steps, each made once
    return out.where(F.col("_value").rlike(SOLID)).select("tree_id", "node_id", "field", _bare(F.col("_value")).alias("_bare")).select(*KEY, lower_safe(F.col("_bare")).alias("low"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """Entries with their numbers, and postings (bucket, word, entry) filed by bucket, as they lie in a folder."""

    entries: DataFrame
    postings: DataFrame
    words: DataFrame


def write_index(found: DataFrame, path: str) -> None:
    """Writes entries() and their postings; words of any number of entries spread over as many rows."""
    numbered = found.withColumn("entry", F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(f"{path}/entries")
    kept = found.sparkSession.read.schema(numbered.schema).parquet(f"{path}/entries")
    words = kept.select("entry", F.explode(F.array_distinct(F.split("low", " "))).alias("word")).withColumn("bucket", _bucket(F.col("word")))
    # a frequent word's postings are dealt over several writers of its bucket
    words.repartition(F.col("bucket"), F.pmod(F.xxhash64("entry"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    read_postings(kept.sparkSession, path).groupBy("bucket", "word").agg(F.count("*").alias("entries")).write.mode("overwrite").parquet(f"{path}/words")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entry long, word string, bucket int").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/entries"), read_postings(spark, path), spark.read.parquet(f"{path}/words"))


def _asked(q: str) -> list[Column]:
    """What each word of a query asks of one word of an entry."""
    word, (first, *rest) = F.col("word"), q.split(" ")
    return [word.contains(first)] if not rest else [word.endswith(first), *[word == w for w in rest[:-1]], word.startswith(rest[-1])]


def find(index: Index, query: str) -> DataFrame:
    """(tree_id, node_id, field, hits) of the entries that hold a query of LEAST characters or more; hits do not overlap."""
    return find_all(index, [query]).drop("query")


def find_all(index: Index, queries: Sequence[str]) -> DataFrame:
    """find() of several queries with column query; the index is gone through once for as many as BITS holds."""
    spark = index.entries.sparkSession
    low = [r[0] for r in spark.createDataFrame([(k, q) for k, q in enumerate(queries)], "k int, q string").orderBy("k").select(squeezed(F.col("q"))).collect()] if queries else []
    lots, used = [], BITS
    for q, s in zip(queries, low):
        if len(s) >= LEAST:
            asked = _asked(s)[:BITS]
            if used + len(asked) > BITS:
                lots.append([])
                used = 0
            lots[-1].append((q, s, asked, used))
            used += len(asked)
    out = [_find_lot(index, lot) for lot in lots]
    return reduce(DataFrame.unionByName, out) if out else index.entries.limit(0).select(F.lit("").alias("query"), *KEY, F.lit(0).alias("hits"))


def _find_lot(index: Index, lot: list[tuple[str, str, list[Column], int]]) -> DataFrame:
    bits = reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << at + k)).otherwise(F.lit(0)).cast("long") for _, _, asked, at in lot for k, c in enumerate(asked)])
    words = index.words.select("bucket", "word", bits.alias("bits")).where("bits <> 0")
    n, buckets = words.agg(F.count("*"), F.array_sort(F.collect_set("bucket"))).first()  # BUCKETS at most
    held = index.postings.where(F.col("bucket").isin(list(buckets)) if buckets else F.lit(False))
    held = held.join(F.broadcast(words) if n <= BROADCAST_WORDS else words.hint("merge"), ["bucket", "word"])
    both = held.groupBy("entry").agg(F.bit_or("bits").alias("_bits"))
    whole = lambda asked, at: F.lit((1 << len(asked)) - 1 << at)
    both = both.where(reduce(Column.__or__, [F.col("_bits").bitwiseAND(whole(a, at)) == whole(a, at) for _, _, a, at in lot]))
    count = lambda s: ((F.length("low") - F.length(F.replace("low", F.lit(s), F.lit("")))) / len(s)).cast("int")
    hit = lambda q, s, a, at: F.when(F.col("low").contains(s), F.struct(F.lit(q).alias("query"), count(s).alias("hits"), whole(a, at).cast("long").alias("_all")))
    holds = reduce(Column.__or__, [F.col("low").contains(s) for _, s, _, _ in lot])
    read = index.entries.where(holds).select("entry", *KEY, F.inline(F.array_compact(F.array(*[hit(*x) for x in lot]))))
    return read.join(both.hint("merge"), "entry").where(F.col("_bits").bitwiseAND(F.col("_all")) == F.col("_all")).select("query", *KEY, "hits")
