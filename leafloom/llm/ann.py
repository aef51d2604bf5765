"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest of PIVOTS pivots, in order. Shards of rows post those places in one inverted
file per pivot. A query reads the files of its own nearest pivots, adds up how far the places agree (which ranks
candidates by the footrule distance of the two permutations, absent pivots counting as place PREFIX), and reranks the
best SHARE of each shard, with all that tie with the last of them, by the real distance. Equal vectors are one entry of the index with the
smallest of their ids, as many as a result can hold. The pivots are a sample of at most PIVOTS different vectors; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table
from .vectors import matrix, one_per_id, usable

PIVOTS, PREFIX, SHARE, LEAST, NEAREST = 512, 64, 0.25, 256, 10
SHARD_ROWS, QUERY_ROWS = 8192, 2048


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(rows, prefix): the nearest pivots of each row, nearest first."""
    d = (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    prefix = min(prefix, len(pivots))
    near = np.argpartition(d, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)


def inverted_files(perm: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, row, place): rows and places posted under each pivot."""
    flat = perm.ravel()
    order = np.argsort(flat, kind="stable")
    begin = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=pivots))))
    return begin, (order // perm.shape[1]).astype(np.int32), (order % perm.shape[1]).astype(np.int32)


def search_shard(ids, many, x, begin, row, place, queries, query_ids, query_perm, nearest=NEAREST, share=SHARE, least=LEAST):
    """For each query the shard's nearest found: lists of (query_id, vec_id, distance). Vector k of x has the next many[k] of ids."""
    first = np.cumsum(many) - many
    prefix = query_perm.shape[1]
    take = min(len(x), max(least, int(np.ceil(share * len(x)))))
    out = []
    for q, qid, perm in zip(queries, query_ids, query_perm):
        spans = [(begin[p], begin[p + 1]) for p in perm]
        rows = np.concatenate([row[a:b] for a, b in spans])
        agree = np.concatenate([prefix - np.maximum(place[a:b], k) for k, (a, b) in enumerate(spans)])
        score = np.bincount(rows, weights=agree, minlength=len(x))
        best = np.flatnonzero(score >= np.partition(score, len(x) - take)[len(x) - take])
        d = np.sqrt(((x[best] - q) ** 2).sum(axis=1))
        if len(best) > nearest + 1:  # the query may be one of them
            close = d <= np.partition(d, nearest)[nearest]
            best, d = best[close], d[close]
        found = np.concatenate([ids[first[k] : first[k] + many[k]] for k in best])
        d = np.repeat(d, many[best])
        found, d = found[found != qid], d[found != qid]
        top = np.lexsort((found, d))[:nearest]
        out.append((np.full(len(top), qid), found[top], d[top]))
    return out


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """(vec_id, ids, v): a row for each different vector, with the `most` smallest of its ids, ascending; vec_id is the first."""
    lists = lambda ids: F.slice(F.sort_array(ids), 1, most)
    some = vectors.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("_part")).agg(lists(F.collect_list("vec_id")).alias("ids"))
    return some.groupBy("v").agg(lists(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "ids", "v")


def build_index(vectors: DataFrame, rows: int, pivots: dict[int, np.ndarray], prefix: int = PREFIX, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors: (vec_id, ids, v). One row for each shard: dim, shard, ids and how many each vector has, values, and its pivots' inverted files."""
    shards = max(1, -(-rows // shard_rows))

    def run(t: pa.Table) -> pa.Table:
        x, ids = matrix(t.column("v")), t.column("ids").combine_chunks()
        dim = x.shape[1]
        begin, row, place = inverted_files(permutations(x, pivots[dim], prefix), len(pivots[dim]))
        lists = {"ids": ids.flatten().to_numpy(), "many": np.asarray(ids.value_lengths()), "values": x.ravel(), "begin": begin, "row": row, "place": place}
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": t.column("shard").slice(0, 1), **{k: pa.array([v]) for k, v in lists.items()}})

    dealt = vectors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "ids", "v")
    return dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, ids array<bigint>, many array<int>, values array<double>, begin array<bigint>, row array<int>, place array<int>")


def pick_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """By vector length, at most `pivots` rows in hash order. The number of different lengths is taken to be small."""
    out = {}
    for (dim,) in vectors.select(F.size("v")).distinct().collect():
        some = vectors.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").toArrow()
        out[dim] = matrix(some.column("v"))
    return out


def nearest_neighbours(df: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, share: float = SHARE, pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where is_query holds, against every other row; score is the Euclidean distance in doubles.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; vectors
    of another length than the query's are no candidates. Repeated rows of an id are one vector. Equal distances go by the
    smaller id. With fewer candidates than `nearest`, all are returned; an empty table gives none. Other columns are not used,
    whatever their names. share=1 reranks every vector and is exact.
    """
    prepare(df.sparkSession)
    every = one_per_id(df.select(id_col, vector), id_col, vector)
    vectors = materialize(every.where(usable("v")), "ann-vectors")
    different = materialize(distinct_vectors(vectors, nearest + 1), "ann-distinct")
    chosen = pick_pivots(different, pivots)
    asked = vectors.where(is_query)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    index = materialize(build_index(different, different.count(), chosen, prefix), "ann-index")
    shards = index.select("dim", "shard")

    def gather(t: pa.Table) -> pa.Table:
        return pa.table({"dim": t.column("dim").slice(0, 1), "block": t.column("block").slice(0, 1), "q_ids": pa.array([t.column("vec_id").to_numpy()]), "q_values": pa.array([matrix(t.column("v")).ravel()])})

    packed = asked.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    packed = packed.groupBy("dim", "block").applyInArrow(gather, "dim int, block int, q_ids array<bigint>, q_values array<double>")
    met = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("dim", "shard", "block")
    met = met.join(F.broadcast(packed) if blocks == 1 else packed, ["dim", "block"]).join(index, ["dim", "shard"])

    def search(batches):
        for b in batches:
            flat = {n: b.column(n) for n in b.schema.names}
            for k in range(b.num_rows):
                dim = flat["dim"][k].as_py()
                ids, many, values, begin, row, place, q_ids, q_values = (flat[n].slice(k, 1).flatten().to_numpy() for n in b.schema.names[1:])
                q = q_values.reshape(-1, dim)
                got = search_shard(ids, many, values.reshape(-1, dim), begin, row, place, q, q_ids, permutations(q, chosen[dim], prefix), nearest, share)
                a, c, d = (np.concatenate(y) for y in zip(*got))
                yield pa.record_batch([pa.array(a), pa.array(c), pa.array(d)], names=["query_id", "vec_id", "score"])

    found = met.select("dim", "ids", "many", "values", "begin", "row", "place", "q_ids", "q_values").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
