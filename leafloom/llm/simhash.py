"""SimHash near-duplicate groups: a binary trie of fingerprints is joined with itself.

Pairs of trie nodes are followed together bit by bit; each pair carries the number of bits in which its two prefixes
differ and ends once that exceeds the budget. Equal fingerprints are one leaf. To deal the trie out, the 64 bits are cut into
blocks: two fingerprints within the budget agree in some choice of blocks (budget + 1 blocks: one of them; more blocks:
more of them), so each choice roots one trie, keyed by the agreeing bits, and is joined by itself. A root with more
fingerprints than a task should hold is dealt out as pairs of hashed chunks. Within a task, node pairs whose leaves are
all in one component already are not followed further, so a dense group costs no square of its size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare, table
from .components import connected_components

BITS, SEED, BUDGET, SHINGLE = 64, 42, 3, 3
#: Fingerprints under one root that one task takes; larger roots are dealt out in chunks of this size.
ROOT_ROWS = 2048


def _add_bits(hashes: list[int], counts: np.ndarray) -> None:
    raw = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 50_000):
        counts += np.unpackbits(raw[at : at + 50_000], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a whole text, as an unsigned number; 0 where there are no words."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    words = raw.lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    counts, n = np.zeros(64, dtype=np.int64), max(1, len(words) - shingle + 1)
    if n == 1:
        _add_bits([digest(joined, seed)], counts)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        begin, stop = starts[:n].tolist(), ends[shingle - 1 :].tolist()
        for at in range(0, n, 100_000):
            _add_bits([digest(joined[a:b], seed) for a, b in zip(begin[at : at + 100_000], stop[at : at + 100_000])], counts)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches):
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(2).cast(pa.binary()).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(fps)], names=["id", "th", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp): a row for each row of docs; th hashes the text, fp is the signed form of the 64 bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).mapInArrow(_fingerprint_batches, "id long, th long, fp long")


def local_components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable, for n nodes and links (i, j)."""
    label = np.arange(n) if label is None else label.copy()
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def trie_components(keys: np.ndarray, bounds: np.ndarray, budget: int = BUDGET, chunk: int = 100_000) -> np.ndarray:
    """Joins the tries rooted at keys[bounds[k]:bounds[k+1]], each range ascending, with themselves: the component label of every leaf (smallest index)."""
    n = len(keys)
    label = np.arange(n)
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        return ones[depth]

    lo, hi = bounds[:-1], bounds[1:]
    many = hi - lo > 1
    stack = [(0, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), dtype=np.int64))]
    while stack:
        depth, a0, a1, b0, b1, d = stack.pop()
        if not len(a0):
            continue
        if len(a0) > chunk:
            half = len(a0) // 2
            stack += [(depth, *(x[half:] for x in (a0, a1, b0, b1, d))), (depth, *(x[:half] for x in (a0, a1, b0, b1, d)))]
            continue
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        go = ~((change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (label[a0] == label[b0]))
        a0, a1, b0, b1, d = (x[go] for x in (a0, a1, b0, b1, d))
        size = (a1 - a0) * (b1 - b0)
        leaf = (size <= 64) | (depth >= 64)
        if leaf.any():
            la, lb, wb, sz = a0[leaf], b0[leaf], (b1 - b0)[leaf], size[leaf]
            step = 1 if not len(sz) else max(1, int(4 * chunk // max(1, sz.max())))
            for at in range(0, len(la), step):
                s = sz[at : at + step]
                each = np.repeat(np.arange(len(s)), s)
                k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                i, j = la[at : at + step][each] + k // wb[at : at + step][each], lb[at : at + step][each] + k % wb[at : at + step][each]
                near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
                if near.any():
                    label = local_components(n, i[near], j[near], label)
        a0, a1, b0, b1, d = (x[~leaf] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        c = ones_before(depth)
        am, bm, own = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0]), (a0 == b0) & (a1 == b1)
        both = lambda *x: tuple(np.concatenate(y) for y in zip(*x))
        other = ~own
        kids = both((a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), tuple(x[other] for x in (am, a1, b0, bm, d + 1)))
        a0, a1, b0, b1, d = kids
        go = (a1 > a0) & (b1 > b0) & (d <= budget) & ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
        stack.append((depth + 1, *(x[go] for x in kids)))
    return label


def _block_choices(rows: int, budget: int) -> list[int]:
    """Masks of bits that must agree: of budget + 1 blocks one, of more blocks more, until a root holds few rows on average."""
    for extra in range(budget + 1):
        blocks = budget + 1 + extra
        edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
        masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in kept) for kept in combinations(range(blocks), extra + 1)]
        if rows / 2 ** min(m.bit_count() for m in masks) <= ROOT_ROWS / 8:
            break
    return masks


def _join_batches(masks: list[int], budget: int):
    tops = []
    for m in masks:  # where each bit goes: agreeing bits on top
        order = [b for b in range(63, -1, -1) if m >> b & 1] + [b for b in range(63, -1, -1) if not m >> b & 1]
        tops.append(order)

    def arranged(fp: np.ndarray, which: int) -> np.ndarray:
        out, order, at = np.zeros(len(fp), dtype=np.uint64), tops[which], 63
        k = 0
        while k < 64:  # runs of neighbouring bits move together
            e = k
            while e + 1 < 64 and order[e + 1] == order[e] - 1:
                e += 1
            width = e - k + 1
            field = (fp >> np.uint64(order[e])) & np.uint64((1 << width) - 1)
            out |= field << np.uint64(at - width + 1)
            at, k = at - width, e + 1
        return out

    def flush(rows):
        which, root, chunk, fp = (np.concatenate(x) for x in zip(*rows))
        keys = np.empty(len(fp), dtype=np.uint64)
        for w in np.unique(which):
            keys[which == w] = arranged(fp[which == w].view(np.uint64), int(w))
        order = np.lexsort((keys, chunk, root, which))
        which, root, chunk, fp, keys = (x[order] for x in (which, root, chunk, fp, keys))
        new = np.concatenate(([True], (which[1:] != which[:-1]) | (root[1:] != root[:-1]) | (chunk[1:] != chunk[:-1]), [True]))
        label = trie_components(keys, np.flatnonzero(new), budget)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch([pa.array(fp[tied]), pa.array(fp[label[tied]])], names=["a", "b"])

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:  # sorted by root, so a root is whole once another begins
            cols = [b.column(k).to_numpy() for k in range(4)]
            if not len(cols[0]):
                continue
            key = np.stack(cols[:3])
            if size >= 100_000 and last is not None:
                cut = int(np.argmax((key != last).any(axis=0))) if (key != last).any() else len(cols[0])
                rows.append([c[:cut] for c in cols])
                if cut < len(cols[0]):
                    yield flush(rows)
                    rows, size = [], 0
                cols = [c[cut:] for c in cols]
            if len(cols[0]):
                rows.append(cols)
                size += len(cols[0])
                last = np.array([[cols[0][-1]], [cols[1][-1]], [cols[2][-1]]])
        if rows:
            yield flush(rows)

    return run


def near_links(fps: DataFrame, rows: int, budget: int = BUDGET) -> DataFrame:
    """fps: distinct signed fingerprints in column fp. Links (a, b) that join all within the budget into the same components."""
    masks = _block_choices(rows, budget)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rooted = fps.select(F.col("fp"), F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("which", "mask")).select(
        "which", F.col("fp").bitwiseAND(F.col("mask")).alias("root"), "fp"
    )
    large = rooted.groupBy("which", "root").count().where(F.col("count") > ROOT_ROWS).select("which", "root", F.ceil(F.col("count") / ROOT_ROWS).cast("long").alias("parts"))
    dealt = rooted.join(large, ["which", "root"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    dealt = dealt.select("which", "root", "fp", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    chunk = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
    dealt = dealt.select(F.col("which").cast("long").alias("which"), "root", chunk.alias("chunk"), "fp")
    return dealt.repartition("which", "root", "chunk").sortWithinPartitions("which", "root", "chunk").mapInArrow(_join_batches(masks, budget), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(id, th, fp, component_id) for each row of docs: fingerprints within `budget` bits are linked, components take all that is reachable.

    Null and empty texts have fingerprint 0 and link like any other. component_id is the smallest non-null id reachable (null if there is none).
    Repeated rows keep their own rows. An empty table gives an empty table.
    """
    spark = prepare(docs.sparkSession)
    marked = materialize(fingerprints(docs, id_col, text_col), "simhash")
    fps = materialize(marked.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-fps")
    found = connected_components(near_links(fps.select("fp"), fps.count(), budget))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("component").agg(F.min("rep").alias("component_id"))
    return marked.join(rooted.join(least, "component").select("fp", "component_id"), "fp").select("id", "th", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: the smallest id (rows without an id come last; ties by text hash)."""
    last = F.lit(2**63 - 1)
    groups = materialize(simhash_groups(docs, id_col, text_col), "simhash-groups")
    # a group without any id has no component_id: its fingerprint stands for it
    group = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")))
    lead = groups.groupBy(group.alias("g")).agg(F.min(F.struct(F.coalesce("id", last).alias("i"), F.col("th").alias("h"))).alias("lead")).select("lead.i", "lead.h")
    key = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(id_col).cast("long"), last).alias("_sh_i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_sh_h"))
    kept = key.join(lead.select(F.col("i").alias("_sh_i"), F.col("h").alias("_sh_h")), ["_sh_i", "_sh_h"], "left_semi")
    return kept.dropDuplicates(["_sh_i", "_sh_h"]).select(docs.columns)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
