"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors lexicographically by a string of random hash bits (the signs of random projections of the vectors
less their mean) and compares every vector with a bounded window of its neighbours in that order; verified pairs of all passes
are united. What is sorted is a code of a byte for each component with a bound of its error: pairs that the bound settles
are settled there, the few that it does not are compared as doubles.

The number of passes and the window follow from the row count and from how far the vectors lie from their mean (measured), so
that a pair just at the threshold stays apart in all passes with a chance of at most MISS. That holds if all meet that share the leading
bits relied on: the window is WIDER times the one that the number of passes is for, and runs of equal leading bits that exceed even
that (dense topics) are compared whole, tile by tile, where they are not in one component yet. The links inside each
component are then counted exactly: vectors within half the threshold's angle of the component's centre are all
linked with each other, and only those further out are compared, tile by tile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare, release, table
from .components import connected_components
from .simhash import local_components
from .vectors import matrix, one_per_id, same_length, usable

THRESHOLD = 0.95
WINDOW = 64
BITS = 48
#: Passes that are sorted at one time; where more are needed, they are made in turns, so that what lies on disk does not grow with their number.
PASSES_AT_ONCE = 512
MISS = 1e-5
SEED = 17
#: Rows on each side of a tile of compared vectors, and members of small components that one group takes on average.
TILE, GROUP_ROWS = 4096, 20_000
#: Windows are wider by this than halving rows would need, as no plane halves them exactly.
WIDER = 4
#: Rows on each side of a tile of a long run.
RUN_ROWS = 2048


def leading_bits(rows: int, window: int = WINDOW) -> float:
    """Bits after which rows / 2^bits, halved once more for unevenness, fit in the window."""
    return max(1.0, math.log2(max(2.0, rows / window)) + 1)


def agreement(threshold: float, radius2: float) -> float:
    """Chance that two vectors at the threshold have one sign, both at that squared distance from the mean."""
    cos = 1 - (1 - threshold) / max(radius2, 1e-9)
    return 1 - math.acos(max(-1.0, min(1.0, cos))) / math.pi


def passes_for(rows: int, agree: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Two vectors meet in a window once they share log2(rows / window) leading bits."""
    meet = max(agree, 0.5) ** leading_bits(rows, window)
    return max(4, math.ceil(math.log(miss) / math.log1p(-meet)))


def plan_passes(rows: int, agree: float, window: int = WINDOW) -> tuple[int, int]:
    """(passes, window) of the least work: a pass moves every row once and compares it with a window. Windows wider than 64 times `window`
    are weighed where the others ask for more passes than are made at one time. MISS holds for whatever is chosen: nothing is capped."""
    plans = lambda ks: [(passes_for(rows, agree, w), w) for w in (window << k for k in ks)]
    work = lambda x: x[0] * (256 + x[1])
    best = min(plans(range(7)), key=work)
    if best[0] <= PASSES_AT_ONCE:
        return best
    return min([best, *plans(range(7, 11))], key=work)


def turns(passes: int) -> list[range]:
    """The passes, PASSES_AT_ONCE at a time."""
    return [range(a, min(passes, a + PASSES_AT_ONCE)) for a in range(0, passes, PASSES_AT_ONCE)]


def _unit_batches(batches):
    for b in batches:
        for at, to in same_length(b.column(1)):
            x = matrix(b.column(1).slice(at, to - at))
            x = x / np.abs(x).max(axis=1)[:, None]  # squares of what is left neither overflow nor vanish
            x /= np.sqrt((x**2).sum(axis=1))[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.record_batch([b.column(0).slice(at, to - at), flat], names=["vec_id", "v"])


def _keys(x: np.ndarray, mean: np.ndarray, passes: range, seed: int) -> np.ndarray:
    """(rows, passes) of BITS sign bits, the first projection on top."""
    out = np.empty((len(x), len(passes)), dtype=np.int64)
    weights, x = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64), x - mean
    for k, p in enumerate(passes):
        planes = np.random.default_rng((seed, p, x.shape[1])).standard_normal((x.shape[1], BITS))
        out[:, k] = ((x @ planes) >= 0) @ weights
    return out


def _codes(x: np.ndarray) -> list[bytes]:
    """A code of each unit vector: step and error bound (floats), then a byte for each component."""
    step = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    q = np.rint(x / step[:, None].astype(np.float64)).astype(np.int8)
    error = np.sqrt(((x - q * step[:, None].astype(np.float64)) ** 2).sum(axis=1)) * 1.001 + 1e-6
    raw = np.concatenate([np.stack([step, error.astype(np.float32)], axis=1).view(np.uint8), q.view(np.uint8)], axis=1)
    return list(map(bytes, raw))


def _decoded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, error bounds) of codes of one length."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return raw[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1].copy()


def _ordered_batches(passes: range, seed: int, means: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            for at, to in same_length(b.column(1)):
                part = b.slice(at, to - at)
                x = matrix(part.column(1))
                keys, codes, n = _keys(x, means[x.shape[1]], passes, seed), pa.array(_codes(x), pa.binary()), len(x)
                for k, p in enumerate(passes):
                    yield pa.record_batch([pa.array(np.full(n, x.shape[1], np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(keys[:, k]), part.column(0), codes], names=["dim", "pass", "key", "vec_id", "q"])

    return run


def _linked(x: np.ndarray, error: np.ndarray, group: np.ndarray, window: int, threshold: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of pairs i < j <= i + window of one group that are or may be at or above the threshold; with split, only those with i < split <= j."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for s in range(0, len(x), 256):
        e = min(len(x), s + 256)
        f = min(len(x), e + window)
        c = x[s:e] @ x[s:f].T
        slack = 1.02 * (error[s:e, None] + error[None, s:f]) + 1e-5
        i, j = np.nonzero(c + slack >= threshold)
        sure = c[i, j] - slack[i, j] >= threshold
        i, j = i + s, j + s
        ok = (j > i) & (j - i <= window) & (group[i] == group[j])
        if split is not None:
            ok &= (i < split) & (j >= split)
        found.append((i[ok], j[ok], sure[ok]))
    return tuple(np.concatenate(y) for y in zip(*found))


def _settled(ids: np.ndarray, i: np.ndarray, j: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, edge): links that tie together what the sure pairs do (-2), and unsure pairs between what they leave apart (-3)."""
    label = local_components(len(ids), i[sure], j[sure])
    tied = np.flatnonzero(label != np.arange(len(ids)))
    open_ = ~sure & (label[i] != label[j])
    a, b = np.concatenate([ids[tied], ids[i[open_]]]), np.concatenate([ids[label[tied]], ids[j[open_]]])
    return a, b, np.repeat(np.array([-2, -3], np.int32), [len(tied), int(open_.sum())])


def _star(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together what (i, j) tie together, at most one for each row."""
    label = local_components(len(ids), i, j)
    tied = np.flatnonzero(label != np.arange(len(ids)))
    return ids[tied], ids[label[tied]]


_PAIR_SCHEMA = "a long, b long, edge int, side int, at int, grp int, q binary"


def _window_batches(window: int, threshold: float):
    """Over sorted rows: links within the window; the rows at both ends of the partition go on, to meet those of its neighbours."""

    def rows(a, b, edge, side, at, grp, q):
        n = len(a)
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(edge if np.ndim(edge) else np.full(n, edge, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(at.astype(np.int32)), pa.array(grp.astype(np.int32)), q], names=["a", "b", "edge", "side", "at", "grp", "q"])

    def run(batches):
        part, tail, head_left = TaskContext.get().partitionId(), None, window
        for b in batches:
            all_codes, dims = b.column(4).to_pylist(), b.column(0).to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(dims[1:] != dims[:-1]) + 1, [len(dims)])).tolist() if len(dims) else []
            for at, to in zip(edge, edge[1:]):
                codes = all_codes[at:to]
                (x, error), ids = _decoded(codes), b.column(3).to_numpy()[at:to]
                grp = dims[at:to].astype(np.int64) * (1 << 32) + b.column(1).to_numpy()[at:to]
                if head_left > 0:
                    n = min(head_left, len(ids))
                    yield rows(ids[:n], ids[:n], part - 1, 1, np.arange(window - head_left, window - head_left + n), grp[:n], pa.array(codes[:n], pa.binary()))
                    head_left -= n
                before = 0
                if tail is not None and tail[0].shape[1] == x.shape[1]:
                    before = len(tail[1])
                    x, ids, grp, error = (np.concatenate(v) for v in zip(tail[:4], (x, ids, grp, error)))
                    codes = tail[4] + codes
                i, j, sure = _linked(x, error, grp, window, threshold)
                new = j >= before
                a, c, kind = _settled(ids, i[new], j[new], sure[new])
                yield rows(a, c, kind, 0, np.zeros(len(a)), np.zeros(len(a)), pa.nulls(len(a), pa.binary()))
                tail = (x[-window:], ids[-window:], grp[-window:], error[-window:], codes[-window:])
        if tail is not None:
            _, ids, grp, _, codes = tail
            yield rows(ids, ids, part, 0, np.arange(len(ids)), grp, pa.array(codes, pa.binary()))

    return run


def _ends(window: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "at"], kind="stable")
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for _, g in pdf.groupby(pdf["q"].map(len)):
            split = int((g["side"] == 0).sum())
            if 0 < split < len(g):
                out.append(_settled(g["a"].to_numpy(), *_linked(*_decoded(g["q"].to_list()), g["grp"].to_numpy(), window, threshold, split)))
        return pd.DataFrame(dict(zip(("a", "b", "edge"), (np.concatenate(x) for x in zip(*out)))))

    return run


def _moments(batches):
    """By length: how many vectors, and their sum."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        for at, to in same_length(b.column(1)):
            x = matrix(b.column(1).slice(at, to - at))
            n, v = total.get(x.shape[1], (0, 0.0))
            total[x.shape[1]] = (n + len(x), v + x.sum(axis=0))
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([v for _, v in total.values()], pa.list_(pa.float64()))], names=["dim", "n", "total"])


def means_of(vectors: DataFrame) -> tuple[dict[int, np.ndarray], int, float]:
    """By length, the mean of unit vectors (a row for each partition and length comes to the driver); how many vectors there are; and the least mean squared distance from the mean of more than a window of them."""
    n, total = {}, {}
    for r in vectors.select("vec_id", "v").mapInArrow(_moments, "dim int, n long, total array<double>").collect():
        n[r.dim] = n.get(r.dim, 0) + r.n
        total[r.dim] = total.get(r.dim, 0.0) + np.array(r.total)
    means = {d: total[d] / n[d] for d in n}
    # unit vectors: the mean squared distance from the mean is 1 less the mean's square; a window holds all of a few
    return means, sum(n.values()), min((1 - float(m @ m) for d, m in means.items() if n[d] > WINDOW), default=1.0)


def _exact(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    side = lambda k: vectors.select(F.col("vec_id").alias(k), F.col("v").alias(f"v{k}"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(dot >= threshold).select("a", "b")


def projection_links(vectors: DataFrame, means: dict[int, np.ndarray], rows: int, passes: range, window: int, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """vectors: (vec_id, v) of unit length. Verified links (a, b) that connect what the passes find."""
    spark, window = vectors.sparkSession, WIDER * window
    listed = vectors.mapInArrow(_ordered_batches(passes, seed, means), "dim int, pass int, key long, vec_id long, q binary")
    parts = int(max(1, min(rows * len(passes) // (16 * window) + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * len(passes) // 200_000))))
    order = ["dim", "pass", "key", "vec_id"]
    met = materialize(listed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_window_batches(window, threshold), _PAIR_SCHEMA), "proj-met")
    ends = materialize(met.where("edge > -2 and edge >= 0").groupBy("edge").applyInPandas(_ends(window, threshold), "a long, b long, edge int"), "proj-ends")
    found = met.select("a", "b", "edge").unionAll(ends)
    return found.where("edge = -2").select("a", "b").unionAll(_exact(found.where("edge = -3").select("a", "b"), vectors, threshold))


def _run_batches(passes: range, seed: int, bits: int, means: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            for at, to in same_length(b.column(1)):
                part = b.slice(at, to - at)
                x = matrix(part.column(1))
                keys = _keys(x, means[x.shape[1]], passes, seed) >> (BITS - bits)
                n = len(x)
                for k, p in enumerate(passes):
                    yield pa.record_batch([pa.array(np.full(n, x.shape[1], np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(keys[:, k]), part.column(0)], names=["dim", "pass", "run", "vec_id"])

    return run


def _run_links(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        c, own, ids = (t.column(k).to_numpy() for k in ("c", "own", "vec_id"))
        order = np.argsort(c, kind="stable")  # blocks inside one component are passed over
        x, c, own, ids = matrix(t.column("v"))[order], c[order], own[order], ids[order]
        two = own.min() != own.max()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s in range(0, len(x), 256):
            e = min(len(x), s + 256)
            after = int(np.searchsorted(c, c[s], side="right")) if c[s] == c[e - 1] else s
            for f in range(after, len(x), 4096):
                g = min(len(x), f + 4096)
                near = (x[s:e] @ x[f:g].T >= threshold) & (c[s:e, None] < c[None, f:g])
                if two:
                    near &= own[s:e, None] != own[None, f:g]
                i, j = np.nonzero(near)
                found.append((i + s, j + f))
        a, b = _star(ids, *(np.concatenate(y) for y in zip(*found)))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def long_run_links(vectors: DataFrame, found: DataFrame, means: dict[int, np.ndarray], rows: int, passes: range, window: int, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """Links (a, b) between components (found: node, component) inside runs of equal leading bits that are longer than the wide window."""
    bits = min(BITS, math.floor(leading_bits(rows, window)))
    keyed = materialize(vectors.mapInArrow(_run_batches(passes, seed, bits, means), "dim int, pass int, run long, vec_id long"), "proj-runs")
    known = keyed.join(found.select(F.col("node").alias("vec_id"), F.col("component").alias("c")), "vec_id", "left").withColumn("c", F.coalesce("c", "vec_id"))
    run = ["dim", "pass", "run"]
    long = known.groupBy(*run).agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where((F.col("n") > WIDER * window + 1) & (F.col("c0") < F.col("c1")))
    long = long.select(*run, F.ceil(F.col("n") / RUN_ROWS).cast("long").alias("parts"))
    dealt = known.join(long, run).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select(*run, (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("tile"), "own", "vec_id", "c")
    return dealt.join(vectors, "vec_id").groupBy(*run, "tile").applyInArrow(_run_links(threshold), "a long, b long")


def _tile_counts(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, counts = [], []
        for _, g in pdf.groupby(["component", "tl", "ta"], sort=False):
            far = g["far"].to_numpy()
            if far.all() or not far.any():
                continue
            x, who, loose = np.stack(g["v"].to_list()), g["vec_id"].to_numpy(), g["loose"].to_numpy()
            tight, seen = ~loose[~far], np.zeros(int((~far).sum()), np.int64)
            for at in range(0, int(far.sum()), 512):
                a, own = x[far][at : at + 512], who[far][at : at + 512]
                near = (a @ x[~far].T >= threshold) & (own[:, None] != who[~far][None, :])
                ids.append(own)
                counts.append(near.sum(axis=1))
                seen += near.sum(axis=0)
            ids.append(who[~far][tight])
            counts.append(seen[tight])
        empty = np.zeros(0, np.int64)
        return pd.DataFrame({"vec_id": np.concatenate([empty, *ids]), "n": np.concatenate([empty, *counts]).astype(np.int64)})

    return run


def link_counts(members: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """members: (component, vec_id, v) of unit length. (vec_id, n_links): exact number of other members at or above the threshold."""
    spark = members.sparkSession
    sums = members.select("component", F.posexplode("v").alias("k", "x")).groupBy("component", "k").agg(F.sum("x").alias("x"))
    centres = sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s.x).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(F.col("c"), F.col("c")))
    angle = F.when(size > 1e-9, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("v"), F.col("c")) / size)))).otherwise(F.lit(4.0))
    placed = members.join(centres, "component").select("component", "vec_id", "v", (angle > math.acos(threshold) / 2 - 1e-6).alias("loose"))
    placed = materialize(placed, "proj-placed")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("loose").cast("long")).alias("n_loose"))
    sizes = sizes.select("component", "n", "n_loose", F.ceil(F.col("n") / tile).cast("int").alias("ta_n"), F.ceil(F.col("n_loose") / tile).cast("int").alias("tl_n"))
    known = placed.join(sizes, "component")
    own = F.pmod(F.xxhash64("vec_id"), F.lit(2**31 - 1))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = known.where("n_loose > 0")
    all_rows = some.select("component", "vec_id", "v", "loose", F.lit(False).alias("far"), upto("tl_n").alias("tl"), (own % F.col("ta_n")).cast("int").alias("ta"), "ta_n", "tl_n")
    far_rows = some.where("loose").select("component", "vec_id", "v", "loose", F.lit(True).alias("far"), (own % F.col("tl_n")).cast("int").alias("tl"), upto("ta_n").alias("ta"), "ta_n", "tl_n")
    few = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, placed.count() // GROUP_ROWS)
    key = F.when((F.col("ta_n") == 1) & (F.col("tl_n") == 1), F.pmod(F.xxhash64("component"), F.lit(few))).otherwise(F.xxhash64("component", "tl", "ta"))
    tiles = all_rows.unionAll(far_rows).select(key.alias("g"), "component", "vec_id", "v", "loose", "far", "tl", "ta")
    met = tiles.groupBy("g").applyInPandas(_tile_counts(threshold), "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("met"))
    sure = F.when(F.col("loose"), F.lit(0)).otherwise(F.col("n") - F.col("n_loose") - 1)
    return known.join(met, "vec_id", "left").select("vec_id", (sure + F.coalesce("met", F.lit(0))).cast("long").alias("n_links"))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept): each vector's number of others at or above the cosine threshold and the smallest id reachable.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths with each other. Repeated rows of an id count as one vector and give one row. Rows with a null id come once,
    without links or component, not kept. An empty table gives an empty table.
    """
    spark = prepare(df.sparkSession)
    every = materialize(one_per_id(df.select(F.col(id_col), F.col(vector).alias("_v")), id_col, "_v"), "proj-vectors")
    unit = materialize(every.where(usable("v")).mapInArrow(_unit_batches, "vec_id long, v array<double>"), "proj-unit")
    means, rows, radius2 = means_of(unit)
    passes, window = plan_passes(rows, agreement(threshold, radius2), window)
    found, links = None, None
    for turn in turns(passes):
        met = projection_links(unit, means, rows, turn, window, threshold, seed)
        links = materialize(met if links is None else links.unionAll(met), "proj-links")
        found = connected_components(links)
        more = materialize(long_run_links(unit, found, means, rows, turn, window, threshold, seed), "proj-more")
        if not more.isEmpty():
            links = links.unionAll(more)
            found = connected_components(links)
        if turn.stop < passes:  # of the links so far, those that tie the components are enough
            links = materialize(found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")), "proj-turn")
            release(spark)
    found = materialize(found.select(F.col("node").alias("vec_id"), "component"), "proj-components")
    counts = link_counts(found.join(unit, "vec_id").select("component", "vec_id", "v"), threshold)
    out = every.select("vec_id").join(found, "vec_id", "left").join(counts, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    no_id = df.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionAll(no_id).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
