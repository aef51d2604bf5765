"""Near-duplicate texts: SimHash groups by the trie self-join, then an exact join of sets of word shingles for what they leave apart.

Every text has a SimHash fingerprint of its shingles; the binary trie of fingerprints is joined with itself (simhash.py) and the links found
are verified. At the similarity asked for most alike texts differ in more bits than a trie join can afford (some 10 of 64), so
what the fingerprints leave apart is completed exactly.

Two texts are near copies where the Jaccard similarity of their shingle sets is ALIKE[0] / ALIKE[1] or more. In any one order of all
shingles such sets share a shingle among the first n - ceil(0.8 n) + 1 of each, so only texts that meet under such a shingle are
compared: by counts of shingles in BUCKETS parts, whose differences add up to no more than the sets differ in, and what that leaves by
the shared shingles themselves. The order puts shingles that a sample shows to be common last; it decides
the cost, never the result. Texts that are in one component already are not compared: first every text meets a window of others, then
all others, so a dense group costs no square of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, prepare
from .components import connected_components, grown
from .simhash import near_links

WORDS, SEED = 5, 42
ALIKE = (4, 5)
WINDOW = 8
BUCKETS = 256
#: One text of SAMPLE_OF shows which shingles are common: met COMMON times or more there; at most COMMON_MOST of them are told to the workers.
SAMPLE_OF, COMMON, COMMON_MOST = 16, 3, 200_000


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of the shingles of a whole text; a text of fewer words is one shingle, one without words has none."""
    parts = (text or b"").lower().split()  # bytes: only A-Z, only ASCII white space
    if not parts:
        return np.zeros(0, np.int64)
    digest, joined, n = xxhash.xxh64_intdigest, b" ".join(parts), len(parts) - words + 1
    if n <= 1:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())]
    return np.unique(np.array(hashes, dtype=np.uint64).view(np.int64))


def simhash(have: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingles: a bit is 1 where it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(have), 50_000):
        counts += np.unpackbits(have[at : at + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(have)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def prefix(have: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles under which a set is filed. common: ascending hashes, the rarer of them lower in rank."""
    n = len(have)
    keep = n - -(-ALIKE[0] * n // ALIKE[1]) + 1 if n else 0
    if not len(common):
        return have[:keep]
    at = np.minimum(np.searchsorted(common, have), len(common) - 1)
    known = common[at] == have
    rare = have[~known]
    return rare[:keep] if len(rare) >= keep else np.concatenate([rare, have[known][np.argsort(rank[at[known]])][: keep - len(rare)]])


def _arrays(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _sets(batches):
    for b in batches:
        have = [shingles(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([b.column(0), _arrays(have)], names=["s", "h"])


def _measured(common: np.ndarray, rank: np.ndarray):
    def run(batches):
        for b in batches:
            have = [shingles(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            s = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in have], dtype=np.uint64).view(np.int64)
            files = _arrays([prefix(h, common, rank) for h in have])
            counts = [np.minimum(np.bincount(h & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes() for h in have]
            sizes = pa.array(np.fromiter(map(len, have), np.int64, len(have)))
            prints = pa.array([simhash(h) for h in have], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), sizes, files, pa.array(counts, pa.binary()), prints], names=["id", "th", "s", "n", "files", "counts", "fp"])

    return run


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and ranks of the shingles that are common in a sample of the texts."""
    some = texts.where(F.pmod(F.xxhash64("th"), F.lit(SAMPLE_OF)) == 0).dropDuplicates(["th"]).select("th", "t")
    met = some.mapInArrow(_sets, "s long, h array<long>").select(F.explode("h").alias("x")).groupBy("x").count().where(F.col("count") >= COMMON)
    top = met.orderBy(F.col("count").desc(), "x").limit(COMMON_MOST).toArrow()
    x, count = top.column("x").to_numpy(), top.column("count").to_numpy()
    order = np.argsort(x)
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((x, count))] = np.arange(len(x))
    return x[order], rank[order]


def _near_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ALIKE[1] * np.minimum(a, b) >= ALIKE[0] * np.maximum(a, b)


def _out(a: np.ndarray, b: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    pad = np.full(len(full), -1)
    is_pair = np.concatenate([np.ones(len(low), bool), np.zeros(len(full), bool)])
    return pa.record_batch([pa.array(np.concatenate([low, full])), pa.array(np.concatenate([high, pad])), pa.array(is_pair)], names=["a", "b", "pair"])


def _window_pairs(window: int):
    """Over rows (x, s, n, component) sorted by x: pairs of two components at most `window` apart, and each x that has rows further apart than that."""

    def run(batches):
        tail = [np.zeros(0, np.int64)] * 4
        for b in batches:
            before = len(tail[0])
            x, s, n, c0 = (np.concatenate([t, b.column(k).to_numpy()]) for k, t in enumerate(tail))
            a, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, window + 1):
                i = np.flatnonzero(x[d:] == x[:-d])
                i = i[i + d >= before]
                i = i[_near_size(n[i], n[i + d]) & (c0[i] != c0[i + d])]
                a.append(s[i])
                c.append(s[i + d])
            far = x[window + 1 :][x[window + 1 :] == x[: -window - 1]]
            yield _out(np.concatenate(a), np.concatenate(c), np.unique(far))
            tail = [v[-window - 1 :] for v in (x, s, n, c0)]

    return run


def _within(ca: np.ndarray, cb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether counts by part differ by no more than those of alike sets can: (q - p) / (q + p) of their sizes' sum."""
    apart = np.abs(ca.astype(np.int16) - cb).sum(axis=1, dtype=np.int64)
    return sum(ALIKE) * apart <= (ALIKE[1] - ALIKE[0]) * (na + nb)


def _counts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def _all_pairs(batches):
    """Over rows (x, s, n, component, counts) sorted by x: all pairs of one x that are in different components and may be alike by their counts."""

    def group(rows):
        x, s, n, c, counts = (np.concatenate(v) for v in zip(*rows))
        edge = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if (c[lo:hi] == c[lo]).all():
                continue
            step = max(1, 1_000_000 // (hi - lo))
            for at in range(lo, hi, step):
                to = min(hi, at + step)
                i, j = np.nonzero((c[at:to, None] != c[None, lo:hi]) & (s[at:to, None] < s[None, lo:hi]) & _near_size(n[at:to, None], n[None, lo:hi]))
                for k in range(0, len(i), 20_000):
                    p, q = at + i[k : k + 20_000], lo + j[k : k + 20_000]
                    may = _within(counts[p], counts[q], n[p], n[q])
                    if may.any():
                        yield _out(s[p[may]], s[q[may]], np.zeros(0, np.int64))

    rows, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = [*(b.column(k).to_numpy() for k in range(4)), _counts(b.column(4))]
        if size >= 50_000 and (new := np.flatnonzero(cols[0] != rows[-1][0][-1])).size:
            rows.append([v[: new[0]] for v in cols])
            yield from group(rows)
            rows, size, cols = [], 0, [v[new[0] :] for v in cols]
        rows.append(cols)
        size += len(cols[0])
    if rows:
        yield from group(rows)


_PAIRS = "a long, b long, pair boolean"


def _may_be_alike(batches):
    """Over rows (a, b, na, nb, ca, cb): pairs whose counts by part do not differ by more than those of alike sets can."""
    for b in batches:
        may = _within(_counts(b.column(4)), _counts(b.column(5)), b.column(2).to_numpy(), b.column(3).to_numpy())
        yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(may))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sets are alike, by exact counts."""
    side = lambda k: nodes.select(F.col("s").alias(k), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ca", "cb")
    pairs = materialize(both.mapInArrow(_may_be_alike, "a long, b long"), "shingle-pairs")
    named = pairs.select(F.col("a").alias("s")).unionAll(pairs.select(F.col("b").alias("s"))).distinct()
    named = nodes.select("s", "th").join(named, "s", "left_semi")
    sets = texts.join(named, "th").dropDuplicates(["s"]).select("s", "t").mapInArrow(_sets, "s long, h array<long>")
    sets = materialize(sets, "shingle-sets")
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("s").alias("b"), F.col("h").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb")).cast("long")
    # shared / (all - shared) >= p / q
    both = both.where(sum(ALIKE) * shared >= ALIKE[0] * (F.size("ha") + F.size("hb")).cast("long")).select("a", "b")
    links = materialize(both, "shingle-links")
    drop_materialized(sets)
    return links


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that tie together what fingerprints within the trie join's budget do, of sizes that can be alike."""
    own = materialize(nodes.where("n > 0").groupBy("fp").agg(F.min(F.struct("s", "n")).alias("lead")), "shingle-prints")
    lead = own.select("fp", F.col("lead.s").alias("b"), F.col("lead.n").alias("nb"))
    same = nodes.where("n > 0").select("fp", F.col("s").alias("a"), F.col("n").alias("na")).join(lead, "fp").where("a <> b")
    near = near_links(own.select("fp"), own.count()).join(lead.select(F.col("fp").alias("a_fp"), F.col("b").alias("s"), F.col("nb").alias("na")), F.col("a") == F.col("a_fp"))
    near = near.select("s", "na", F.col("b").alias("b_fp")).join(lead.withColumnRenamed("fp", "b_fp"), "b_fp").select(F.col("s").alias("a"), "b", "na", "nb")
    pairs = same.select("a", "b", "na", "nb").unionAll(near).where(ALIKE[1] * F.least("na", "nb") >= ALIKE[0] * F.greatest("na", "nb"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, component) for each row of docs: alike texts are linked, components take all that is reachable.

    Texts without words are alike. Null texts are empty, repeated rows are alike, ids may be null, texts may be of any length. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    marked = materialize(texts.mapInArrow(_measured(*_common(texts)), "id long, th long, s long, n long, files array<long>, counts binary, fp long"), "shingle-marked")
    nodes = materialize(marked.dropDuplicates(["s"]).select("s", "th", "n", "files", "counts", "fp"), "shingle-nodes")
    found = materialize(connected_components(_verified(_simhash_pairs(nodes), nodes, texts)), "shingle-components")

    def filed() -> DataFrame:
        own = nodes.join(found.withColumnRenamed("node", "s"), "s", "left")
        return own.select(F.explode("files").alias("x"), "s", "n", F.coalesce("component", "s").alias("c"))

    # one order of the texts under every x: those that share many shingles meet the same others under each, not new ones
    by_x = filed().repartition("x").sortWithinPartitions("x", F.xxhash64("s")).select("x", "s", "n", "c")
    met = materialize(by_x.mapInArrow(_window_pairs(window), _PAIRS).distinct(), "shingle-met")
    tried = met.where("pair").select("a", "b")
    found = materialize(grown(found, _verified(tried, nodes, texts)), "shingle-components")
    full = met.where(~F.col("pair")).select(F.col("a").alias("x"))
    # written first: a repartition right after a join by the same key would be optimized away, and adaptive execution may
    # then turn the join into a local read that scatters the rows of one x
    rest = filed().join(full, "x", "left_semi").join(nodes.select("s", "counts"), "s").select("x", "s", "n", "c", "counts")
    rest = materialize(rest, "shingle-rest")
    more = rest.repartition("x").sortWithinPartitions("x").mapInArrow(_all_pairs, _PAIRS).select("a", "b").distinct()
    more = materialize(more.join(tried, ["a", "b"], "left_anti"), "shingle-more")
    if not more.isEmpty():
        found = materialize(grown(found, _verified(more, nodes, texts)), "shingle-components")
    return marked.select("id", "th", "s").join(found.withColumnRenamed("node", "s"), "s", "left").select("id", "th", F.coalesce("component", "s").alias("component"))


def keep_one_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of alike texts: the smallest id (rows without an id come last; ties by text hash)."""
    last = F.lit(2**63 - 1)
    groups = materialize(similar_groups(docs, id_col, text_col), "shingle-groups")
    lead = groups.groupBy("component").agg(F.min(F.struct(F.coalesce("id", last).alias("i"), F.col("th").alias("h"))).alias("lead")).select(F.col("lead.i").alias("_sh_i"), F.col("lead.h").alias("_sh_h"))
    key = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(id_col).cast("long"), last).alias("_sh_i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_sh_h"))
    return key.join(lead, ["_sh_i", "_sh_h"], "left_semi").dropDuplicates(["_sh_i", "_sh_h"]).select(docs.columns)
