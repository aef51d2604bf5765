"""Exact removal of long repeated byte strings, by bucket-pointer refinement over sampled suffixes.

A suffix's bucket is the identifier of its first q bytes (q = width / 4). Identifiers of 2q and 4q bytes come from
the identifier at the suffix and the one at the later offset, the refined values being used again for the next step,
so a `width`-byte bucket costs as many refinements as the length has halvings and bytes are never compared again.

Refining every suffix of the corpus would move many times its size. Each `width`-byte window therefore files under the
smallest q-gram bucket it holds (leftmost on ties), which equal windows share; neighbouring windows mostly share
it too and travel as one run. Round by round only buckets with more than one member go on:

1. runs meet by q-gram bucket; buckets of one run are unique suffixes and end here;
2. buckets are refined by the identifiers at both ends of the run; runs that agree there agree in every window;
3. only runs that still differ within a shared bucket (mostly the two ends of a passage) are cut into cells of a few
   windows, aligned to the q-gram, which meet by the identifier of the string that all windows of the cell hold;
4. only cells that still differ within a shared bucket open into single windows.

Identifiers are 64-bit hashes compared within a q-gram bucket that is itself 64 bits, in every round: windows that meet by chance
would have to share a q-gram and then a 64-bit identifier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import drop_materialized, materialize, prepare, release, table

WIDTH = 200
#: Bytes handled as one numpy array; longer texts get an array of their own, ranked in parts whose positions fit PLACE_BITS.
CHUNK, PLACE_BITS = 64_000, 20
#: Windows opened before their rows go on.
OPEN_WINDOWS = 500_000

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LETTERS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = b * _K2
    out ^= out >> np.uint64(31)
    out += a
    out *= _K1
    out ^= out >> np.uint64(29)
    return out


def identifiers(x: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, the bucket identifier of the string of that length at every place of the byte array x."""
    known = {1: _LETTERS[x]}
    for n in lengths:
        _refine(known, n, len(x))
    return [known[n] for n in lengths]


def _refine(known: dict[int, np.ndarray], n: int, size: int) -> None:
    """Adds the identifiers of length n from those of two shorter lengths, the second at the later offset."""
    if n in known:
        return
    half = n // 2 if n % 2 == 0 else n - 1
    _refine(known, half, size)
    _refine(known, n - half, size)
    count = max(0, size - n + 1)
    known[n] = _mix(known[half][:count], known[n - half][half : half + count])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have < w:
        step = min(have, w - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    return v


def windows_of(x: np.ndarray, width: int) -> dict[str, np.ndarray] | None:
    """For every window: the place of its smallest q-gram (at); and the identifiers of q-grams, half windows and windows."""
    q = max(1, width // 4)
    if len(x) < width:
        return None
    grams, half, whole = identifiers(x, (q, width // 2, width))
    low, n, parts = np.uint64((1 << PLACE_BITS) - 1), len(x) - width + 1, []
    step = (1 << PLACE_BITS) - width
    for a in range(0, n, step):  # the same bits rank q-grams in texts of any length
        part = grams[a : a + step + width - q]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        parts.append((_sliding_min(key, width - q + 1) & low).astype(np.int64) + a)
    at = np.concatenate(parts)
    return {"at": at, "grams": grams, "half": half, "whole": whole}


def _texts(batch_text: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in batch_text.cast(pa.binary()).to_pylist()]


def _chunks(texts: list[bytes], wanted) -> list[list[int]]:
    """Row numbers in groups of up to CHUNK bytes."""
    out, size = [], 0
    for i in wanted:
        n = len(texts[i])
        if not out or size + n > CHUNK:
            out.append([])
            size = 0
        out[-1].append(i)
        size += n
    return out


class _Runs:
    """Runs of neighbouring windows with one smallest q-gram, in several texts laid end to end; windows over two texts are left out."""

    def __init__(self, texts: list[bytes], rows: list[int], width: int):
        self.width, self.rows = width, np.asarray(rows)
        x = np.frombuffer(b"".join(texts[i] for i in rows), dtype=np.uint8)
        w = windows_of(x, width)
        self.grams, self.half, self.whole, at = w["grams"], w["half"], w["whole"], w["at"]
        sizes = np.array([len(texts[i]) for i in rows], dtype=np.int64)
        ends, n = np.cumsum(sizes), len(at)
        begins = ends - sizes
        owner = np.searchsorted(ends, np.arange(n), side="right")
        inside = np.arange(n) + width <= ends[owner]
        change = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]))
        lo = np.flatnonzero(change)
        hi = np.append(lo[1:], n) - 1
        ok = inside[lo]
        self.lo, self.hi = lo[ok], hi[ok]
        self.owner, self.p = owner[self.lo], at[self.lo]
        self.begin = begins[self.owner]

    def refined(self, lo, hi, p):
        return _mix(_mix(self.whole[lo], self.whole[hi]), ((hi - lo) * 1024 + (p - lo)).astype(np.uint64))

    def find(self, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Numbers of the runs that hold these windows."""
        big = np.int64(1) << np.int64(40)
        return np.searchsorted(self.owner * big + self.lo - self.begin, owner * big + start, side="right") - 1


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of n members: each member's group and its number within it."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _runs_batches(width: int):
    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(2))
            for rows in _chunks(texts, [i for i, t in enumerate(texts) if len(t) >= width]):
                r = _Runs(texts, rows, width)
                take = pa.array(r.rows[r.owner])
                yield _packed(r.grams[r.p], r.refined(r.lo, r.hi, r.p), batch, take, ((r.lo - r.begin) << 16) | (r.hi - r.lo), np.ones(len(take), np.int32))

    return run


def _packed(bucket, refined, batch, take, run, weight):
    cols = [pa.array(bucket.view(np.int64)), pa.array(refined.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(run), pa.array(weight.astype(np.int32))]
    return pa.record_batch(cols, names=["bucket", "refined", "id", "th", "run", "weight"])


def _asked(batch, width: int):
    """Chunk by chunk: the runs, and of each listed run or cell its text's number in the chunk, first and last window, and 2 if others like it are known, else 1."""
    texts, need = _texts(batch.column(2)), batch.column(3).to_pylist()
    for rows in _chunks(texts, [i for i, x in enumerate(need) if x]):
        r = _Runs(texts, rows, width)
        owner = np.repeat(np.arange(len(rows)), [len(need[i]) for i in rows])
        asked = np.array([v for i in rows for v in need[i]], dtype=np.int64)
        start, more = asked >> 17, (asked >> 1) & 0xFFFF
        k = r.find(owner, start)
        first = start + r.begin[k]
        yield r, k, first, first + more, (asked & 1) + 1


def _cell_batches(width: int):
    """Cuts the listed runs into cells: windows whose distance to the q-gram has one quotient by the cell's size."""
    size = max(1, min(16, width // 4))
    core = width - size + 1

    def run(batches):
        for batch in batches:
            for r, k, lo, hi, weight in _asked(batch, width):
                p = r.p[k]
                low = (p - hi) // size
                each, step = _spread((p - lo) // size - low + 1)
                p, lo, hi, cell, weight, owner, begin = p[each], lo[each], hi[each], low[each] + step, weight[each], r.owner[k][each], r.begin[k][each]
                a, b = np.maximum(lo, p - cell * size - size + 1), np.minimum(hi, p - cell * size)
                c = p - cell * size
                bucket = _mix(_mix(r.half[c], r.half[c + core - width // 2]), r.grams[p] + cell.astype(np.uint64))
                yield _packed(bucket, r.refined(a, b, p), batch, pa.array(r.rows[owner]), ((a - begin) << 16) | (b - a), weight)

    return run


def settled_rows(batch, parts) -> pa.RecordBatch:
    """Opened windows of a batch as rows; those met twice among them are settled here."""
    wid, gram, row, start, weight = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((gram, wid))
    wid, gram, row, start, weight = wid[order], gram[order], row[order], start[order], weight[order]
    new = np.append(True, (wid[1:] != wid[:-1]) | (gram[1:] != gram[:-1]))
    total = np.bincount(np.cumsum(new) - 1, weights=weight)[np.cumsum(new) - 1]
    # one row for each identifier goes on to meet those of other batches; the rest are settled or known
    alone, lead, settled = total < 2, new & (total >= 2), (total >= 2) & (weight == 1)
    out = np.concatenate([wid[alone], wid[lead], _mix(wid[settled], (row[settled] * 7919 + start[settled]).astype(np.uint64))])
    grams = np.concatenate([gram[alone], gram[lead], gram[settled]])
    kind = np.repeat(np.array([1, 2, 3], np.int32), [alone.sum(), lead.sum(), settled.sum()])
    take = pa.array(np.concatenate([row[alone], row[lead], row[settled]]))
    first = np.concatenate([start[alone], start[lead], start[settled]])
    return pa.record_batch([pa.array(grams.view(np.int64)), pa.array(out.view(np.int64)), pa.array(kind), batch.column(0).take(take), batch.column(1).take(take), pa.array(first)], names=["bucket", "wid", "weight", "id", "th", "start"])


def _open_batches(width: int):
    """Opens the listed cells into windows."""

    def run(batches):
        for batch in batches:
            parts, many = [], 0
            for r, k, lo, hi, weight in _asked(batch, width):
                each, step = _spread(hi - lo + 1)
                s, p = lo[each] + step, r.p[k][each]
                wid = _mix(_mix(r.whole[s], r.grams[p]), (p - s).astype(np.uint64))
                parts.append((wid, r.grams[p], r.rows[r.owner[k]][each], s - r.begin[k][each], weight[each]))
                many += len(s)
                if many >= OPEN_WINDOWS:
                    yield settled_rows(batch, parts)
                    parts, many = [], 0
            if parts:
                yield settled_rows(batch, parts)

    return run


_ROWS = "bucket long, refined long, id long, th long, run long, weight int"


def _meet(rows: DataFrame, name: str) -> DataFrame:
    """One round of refinement over materialized rows (which it drops): (id, th, run, same, open).

    same: another run of the bucket has the same refined identifier. open: the bucket holds different ones, and this run
    is to stand for its own in the next round. Members of neither kind are unique and end here.
    """
    shared = rows.groupBy("bucket").agg(F.sum("weight").alias("_n"), F.min("refined").alias("_a"), F.max("refined").alias("_b")).where("_n > 1")
    # written first, so that both sides of the join are plain exchanges and adaptive execution can split a hot bucket
    shared = materialize(shared.select("bucket", (F.col("_a") != F.col("_b")).alias("differ")), f"{name}-shared")
    members = materialize(rows.join(shared, "bucket"), f"{name}-members")
    drop_materialized(rows)
    drop_materialized(shared)
    lead = F.struct("id", "th", "run")
    refined = members.groupBy("bucket", "refined").agg(F.sum("weight").alias("_n"), F.min(lead).alias("lead"))
    refined = materialize(refined, f"{name}-refined")
    known = members.join(refined, ["bucket", "refined"]).select("id", "th", "run", (F.col("_n") > 1).alias("same"), (F.col("differ") & (lead == F.col("lead"))).alias("open"))
    known = materialize(known.where("same or open"), f"{name}-known")
    drop_materialized(members)
    drop_materialized(refined)
    return known


def removed_ranges(n: int, runs, starts, width: int) -> list[tuple[int, int]]:
    """Maximal removed [from, to) ranges of a text of n bytes, from whole runs and single windows."""
    lo = np.concatenate([np.array(runs, dtype=np.int64) >> 16, np.array(starts, dtype=np.int64)])
    if not len(lo):
        return []
    end = np.concatenate([(np.array(runs, dtype=np.int64) >> 16) + (np.array(runs, dtype=np.int64) & 0xFFFF), np.array(starts, dtype=np.int64)]) + width
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, lo, 1)
    np.add.at(depth, end, -1)
    covered = np.cumsum(depth[:n]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _apply_batches(width: int, as_text: bool):
    def run(batches):
        for batch in batches:
            texts = _texts(batch.column("_text"))
            out = {k: [] for k in ("_kept", "_from", "_to", "_n")}
            for t, runs, starts in zip(texts, batch.column("_runs").to_pylist(), batch.column("_starts").to_pylist()):
                spans = removed_ranges(len(t), runs or [], starts or [], width)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(t[at:a])
                    at = b
                out["_kept"].append(b"".join([*kept, t[at:]]) if spans else t)
                out["_from"].append([a for a, _ in spans])
                out["_to"].append([b for _, b in spans])
                out["_n"].append(len(t))
            names = [n for n in batch.schema.names if n not in ("_text", "_runs", "_starts")]
            cols = [batch.column(n) for n in names]
            kept = [k.decode("utf-8", "ignore") for k in out["_kept"]] if as_text else out["_kept"]
            cols += [pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(out["_from"], pa.list_(pa.int64())), pa.array(out["_to"], pa.list_(pa.int64())), pa.array(out["_n"], pa.int64())]
            yield pa.record_batch(cols, names=[*names, "kept", "removed_from", "removed_to", "n_bytes"])

    return run


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, as_text: bool = False) -> DataFrame:
    """Removes every byte covered by a `width`-byte string that also starts anywhere else in the column.

    Returns docs' columns (but the text) and kept (the remaining bytes; with as_text a string, without characters that a cut
    went through), removed_from and removed_to (arrays: maximal removed byte ranges), n_bytes. Null text is empty; repeated rows are documents of their own, so their long strings all go; ids may
    be null or repeat; texts may be of any length; an empty table stays empty. Columns of docs that clash with the four new ones are replaced.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("kept", "removed_from", "removed_to", "n_bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_sa_id"), F.xxhash64(text).alias("_sa_th"), text.alias("_text")]

    def reopened(known: DataFrame) -> DataFrame:
        ask = F.shiftleft("run", 1).bitwiseOR(F.col("same").cast("long"))
        need = known.where("open").groupBy(F.col("id").alias("_sa_id"), F.col("th").alias("_sa_th")).agg(F.collect_set(ask).alias("_need"))
        return docs.select(*key).join(need, ["_sa_id", "_sa_th"]).select("_sa_id", "_sa_th", "_text", "_need")

    runs = _meet(materialize(docs.select(*key).mapInArrow(_runs_batches(width), _ROWS), "sa-runs"), "sa-runs")
    cells = _meet(materialize(reopened(runs).mapInArrow(_cell_batches(width), _ROWS), "sa-cells"), "sa-cells")
    windows = materialize(reopened(cells).mapInArrow(_open_batches(width), "bucket long, wid long, weight int, id long, th long, start long"), "sa-windows")
    release(spark)
    met = windows.where("weight < 3").groupBy("bucket", "wid").agg(F.sum("weight").alias("_t")).where("_t > 1").select("bucket", "wid")
    met = materialize(met, "sa-met")
    hits = windows.where("weight = 1").join(met, ["bucket", "wid"]).select("id", "th", "start").unionAll(windows.where("weight = 3").select("id", "th", "start"))

    nothing = F.lit(None).cast("long")
    whole = runs.where("same").unionAll(cells.where("same"))
    marks = whole.select("id", "th", "run", nothing.alias("start")).unionAll(hits.select("id", "th", nothing.alias("run"), "start"))
    marks = marks.groupBy(F.col("id").alias("_sa_id"), F.col("th").alias("_sa_th")).agg(F.collect_set("run").alias("_runs"), F.collect_set("start").alias("_starts"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    joined = docs.select(*key, *rest).join(marks, ["_sa_id", "_sa_th"], "left")
    schema = StructType([f for f in docs.schema if f.name != text_col])
    schema = schema.add("kept", "string" if as_text else "binary").add("removed_from", ArrayType(LongType())).add("removed_to", ArrayType(LongType())).add("n_bytes", LongType())
    return joined.select("_text", "_runs", "_starts", *rest).mapInArrow(_apply_batches(width, as_text), schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed_from").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
