"""Packing token sequences by cutting-stock column generation.

Documents longer than a sequence are cut into whole sequences. What is left stays whole below WHOLE tokens; otherwise its
last tokens beyond a multiple of GRID are cut off, so that the pieces have few different lengths, all of which combine
without a gap. Only the histogram of those lengths (under WHOLE + SEQUENCE / GRID numbers) comes to the driver. A linear program over patterns of lengths
is solved by column generation: an unbounded-knapsack dynamic program over the lengths' dual prices finds the next pattern.
Rounded patterns become sequences; documents, ranked within their length, take the patterns' places by rank.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table
from .tokens import load, tokenizer_path, with_end

SEQUENCE, GRID, WHOLE = 1024, 32, 64
#: The linear program ends once it is within this share of the bound that no packing can beat (tokens / SEQUENCE).
GAP = 2e-4


def cost(total: int, size: int = SEQUENCE) -> float:
    """Padded length of a sequence of `total` tokens, in sequences: a power of two needs no padding."""
    return total / size if total & (total - 1) == 0 else 1.0


def best_patterns(lengths: np.ndarray, price: np.ndarray, size: int) -> list[tuple[float, list[int]]]:
    """(reduced cost, positions in lengths) of the best patterns that fill up to `size` or exactly a power of two."""
    value = np.full(size + 1, -np.inf)
    value[0] = 0.0
    last = np.full(size + 1, -1)
    count = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        m = count[c]
        if m:
            v = value[c - lengths[:m]] + price[:m]
            k = int(v.argmax())
            if v[k] > value[c]:
                value[c], last[c] = v[k], k
    out = []
    for c in {int(value.argmax()), size, *(1 << k for k in range(size.bit_length() - 1))}:
        gain = cost(c, size) - value[c]
        if gain < -1e-9:
            items, at = [], c
            while at:
                items.append(int(last[at]))
                at -= int(lengths[last[at]])
            out.append((gain, items))
    return sorted(out)


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int = SEQUENCE, gap: float = GAP, rounds: int = 6000) -> list[tuple[list[int], float]]:
    """Patterns (positions in lengths) and how often each is used in the linear program's solution."""
    m = len(lengths)
    patterns = [[k] * max(1, size // int(lengths[k])) for k in range(m)]
    inverse = np.diag([1.0 / len(p) for p in patterns])
    costs = np.array([cost(int(lengths[p].sum()), size) for p in patterns])
    amount = inverse @ demand
    bound = float(lengths @ demand) / size
    for _ in range(rounds):
        if costs @ amount <= bound * (1 + gap):
            break
        price = costs @ inverse
        entering = best_patterns(lengths, price, size)
        if not entering:
            break
        moved = False
        for _, items in entering:
            column = np.bincount(items, minlength=m).astype(float)
            c = cost(int(lengths[items].sum()), size)
            if c - costs @ (inverse @ column) > -1e-9:
                continue
            step = inverse @ column
            up = step > 1e-9
            ratio = np.where(up, amount / np.where(up, step, 1.0), np.inf)
            out = int(ratio.argmin())
            theta = ratio[out]
            amount = np.maximum(amount - theta * step, 0.0)
            amount[out] = theta
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            patterns[out], costs[out], moved = items, c, True
        if not moved:
            break
    return [(patterns[k], float(amount[k])) for k in range(m) if amount[k] > 1e-9]


def whole_patterns(lengths: np.ndarray, demand: np.ndarray, solved: list[tuple[list[int], float]], size: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Rounds the program's solution to whole sequences that use every piece once: down, then up where the demand allows, then best fit."""
    left, used = demand.copy(), Counter()
    for items, amount in solved:
        times = int(amount + 1e-6)
        need = Counter(items)
        times = min([times, *(int(left[k]) // n for k, n in need.items())])
        if times:
            used[tuple(sorted(items))] += times
            for k, n in need.items():
                left[k] -= n * times
    for items, amount in sorted(solved, key=lambda x: (-(x[1] % 1), x[0])):
        need = Counter(items)
        if all(left[k] >= n for k, n in need.items()) and cost(int(lengths[items].sum()), size) * size <= int(lengths[items].sum()):
            used[tuple(sorted(items))] += 1
            for k, n in need.items():
                left[k] -= n
    rest = [k for k in range(len(lengths) - 1, -1, -1) for _ in range(int(left[k]))]
    by_room: dict[int, list[list[int]]] = {}
    rooms = np.zeros(size + 1, dtype=bool)
    for k in rest:  # longest first, into the sequence with the least room that suffices
        n = int(lengths[k])
        fits = np.flatnonzero(rooms[n:])
        room = n + int(fits[0]) if len(fits) else size
        items = by_room[room].pop() if len(fits) else []
        if len(fits) and not by_room[room]:
            rooms[room] = False
        items.append(k)
        by_room.setdefault(room - n, []).append(items)
        rooms[room - n] = room - n > 0
    used.update(Counter(tuple(sorted(x)) for xs in by_room.values() for x in xs))
    return [(list(p), n) for p, n in sorted(used.items())]


def places(lengths: np.ndarray, chosen: list[tuple[list[int], int]]) -> tuple[dict[str, np.ndarray], int]:
    """For each length and rank interval: the sequences and offset its pieces take. Also the number of sequences."""
    rows, sequence, taken = [], 0, Counter()
    for items, times in chosen:
        offset = 0
        for k in sorted(items, reverse=True):
            n = int(lengths[k])
            rows.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), cols.T)), sequence


def cuts(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    out = [(at, size) for at in range(0, n - size + 1, size)]
    at, left = n - n % size, n % size
    if left >= WHOLE and left % GRID:
        out.append((at, left - left % GRID))
        at, left = n - left % GRID, left % GRID
    return [*out, (at, left)] if left else out


def _piece_batches(path: str, size: int):
    def run(batches):
        part, full_no, tok = TaskContext.get().partitionId(), 0, load(path)
        for b in batches:
            out = {k: [] for k in ("row", "start", "length", "crc", "doc_tokens", "no")}
            for row, got in enumerate(tok.encode_batch(b.column(1).to_pylist())):
                ids = with_end(got)
                raw, n = memoryview(ids.astype("<u4").tobytes()), len(ids)
                for at, length in cuts(n, size):
                    out["row"].append(row)
                    out["start"].append(at)
                    out["length"].append(length)
                    out["crc"].append(zlib.crc32(raw[4 * at : 4 * (at + length)]))
                    out["doc_tokens"].append(n)
                    out["no"].append(full_no if length == size else None)
                    full_no += length == size
            take = pa.array(out.pop("row"), pa.int64())
            cols = {k: pa.array(v, pa.int64()) for k, v in out.items()}
            yield pa.record_batch([b.column(0).take(take), b.column(2).take(take), *cols.values(), pa.array(np.full(len(take), part, np.int32))], names=["doc_id", "th", *cols, "part"])

    return run


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece; each token id lies in one piece.

    Null and empty texts are one piece, the end id. Repeated rows are packed each for itself; ids may be null. An empty table gives no piece.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    schema = "doc_id long, th long, start long, length long, crc long, doc_tokens long, no long, part int"
    pieces = materialize(cut.mapInArrow(_piece_batches(path or tokenizer_path(), size), schema), "pack-pieces")

    some = pieces.where(F.col("length") < size)
    counted = some.groupBy("length").count().orderBy("length").collect()  # under WHOLE + size / GRID rows
    lengths, demand = np.array([r[0] for r in counted], dtype=np.int64), np.array([r[1] for r in counted], dtype=np.float64)
    chosen = whole_patterns(lengths, demand, column_generation(lengths, demand, size), size) if len(lengths) else []
    at, sequences = places(lengths, chosen)

    total = int(demand.sum())
    salts = max(64, total // 1_000_000)
    salted = some.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "th", "start")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))

    def place(batches):
        key = at["length"] * (1 << 50) + at["rank"]
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(key, n * (1 << 50) + rank, side="right") - 1
            put = {"sequence_id": at["sequence"][k] + rank - at["rank"][k], "offset": at["offset"][k]}
            yield pa.record_batch([*b.columns[:-1], *map(pa.array, put.values())], names=[*b.schema.names[:-1], *put])

    columns = ["doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens"]
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    partial = ranked.select(*columns, F.col("rank").cast("long").alias("rank")).mapInArrow(place, out)

    full = pieces.where(F.col("length") == size)
    base, rows = sequences, []
    for part, n in full.groupBy("part").count().orderBy("part").collect():  # a row for each partition of the scan
        rows.append((part, base))
        base += n
    starts = spark.createDataFrame(rows, "part int, base long")
    whole = full.join(starts, "part").select(*columns, (F.col("base") + F.col("no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return partial.unionAll(whole)


def op9_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
