"""Periodic runs of words: Lyndon arrays in both orders, with the extensions that decide them matched once and reused.

The longest Lyndon word at place i ends where the next smaller suffix begins. Places go from the first to the last; each is
compared with the suffixes before it that have found no smaller one yet, from the nearest on. What two suffixes share follows from
what either shares with a third wherever those lengths differ; where they lie in a stretch that was matched with an earlier one, it
is what their images share, as far as the match reaches; only what lies beyond the farthest match is compared word by word. Every
run has a root that is the longest Lyndon word at its place in one of the two orders; how far the run goes on to the right is the
extension that decided the place, and to the left its first root lies less than a period from its start. Only the order of words is
asked for: no suffix array, no fingerprints.

Runs of few repeats or none are not asked for, so the arrays are built only over stretches that can hold a wanted run: where a
word's last occurrence is no farther away than a bound, for long enough a stretch. That loses no run (`stretches`).
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

#: A run repeats its period this often at least and has this many words.
EXPONENT, LENGTH = 4, 6
_FAR = np.int64(1) << 40


def lyndon(t: list[int]) -> tuple[list[int], list[int], int]:
    """For each place the length of the longest Lyndon word that begins there, and how far its suffix goes with the one behind
    that word; the third value counts the pairs of numbers compared, which stays within a small multiple of the length."""
    n = len(t)
    t = [*t, min(t, default=0) - 1]  # the end is smaller than any number
    #: By place: the last smaller suffix before and the next smaller one behind, and what the place's suffix shares with either.
    before, after, with_before, with_after = [-1] * (n + 1), [n] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    # the match that reaches farthest: suffixes `left` and `right` share all up to the place `reach`
    left, right, reach, compared = 0, 0, 0, 0
    for i in range(1, n + 1):
        p, q, k = i - 1, -1, 0
        while p >= 0:
            # suffix i is smaller than suffix q, whose last smaller one is p: lengths that differ decide without a look
            if q >= 0 and k != with_before[q]:
                if k > with_before[q]:
                    k = with_before[q]
                    break
            else:
                if p >= right and i < reach:  # both lie in what was matched: the pair as far back was compared before
                    d = right - left
                    back = with_after[p - d] if after[p - d] == i - d else with_before[i - d] if before[i - d] == p - d else 0
                    k = max(k, min(back, reach - i))
                begun = k
                while t[p + k] == t[i + k]:
                    k += 1
                compared += k - begun + 1
                if i + k > reach:
                    left, right, reach = p, i, i + k
                if t[p + k] < t[i + k]:
                    break
            after[p], with_after[p] = i, k
            p, q = before[p], p
        before[i], with_before[i] = p, k
    return [after[i] - i for i in range(n)], with_after[:n], compared


def runs(t: list[int], exponent: int = 2) -> list[tuple[int, int, int]]:
    """All (start, length, period) of maximal runs of t with length >= exponent * period, by start and period."""
    found = set()
    for order in (t, [-x for x in t]):
        words, ext, _ = lyndon(order)
        q, right = np.array(words, np.int64), np.array(ext, np.int64)
        upto: dict[int, int] = {}
        # a run's first root begins less than a period behind its start, so this much of it lies to the right
        for i in np.flatnonzero(right >= (exponent - 2) * q).tolist():
            d = words[i]
            end = i + d + ext[i]
            if upto.get(d) == end:  # another root of the run before
                continue
            upto[d] = end
            s = i
            while s and t[s - 1] == t[s - 1 + d]:
                s -= 1
            if end - s >= exponent * d:
                found.add((s, end - s, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, starts: np.ndarray, exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int]]:
    """Disjoint [from, to) of codes outside which no run of that exponent and length lies. `starts`: where each document begins, in order.

    In a run of period q every word but the first q stands q behind its like, so for (exponent - 1) * q words on end the last
    occurrence of a word is no farther than q. Periods are tried by powers of two.
    """
    n = len(codes)
    if not n:
        return []
    doc = np.zeros(n, np.int64)
    np.add.at(doc, starts[(starts > 0) & (starts < n)], 1)
    doc = np.cumsum(doc)
    order = np.argsort(doc * (int(codes.max()) + 1) + codes, kind="stable")
    gap = np.full(n, _FAR)
    same = (codes[order[1:]] == codes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    first = starts[np.searchsorted(starts, np.arange(n), side="right") - 1] if n else starts
    edges = np.zeros(n + 1, np.int64)
    longest = int(np.diff(np.append(starts, n)).max())
    top = 1
    while True:
        near = np.flatnonzero(np.diff(np.concatenate(([0], (gap <= top).view(np.int8), [0]))))
        a, b = near[::2], near[1::2]
        keep = b - a >= max(length - top, (exponent - 1) * (top // 2 + 1))
        a, b = a[keep], b[keep]
        np.add.at(edges, np.maximum(a - top, first[np.minimum(a, n - 1)]), 1)
        np.add.at(edges, b, -1)
        if exponent * top >= longest:
            break
        top *= 2
    held = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(edges[:n]) > 0).view(np.int8), [0]))))
    # stretches of two documents may touch: they end where a document does
    out = []
    for a, b in zip(held[::2].tolist(), held[1::2].tolist()):
        cuts = starts[np.searchsorted(starts, a, side="right") : np.searchsorted(starts, b, side="left")]
        points = [a, *sorted(set(cuts.tolist())), b]
        out += [(x, y) for x, y in zip(points, points[1:]) if y > x]
    return out


def planted(codes: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Of every tenth document by crc of its id, the words from some place on made periodic; other documents, and those without an id, as they are."""
    n = len(codes)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return codes
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((codes[:a], np.resize(codes[a : a + p], n - a)))


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of all texts as ranks in the order of their bytes, where each text's words begin (and the end), and the words by rank."""
    lists = pc.ascii_split_whitespace(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    flat, parent = flat.filter(some), parent.filter(some)
    coded = flat.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    starts = np.concatenate(([0], np.cumsum(np.bincount(parent.to_numpy(), minlength=len(texts)))))
    return rank[coded.indices.to_numpy()], starts, coded.dictionary.take(order)


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _run_batches(exponent: int, length: int, plant: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            codes, starts, words = numbered(batch.column(1))
            if plant:
                codes = np.concatenate([planted(codes[a:b], d) for d, a, b in zip(ids, starts, starts[1:])] or [codes])
            found: list[list] = [[] for _ in ids]
            kept = np.ones(len(codes), bool)
            for a, b in stretches(codes, starts[:-1], exponent, length):
                doc = int(np.searchsorted(starts, a, side="right")) - 1
                for s, size, q in runs(codes[a:b].tolist(), exponent):
                    if size >= length:
                        found[doc].append((a + s - int(starts[doc]), size, q))
                        kept[a + s + q : a + s + size] = False
            left = np.concatenate(([0], np.cumsum(kept)))[starts]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(codes[kept]))), " ")
            rows = []
            for d, own, text in zip(ids, found, texts):
                own.sort(key=lambda r: (r[0], r[2]))
                best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if own else (None, None, None)
                told = hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in own).encode()).hexdigest()
                milli = 1000 * best[1] // best[2] if own else None
                rows.append((d, len(own), *best, milli, told, hashlib.sha256(text.as_buffer()).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=_NAMES)

    return run


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, length: int = LENGTH, plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for every row of docs.

    Null text has no words: no runs, four nulls, digests of nothing. Null ids stay null; repeated rows each get their row. A text of any
    length is taken whole, in one task, as numbers of words. Of runs with the same exponent the first is told, then that of the smaller
    period. Other columns are not used, whatever their names. An empty table gives an empty result. `plant`: see planted().
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_run_batches(exponent, length, plant), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op12_lyndon_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
