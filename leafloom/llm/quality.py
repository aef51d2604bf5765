"""Quality score by a generalised additive model with pairwise interactions.

Shallow trees over one binned feature at a time are boosted in cycles; each feature's trees add up to one lookup table.
Then the pairs of features that explain most of what is left get tables of their own in the same way. A score is a sum of
table entries. The model is fitted on at most SAMPLE labelled rows in hash order; scoring covers every row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare, table

SAMPLE, BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 20_000, 32, 8, 80, 40, 6, 0.15, 1.0
THRESHOLD = 0.7

FEATURES = (
    "words", "word_length", "upper", "digits", "marks", "punctuation", "symbols", "space", "high_bytes", "distinct_words",
    "same_as_before", "top_word", "distinct_lines", "line_length", "short_words", "long_words", "packed_size", "same_in_50", "sentence_length",
)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS, _PUNCT, _SYMBOL, _HIGH = b"!?", b".,;:", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256))


def _packed(text: bytes, block: int = 1 << 20) -> int:
    """Compressed size of a whole text, block by block."""
    packer, view = zlib.compressobj(1), memoryview(text)
    return sum(len(packer.compress(view[at : at + block])) for at in range(0, len(view), block)) + len(packer.flush())


def features(text: bytes) -> list[float]:
    """Numbers that tell running prose from noise, of a whole text (empty texts have defined ones too)."""
    n = max(1, len(text))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    words = text.split()
    m = max(1, len(words))
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    recent = [len(set(words[k : k + 50])) / len(words[k : k + 50]) for k in range(0, len(words), 50)] or [1.0]
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    return [
        float(np.log1p(len(words))), float(lengths.mean()), share(_UPPER), share(_DIGIT), share(_MARKS), share(_PUNCT), share(_SYMBOL),
        share(b" \t\r\n\v\f"), share(_HIGH), len(count) / m**0.8, sum(a == b for a, b in zip(words, words[1:])) / m,
        max(count.values(), default=0) / m, len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        float((lengths <= 3).mean()), float((lengths > 15).mean()), _packed(text) / n,
        float(np.mean(recent)), float(np.log1p(len(words) / max(1, stops))),
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([features(t or b"") for t in column.cast(pa.binary()).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Additive:
    """Tables by feature and by pair of features; sums of their entries are log odds."""

    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        out = np.full(len(x), self.start)
        for b, t in zip(bins, self.tables):
            out += t[b]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of splitting bins in two, and the first bin of the upper part."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE)
    if not len(gain):
        return 0.0, 1
    k = int(gain.argmax())
    return float(gain[k] - g.sum() ** 2 / (h.sum() + RIDGE)), k + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * float(g.sum()) / (float(h.sum()) + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over one feature's bins, as a table."""
    out = np.zeros(len(g))
    _, c = _cut(g, h)
    for a, b in ((0, c), (c, len(g))):
        _, d = _cut(g[a:b], h[a:b])
        for lo, hi in ((a, min(a + d, b)), (min(a + d, b), b)):
            out[lo:hi] = _leaf(g[lo:hi], h[lo:hi])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of depth two over two features' bins: the better of cutting one first and then the other in each part."""
    best = (-1.0, np.zeros(g.shape))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for c in range(1, a.shape[0]):
            gain, out = 0.0, np.zeros(a.shape)
            for lo, hi in ((0, c), (c, a.shape[0])):
                ga, ha = a[lo:hi].sum(axis=0), b[lo:hi].sum(axis=0)
                more, d = _cut(ga, ha)
                gain += more + ga.sum() ** 2 / (ha.sum() + RIDGE)
                out[lo:hi, :d], out[lo:hi, d:] = _leaf(ga[:d], ha[:d]), _leaf(ga[d:], ha[d:])
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """y: 0 or 1. Without rows every score is 1: there is nothing to reject by."""
    if not len(x):
        return Additive([np.zeros(0)] * x.shape[1], [np.zeros(1, np.int64)] * x.shape[1], [np.zeros(1)] * x.shape[1], [], 30.0)
    model = Additive(start=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    sizes = [len(e) + 1 for e in model.edges]
    model.coarse = [np.arange(s) * PAIR_BINS // max(s, PAIR_BINS) for s in sizes]
    model.tables = [np.zeros(s) for s in sizes]
    odds = np.full(len(y), model.start)

    def slopes():
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            t = _tree(np.bincount(b, g, sizes[k]), np.bincount(b, h, sizes[k]))
            model.tables[k] += t
            odds += t[b]
    few = [c[b] for c, b in zip(model.coarse, bins)]
    wide = [int(c.max()) + 1 for c in model.coarse]

    def grid(i, j, v):
        return np.bincount(few[i] * wide[j] + few[j], v, wide[i] * wide[j]).reshape(wide[i], wide[j])

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(bins)) for j in range(i)), reverse=True)[:PAIRS]
    chosen = [(i, j, np.zeros((wide[i], wide[j]))) for _, i, j in gains]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in chosen:
            g, h = slopes()
            _, step = _pair_tree(grid(i, j, g), grid(i, j, h))
            t += step
            odds += step[few[i], few[j]]
    model.pairs = chosen
    return model


def _held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Fits on labelled documents (doc_id, text) whose crc32(doc_id) mod 4 isn't 2: at most `sample` labels in hash order. Of repeated labels the lower counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~_held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` rows of two numbers: safe to broadcast
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(known), "id")

    def measure(batches):
        for b in batches:
            x = _matrix(b.column(1))
            yield pa.record_batch([b.column(0), b.column(1 + 1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = chosen.select("id", "t", "y").mapInArrow(measure, "id long, y int, x array<double>").orderBy(F.xxhash64("id"), "id", "x").limit(sample).toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, (got.column("y").to_numpy() > 0).astype(np.float64))


def score_documents(docs: DataFrame, model: Additive, text_col: str = "text", keep_from: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns of it) with column quality_score (0 to 1). With keep_from, only rows that reach it.

    Null text is empty and has a score too; repeated rows and null ids are scored like any; texts may be of any length; an empty
    table stays empty. A column of docs named quality_score is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("quality_score")
    names = [c for c in docs.columns if columns is None or c in columns]
    where = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(where)))
            out = pa.record_batch([*(b.column(c) for c in names), pa.array(s)], names=[*names, "quality_score"])
            yield out if keep_from is None else out.filter(pa.array(s >= keep_from))

    return docs.mapInArrow(run, StructType([f for f in docs.schema if f.name in names]).add("quality_score", "double"))


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit_on(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return scored.select(
        "doc_id", _held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted")
    )
