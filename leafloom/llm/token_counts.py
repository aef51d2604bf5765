"""Token counts of whole texts; huge documents are counted in overlapping chunks, spliced where both encodings agree.

A text of up to CHUNK characters is counted where it lies. A longer one is cut into chunks of CHUNK characters, each reaching
OVERLAP characters into the next; chunks are rows, dealt out by number, so no task holds more than its share of a huge document.
Every chunk is encoded by the library with offsets and tells, for its first OVERLAP characters and for those it shares with the
next, at which places it has a token boundary that is proven stable and which ids follow up to the next such place. Two neighbours
are spliced at the first place that both tell alike. Where there is none (one word longer than the overlap), the stretch between
the nearest spliced places is cut anew with chunks and overlaps WIDER times as large, until all is spliced or one chunk holds it.

Stable is a place before a blank, tab or line break. The tokenizer's normalizer turns white space into one space, composes
characters (never over white space, which composes with nothing before it) and lowers letters one by one; its pattern drops white
space and no match holds any; the strings of its special tokens hold none. So what stands before such a place is encoded the same
whatever stands behind it, and the reverse.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table
from .tokens import tokenizer_path

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: Characters of a chunk and of its overlap with the next, and by what both grow where chunks can't be spliced.
CHUNK, OVERLAP, WIDER = 32_768, 1_024, 8

_BREAK = " \t\n\r"
_BREAKS = re.compile(r"[ \t\n\r]+")
#: White space for str.split() that is not one of _BREAK.
_ODD = re.compile(r"[^\S \t\n\r]")
_PLACES = "array<struct<at:long,ids:long,n:long>>"
#: Chunks that one task encodes, where there are more than the session's partitions take.
_TASK_CHUNKS = 2_048


class Counter(dict):
    """Numbers of tokens of words between breaks, each asked of the library once and remembered within bounds."""

    KEEP, LONGEST = 400_000, 48

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain, self.older = Tokenizer.from_file(path), {}
        self.plain.no_truncation()
        self.plain.no_padding()

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = len(self.plain.encode(word, add_special_tokens=False).ids)
        if len(word) <= self.LONGEST:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > self.KEEP:  # words of the last round stay, those met again move on
            self.older = self.copy()
            self.clear()
        words = text.split() if not _ODD.search(text) else [w for w in _BREAKS.split(text) if w]
        return sum(map(self.__getitem__, words))

    def places(self, text: str, ranges: list[tuple[int, int]], final: bool) -> tuple[int, list[list[tuple[int, int, int]]]]:
        """Tokens of text, and for each range, in order, its stable places: (place, crc of the ids up to the next such place, tokens before).

        `final`: text ends at a stable place, its end.
        """
        got = self.plain.encode(text, add_special_tokens=False)
        ids, ends = got.ids, [e for _, e in got.offsets]
        out = []
        for lo, hi in ranges:
            at = [m.start() for m in _BREAKS.finditer(text, lo, min(len(text), hi))] if lo < len(text) else []
            if final and lo <= len(text) < hi:
                at.append(len(text))
            upto = [bisect_right(ends, x) for x in at]
            follow = [zlib.crc32(array("I", ids[n:m]).tobytes()) for n, m in zip(upto, upto[1:])]
            # what follows the last place is known in whole only where that is the end
            if at and final and at[-1] == len(text):
                follow.append(-1)
            out.append(list(zip(at, follow, upto)))
        return len(ids), out


_LOADED: dict[str, Counter] = {}


def load(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def _first_pass(path: str, chunk: int, overlap: int):
    """A row for each document, counted where its text is short, and one for each chunk of a long text."""
    names = ["rid", "doc_id", "n_bytes", "n_tokens", "a", "b", "k", "text"]
    kinds = [pa.int64()] * 7 + [pa.string()]

    def batch(rows):
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        rid, counter = TaskContext.get().partitionId() << 40, load(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size = len(text.encode())
                if len(text) <= chunk:
                    rows.append((rid, doc, size, counter.count(text), None, None, None, None))
                else:
                    rows.append((rid, doc, size, None, None, None, None, None))
                    for k, at in enumerate(range(0, len(text), chunk)):
                        rows.append((rid, None, None, None, 0, len(text), k, text[at : at + chunk + overlap]))
                        if len(rows) >= 200:
                            yield batch(rows)
                            rows = []
                rid += 1
            if rows:
                yield batch(rows)

    return run, "rid long, doc_id long, n_bytes long, n_tokens long, a long, b long, k long, text string"


def _encoded(path: str, chunk: int, overlap: int):
    """Chunks (rid, a, b, k, text) to (rid, a, b, k, n, head, tail): tokens, and the stable places of both overlaps, told from the document's start."""
    place = pa.list_(pa.struct([("at", pa.int64()), ("ids", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        counter = load(path)
        for batch in batches:
            n, heads, tails = [], [], []
            for a, b, k, text in zip(*(batch.column(c).to_pylist() for c in range(1, 5))):
                begin = a + k * chunk
                tokens, found = counter.places(text, [(0, overlap), (chunk, chunk + overlap)], begin + len(text) >= b)
                n.append(tokens)
                for side, places in zip((heads, tails), found):
                    side.append([{"at": begin + x, "ids": y, "n": z} for x, y, z in places])
            columns = [*(batch.column(c) for c in range(4)), pa.array(n, pa.int64()), pa.array(heads, place), pa.array(tails, place)]
            yield pa.record_batch(columns, names=["rid", "a", "b", "k", "n", "head", "tail"])

    return run, f"rid long, a long, b long, k long, n long, head {_PLACES}, tail {_PLACES}"


def _spliced(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(rid, a, b, k, last, n, cut, n_left, n_right): where each chunk is spliced with the next, and the tokens that each counts before that place.

    The window holds one document's chunks at a time, and no value of a table is over 2 GB.
    """
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.count() // _TASK_CHUNKS)
    run, schema = _encoded(path, chunk, overlap)
    encoded = chunks.select("rid", "a", "b", "k", "text").repartition(parts, "rid", "k").mapInArrow(run, schema)
    following = F.lead("head").over(Window.partitionBy("rid", "a").orderBy("k"))
    alike = lambda places: F.transform(places, lambda x: F.struct(x["at"].alias("at"), x["ids"].alias("ids")))
    before = lambda places: F.get(F.filter(places, lambda x: x["at"] == F.col("cut")), F.lit(0))["n"]
    seams = encoded.withColumn("next", following).withColumn("last", F.expr(f"a + (k + 1) * {chunk} >= b"))
    seams = seams.withColumn("cut", F.when(~F.col("last"), F.array_min(F.array_intersect(alike(F.col("tail")), alike(F.col("next"))))["at"]))
    return materialize(seams.select("rid", "a", "b", "k", "last", "n", "cut", before(F.col("tail")).alias("n_left"), before(F.col("next")).alias("n_right")), "count-seams")


def _settle(seams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, n) of the chunks spliced on both sides, and (rid, a, b) of the stretches between spliced places that are still to be counted."""
    own = Window.partitionBy("rid", "a").orderBy("k")
    x = seams.withColumns({"_cut": F.lag("cut").over(own), "_n": F.lag("n_right").over(own)})
    x = x.withColumns({"left": (F.col("k") == 0) | F.col("_cut").isNotNull(), "right": F.col("last") | F.col("cut").isNotNull()})
    done = x.where("left and right").select("rid", (F.coalesce("n_left", "n") - F.coalesce("_n", F.lit(0))).alias("n"))
    still = x.where("not (left and right)").withColumn("_g", F.sum(F.col("left").cast("int")).over(own))
    stretch = still.groupBy("rid", "a", "_g").agg(F.min(F.when(F.col("left"), F.coalesce("_cut", "a"))).alias("from"), F.max(F.when(F.col("right"), F.coalesce("cut", "b"))).alias("to"))
    return done, stretch.select("rid", F.col("from").alias("a"), F.col("to").alias("b"))


def _recut(stretches: DataFrame, pieces: DataFrame, piece: int, chunk: int, overlap: int) -> DataFrame:
    """Chunks (rid, a, b, k, text) of the stretches, put together from the pieces (rid, p, text) of `piece` characters each."""
    asked = stretches.select("rid", "a", "b", F.explode(F.expr(f"sequence(a div {piece}, (b - 1) div {piece})")).alias("p"))
    held = asked.join(pieces, ["rid", "p"]).withColumn("at", F.col("p") * piece)
    # chunk k takes what lies in [a + k * chunk, a + (k + 1) * chunk + overlap)
    first = f"greatest(0, (greatest(at - a - {overlap}, 0)) div {chunk})"
    last = f"(least(at + {piece}, b) - 1 - a) div {chunk}"
    lots = held.withColumn("k", F.explode(F.expr(f"sequence({first}, {last})")))
    joined = lots.groupBy("rid", "a", "b", "k").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("t"))
    begin = F.expr(f"a + k * {chunk}")
    text = F.array_join(F.transform("t", lambda x: x["text"]), "")
    size = F.least(F.lit(chunk + overlap), F.col("b") - begin).cast("int")
    return joined.select("rid", "a", "b", "k", F.substring(text, (begin - F.col("t")[0]["at"] + 1).cast("int"), size).alias("text"))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, as the library counts its whole text.

    Null text is empty: no bytes, no tokens. Null ids stay null; repeated rows and ids each count for themselves, in no order. A text of
    any length is counted whole. Other columns are not used, whatever their names. An empty table gives an empty result.
    """
    if not 0 < overlap < chunk:
        raise ValueError("an overlap is shorter than a chunk")
    spark = prepare(docs.sparkSession)
    path = path or tokenizer_path(TOKENIZER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run, schema = _first_pass(path, chunk, overlap)
    lots = materialize(rows.mapInArrow(run, schema), "count-lots")
    chunks = lots.where("k is not null").select("rid", "a", "b", "k", "text")
    pieces = chunks.select("rid", F.col("k").alias("p"), F.substring("text", 1, chunk).alias("text"))
    counted, size, over = [], chunk, overlap
    while not chunks.isEmpty():
        done, stretches = _settle(_spliced(chunks, path, size, over))
        counted.append(done)
        if stretches.isEmpty():
            break
        size, over = size * WIDER, over * WIDER
        chunks = materialize(_recut(stretches, pieces, chunk, size, over), "count-wider")
    short = lots.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")
    if counted:
        every = counted[0]
        for x in counted[1:]:
            every = every.unionAll(x)
        totals = every.groupBy("rid").agg(F.sum("n").alias("n_tokens"))
        short = short.unionAll(lots.where("k is null and n_tokens is null").select("rid", "doc_id", "n_bytes").join(totals, "rid").select("doc_id", "n_bytes", "n_tokens"))
    return short.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_overlap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
