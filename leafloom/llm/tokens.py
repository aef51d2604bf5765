"""Token ids by a public byte-level BPE file of the tokenizers library, and a wavelet-matrix file format for them."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Tokens after which a shard ends (with its document).
SHARD_TOKENS = 1 << 18

_SAFE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte in the model's words: itself where it can be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in seen)}


class _Words(dict):
    """Ids of pieces of text, made where a piece is met for the first time."""

    def __init__(self, make, longest: int):
        super().__init__()
        self.make, self.longest, self.older = make, longest, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= self.longest:
            self[piece] = ids
        return ids

    def turn_over(self) -> None:
        """Pieces of the last round stay, those met again move on."""
        self.older = self.copy()
        self.clear()


class WordCachedTokenizer:
    """Same ids as tokenizer.encode(text, add_special_tokens=False) for byte-level BPE with the usual word pattern.

    Its words never run over a single space between two other characters that aren't white space, so the pieces between such
    spaces are encoded by the library once each (with the space before them) and remembered; a single line break between two
    such characters begins a piece too. Letters alone are one word of the pattern, with the space before them, so they go
    straight to the library's model in its byte alphabet; stops behind them are another word. All other pieces go to the
    library whole, and so do texts that hold a special token's string.
    """

    KEEP, LONGEST = 400_000, 48
    _PLAIN, _ODD_SPACE = ("  ", "\n\n", " \n", "\n "), re.compile(r"[^\S \n]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        if self.plain.get_vocab_size() > 65536:
            raise ValueError("ids of more than 16 bits")
        self.line, self.alphabet, self.model = self._whole("\n"), byte_alphabet(), self.plain.model.tokenize
        self.stops: dict[str, bytes] = {"": b""}
        self.words = _Words(self._piece, self.LONGEST)

    def _whole(self, text: str) -> bytes:
        return array("H", self.plain.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece with a space before it, or as it is where it begins with a line break."""
        if piece.isascii() and piece.isalpha():
            return array("H", [t.id for t in self.model("\u0120" + piece)]).tobytes()
        base = piece.rstrip(".,;:!?")
        new = base[:1] == "\n"
        word = base[1:] if new else base
        if not word.isalpha():
            return self._whole(piece if piece[:1] == "\n" else " " + piece)
        tail = piece[len(base) :]
        if tail not in self.stops:
            self.stops[tail] = self._whole(tail)
        if tail and not new:
            return self.words[base] + self.stops[tail]  # the word alone is met more often, and remembered
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        if new:
            return self.line + array("H", [t.id for t in self.model(word)]).tobytes() + self.stops[tail]
        return array("H", [t.id for t in self.model("\u0120" + word)]).tobytes() + self.stops[tail]

    def _plain_spaces(self, text: str) -> bool:
        """Whether all white space is single spaces and line breaks inside the text."""
        return bool(text) and not (text[0].isspace() or text[-1].isspace() or any(x in text for x in self._PLAIN) or self._ODD_SPACE.search(text))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > self.KEEP:
            self.words.turn_over()
        find, out = self.words.__getitem__, []
        for t in texts:
            if any(x in t for x in self.special):
                raw = self._whole(t)
            elif self._plain_spaces(t):
                first, *rest = t.replace("\n", " \n").split(" ")
                raw = find("\n" + first)[len(self.line) :] + b"".join(map(find, rest))  # as if after a line break, whose id goes again
            else:
                first, *rest = _SAFE.split(t)
                raw = self._whole(first) + b"".join(map(find, rest))
            out.append(np.frombuffer(raw, dtype="<u2"))
        return out


_LOADED: dict[str, WordCachedTokenizer] = {}


def load(path: str) -> WordCachedTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordCachedTokenizer(path)
    return _LOADED[path]


def with_end(ids: np.ndarray) -> np.ndarray:
    return np.append(ids, np.uint16(END))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# ---------------------------------------------------------------- wavelet matrix

#: Bits for which a plane's directory counts the ones before, and bytes of a plane in one compressed frame.
_BLOCK, _FRAME = 512, 4096
_MAGIC, _HEAD = b"LFWM", struct.Struct("<4sHHQQ")


def _order(bit: np.ndarray) -> tuple[np.ndarray, int]:
    """Places with a zero, then places with a one, each in order; and the number of zeros."""
    zero = np.flatnonzero(~bit)
    return np.concatenate((zero, np.flatnonzero(bit))), len(zero)


def _ones_by_block(plane: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-max(1, len(plane)) // 64) * 64, dtype=np.uint8)
    padded[: len(plane)] = plane
    return np.concatenate(([0], np.cumsum(np.bitwise_count(padded.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.int64))))


class _Plane:
    """A bit-plane in frames of its own: bytes are inflated where they are asked for."""

    def __init__(self, frames: list[bytes]):
        self.frames, self.known = frames, {}

    def bytes_of(self, a: int, b: int) -> np.ndarray:
        got = []
        for k in range(a // _FRAME, -(-b // _FRAME)):
            if k not in self.known and k < len(self.frames):
                self.known[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[k]), np.uint8)
            if k in self.known:
                got.append(self.known[k][max(0, a - k * _FRAME) : b - k * _FRAME])
        return np.concatenate(got) if got else np.zeros(0, np.uint8)

    def all(self) -> np.ndarray:
        return self.bytes_of(0, _FRAME * len(self.frames))


class WaveletMatrix:
    """Bit-planes from the top bit down, each ordered by the bits above it (zeros first), with counts of ones before every 512 bits.

    Planes and counts are those of a file or just built; access, rank and select inflate no more than the frames they touch.
    """

    def __init__(self, planes: list[_Plane], zeros: list[int], ranks: list[np.ndarray], n: int):
        self.planes, self.zeros, self.ranks, self.n, self.levels = planes, zeros, ranks, n, len(planes)
        #: By plane, where each place of the plane below comes from, once everything has been decoded.
        self.above: list[np.ndarray] = []

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now, self.above = np.zeros(self.n, dtype=np.uint16), [None] * self.levels
        for k in range(self.levels - 1, -1, -1):
            order, zeros = _order(np.unpackbits(self.planes[k].all(), count=self.n, bitorder="little").view(bool))
            self.above[k] = order.astype(np.int32)
            now[zeros:] |= np.uint16(1 << (self.levels - 1 - k))
            up = np.empty_like(now)
            up[order] = now
            now = up
        return now

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k].bytes_of(i >> 3, (i >> 3) + 1)[0]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones before place i of plane k."""
        block = i // _BLOCK
        part = self.planes[k].bytes_of(block * _BLOCK // 8, (i + 7) // 8)
        inside = np.unpackbits(part, bitorder="little")[: i - block * _BLOCK]
        return int(self.ranks[k][block]) + int(inside.sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            b, ones = self._bit(k, i), self._ones(k, i)
            i = self.zeros[k] + ones if b else i - ones
            value = value << 1 | b
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        for k in range(self.levels):
            oa, ob = self._ones(k, a), self._ones(k, b)
            a, b = (self.zeros[k] + oa, self.zeros[k] + ob) if token >> (self.levels - 1 - k) & 1 else (a - oa, b - ob)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """How often token stands before place end."""
        a, b = self._range(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bits(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0) bits of that value in plane k."""
        before = self.ranks[k] if bit else np.arange(len(self.ranks[k])) * _BLOCK - self.ranks[k]
        block = np.searchsorted(before, nth, side="right") - 1
        rows, own = np.unique(block, return_inverse=True)
        wide = np.zeros((len(rows), _BLOCK // 8), np.uint8)
        for r, x in zip(wide, rows.tolist()):
            part = self.planes[k].bytes_of(x * _BLOCK // 8, (x + 1) * _BLOCK // 8)
            r[: len(part)] = part
        place = np.cumsum(np.unpackbits(wide, axis=1, bitorder="little") == bit, axis=1, dtype=np.int32)
        at = np.empty(len(nth), np.int64)
        want = nth - before[block]
        for j in range(len(rows)):
            mine = own == j if len(rows) > 1 else slice(None)
            at[mine] = np.searchsorted(place[j], want[mine] + 1)
        return block * _BLOCK + at

    def select(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of token."""
        return int(self.select_all(token, np.array([nth]))[0])

    def select_all(self, token: int, nth: np.ndarray) -> np.ndarray:
        """Places of these (from 0) occurrences of token."""
        a, b = self._range(token, self.n)
        nth = np.asarray(nth, np.int64)
        if len(nth) and not (0 <= nth.min() and nth.max() < b - a):
            raise IndexError(nth)
        i = a + nth
        for k in range(self.levels - 1, -1, -1) if len(nth) else ():
            bit = token >> (self.levels - 1 - k) & 1
            i = self.above[k][i] if self.above else self._select_bits(k, bit, i - self.zeros[k] if bit else i)
        return np.asarray(i, np.int64)

    def occurrences(self, token: int) -> list[int]:
        return self.select_all(token, np.arange(self.count(token))).tolist()


def _planes(ids: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[int]]:
    planes, zeros, now = [], [], np.ascontiguousarray(ids, dtype=np.uint16)
    for level in range(levels - 1, -1, -1):
        bit = (now & np.uint16(1 << level)) != 0
        order, low = _order(bit)
        planes.append(np.packbits(bit, bitorder="little"))
        zeros.append(low)
        now = now.take(order)
    return planes, zeros


def dump_shard(ids: np.ndarray, doc_ids: list, ends: list[int], levels: int = 16) -> bytes:
    """One self-contained file. `ends`: the place of each document's end id in ids.

    Header, then frames, each after its length: document ids, null flags and each document's end id as its number among the
    occurrences of END; then for each plane the zeros and counts of ones by block, and the plane cut into frames.
    """
    planes, zeros = _planes(ids, levels)
    put = zstandard.ZstdCompressor(level=1).compress
    among = np.cumsum(np.asarray(ids) == END)[np.array(ends, dtype=np.int64)] - 1 if len(ends) else np.zeros(0)
    parts = [np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(), among.astype("<i8").tobytes()]
    for p, z in zip(planes, zeros):
        raw = p.tobytes()
        parts.append(struct.pack("<Q", z) + _ones_by_block(p).astype("<u4").tobytes())
        parts += [raw[at : at + _FRAME] for at in range(0, len(raw), _FRAME)]
    frames = [put(x) for x in parts]
    return _HEAD.pack(_MAGIC, 2, levels, len(ids), len(doc_ids)) + b"".join(struct.pack("<I", len(f)) + f for f in frames)


def load_shard(payload: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(ids, document ids, number of each document's end id among the occurrences of END) of dump_shard(). No plane is inflated yet."""
    magic, version, levels, n, _ = _HEAD.unpack_from(payload)
    if magic != _MAGIC or version != 2:
        raise ValueError("not a shard of this format")
    at, got, get = _HEAD.size, [], zstandard.ZstdDecompressor().decompress
    each = -(-(-(-n // 8)) // _FRAME)
    for _ in range(3 + levels * (1 + each)):
        (size,) = struct.unpack_from("<I", payload, at)
        got.append(payload[at + 4 : at + 4 + size])
        at += 4 + size
    if at != len(payload):
        raise ValueError("bytes after the last plane")
    null, among = np.frombuffer(get(got[1]), np.uint8), np.frombuffer(get(got[2]), "<i8")
    ids = [None if z else int(x) for x, z in zip(np.frombuffer(get(got[0]), "<i8"), null)]
    heads = [get(x) for x in got[3 :: 1 + each]]
    planes = [_Plane(got[k + 1 : k + 1 + each]) for k in range(3, len(got), 1 + each)]
    ranks = [np.frombuffer(x, "<u4", offset=8).astype(np.int64) for x in heads]
    wm = WaveletMatrix(planes, [struct.unpack_from("<Q", x)[0] for x in heads], ranks, n)
    return wm, ids, among


def _shard_batches(path: str, shard_tokens: int):
    def row(part, seq, ids, docs):
        flat = np.concatenate(ids)
        payload = dump_shard(flat, docs, (np.cumsum([len(x) for x in ids]) - 1).tolist())
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([payload], pa.binary())], names=["part", "seq", "n_tokens", "payload"])

    def run(batches):
        part, seq, tok = TaskContext.get().partitionId(), 0, load(path)
        ids, docs, n = [], [], 0
        for b in batches:
            for doc, got in zip(b.column(0).to_pylist(), tok.encode_batch(b.column(1).to_pylist())):
                ids.append(with_end(got))
                docs.append(doc)
                n += len(ids[-1])
                if n >= shard_tokens:
                    yield row(part, seq, ids, docs)
                    ids, docs, n, seq = [], [], 0, seq + 1
        if ids:
            yield row(part, seq, ids, docs)

    return run


def write_token_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards in ascending id order (ids that are null first, repeated ids by text): (part, seq, n_tokens, payload), payload being a file of dump_shard().

    The rows are written to the shared folder through Spark, which any store behind it takes, and read again from there.
    Null text is empty and gives just the end id. A text of any length is one document of one shard. Other columns are not used,
    whatever their names. An empty table gives no shard.
    """
    spark = prepare(docs.sparkSession)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    order = [F.asc_nulls_first("id"), F.asc("th")]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("id", "text")
    return materialize(dealt.mapInArrow(_shard_batches(path or tokenizer_path(), shard_tokens), "part int, seq long, n_tokens long, payload binary"), "token-shards")


def _read_batches(batches):
    for b in batches:
        for part, seq, payload in zip(*(b.column(k).to_pylist() for k in range(3))):
            wm, docs, among = load_shard(payload)
            raw = memoryview(wm.decode().astype("<u4").tobytes())
            ends = wm.select_all(END, among) + 1
            starts = np.concatenate(([0], ends[:-1]))
            sizes = ends - starts
            crcs = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
            n = len(docs)
            yield pa.record_batch([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq)), pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64())], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_token_index(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the shards' payloads; start counts the ids of all documents before.

    Where a document ends is looked up in its shard as an occurrence of the end id. Null ids come back null, repeated rows each for itself;
    no shards give no rows.
    """
    spark = shards.sparkSession
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each range partition
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    first = spark.createDataFrame(rows, "part int, part_start long")
    own = Window.partitionBy("part").orderBy("seq")
    places = shards.select("part", "seq", (F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("shard_start")).join(first, "part")
    read = shards.select("part", "seq", "payload").mapInArrow(_read_batches, "part int, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return read.join(places, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op5_wavelet_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_index(write_token_shards(table(spark, sf_dir, "documents").select("doc_id", "text")))
