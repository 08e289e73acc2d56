"""Token-ID files: a concatenated id array with Elias-Fano encoded document boundaries.

Documents are dealt by ranges of doc_id, so that parts in order hold doc_ids in order. A file row is a
block of about BLOCK ids: the ids with 2 bytes each where all fit, else 4; and its doc_ids above the first
and the ends of its documents, both in Elias-Fano form. For n ends below u it takes about n (2 + log2(u / n)) bits: the low
bits as they are, the high bits as a unary bit vector with a sample of every SAMPLE-th one bit, from
which select(i) finds the i-th end by reading a few bytes. A document's offset in the whole corpus is its
block's start, the ids of earlier parts and earlier blocks, plus select in its block.

The container is Parquet in the shared folder, which any executor and any store that Spark reaches can
read; a text of any length is one document of one block.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import new_folder, table
from framewell.llm.words import pieces, text_bytes

#: Ids of a block, but for a longer document.
BLOCK = 1 << 19
SAMPLE = 64
#: Text bytes that are encoded at once, but for a longer text.
PIECE = 16 << 20
#: Text units whose ids a task remembers.
REMEMBERED = 1_000_000
#: Text units whose numbers of ids a task remembers.
SIZES = 1_000_000
END = 0
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(1)
FILE = "part int, block int, n_docs long, n_ids long, inside long, width int, ids binary, first_doc long, last_doc long, doc_ids binary, ends binary"


class EliasFano:
    """A non-decreasing sequence of integers from 0 up to `top`."""

    def __init__(self, data: bytes) -> None:
        self.n, self.low_bits, low_size, high_size = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        self.low = np.frombuffer(data, np.uint8, low_size, at)
        self.high = np.frombuffer(data, np.uint8, high_size, at + low_size)
        self.samples = np.frombuffer(data, "<u4", -1, at + low_size + high_size)

    @staticmethod
    def encode(values: np.ndarray, top: int) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, int(np.floor(np.log2(max(1, top) / n)))) if n and top > n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((top >> low_bits) + n + 1, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        return struct.pack("<QBQQ", n, low_bits, len(low), len(high)) + low.tobytes() + high.tobytes() + places[::SAMPLE].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bits = at // 8, int(self.high[at // 8]) >> (at % 8) << (at % 8)
        while left >= (ones := _ONES[bits]):
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        place = byte * 8 + int(np.flatnonzero(_BITS[bits])[left])
        return ((place - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        part = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (part >> first % 8) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1) if self.low_bits else np.zeros(self.n, np.int64)
        return ((places - np.arange(self.n)) << self.low_bits) | low


def _lead(data: np.ndarray, back: int) -> np.ndarray:
    """Each byte's neighbour `back` places before; 0 where there is none."""
    out = np.zeros(len(data), np.uint8)
    out[back:] = data[:-back]
    return out


def unit_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where units of texts start: the first byte of each text that isn't empty, each single space between two other characters, and each single line break there and the byte after it.

    The characters next to the blank are visible ASCII or of a block of UTF-8 without spaces (lead bytes 0xC3 to
    0xDF and from 0xE4 on), so no space of any kind can stand beside it. The tokenizer's own word pattern starts a
    word at such places, hence the ids of a text are those of its units in order.
    """
    visible = (data > 32) & (data < 127)
    opens = visible | ((data >= 0xC3) & (data <= 0xDF)) | (data >= 0xE4)
    two, three, four = (_lead(data, k) for k in (1, 2, 3))
    tail = (data & 0xC0) == 0x80
    closes = visible | (tail & (((two >= 0xC3) & (two <= 0xDF)) | ((three >= 0xE4) & (three <= 0xEF)) | (four >= 0xF0)))
    between = np.zeros(len(data), bool)
    between[1:-1] = closes[:-2] & opens[2:]
    between[first[1:] - 1] = False  # the last bytes of texts
    between[first] = False
    line = between & (data == 10)
    cut = line | (between & (data == 32))
    cut[1:] |= line[:-1]
    cut[first] = True
    return np.flatnonzero(cut)


#: A unit of a space and a word, and a word alone; letters as in unit_starts, of two bytes at most.
_SPACED = re.compile(rb" [!-~\xc3-\xdf\x80-\xbf]+").fullmatch
_BARE = re.compile(rb"[!-~\xc3-\xdf\x80-\xbf]+").fullmatch


class Encoder:
    """Ids of whole texts. Texts are cut into units (unit_starts); Arrow finds the distinct ones by their bytes, and the ids of those are remembered. New units go to the tokenizer TOGETHER at once, as a text that it cuts at the same places: words with a space in a row, words alone on lines of their own."""

    TOGETHER = 500

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced, self.line = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))  # ids that start with a space, or are a line break
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.line[vocabulary["\u010a"]] = True
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.sizes: dict[bytes, int] = {}
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        # few at a time: an encoding takes far more memory than its ids
        parts = (texts[i : i + 16] for i in range(0, len(texts), 16))
        return [np.array(e.ids, np.uint32) for part in parts for e in self.tokenizer.encode_batch([t.decode() for t in part], add_special_tokens=False)]

    def _together(self, units: list[bytes], between: bytes, starts: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """(units, their ids in a row, the number of ids of each). starts: the ids that start a unit, or stand between two."""
        runs = [units[i : i + self.TOGETHER] for i in range(0, len(units), self.TOGETHER)]
        for run, ids in zip(runs, self._encode([between.join(r) for r in runs]), strict=True):
            at = np.flatnonzero(starts[ids])
            if between:
                at, ids = np.concatenate([[0], at - np.arange(len(at))]), np.delete(ids, at)
            if len(at) != len(run):
                raise ValueError("this tokenizer doesn't cut at each space and line break")
            yield run, ids, np.diff(np.append(at, len(ids)))

    def _found(self, new: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """(units, their ids in a row, the number of ids of each) of new units, in any order."""
        odd = {u for u in new if any(t in u for t in self.added)} if any(t in b"".join(new) for t in self.added) else set()
        spaced, bare, rest = [], [], []
        for u in new:
            (rest if u in odd else spaced if _SPACED(u) else bare if _BARE(u) else rest).append(u)
        yield from self._together(spaced, b"", self.spaced)
        yield from self._together(bare, b"\n", self.line)
        yield from (([u], ids, np.array([len(ids)])) for u, ids in zip(rest, self._encode(rest), strict=True))

    def _learn(self, new: list[bytes]) -> None:
        found = list(self._found(new))
        units = [u for run, _, _ in found for u in run]
        sizes = np.concatenate([x for _, _, x in found])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, *(ids for _, ids, _ in found)])
        self.known |= dict(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))

    @staticmethod
    def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(n + 1 borders of the texts' bytes, places where units start, the distinct units, which of them stands at each place)."""
        data, borders = text_bytes(texts)
        starts = unit_starts(data, borders[:-1][np.diff(borders) > 0]) if len(data) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(starts, len(data)), pa.int64())
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        return borders, starts, units.dictionary.to_pylist(), units.indices.to_numpy()

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text, END among them. Only numbers of ids are remembered, of SIZES units."""
        if len(self.sizes) > SIZES:
            self.sizes = {}
        borders, starts, distinct, place = self._units(texts)
        size = np.array([self.sizes.get(u, 0) for u in distinct], np.int64)
        if len(new := np.flatnonzero(size == 0)):
            learned = [distinct[i] for i in new.tolist()]
            for units, _, n in self._found(learned):
                self.sizes |= zip(units, n.tolist(), strict=True)
            size[new] = [self.sizes[u] for u in learned]
        ends = np.concatenate([[0], np.cumsum(size[place])])
        return np.diff(ends[np.searchsorted(starts, borders, side="left")]) + 1

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END behind it; n + 1 borders)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        borders, starts, distinct, place = self._units(texts)
        code = np.array([self.known.get(u, -1) for u in distinct], np.int64)
        if len(new := np.flatnonzero(code < 0)):
            learned = [distinct[i] for i in new.tolist()]
            self._learn(learned)
            code[new] = [self.known[u] for u in learned]
        at = code[place]
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        body = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(total)]
        body_border = np.concatenate([[0], ends])[np.searchsorted(starts, borders, side="left")]
        return np.insert(body, body_border[1:], END), body_border + np.arange(len(texts) + 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None, name: str) -> Encoder:
    """One for each file and Python worker, since a worker runs many tasks. path: the tokenizer's file, by default that of `name` among the public tokenizers of the executor."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _files(path: str | None, name: str):
    """Blocks of the part's documents, which come in order of doc_id."""

    def block(number: int, inside: int, ids: list[np.ndarray], docs: list[int], sizes: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(ids)
        width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
        above = np.array([d - docs[0] for d in docs], np.uint64)
        values = [TaskContext.get().partitionId(), number, len(docs), len(flat), inside, width, flat.astype(f"<u{width}").tobytes(), docs[0], docs[-1], EliasFano.encode(above, docs[-1] - docs[0]), EliasFano.encode(np.cumsum(sizes), len(flat))]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in FILE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, name)
        number, inside, held, ids, docs, sizes = 0, 0, 0, [], [], []
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                flat, border = encode(piece.column(1))
                for i, doc in enumerate(piece.column(0).to_pylist()):
                    size = int(border[i + 1] - border[i])
                    if held and held + size > BLOCK:
                        yield block(number, inside, ids, docs, sizes)
                        number, inside, held, ids, docs, sizes = number + 1, inside + held, 0, [], [], []
                    ids.append(flat[border[i] : border[i + 1]]), docs.append(doc), sizes.append(size)
                    held += size
        if docs:
            yield block(number, inside, ids, docs, sizes)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, name: str = "byte_bpe_50k.json") -> None:
    """Writes docs(doc_id, text, ...) as token files. tokenizer: its file's place; by default that of `name` among the public tokenizers of each executor.

    A null or empty text has the end id alone. Rows with a null doc_id are left out, since they have no
    place in the order; rows that repeat a doc_id follow each other, in order of a hash of their texts.
    Extra columns are ignored; without documents no block is written.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").where("doc_id is not null").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(_files(tokenizer, name), FILE).write.parquet(path)


def open_token_files(spark, path: str) -> DataFrame:
    """The blocks with `start`, the ids of all blocks before each."""
    files = spark.read.schema(FILE).parquet(path)
    # a row for each part of the range partitioning: as many as it has partitions
    parts = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = [], 0
    for part, n in parts:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, before long")
    return files.join(offsets, "part").withColumn("start", F.col("inside") + F.col("before"))


class Block:
    """One file row: documents by place or by id, found by select."""

    def __init__(self, start: int, width: int, ids: bytes, first_doc: int, doc_ids: bytes, ends: bytes) -> None:
        self.start, self.first_doc = start, first_doc
        self.ids, self.docs, self.ends = np.frombuffer(ids, f"<u{width}"), EliasFano(doc_ids), EliasFano(ends)

    def document(self, i: int) -> tuple[int, int, np.ndarray]:
        """(doc_id, offset of its first id in the corpus, ids) of the block's i-th document."""
        a, b = self.ends.select(i - 1) if i else 0, self.ends.select(i)
        return self.first_doc + self.docs.select(i), self.start + a, self.ids[a:b]

    def find(self, doc_id: int) -> range:
        """The places of a doc_id, by binary search over select."""
        places = range(self.docs.n)
        first = bisect_left(places, doc_id - self.first_doc, key=self.docs.select)
        return range(first, bisect_right(places, doc_id - self.first_doc, lo=first, key=self.docs.select))


COLUMNS = ["start", "width", "ids", "first_doc", "doc_ids", "ends"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(len(batch)):
            yield Block(*(batch.column(c)[i].as_py() for c in range(len(COLUMNS))))


def read_digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of blocks, as open_token_files gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            rows = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in map(block.document, range(block.docs.n))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select(*COLUMNS).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, start, ids) of a stated list of documents: only blocks whose range of ids holds one are read, and in them only those documents' ids."""
    wanted = sorted(set(doc_ids))
    near = reduce(or_, [F.lit(x).between(F.col("first_doc"), F.col("last_doc")) for x in wanted], F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            rows = [block.document(i) for x in wanted for i in block.find(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return blocks.where(near).select(*COLUMNS).mapInArrow(run, "doc_id long, start long, ids array<long>")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_digests(open_token_files(spark, path))
