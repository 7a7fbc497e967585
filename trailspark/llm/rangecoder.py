"""Token ids in range-coded blocks, and the table format that holds them (operator 7).

A segment's header lists its distinct ids with coarse frequencies. A block starts from those alone: its own counts,
its own coder, its own checksum. The blocks of a segment are coded in lockstep, one id of each at a time, so the
arithmetic runs on arrays of thousands of blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.tokens import encoder

MAGIC = b"TSRC"
VERSION = 2
#: Ids in a block.
BLOCK = 1024
#: Groups of neighbouring ids whose shares adapt within a block, and how much one id adds to its group.
CLASSES, GAIN = 32, 6
#: Slots of a block's candidates after one and after two ids.
SLOTS = (512, 1024)
_FIXED = "<4sHHQIIII"
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 44)
_WORD, _HALF = np.uint64(16), np.uint64(48)


class Corrupt(ValueError):
    """A segment that is cut off, or whose checksums or header are wrong."""


class _Lanes:
    """Range coders of many blocks at once, on 64 bits, 16 at a time; reads from ``source`` if given, else writes."""

    def __init__(self, lanes: int, capacity: int, source: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.low, self.size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.source, self.decoding = source, source is not None
        if self.decoding:
            self.at, self.code = starts.astype(np.int64), np.zeros(lanes, np.uint64)
            for _ in range(4):
                self.code = self.code << _WORD | source[self.at]
                self.at += 1
        else:
            self.at, self.words = np.arange(lanes) * capacity, np.zeros(lanes * capacity, np.uint16)

    def target(self, n: int, total: np.ndarray) -> np.ndarray:
        """The count below ``total`` that each of the first n codes stands for."""
        self.unit = self.size[:n] // total
        return np.minimum((self.code[:n] - self.low[:n]) // self.unit, total - np.uint64(1))

    def take(self, n: int, below: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
        """Narrow the first n lanes to ``count`` of ``total`` after ``below``, and move settled words out or in."""
        unit = self.unit if self.decoding else self.size[:n] // total
        low, size, at = self.low[:n], self.size[:n], self.at[:n]
        low += below * unit
        np.multiply(unit, count, out=size)
        settled = (low ^ (low + size)) < _TOP
        by = settled.astype(np.uint64) * _WORD
        if self.decoding:
            self.code[:n] = self.code[:n] << by | self.source[at] * settled
        else:
            self.words[at] = low >> _HALF
        at += settled
        low <<= by
        size <<= by
        while len(small := np.flatnonzero(size < _BOTTOM)):  # few lanes
            a, b = low[small], size[small]
            b = np.where((a ^ (a + b)) < _TOP, b, (~a + np.uint64(1)) & (_BOTTOM - np.uint64(1)))
            if self.decoding:
                self.code[small] = self.code[small] << _WORD | self.source[at[small]]
            else:
                self.words[at[small]] = a >> _HALF
            at[small] += 1
            low[small], size[small] = a << _WORD, b << _WORD

    def flush(self) -> None:
        """Two words lead into what is left of each interval, whatever follows them."""
        end = self.low + np.uint64((1 << 32) - 1)
        for shift in (48, 32):
            self.words[self.at] = end >> np.uint64(shift)
            self.at += 1


class _Frequencies:
    """A segment's ids by place in its alphabet: class, and where a place lies within its class.

    Classes are runs of the alphabet with about equal shares. Within a class, the frequencies of its places add up
    to 2^bits, so that a place's share is its class's adaptive count times a fixed frequency.
    """

    def __init__(self, levels: np.ndarray):
        weight = np.array([int(2 ** (k / 4)) for k in range(160)], np.int64)[levels]
        upto = np.cumsum(weight) - weight
        self.of = upto * CLASSES // max(1, int(weight.sum()))
        members = np.bincount(self.of, minlength=CLASSES)
        self.bits = max(12, int(members.max()).bit_length() + 1)
        room = 1 << self.bits
        sums = np.bincount(self.of, weights=weight, minlength=CLASSES).astype(np.int64)
        share = 1 + weight * (room - members[self.of]) // sums[self.of]
        first = np.concatenate([[0], np.cumsum(members)])[:-1]
        some = members > 0
        share[first[some]] += room - np.bincount(self.of, weights=share, minlength=CLASSES).astype(np.int64)[some]
        start = np.cumsum(share) - share
        start -= start[first[self.of]]
        self.place = self.of << 48 | start << 24 | share
        counts = 1 + sums * (16 * CLASSES) // max(1, int(weight.sum()))
        self.classes = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint16)
        self.total = int(self.classes[-1])
        lookup = np.zeros((CLASSES, room), np.uint32)
        lookup[some] = np.repeat(np.arange(len(share), dtype=np.uint32), share).reshape(-1, room)
        self.lookup = lookup.ravel()


class _Models:
    """Predictions of the next id in each block, mixed.

    Orders 2 and 1 put all their weight on the id that last followed the same two ids or the same id; order 0
    spreads its own over all ids, by class counts that adapt. The three weights are learned for every state of the
    candidates' confidences (how often they were right of late, and whether they agree). An id's share of the code
    is the sum of what the three orders give it.
    """

    #: Weights of orders 0, 1 and 2 in ten bits each, for each state, at the start of a block.
    START = np.array([24 | (4 + 10 * one) << 10 | (6 + 24 * two) << 20 for two in range(4) for one in range(4) for _ in range(2)], np.uint32)

    def __init__(self, lanes: int, known: _Frequencies):
        self.known, self.lanes, self.lane = known, lanes, np.arange(lanes)
        self.table = [np.zeros(lanes * s, np.uint32) for s in SLOTS]
        self.weights = np.tile(self.START, lanes)
        self.upto = np.repeat(known.classes[:, None], lanes, axis=1)
        self.flat, self.rows = self.upto.reshape(-1), np.arange(CLASSES + 1, dtype=np.uint8)[:, None]
        self.total, self.one, self.two = known.total, np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, n: int) -> None:
        lane, one, two = self.lane[:n], self.one[:n], self.two[:n]
        self.at = [lane * SLOTS[0] + (one * 40_503 >> 4 & SLOTS[0] - 1), lane * SLOTS[1] + (one * 40_503 + two * 60_493 >> 3 & SLOTS[1] - 1)]
        self.held = [t[at].astype(np.int64) for t, at in zip(self.table, self.at)]
        self.sure = [h & 3 for h in self.held]
        self.candidate = first, second = [(h >> 2) - 1 for h in self.held]
        self.state = lane * 32 + (self.sure[1] * 8 + self.sure[0] * 2 + (first == second))
        self.packed = self.weights[self.state]
        w = self.packed.astype(np.int64)
        self.w0, self.w1, self.w2 = w & 1023, (w >> 10 & 1023) * (first >= 0), (w >> 20) * (second >= 0)
        self.unit = self.total << self.known.bits
        self.whole = ((self.w0 + self.w1 + self.w2) * self.unit).view(np.uint64)

    def ordinary(self, n: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What lies before each place in order 0, its own share, and its class."""
        packed = self.known.place[places]
        of = packed >> 48
        at = of * self.lanes + self.lane[:n]
        before = self.flat[at].astype(np.int64)
        size = self.flat[at + self.lanes] - before
        return (before << self.known.bits) + size * (packed >> 24 & 0xFFFFFF), size * (packed & 0xFFFFFF), of

    def share(self, n: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts below and of each place in the mixture, and its class."""
        before, own, of = self.ordinary(n, places)
        first, second = self.candidate
        self.hits = hit1, hit2 = first == places, second == places
        below = self.w0 * before + self.unit * (self.w1 * (first < places) + self.w2 * (second < places))
        return below, self.w0 * own + self.unit * (self.w1 * hit1 + self.w2 * hit2), of

    def find(self, n: int, target: np.ndarray) -> np.ndarray:
        """The places whose shares hold the targets."""
        first, second = self.candidate
        swap = first > second
        low, high = np.where(swap, second, first), np.where(swap, first, second)
        low_w, high_w = np.where(swap, self.w2, self.w1), np.where(swap, self.w1, self.w2)
        same = low == high
        low_w, high_w = (low_w + high_w * same) * self.unit, high_w * ~same * self.unit
        low, high = np.maximum(low, 0), np.maximum(high, 0)  # without a candidate the weight is nought
        before, own, _ = self.ordinary(n, low)
        past = target - self.w0 * before
        is_low = (past >= 0) & (past < self.w0 * own + low_w)
        rest = target - low_w * (past >= 0)
        before, own, _ = self.ordinary(n, high)
        past = rest - self.w0 * before
        is_high = (past >= 0) & (past < self.w0 * own + high_w) & ~same
        rest = (rest - high_w * (past >= 0)) // self.w0
        rest = np.clip(rest, 0, self.unit - 1)  # only where a candidate is meant
        row = (rest >> self.known.bits).astype(np.uint16)
        of = np.add.reduce((self.upto[1:, :n] <= row).view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
        at = of * self.lanes + self.lane[:n]
        start = self.flat[at].astype(np.int64)
        within = (rest - (start << self.known.bits)) // np.maximum(self.flat[at + self.lanes] - start, 1)
        found = self.known.lookup[(of << self.known.bits) + within].astype(np.int64)
        return np.where(is_low, low, np.where(is_high, high, found))

    def learn(self, n: int, places: np.ndarray, of: np.ndarray) -> None:
        """Take in the places that ``share`` was last asked for."""
        hit1, hit2 = self.hits
        fresh = places + 1 << 2
        for table, at, held, sure, hit in zip(self.table, self.at, self.held, self.sure, self.hits):
            table[at] = np.where(hit, held + (sure < 3), np.where(sure > 0, held - 1, fresh))
        shift = (hit2 * np.uint32(20)) | (hit1 & ~hit2) * np.uint32(10)
        packed = self.packed + (np.uint32(12) << shift)
        if len(full := np.flatnonzero((packed >> shift & np.uint32(1023)) > 1000)):
            packed[full] = packed[full] >> np.uint32(1) & np.uint32(0x1FF7FDFF) | np.uint32(1 << 20 | 1 << 10 | 1)
        self.weights[self.state] = packed
        self.upto[:, :n] += (self.rows > of.astype(np.uint8)).view(np.uint8) * np.uint8(GAIN)
        self.total += GAIN
        self.two[:n], self.one[:n] = self.one[:n], places


def _written_blocks(places: np.ndarray, last: int, known: _Frequencies) -> tuple[np.ndarray, np.ndarray, int]:
    """Code blocks, given as columns of places (block, blocks) of which the last column ends at ``last``."""
    lanes = places.shape[1]
    capacity = 3 * len(places) + 8
    coder, model = _Lanes(lanes, capacity), _Models(lanes, known)
    for k in range(len(places)):
        n = lanes if k < last else lanes - 1
        model.predict(n)
        now = places[k, :n].astype(np.int64)
        below, count, of = model.share(n, now)
        coder.take(n, below.view(np.uint64), count.view(np.uint64), model.whole)
        model.learn(n, now, of)
    coder.flush()
    return coder.words, coder.at - np.arange(lanes) * capacity, capacity


def _read_blocks(source: np.ndarray, starts: np.ndarray, longest: int, last: int, known: _Frequencies) -> np.ndarray:
    lanes = len(starts)
    out = np.zeros((longest, lanes), np.uint32)
    coder, model = _Lanes(lanes, 0, source, starts), _Models(lanes, known)
    for k in range(longest):
        n = lanes if k < last else lanes - 1
        model.predict(n)
        found = model.find(n, coder.target(n, model.whole).view(np.int64))
        below, count, of = model.share(n, found)
        coder.take(n, below.view(np.uint64), count.view(np.uint64), model.whole)
        model.learn(n, found, of)
        out[k, :n] = found
    return out


def compress(ids: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit ids: a header with alphabet and frequencies, a table of its blocks (ids, bytes,
    crc32 of the bytes and of the ids), and the blocks."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) < 1 << 22:
        n = np.bincount(ids)
        alphabet = np.flatnonzero(n)
        rank = np.zeros(len(n), np.uint32)
        rank[alphabet] = np.arange(len(alphabet))
        counts, places = n[alphabet], rank[ids]
    else:
        alphabet, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
    levels = (4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    letters = zlib.compress(np.diff(alphabet.astype(np.int64), prepend=0).astype("<u4").tobytes(), 6), zlib.compress(levels.tobytes(), 6)
    blocks = -(-len(ids) // BLOCK)
    head = struct.pack(_FIXED, MAGIC, VERSION, BLOCK, len(ids), blocks, len(alphabet), *map(len, letters)) + b"".join(letters)
    if not blocks:
        return head + struct.pack("<I", zlib.crc32(head))
    longest, last = min(BLOCK, len(ids)), len(ids) - (blocks - 1) * BLOCK
    padded = np.zeros(blocks * longest, np.uint32)
    padded[: len(ids)] = places
    words, sizes, capacity = _written_blocks(np.ascontiguousarray(padded.reshape(blocks, longest).T), last, _Frequencies(levels))
    coded = [words[k * capacity : k * capacity + n].astype("<u2").tobytes() for k, n in enumerate(sizes.tolist())]
    raw, table = memoryview(ids).cast("B"), []
    for k, part in enumerate(coded):
        some = raw[4 * k * BLOCK : 4 * (k + 1) * BLOCK]
        table.append(struct.pack("<IIII", len(some) // 4, len(part), zlib.crc32(part), zlib.crc32(some)))
    head += b"".join(table)
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(coded)


def decompress(segment: bytes) -> np.ndarray:
    """The ids of a segment; the header and every block must pass their checksums."""
    at = struct.calcsize(_FIXED)
    try:
        magic, version, block, total, blocks, letters, n_ids, n_levels = struct.unpack_from(_FIXED, segment)
        if magic != MAGIC or version != VERSION:
            raise Corrupt("not a segment of this format")
        body = at + n_ids + n_levels + 16 * blocks
        if zlib.crc32(memoryview(segment)[:body]) != struct.unpack_from("<I", segment, body)[0]:
            raise Corrupt("the header's checksum is wrong")
    except struct.error as e:
        raise Corrupt("the segment is cut off") from e
    alphabet = np.cumsum(np.frombuffer(zlib.decompress(segment[at : at + n_ids]), "<u4").astype(np.int64)).astype("<u4")
    levels = np.frombuffer(zlib.decompress(segment[at + n_ids : at + n_ids + n_levels]), np.uint8)
    table = np.frombuffer(segment, "<u4", 4 * blocks, at + n_ids + n_levels).reshape(blocks, 4).astype(np.int64)
    start = body + 4
    if len(segment) != start + table[:, 1].sum() or table[:, 0].sum() != total or len(alphabet) != letters:
        raise Corrupt("the segment is cut off")
    if not blocks:
        return np.zeros(0, "<u4")
    source = np.concatenate([np.frombuffer(segment, "<u2", offset=start), np.zeros(8, "<u2")]).astype(np.uint64)
    starts = (np.cumsum(table[:, 1]) - table[:, 1]) // 2
    raw = memoryview(segment)[start:]
    for a, size, crc in zip(starts.tolist(), table[:, 1].tolist(), table[:, 2].tolist()):
        if zlib.crc32(raw[2 * a : 2 * a + size]) != crc:
            raise Corrupt("a block's checksum is wrong")
    got = _read_blocks(source, starts, int(table[:, 0].max()), int(table[-1, 0]), _Frequencies(levels))
    ids = alphabet[got.T.ravel()[:total]]
    raw = memoryview(ids).cast("B")
    for k, (n, _, _, crc) in enumerate(table.tolist()):
        if zlib.crc32(raw[4 * k * block : 4 * (k * block + n)]) != crc:
            raise Corrupt("a block's ids differ from its checksum")
    return ids


FILES = "part int, segment int, first long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, segment_ids: int = 8_000_000) -> None:
    """Encode every text of docs (doc_id, text; a null text is empty), add the end id, and write segments to path.

    Rows are dealt by ranges of doc_id and sorted in each, so files in order of (part, segment) hold ascending ids;
    equal ids go in order of their text, so that a retried task gives the same rows. A segment ends after the
    document that brings it to ``segment_ids``; ``first`` counts the part's ids before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).encode, int(end_id).to_bytes(4, "little")
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        docs_in: list = []
        counts: list[int] = []

        def closed() -> pa.RecordBatch:
            nonlocal segment, first
            raw = b"".join(ids)
            ids.clear()
            payload = compress(np.frombuffer(raw, "<u4"))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([docs_in], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["part", "segment", "first", "doc_ids", "doc_tokens", "payload"])
            segment, first = segment + 1, first + sum(counts)
            docs_in.clear(), counts.clear()
            return row

        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                for doc_id, got in zip(some.column(0).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()])):
                    ids.append(got + end)
                    docs_in.append(doc_id)
                    counts.append(len(got) // 4 + 1)
                    size += counts[-1]
                    if size >= segment_ids:
                        yield closed()
                        size = 0
        if docs_in:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, FILES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    files = spark.read.schema(FILES).parquet(path)
    totals = files.select("part", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row for each part
    offsets = dict(zip([r["part"] for r in totals], np.cumsum([0] + [r["n"] for r in totals]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decompress(row["payload"]).tobytes()
                at, out = 0, []
                for doc_id, n in zip(row["doc_ids"], row["doc_tokens"]):
                    out.append((doc_id, offsets[row["part"]] + row["first"] + at, n, ids[4 * at : 4 * (at + n)]))
                    at += n
                if 4 * at != len(ids):
                    raise Corrupt("documents and ids of a segment differ in number")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
