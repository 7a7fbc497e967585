"""Minimum-bin-slack packing of tokenised documents into fixed windows (operator 9)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()),
])


def fill(lengths: list[int], count: Callable[[int], int], room: int) -> dict[int, int]:
    """The multiset, {length: how many}, of the given sorted lengths whose sum is closest to ``room`` from below.

    Bit s of ``sums`` is set when some multiset of the lengths seen so far adds up to s. Copies of one length
    enter in powers of two. The search stops at the first exact fill; the states before each step lead back to
    the counts.
    """
    sums, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, copies, sums before
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        left, copies = min(count(length), room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, sums))
            sums |= (sums << (length * copies)) & mask
            left -= copies
            copies *= 2
        if sums >> room & 1:
            break
    total, used = sums.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            total -= length * copies
            used[length] = used.get(length, 0) + copies
    return used


class Packer:
    """Packs the documents of one task. ``add`` takes tokenised documents, ``pack`` yields the pieces.

    A document's full windows stand alone; what remains goes by length into a multiset. Each window takes the
    longest remainder and the multiset of others that leaves least slack; slack that is left is filled with a
    cut from another remainder, so only a task's last window is short. That one is cut into windows of powers
    of two, which need no padding.
    """

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.rest: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []  # those in rest, in ascending order
        self.tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        """pieces: (doc_id, start, ids, tokens of the document), which lie in one window in this order."""
        total, offset = sum(len(p[2]) // 4 for p in pieces), 0
        padded = total if total & (total - 1) == 0 else self.capacity
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, tokens, self.sequence, offset, padded))
            offset += n
        self.sequence += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step, tokens = 4 * self.capacity, len(ids) // 4
        for k in range(0, len(ids) - step + 1, step):
            self._emit([(doc_id, k // 4, ids[k : k + step], tokens)])
        if tail := len(ids) % step:
            self._keep((doc_id, (len(ids) - tail) // 4, ids[len(ids) - tail :], tokens))

    def _keep(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        if length not in self.rest:
            self.rest[length] = []
            insort(self.lengths, length)
        self.rest[length].append(piece)
        self.tokens += length

    def _take(self, length: int) -> tuple:
        stack = self.rest[length]
        piece = stack.pop()
        if not stack:
            del self.rest[length], self.lengths[bisect_left(self.lengths, length)]
        self.tokens -= length
        return piece

    def _cut(self, length: int, room: int) -> tuple:
        """The first ``room`` tokens of a remainder; the others go back."""
        doc_id, start, ids, tokens = self._take(length)
        if length > room:
            self._keep((doc_id, start + room, ids[4 * room :], tokens))
        return doc_id, start, ids[: 4 * room], tokens

    def pack(self, keep: int) -> None:
        """Fill windows while more than ``keep`` tokens remain, and at least one window's worth."""
        while self.tokens >= max(keep, self.capacity):
            pieces = [self._take(self.lengths[-1])]
            room = self.capacity - len(pieces[0][2]) // 4
            used = fill(self.lengths, lambda n: len(self.rest[n]), room) if room else {}
            for length, n in used.items():
                pieces += [self._take(length) for _ in range(n)]
            room -= sum(k * n for k, n in used.items())
            while room:
                longest = self.lengths[-1]
                pieces.append(self._cut(longest, room))
                room -= min(longest, room)
            self._emit(pieces)

    def close(self) -> None:
        self.pack(0)
        while self.tokens:
            room, pieces = 1 << (self.tokens.bit_length() - 1), []
            while room:
                longest = self.lengths[-1]
                pieces.append(self._cut(longest, room))
                room -= min(longest, room)
            self._emit(pieces)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_ARROW), _ARROW.types)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, window_tokens: int = 2_000_000) -> DataFrame:
    """Pieces of all documents, each at its place in a sequence of at most ``capacity`` ids.

    docs: doc_id and text; other columns are ignored. A null text counts as empty, an empty one gives the end id
    alone; repeated rows are packed once each; an empty table gives no rows. Each task packs the documents it
    reads, ``window_tokens`` of remainders at a time, so nothing is shuffled, no group is gathered and a retried
    task gives the same rows. Sequence ids hold the partition in their upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = int(end_id).to_bytes(4, "little")
        packer = Packer(capacity, (TaskContext.get().partitionId()) << 36)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 500):
                for doc_id, got in zip(ids[k : k + 500], encode([t or "" for t in texts[k : k + 500].to_pylist()])):
                    packer.add(doc_id, got + end)
                if packer.tokens > 2 * window_tokens:
                    packer.pack(window_tokens)
                if packer.rows:
                    yield packer.taken()
        packer.close()
        yield packer.taken()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
