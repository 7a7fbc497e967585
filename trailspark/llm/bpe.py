"""Byte pair encoding by a segment tree over pair ranks, and its inverse (operator 12)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from trailspark.llm.tokens import CachedEncoder

#: Characters of a text that are encoded at once; longer texts are cut before a blank, which belongs to no word.
PIECE = 1 << 20
#: No pair here can be merged.
_NEVER = 1 << 62


def merge(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """ids after all merges, always the leftmost pair of lowest rank first.

    ranks: pair -> (rank, merged id). Leaf i of a segment tree holds rank * n + i for the pair that begins at i, so
    the root yields that pair. A merge empties the leaf of the right-hand id and renews two others, each in as many
    steps as the tree is high.
    """
    n = len(ids)
    if n < 2:
        return ids
    ids, size = list(ids), 1 << (n - 2).bit_length()
    tree = [_NEVER] * (2 * size)
    for i in range(n - 1):
        if pair := ranks.get((ids[i], ids[i + 1])):
            tree[size + i] = pair[0] * n + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            value = min(value, tree[k ^ 1])
            k >>= 1
            if tree[k] == value:
                break
            tree[k] = value

    while (least := tree[1]) < _NEVER:
        i = least % n
        gone = after[i]
        ids[i] = ranks[ids[i], ids[gone]][1]
        ids[gone] = -1
        right, left = after[gone], before[i]
        after[i] = right
        if right < n:
            before[right] = i
        if gone < n - 1:
            put(gone, _NEVER)
        pair = ranks.get((ids[i], ids[right])) if right < n else None
        put(i, pair[0] * n + i if pair else _NEVER)
        if left >= 0:
            pair = ranks.get((ids[left], ids[i]))
            put(left, pair[0] * n + left if pair else _NEVER)
    return [x for x in ids if x >= 0]


class Merger:
    """The merges of a vocabulary for many words at once: one segment tree for each word, side by side in an array."""

    #: Ids of a word up to which trees stand side by side; longer words have ``merge``.
    LONGEST = 65

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        self.ranks = ranks
        self.shift = np.int64(max((x for pair in ranks for x in pair), default=0)).item().bit_length() + 1
        pairs = np.array([(a << self.shift) + b for a, b in ranks] or [0], np.int64)
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        found = np.array([*ranks.values()] or [(0, 0)], np.int64)
        self.rank, self.merged = found[order, 0], np.zeros(found[:, 0].max() + 1, np.int64)
        self.merged[found[:, 0]] = found[:, 1]
        if not ranks:
            self.pairs[:] = -1

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank * 128 + position of the pairs that merge; ids below nought stand for nothing."""
        pair = (left << self.shift) + right
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[k] == pair) & (left >= 0) & (right >= 0), self.rank[k] * 128 + at, _NEVER)

    def _side_by_side(self, ids: np.ndarray, size: int) -> None:
        """Merge the columns of ids, of shape (size + 2, words), in place; what was merged away becomes -1."""
        words = ids.shape[1]
        tree = np.empty((2 * size, words), np.int64)
        tree[size:] = self._keys(ids[:size], ids[1 : size + 1], np.arange(size)[:, None])
        for k in range(size - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        after = np.repeat(np.arange(1, size + 3)[:, None], words, 1)
        before = np.repeat(np.arange(-1, size + 1)[:, None], words, 1)
        now = np.flatnonzero(tree[1] < _NEVER)
        while len(now):
            least = tree[1, now]
            i = least % 128
            gone = after[i, now]
            new = self.merged[least // 128]
            ids[i, now], ids[gone, now] = new, -1
            right, left = after[gone, now], before[i, now]
            after[i, now] = right
            before[np.minimum(right, size + 1), now] = i
            none = left < 0
            left = np.where(none, i, left)
            keys = self._keys(np.stack([ids[left, now], new]), np.stack([new, ids[np.minimum(right, size + 1), now]]), np.stack([left, i]))
            leaf = np.stack([np.where(gone < size, gone, i), np.where(none, i, left), i])
            tree[size + leaf[0], now] = _NEVER
            tree[size + leaf[1], now] = keys[0]
            tree[size + leaf[2], now] = keys[1]  # last, since the others fall back on it
            node = size + leaf
            while node[0, 0] > 1:
                node = node >> 1
                tree[node, now] = np.minimum(tree[2 * node, now], tree[2 * node + 1, now])
            now = now[tree[1, now] < _NEVER]

    def merge(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words that end at ``ends``, merged, and how many ids each word has then."""
        n = np.diff(ends, prepend=0)
        out, begin = ids.astype(np.int64), ends - n
        size = np.where(n < 2, 0, np.int64(1) << np.ceil(np.log2(np.maximum(n - 1, 1))).astype(np.int64))
        for s in np.unique(size[(n >= 2) & (n <= self.LONGEST)]).tolist():
            chosen = np.flatnonzero((size == s) & (n <= self.LONGEST))
            for k in range(0, len(chosen), 4096):
                some = chosen[k : k + 4096]
                at = begin[some] + np.arange(s + 2)[:, None]
                inside = at < ends[some]
                square = np.where(inside, out[np.minimum(at, len(out) - 1)], -1)
                self._side_by_side(square, s)
                out[at[inside]] = square[inside]
        for k in np.flatnonzero(n > self.LONGEST).tolist():
            own = merge(out[begin[k] : ends[k]].tolist(), self.ranks)
            out[begin[k] : ends[k]] = own + [-1] * (n[k] - len(own))
        kept = out >= 0
        upto = np.append(0, np.cumsum(kept))
        return out[kept], upto[ends] - upto[begin]


class TreeEncoder(CachedEncoder):
    """Text to ids, with the library's normaliser and word pattern and the merges of ``Merger``.

    Words that were met before come from the table of the base class. The strings of special tokens become their ids,
    as they do in the library.
    """

    def __init__(self, path: str, limit: int):
        super().__init__(path, limit)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or not model["end_of_word_suffix"] or not self.drops_space:
            raise ValueError("only byte pair vocabularies with word ends that drop white space are read")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merger = Merger({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)})
        letters = {c: i for c, i in vocab.items() if len(c) == 1}
        self.inner, self.last = np.full((2, max(map(ord, letters)) + 1), -1, np.int64)
        for c, i in letters.items():
            self.inner[ord(c)], self.last[ord(c)] = i, vocab.get(c + suffix, -1)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in byte letters, one behind the other, and how many each has."""
        ends = np.cumsum([len(w) for w in words])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        ids = self.inner[letters]
        ids[ends - 1] = self.last[letters[ends - 1]]
        return self.merger.merge(ids, ends)

    def _plain(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens; after normalisation a blank is the only white space."""
        words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        if not words:
            return np.zeros(0, np.int64)
        met = list(dict.fromkeys(words))
        place = dict(zip(met, range(len(met))))
        ids, n = self._merged(met)
        first, which = np.cumsum(n) - n, np.array([place[w] for w in words])
        upto = np.cumsum(n[which])
        return ids[np.repeat(first[which] - upto + n[which], n[which]) + np.arange(upto[-1])]

    def _direct(self, texts: list[str]) -> list[bytes]:
        if not hasattr(self, "merger"):  # the base class tries the library's habits first
            return super()._direct(texts)
        out = []
        for text in texts:
            ids, begin = [], 0
            for m in self.cut.finditer(text) if self.cut else ():
                ids += [self._plain(text[begin : m.start()]), [self.special[m[0]]]]
                begin = m.end()
            ids.append(self._plain(text[begin:]))
            out.append(np.concatenate(ids).astype("<u4").tobytes())
        return out

    def _separate(self, parts: list[str]) -> list[bytes]:
        """Ids of many parts without white space: all are normalised and cut into words in one call."""
        text = self.tokenizer.normalizer.normalize_str(" ".join(parts))
        chunks = text.split(" ")
        if len(chunks) != len(parts) or (self.cut and self.cut.search(text)):
            return self._direct(parts)
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        if not words:
            return [b""] * len(parts)
        ids, n = self._merged([w for w, _ in words])
        behind = np.cumsum([len(c) + 1 for c in chunks])
        of = np.searchsorted(behind, [a for _, (a, _) in words], side="right")
        upto = np.append(0, np.cumsum(np.bincount(of, weights=n, minlength=len(parts)).astype(np.int64))) * 4
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces, of = [], []
        for k, text in enumerate(texts):
            begin = 0
            while len(text) - begin > PIECE and (end := text.rfind(" ", begin + 1, begin + PIECE)) > 0:
                pieces.append(text[begin:end])
                of.append(k)
                begin = end
            pieces.append(text[begin:])
            of.append(k)
        marked = [self.cut is not None and "<" in p and self.cut.search(p) is not None for p in pieces]
        plain = iter(super().encode([p for p, m in zip(pieces, marked) if not m]))
        direct = iter(self._direct([p for p, m in zip(pieces, marked) if m]))
        out = [b""] * len(texts)
        for k, m in zip(of, marked):
            got = next(direct if m else plain)
            out[k] = out[k] + got if out[k] else got
        return out


_ENCODERS: dict[str, TreeEncoder] = {}


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in lists of at most 500 rows or, above one row, about 4 MB."""
    now, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if now and (len(now) == 500 or size + len(t) > 4_000_000):
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t)
    if now:
        yield now


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row; what stands in further columns is ignored.

    A null text counts as empty and has no ids, repeated rows are encoded once each, an empty table gives no rows. A
    text is worked on in pieces of about 1 MB, a word of any length by the tree alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[tokenizer_path] = TreeEncoder(tokenizer_path, 1_000_000)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                ids = [np.frombuffer(x, "<i4") for x in _ENCODERS[tokenizer_path].encode(texts)]
                offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], names=["doc_id", "ids"])
                at += len(texts)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, docs.select("doc_id").schema.add("ids", ArrayType(IntegerType())))


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """tokens with their text in ``decoded``, special tokens included; null ids give an empty text, unknown ones nothing.

    The vocabulary names no decoder, so the library puts the tokens' strings side by side with a blank between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        if tokenizer.decoder is not None:
            raise ValueError("only vocabularies without a decoder are read")
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        strings = [b""] * (max(vocab.values()) + 2)
        for token, i in vocab.items():
            strings[i] = token.encode() + b" "
        width = np.array([len(s) for s in strings], np.int64)
        first, pool = np.cumsum(width) - width, np.frombuffer(b"".join(strings), np.uint8)
        last = len(strings) - 1  # stands for all unknown ids

        def text(ids: np.ndarray) -> bytes:
            out = []
            for k in range(0, len(ids), PIECE):
                now = ids[k : k + PIECE]
                now = np.where((now >= 0) & (now < last), now, last)
                n = width[now]
                upto = np.cumsum(n)
                out.append(pool[np.repeat(first[now] - upto + n, n) + np.arange(upto[-1])].tobytes())
            return b"".join(out)[:-1]

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            decoded, kept, size, begin = [], 0, 0, 0
            for k in range(len(column)):
                decoded.append(text(flat[offsets[k] : offsets[k + 1]]) if column[k].is_valid else b"")
                size += len(decoded[-1])
                kept += 1
                if size > 4_000_000 or k == len(column) - 1:
                    yield pa.RecordBatch.from_arrays([*(c.slice(begin, kept) for c in batch.columns), pa.array(decoded, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "decoded"])
                    decoded, begin, kept, size = [], begin + kept, 0, 0

    return tokens.mapInArrow(run, tokens.select("*").schema.add("decoded", "string"))
