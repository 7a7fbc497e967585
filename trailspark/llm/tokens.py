"""Encoding with the tokenizers library and a table of known parts, used inside tasks.

Both public BPE tokenizers split a text into words before they merge anything, and a blank or a new line never
stands inside or at the end of such a word; nor does a mark that follows a letter stand in the letter's word. Text is
therefore cut before each run of blanks and new lines and before a mark at a word's end, and the ids of a part are
remembered. A tokenizer that drops white space gets the words themselves. A text with any other white space goes to
the library as a whole, since word patterns treat mixed runs together.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from trailspark.llm.shingles import fingerprints

_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Space to one side only: str.split, the word patterns, or one byte and not another.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_BLANKS = np.isin(np.arange(256), list(b" \n"))
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Normaliser and word pattern under which a run of plain letters, and the marks behind it, are a word each.
_LOWER_WORDS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
#: Letters of ASCII and Latin-1, then marks of ASCII without the apostrophe: composed already, and each in lower case by itself.
_PLAIN = re.compile(r"([a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_ENCODERS: dict[tuple[str, int], "CachedEncoder"] = {}

#: Bytes of a part beyond which it is encoded each time.
LONGEST_CACHED = 64


class _Table:
    """Where the ids of a part lie in ``pool``, by the part's 64-bit fingerprint; open addressing in arrays."""

    def __init__(self) -> None:
        self.n, self.used = 0, 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self._empty(1 << 16)

    def _empty(self, slots: int) -> None:
        self.mask, self.shift = slots - 1, np.uint64(64 - (slots.bit_length() - 1))
        self.key, self.first, self.count = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.uint16)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each fingerprint, or the empty slot in its place, and whether it is there."""
        slot = (code >> self.shift).astype(np.int64)
        found = self.key[slot]
        left = np.flatnonzero((found != code) & (found != 0))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            found = self.key[slot[left]]
            left = left[(found != code[left]) & (found != 0)]
        return slot, self.key[slot] == code

    def _put(self, code: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        left = np.arange(len(code))
        while len(left):
            slot, _ = self.find(code[left])
            slot, which = np.unique(slot, return_index=True)  # of those that meet in one slot, one goes in
            now = left[which]
            self.key[slot], self.first[slot], self.count[slot] = code[now], first[now], count[now]
            left = np.delete(left, which)

    def add(self, code: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Put distinct fingerprints that aren't there into the table."""
        self.n += len(code)
        if 2 * self.n > self.mask:
            held = np.flatnonzero(self.key)
            old = self.key[held], self.first[held], self.count[held]
            self._empty(1 << (4 * self.n).bit_length())
            self._put(*old)
        self._put(code, first, count)

    def extend(self, ids: np.ndarray) -> int:
        """Append ids to the pool; where they begin."""
        begin, need = self.used, self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[:begin], np.zeros(need + begin // 2 - begin, np.uint32)])
        self.pool[begin:need], self.used = ids, need
        return begin


class CachedEncoder:
    """Text to ids as little-endian unsigned 32-bit integers, equal to the library's own result.

    The table is emptied beyond ``limit`` parts (about 60 bytes a part).
    """

    def __init__(self, path: str, limit: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = max(special, default=(-1, ""))
        #: Bytes that each id stands for, where the tokenizer keeps every byte of a text.
        self.widths = None
        if self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel":
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.widths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            self.widths[list(vocab.values())] = [len(w) for w in vocab]
        blank, both, x, y, upper = self._direct([" \n\t ", "x \n y", "x", "y", "X"])
        self.drops_space = not blank and both == x + y
        self.odd = _ODD_SPACE if self.drops_space else _OTHER_SPACE
        self.lowers = upper == x
        self.limit, self.table = limit, _Table()
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        #: Whether plain words may go to the library's model at once, past its normaliser and word pattern.
        self.plain = [given["normalizer"], given["pre_tokenizer"]] == _LOWER_WORDS
        self.model = self.tokenizer.model
        if self.plain:
            hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
            self.visible = {b: 256 + k for k, b in enumerate(hidden)}  # as the library writes bytes that have no sign

    def _direct(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in got]

    def _modelled(self, letters: str, marks: str) -> bytes:
        """Ids of a plain word and the marks behind it."""
        word = letters.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.visible)
        got = self.model.tokenize(word) + self.model.tokenize(marks) if marks else self.model.tokenize(word)
        return b"".join([t.id.to_bytes(4, "little") for t in got])

    def _separate(self, parts: list[str]) -> list[bytes]:
        """Ids of many short texts: plain words by the library's model, others in one call."""
        if not self.plain:
            return self._joined(parts)
        met = [_PLAIN.fullmatch(p) for p in parts]
        rest = iter(self._joined(others) if (others := [p for p, m in zip(parts, met) if m is None]) else ())
        return [next(rest) if m is None else self._modelled(*m.groups()) for m in met]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Ids of many short texts in one call: a special token between them keeps them apart."""
        if self.widths is not None:
            joinable = [p for p in parts if p[0] in " \n" and p[-1] not in " \n"]
            if len(joinable) == len(parts):
                ids = np.array(self.tokenizer.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
                at = np.cumsum(self.widths[ids])
                ends = np.searchsorted(at, np.cumsum([len(p.encode()) for p in parts]), side="right")
                raw, starts = ids.tobytes(), np.append(0, ends[:-1])
                return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
            others = [p for p in parts if p[0] not in " \n" or p[-1] in " \n"]
            got = dict(zip(others, self._direct(others)))
            got.update(zip(joinable, self._joined(joinable)) if joinable else ())
            return [got[p] for p in parts]
        if not self.mark or (joined := self.mark.join(parts)).count(self.mark) != len(parts) - 1:
            return self._direct(parts)
        self.tokenizer.encode_special_tokens = False
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        self.tokenizer.encode_special_tokens = True
        ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
        if len(ends) != len(parts):
            return self._direct(parts)
        raw, starts = ids.tobytes(), np.append(0, ends[:-1] + 1)
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]

    def _parts(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte of each part of joined texts that begin at ``begins``."""
        blank = (_SPACES if self.drops_space else _BLANKS)[raw]
        begin = np.zeros(len(raw) + 1, bool)
        begin[begins] = begin[-1] = True
        after = np.empty(len(raw), bool)  # whether a text or blanks begin behind a byte
        after[:-1], after[-1] = blank[1:], True
        after |= begin[1:]
        mark = _MARK[raw] & after
        mark[0], mark[1:] = False, mark[1:] & _LETTER[raw[:-1]] & ~begin[1:-1]
        if self.drops_space:
            start, end = ~blank, ~blank & after
            start[1:] &= blank[:-1] | begin[1:-1] | mark[1:]
            end[:-1] |= mark[1:]
            return np.flatnonzero(start), np.flatnonzero(end) + 1
        cut = mark | begin[:-1]
        cut[1:] |= blank[1:] & ~blank[:-1]
        at = np.flatnonzero(cut)
        return at, np.append(at[1:], len(raw))

    def _looked_up(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = b"".join(texts)
        if not joined:
            return [b""] * len(texts)
        if self.lowers:
            joined = joined.lower()  # A-Z alone
        raw, begins = np.frombuffer(joined, np.uint8), np.cumsum(sizes) - sizes
        start, end = self._parts(raw, begins[sizes > 0])
        code = fingerprints(raw, start, end)
        table = self.table
        slot, hit = table.find(code)
        first, count = table.first[slot].astype(np.int64), table.count[slot].astype(np.int64)
        committed = table.used
        if len(miss := np.flatnonzero(~hit)):
            new, at, back = np.unique(code[miss], return_index=True, return_inverse=True)
            at = miss[at]
            got: list[bytes] = []
            for k in range(0, len(at), 5_000):
                got += self._separate([joined[a:b].decode() for a, b in zip(start[at[k : k + 5_000]].tolist(), end[at[k : k + 5_000]].tolist())])
            short = end[at] - start[at] <= LONGEST_CACHED
            order = np.argsort(~short, kind="stable")  # those to be kept come first
            n = np.array([len(g) // 4 for g in got], np.int64)
            where = np.empty(len(new), np.int64)
            where[order] = table.extend(np.frombuffer(b"".join([got[k] for k in order.tolist()]), "<u4")) + np.cumsum(n[order]) - n[order]
            first[miss], count[miss] = where[back], n[back]
            committed += int(n[short].sum())
            table.add(new[short], where[short], n[short])
        upto = np.append(0, np.cumsum(count))
        ids = table.pool[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])]
        table.used = committed
        if table.n > self.limit:
            self.table = _Table()
        bounds = (4 * upto[np.append(np.searchsorted(start, begins), len(start))]).tolist()
        out = ids.astype("<u4", copy=False).tobytes()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [self.odd.search(t) is not None for t in texts]
        known = iter(self._looked_up([t.encode() for t, odd in zip(texts, whole) if not odd]))
        others = iter(self._direct([t for t, odd in zip(texts, whole) if odd]))
        return [next(others if odd else known) for odd in whole]


def encoder(path: str, limit: int = 1_500_000) -> CachedEncoder:
    """This worker's encoder for a vocabulary file. Only one is held at a time."""
    key = (path, limit)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = CachedEncoder(path, limit)
    return _ENCODERS[key]
