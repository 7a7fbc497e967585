"""64-bit fingerprints of words and word shingles, computed on whole texts with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_RANDOM = np.random.default_rng(20_261)
#: Odd multipliers, one for each word of a shingle, from a fixed seed.
_FACTORS = _RANDOM.integers(1 << 62, (1 << 63) - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The low bytes of a word of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and marks that may stand at the ends of a word.
_MARK = _SPACE.copy()
_MARK[list(b".,;:!?\"'()[]{}<>|*#%$&/\\-_=+~`^@")] = True
#: Bytes of a text that are worked on at once.
_PIECE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def fingerprints(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the parts of ``raw`` from start to end; never nought.

    Eight bytes at a time go through an invertible mixing step, so parts of up to eight bytes never collide with
    others of their length, and no regular pattern of bytes cancels out as it does in a polynomial modulo 2^64. Parts
    of more than 4096 bytes are hashed by xxh3.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    size = end - start
    h = mixed(size.astype(np.uint64) * _FACTORS[0] ^ (eight[start] & _LOW[np.minimum(size, 8)]))
    done, more = 8, np.flatnonzero((size > 8) & (size <= 4096))
    while len(more):
        h[more] = mixed(h[more] * _FACTORS[1] ^ (eight[start[more] + done] & _LOW[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for k in np.flatnonzero(size > 4096).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]].tobytes())
    return np.maximum(h, np.uint64(1))


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """raw in pieces of about _PIECE bytes that end behind white space."""
    begin = 0
    while len(raw) - begin > _PIECE:
        end = begin + _PIECE
        while end < len(raw) and not _SPACE[raw[end - 1]]:
            gap = np.flatnonzero(_SPACE[raw[end : end + _PIECE]])
            end = end + int(gap[0]) + 1 if len(gap) else min(len(raw), end + _PIECE)
        yield raw[begin:end]
        begin = end
    yield raw[begin:]


def _words(raw: np.ndarray, strip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of a piece in lower case, and where they begin; see ``word_hashes``."""
    edge = np.flatnonzero(np.diff(_SPACE[raw].view(np.int8), prepend=1, append=1))
    start, end = edge[::2].copy(), edge[1::2].copy()
    if strip and len(start):
        letter = np.flatnonzero(~_MARK[raw])  # the next letter behind a mark, the last one before it
        for k in (np.flatnonzero(_MARK[raw[start]]), np.flatnonzero(_MARK[raw[end - 1]])):
            at = np.searchsorted(letter, start[k])
            start[k] = np.append(letter, len(raw))[at]
            end[k] = np.append(-1, letter)[np.searchsorted(letter, end[k])] + 1
        some = start < end
        start, end = start[some], end[some]
    return fingerprints(raw, start, end), start


def word_hashes(text: bytes, strip: bool = False) -> np.ndarray:
    """A fingerprint of each word of a text, A-Z as a-z.

    With ``strip``, of each word without the ASCII marks at its ends; words of marks alone are then left out.
    """
    out = [_words(raw, strip)[0] for raw in _pieces(np.frombuffer(text.lower(), dtype=np.uint8))]
    return out[0] if len(out) == 1 else np.concatenate(out)


def all_word_hashes(texts: list[bytes], strip: bool = False) -> list[np.ndarray]:
    """word_hashes of each text; short texts are worked on together."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and size + len(texts[upto]) < _PIECE // 4:
            size += len(texts[upto]) + 1
            upto += 1
        if upto == at:
            out.append(word_hashes(texts[at], strip))
            at += 1
            continue
        code, start = _words(np.frombuffer(b"\n".join(texts[at:upto]).lower(), dtype=np.uint8), strip)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[at:upto]])
        bound = np.searchsorted(start, begin).tolist()
        out += [code[a:b] for a, b in zip(bound, bound[1:])]
        at = upto
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k words, given by their own, in order; fewer words are one run."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = h[: len(h) - k + 1] * _FACTORS[0]
    for i in range(1, k):
        out = out + h[i : len(h) - k + 1 + i] * _FACTORS[i]
    return mixed(out + np.uint64(k))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    return text.lower().split()


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct fingerprints of a text's k-word shingles; empty without words."""
    return np.unique(rolling(word_hashes(text), k))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """shingle_set of each text."""
    out = []
    for h in all_word_hashes(texts):
        grams = rolling(h, k)
        grams.sort()
        out.append(grams[np.flatnonzero(np.diff(grams, prepend=~grams[:1]))] if len(grams) > 1 else grams)
    return out
