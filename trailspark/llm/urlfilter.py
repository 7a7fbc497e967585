"""URL rules and glob patterns as one bit-parallel Shift-And automaton (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host of canonical URLs begins behind this mark, so that a rule's host starts at a label.
LABEL = "."


@dataclass(frozen=True)
class Rule:
    """verdict ``allow`` or ``block`` for ``host`` with all its subdomains, from a path prefix on."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*{LABEL}{_literal(self.host)}{_SEP}{_literal(self.path)}*"


#: Between host and path of a canonical URL; stands in neither.
_SEP = "\x00"


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("*", "\\*").replace("?", "\\?")


def parse(glob: str) -> tuple[list[int], list[bool]]:
    """A glob's positions (byte value, or -1 for any byte) and, for 0 to all of them matched, whether a star waits there."""
    at, stars, raw, k = [], [False], glob.encode(), 0
    while k < len(raw):
        c = raw[k]
        if c == 0x5C and k + 1 < len(raw):
            k += 1
            at.append(raw[k])
            stars.append(False)
        elif c == 0x2A:
            stars[-1] = True
        else:
            at.append(-1 if c == 0x3F else c)
            stars.append(False)
        k += 1
    return at, stars


class Automaton:
    """All globs at once: bit j of a state says that the positions before j of its glob have matched.

    Each glob takes one bit more than it has positions, in a row of 64-bit words; ``step[c]`` keeps the bits that
    a byte c moves on from, ``star`` those that stay whatever comes. Urls go through in lockstep.
    """

    def __init__(self, globs: Sequence[str]):
        parsed = [parse(g) for g in globs]
        self.words = max(1, -(-sum(len(at) + 1 for at, _ in parsed) // 64))
        step, self.star, self.first, self.last = np.zeros((256, self.words), np.uint64), np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64), []
        bit = 0
        for at, stars in parsed:
            self._set(self.first, bit)
            for j, c in enumerate(at):
                for row in step if c < 0 else step[c : c + 1]:
                    self._set(row, bit + j)
            for j, star in enumerate(stars):
                if star:
                    self._set(self.star, bit + j)
            bit += len(at) + 1
            self.last.append(bit - 1)
        self.step = step

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which globs match each whole text: (texts, globs)."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order])
        flat = np.frombuffer(b"".join(texts[i] for i in order) or b"\0", dtype=np.uint8)
        start = np.cumsum(sizes) - sizes
        state = np.tile(self.first, (len(texts), 1))
        for k in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -k, side="left"))  # texts longer than k
            now = state[:n]
            moved = now & self.step[flat[start[:n] + k]]
            carry = moved >> np.uint64(63)
            shifted = moved << np.uint64(1)
            shifted[:, 1:] |= carry[:, :-1]
            state[:n] = shifted | (now & self.star)
        last = np.array(self.last, dtype=np.int64)
        hits = (state[:, last >> 6] >> (last & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        out = np.empty_like(hits)
        out[order] = hits
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path without query and fragment; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def judge(pages: DataFrame, rules: Sequence[Rule], block_globs: Sequence[str], allow_globs: Sequence[str] = ()) -> DataFrame:
    """Every column of pages, and host, path, rule (its name or null) and verdict of column ``url``.

    The longest rule that fits decides (by name, then host). Without one, ``allow`` if an allow glob matches the
    canonical URL ``.host\\0path``, else ``block`` if a block glob does, else ``allow``. Globs know ``*``, ``?``
    and ``\\`` before a literal. Columns of these four names in pages are replaced; repeated rows are kept.
    """
    made = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c.lower() not in made]
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    globs = [*[r.glob for r in ordered], *allow_globs, *block_globs]
    host, path = host_and_path(F.col("url").cast("string"))
    given = pages.select(*[f"`{c}`" for c in rest], host.alias("host"), path.alias("path"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        names = np.array([r.name for r in ordered] + [None], dtype=object)
        says = np.array([r.verdict for r in ordered] + [""], dtype=object)
        n_rules, n_allow = len(ordered), len(allow_globs)
        for batch in batches:
            hosts, paths = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            hit = automaton.match([(LABEL + h + _SEP + p).encode() for h, p in zip(hosts, paths)])
            by_rule = hit[:, :n_rules]
            which = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1) if n_rules else 0, n_rules)
            blocked = hit[:, n_rules + n_allow :].any(axis=1) & ~hit[:, n_rules : n_rules + n_allow].any(axis=1)
            verdict = np.where(which < n_rules, says[which], np.where(blocked, "block", "allow"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[which], pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return given.mapInArrow(run, f"{fields}, rule string, verdict string")
